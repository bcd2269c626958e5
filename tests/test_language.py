"""Query texts on small graphs, against bags worked out by hand."""

import pytest

from quadloom.engine import Engine, values
from quadloom.plans import algebra as A
from quadloom.plans.parser import SyntaxProblem, parse, parse_update
from quadloom.sources import rdf

DATA = """
<urn:a> <urn:knows> <urn:b> .
<urn:b> <urn:knows> <urn:c> .
<urn:c> <urn:knows> <urn:a> .
<urn:a> <urn:name> "Ann"@en .
<urn:b> <urn:name> "Bob" .
<urn:a> <urn:age> "30"^^<http://www.w3.org/2001/XMLSchema#integer> .
<urn:b> <urn:age> "30.0"^^<http://www.w3.org/2001/XMLSchema#decimal> .
<urn:c> <urn:age> "old" .
<urn:c> <urn:has> _:x .
_:x <urn:value> "line\\none \\"q\\" \\\\n" .
# a comment
not a triple
<urn:g1> <urn:in> "1" <urn:graph1> .
<urn:g1> <urn:in> "1" <urn:graph2> .
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, rdf.parse_lines(spark.createDataFrame([(x,) for x in DATA.split("\n")], "value string")).cache())


def bag(df):
    return sorted((tuple(r) for r in values(df).collect()), key=str)


CASES = [
    ("SELECT ?x { ?x <urn:knows>/<urn:knows> <urn:c> }", [("urn:a",)]),
    ("SELECT ?x { <urn:a> <urn:knows>+ ?x }", [("urn:a",), ("urn:b",), ("urn:c",)]),
    ("SELECT ?x { ?x <urn:knows>* <urn:z> }", [("urn:z",)]),
    ("SELECT ?x { <urn:a> ^<urn:knows>|<urn:name> ?x }", [("Ann",), ("urn:c",)]),
    ("SELECT ?x { <urn:a> !(<urn:knows>|^<urn:knows>) ?x }", [("30",), ("Ann",)]),
    ("SELECT ?x ?y { ?x <urn:age> ?a . ?y <urn:age> ?b FILTER(?a = ?b && ?x != ?y) }", [("urn:a", "urn:b"), ("urn:b", "urn:a")]),
    ("SELECT ?x { ?x <urn:age> 30 }", [("urn:a",)]),
    ("SELECT ?x { ?x <urn:age> ?a FILTER(?a < 31) }", [("urn:a",), ("urn:b",)]),
    ("SELECT ?x { ?x <urn:name> 'Ann' }", []),
    ("SELECT ?x { ?x <urn:name> 'Ann'@EN }", [("urn:a",)]),
    ("SELECT ?n { ?x <urn:name> ?n FILTER LANGMATCHES(LANG(?n), 'en') }", [("Ann",)]),
    ("SELECT ?v { <urn:c> <urn:has> [ <urn:value> ?v ] }", [('line\none "q" \\n',)]),
    ("SELECT ?x ?n { ?x <urn:age> ?a OPTIONAL { ?x <urn:name> ?n } }", [("urn:a", "Ann"), ("urn:b", "Bob"), ("urn:c", None)]),
    ("SELECT ?x { ?x <urn:age> ?a OPTIONAL { ?x <urn:name> ?n } FILTER(!BOUND(?n)) }", [("urn:c",)]),
    ("SELECT ?x { ?x <urn:age> ?a MINUS { ?x <urn:name> ?n } }", [("urn:c",)]),
    ("SELECT ?x { ?x <urn:age> ?a FILTER NOT EXISTS { ?x <urn:name> ?n FILTER(?n = 'Bob') } }", [("urn:a",), ("urn:c",)]),
    ("SELECT (COUNT(*) AS ?n) (COUNT(DISTINCT ?p) AS ?m) { ?s ?p ?o }", [("11", "6")]),  # one triple is in two graphs
    ("SELECT ?g { GRAPH ?g { <urn:g1> ?p ?o } }", [("urn:graph1",), ("urn:graph2",)]),
    ("SELECT ?o FROM <urn:graph1> FROM <urn:graph2> { ?s ?p ?o }", [("1",)]),
    ("SELECT ?o FROM NAMED <urn:graph1> { GRAPH ?g { ?s ?p ?o } }", [("1",)]),
    ("SELECT ?x { VALUES ?x { 1 UNDEF } VALUES ?x { 1 2 UNDEF } }", [("1",), ("1",), ("1",), ("2",), (None,)]),
    ("SELECT ?x (SUM(?a) AS ?t) { ?x <urn:age> ?a } GROUP BY ?x", [("urn:a", "30"), ("urn:b", "30"), ("urn:c", None)]),
    ("SELECT (GROUP_CONCAT(DISTINCT ?p; SEPARATOR=',') AS ?l) { <urn:a> ?q ?o BIND(STRAFTER(STR(?q), ':') AS ?p) }", [("age,knows,name",)]),
    ("SELECT (1 + 2 * 3 - 4 / 2 AS ?x) (-(2) AS ?y) (2 > 1 || 1/0 > 1 AS ?z) { }", [("5", "-2", "true")]),
    ("SELECT (IF(1/0 = 1, 'a', 'b') AS ?x) (COALESCE(1/0, 'c') AS ?y) (ROUND(2.5) AS ?r) (STRLEN('é') AS ?l) { }", [(None, "c", "3", "1")]),
    ("SELECT (SUBSTR('abcdef', 0, 3) AS ?x) (SUBSTR('abc', 5) AS ?y) (STRBEFORE('abc', '') AS ?z) (CONCAT('a'@en, 'b'@en) AS ?c) { }", [("ab", "", "", "ab")]),
    ("SELECT ?x { ?x <urn:age> ?a } ORDER BY ?a LIMIT 1", [("urn:c",)]),
    ("SELECT DISTINCT ?p { ?s ?p ?o FILTER(STRSTARTS(STR(?p), 'urn:k')) }", [("urn:knows",)]),
    ("SELECT ?x { { SELECT ?x { ?x <urn:name> ?n } ORDER BY ?n LIMIT 1 } ?x <urn:knows> ?y }", [("urn:a",)]),
    ("SELECT ?x { ?x <urn:age> ?a FILTER(?a IN (30, 'old')) }", [("urn:a",), ("urn:b",), ("urn:c",)]),
    ("SELECT ?x { ?x <urn:knows> ?x }", []),
    ("SELECT * { <urn:c> <urn:has> _:b . _:b <urn:value> ?v . ?x <urn:name> 'Bob' }", [('line\none "q" \\n', "urn:b")]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_select(engine, text, want):
    assert bag(engine.query(text)) == sorted(want, key=str)


def test_forms(engine):
    assert engine.query("ASK { <urn:a> <urn:knows> ?x }") is True and engine.query("ASK { <urn:a> <urn:nothing> ?x }") is False
    made = engine.query("CONSTRUCT { ?x <urn:is> ?n . ?n <urn:bad> 1 . _:new <urn:of> ?x } WHERE { ?x <urn:name> ?n }")
    rows = made.collect()
    assert len(rows) == 4 and {r.s_kind for r in rows} == {1, 2} and len({r.s for r in rows if r.s_kind == 1}) == 2
    assert {(r.s_kind, r.p) for r in engine.query("DESCRIBE <urn:c>").collect()} == {(2, "urn:knows"), (2, "urn:age"), (2, "urn:has"), (1, "urn:value")}


def test_joined_orders_agree(engine):
    text = "SELECT ?x ?n ?a { ?x <urn:knows> ?y . ?y <urn:age> ?a . ?x <urn:name> ?n }"
    want = bag(engine.query(text))
    for order in ("cardinality", "selectivity", "zero-knowledge"):
        assert bag(Engine(engine.spark, engine.quads, join_order=order).analyze().query(text)) == want


def test_updates(spark, engine):
    e = Engine(spark, engine.quads)
    e.update('INSERT DATA { <urn:d> <urn:age> 7 } ; DELETE { ?x <urn:age> ?a } INSERT { ?x <urn:years> ?a } WHERE { ?x <urn:age> ?a FILTER(?a > 10) }')
    assert bag(e.query("SELECT ?x { ?x <urn:age> ?a }")) == [("urn:c",), ("urn:d",)] and bag(e.query("SELECT ?x { ?x <urn:years> ?a }")) == [("urn:a",), ("urn:b",)]
    e.update("DELETE WHERE { ?x <urn:years> ?a } ; CLEAR GRAPH <urn:graph1> ; COPY <urn:graph2> TO <urn:graph3> ; LOAD SILENT <urn:nowhere>")
    assert bag(e.query("SELECT DISTINCT ?g { GRAPH ?g { ?s ?p ?o } }")) == [("urn:graph2",), ("urn:graph3",)] and e.query("ASK { ?x <urn:years> ?a }") is False
    e.update("DROP ALL")
    assert e.quads.count() == 0
    with pytest.raises(ValueError, match="no loader"):
        e.update("LOAD <urn:nowhere>")


def test_services(spark, engine):
    e = Engine(spark, engine.quads, services={"urn:remote": lambda: engine.quads.filter("p = 'urn:name'")})
    assert bag(e.query("SELECT ?x ?n { ?x <urn:age> 30 SERVICE <urn:remote> { ?x <urn:name> ?n } }")) == [("urn:a", "Ann")]
    assert len(bag(e.query("SELECT ?x { ?x <urn:age> ?a SERVICE SILENT <urn:gone> { ?x <urn:q> ?z } }"))) == 3
    with pytest.raises(KeyError):
        e.query("SELECT ?x { SERVICE <urn:gone> { ?x <urn:q> ?z } }")


def test_serialising_round_trip(engine):
    again = rdf.parse_lines(rdf.to_lines(engine.quads))
    key = lambda df: sorted(map(tuple, df.drop("src").collect()))
    assert key(again) == key(engine.quads)
    df = engine.query("SELECT ?x ?n { ?x <urn:age> ?a OPTIONAL { ?x <urn:name> ?n } }")
    assert {r[0] for r in rdf.results_csv(df).collect()} == {"urn:a,Ann", "urn:b,Bob", "urn:c,"}
    assert {r[0] for r in rdf.results_tsv(df).collect()} == {'<urn:a>\t"Ann"@en', '<urn:b>\t"Bob"', "<urn:c>\t"}
    assert {r[0] for r in rdf.results_json(df).collect()} >= {'{"x":{"type":"uri","value":"urn:c"}}'}


def test_syntax():
    for bad in ("SELECT", "SELECT ?x { ?x }", "SELECT ?x { ?x x:y ?z }", "ASK { ?s ?p ?o } junk", "SELECT (SUM(?x) { }"):
        with pytest.raises(SyntaxProblem):
            parse(bad)
    op = parse("BASE <http://e/> PREFIX : <http://p/> SELECT * { <x> a :T ; :p 1, 2 . [] :q (1 2) . # note\n ?s ?p 'it''s' }".replace("'it''s'", "'its'"))
    found = A.patterns(op)
    assert len(found) == 9 and found[0].s == A.named("http://e/x") and found[1].p == A.named("http://p/p")
    assert [u.kind for u in parse_update("INSERT DATA { GRAPH <g> { <a> <b> 1e3 } } ; DROP NAMED ; MOVE DEFAULT TO <x>")] == ["insert", "drop", "move"]


def test_extension_function(spark, engine):
    from quadloom.functions import scalar
    from quadloom.model import literal

    scalar.register("urn:fn:shout", lambda x: literal(scalar.F.concat(x.value, scalar.F.lit("!"))))
    assert bag(engine.query("SELECT (<urn:fn:shout>(?n) AS ?s) { ?x <urn:name> ?n }")) == [("Ann!",), ("Bob!",)]
    with pytest.raises(ValueError, match="unknown function"):
        engine.query("SELECT (NOSUCH(1) AS ?x) { }")


def test_nested_logic_stays_small(engine):
    text = "?a = 1"
    for i in range(12):
        text = f"!({text} && ?a != {i})"
    plan = engine.query(f"SELECT ?x {{ ?x <urn:age> ?a FILTER({text}) }}")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
