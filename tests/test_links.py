"""Link filters, traversal, cardinalities, requests and streams."""

import pytest
from pyspark.sql import functions as F

from quadloom.engine import Engine
from quadloom.model import QUADS
from quadloom.operators import cardinality, linkfilters, traversal
from quadloom.plans import algebra as A
from quadloom.plans import ordering
from quadloom.plans.parser import parse
from quadloom.sources import datasource, http, rdf
from quadloom.streaming import incremental

SUMMARY = "dataset string, projected_property string, projected_resource string, bits int, k int, positions array<bigint>"


def _filter(spark, values, bits=256, k=3):
    return linkfilters.build(spark.createDataFrame([("f", v) for v in values], "key string, v string"), "key", "v", bits, k).collect()[0].positions


def _pruned(spark, rows, patterns, mode="reference"):
    found = linkfilters.irrelevant_datasets(spark.createDataFrame(rows, SUMMARY), spark.createDataFrame(patterns, "qs string, qp string, qo string"), mode)
    return {r.dataset for r in found.collect()}


def test_bloom_truth_table(spark):
    at = _filter(spark, ["in", "p1"])
    prop, res = ("d", "p", None, 256, 3, at), ("d", None, "x", 256, 3, at)
    for pattern, keeps_property, keeps_resource in (
        ((None, None, None), True, True), ((None, None, "o"), True, False), ((None, "p", None), True, False), (("in", "p", None), True, False), (("out", "p", None), False, False), ((None, "p", "in"), True, False), (("out", "p", "in"), True, False),
        ((None, "q", None), False, False), (("x", "p1", None), False, True), (("x", None, "in"), True, True), (("x", None, None), True, False), (("x", "other", "out"), False, False), (("in", None, "x"), True, True), ((None, "p1", "x"), False, True), (("out", "q", "x"), False, False),
    ):
        assert ("d" not in _pruned(spark, [prop], [pattern])) == keeps_property, pattern
        assert ("d" not in _pruned(spark, [res], [pattern])) == keeps_resource, pattern


def test_bloom_incomplete_summaries(spark):
    at = _filter(spark, ["in"])
    rows = [("none", "p", None, None, None, None), ("bare", None, None, 256, 3, at), ("half", "p", None, 256, None, at), ("ok", "p", None, 256, 3, at), ("both", "p", "x", 256, 3, at)]
    assert _pruned(spark, rows, [(None, "p", "in")]) == {"none", "bare", "half"}
    assert _pruned(spark, rows, [(None, "p", "in")], "sound") == set() and _pruned(spark, rows, [(None, "p", "out")], "sound") == {"ok", "both"}


def test_void_rules_and_denials(spark, monkeypatch):
    rows = [("a", "sparqlEndpoint", "e"), ("a", "uriSpace", "http://a/"), ("a", "uriRegexPattern", "."), ("b", "sparqlEndpoint", "e"), ("b", "uriSpace", ""), ("b", "uriRegexPattern", r"\d$"), ("c", "uriSpace", "http"), ("d", "sparqlEndpoint", "e"), ("a", "uriSpace", "http://aa/")]
    quads = spark.createDataFrame([(s, linkfilters.VOID + p, o, i) for i, (s, p, o) in enumerate(rows)], "s string, p string, o string, seq int")
    rules = linkfilters.void_rules(quads)
    assert {(r.dataset, r.prefix, r.pattern) for r in rules.collect()} == {("a", "http://aa/", None), ("b", None, r"\d$")}
    links = spark.createDataFrame([("http://aa/1x",), ("http://a/x",), ("http://b/9",), (None,)], "url string")
    for few in (1000, 1):
        monkeypatch.setattr(linkfilters, "FEW_RULES", few)
        assert {r.url for r in linkfilters.deny(links, rules).collect()} == {"http://a/x", None}
    assert linkfilters.deny(links, rules.limit(0)).count() == 4


def test_traversal_is_breadth_first_and_ends_on_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("x", "y")], "src string, url string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in traversal.traverse(links, seeds).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.url for r in traversal.traverse(links, seeds, lambda df: df.filter("url <> 'c'")).collect()} == {"a", "b"}


def test_links_of_documents(spark):
    quads = spark.createDataFrame([("", 2, "doc", "urn:next", 2, "other", "", "", "doc"), ("", 2, "else", "urn:next", 2, "third", "", "", "doc"), ("", 2, "doc", "urn:next", 3, "text", "", "", "doc")], QUADS)
    assert {r.url for r in traversal.predicate_links(quads, ("urn:next",)).collect()} == {"other", "third"}
    assert {r.url for r in traversal.predicate_links(quads, ("urn:next",), True).collect()} == {"other"}
    assert {r.url for r in traversal.pattern_links(quads, [("else", None, None)]).collect()} == {"else", "urn:next", "third"}


def test_accumulation():
    made = lambda uri, n: cardinality.Statistics(uri, (n, 1.0, 1.0))
    op = A.Pattern(A.Var("s"), A.named("p"), A.Var("o"))
    assert cardinality.accumulate("initialize", {}, {"datasets": [made("a", 1.0)]}) == {} and cardinality.accumulate("append", {}, {}) == {}
    one = cardinality.accumulate("append", {}, {"datasets": [made("a", 1.0)]}, op)
    assert one["cardinality"] == cardinality.Estimate(1.0, "estimate", "a")
    two = cardinality.accumulate("append", one, {"datasets": [made("b", 2.0), made("a", 5.0)]}, op)
    assert [d.uri for d in two["datasets"]] == ["a", "b"] and two["cardinality"] == cardinality.Estimate(7.0, "estimate", None)
    assert "cardinality" not in cardinality.accumulate("append", {}, {"datasets": [made("a", 1.0)]}) and cardinality.estimate_operation(op, []) is None


def test_orders():
    found = A.patterns(parse("SELECT * { ?a <p> ?b . ?c <q> ?d . ?b <r> ?c . <urn:x> <s> ?a }"))
    assert ordering.by_cardinality(found, [3, 1, 2, 3]) == [1, 2, 0, 3]
    assert ordering.smallest_connected(found, [3, 1, 2, 3]) == [1, 2, 0, 3] and ordering.smallest_connected(found, [1, 1, 9, 9]) == [0, 2, 1, 3]
    assert ordering.zero_knowledge(found)[0] == 3


def test_delay():
    slept, served = [], []
    fetch = lambda url, context: served.append((url, context)) or "body"
    d = http.Delay(40, 0, sleep=slept.append)
    assert d.test({}) == 0 and d.run("u", {"k": 1}, fetch) == "body" and slept == [0.04] and served == [("u", {"k": 1, "delayed": True})]
    with pytest.raises(http.CannotServe):
        d.test({"delayed": True})
    with pytest.raises(http.CannotServe):
        http.Delay(0, 0).test({})
    assert (http.Delay(20, 50).minimum, http.Delay(20, 50).range) == (0, 100) and http.half_up(2.5) == 3
    with pytest.raises(KeyError):
        http.Delay(1, 0, sleep=slept.append).run("u", {}, lambda *_: {}["x"])


def test_rate_limit_and_retry():
    now, slept, tries = [0.0], [], []

    def fetch(url, context):
        now[0] += 2.0
        return url

    limit = http.RateLimit(clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for url in ("http://a/1", "http://a/2", "http://b/1"):
        limit.run(url, {}, fetch)
    assert slept == [] and limit.hosts.keys() == {"a", "b"}

    def flaky(url, context):
        tries.append(url)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert http.retry(flaky, 3)("u", {}) == "ok" and len(tries) == 3
    with pytest.raises(http.CannotServe):
        http.mediate({"a": http.Delay(0, 0).test}, {})


def test_data_source(spark, tmp_path):
    (tmp_path / "x.nq").write_text('<urn:a> <urn:p> "b\\n"@en <urn:g> .\n# no\n_:c <urn:p> <urn:d> .\n')
    spark.dataSource.register(datasource.QuadSource)
    df = spark.read.format("quadloom").option("urls", f"file://{tmp_path}/x.nq").load()
    plain = rdf.read(spark, f"{tmp_path}/x.nq")
    assert sorted(map(tuple, df.drop("src").collect())) == sorted(map(tuple, plain.drop("src").collect())) and df.schema.names == plain.schema.names
    assert Engine(spark, df).query("ASK { <urn:a> <urn:p> 'b\\n'@en }") is True


def test_stream_suppression(spark, tmp_path):
    for run, rows in enumerate([[("a", 1), ("a", 1), (None, 2)], [("a", 1), ("b", 3)], [("a", 1), ("a", 1), ("a", 1), (None, 2)]]):
        spark.createDataFrame([(x, y, run) for x, y in rows], "x string, y int, run int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x string, y int, run int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = incremental.replay_suppressed(stream, ["x", "y"]).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("kept").collect()), key=str) == sorted([("a", 1)] * 3 + [(None, 2), ("b", 3)], key=str)


def test_stream_suppression_takes_few_calls_and_keeps_values(spark, tmp_path):
    import datetime as dt
    from collections import Counter

    at = dt.datetime(2020, 1, 1, 0, 0, 0, 1)
    odd = [(None, at, 2.5), ((1 << 53) + 1, at, float("nan")), ((1 << 53) + 1, at + dt.timedelta(microseconds=1), None), (None, None, None)]
    many = [(i, at, 0.5) for i in range(20000)]
    for run, rows in enumerate([odd + many, odd[1:] + many + many[:5000] + odd[:1] * 2500]):
        spark.createDataFrame([(*r, run) for r in rows], "x long, `t.s` timestamp, z double, run int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x long, `t.s` timestamp, z double, run int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept = incremental.replay_suppressed(stream, ["x", "t.s", "z"])
    q = kept.writeStream.format("memory").queryName("kept_values").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert kept.dtypes == stream.dtypes[:3]
    # The states are pages of rows, not one for each of 20004 rows, each of which was a call.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= incremental.PAGES
    assert Counter(map(str, map(tuple, spark.table("kept_values").collect()))) == Counter(map(str, odd + many + many[:5000] + odd[:1] * 2499))


def test_command_line(spark, tmp_path, capsys):
    from quadloom import cli

    (tmp_path / "x.nt").write_text('<urn:a> <urn:p> "b" .\n')
    for style, want in (("csv", "x\nurn:a\n"), ("tsv", "?x\n<urn:a>\n"), ("json", '{"x":{"type":"uri","value":"urn:a"}}\n')):
        assert cli.main(["--data", f"{tmp_path}/x.nt", "--format", style, "SELECT ?x { ?x <urn:p> 'b' }"]) == 0
        assert capsys.readouterr().out == want
    cli.main(["--data", f"{tmp_path}/x.nt", "ASK { ?x ?p 'c' }"])
    cli.main(["--data", f"{tmp_path}/x.nt", "CONSTRUCT { ?x <urn:q> 'c' } { ?x <urn:p> 'b' }"])
    assert capsys.readouterr().out == 'false\n<urn:a> <urn:q> "c" .\n'


def test_plans_read_only_what_they_need(spark):
    from quadloom.sources.tables import table_quads

    quads = table_quads(spark, "/root/testdata/sf0.001", "customer", "orders", "nation")
    plan = Engine(spark, quads).query("SELECT ?n { ?c <urn:p:c_nationkey> <urn:nation:3> ; <urn:p:c_name> ?n }")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and "o_orderkey" not in plan and "Union" not in plan and "BatchEvalPython" not in plan
    assert F.col("x") is not None


def test_bitmaps(spark):
    df = spark.createDataFrame([([0, 3, 9, 255],), ([7],), ([],)], "p array<bigint>").select("p", linkfilters.bitmap(F.col("p"), 256).alias("b"))
    assert all(sorted(r.back) == sorted(r.p) for r in df.select("p", linkfilters.bitmap_positions(F.col("b")).alias("back")).collect())
    assert spark.range(1).select(linkfilters.bitmap_positions(F.lit("!!")).alias("x")).collect()[0].x is None


def test_documents_of_all_syntaxes(spark):
    from quadloom.sources.documents import parse_documents

    docs = [
        ("http://e/ttl", "@prefix : <http://p/> . @base <http://b/> .\n<x> a :T ; :p 1, 'two'@en, (1.5 true) ; :q [ :r <y> ] .\n_:z :p _:z .", "text/turtle; charset=utf-8"),
        ("http://e/trig", "PREFIX : <http://p/>\n{ :a :b :c } :g { :a :b 1e0 . } GRAPH <h> { :a :b '''x''' }", "application/trig"),
        ("http://e/xml", """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:p="http://p/"><p:T rdf:about="x" p:name="n"><p:k rdf:resource="http://o"/><p:v xml:lang="EN">t</p:v><p:w rdf:datatype="http://d">3</p:w><p:in><rdf:Description/></p:in></p:T></rdf:RDF>""", "application/rdf+xml"),
        ("http://e/json", '{"@context": {"@vocab": "http://p/", "k": {"@type": "@id"}, "s": "http://s/"}, "@id": "x", "@type": "T", "k": "y", "n": [1, 2.5, true, null], "s:l": {"@value": "t", "@language": "EN"}, "in": {"v": "w"}, "li": {"@list": ["a"]}}', "application/ld+json"),
        ("http://e/html", '<html><script type="application/ld+json">{"@id": "http://a", "http://p/b": "c"}</script></html>', "text/html"),
        ("http://e/nt", "<urn:a> <urn:b> <urn:c> .\nbroken", "application/n-triples"),
        ("http://e/bad", "this is not turtle", "text/turtle"), ("http://e/png", "x", "image/png"), (None, None, None),
    ]
    got = {}
    for r in parse_documents(spark.createDataFrame(docs, "url string, content string, media_type string")).collect():
        got.setdefault(r.src, set()).add((r.g, r.s if r.s_kind == 2 else "_", r.p.rsplit("/", 1)[-1].rsplit("#", 1)[-1], r.o if r.o_kind != 1 else "_", r.o_lang))
    assert got["http://e/ttl"] == {("", "http://b/x", "type", "http://p/T", ""), ("", "http://b/x", "p", "1", ""), ("", "http://b/x", "p", "two", "en"), ("", "http://b/x", "p", "_", ""), ("", "_", "first", "1.5", ""), ("", "_", "rest", "_", ""), ("", "_", "first", "true", ""), ("", "_", "rest", "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil", ""), ("", "http://b/x", "q", "_", ""), ("", "_", "r", "http://b/y", ""), ("", "_", "p", "_", "")}
    assert got["http://e/trig"] == {("", "http://p/a", "b", "http://p/c", ""), ("http://p/g", "http://p/a", "b", "1e0", ""), ("http://e/h", "http://p/a", "b", "x", "")}
    assert got["http://e/xml"] == {("", "http://e/x", "type", "http://p/T", ""), ("", "http://e/x", "name", "n", ""), ("", "http://e/x", "k", "http://o", ""), ("", "http://e/x", "v", "t", "en"), ("", "http://e/x", "w", "3", ""), ("", "http://e/x", "in", "_", "")}
    assert got["http://e/json"] == {("", "http://e/x", "type", "http://p/T", ""), ("", "http://e/x", "k", "http://e/y", ""), ("", "http://e/x", "n", "1", ""), ("", "http://e/x", "n", "2.5", ""), ("", "http://e/x", "n", "true", ""), ("", "http://e/x", "l", "t", "en"), ("", "http://e/x", "in", "_", ""), ("", "_", "v", "w", ""), ("", "http://e/x", "li", "_", ""), ("", "_", "first", "a", ""), ("", "_", "rest", "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil", "")}
    assert got["http://e/html"] == {("", "http://a", "b", "c", "")} and len(got["http://e/nt"]) == 1 and len(got) == 6


def test_link_traversal_with_filters(spark):
    from quadloom.operators.hypermedia import LinkTraversal

    see, void, mem = traversal.COMMON[0], linkfilters.VOID, linkfilters.MEM
    # Published summaries hash by FNV-1a.
    at = linkfilters.build(spark.createDataFrame([("k", "urn:bob")], "key string, v string"), "key", "v", 64, 3, "fnv").collect()[0].positions
    packed = spark.createDataFrame([(at,)], "p array<bigint>").select(linkfilters.bitmap(F.col("p"), 64).alias("b")).collect()[0].b
    lines = f"""http://a/1 <http://a/1> <{see}> <http://a/2> .
http://a/1 <http://a/1> <{see}> <http://b/1> .
http://a/1 <http://a/1> <{see}> <http://c/1> .
http://a/1 <urn:ann> <urn:knows> <urn:bob> .
http://a/1 <urn:vd> <{void}sparqlEndpoint> <http://b/sparql> .
http://a/1 <urn:vd> <{void}uriSpace> "http://b/" .
http://a/1 <urn:mc> <{mem}sourceCollection> <http://c/> .
http://a/1 <urn:mc> <{mem}projectedProperty> <urn:knows> .
http://a/1 <urn:mf> <{mem}memberCollection> <urn:mc> .
http://a/1 <urn:mf> <{mem}hashFunction> <urn:mh> .
http://a/1 <urn:mf> <{mem}bitSize> "64" .
http://a/1 <urn:mf> <{mem}binaryRepresentation> "{packed}" .
http://a/1 <urn:mh> <{mem}hashSize> "3" .
http://a/2 <urn:eve> <urn:knows> <urn:bob> .
http://b/1 <urn:ben> <urn:knows> <urn:bob> .
http://c/1 <urn:cat> <urn:knows> <urn:bob> .
http://c/1 <urn:cat> <urn:knows> <urn:dan> .
http://z/9 <urn:zed> <urn:knows> <urn:bob> ."""
    quads = rdf.parse_lines(spark.createDataFrame([tuple(x.split(" ", 1)) for x in lines.split("\n")], "src string, value string")).drop("src")
    quads = spark.createDataFrame([(*q, x.split(" ", 1)[0]) for q, x in zip((tuple(r) for r in quads.collect()), lines.split("\n"), strict=True)], QUADS)

    def names(text, **options):
        return {r.x.value[4:] for r in LinkTraversal(quads, **options).query(text, ["http://a/1"]).collect()}

    bob, dan = "SELECT ?x { ?x <urn:knows> <urn:bob> }", "SELECT ?x { ?x <urn:knows> <urn:dan> }"
    assert names(bob) == {"ann", "eve", "cat"} and names(bob, use_void=False) == {"ann", "eve", "cat", "ben"} and names(bob, most_rounds=0) == {"ann"}
    assert names(dan) == set() and names(dan, use_bloom=False) == {"cat"}


def test_http_service(spark):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    from quadloom.service import server

    engine = Engine(spark, rdf.parse_lines(spark.createDataFrame([('<urn:a> <urn:p> "b"@en .',), ("<urn:a> <urn:p> <urn:c> .",)], "value string")))
    with server(engine, 0, updates=True) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{running.server_port}/sparql"
        get = lambda query, accept="": urlopen(Request(f"{url}?{urlencode({'query': query})}", headers={"Accept": accept})).read().decode()
        found = json.loads(get("SELECT ?o { <urn:a> <urn:p> ?o FILTER ISLITERAL(?o) }"))
        assert found == {"head": {"vars": ["o"]}, "results": {"bindings": [{"o": {"type": "literal", "value": "b", "xml:lang": "en"}}]}}
        assert json.loads(get("ASK { <urn:a> ?p ?o }"))["boolean"] is True and get("SELECT ?o { ?s ?p ?o FILTER ISIRI(?o) }", "text/csv") == "o\nurn:c\n"
        assert get("CONSTRUCT { ?o <urn:q> ?s } { ?s ?p ?o FILTER ISIRI(?o) }") == "<urn:c> <urn:q> <urn:a> .\n"
        urlopen(Request(url, data=b"INSERT DATA { <urn:x> <urn:p> 1 }", headers={"Content-Type": "application/sparql-update"})).read()
        assert get("SELECT ?s { ?s <urn:p> 1 }", "text/tab-separated-values") == "?s\n<urn:x>\n"
        with pytest.raises(HTTPError, match="400"):
            get("SELECT nonsense")
        running.shutdown()


def test_fnv1a_known_values(spark):
    row = spark.range(1).select(*[linkfilters.fnv1a(F.lit(x)).alias(f"x{i}") for i, x in enumerate(["", "a", "foobar"])], linkfilters.fnv1a(F.lit("oobar"), b"f").alias("seeded")).first()
    assert tuple(row) == (0x811C9DC5, 0xE40C292C, 0xBF9CF968, 0xBF9CF968)
    text = "caf\u00e9 \u4e2d"
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 % (1 << 32)
    assert spark.range(1).select(linkfilters.fnv1a(F.lit(text))).first()[0] == h


def test_bitmaps_are_asked_by_bytes(spark):
    values_ = [f"urn:{i}" for i in range(30)]
    rows = spark.createDataFrame([("k", v) for v in values_], "key string, v string")
    made = linkfilters.build(rows, "key", "v", 300, 4, "fnv").select("bits", "k", F.unbase64(linkfilters.bitmap(F.col("positions"), 300)).alias("raw"), "positions")
    probes = spark.createDataFrame([(f"urn:{i}",) for i in range(300)], "v string")
    both = probes.crossJoin(made.withColumnRenamed("k", "n")).select("v", linkfilters.holds(F.col("raw"), F.col("v"), F.col("bits"), F.col("n"), "fnv").alias("a"), linkfilters.contains(F.col("positions"), F.col("v"), F.col("bits"), F.col("n"), "fnv").alias("b"), linkfilters.holds(F.lit(b"").cast("binary"), F.col("v"), F.col("bits"), F.col("n"), "fnv").alias("none")).collect()
    assert all(r.a == r.b and not r.none for r in both) and all(r.a for r in both if r.v in values_) and sum(r.a for r in both) < 90


def test_filters_need_a_list(spark):
    from quadloom.operators.hypermedia import LinkTraversal

    quads = spark.createDataFrame([("", 2, "urn:a", "urn:p", 2, "urn:b", "", "", "urn:a")], QUADS)
    text = "SELECT ?o { <urn:a> <urn:p> ?o }"
    with pytest.raises(linkfilters.NoFilterList, match="without filter output array"):
        LinkTraversal(quads, link_filters=None).query(text, ["urn:a"])
    assert LinkTraversal(quads, link_filters=None, use_void=False, use_bloom=False).query(text, ["urn:a"]).count() == 1
    noted: list = []
    quads = quads.unionByName(spark.createDataFrame([("", 2, "urn:d", linkfilters.VOID + "sparqlEndpoint", 2, "urn:e", "", "", "urn:a")], QUADS))
    LinkTraversal(quads, link_filters=noted).query(text, ["urn:a"]).count()
    assert [kind for kind, _ in noted] == ["void", "bloom"]


def test_other_serialisations(spark):
    import json
    import xml.etree.ElementTree as ET

    from quadloom.sources.documents import parse_documents

    rows = [("", 2, "urn:a", "urn:p", 3, 'x "q" <&>\n\u00e9', "http://www.w3.org/2001/XMLSchema#string", "", ""), ("urn:g", 2, "urn:a", "urn:q", 3, "5", "http://www.w3.org/2001/XMLSchema#integer", "", ""), ("urn:g", 1, "b", "urn:r", 3, "hi", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", "en", ""), ("", 2, "urn:a", "urn:s", 1, "b", "", "", "")]
    quads = spark.createDataFrame(rows, QUADS)
    join = lambda df: "\n".join(r.value for r in df.collect())
    texts = {"text/turtle": join(rdf.to_turtle(quads)), "application/trig": join(rdf.to_trig(quads)), "application/ld+json": "[" + ",".join(r.value for r in rdf.to_jsonld(quads).collect()) + "]"}
    assert len(json.loads(texts["application/ld+json"])) == 4
    docs = spark.createDataFrame([(f"http://e/{i}", text, kind) for i, (kind, text) in enumerate(texts.items())], "url string, content string, media_type string")
    for i, kind in enumerate(texts):
        got = parse_documents(docs.filter(f"url = 'http://e/{i}'")).collect()
        graph = lambda g: g if kind == "application/trig" else ""
        assert sorted((r.g, r.s_kind, r.s if r.s_kind == 2 else "", r.p, r.o_kind, r.o if r.o_kind != 1 else "", r.o_dt, r.o_lang) for r in got) == sorted((graph(g), sk, s if sk == 2 else "", p, ok, o if ok != 1 else "", dt, lang) for g, sk, s, p, ok, o, dt, lang, _ in rows), kind
    found = Engine(spark, quads).query("SELECT ?o ?none { <urn:a> ?p ?o }")
    before, behind = rdf.xml_frame(found.columns)
    tree = ET.fromstring(before + join(rdf.results_xml(found)) + behind)
    ns = "{http://www.w3.org/2005/sparql-results#}"
    assert [v.get("name") for v in tree.iter(f"{ns}variable")] == ["o", "none"] and len(list(tree.iter(f"{ns}result"))) == 3
    assert {(x.text, x.get("datatype")) for x in tree.iter(f"{ns}literal")} == {('x "q" <&>\n\u00e9', None), ("5", "http://www.w3.org/2001/XMLSchema#integer")} and len(list(tree.iter(f"{ns}bnode"))) == 1


def test_operations_as_text():
    from quadloom.plans import algebra as A
    from quadloom.plans.parser import parse
    from quadloom.sources.endpoint import NotWritable, bound, write

    text = """SELECT * { ?a <urn:p>/^<urn:q>* ?b . ?b <urn:r> "x\\"y"@en OPTIONAL { ?a <urn:s> ?c FILTER(?c > 3 || !BOUND(?b)) } FILTER(?a IN (<urn:1>, 2)) FILTER NOT EXISTS { ?a <urn:z> ?zz }
      { ?d <urn:u> 1 } UNION { ?e <urn:v> 2.5 } MINUS { ?a <urn:w> ?d } BIND(STRLEN(STR(?a)) + 1 AS ?n) VALUES (?k ?l) { (1 UNDEF) (UNDEF "z") } GRAPH ?g { ?a ?p ?o } }"""
    op = parse(text)
    inner = op.child if isinstance(op, A.Project) else op
    again = parse("SELECT * { " + write(inner) + " }")
    assert write(again.child if isinstance(again, A.Project) else again).count("OPTIONAL") == 1
    names = bound(inner)
    assert names["a"] is False and names["c"] is True and names["d"] is True and names["k"] is True and names["g"] is False
    with pytest.raises(NotWritable):
        write(A.Distinct(inner))


def test_bind_join_sends_bindings_in_blocks(spark, tmp_path):
    import json as js

    from quadloom.sources import endpoint

    log = str(tmp_path)

    def fetch(url, query):
        import os
        import re
        import uuid

        with open(os.path.join(log, uuid.uuid4().hex), "w") as file:
            file.write(query)
        found = re.findall(r"<urn:n:(\d+)>", query)
        return js.dumps({"results": {"bindings": [{"n": {"type": "uri", "value": f"urn:n:{k}"}, "name": {"type": "literal", "value": f"name {k}"}} for k in found]}})

    quads = spark.createDataFrame([("", 2, f"urn:c:{i}", "urn:in", 2, f"urn:n:{i % 120}", "", "", "") for i in range(400)], QUADS)
    engine = Engine(spark, quads, services={"urn:e": endpoint.Endpoint("http://nowhere", fetch)})
    rows = engine.query("SELECT ?c ?name { ?c <urn:in> ?n SERVICE <urn:e> { ?n <urn:name> ?name } }").collect()
    assert len(rows) == 400 and {r.name.value for r in rows} == {f"name {k}" for k in range(120)}
    sent = [open(f"{log}/{f}").read() for f in __import__("os").listdir(log)]
    assert len(sent) == 3 and all("VALUES (?n)" in q and q.count("urn:n:") <= endpoint.BLOCK for q in sent)


def _no_nested_loop(df) -> bool:
    return "NestedLoop" not in df._jdf.queryExecution().toString() and "CartesianProduct" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("rest", ["OPTIONAL { ?x <urn:w> ?z . ?z <urn:q> ?y }", "MINUS { ?x <urn:w> ?z . ?z <urn:q> ?y }", "FILTER EXISTS { ?x <urn:w> ?z . ?z <urn:q> ?y }", "FILTER NOT EXISTS { ?x <urn:w> ?z . ?z <urn:q> ?y }"])
def test_loose_variables_need_no_nested_loop(spark, rest):
    """One to three variables that the left may leave unbound, beside one that it binds."""
    quads = spark.createDataFrame([("", 2, f"urn:{i % 7}", f"urn:{'pqvw'[i % 4]}", 2, f"urn:{i % 5}", "", "", "") for i in range(60)], QUADS)
    loose = ["OPTIONAL { ?x <urn:p> ?z }", "OPTIONAL { ?x <urn:p> ?z } OPTIONAL { ?x <urn:q> ?y }"]
    for before in loose:
        assert _no_nested_loop(Engine(spark, quads).query(f"SELECT * {{ ?x <urn:v> ?v {before} {rest} }}")), before


def test_stars_are_one_scan(spark):
    from quadloom.sources.tables import Tables

    plan = Engine(spark, Tables(spark, "/root/testdata/sf0.001", "customer", "nation")).query("PREFIX p: <urn:p:> SELECT ?name ?bal ?n { ?c p:c_name ?name ; p:c_acctbal ?bal ; p:c_nationkey ?n ; p:c_mktsegment 'BUILDING' }")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text and "= BUILDING)" in text
