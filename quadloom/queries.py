"""Registered queries, one or more per operator, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.engine import Engine, values
from quadloom.model import IRI, LITERAL, MEM, QUADS, VOID
from quadloom.operators import adaptive, cardinality, linkfilters, traversal
from quadloom.operators.adaptive import RestartConfig
from quadloom.plans import algebra as A
from quadloom.plans import ordering
from quadloom.plans.parser import parse
from quadloom.sources import http, rdf
from quadloom.sources.tables import Tables, table_quads
from quadloom.storage import fresh_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
P = "PREFIX p: <urn:p:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
L, D = "bigint", "double"


def _put(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _put(name, f, sql)
        return f

    return keep


def sparql(name: str, tables: str, text: str, sql: str, **types: str) -> None:
    """A query text over the quads of some tables; types cast result columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return values(Engine(spark, Tables(spark, sf_dir, *tables.split())).query(P + text), **types)

    _put(name, run, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Graph patterns and joins
sparql("bgp_star_customer", "customer nation", "SELECT ?name ?bal ?nation { ?c p:c_name ?name ; p:c_acctbal ?bal ; p:c_nationkey ?n . ?n p:n_name ?nation }",
       "SELECT c_name AS name, c_acctbal AS bal, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey", bal=D)
sparql("bgp_chain_lineitem_region", "lineitem orders customer nation region", """SELECT ?region (COUNT(?l) AS ?n) { ?l p:l_orderkey ?o . ?o p:o_custkey ?c . ?c p:c_nationkey ?k . ?k p:n_regionkey ?r . ?r p:r_name ?region } GROUP BY ?region""",
       "SELECT r_name AS region, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", n=L)
sparql("bgp_var_predicate", "nation supplier", "SELECT ?pred (COUNT(*) AS ?n) { ?s ?pred ?o } GROUP BY ?pred",
       "SELECT 'urn:p:n_name' AS pred, count(*) AS n FROM nation UNION ALL SELECT 'urn:p:n_regionkey', count(*) FROM nation UNION ALL SELECT 'urn:p:s_name', count(*) FROM supplier UNION ALL SELECT 'urn:p:s_nationkey', count(*) FROM supplier UNION ALL SELECT 'urn:p:s_acctbal', count(*) FROM supplier", n=L)


@query("bgp_repeated_var", "SELECT 'urn:k:' || n_nationkey AS x FROM nation WHERE n_nationkey = n_regionkey")
def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "nation").selectExpr("'' g", "2Y s_kind", "'urn:k:' || n_nationkey s", "'urn:link' p", "2Y o_kind", "'urn:k:' || n_regionkey o", "'' o_dt", "'' o_lang", "'' src")
    return values(Engine(spark, links).query("SELECT ?x { ?x <urn:link> ?x }"))


sparql("join_cross_theta", "part", "SELECT ?a ?b { ?a p:p_size 7 ; p:p_retailprice ?x . ?b p:p_size 9 ; p:p_retailprice ?y . FILTER(?x < ?y && ?y < ?x + 50) }",
       "SELECT 'urn:part:' || a.p_partkey AS a, 'urn:part:' || b.p_partkey AS b FROM part a JOIN part b ON a.p_size = 7 AND b.p_size = 9 AND a.p_retailprice < b.p_retailprice AND b.p_retailprice < a.p_retailprice + 50")


@query("join_semijoin_reduced", "SELECT 'urn:orders:' || o_orderkey AS o, 'urn:customer:' || o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 8000")
def _reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.operators.joins import join, reduce_by_keys
    from quadloom.plans.planner import Planner

    planner = Planner(Engine(spark, table_quads(spark, sf_dir, "orders", "customer")).context())
    small = planner.run(parse(P + "SELECT ?c { ?c p:c_mktsegment 'BUILDING' ; p:c_acctbal ?b FILTER(?b > 8000) }"))
    large = planner.run(parse(P + "SELECT ?o ?c { ?o p:o_custkey ?c }"))
    return values(join(reduce_by_keys(small, large), small).df).select("o", "c")


sparql("join_undef_compat", "nation region", """SELECT ?n ?r ?tag { ?n p:n_regionkey ?r . VALUES (?r ?n ?tag) { (<urn:region:1> UNDEF "one") (UNDEF <urn:nation:3> "three") (UNDEF UNDEF "all") (<urn:region:2> <urn:nation:2> "both") } }""",
       """SELECT 'urn:nation:' || n_nationkey AS n, 'urn:region:' || n_regionkey AS r, tag FROM nation JOIN (VALUES (1, NULL, 'one'), (NULL, 3, 'three'), (NULL, NULL, 'all'), (2, 2, 'both')) v(r, n, tag) ON (v.r IS NULL OR v.r = n_regionkey) AND (v.n IS NULL OR v.n = n_nationkey)""")  # fmt: skip
sparql("join_undef_chain", "customer nation", """SELECT ?c ?n ?name { { ?c p:c_mktsegment "BUILDING" OPTIONAL { ?c p:c_nationkey ?n . ?c p:c_acctbal ?b FILTER(?b > 5000) } } ?n p:n_name ?name }""",
       "SELECT 'urn:customer:' || c_custkey AS c, 'urn:nation:' || n_nationkey AS n, n_name AS name FROM customer JOIN nation ON c_acctbal <= 5000 OR c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
sparql("optional_filter", "customer orders", "SELECT ?c ?o { ?c p:c_mktsegment 'MACHINERY' OPTIONAL { ?o p:o_custkey ?c ; p:o_totalprice ?t FILTER(?t > 300000) } }",
       "SELECT 'urn:customer:' || c_custkey AS c, 'urn:orders:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE c_mktsegment = 'MACHINERY'")
sparql("optional_outer_variable", "customer orders", "SELECT ?c ?o { ?c p:c_acctbal ?b ; p:c_mktsegment 'BUILDING' OPTIONAL { ?o p:o_custkey ?c ; p:o_totalprice ?t FILTER(?t > 50 * ?b) } }",
       "SELECT 'urn:customer:' || c_custkey AS c, 'urn:orders:' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 50 * c_acctbal WHERE c_mktsegment = 'BUILDING'")
sparql("minus_compat", "customer orders", "SELECT ?c { ?c p:c_name ?n MINUS { ?o p:o_custkey ?c ; p:o_orderstatus 'F' } }",
       "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sparql("minus_nothing_shared", "nation region", "SELECT ?n { ?n p:n_name ?x MINUS { ?r p:r_name ?y } }", "SELECT 'urn:nation:' || n_nationkey AS n FROM nation")
sparql("exists", "customer orders", "SELECT ?c { ?c p:c_name ?n FILTER EXISTS { ?o p:o_custkey ?c ; p:o_totalprice ?t FILTER(?t > 450000) } }",
       "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
sparql("not_exists", "customer orders", "SELECT ?c { ?c p:c_acctbal ?b FILTER(?b < 1000) FILTER NOT EXISTS { ?o p:o_custkey ?c ; p:o_totalprice ?t FILTER(?t > 2000 * ?b) } }",
       "SELECT 'urn:customer:' || c_custkey AS c FROM customer WHERE c_acctbal < 1000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 2000 * c_acctbal)")
sparql("union_padded", "nation region", "SELECT ?x ?n ?r { { ?x p:n_name ?n } UNION { ?x p:r_name ?r } }",
       "SELECT 'urn:nation:' || n_nationkey AS x, n_name AS n, NULL AS r FROM nation UNION ALL SELECT 'urn:region:' || r_regionkey, NULL, r_name FROM region")
sparql("values_inline", "nation", "SELECT ?n ?w { VALUES (?n ?w) { ('NATION_1' 10) ('NATION_2' 20) ('nowhere' 30) } ?x p:n_name ?n }",
       "SELECT n_name AS n, w FROM nation JOIN (VALUES ('NATION_1', CAST(10 AS BIGINT)), ('NATION_2', 20), ('nowhere', 30)) v(n, w) ON n_name = n", w=L)
sparql("bind_expr", "part", "SELECT ?x ?twice { ?x p:p_size ?s BIND(?s * 2 + 1 AS ?twice) FILTER(?twice > 80) }",
       "SELECT 'urn:part:' || p_partkey AS x, CAST(p_size * 2 + 1 AS BIGINT) AS twice FROM part WHERE p_size * 2 + 1 > 80", twice=L)
sparql("graph_scope", "nation region", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g",
       "SELECT 'urn:g:nation' AS g, 2 * count(*) AS n FROM nation UNION ALL SELECT 'urn:g:region', count(*) FROM region", n=L)
sparql("graph_constant", "nation region", "SELECT ?s ?o { GRAPH <urn:g:region> { ?s ?p ?o } }", "SELECT 'urn:region:' || r_regionkey AS s, r_name AS o FROM region")
sparql("graph_from", "nation region", "SELECT ?s FROM <urn:g:region> { ?s ?p ?o }", "SELECT 'urn:region:' || r_regionkey AS s FROM region")
sparql("subselect_topn", "customer orders", "SELECT ?name ?t { { SELECT ?c (SUM(?p) AS ?t) { ?o p:o_custkey ?c ; p:o_totalprice ?p } GROUP BY ?c ORDER BY DESC(?t) LIMIT 7 } ?c p:c_name ?name }",
       "SELECT c_name AS name, t FROM (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 7) JOIN customer ON o_custkey = c_custkey", t="decimal(20,2)")
ORACLE["subselect_topn"] = ORACLE["subselect_topn"].replace("AS name, t", "AS name, CAST(t AS DECIMAL(20,2)) AS t")


@query("service_federated", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def _service(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, table_quads(spark, sf_dir, "nation"), services={"urn:endpoint": lambda: table_quads(spark, sf_dir, "region")})
    return values(engine.query(P + "SELECT ?n ?r { ?x p:n_name ?n ; p:n_regionkey ?k SERVICE <urn:endpoint> { ?k p:r_name ?r } SERVICE SILENT <urn:none> { ?k p:none ?z } }"))


# Property paths
sparql("path_sequence", "customer nation region", "SELECT ?c ?r { ?c p:c_nationkey/p:n_regionkey/p:r_name ?r }",
       "SELECT 'urn:customer:' || c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
sparql("path_inverse_alt", "nation customer supplier", "SELECT ?n ?x { ?n ^(p:c_nationkey|p:s_nationkey) ?x }",
       "SELECT 'urn:nation:' || c_nationkey AS n, 'urn:customer:' || c_custkey AS x FROM customer UNION ALL SELECT 'urn:nation:' || s_nationkey, 'urn:supplier:' || s_suppkey FROM supplier")
sparql("path_negated", "nation", "SELECT ?n ?o { ?n !(p:n_name) ?o }", "SELECT 'urn:nation:' || n_nationkey AS n, 'urn:region:' || n_regionkey AS o FROM nation")
sparql("path_optional", "nation", "SELECT ?y { <urn:nation:4> p:n_regionkey? ?y }", "SELECT 'urn:nation:4' AS y UNION SELECT 'urn:region:' || n_regionkey FROM nation WHERE n_nationkey = 4")
EDGES = "edges AS (SELECT n_nationkey AS a, (7 * n_nationkey + 3) % 25 AS b FROM nation)"


def _cycle(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, table(spark, sf_dir, "nation").selectExpr("'' g", "2Y s_kind", "'urn:k:' || n_nationkey s", "'urn:next' p", "2Y o_kind", "'urn:k:' || ((7 * n_nationkey + 3) % 25) o", "'' o_dt", "'' o_lang", "'' src"))


@query("path_plus_cyclic", f"WITH RECURSIVE {EDGES}, r AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a) SELECT 'urn:k:' || a AS x, 'urn:k:' || b AS y FROM r")
def _plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(_cycle(spark, sf_dir).query("SELECT ?x ?y { ?x <urn:next>+ ?y }"))


@query("path_star", f"WITH RECURSIVE {EDGES}, r AS (SELECT 2 AS b UNION SELECT e.b FROM r JOIN edges e ON r.b = e.a) SELECT 'urn:k:' || b AS y FROM r")
def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(_cycle(spark, sf_dir).query("SELECT ?y { <urn:k:2> <urn:next>* ?y }"))


# Modifiers and forms
sparql("distinct_vars", "customer", "SELECT DISTINCT ?s ?n { ?c p:c_mktsegment ?s ; p:c_nationkey ?n }", "SELECT DISTINCT c_mktsegment AS s, 'urn:nation:' || c_nationkey AS n FROM customer")
sparql("reduced_vars", "nation", "SELECT REDUCED ?r { ?n p:n_regionkey ?r }", "SELECT 'urn:region:' || n_regionkey AS r FROM nation")
sparql("order_terms_slice", "customer", "SELECT ?n ?b { ?c p:c_name ?n ; p:c_acctbal ?b } ORDER BY DESC(?b) ?n LIMIT 11 OFFSET 5",
       "SELECT c_name AS n, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 11 OFFSET 5", b=D)


@query("order_unbound_bnode_iri_literal", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), NULL), (2, 'b'), (3, 'urn:x'), (4, '2'), (5, '10')) t(rn, x)")
def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = 'SELECT ?x { VALUES ?v { 1 2 3 4 5 } BIND(IF(?v = 1, 10, IF(?v = 2, BNODE("a"), IF(?v = 3, <urn:x>, IF(?v = 4, 2, ?nothing)))) AS ?x) }'
    df = Engine(spark, spark.createDataFrame([], QUADS)).query(made)
    from quadloom.functions.scalar import order_key

    numbered = df.select("x", F.row_number().over(Window.orderBy(order_key(F.col("x")))).cast("bigint").alias("rn"))
    return numbered.select("rn", F.when(F.col("x.kind") == 1, "b").otherwise(F.col("x.value")).alias("x"))


@query("ask_nonempty", "SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000) AS rich, EXISTS (SELECT 1 FROM nation WHERE n_name = 'Atlantis') AS none")
def _ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, table_quads(spark, sf_dir, "customer", "nation"))
    return spark.createDataFrame([(engine.query(P + "ASK { ?c p:c_acctbal ?b FILTER(?b > 9000) }"), engine.query(P + "ASK { ?n p:n_name 'Atlantis' }"))], "rich boolean, none boolean")


@query("construct_template", "SELECT DISTINCT 'urn:region:' || n_regionkey AS s, 'urn:holds' AS p, n_name AS o FROM nation UNION ALL SELECT DISTINCT 'urn:nation:' || n_nationkey, 'urn:in', 'urn:region:' || n_regionkey FROM nation")
def _construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = P + "CONSTRUCT { ?r <urn:holds> ?n . ?x <urn:in> ?r . ?n <urn:bad> ?x . ?x <urn:none> ?missing } { ?x p:n_name ?n ; p:n_regionkey ?r }"
    return Engine(spark, table_quads(spark, sf_dir, "nation")).query(text).select("s", "p", "o")


@query("describe_cbd", "SELECT 'urn:p:n_name' AS p, n_name AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'urn:p:n_regionkey', 'urn:region:' || n_regionkey FROM nation WHERE n_nationkey = 3")
def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, table_quads(spark, sf_dir, "nation", "region")).query("DESCRIBE <urn:nation:3>").select("p", "o")


# Aggregates
sparql("group_having", "orders", "SELECT ?s ?r (COUNT(*) AS ?n) { ?o p:o_orderstatus ?s ; p:o_orderpriority ?r } GROUP BY ?s ?r HAVING (COUNT(*) > 100)",
       "SELECT o_orderstatus AS s, o_orderpriority AS r, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 100", n=L)
sparql("agg_all", "orders", "SELECT ?s (COUNT(?t) AS ?n) (SUM(?t) AS ?total) (AVG(?t) AS ?mean) (MIN(?t) AS ?low) (MAX(?t) AS ?high) { ?o p:o_orderstatus ?s ; p:o_totalprice ?t } GROUP BY ?s",
       "SELECT o_orderstatus AS s, count(*) AS n, CAST(sum(o_totalprice) AS DECIMAL(20,2)) AS total, CAST(avg(o_totalprice) AS DECIMAL(20,2)) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1", n=L, total="decimal(20,2)", mean="decimal(20,2)", low=D, high=D)
sparql("agg_distinct", "customer", "SELECT (COUNT(DISTINCT ?s) AS ?segments) (COUNT(DISTINCT ?n) AS ?nations) (COUNT(*) AS ?n0) { ?c p:c_mktsegment ?s ; p:c_nationkey ?n }",
       "SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_nationkey) AS nations, count(*) AS n0 FROM customer", segments=L, nations=L, n0=L)
sparql("agg_distinct_sum", "part", "SELECT ?b (SUM(DISTINCT ?s) AS ?t) (AVG(DISTINCT ?s) AS ?a) { ?x p:p_brand ?b ; p:p_size ?s } GROUP BY ?b",
       "SELECT p_brand AS b, CAST(sum(DISTINCT p_size) AS BIGINT) AS t, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY 1", t=L, a="decimal(20,6)")
ORACLE["agg_distinct_sum"] = ORACLE["agg_distinct_sum"].replace("round(avg(DISTINCT p_size), 6)", "CAST(avg(DISTINCT p_size) AS DECIMAL(20,6))")
sparql("agg_empty_zero", "nation", "SELECT (SUM(?x) AS ?total) (COUNT(?x) AS ?n) (AVG(?x) AS ?mean) (MIN(?x) AS ?low) { ?s p:none ?x }",
       "SELECT CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS mean, CAST(NULL AS BIGINT) AS low", total=L, n=L, mean=L, low=L)
sparql("agg_error_unbound", "nation", "SELECT ?r (SUM(?v) AS ?total) (COUNT(?v) AS ?n) { ?x p:n_regionkey ?r ; p:n_name ?v } GROUP BY ?r",
       "SELECT 'urn:region:' || n_regionkey AS r, CAST(NULL AS BIGINT) AS total, count(*) AS n FROM nation GROUP BY n_regionkey", total=L, n=L)
sparql("group_concat_sorted", "nation", "SELECT ?r (GROUP_CONCAT(?v; SEPARATOR = '|') AS ?names) { ?x p:n_regionkey ?r ; p:n_name ?v } GROUP BY ?r",
       "SELECT 'urn:region:' || n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sparql("sample_min", "customer", "SELECT ?s (SAMPLE(?n) AS ?one) { ?c p:c_mktsegment ?s ; p:c_name ?n } GROUP BY ?s", "SELECT c_mktsegment AS s, min(c_name) AS one FROM customer GROUP BY 1")

# Functions
sparql("fn_strings", "part", """SELECT ?x (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(UCASE(?n)) AS ?low) (SUBSTR(?n, 2, 3) AS ?sub) (SUBSTR(?n, 4) AS ?tail) (STRBEFORE(?n, " ") AS ?before) (STRAFTER(?n, " ") AS ?after) (STRAFTER(?n, "zz") AS ?absent)
  (CONTAINS(?n, "ring") AS ?has) (STRSTARTS(?n, "red") AS ?red) (STRENDS(?n, "t") AS ?t) (CONCAT(?n, "/", ?b) AS ?both) (ENCODE_FOR_URI(CONCAT(?n, "~*é")) AS ?uri) { ?x p:p_name ?n ; p:p_brand ?b }""",
       """SELECT 'urn:part:' || p_partkey AS x, length(p_name) AS len, upper(p_name) AS up, lower(p_name) AS low, substr(p_name, 2, 3) AS sub, substr(p_name, 4) AS tail, split_part(p_name, ' ', 1) AS before, substr(p_name, instr(p_name, ' ') + 1) AS after, '' AS absent,
  contains(p_name, 'ring') AS has, starts_with(p_name, 'red') AS red, ends_with(p_name, 't') AS t, p_name || '/' || p_brand AS both, replace(p_name, ' ', '%20') || '~%2A%C3%A9' AS uri FROM part""", len=L, has="boolean", red="boolean", t="boolean")  # fmt: skip
sparql("fn_regex", "part", """SELECT ?x (REGEX(?n, "^(SMALL|red)", "i") AS ?hit) (REPLACE(?n, "[aeiou]", "_") AS ?r) (LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "en") AS ?en) (LANGMATCHES("", "*") AS ?any) { ?x p:p_name ?n }""",
       "SELECT 'urn:part:' || p_partkey AS x, regexp_matches(p_name, '^(SMALL|red)', 'i') AS hit, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, true AS en, false AS \"any\" FROM part", hit="boolean", en="boolean", any="boolean")
sparql("fn_numeric_round", "customer", "SELECT ?c (ROUND(?b) AS ?r) (CEIL(?b) AS ?up) (FLOOR(?b) AS ?down) (ABS(-?b) AS ?abs) (ROUND(-2.5) AS ?tie) (?b / 4 AS ?q) (7 / 2 AS ?half) { ?c p:c_acctbal ?b }",
       "SELECT 'urn:customer:' || c_custkey AS c, floor(c_acctbal + 0.5) AS r, ceil(c_acctbal) AS up, floor(c_acctbal) AS down, abs(c_acctbal) AS abs, CAST(-2 AS DOUBLE) AS tie, c_acctbal / 4 AS q, CAST(3.5 AS DOUBLE) AS half FROM customer", r=D, up=D, down=D, abs=D, tie=D, q=D, half=D)
sparql("fn_dates", "orders", """SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS("2021-03-04T05:06:07.5-08:30"^^xsd:dateTime) AS ?h) (MINUTES("2021-03-04T05:06:07.5-08:30"^^xsd:dateTime) AS ?mi) (SECONDS("2021-03-04T05:06:07.5-08:30"^^xsd:dateTime) AS ?s) (TZ("2021-03-04T05:06:07.5-08:30"^^xsd:dateTime) AS ?tz) (STR(TIMEZONE("2021-03-04T05:06:07.5-08:30"^^xsd:dateTime)) AS ?tzd) { ?o p:o_orderdate ?d }""",
       "SELECT 'urn:orders:' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, CAST(5 AS BIGINT) AS h, CAST(6 AS BIGINT) AS mi, CAST(7.5 AS DOUBLE) AS s, '-08:30' AS tz, '-PT8H30M' AS tzd FROM orders", y=L, m=L, dd=L, h=L, mi=L, s=D)
sparql("fn_hashes", "nation", "SELECT (MD5(?n) AS ?a) (SHA1(?n) AS ?b) (SHA256(?n) AS ?c) (STRLEN(SHA384(?n)) AS ?d) (STRLEN(SHA512(?n)) AS ?e) { ?x p:n_name ?n }",
       "SELECT md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c, CAST(96 AS BIGINT) AS d, CAST(128 AS BIGINT) AS e FROM nation", d=L, e=L)
sparql("fn_casts", "part", """SELECT ?x (xsd:integer(?p) AS ?i) (xsd:double(?s) AS ?d) (xsd:string(?s) AS ?str) (xsd:boolean(?s) AS ?b) (xsd:decimal("1.50") AS ?dec) (xsd:integer("x") AS ?bad) (xsd:dateTime("2020-01-02T03:04:05Z") AS ?dt) (xsd:float("2.5") AS ?f) { ?x p:p_size ?s ; p:p_retailprice ?p }""",
       "SELECT 'urn:part:' || p_partkey AS x, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS VARCHAR) AS str, p_size <> 0 AS b, '1.5' AS dec, CAST(NULL AS BIGINT) AS bad, '2020-01-02T03:04:05Z' AS dt, CAST(2.5 AS DOUBLE) AS f FROM part", i=L, d=D, b="boolean", bad=L, f=D)
sparql("fn_logic_errors", "nation", """SELECT ?n (COALESCE(?nothing, ?v) AS ?co) (BOUND(?nothing) AS ?bd) (IF(?v = "NATION_3", "yes", "no") AS ?if) ((?v < 5) AS ?err) ((?v < 5 || true) AS ?or) ((?v < 5 && false) AS ?and) (?v IN ("NATION_1", "NATION_2") AS ?in) (?v NOT IN ("NATION_1") AS ?ni) (1/0 AS ?zero) (!(1 = 1.0) AS ?neq) { ?n p:n_name ?v }""".replace("(?v IN (\"NATION_1\", \"NATION_2\") AS ?in)", "((?v IN (\"NATION_1\", \"NATION_2\")) AS ?in)").replace("(?v NOT IN (\"NATION_1\") AS ?ni)", "((?v NOT IN (\"NATION_1\")) AS ?ni)"),
       """SELECT 'urn:nation:' || n_nationkey AS n, n_name AS co, false AS bd, CASE WHEN n_nationkey = 3 THEN 'yes' ELSE 'no' END AS "if", CAST(NULL AS BOOLEAN) AS err, true AS "or", false AS "and", n_nationkey IN (1, 2) AS "in", n_nationkey <> 1 AS ni, CAST(NULL AS BIGINT) AS zero, false AS neq FROM nation""", bd="boolean", err="boolean", **{"or": "boolean", "and": "boolean", "in": "boolean"}, ni="boolean", zero=L, neq="boolean")  # fmt: skip
sparql("fn_terms", "nation", """SELECT ?n (ISIRI(?n) AS ?iri) (ISLITERAL(?v) AS ?lit) (ISBLANK(BNODE()) AS ?bn) (ISNUMERIC(?v) AS ?num) (ISNUMERIC(5) AS ?five) (STR(?n) AS ?str) (STR(DATATYPE(?v)) AS ?dt) (LANG("a"@en) AS ?lang) (STR(IRI(CONCAT("urn:z:", ?v))) AS ?made) (STR(DATATYPE(STRDT("1", xsd:integer))) AS ?sd) (SAMETERM(1, 1.0) AS ?same) ((1 = 1.0) AS ?eq) (STRLEN(STRUUID()) AS ?uu) { ?n p:n_name ?v }""",
       "SELECT 'urn:nation:' || n_nationkey AS n, true AS iri, true AS lit, true AS bn, false AS num, true AS five, 'urn:nation:' || n_nationkey AS str, 'http://www.w3.org/2001/XMLSchema#string' AS dt, 'en' AS lang, 'urn:z:' || n_name AS made, 'http://www.w3.org/2001/XMLSchema#integer' AS sd, false AS same, true AS eq, CAST(36 AS BIGINT) AS uu FROM nation", iri="boolean", lit="boolean", bn="boolean", num="boolean", five="boolean", same="boolean", eq="boolean", uu=L)


# Updates, parsing and serialising
@query("update_insert_delete", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:p:n_name' AS p, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE n_name END AS o FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:p:n_regionkey', 'urn:region:' || n_regionkey FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'urn:new', 'urn:p:n_name', 'New'")
def _update(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, table_quads(spark, sf_dir, "nation"))
    engine.update(P + """WITH <urn:g:nation> DELETE { ?n p:n_name ?v } INSERT { ?n p:n_name "moved" } WHERE { ?n p:n_regionkey <urn:region:1> ; p:n_name ?v } ;
      INSERT DATA { GRAPH <urn:g:nation> { <urn:new> p:n_name "New" . <urn:new> p:gone "x" } } ; DELETE DATA { GRAPH <urn:g:nation> { <urn:new> p:gone "x" } } ;
      WITH <urn:g:nation> DELETE { <urn:nation:7> ?p ?o } WHERE { <urn:nation:7> ?p ?o }""")  # fmt: skip
    return engine.quads.select("s", "p", "o")


@query("update_graph_ops", "SELECT 'urn:g:copy' AS g, 2 * count(*) AS n FROM nation UNION ALL SELECT 'urn:g:moved', count(*) FROM region UNION ALL SELECT 'urn:g:nation', 2 * count(*) + (SELECT count(*) FROM region) FROM nation")
def _graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, table_quads(spark, sf_dir, "nation", "region", "supplier"))
    engine.update("COPY <urn:g:nation> TO <urn:g:copy> ; ADD <urn:g:region> TO <urn:g:nation> ; MOVE <urn:g:region> TO <urn:g:moved> ; CREATE GRAPH <urn:g:empty> ; DROP GRAPH <urn:g:supplier> ; CLEAR SILENT GRAPH <urn:g:none>")
    return engine.quads.groupBy("g").agg(F.count("*").alias("n"))


@query("parse_ntriples_roundtrip", "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:p:n_name' AS p, n_name || '\"\\' || chr(10) || 'x' AS o, 'en' AS o_lang FROM nation UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:p:n_regionkey', 'urn:region:' || n_regionkey, '' FROM nation")
def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = table_quads(spark, sf_dir, "nation")
    literal = F.col("o_kind") == LITERAL
    quads = quads.withColumn("o", F.when(literal, F.concat("o", F.lit('"\\\nx'))).otherwise(F.col("o"))).withColumn("o_lang", F.when(literal, "en").otherwise("")).withColumn("o_dt", F.when(literal, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(""))
    return rdf.parse_lines(rdf.to_lines(quads)).select("s", "p", "o", "o_lang")


@query("results_csv_json", """SELECT n_name || ',"a,b"' AS csv, '"' || n_name || '"' || chr(9) || '"a,b"' AS tsv, '{"n":{"type":"literal","value":"' || n_name || '"},"c":{"type":"literal","value":"a,b"}}' AS json FROM nation""")
def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = Engine(spark, table_quads(spark, sf_dir, "nation")).query(P + 'SELECT ?n ("a,b" AS ?c) { ?x p:n_name ?n }')
    rows = df.select(F.struct("*").alias("r"))
    one = rows.select("r.*")
    csv, tsv, js = (f(one).withColumn("k", F.regexp_extract("value", r"NATION_\d+", 0)) for f in (rdf.results_csv, rdf.results_tsv, rdf.results_json))
    return csv.select("k", F.col("value").alias("csv")).join(tsv.select("k", F.col("value").alias("tsv")), "k").join(js.select("k", F.col("value").alias("json")), "k").drop("k")


# Adaptive joins
def _star_plan(spark: SparkSession, sf_dir: str):
    """Operands of the adaptive star (orders, customers, nations) and its plan in a given order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("nation"))
    shares = [["o_orderkey", "c"], ["c", "n"], ["n", "nation"]]

    def plan(operands: list[DataFrame], order: list[int]) -> DataFrame:
        left = [i for i in order]
        now, seen = operands[left[0]], set(shares[left.pop(0)])
        while left:
            pick = next((i for i in left if seen & set(shares[i])), left[0])
            left.remove(pick)
            now = now.join(operands[pick], sorted(seen & set(shares[pick])))
            seen |= set(shares[pick])
        return now.select("o_orderkey", "c", "n", "nation")

    return [orders, customers, nations], plan


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple:
    """Plan and rounds: customers in two rounds, a 64th of the orders in the first, a quarter by the second, the rest in two more. Cardinalities are counts of what has arrived."""
    (orders, customers, nations), plan = _star_plan(spark, sf_dir)
    orders_at = F.when(F.col("o_orderkey") % 64 == 0, 0).when(F.col("o_orderkey") % 64 < 16, 1).when(F.col("o_orderkey") % 64 < 40, 2).otherwise(3)
    customers_at = F.col("c") % 2
    counted = orders.select(orders_at.alias("at"), F.lit(0).alias("of")).unionByName(customers.select(customers_at.alias("at"), F.lit(1).alias("of"))).unionByName(nations.select(F.lit(0).alias("at"), F.lit(2).alias("of")))
    n = {(r["of"], r["at"]): r["count"] for r in counted.groupBy("of", "at").count().collect()}  # one row per operand and round
    rounds = []
    for at in range(4):
        new = [orders.filter(orders_at == at), customers.filter(customers_at == at) if at < 2 else None, nations if at == 0 else None]
        rounds.append((new, [float(sum(n.get((of, k), 0) for k in range(at + 1))) for of in range(3)]))
    return plan, rounds


def _adaptive(spark: SparkSession, sf_dir: str, config: RestartConfig) -> adaptive.AdaptiveJoin:
    plan, rounds = _arrivals(spark, sf_dir)
    join = adaptive.AdaptiveJoin(plan, lambda n: sorted(range(3), key=lambda i: n[i]), 1.0, config)
    join.run(rounds)
    return join


STAR = "SELECT o_orderkey, c_custkey AS c, n_nationkey AS n, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("adaptive_join_static_equiv", STAR)
def _static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptive(spark, sf_dir, RestartConfig(threshold=1e-9)).emitted


@query("adaptive_observed_trace", """WITH o AS (SELECT CASE WHEN o_orderkey % 64 = 0 THEN 0 WHEN o_orderkey % 64 < 16 THEN 1 WHEN o_orderkey % 64 < 40 THEN 2 ELSE 3 END AS w, o_custkey % 2 AS c FROM orders),
 r AS (SELECT CAST(k AS BIGINT) AS k, (SELECT count(*) FROM o WHERE w <= k) AS orders, (SELECT count(*) FROM customer WHERE c_custkey % 2 <= k) AS customers, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM o WHERE w < k AND c < k) AS made FROM range(4) t(k)),
 x AS (SELECT k, CAST(orders + customers + nations AS DOUBLE) AS expected, CASE WHEN nations <= orders THEN CASE WHEN customers < nations THEN 'c,n,o' WHEN customers < orders THEN 'n,c,o' ELSE 'n,o,c' END ELSE CASE WHEN customers < orders THEN 'c,o,n' WHEN customers <= nations THEN 'o,c,n' ELSE 'o,n,c' END END AS best, made FROM r),
 y AS (SELECT *, lag(best) OVER (ORDER BY k) AS before FROM x)
 SELECT k AS round, expected, CASE WHEN before IS NULL THEN 'start' WHEN best = before THEN 'keep' WHEN made < ceil(0.2 * expected) THEN 'swap' ELSE 'skip' END AS action FROM y""")
def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over observed counts: orders outgrow customers in the second round, after few results."""
    trace = _adaptive(spark, sf_dir, RestartConfig()).trace
    return spark.createDataFrame([(t["round"], t["expected"], t["action"]) for t in trace], "round bigint, expected double, action string")


@query("adaptive_join_forced_restart", STAR)
def _forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adaptive(spark, sf_dir, RestartConfig(threshold=1e9)).emitted


def adaptive_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer, nation and region, by an adaptive join."""
    found = _adaptive(spark, sf_dir, RestartConfig()).emitted
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return found.groupBy("c", "n", "nation").agg(F.count("*").alias("orders")).join(nation, F.col("n") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("c", "nation", F.col("r_name").alias("region"), "orders")


_put("adaptive_star", adaptive_star, f"SELECT c, nation, r_name AS region, count(*) AS orders FROM ({STAR}) JOIN nation ON n = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
#: cardinalities, selectivity, threshold, produced, restarts, limit
VECTORS = [([1.0, 10.0], 0.5, 0.5, 2, 0, None), ([1.0, 10.0], 0.5, 0.5, 3, 0, None), ([1.0, 10.0], 0.5, 0.2, 1, 0, None), ([1.0, 10.0], 0.5, 0.2, 2, 0, None), ([20.0, 10.0], 1.0, 0.2, 0, 0, None), ([20.0, 10.0], 1.0, 0.2, 6, 0, None), ([], 1.0, 0.2, 0, 0, None), ([1.0, 10.0], None, 0.5, 0, 0, None), ([20.0, 10.0], 1.0, 0.2, 0, 2, 2.0)]


@query("restart_decision_trace", "SELECT CAST(i AS BIGINT) AS i, action FROM (VALUES (0, 'swap'), (1, 'skip'), (2, 'swap'), (3, 'skip'), (4, 'swap'), (5, 'skip'), (6, 'skip'), (7, 'skip'), (8, 'none')) t(i, action)")
def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(i, adaptive.decide(produced, adaptive.expected_output(n, s), restarts, RestartConfig(threshold=t, limit=limit))) for i, (n, s, t, produced, restarts, limit) in enumerate(VECTORS)]
    return spark.createDataFrame(rows, "i bigint, action string")


@query("restart_gate_matrix", """SELECT skip, wrapped, wrap_all, updates, lim, CASE WHEN skip THEN 'cannot run due to adaptive join being disabled' WHEN wrapped > 0 AND NOT wrap_all THEN 'can only wrap the topmost join' WHEN wrapped = 2 THEN 'can only wrap a single set of join entries once'
  WHEN NOT updates THEN 'has no evaluation conditions enabled' WHEN lim < 1 THEN 'cannot restart even once' ELSE 'pass' END AS why FROM (VALUES (true), (false)) a(skip), (VALUES (CAST(0 AS BIGINT)), (1), (2)) b(wrapped), (VALUES (true), (false)) c(wrap_all), (VALUES (true), (false)) d(updates), (VALUES (CAST(0 AS BIGINT)), (1)) e(lim)""")
def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for skip in (True, False):
        for wrapped in (0, 1, 2):  # nothing wrapped, another operation, one of these
            for wrap_all in (True, False):
                for updates in (True, False):
                    for limit in (0, 1):
                        config = RestartConfig(updates, None, limit, 0.5, wrap_all)
                        rows.append((skip, wrapped, wrap_all, updates, limit, adaptive.gate(config, ["a", "b"], [[], ["x"], ["a"]][wrapped], skip) or "pass"))
    return spark.createDataFrame(rows, "skip boolean, wrapped bigint, wrap_all boolean, updates boolean, lim bigint, why string")


@query("replay_suppression_bag", "SELECT o_orderpriority AS pr, o_orderstatus AS st FROM orders EXCEPT ALL SELECT o_orderpriority, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("st"), "o_orderkey")
    return adaptive.suppress(rows.select("pr", "st"), rows.filter("o_orderkey % 3 = 0").select("pr", "st"))


# Operand order and estimates
CHAIN = P + "SELECT * { ?l p:l_orderkey ?o . ?o p:o_custkey ?c . ?c p:c_nationkey ?n . ?n p:n_regionkey <urn:region:1> }"


def _chain(spark: SparkSession, sf_dir: str):
    stats = cardinality.Statistics.collect(cardinality.describe(table_quads(spark, sf_dir, "lineitem", "orders", "customer", "nation")))
    patterns = A.patterns(parse(CHAIN))
    return patterns, ordering.estimates(patterns, list(stats.values())), stats


def _order_rows(spark: SparkSession, patterns: list[A.Pattern], order: list[int]) -> DataFrame:
    return spark.createDataFrame([(rank, patterns[i].p.value) for rank, i in enumerate(order)], "rank bigint, p string")


@query("operand_order_cardinality", """SELECT row_number() OVER (ORDER BY n, ord) - 1 AS rank, p FROM (SELECT 0 AS ord, 'urn:p:l_orderkey' AS p, count(*) AS n FROM lineitem UNION ALL SELECT 1, 'urn:p:o_custkey', count(*) FROM orders UNION ALL SELECT 2, 'urn:p:c_nationkey', count(*) FROM customer UNION ALL SELECT 3, 'urn:p:n_regionkey', count(*) / count(DISTINCT n_regionkey) FROM nation)""")
def _by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns, sizes, _ = _chain(spark, sf_dir)
    return _order_rows(spark, patterns, ordering.by_cardinality(patterns, sizes))


ORDERED = "SELECT CAST(rank AS BIGINT) AS rank, p FROM (VALUES (0, 'urn:p:n_regionkey'), (1, 'urn:p:c_nationkey'), (2, 'urn:p:o_custkey'), (3, 'urn:p:l_orderkey')) t(rank, p)"


@query("operand_order_selectivity", ORDERED)
def _by_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns, sizes, stats = _chain(spark, sf_dir)
    merged = cardinality.Statistics("all", tuple(sum(s.whole[i] for s in stats.values()) for i in range(3)), {p: v for s in stats.values() for p, v in s.by_predicate.items()})
    return _order_rows(spark, patterns, ordering.by_selectivity(patterns, sizes, merged))


@query("operand_order_zero_knowledge", ORDERED)
def _by_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = A.patterns(parse(CHAIN))
    return _order_rows(spark, patterns, ordering.zero_knowledge(patterns))


@query("void_stats", """SELECT 'nation' AS dataset, 'urn:p:n_name' AS p, count(*) AS triples, count(DISTINCT n_nationkey) AS distinct_s, count(DISTINCT n_name) AS distinct_o FROM nation
 UNION ALL SELECT 'nation', 'urn:p:n_regionkey', count(*), count(DISTINCT n_nationkey), count(DISTINCT n_regionkey) FROM nation
 UNION ALL SELECT 'nation', NULL, 2 * count(*), count(DISTINCT n_nationkey), count(DISTINCT n_name) + count(DISTINCT n_regionkey) FROM nation
 UNION ALL SELECT 'region', 'urn:p:r_name', count(*), count(DISTINCT r_regionkey), count(DISTINCT r_name) FROM region
 UNION ALL SELECT 'region', NULL, count(*), count(DISTINCT r_regionkey), count(DISTINCT r_name) FROM region""")
def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cardinality.describe(table_quads(spark, sf_dir, "nation", "region"))


MASKS = "SELECT * { ?a ?b ?c . <urn:nation:1> ?d ?e . ?f p:n_regionkey ?g . ?h ?i <urn:region:1> . <urn:nation:1> p:n_regionkey ?j . ?k p:n_regionkey <urn:region:1> . <urn:nation:1> ?l <urn:region:1> . <urn:nation:1> p:n_regionkey <urn:region:1> . ?m p:absent ?n }"


def _nation_stats(spark: SparkSession, sf_dir: str) -> list:
    return list(cardinality.Statistics.collect(cardinality.describe(table_quads(spark, sf_dir, "nation"))).values())


@query("void_pattern_estimates", """WITH n AS (SELECT CAST(2 * count(*) AS DOUBLE) AS t, count(DISTINCT n_nationkey) AS s, count(DISTINCT n_name) + count(DISTINCT n_regionkey) AS o, CAST(count(*) AS DOUBLE) AS tp, count(DISTINCT n_nationkey) AS sp, count(DISTINCT n_regionkey) AS op FROM nation)
 SELECT CAST(i AS BIGINT) AS i, round(CASE i WHEN 0 THEN t WHEN 1 THEN t / s WHEN 2 THEN tp WHEN 3 THEN t / o WHEN 4 THEN tp / sp WHEN 5 THEN tp / op WHEN 6 THEN t / (s * o) WHEN 7 THEN least(1.0, tp / (sp * op)) ELSE 0.0 END, 9) AS estimate FROM n, range(9) r(i)""")
def _pattern_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _nation_stats(spark, sf_dir)
    return spark.createDataFrame([(i, round(cardinality.estimate_operation(p, stats).value, 9)) for i, p in enumerate(A.patterns(parse(P + MASKS)))], "i bigint, estimate double")


@query("void_predicate_estimates", """WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS tp FROM nation) SELECT CAST(i AS BIGINT) AS i, CASE WHEN i IN (0, 1, 3, 6) THEN 2 * tp WHEN i = 8 THEN 0.0 ELSE tp END AS estimate FROM n, range(9) r(i)""")
def _predicate_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _nation_stats(spark, sf_dir)
    rows = [(i, cardinality.estimate_operation(p, stats, predicate_only=True).value) for i, p in enumerate(A.patterns(parse(P + MASKS)))]
    assert cardinality.estimate_operation(parse(P + MASKS), stats, predicate_only=True) is None
    return spark.createDataFrame(rows, "i bigint, estimate double")


@query("dataset_accumulate_dedupe", "SELECT CAST(pos AS BIGINT) AS pos, uri, source FROM (VALUES (0, 'ex:a', 'r2'), (1, 'ex:b', 'r1'), (2, 'ex:c', 'r2')) t(pos, uri, source)")
def _accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda uri, source: cardinality.Statistics(uri, (1.0, 1.0, 1.0), source=source)
    known = cardinality.accumulate("append", {}, {"datasets": [made("ex:a", "r1"), made("ex:b", "r1")]})
    found = cardinality.accumulate("append", known, {"datasets": [made("ex:c", "r2"), made("ex:a", "r2")]})["datasets"]
    return spark.createDataFrame([(i, d.uri, d.source) for i, d in enumerate(found)], "pos bigint, uri string, source string")


@query("cardinality_accumulate_type", "SELECT 1 AS step, CAST(count(*) AS DOUBLE) AS value, 'estimate' AS type, 'nation' AS dataset FROM nation UNION ALL SELECT 2, CAST(count(*) AS DOUBLE) + 0, 'estimate', NULL FROM nation")
def _accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = list(cardinality.Statistics.collect(cardinality.describe(table_quads(spark, sf_dir, "nation", "region"))).values())
    stats.sort(key=lambda s: s.uri)
    op = A.patterns(parse(P + "SELECT * { ?x p:n_name ?y }"))[0]
    one = cardinality.accumulate("append", {}, {"datasets": stats[:1]}, op)
    two = cardinality.accumulate("append", one, {"datasets": stats[1:]}, op)
    assert cardinality.accumulate("initialize", {}, {}) == {}
    return spark.createDataFrame([(i, m["cardinality"].value, m["cardinality"].type, m["cardinality"].dataset) for i, m in ((1, one), (2, two))], "step int, value double, type string, dataset string")


# Link filters and traversal
HASH = "SELECT v, ('0x' || substr(md5(v), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(v), 9, 8))::BIGINT AS h2"
BITS, K = 512, 4


@query("bloom_build_positions", f"SELECT DISTINCT key, (h1 + i * h2) % {BITS} AS at FROM (SELECT key, h1, h2, unnest(range({K})) AS i FROM (SELECT 'urn:region:' || n_regionkey AS key, n_name AS v, ('0x' || substr(md5(n_name), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(n_name), 9, 8))::BIGINT AS h2 FROM nation))")
def _bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _region_filters(spark, sf_dir).select("key", F.explode("positions").alias("at"))


def _region_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").selectExpr("'urn:region:' || n_regionkey key", "n_name v")
    return linkfilters.build(names, "key", "v", BITS, K)


BLOOM_SQL = f"""bits AS (SELECT DISTINCT key, (h1 + i * h2) % {BITS} AS pos FROM (SELECT key, h1, h2, unnest(range({K})) AS i FROM (SELECT 'urn:region:' || n_regionkey AS key, ('0x' || substr(md5(n_name), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(n_name), 9, 8))::BIGINT AS h2 FROM nation))),
probe AS (SELECT DISTINCT v, (h1 + i * h2) % {BITS} AS pos FROM (SELECT v, h1, h2, unnest(range({K})) AS i FROM ({HASH} FROM (SELECT n_name AS v FROM nation UNION ALL SELECT c_name FROM customer)))),
hits AS (SELECT key, v, count(*) AS c FROM bits JOIN probe USING (pos) GROUP BY 1, 2), need AS (SELECT v, count(*) AS c FROM probe GROUP BY 1)"""


@query("bloom_membership", f"WITH {BLOOM_SQL} SELECT key, v FROM hits JOIN need USING (v) WHERE hits.c = need.c")
def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "nation").selectExpr("n_name v").unionByName(table(spark, sf_dir, "customer").selectExpr("c_name v")).distinct()
    return probes.crossJoin(F.broadcast(_region_filters(spark, sf_dir))).filter(linkfilters.contains(F.col("positions"), F.col("v"), F.col("bits"), F.col("k"))).select("key", "v")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property filter per region, a resource filter for some, one dataset without a filter, one without a projection."""
    filters = _region_filters(spark, sf_dir)
    prop = filters.select(F.concat(F.lit("http://data/"), "key").alias("dataset"), F.lit("urn:p:n_name").alias("projected_property"), F.lit(None).cast("string").alias("projected_resource"), "bits", "k", "positions")
    res = filters.filter("key = 'urn:region:2'").select(F.lit("http://data/resource").alias("dataset"), F.lit(None).cast("string").alias("projected_property"), F.lit("urn:x").alias("projected_resource"), "bits", "k", "positions")
    bare = prop.limit(1).select(F.lit("http://data/bare").alias("dataset"), F.lit(None).cast("string").alias("projected_property"), F.lit(None).cast("string").alias("projected_resource"), "bits", "k", "positions")
    none = spark.createDataFrame([("http://data/none", "urn:p:n_name", None, None, None, None)], "dataset string, projected_property string, projected_resource string, bits int, k int, positions array<bigint>")
    return prop.unionByName(res).unionByName(bare).unionByName(none)


BLOOM_QUERY = P + "SELECT * { ?x p:n_name 'NATION_6' . ?x p:n_regionkey ?y . <urn:x> ?z 'NATION_7' }"
MATCHING = f"WITH {BLOOM_SQL}, has AS (SELECT key, v FROM hits JOIN need USING (v) WHERE hits.c = need.c)"


@query("bloom_relevance_reference", f"{MATCHING} SELECT 'http://data/' || key AS dataset FROM (SELECT DISTINCT key FROM bits) WHERE key NOT IN (SELECT key FROM has WHERE v = 'NATION_6') UNION ALL SELECT 'http://data/none' UNION ALL SELECT 'http://data/bare' UNION ALL SELECT 'http://data/resource' WHERE NOT EXISTS (SELECT 1 FROM has WHERE key = 'urn:region:2' AND v = 'NATION_7')")
def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The third pattern has a variable predicate, which would rescue every property filter.
    patterns = linkfilters.pattern_table(spark, parse(BLOOM_QUERY))
    some = patterns.filter("qp is not null")
    by_property = linkfilters.irrelevant_datasets(_summaries(spark, sf_dir).filter("projected_resource is null"), some)
    return by_property.unionByName(linkfilters.irrelevant_datasets(_summaries(spark, sf_dir).filter("projected_resource is not null"), patterns))


@query("bloom_relevance_sound", f"{MATCHING} SELECT 'http://data/' || key AS dataset FROM (SELECT DISTINCT key FROM bits) WHERE key NOT IN (SELECT key FROM has WHERE v = 'NATION_6')")
def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = linkfilters.pattern_table(spark, parse(P + "SELECT * { ?x p:n_name 'NATION_6' }"))
    return linkfilters.irrelevant_datasets(_summaries(spark, sf_dir), patterns, "sound")


@query("bloom_metadata_summaries", "SELECT 'ex:collection' AS collection, 'ex:dataset' AS dataset, 'ex:p' AS projected_property, CAST(NULL AS VARCHAR) AS projected_resource, CAST(64 AS INTEGER) AS bits, 'AAA=' AS bitmap, CAST(3 AS INTEGER) AS k UNION ALL SELECT 'ex:empty', 'ex:other', NULL, 'ex:r', NULL, NULL, NULL")
def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("ex:f", "memberCollection", "ex:collection"), ("ex:f", "hashFunction", "ex:h"), ("ex:h", "hashSize", "3"), ("ex:f", "bitSize", "32"), ("ex:f", "bitSize", "64"), ("ex:f", "binaryRepresentation", "AAA="), ("ex:collection", "sourceCollection", "ex:dataset"), ("ex:collection", "projectedProperty", "ex:p"), ("ex:empty", "sourceCollection", "ex:other"), ("ex:empty", "projectedResource", "ex:r")]
    quads = spark.createDataFrame([(s, MEM + p, o, i) for i, (s, p, o) in enumerate(rows)], "s string, p string, o string, seq int")
    return linkfilters.membership_summaries(quads)


@query("bloom_deny_links", "SELECT url FROM pages WHERE NOT starts_with(url, 'https://m.') AND NOT starts_with(url, 'http://th')")
def _deny(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = spark.createDataFrame([("https://m.",), ("http://th",)], "dataset string")
    return linkfilters.deny_prefixes(table(spark, sf_dir, "pages").select("url"), datasets)


def _void(spark: SparkSession) -> DataFrame:
    """Rules: an endpoint with a space (its pattern is passed over), one with an empty space and a pattern, one without endpoint, one with neither."""
    rows = [("ex:a", "sparqlEndpoint", "ex:sparql"), ("ex:a", "uriSpace", "https://www."), ("ex:a", "uriRegexPattern", "."), ("ex:b", "sparqlEndpoint", "ex:sparql"), ("ex:b", "uriSpace", ""), ("ex:b", "uriRegexPattern", r"/en/\d+[02468]\b"), ("ex:c", "uriSpace", "http"), ("ex:d", "sparqlEndpoint", "ex:sparql")]
    return linkfilters.void_rules(spark.createDataFrame([(s, VOID + p, o, i) for i, (s, p, o) in enumerate(rows)], "s string, p string, o string, seq int"))


@query("void_deny_prefix", "SELECT url FROM pages WHERE NOT starts_with(url, 'https://www.')")
def _deny_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkfilters.deny(table(spark, sf_dir, "pages").select("url"), _void(spark).filter("prefix is not null"))


@query("void_deny_regex", r"SELECT url FROM pages WHERE NOT starts_with(url, 'https://www.') AND NOT regexp_matches(url, '/en/\d+[02468]\b')")
def _deny_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkfilters.deny(table(spark, sf_dir, "pages").select("url"), _void(spark))


@query("extract_links_predicate", "SELECT 'customer' AS src, 'urn:nation:' || c_nationkey AS url FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', 'urn:nation:' || s_nationkey FROM supplier GROUP BY ALL")
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.predicate_links(table_quads(spark, sf_dir, "customer", "supplier"), ("urn:p:c_nationkey", "urn:p:s_nationkey"))


@query("extract_links_pattern", "SELECT 'nation' AS src, 'urn:nation:' || n_nationkey AS url FROM nation WHERE n_regionkey = 2 UNION SELECT 'nation', 'urn:p:n_regionkey' UNION SELECT 'nation', 'urn:region:2'")
def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.pattern_links(table_quads(spark, sf_dir, "nation"), [(None, "urn:p:n_regionkey", "urn:region:2")])


@query("extract_links_html", """SELECT url AS src, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS url FROM pages""")
def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.html_links(table(spark, sf_dir, "pages"))


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = table_quads(spark, sf_dir, "nation", "region", "supplier")
    linked = quads.filter(F.col("o_kind") == IRI).select(F.col("s").alias("src"), F.col("o").alias("url"))
    return linked.unionByName(linked.select(F.col("url").alias("src"), F.col("src").alias("url")))


WEB = """edges AS (SELECT 'urn:nation:' || n_nationkey AS a, 'urn:region:' || n_regionkey AS b FROM nation UNION SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)"""


@query("traversal_frontier", f"WITH RECURSIVE {WEB}, r(url, depth) AS (SELECT 'urn:region:1', 0 UNION SELECT b, depth + 1 FROM r JOIN both_ways ON url = a WHERE depth < 4) SELECT url, min(depth) AS depth FROM r GROUP BY url")
def _traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traversal.traverse(_web(spark, sf_dir), spark.createDataFrame([("urn:region:1",)], "url string"), most_rounds=4)


@query("traversal_filtered", f"WITH RECURSIVE {WEB}, r(url, depth) AS (SELECT 'urn:region:1', 0 UNION SELECT b, depth + 1 FROM r JOIN both_ways ON url = a WHERE depth < 4 AND NOT starts_with(b, 'urn:supplier:1')) SELECT url, min(depth) AS depth FROM r GROUP BY url")
def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("urn:supplier:1",)], "dataset string")
    return traversal.traverse(_web(spark, sf_dir), spark.createDataFrame([("urn:region:1",)], "url string"), lambda df: linkfilters.deny_prefixes(df, rules), 4)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of customer, nation and region as a document; what a nation says of its region the region says too."""
    quads = table_quads(spark, sf_dir, "customer", "nation", "region").withColumn("src", F.col("s"))
    return quads.unionByName(quads.filter("p = 'urn:p:n_regionkey'").withColumn("src", F.col("o")).withColumn("g", F.lit("urn:g:copies")))


SEEDS = [f"urn:customer:{k}" for k in range(0, 40, 3)]
FOLLOW = P + "SELECT ?c ?name ?m { ?r p:r_name ?name . ?n p:n_regionkey ?r . ?c p:c_nationkey ?n OPTIONAL { ?c p:c_mktsegment ?m FILTER(?m > 'C') } }"
FOLLOWED = "SELECT 'urn:customer:' || c_custkey AS c, r_name AS name, CASE WHEN c_mktsegment > 'C' THEN c_mktsegment END AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (" + ", ".join(s.rsplit(":", 1)[1] for s in SEEDS) + ")"


@query("traversal_adaptive", FOLLOWED)
def _traversal_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers lead to nations and those to regions; the join runs while documents arrive."""
    from quadloom.operators.hypermedia import LinkTraversal

    return values(LinkTraversal(_documents(spark, sf_dir), restart=RestartConfig(threshold=1e9)).query(FOLLOW, SEEDS))


@query("traversal_plain_join", FOLLOWED)
def _traversal_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.operators.hypermedia import LinkTraversal

    return values(LinkTraversal(_documents(spark, sf_dir), skip_adaptive_join=True).query(FOLLOW, SEEDS))


@query("graph_union_distinct", "SELECT 'urn:nation:' || n_nationkey AS n, 'urn:region:' || n_regionkey AS r FROM nation")
def _union_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples that two graphs hold count once in the default graph."""
    return values(Engine(spark, _documents(spark, sf_dir)).query(P + "SELECT ?n ?r { ?n p:n_regionkey ?r }"))


sparql("exists_in_expression", "customer orders", "SELECT ?c ?big { ?c p:c_mktsegment 'BUILDING' ; p:c_acctbal ?b BIND(EXISTS { ?o p:o_custkey ?c ; p:o_totalprice ?t FILTER(?t > 400000) } AS ?big) FILTER(?b < 0 || NOT EXISTS { ?o p:o_custkey ?c ; p:o_orderstatus 'F' }) }",
       "SELECT 'urn:customer:' || c_custkey AS c, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS big FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_acctbal < 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'))", big="boolean")
LOOSE = "?c p:c_mktsegment 'BUILDING' OPTIONAL { ?c p:c_nationkey ?n . ?c p:c_acctbal ?b FILTER(?b > 5000) }"
LOOSE_SQL = "(SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_nationkey END AS n FROM customer WHERE c_mktsegment = 'BUILDING')"
sparql("optional_loose", "customer nation", f"SELECT ?c ?n ?name {{ {LOOSE} OPTIONAL {{ ?n p:n_name ?name FILTER(?name < 'NATION_15') }} }}",
       f"SELECT 'urn:customer:' || c_custkey AS c, 'urn:nation:' || coalesce(n, n_nationkey) AS n, n_name AS name FROM {LOOSE_SQL} LEFT JOIN nation ON (n IS NULL OR n = n_nationkey) AND n_name < 'NATION_15'")
sparql("minus_loose", "customer nation", f"SELECT ?c ?n {{ {LOOSE} MINUS {{ ?n p:n_regionkey <urn:region:1> }} }}",
       f"SELECT 'urn:customer:' || c_custkey AS c, 'urn:nation:' || n AS n FROM {LOOSE_SQL} WHERE n IS NULL OR n NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sparql("exists_loose", "customer nation", f"SELECT ?c ?n {{ {LOOSE} FILTER EXISTS {{ ?n p:n_regionkey <urn:region:1> }} FILTER NOT EXISTS {{ ?n p:n_regionkey <urn:region:77> }} }}",
       f"SELECT 'urn:customer:' || c_custkey AS c, 'urn:nation:' || n AS n FROM {LOOSE_SQL} WHERE (n IS NULL AND EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1)) OR n IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")


@query("service_variable", "SELECT 'urn:a' AS e, 'urn:nation:' || n_nationkey AS x FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 'urn:b', 'urn:region:' || r_regionkey FROM region")
def _service_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every endpoint that the engine knows answers a variable one."""
    services = {"urn:a": lambda: table_quads(spark, sf_dir, "nation").filter("s rlike ':[0-4]$'"), "urn:b": lambda: table_quads(spark, sf_dir, "region")}
    engine = Engine(spark, spark.createDataFrame([], QUADS), services=services)
    return values(engine.query(P + "SELECT ?e ?x { SERVICE ?e { ?x ?p ?name FILTER(?p = p:n_name || ?p = p:r_name) } }"))


@query("service_endpoint", "SELECT 'urn:customer:' || c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name <> 'NATION_3'")
def _endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group pushed to an endpoint, this engine's own service, with the nations that customers have as bindings."""
    import threading

    from quadloom.service import server
    from quadloom.sources.endpoint import Endpoint

    with server(Engine(spark, Tables(spark, sf_dir, "nation")), 0) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        engine = Engine(spark, Tables(spark, sf_dir, "customer"), services={"urn:endpoint": Endpoint(f"http://127.0.0.1:{running.server_port}/sparql")})
        found = values(engine.query(P + "SELECT ?c ?name { ?c p:c_mktsegment 'BUILDING' ; p:c_nationkey ?n SERVICE <urn:endpoint> { ?n p:n_name ?name FILTER(?name != 'NATION_3') } }"))
        out = written(found, "endpoint")
        running.shutdown()
    return out


FNV_SQL = "list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split('{seed}' || v, ''), lambda c: ord(c)::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query("bloom_fnv_membership", f"""WITH h AS (SELECT v, region, {FNV_SQL.format(seed="S")} AS h1, {FNV_SQL.format(seed="W")} AS h2 FROM (SELECT n_name AS v, 'urn:region:' || n_regionkey AS region FROM nation UNION ALL SELECT c_name, NULL FROM customer)),
 p AS (SELECT v, region, ((h1 + i * h2) % {BITS})::BIGINT AS pos FROM h, range({K}) r(i)), bits AS (SELECT DISTINCT region AS key, pos FROM p WHERE region IS NOT NULL),
 probe AS (SELECT DISTINCT v, pos FROM p), hits AS (SELECT key, v, count(*) AS c FROM bits JOIN probe USING (pos) GROUP BY 1, 2), need AS (SELECT v, count(*) AS c FROM probe GROUP BY 1)
 SELECT key, v FROM hits JOIN need USING (v) WHERE hits.c = need.c""")
def _fnv_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by FNV-1a as bitmaps, asked by one byte test per position."""
    names = table(spark, sf_dir, "nation").selectExpr("'urn:region:' || n_regionkey key", "n_name v")
    filters = linkfilters.build(names, "key", "v", BITS, K, "fnv").select("key", "bits", "k", F.unbase64(linkfilters.bitmap(F.col("positions"), BITS)).alias("raw"))
    probes = table(spark, sf_dir, "nation").selectExpr("n_name v").unionByName(table(spark, sf_dir, "customer").selectExpr("c_name v")).distinct()
    return probes.crossJoin(F.broadcast(filters)).filter(linkfilters.holds(F.col("raw"), F.col("v"), F.col("bits"), F.col("k"), "fnv")).select("key", "v")


# Requests, context and streams
@query("http_delay_distribution", "SELECT event_id, CAST(floor(30.0 + u * 20.0 + 0.5) AS BIGINT) AS ms, CAST(floor(0.0 + u * 100.0 + 0.5) AS BIGINT) AS clipped FROM (SELECT event_id, ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events)")
def _delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return table(spark, sf_dir, "events").select("event_id", http.Delay(40, 10).column(u).alias("ms"), http.Delay(20, 50).column(u).alias("clipped"))


@query("context_defaults", "SELECT CAST(0 AS BIGINT) AS link_filters, 'cardinality' AS join_order, CAST(0.2 AS DOUBLE) AS threshold, true AS unlimited")
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, config = Engine(spark, spark.createDataFrame([], QUADS)).context(), RestartConfig()
    return spark.createDataFrame([(len(c.link_filters), c.join_order, config.threshold, config.most == float("inf"))], "link_filters bigint, join_order string, threshold double, unlimited boolean")


@query("wiring_http_min_time", "SELECT 'delay' AS first, 'fetch' AS second")
def _wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = http.Delay()
    actors = {"fetch": lambda c: 1.0, "delay": delay.test}
    return spark.createDataFrame([(http.mediate(actors, {}), http.mediate(actors, {"delayed": True}))], "first string, second string")


def _event_stream(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """Events as a stream of files; copies > 1 repeats them as restarted runs."""
    folder = fresh_dir(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_type", F.col("user_id"))
    for run in range(copies):
        events.withColumn("run", F.lit(run)).write.mode("append").parquet(folder)
    return spark.readStream.schema("event_type string, user_id bigint, run int").option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, batch after batch, into the shared folder; the last batch of a complete result."""
    out, last = fresh_dir(spark, "stream-out"), {}

    def keep(df: DataFrame, batch: int) -> None:
        last["path"] = f"{out}/{batch}"
        df.write.mode("overwrite").parquet(last["path"])

    stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_dir(spark, "stream-state")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last["path"] if mode == "complete" else f"{out}/*")


@query("stream_replay_suppression", "SELECT event_type, user_id FROM events")
def _stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.streaming.incremental import replay_suppressed

    return _drain(spark, replay_suppressed(_event_stream(spark, sf_dir, 2), ["event_type", "user_id"]), "append")


@query("stream_partial_cardinality", "SELECT event_type, count(*) AS cardinality FROM events GROUP BY 1")
def _stream_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.streaming.incremental import partial_cardinalities

    return _drain(spark, partial_cardinalities(_event_stream(spark, sf_dir, 1), "event_type"), "complete")
