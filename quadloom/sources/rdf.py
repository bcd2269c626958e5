"""N-Triples and N-Quads in and out, and result formats, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.model import BNODE, IRI, LANG_STRING, LITERAL, STRING

_TERM = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
LINE = rf"^\s*(<[^>]*>|_:[^\s]+)\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>)?\s*\.\s*(?:#.*)?$"
_ESCAPED = {"\\\\": "\\", '\\"': '"', "\\n": "\n", "\\r": "\r", "\\t": "\t"}


def _unescape(x: Column) -> Column:
    # A private-use character holds the place of escaped backslashes, so that they don't escape again.
    x = F.replace(x, F.lit("\\\\"), F.lit(""))
    for a, b in _ESCAPED.items():
        if a != "\\\\":
            x = F.replace(x, F.lit(a), F.lit(b))
    return F.replace(x, F.lit(""), F.lit("\\"))


def _escape(x: Column) -> Column:
    for a, b in _ESCAPED.items():
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def _kind(t: Column) -> Column:
    return F.when(F.startswith(t, F.lit("<")), IRI).when(F.startswith(t, F.lit("_:")), BNODE).otherwise(LITERAL).cast("tinyint")


def _value(t: Column) -> Column:
    return F.when(F.startswith(t, F.lit("<")), F.substring(t, F.lit(2), F.length(t) - 2)).when(F.startswith(t, F.lit("_:")), F.substring(t, F.lit(3), F.length(t))).otherwise(_unescape(F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1)))


def parse_lines(lines: DataFrame, column: str = "value", src: str = "") -> DataFrame:
    """Quads of N-Triples or N-Quads lines; comments, blank and malformed lines give none."""
    found = lines.filter(F.col(column).rlike(LINE)).select(*[F.regexp_extract(column, LINE, i).alias(n) for i, n in enumerate(("a", "b", "c", "d"), 1)])
    c = F.col("c")
    lang = F.lower(F.regexp_extract(c, r'"@([A-Za-z0-9-]+)$', 1))
    dt = F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1)
    literal = _kind(c) == LITERAL
    return found.select(
        F.when(F.col("d") == "", "").otherwise(F.substring("d", F.lit(2), F.length("d") - 2)).alias("g"), _kind(F.col("a")).alias("s_kind"), _value(F.col("a")).alias("s"), _value(F.col("b")).alias("p"), _kind(c).alias("o_kind"), _value(c).alias("o"),
        F.when(literal, F.when(lang != "", LANG_STRING).when(dt == "", STRING).otherwise(dt)).otherwise("").alias("o_dt"), F.when(literal, lang).otherwise("").alias("o_lang"), F.lit(src).alias("src"),
    )


def read(spark, path: str) -> DataFrame:
    """A file or folder of lines."""
    return parse_lines(spark.read.text(path), src=path)


def _written(kind: Column, value: Column, dt: Column, lang: Column) -> Column:
    quoted = F.concat(F.lit('"'), _escape(value), F.lit('"'))
    return F.when(kind == IRI, F.concat(F.lit("<"), value, F.lit(">"))).when(kind == BNODE, F.concat(F.lit("_:"), value)).when(lang != "", F.concat(quoted, F.lit("@"), lang)).when(dt.isin("", STRING), quoted).otherwise(F.concat(quoted, F.lit("^^<"), dt, F.lit(">")))


def _triple(graph: Column | None = None) -> Column:
    none = F.lit("")
    return F.concat(_written(F.col("s_kind"), F.col("s"), none, none), F.lit(" <"), F.col("p"), F.lit("> "), _written(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")), graph if graph is not None else none, F.lit(" ."))


def to_lines(quads: DataFrame) -> DataFrame:
    """value: one N-Quads line (N-Triples for the default graph) per quad."""
    graph = F.when(F.col("g") != "", F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("") if "g" in quads.columns else F.lit("")
    return quads.select(_triple(graph).alias("value"))


def results_csv(df: DataFrame) -> DataFrame:
    """value: one CSV row per solution (lexical values; unbound is empty)."""
    cell = lambda c: F.when(F.coalesce(c["value"], F.lit("")).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c["value"], F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.when(c["kind"] == BNODE, F.concat(F.lit("_:"), c["value"])).otherwise(c["value"]), F.lit("")))
    return df.select(F.concat_ws(",", *[cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def results_tsv(df: DataFrame) -> DataFrame:
    """value: one TSV row per solution (terms as written in N-Triples)."""
    cell = lambda c: F.coalesce(_written(c["kind"], c["value"], c["dt"], c["lang"]), F.lit(""))
    return df.select(F.concat_ws("\t", *[cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def results_json(df: DataFrame) -> DataFrame:
    """value: one JSON binding object per solution; unbound variables are left out."""

    def cell(c: Column) -> Column:
        kind = F.when(c["kind"] == IRI, "uri").when(c["kind"] == BNODE, "bnode").when(c["kind"] == LITERAL, "literal")
        return F.when(c.isNotNull(), F.struct(kind.alias("type"), c["value"].alias("value"), F.when((c["dt"] != "") & ~c["dt"].isin(STRING, LANG_STRING), c["dt"]).alias("datatype"), F.when(c["lang"] != "", c["lang"]).alias("xml:lang")))

    return df.select(F.to_json(F.struct(*[cell(F.col(f"`{c}`")).alias(c) for c in df.columns])).alias("value"))


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def results_xml(df: DataFrame) -> DataFrame:
    """value: one <result> per solution; unbound variables are left out. See xml_frame() for what stands around."""

    def cell(name: str) -> Column:
        c = F.col(f"`{name}`")
        more = F.when(c["lang"] != "", F.concat(F.lit(' xml:lang="'), _xml(c["lang"]), F.lit('"'))).when(c["dt"].isin("", STRING), "").otherwise(F.concat(F.lit(' datatype="'), _xml(c["dt"]), F.lit('"')))
        inner = F.when(c["kind"] == IRI, F.concat(F.lit("<uri>"), _xml(c["value"]), F.lit("</uri>"))).when(c["kind"] == BNODE, F.concat(F.lit("<bnode>"), _xml(c["value"]), F.lit("</bnode>"))).otherwise(F.concat(F.lit("<literal"), more, F.lit(">"), _xml(c["value"]), F.lit("</literal>")))
        return F.when(c.isNotNull(), F.concat(F.lit(f'<binding name="{name}">'), inner, F.lit("</binding>"))).otherwise("")

    return df.select(F.concat(F.lit("<result>"), *[cell(c) for c in df.columns], F.lit("</result>")).alias("value"))


def xml_frame(columns: list[str]) -> tuple[str, str]:
    """What stands before and behind the results."""
    head = "".join(f'<variable name="{c}"/>' for c in columns)
    return f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{head}</head><results>\n', "</results></sparql>\n"


def to_turtle(quads: DataFrame) -> DataFrame:
    """value: one Turtle statement per triple, graphs left out."""
    return to_lines(quads.drop("g"))


def to_trig(quads: DataFrame) -> DataFrame:
    """value: one TriG block per quad."""
    return quads.select(F.when(F.col("g") == "", _triple()).otherwise(F.concat(F.lit("<"), F.col("g"), F.lit("> { "), _triple(), F.lit(" }"))).alias("value"))


def to_jsonld(quads: DataFrame) -> DataFrame:
    """value: one node object of expanded JSON-LD per triple, graphs left out; an array of them is a document."""
    text = lambda c: F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    name = lambda kind, value: text(F.when(kind == BNODE, F.concat(F.lit("_:"), value)).otherwise(value))
    more = F.when(F.col("o_lang") != "", F.concat(F.lit(',"@language":'), text(F.col("o_lang")))).when(F.col("o_dt").isin("", STRING), "").otherwise(F.concat(F.lit(',"@type":'), text(F.col("o_dt"))))
    made = F.when(F.col("o_kind") == LITERAL, F.concat(F.lit('{"@value":'), text(F.col("o")), more, F.lit("}"))).otherwise(F.concat(F.lit('{"@id":'), name(F.col("o_kind"), F.col("o")), F.lit("}")))
    return quads.select(F.concat(F.lit('{"@id":'), name(F.col("s_kind"), F.col("s")), F.lit(","), text(F.col("p")), F.lit(":["), made, F.lit("]}")).alias("value"))


__all__ = ["parse_lines", "read", "results_csv", "results_json", "results_tsv", "results_xml", "to_jsonld", "to_lines", "to_trig", "to_turtle", "xml_frame"]
