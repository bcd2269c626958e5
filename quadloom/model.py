"""Terms and quads as Spark columns.

A bound variable is a struct (kind, value, dt, lang) without nulls inside, so struct equality is
sameTerm and structs can be join keys; an unbound one is null. Quads are flat, so that constants
of a pattern reach the scan as plain predicates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BNODE, IRI, LITERAL = 1, 2, 3
QUADS = "g string, s_kind tinyint, s string, p string, o_kind tinyint, o string, o_dt string, o_lang string, src string"
TERM = "struct<kind: tinyint, value: string, dt: string, lang: string>"

# Public vocabularies.
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
MEM = "http://semweb.mmlab.be/ns/membership#"
VOID = "http://rdfs.org/ns/void#"
STRING, BOOLEAN, INTEGER, DECIMAL, FLOAT, DOUBLE, DATETIME, DURATION = (XSD + x for x in ("string", "boolean", "integer", "decimal", "float", "double", "dateTime", "dayTimeDuration"))
INTEGERS = [XSD + x for x in ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]


def _field(x: Column | str | int, kind: str) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(kind)


def term(kind: Column | int, value: Column | str, dt: Column | str = "", lang: Column | str = "") -> Column:
    """A term, or null where its value is null."""
    value = _field(value, "string")
    made = F.struct(_field(kind, "tinyint").alias("kind"), value.alias("value"), _field(dt, "string").alias("dt"), _field(lang, "string").alias("lang"))
    return F.when(value.isNotNull(), made)


def iri(value: Column | str) -> Column:
    return term(IRI, value)


def literal(value: Column | str, dt: Column | str = STRING, lang: Column | str = "") -> Column:
    return term(LITERAL, value, dt, lang)
