"""Relational tables as quads: one IRI per row, one quad per non-key column.

Every (table, column) pair is a branch of its own with a literal predicate, so Catalyst drops all
branches but one below a pattern with a constant predicate and reads just its columns. Several
patterns on one row (a star) are one scan of their columns, without a join: see ``Tables``.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.model import DATETIME, DOUBLE, INTEGER, IRI, LITERAL, STRING
from quadloom.operators.joins import Solutions, key_column
from quadloom.plans.algebra import Term, Var

#: Key columns, and where foreign keys point.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "events": ["event_id"],
}
FOREIGN = {"n_regionkey": "region", "c_nationkey": "nation", "s_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}
DATATYPES = {"int": INTEGER, "bigint": INTEGER, "double": DOUBLE, "timestamp_ntz": DATETIME, "timestamp": DATETIME}


def row_iri(table: str, keys: list[Column]) -> Column:
    return F.concat(F.lit(f"urn:{table}:"), F.concat_ws("-", *[k.cast("string") for k in keys]))


def _cell(name: str, kind: str) -> Column:
    """Lexical value of a column as an object."""
    if linked := FOREIGN.get(name):
        return F.concat(F.lit(f"urn:{linked}:"), F.col(name).cast("string"))
    return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss") if kind.startswith("timestamp") else F.col(name).cast("string")


def _columns(table: str, df: DataFrame) -> dict[str, str]:
    """Columns that give quads, and their kinds."""
    return {name: kind for name, kind in df.dtypes if not ((name in KEYS[table] and name not in FOREIGN) or kind.startswith("array"))}


def table_quads(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    """Quads of the tables; a null cell gives none."""
    return Tables(spark, sf_dir, *tables).quads


class Tables:
    """Tables whose quads are known to be distinct, and whose stars need no join."""

    def __init__(self, spark: SparkSession, sf_dir: str, *tables: str) -> None:
        self.frames = {table: spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables}
        self.columns = {table: _columns(table, df) for table, df in self.frames.items()}
        self.places = {f"urn:p:{name}": (table, name) for table, columns in self.columns.items() for name in columns}

    @cached_property
    def quads(self) -> DataFrame:
        parts = []
        for table, df in self.frames.items():
            subject = row_iri(table, [F.col(k) for k in KEYS[table]])
            for name, kind in self.columns[table].items():
                linked = name in FOREIGN
                columns = {"g": F.lit(f"urn:g:{table}"), "s_kind": F.lit(IRI), "s": subject, "p": F.lit(f"urn:p:{name}"), "o_kind": F.lit(IRI if linked else LITERAL), "o": _cell(name, kind), "o_dt": F.lit("" if linked else DATATYPES.get(kind, STRING)), "o_lang": F.lit(""), "src": F.lit(table)}
                parts.append(df.filter(F.col(name).isNotNull()).select(*[(c.cast("tinyint") if k.endswith("kind") else c).alias(k) for k, c in columns.items()]))
        return reduce(DataFrame.unionByName, parts)

    def table_of(self, predicate: str) -> str | None:
        return self.places.get(predicate, (None,))[0]

    def star(self, table: str, subject: str, cells: list[tuple[str, Var | Term]]) -> Solutions:
        """Solutions of the rows that have all these cells: the subject and the object variables.

        Where an IRI is a prefix and one integer key, the integer stands beside it for joins.
        """
        df, keys = self.frames[table], KEYS[table]
        made, native = {subject: _struct(IRI, row_iri(table, [F.col(k) for k in keys]), "")}, {}
        if len(keys) == 1:
            native[subject] = (table, F.col(keys[0]).cast("bigint"))
        for predicate, node in cells:
            name = self.places[predicate][1]
            kind = self.columns[table][name]
            datatype = "" if name in FOREIGN else DATATYPES.get(kind, STRING)
            df = df.filter(F.col(name).isNotNull())
            if isinstance(node, Var):
                made[node.name] = _struct(LITERAL if datatype else IRI, _cell(name, kind), datatype)
                if name in FOREIGN:
                    native[node.name] = (FOREIGN[name], F.col(name).cast("bigint"))
            else:
                same = (node.kind, node.dt, node.lang) == ((LITERAL, datatype, "") if datatype else (IRI, "", ""))
                df = df.filter(_cell(name, kind) == node.value) if same else df.filter(F.lit(False))
        df = df.select(*[c.alias(v) for v, c in made.items()], *[c.alias(key_column(v)) for v, (_, c) in native.items()])
        return Solutions(df, dict.fromkeys(made, False), {v: prefix for v, (prefix, _) in native.items()})


def _struct(kind: int, value: Column, datatype: str) -> Column:
    return F.struct(F.lit(kind).cast("tinyint").alias("kind"), value.alias("value"), F.lit(datatype).alias("dt"), F.lit("").alias("lang"))
