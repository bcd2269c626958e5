"""Updates: each gives a new table of quads; nothing changes in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans import algebra as A
from quadloom.plans.planner import Context, Planner, instantiate
from quadloom.storage import cut

KEY = ["g", "s_kind", "s", "p", "o_kind", "o", "o_dt", "o_lang"]


class UpdateProblem(ValueError):
    pass


def _in(quads: DataFrame, graph: str | None):
    if graph == "ALL":
        return F.lit(True)
    return F.col("g") != "" if graph == "NAMED" else F.col("g") == graph


def _named(df: DataFrame, graph: str) -> DataFrame:
    return df.withColumn("g", F.lit(graph))


def add(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of quads."""
    src = new if "src" in new.columns else new.withColumn("src", F.lit(""))
    return quads.unionByName(src.select(*quads.columns)).dropDuplicates(KEY)


def remove(quads: DataFrame, gone: DataFrame) -> DataFrame:
    return quads.join(gone.select(*KEY).distinct(), KEY, "left_anti").select(*quads.columns)


def apply(quads: DataFrame, update: A.Update, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The quads after one update. load(url) reads a document as quads."""
    spark = quads.sparkSession
    planner = Planner(Context(spark, quads))
    if update.kind in ("insert", "delete"):
        data = instantiate(planner.unit(), getattr(update, update.kind), A.named(""))
        return add(quads, data) if update.kind == "insert" else remove(quads, data)
    if update.kind == "modify":
        found = planner.run(update.where)
        # Both templates read the quads as they were.
        found = found.with_df(cut(found.df)) if found.variables else found
        out = remove(quads, instantiate(found, update.delete, A.named(""))) if update.delete else quads
        return add(out, instantiate(found, update.insert, A.named(""))) if update.insert else out
    if update.kind == "load":
        try:
            if load is None:
                raise UpdateProblem(f"no loader for {update.source}")
            return add(quads, _named(load(update.source), update.target or ""))
        except Exception:
            if update.silent:
                return quads
            raise
    if update.kind in ("clear", "drop"):
        return quads.filter(~_in(quads, update.target))
    if update.kind == "create":
        return quads
    if update.source == update.target:
        return quads
    moved = _named(quads.filter(_in(quads, update.source)), update.target or "")
    if update.kind == "add":
        return add(quads, moved)
    rest = quads.filter(~_in(quads, update.target))
    if update.kind == "move":
        rest = rest.filter(~_in(quads, update.source))
    return add(rest, moved)
