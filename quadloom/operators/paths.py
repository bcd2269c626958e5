"""Property paths as (s, o) tables of terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.model import term
from quadloom.plans.algebra import Path
from quadloom.storage import cut


def _edges(quads: DataFrame) -> DataFrame:
    return quads.select(term(F.col("s_kind"), F.col("s")).alias("s"), term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")).alias("o"))


def _back(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))


def _step(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumnRenamed("o", "m").join(right.select(F.col("s").alias("m"), F.col("o")), "m").select("s", "o")


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Pairs joined by one or more edges, each once; only from the terms s of start, if given.

    Semi-naive: each round extends only the pairs found in the round before. Rounds are cut by a
    reliable checkpoint, so the plan stays short and survives lost executors.
    """
    edges = edges.distinct()
    first = edges.join(start.select("s").distinct(), "s", "left_semi") if start is not None else edges
    reached = frontier = cut(first.select("s", "o"))
    while not frontier.isEmpty():
        frontier = cut(_step(frontier, edges).distinct().join(reached, ["s", "o"], "left_anti").select("s", "o"))
        reached = reached.unionByName(frontier)
    return reached


def pairs(quads: DataFrame, path: Path, start: DataFrame | None = None) -> DataFrame:
    """Bag of (s, o) of a path; ?, + and * give each pair once. start bounds the closures (terms s)."""
    if path.kind == "link":
        return _edges(quads.filter(F.col("p") == path.iri))
    if path.kind == "inverse":
        return _back(pairs(quads, path.parts[0]))
    if path.kind == "alt":
        return reduce(DataFrame.unionByName, [pairs(quads, p, start) for p in path.parts])
    if path.kind == "seq":
        first, *rest = path.parts
        return reduce(_step, [pairs(quads, p) for p in rest], pairs(quads, first, start))
    if path.kind == "not":
        ahead, back = [p.iri for p in path.parts if p.kind == "link"], [p.parts[0].iri for p in path.parts if p.kind == "inverse"]
        parts = []
        if ahead or not back:
            parts.append(_edges(quads.filter(~F.col("p").isin(*ahead))))
        if back:
            parts.append(_back(_edges(quads.filter(~F.col("p").isin(*back)))))
        return reduce(DataFrame.unionByName, parts)
    inner = pairs(quads, path.parts[0])
    if path.kind == "plus":
        return closure(inner, start)
    terms = _edges(quads).select(F.explode(F.array("s", "o")).alias("s")).distinct()
    if start is not None:
        terms = start.select("s").distinct()
    own = terms.select("s", F.col("s").alias("o"))
    more = inner if path.kind == "opt" else closure(inner, start)
    return own.unionByName(more).distinct()


__all__ = ["closure", "pairs"]
