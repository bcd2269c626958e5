"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregation (pre-aggregated before the shuffle, so a vertex with very many
neighbours stays cheap) and one join back; rounds grow with the logarithm of the longest path.
Edges never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import spool


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each vertex, written before it is joined back: below an aggregate Spark couldn't split a vertex with very many neighbours."""
    return spool(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns u, v: every vertex u that is not the smallest of its component, and the smallest, v.

    Loops and repeated edges do no harm; edges with a null end are left out. No edges, no rows.
    """
    now = spool(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = spool(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = _least(large)
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = spool(small, "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
