"""Aggregates over term columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions.scalar import V, as_rank, number, of_integer, order_key, rank, value
from quadloom.model import literal


def _sum(x: V, distinct: bool, mean: bool = False) -> Column:
    """0 over nothing; unbound if any member is no number."""
    bad = F.max(number(x).isNull().cast("int")) == 1
    n = F.struct(number(x).alias("n"), x.term().alias("x"))
    total = F.aggregate(F.collect_set(n), F.lit(0.0), lambda a, s: a + s["n"]) if distinct else F.coalesce(F.sum(number(x)), F.lit(0.0))
    count = F.size(F.collect_set(n)) if distinct else F.count(number(x))
    by = F.coalesce(F.max(rank(x)), F.lit(1))
    if not mean:
        return F.when(F.coalesce(~bad, F.lit(True)), as_rank(total, by).term())
    return F.when(F.coalesce(~bad, F.lit(True)), as_rank(F.when(count == 0, 0.0).otherwise(F.try_divide(total, count)), F.when(count == 0, 1).otherwise(F.greatest(by, F.lit(2)))).term())


def _concat(x: V, distinct: bool, separator: str) -> Column:
    """In order of text, so that results are the same on every run; unbound members count as errors."""
    ordered = F.array_sort(F.collect_set(value(x)) if distinct else F.collect_list(value(x)))
    return F.when(F.coalesce(F.max(x.isNull().cast("int")), F.lit(0)) == 0, literal(F.array_join(ordered, separator)))


AGGREGATES: dict[str, Callable[..., Column]] = {
    "COUNT": lambda x, distinct, _: of_integer(F.count_distinct(x.term()) if distinct else F.count(x.term())).term(),
    "SUM": lambda x, distinct, _: _sum(x, distinct),
    "AVG": lambda x, distinct, _: _sum(x, distinct, True),
    "MIN": lambda x, *_: F.min_by(x.term(), F.when(x.isNotNull(), order_key(x))),
    "MAX": lambda x, *_: F.max_by(x.term(), F.when(x.isNotNull(), order_key(x))),
    "SAMPLE": lambda x, *_: F.min_by(x.term(), F.when(x.isNotNull(), order_key(x))),
    "GROUP_CONCAT": _concat,
}
