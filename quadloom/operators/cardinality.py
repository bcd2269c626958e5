"""Cardinality estimates from dataset descriptions, and how they accumulate.

``describe`` computes VoID-like statistics of each dataset; estimates follow from them by uniform
distribution. ``accumulate`` merges the datasets met so far and re-estimates an operation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.model import RDF_TYPE
from quadloom.plans import algebra as A


def describe(quads: DataFrame, exact: bool = True) -> DataFrame:
    """dataset, p (null: the whole dataset), triples, distinct_s, distinct_o: one grouping-sets pass."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    o = F.struct("o_kind", "o", "o_dt", "o_lang")
    found = quads.groupingSets([[F.col("src"), F.col("p")], [F.col("src")]], F.col("src"), F.col("p")).agg(F.count("*").alias("triples"), distinct(F.struct("s_kind", "s")).alias("distinct_s"), distinct(o).alias("distinct_o"))
    return found.select(F.col("src").alias("dataset"), "p", "triples", "distinct_s", "distinct_o")


@dataclass
class Statistics:
    """Of one dataset: triples, distinct subjects and objects, as a whole and by predicate."""

    uri: str
    whole: tuple[float, float, float]
    by_predicate: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    by_class: dict[str, float] = field(default_factory=dict)
    source: str = ""

    @classmethod
    def collect(cls, described: DataFrame) -> dict[str, Statistics]:
        """Driver-side statistics: one row per dataset and predicate, which are few."""
        out: dict[str, Statistics] = {}
        rows = described.collect()
        for r in rows:
            if r["p"] is None:
                out[r["dataset"]] = cls(r["dataset"], (r["triples"], r["distinct_s"], r["distinct_o"]))
        for r in rows:
            if r["p"] is not None:
                out[r["dataset"]].by_predicate[r["p"]] = (r["triples"], r["distinct_s"], r["distinct_o"])
        return out

    def cardinality(self, op: A.Op) -> Estimate | None:
        n = self._estimate(op)
        return None if n is None else Estimate(n, "estimate", self.uri)

    def _estimate(self, op: A.Op) -> float | None:
        if isinstance(op, A.Pattern):
            return self.pattern(op)
        if isinstance(op, A.Join):
            return join_estimate([(p, self._estimate(p)) for p in op.parts], self)
        if isinstance(op, A.Union):
            parts = [self._estimate(p) for p in op.parts]
            return None if None in parts else sum(parts)
        return None

    def pattern(self, op: A.Pattern) -> float:
        s, p, o = (isinstance(x, A.Term) for x in (op.s, op.p, op.o))
        t, ns, no = self.whole
        if p:
            if op.p.value == RDF_TYPE and o and not s and op.o.value in self.by_class:
                return self.by_class[op.o.value]
            t, ns, no = self.by_predicate.get(op.p.value, (0.0, 1.0, 1.0)) if self.by_predicate else self.whole
        n = t / (max(ns, 1) if s else 1) / (max(no, 1) if o else 1)
        return min(1.0, n) if s and p and o else float(n)


@dataclass(frozen=True)
class Estimate:
    value: float
    type: str = "estimate"
    dataset: str | None = None


def selectivity(a: A.Op, b: A.Op, stats: Statistics) -> float:
    """Of the join of two patterns: product over shared variables of 1 / max(distinct, distinct)."""
    out = 1.0
    for v in set(variables(a)) & set(variables(b)):
        out /= max(_distinct(a, v, stats), _distinct(b, v, stats), 1.0)
    return min(max(out, 0.0), 1.0)


def variables(op: A.Op) -> list[str]:
    return list(dict.fromkeys(x.name for x in _nodes(op) if isinstance(x, A.Var)))


def _nodes(op: A.Op):
    for x in A.walk(op):
        if isinstance(x, A.Pattern | A.PathPattern):
            yield from (n for n in (x.s, getattr(x, "p", None), x.o) if n is not None)


def _distinct(op: A.Op, v: str, stats: Statistics) -> float:
    found = [1.0]
    for x in A.patterns(op):
        _, ns, no = stats.by_predicate.get(x.p.value, stats.whole) if isinstance(x.p, A.Term) else stats.whole
        found += [n for node, n in ((x.s, ns), (x.o, no), (x.p, len(stats.by_predicate))) if node == A.Var(v)]
    return max(found)


def join_estimate(parts: list[tuple[A.Op, float | None]], stats: Statistics) -> float | None:
    if any(n is None for _, n in parts):
        return None
    done, total = [], 1.0
    for op, n in parts:
        total *= n
        for other in done:
            total *= selectivity(op, other, stats)
        done.append(op)
    return total


def merge_datasets(known: list, new: list) -> list:
    """Union by uri: what comes later replaces, the order is that of first arrival."""
    return list(({d.uri: d for d in known} | {d.uri: d for d in new}).values())


def estimate_operation(op: A.Op, datasets: list, predicate_only: bool = False) -> Estimate | None:
    """Sum over the datasets. One dataset keeps its type and name; from two on it is a nameless estimate.

    predicate_only: a pattern counts as (?s p ?o), any other operation has no estimate.
    """
    if predicate_only:
        if not isinstance(op, A.Pattern):
            return None
        op = A.Pattern(A.Var("s"), op.p, A.Var("o"))
    out: Estimate | None = None
    for d in datasets:
        found = d.cardinality(op)
        if found is None:
            continue
        out = Estimate(found.value, found.type, d.uri) if out is None else Estimate(out.value + found.value, "estimate", None)
    return out


def accumulate(mode: str, known: dict, new: dict, op: A.Op | None = None, predicate_only: bool = False) -> dict:
    """Metadata after one more document: nothing on ``initialize``, merged datasets and estimate on ``append``."""
    if mode == "initialize":
        return {}
    datasets = merge_datasets(known.get("datasets") or [], new.get("datasets") or [])
    out: dict = {"datasets": datasets} if datasets else {}
    if op is not None and (found := estimate_operation(op, datasets, predicate_only)) is not None:
        out["cardinality"] = found
    return out
