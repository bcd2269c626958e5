"""Joins of solution tables: compatibility of bindings, OPTIONAL, MINUS, EXISTS, UNION.

A solution table knows of each variable whether it may be unbound. Variables bound on both sides
are plain equi-join keys, for Catalyst to pick broadcast, shuffled hash or sort-merge. A variable
that may be unbound would need ``a = b OR a IS NULL OR b IS NULL``, which only a nested loop can
run; instead the join splits into disjoint branches by which side is bound, each an equi-join.
OPTIONAL, MINUS and EXISTS split likewise: the left rows by which variables they bind, and for each
part the right rows that can match it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.model import TERM

#: More maybe-unbound shared variables than this make too many branches (3 ** n).
MOST_SPLITS = 3


def key_column(variable: str) -> str:
    return f"#{variable}"


@dataclass
class Solutions:
    """df has one term column per variable (may_be_unbound says which can be null).

    native: variables that are never unbound and whose terms are IRIs of a kind (the value here) and
    an integer, which stands in key_column(variable). Two of one kind are equal if the integers are.
    """

    df: DataFrame
    variables: dict[str, bool]
    native: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.df = self.df.select(*[F.col(f"`{v}`") for v in self.variables], *[F.col(f"`{key_column(v)}`") for v in self.native])

    def plain(self) -> Solutions:
        """Without the integers."""
        return Solutions(self.df, self.variables)

    def with_df(self, df: DataFrame) -> Solutions:
        return replace(self, df=df)


def renamed(right: Solutions) -> tuple[DataFrame, dict[str, str]]:
    """Right side with every variable under a name of its own."""
    names = {v: f"r::{v}" for v in right.variables}
    return right.df.select(*[F.col(f"`{v}`").alias(n) for v, n in names.items()]), names


def shared(left: Solutions, right: Solutions) -> list[str]:
    return [v for v in left.variables if v in right.variables]


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def _column(v: str) -> Column:
    return F.col(f"`{v}`")


def merged(left: Solutions, right: Solutions, unbound_right: bool = False) -> dict[str, bool]:
    out = {v: maybe and not (v in right.variables and not right.variables[v] and not unbound_right) for v, maybe in left.variables.items()}
    return out | {v: maybe or unbound_right for v, maybe in right.variables.items() if v not in out}


def join(left: Solutions, right: Solutions) -> Solutions:
    """All compatible pairs, as a bag."""
    common = shared(left, right)
    loose = [v for v in common if left.variables[v] or right.variables[v]]
    firm = [v for v in common if v not in loose]
    if loose:
        left, right = left.plain(), right.plain()
    r, names = renamed(right)
    out = merged(left, right)
    numbered = [v for v in firm if v in left.native and left.native[v] == right.native.get(v)]
    if left.native or right.native:
        # Integers are joined in place of the IRIs they stand for, and go along for later joins.
        more = {v: f"r::{key_column(v)}" for v in right.native}
        r = right.df.select(*[_column(v).alias(n) for v, n in names.items()], *[_column(key_column(v)).alias(n) for v, n in more.items()])
        pairs = left.df.join(r, both([_column(key_column(v)) == _column(more[v]) if v in numbered else _column(v) == _column(names[v]) for v in firm]), "inner") if firm else left.df.crossJoin(r)
        native = right.native | left.native
        kept = [(_column(key_column(v)) if v in left.native else _column(more[v])).alias(key_column(v)) for v in native]
        return Solutions(pairs.select(*[(_column(v) if v in left.variables else _column(names[v])).alias(v) for v in out], *kept), out, native)

    def branch(ldf: DataFrame, rdf: DataFrame, keys: list[str]) -> DataFrame:
        on = both([_column(v) == _column(names[v]) for v in keys])
        pairs = ldf.join(rdf, on, "inner") if keys else ldf.crossJoin(rdf)
        return pairs.select(*[(F.coalesce(_column(v), _column(names[v])) if v in loose else _column(v) if v in left.variables else _column(names[v])).alias(v) for v in out])

    if not loose:
        return Solutions(branch(left.df, r, firm), out)
    if len(loose) > MOST_SPLITS:
        on = both([_column(v) == _column(names[v]) for v in firm] + [(_column(v) == _column(names[v])) | _column(v).isNull() | _column(names[v]).isNull() for v in loose])
        pairs = left.df.join(r, on, "inner")
        return Solutions(pairs.select(*[(F.coalesce(_column(v), _column(names[v])) if v in common else _column(v) if v in left.variables else _column(names[v])).alias(v) for v in out]), out)
    parts = []
    for mask in itertools.product("blr", repeat=len(loose)):
        # b: both bound; l: left unbound (right any); r: left bound, right unbound
        ldf, rdf = left.df, r
        for v, m in zip(loose, mask, strict=True):
            ldf = ldf.filter(_column(v).isNull() if m == "l" else _column(v).isNotNull())
            rdf = rdf if m == "l" else rdf.filter(_column(names[v]).isNotNull() if m == "b" else _column(names[v]).isNull())
        if any((m == "l" and not left.variables[v]) or (m == "r" and not right.variables[v]) for v, m in zip(loose, mask, strict=True)):
            continue
        parts.append(branch(ldf, rdf, firm + [v for v, m in zip(loose, mask, strict=True) if m == "b"]))
    return Solutions(reduce(DataFrame.unionByName, parts), out)


def compatible(left: Solutions, right: Solutions, names: dict[str, str]) -> list[Column]:
    """Conditions that two rows agree on the shared variables both bind."""
    out = []
    for v in shared(left, right):
        equal = _column(v) == _column(names[v])
        for side, maybe in ((v, left.variables[v]), (names[v], right.variables[v])):
            if maybe:
                equal = equal | _column(side).isNull()
        out.append(equal)
    return out


def _loose(left: Solutions, right: Solutions) -> list[str] | None:
    """Shared variables that a side may leave unbound; None where there are too many to split by."""
    found = [v for v in shared(left, right) if left.variables[v] or right.variables[v]]
    return found if len(found) <= MOST_SPLITS else None


def _parts(left: Solutions, right: Solutions, r: DataFrame, names: dict[str, str], loose: list[str]) -> Iterator[tuple[DataFrame, list[tuple[DataFrame, list[str]]]]]:
    """Disjoint parts of left by the loose variables they bind; for each the disjoint parts of r that can match, and the key variables."""
    firm = [v for v in shared(left, right) if v not in loose]
    for bound in itertools.product(*[(True, False) if left.variables[v] else (True,) for v in loose]):
        ldf, ways = left.df, []
        for v, b in zip(loose, bound, strict=True):
            if left.variables[v]:
                ldf = ldf.filter(_column(v).isNotNull() if b else _column(v).isNull())
        held = [v for v, b in zip(loose, bound, strict=True) if b]
        for equal in itertools.product(*[(True, False) if right.variables[v] else (True,) for v in held]):
            rdf = r
            for v, e in zip(held, equal, strict=True):
                if right.variables[v]:
                    rdf = rdf.filter(_column(names[v]).isNotNull() if e else _column(names[v]).isNull())
            ways.append((rdf, firm + [v for v, e in zip(held, equal, strict=True) if e]))
        yield ldf, ways


def _on(keys: list[str], names: dict[str, str], condition: Column | None) -> list[Column]:
    return [_column(v) == _column(names[v]) for v in keys] + ([condition] if condition is not None else [])


def optional(left: Solutions, right: Solutions, condition=None) -> Solutions:
    """Left join; condition(column of each variable) stands inside ON and sees both sides."""
    r, names = renamed(right)
    loose = _loose(left, right)
    sight = {v: _column(names[v]) for v in right.variables} | {v: F.coalesce(_column(v), _column(names[v])) if v in right.variables and left.variables[v] else _column(v) for v in left.variables}
    also = condition(sight) if condition is not None else None
    out = merged(left, right, unbound_right=True)
    picked = [(F.coalesce(_column(v), _column(names[v])) if v in left.variables and left.variables[v] and v in right.variables else _column(v) if v in left.variables else _column(names[v])).alias(v) for v in out]
    if loose is None:
        return Solutions(left.df.join(r, both(compatible(left, right, names) + ([also] if also is not None else [])), "left").select(*picked), out)
    parts = []
    for ldf, ways in _parts(left, right, r, names, loose):
        if len(ways) == 1:
            parts.append(ldf.join(ways[0][0], both(_on(ways[0][1], names, also)), "left").select(*picked))
            continue
        for rdf, keys in ways:
            parts.append(ldf.join(rdf, both(_on(keys, names, also)), "inner").select(*picked))
            ldf = ldf.join(rdf, both(_on(keys, names, also)), "left_anti")
        nothing = [F.lit(None).cast(TERM).alias(names[v]) for v in right.variables]
        parts.append(ldf.select("*", *nothing).select(*picked))
    return Solutions(reduce(DataFrame.unionByName, parts), out)


def minus(left: Solutions, right: Solutions) -> Solutions:
    """Removes rows compatible with a row on the right that shares a bound variable."""
    common = shared(left, right)
    if not common:
        return left
    some = Solutions(right.df, {v: right.variables[v] for v in common})
    r, names = renamed(some)
    r = r.distinct()
    loose = _loose(left, some)
    if loose is None:
        on = compatible(left, right, names)
        if all(left.variables[v] or right.variables[v] for v in common):
            on.append(reduce(lambda a, b: a | b, [_column(v).isNotNull() & _column(names[v]).isNotNull() for v in common]))
        return left.with_df(left.df.join(r, both(on), "left_anti"))
    parts = []
    for ldf, ways in _parts(left, some, r, names, loose):
        for rdf, keys in ways:
            if keys:  # without a variable that both bind nothing is removed
                ldf = ldf.join(rdf, both(_on(keys, names, None)), "left_anti")
        parts.append(ldf)
    return left.with_df(reduce(DataFrame.unionByName, parts))


def exists(left: Solutions, right: Solutions, negated: bool, condition=None) -> Solutions:
    """Semi or anti join on the shared variables; condition sees both sides."""
    r, names = renamed(right)
    also = condition({v: _column(names[v]) for v in right.variables} | {v: _column(v) for v in left.variables}) if condition is not None else None
    loose = _loose(left, right)
    if loose is None:
        on = compatible(left, right, names) + ([also] if also is not None else [])
        return left.with_df(left.df.join(r, both(on), "left_anti" if negated else "left_semi"))
    kept = []
    for ldf, ways in _parts(left, right, r, names, loose):
        for k, (rdf, keys) in enumerate(ways):
            on = _on(keys, names, also)
            # Without any condition one row decides.
            rdf = rdf if on else rdf.limit(1)
            if not negated:
                kept.append(ldf.join(rdf, both(on), "left_semi"))
            if negated or k + 1 < len(ways):
                ldf = ldf.join(rdf, both(on), "left_anti")
        if negated:
            kept.append(ldf)
    return left.with_df(reduce(DataFrame.unionByName, kept))


def union(parts: list[Solutions]) -> Solutions:
    """Bag union; variables missing in a part are unbound there."""
    names = list(dict.fromkeys(v for p in parts for v in p.variables))
    aligned = [p.df.select(*[_column(v) if v in p.variables else F.lit(None).cast(TERM).alias(v) for v in names]) for p in parts]
    return Solutions(reduce(DataFrame.unionByName, aligned), {v: any(p.variables.get(v, True) for p in parts) for v in names})


def reduce_by_keys(small: Solutions, large: Solutions) -> Solutions:
    """large without the rows that no row of small can match: a semi-join on the firmly shared variables."""
    keys = [v for v in shared(small, large) if not small.variables[v] and not large.variables[v]]
    if not keys:
        return large
    return large.with_df(large.df.join(small.df.select(*[_column(k) for k in keys]).distinct(), keys, "left_semi").select(*[_column(v) for v in large.variables]))
