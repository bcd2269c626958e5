"""Order of join operands: by cardinality, by selectivity, or with zero knowledge."""

from __future__ import annotations

from quadloom.operators.cardinality import Statistics, estimate_operation, selectivity, variables
from quadloom.plans import algebra as A


def estimates(ops: list[A.Op], stats: list[Statistics]) -> list[float]:
    """Infinity where nothing is known."""
    found = [estimate_operation(op, stats) for op in ops]
    return [f.value if f else float("inf") for f in found]


def by_cardinality(ops: list[A.Op], sizes: list[float]) -> list[int]:
    """Ascending; ties keep the order as written."""
    return sorted(range(len(ops)), key=lambda i: sizes[i])


def smallest_connected(ops: list[A.Op], sizes: list[float]) -> list[int]:
    """Smallest first, then the smallest that shares a variable with those taken (any, if none does)."""
    left, out, seen = by_cardinality(ops, sizes), [], set()
    while left:
        pick = next((i for i in left if not out or seen & set(variables(ops[i]))), left[0])
        left.remove(pick)
        out.append(pick)
        seen |= set(variables(ops[pick]))
    return out


def by_selectivity(ops: list[A.Op], sizes: list[float], stats: Statistics) -> list[int]:
    """Greedy: the operand that keeps the intermediate result smallest comes next."""
    left = by_cardinality(ops, sizes)
    out = [left.pop(0)] if left else []
    size = sizes[out[0]] if out else 0.0
    while left:
        grown = {}
        for i in left:
            factor = 1.0
            for j in out:
                factor = min(factor, selectivity(ops[i], ops[j], stats))
            grown[i] = size * sizes[i] * factor
        pick = min(left, key=lambda i: (not set(variables(ops[i])) & {v for j in out for v in variables(ops[j])}, grown[i]))
        size = grown[pick]
        left.remove(pick)
        out.append(pick)
    return out


def zero_knowledge(ops: list[A.Op], seeds: tuple[str, ...] = ()) -> list[int]:
    """Without statistics: patterns with seed documents first, then connected ones, more constants first, vocabulary terms last."""

    def weight(i: int) -> tuple:
        found = A.patterns(ops[i])
        nodes = [n for x in found for n in (x.s, x.o)]
        seeded = any(isinstance(n, A.Term) and (n.value in seeds or (not seeds and n.kind == A.IRI)) for n in nodes)
        constants = sum(isinstance(n, A.Term) for n in nodes)
        return (not seeded, -constants, i)

    left, out, seen = sorted(range(len(ops)), key=weight), [], set()
    while left:
        pick = next((i for i in left if not out or seen & set(variables(ops[i]))), left[0])
        left.remove(pick)
        out.append(pick)
        seen |= set(variables(ops[pick]))
    return out
