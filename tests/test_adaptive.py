"""Gate, decisions, restarts and replay suppression of the adaptive join."""

import math
import os

import pytest

from quadloom.operators import adaptive
from quadloom.operators.adaptive import RestartConfig, decide, expected_output, gate


def test_gate_order_and_messages():
    ok = RestartConfig(threshold=0.5, limit=1)
    assert gate(ok, ["a"]) is None
    assert gate(ok, ["a"], skip_adaptive=True) == "cannot run due to adaptive join being disabled"
    assert gate(ok, ["a"], ["b"]) == "can only wrap the topmost join"
    every = RestartConfig(limit=1, wrap_all_joins=True)
    assert gate(every, ["a"], ["b"]) is None and gate(every, ["a", "c"], ["b", "c"]) == "can only wrap a single set of join entries once"
    assert gate(RestartConfig(on_metadata_update=False), ["a"]) == "has no evaluation conditions enabled"
    assert gate(RestartConfig(on_metadata_update=False, interval=10), ["a"]) is None
    assert gate(RestartConfig(limit=0), ["a"]) == gate(RestartConfig(threshold=0), ["a"]) == "cannot restart even once"


@pytest.mark.parametrize(
    ("sizes", "selectivity", "threshold", "expected", "produced", "action"),
    [([1, 10], 0.5, 0.5, 6, 2, "swap"), ([1, 10], 0.5, 0.5, 6, 3, "skip"), ([1, 10], 0.5, 0.2, 6, 1, "swap"), ([1, 10], 0.5, 0.2, 6, 2, "skip"), ([20, 10], 1.0, 0.2, 30, 0, "swap"), ([20, 10], 1.0, 0.2, 30, 6, "skip"), ([], 1.0, 0.2, 0, 0, "skip")],
)
def test_decisions(sizes, selectivity, threshold, expected, produced, action):
    assert expected_output(sizes, selectivity) == expected
    assert decide(produced, expected, 0, RestartConfig(threshold=threshold)) == action


def test_no_selectivity_never_restarts_and_limits_stop():
    assert math.isnan(expected_output([1, 10], None)) and decide(0, math.nan, 0, RestartConfig()) == "skip"
    assert decide(0, 30, 2, RestartConfig(limit=2)) == "none" and decide(0, 30, 1, RestartConfig(limit=2)) == "swap"


def _rounds(spark):
    left = spark.createDataFrame([(i % 7, i) for i in range(40)], "k int, a int")
    right = spark.createDataFrame([(i % 7, i % 3) for i in range(30)], "k int, b int")
    new = lambda r: [left.filter(f"a >= {10 * r - 10} and a < {10 * r}"), right.filter(f"b = {r - 1}") if r < 4 else None]
    return [(new(r), [float(10 * r if r < 3 else 5), float(8 - r)]) for r in (1, 2, 3, 4)], left.join(right, "k").select("k", "a", "b")


def _plan(ops, order):
    return ops[order[0]].join(ops[order[1]], "k").select("k", "a", "b")


@pytest.mark.parametrize("threshold", [1e-9, 0.2, 0.5, 1e9])
@pytest.mark.parametrize("latch", [False, True])
def test_result_is_the_plain_join(spark, threshold, latch):
    rounds, want = _rounds(spark)
    with adaptive.AdaptiveJoin(_plan, lambda n: sorted(range(2), key=lambda i: n[i]), 0.5, RestartConfig(threshold=threshold, latch=latch)) as join:
        assert sorted(map(tuple, join.run(rounds).collect())) == sorted(map(tuple, want.collect()))
        actions = [t["action"] for t in join.trace]
        assert actions[0] == "start" and ("swap" in actions) == (threshold == 1e9) and len(actions) == 4
        written = [p.removeprefix("file:") for p in join.paths]
        assert written and all(map(os.path.exists, written))
    assert not any(map(os.path.exists, written)) and not join.paths


def test_an_interval_acts_only_when_it_is_over(spark):
    rounds, want = _rounds(spark)
    now = [0.0]
    join = adaptive.AdaptiveJoin(_plan, lambda n: sorted(range(2), key=lambda i: n[i]), 0.5, RestartConfig(on_metadata_update=False, interval=10, threshold=1e9), lambda: now[0])
    for at, round in zip((0, 5, 11, 12), rounds, strict=True):
        now[0] = at
        join.round(*round)
    assert [t["action"] for t in join.trace] == ["start", "keep", "swap", "keep"]
    assert sorted(map(tuple, join.emitted.collect())) == sorted(map(tuple, want.collect()))


def test_suppression_is_by_multiplicity_and_nulls_are_equal(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x"), (None, None)], "a int, b string")
    done = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    assert sorted(map(tuple, adaptive.suppress(rows, done).collect()), key=str) == [(1, None), (2, "x")]
    assert adaptive.suppress(rows, None).count() == 4


def test_not_applicable(spark):
    with pytest.raises(adaptive.NotApplicable, match="no evaluation"):
        adaptive.AdaptiveJoin(None, None, 1.0, RestartConfig(on_metadata_update=False))
