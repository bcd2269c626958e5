"""Adaptive n-ary inner join: re-plans when operand cardinalities change the best order.

Operands arrive in rounds (a traversal depth, a batch of files). After each round the operand
order is looked at again; if it changed and little enough has been produced, the join goes on in
the new order. A round joins only what is new: the new rows of each operand with what the
operands before it hold by now and those behind it held before. Every pair of rows meets exactly
once, whatever the order in any round, so a restart neither loses nor repeats a row and nothing
that was produced is computed or compared again. (Sources that do replay are left to
``suppress`` and, for streams, to ``streaming.incremental``.)
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quadloom.storage import remove, written


@dataclass(frozen=True)
class RestartConfig:
    on_metadata_update: bool = True
    interval: float | None = None
    limit: float | None = None
    threshold: float = 0.2
    wrap_all_joins: bool = False
    #: After a restart that was judged too late, look at no further order until the next restart.
    latch: bool = False

    @property
    def most(self) -> float:
        return math.inf if self.limit is None else self.limit


class NotApplicable(ValueError):
    pass


def gate(config: RestartConfig, operations: Sequence[object], wrapped: Sequence[object] | None = None, skip_adaptive: bool = False) -> str | None:
    """None if the adaptive join may run, else why not. Checks run in this order.

    Fixed values: the order and the wording of the reasons are those that callers test for.
    """
    if skip_adaptive:
        return "cannot run due to adaptive join being disabled"
    if wrapped:
        if not config.wrap_all_joins:
            return "can only wrap the topmost join"
        if any(op in wrapped for op in operations):
            return "can only wrap a single set of join entries once"
    if not config.on_metadata_update and not config.interval:
        return "has no evaluation conditions enabled"
    if config.most < 1 or config.threshold <= 0:
        return "cannot restart even once"
    return None


def expected_output(cardinalities: Sequence[float], selectivity: float | None) -> float:
    """ceil(sum * selectivity) in doubles; NaN without a selectivity, 0 while nothing is known."""
    if not cardinalities:
        return 0.0
    n = sum(cardinalities) * (math.nan if selectivity is None else selectivity)
    return n if math.isnan(n) or math.isinf(n) else float(math.ceil(n))


def cutoff(expected: float, threshold: float) -> float:
    n = threshold * expected
    return n if math.isnan(n) or math.isinf(n) else float(math.ceil(n))


def decide(produced: int, expected: float, restarts: int, config: RestartConfig) -> str:
    """swap, skip, or none where the limit is reached."""
    if restarts >= config.most:
        return "none"
    return "swap" if produced < cutoff(expected, config.threshold) else "skip"


def suppress(new: DataFrame, emitted: DataFrame | None) -> DataFrame:
    """Rows of new that have not been emitted yet, by multiplicity; unbound equals unbound."""
    return new if emitted is None else new.exceptAll(emitted)


def _union(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return b if a is None else a if b is None else a.unionByName(b)


@dataclass
class AdaptiveJoin:
    """Feeds operands round by round; plan(operands, order) builds the join in an order.

    As a context manager it deletes what it has written at the end; the result must be used by then.
    """

    plan: Callable[[list[DataFrame], list[int]], DataFrame]
    order: Callable[[list[float]], list[int]]
    selectivity: float | None
    config: RestartConfig = field(default_factory=RestartConfig)
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self) -> None:
        if why := gate(self.config, []):
            raise NotApplicable(why)
        self.trace: list[dict] = []
        self.restarts, self.pending, self.looked = 0, False, self.clock()
        self.current: list[int] | None = None
        self.running: list[int] | None = None
        self.arrived: list[DataFrame | None] = []
        #: Results: written and counted so far, and not evaluated yet.
        self.done: DataFrame | None = None
        self.later: DataFrame | None = None
        self.counted = 0
        self.paths: list[str] = []

    def __enter__(self) -> AdaptiveJoin:
        return self

    def __exit__(self, *_) -> None:
        if self.paths:
            remove(self.done.sparkSession, self.paths)

    @property
    def produced(self) -> int:
        """Rows produced so far. Only a decision asks, so results without one stay lazy."""
        if self.later is not None:
            now = written(self.later, "adaptive", self.paths)
            self.counted += now.count()
            self.done, self.later = _union(self.done, now), None
        return self.counted

    @property
    def emitted(self) -> DataFrame | None:
        return _union(self.done, self.later)

    def _due(self) -> bool:
        """Whether a better order is acted on now: after any update, or once the interval is over."""
        if self.config.on_metadata_update:
            return True
        if self.clock() - self.looked < self.config.interval:
            return False
        self.looked = self.clock()
        return True

    def round(self, new: list[DataFrame | None], cardinalities: list[float]) -> DataFrame | None:
        """Result rows that the new rows of the operands (None: there are none) give, now that the operands have these cardinalities."""
        best, action, seen = self.order(cardinalities), "keep", None
        expected = expected_output(cardinalities, self.selectivity)
        if self.running is None:
            self.running = self.current = best
            self.arrived = [None] * len(new)
            action = "start"
        else:
            if not (self.config.latch and self.pending) and best != self.current:
                self.current, self.pending = best, True
            if self.pending and self._due():
                # What is counted already may settle it; only else the rows since then are evaluated.
                settled = self.restarts >= self.config.most or not self.counted < cutoff(expected, self.config.threshold)
                seen = self.counted if settled else self.produced
                action = decide(seen, expected, self.restarts, self.config)
                if action == "swap":
                    self.running, self.pending = self.current, False
                    self.restarts += 1
        out = None
        for i, rows in enumerate(new):
            operands = [*[_union(a, b) for a, b in zip(self.arrived[:i], new[:i], strict=True)], rows, *self.arrived[i + 1 :]]
            if not any(x is None for x in operands):
                out = _union(out, self.plan(operands, self.running))
        self.arrived = [_union(a, b) for a, b in zip(self.arrived, new, strict=True)]
        self.later = _union(self.later, out)
        self.trace.append({"round": len(self.trace), "expected": expected, "produced": seen, "cutoff": cutoff(expected, self.config.threshold), "action": action, "order": ",".join(map(str, self.running))})
        return out

    def run(self, rounds: Iterable[tuple[list[DataFrame | None], list[float]]]) -> DataFrame | None:
        """All rows of all rounds; None if an operand never had any."""
        for new, cardinalities in rounds:
            self.round(new, cardinalities)
        return self.emitted
