"""Request layer of document sources: delays, rate limits, retries, and who serves a request.

Nothing here opens a connection: a fetch function is given. Delay columns for simulations are
plain expressions.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

Fetch = Callable[[str, dict], object]


class CannotServe(Exception):
    pass


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


@dataclass
class Delay:
    """Adds average +- delta milliseconds, uniformly, once to each request.

    The lower end is cut at 0 while the range stays 2 * delta wide.
    """

    average: float = 40
    delta: float = 10
    random: Callable[[], float] = random.random
    sleep: Callable[[float], None] = time.sleep

    @property
    def minimum(self) -> float:
        return max(self.average - self.delta, 0)

    @property
    def range(self) -> float:
        return max(2 * self.delta, 0)

    def test(self, context: dict) -> float:
        """Cost of serving a request; raises if it is not to be delayed."""
        if context.get("delayed"):
            raise CannotServe("a request is delayed once only")
        if self.minimum == 0 and self.range == 0:
            raise CannotServe("there is no delay to add")
        return 0.0

    def run(self, url: str, context: dict, fetch: Fetch) -> object:
        ms = half_up(self.minimum + self.random() * self.range)
        if ms > 0:
            self.sleep(ms / 1000)
        return fetch(url, context | {"delayed": True})

    def column(self, u: Column) -> Column:
        """Milliseconds for uniform numbers u in [0, 1)."""
        return F.floor(F.lit(float(self.minimum)) + u * float(self.range) + 0.5).cast("bigint")


@dataclass
class RateLimit:
    """Spaces the requests to one host by its slowest answers so far, after a first failure or from the start."""

    by_default: bool = True
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    hosts: dict[str, list[float]] = field(default_factory=dict)

    def run(self, url: str, context: dict, fetch: Fetch) -> object:
        host = urlsplit(url).netloc
        state = self.hosts.setdefault(host, [0.0, 0.0, float(self.by_default)])
        if state[2] and (wait := state[0] + state[1] - self.clock()) > 0:
            self.sleep(wait)
        began = state[0] = self.clock()
        try:
            return fetch(url, context)
        except Exception:
            state[2] = 1.0
            raise
        finally:
            state[1] = (state[1] + self.clock() - began) / 2 if state[1] else self.clock() - began


def retry(fetch: Fetch, times: int = 3, pause: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    def run(url: str, context: dict) -> object:
        for attempt in range(times + 1):
            try:
                return fetch(url, context)
            except Exception:
                if attempt == times:
                    raise
                sleep(pause)
        raise AssertionError

    return run


def mediate(actors: dict[str, Callable[[dict], float]], context: dict) -> str:
    """Name of the actor with the least time among those that can serve; failures are passed over."""
    found: dict[str, float] = {}
    for name, test in actors.items():
        try:
            found[name] = test(context)
        except CannotServe:
            continue
    if not found:
        raise CannotServe("no actor can serve this request")
    return min(found, key=lambda n: found[n])
