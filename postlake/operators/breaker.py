"""Health of sources: the states of each one's circuit breaker at and after every attempt, over many tasks a source.

Attempts, in order of source and time, are dealt by range, so that a source with very many spans tasks. What a stretch of attempts
makes of a breaker is a function of the state that it is in before: a few states if closed, and if open a step function of
the end of its rest. Each task sends the functions of its first and last source; composed in order, they give
the state in which each task begins, and a second pass walks the attempts from there.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.plans.stages import staged

HEALTH = "source string, event_id long, ok boolean, tried_in string, state string, failures int"
#: Attempts of a task, about.
STRETCH = 200_000

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"
State = tuple[str, int, float]
START: State = (CLOSED, 0, 0.0)


def step(state: str, failures: int, until: float, ok: bool, now: float, threshold: int, recovery: float) -> tuple[str, str, int, float]:
    """One attempt at a source: the state in which it was made, then state, failures and end of the rest after it.

    While an open breaker rests, attempts are refused and change nothing. The first one after the rest is made half
    open; success closes the breaker, and failure, half open or at the threshold, opens it.
    """
    if state == OPEN:
        if now < until:
            return state, state, failures, until
        state = HALF_OPEN
    if ok:
        return state, CLOSED, 0, 0.0
    failures += 1
    if state == HALF_OPEN or failures >= threshold:
        return state, OPEN, failures, now + recovery
    return state, state, failures, until


class Stretch:
    """What attempts (times and outcomes, in order) make of a breaker.

    ``closed[f]``: the state after them if it was closed with f failures. ``opened``: (time, state, failures, more, until): an open one whose
    rest ends at that time or before, and after the time of the entry before, ends up in that state, with ``failures`` and, if ``more``, those it had.
    """

    def __init__(self, times: list[float], oks: list[bool], threshold: int, recovery: float):
        n = len(times)
        # from the last attempt back: ends if one is made closed with f failures, or half open; these are relative to the failures so far
        closed: list[list[tuple]] = [[(CLOSED, f, False, 0.0) for f in range(threshold)]]
        half: list[tuple] = [()] * n

        def rested(i: int, failures: int, more: bool) -> tuple:
            """The end for a breaker that attempt i opened."""
            j = bisect_left(times, times[i] + recovery, i + 1)
            if j == n:
                return OPEN, failures, more, times[i] + recovery
            state, f, own, until = half[j]
            return (state, f + failures, more, until) if own else (state, f, False, until)

        for i in range(n - 1, -1, -1):
            after = closed[-1]
            half[i] = after[0] if oks[i] else rested(i, 1, True)
            closed.append([after[0] if oks[i] else rested(i, f + 1, False) if f + 1 >= threshold else after[f + 1] for f in range(threshold)])
        self.closed = [(s, f, until) for s, f, _, until in closed[-1]]
        # an open breaker's rest ends at the latest a rest after the first attempt
        last = bisect_left(times, times[0] + recovery) if n else 0
        self.opened: list[tuple] = []
        for i in range(min(n, last + 1)):
            if self.opened and self.opened[-1][1:] == half[i]:
                self.opened[-1] = (times[i], *half[i])
            else:
                self.opened.append((times[i], *half[i]))

    @staticmethod
    def after(state: State, closed: list, opened: list) -> State:
        """The state after a stretch, from its functions."""
        name, failures, until = state
        if name != OPEN:
            return tuple(closed[failures])
        for at, then, more_failures, more, rest in opened:
            if until <= at:
                return then, more_failures + failures * more, rest
        return state


_ENDS = "part int, source string, first boolean, closed array<struct<state:string,failures:int,until:double>>, opened array<struct<at:double,state:string,failures:int,more:boolean,until:double>>"


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(part, source, times, oks, whether the part begins with it, whether it ends with it) for each source of each part, in order."""
    part, source, times, oks, first = None, None, [], [], True
    for batch in batches:
        for p, s, t, ok in zip(batch["part"], batch["source"], batch["t"], batch["ok"], strict=True):
            if p != part or s != source:
                if times:
                    yield part, source, times, oks, first, p != part
                first = p != part
                part, source, times, oks = p, s, [], []
            times.append(t)
            oks.append(bool(ok))
    if times:
        yield part, source, times, oks, first, True


def source_health(events: DataFrame, threshold: int = 3, recovery: float = 300.0, stretch: int = STRETCH) -> DataFrame:
    """The breaker's states at and after each attempt (source, event_id, ts, ok), in order of time and id.

    Attempts without a source or a time are left out; an unknown outcome is a failure. A task has about ``stretch`` attempts,
    whatever their source. What comes to the driver are the functions of two sources a task at most.
    """
    timed = events.where("source is not null and ts is not null").select("source", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.coalesce("ok", F.lit(False)).alias("ok"))
    parts = max(1, -(-timed.count() // stretch))
    order = ["source", "t", "event_id", "ok"]
    dealt = staged(timed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "attempts")

    def in_order() -> DataFrame:
        return dealt.repartition(parts, "part").sortWithinPartitions("part", *order)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, source, times, oks, first, last in _segments(batches):
            if first or last:
                f = Stretch(times, oks, threshold, recovery)
                yield pd.DataFrame([(part, source, first, [dict(zip(("state", "failures", "until"), x, strict=True)) for x in f.closed], [dict(zip(("at", "state", "failures", "more", "until"), x, strict=True)) for x in f.opened])], columns=["part", "source", "first", "closed", "opened"])

    entry: dict[int, tuple[str, State]] = {}
    if parts > 1:
        found = in_order().mapInPandas(ends, _ENDS).collect()
        source, state = None, START
        for r in sorted(found, key=lambda r: (r["part"], not r["first"])):
            if r["source"] != source:
                source, state = r["source"], START
            if r["first"]:
                entry[r["part"]] = (source, state)
            state = Stretch.after(state, r["closed"], r["opened"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, source, now = None, None, START
        for batch in batches:
            rows = []
            for p, s, e, t, ok in zip(batch["part"], batch["source"], batch["event_id"], batch["t"], batch["ok"], strict=True):
                if p != part or s != source:
                    known = entry.get(p, (None, START)) if p != part else (None, START)
                    part, source, now = p, s, known[1] if known[0] == s else START
                tried, *now = step(*now, ok, t, threshold, recovery)
                rows.append((s, e, ok, tried, now[0], now[1]))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in HEALTH.split(", ")])

    return in_order().mapInPandas(run, HEALTH)
