"""Breakers over stretches of attempts against a walk from the first one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import breaker


def walk(state, times, oks, threshold, recovery):
    for t, ok in zip(times, oks, strict=True):
        state = breaker.step(*state, ok, t, threshold, recovery)[1:]
    return state


@pytest.mark.parametrize("seed", range(6))
def test_stretches_are_functions_of_the_state_before(seed):
    rng = random.Random(seed)
    for _ in range(300):
        threshold, recovery = rng.choice([1, 2, 3]), rng.choice([0.5, 3.0, 9.0])
        times, t = [], 100.0
        for _ in range(rng.randrange(1, 25)):
            t += rng.choice([0.0, 0.5, 1.0, 4.0])
            times.append(t)
        oks = [rng.random() < 0.4 for _ in times]
        f = breaker.Stretch(times, oks, threshold, recovery)
        before = [(breaker.CLOSED, k, 0.0) for k in range(threshold)]
        before += [(breaker.OPEN, k, times[0] + x) for k in (threshold, threshold + 4) for x in (-5.0, 0.0, recovery / 2, recovery)]
        for state in before:
            assert breaker.Stretch.after(state, f.closed, f.opened) == tuple(walk(state, times, oks, threshold, recovery)), (state, times, oks)


def test_a_source_over_many_tasks(spark):
    rng, rows = random.Random(4), []
    for k in range(6000):
        source = "hot" if k % 10 else rng.choice(["a", "b", None])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(200_000))
        rows.append((source, k, at if k % 500 else None, rng.choice([True, False, False, None])))
    df = spark.createDataFrame(rows, "source string, event_id long, ts timestamp, ok boolean")
    got = {}
    for stretch in (97, 1000, 1 << 20):
        found = breaker.source_health(df, recovery=300.0, stretch=stretch)
        if stretch == 97:
            assert found.select(F.spark_partition_id()).distinct().count() > 1
        got[stretch] = sorted(map(tuple, found.collect()), key=lambda r: r[1])
    want, now = [], {}
    for source, event, at, ok in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[2], r[1])):
        state = now.get(source, breaker.START)
        tried, *state = breaker.step(*state, bool(ok), at.replace(tzinfo=dt.UTC).timestamp(), 3, 300.0)
        now[source] = tuple(state)
        want.append((source, event, bool(ok), tried, state[0], state[1]))
    want.sort(key=lambda r: r[1])
    assert got[97] == got[1000] == got[1 << 20] == want


def test_no_attempts(spark):
    assert breaker.source_health(spark.createDataFrame([], "source string, event_id long, ts timestamp, ok boolean")).count() == 0
