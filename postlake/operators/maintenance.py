"""Retention, cascades and notification outboxes: tables in, surviving or new rows out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.accounts import mail_mode

# Marks of example rows.
EXAMPLES = {
    "source": ["mock"],
    "url": ["%/jobs/mock%", "%-demo.gupy.io%"],
    "title": ["%[teste]%", "%[mock]%"],
    "company": ["%empresa alpha%", "%vagas testes%"],
}


def expired(postings: DataFrame, favourites: DataFrame, as_of: Column, max_days: int) -> DataFrame:
    """Postings to purge: published, or if that is unknown discovered, before the limit, and no favourites; none if max_days < 1."""
    if max_days < 1:
        return postings.limit(0)
    old = F.coalesce("published_at", "discovered_at") < as_of - F.make_dt_interval(F.lit(max_days))
    return postings.where(old).join(favourites.select("posting_seq").distinct(), "posting_seq", "left_anti")


def without(rows: DataFrame, purged: DataFrame) -> DataFrame:
    """Rows of a table, or of a child table, whose posting isn't purged."""
    return rows.join(purged.select("posting_seq").distinct(), "posting_seq", "left_anti")


def is_example() -> Column:
    tests = [F.ilike(F.coalesce(F.col(c), F.lit("")), F.lit(p)) for c, patterns in EXAMPLES.items() for p in patterns]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key: last write wins."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def outbox(scores: DataFrame, channels: DataFrame, sent: DataFrame, default_minimum: int = 70) -> DataFrame:
    """(profile_id, posting_seq, channel, score) to send: score high enough, channel enabled, not sent yet; failures are retried.

    ``channels`` has profile_id, channel, enabled and minimum_score, and may have digest_mode: mail goes out at once only without a digest. ``sent``
    has status too.
    """
    open_ = channels.where("enabled")
    if "digest_mode" in channels.columns:
        open_ = open_.where((F.col("channel") != "mail") | (mail_mode() == "immediately"))
    due = scores.join(open_, "profile_id").where(F.col("score") >= F.coalesce("minimum_score", F.lit(default_minimum)))
    key = ["profile_id", "posting_seq", "channel"]
    return due.join(sent.where("status = 'sent'").select(*key).distinct(), key, "left_anti").select(*key, "score")


def _after(first: Column, shift: Column, low: Column, high: Column) -> Column:
    """Two clamped shifts, one after the other, as one: x + shift kept within low and high."""
    within = lambda x: F.least(F.greatest(x, low), high).cast("int")
    return F.struct((first["shift"] + shift).alias("shift"), within(first["low"] + shift).alias("low"), within(first["high"] + shift).alias("high"))


#: Events that a task folds, about.
FOLDED = 200_000


def feedback_score(events: DataFrame, folded: int = FOLDED) -> DataFrame:
    """Scores after feedback: +5 or -10 for each event in order, kept within 0 and 100 after each.

    Shifts that are clamped make up one such shift. Events, in order of key, time and id, are dealt by range, so that those of
    a key with very many span tasks; each task folds its stretch of a key into one shift, row by row, and a key's stretches, one a task at
    most, are folded in order. Unknown feedback counts as negative, a missing score as 0; events without a key are left out. No events give no rows.
    """
    events = events.where("profile_id is not null and posting_seq is not null").withColumn("score", F.coalesce("score", F.lit(0)))
    key = ["profile_id", "posting_seq"]
    order = [*key, "ts", "event_id"]
    parts = max(1, -(-events.count() // folded))
    delta = F.when(F.col("is_positive"), 5).otherwise(-10).alias("delta")
    kinds = [f"{c} {events.schema[c].dataType.simpleString()}" for c in (*key, "score")]
    names = [*key, "score", "part", "shift", "low", "high", "n"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, state = TaskContext.get().partitionId(), None, None
        for batch in batches:
            done = []
            for *own, score, d in batch[[*key, "score", "delta"]].itertuples(index=False, name=None):
                if own != now:
                    done += [(*now, *state)] if now else []
                    now, state = own, [score, part, 0, 0, 100, 0]
                state[2:5] = state[2] + d, min(100, max(0, state[3] + d)), min(100, max(0, state[4] + d))
                state[5] += 1
            if done:
                yield pd.DataFrame(done, columns=names)
        if now:
            yield pd.DataFrame([(*now, *state)], columns=names)

    dealt = events.select(*order, "score", delta).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stretches = dealt.mapInPandas(fold, ", ".join([*kinds, "part int", "shift long", "low int", "high int", "n long"]))
    none = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(0).alias("low"), F.lit(100).alias("high"))
    listed = F.array_sort(F.collect_list(F.struct("part", F.struct("shift", "low", "high").alias("f"))))  # one a task at most
    whole = stretches.groupBy(*key).agg(
        F.aggregate(listed, none, lambda s, h: _after(s, h["f"]["shift"], h["f"]["low"], h["f"]["high"])).alias("f"), F.first("score").alias("score"), F.sum("n").alias("n_events")
    )
    score = F.least(F.greatest(F.col("score") + F.col("f.shift"), F.col("f.low")), F.col("f.high")).cast("int").alias("score")
    return whole.select(*key, score, "n_events")
