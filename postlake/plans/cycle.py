"""The search cycle over a batch: freshness, deduplication, validation and ranking, with one outcome a posting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postlake.operators import dedup, freshness, ranking, validation
from postlake.plans.stages import staged
from postlake.sources.adapters import small


@dataclass
class Judged:
    """A batch between the stages: ``marked`` has all postings, ``known`` those that history has (``duplicate_of``, ``same_hash``), ``scored`` the rest for each profile."""

    marked: DataFrame
    known: DataFrame
    scored: DataFrame
    counts: dict[str, Observation]


def judge(incoming: DataFrame, history: Callable[[DataFrame], dedup.Known], profiles: DataFrame, as_of: Column, max_days: int = 60) -> Judged:
    """Freshness, deduplication, validation and ranking of a batch; see `run_batch`.

    ``history`` gives what is known that can match rows with the columns of `dedup.with_keys`. What the stages hold is counted
    while they are written, without another pass.
    """
    rows = dedup.with_keys(freshness.freshness(incoming, as_of, max_days))
    fresh = rows.where("not is_ghost")
    first = fresh.groupBy("content_hash").agg(F.min("posting_seq").alias("first_seq"))
    marked = rows.join(first, "content_hash", "left").withColumn("_dup", ~F.col("is_ghost") & (F.col("posting_seq") != F.col("first_seq")))
    counts = {k: Observation() for k in ("marked", "known")}
    found = F.count(F.lit(1)).alias("found"), F.count_if("is_ghost").alias("ghosts"), F.count_if("_dup").alias("dup_in_batch")
    marked = staged(marked.observe(counts["marked"], *found), "cycle-marked")
    candidates = marked.where("not is_ghost and not _dup")
    known = history(candidates)
    exact = candidates.join(known.by_hash.withColumnRenamed("duplicate_of", "_same"), "content_hash", "left")
    fuzzy = dedup.matches(exact.where("_same is null"), known).withColumnRenamed("duplicate_of", "_like")
    judged = exact.join(fuzzy, "posting_seq", "left").withColumns({"duplicate_of": F.coalesce("_same", "_like"), "same_hash": F.col("_same").isNotNull()}).drop("_same", "_like")
    judged = staged(judged.observe(counts["known"], F.count_if(F.col("duplicate_of").isNotNull()).alias("dup_history")), "cycle-judged")
    unseen = ranking.with_signals(validation.with_signals(judged.where("duplicate_of is null").drop("duplicate_of", "same_hash")))
    scored = ranking.rank(validation.validate(unseen.crossJoin(small(profiles))), as_of)
    return Judged(marked, judged.where("duplicate_of is not null"), scored, counts)


def run_batch(incoming: DataFrame, history: DataFrame, profiles: DataFrame, as_of: Column, max_days: int = 60) -> DataFrame:
    """(posting_seq, profile_id, outcome, reason, score) of each incoming posting for each profile.

    Outcomes: ghost, dup_in_batch, dup_history, invalid, new. In the batch the first posting of a
    content hash stays. History must have the columns of `dedup.with_keys`. Profiles are broadcast up to a checked number.
    """
    return outcomes_of(judge(incoming, lambda _: dedup.known(history), profiles, as_of, max_days))


def outcomes_of(batch: Judged) -> DataFrame:
    """The rows of `run_batch`."""
    out = lambda df, outcome, reason: df.select("posting_seq", F.lit(None).cast("int").alias("profile_id"), F.lit(outcome).alias("outcome"), reason.alias("reason"), F.lit(None).cast("int").alias("score"))
    judged_rows = batch.scored.select("posting_seq", "profile_id", F.when(F.col("is_valid"), "new").otherwise("invalid").alias("outcome"), F.col("discard_reason").alias("reason"), F.when(F.col("is_valid"), F.col("score")).alias("score"))
    return (
        out(batch.marked.where("is_ghost"), "ghost", F.col("ghost_reason"))
        .unionByName(out(batch.marked.where("_dup"), "dup_in_batch", F.lit("same_content_hash")))
        .unionByName(out(batch.known, "dup_history", F.when(F.col("same_hash"), "same_content_hash").otherwise("similar")))
        .unionByName(judged_rows)
    )


def top_new(postings: DataFrame, as_of: Column, n: int = 20) -> DataFrame:
    """The flagship list: fresh, first of their content hash, sound, newest first."""
    fresh = freshness.freshness(postings, as_of).where("not is_ghost")
    first = dedup.first_per(fresh.withColumn("content_hash", dedup.text.content_hash(*[F.col(c) for c in ("title", "company", "location", "url", "external_id")])), "content_hash")
    table = {k: v for k, v in validation.rule_table().items() if k in ("v1", "v2", "v3", "v4")}
    sound = validation.with_signals(first).where(F.coalesce(*table.values()).isNull()).withColumn("recency_score", ranking.recency_score(as_of))
    return sound.orderBy(F.desc("recency_score"), F.desc("posting_seq")).limit(n).select("posting_seq", "title", "company", "content_hash", "recency_score")
