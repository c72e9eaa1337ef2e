"""Users' own tables, kept by events in order of ``seq``: favourites, preferences, logs and what was shown to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def favourites(events: DataFrame, keys: tuple[str, ...] = ("profile_id", "posting_seq")) -> DataFrame:
    """Favourites after all events (keys, seq, wanted, note): repeated ones change nothing, empty notes overwrite none."""
    gone = F.max(F.when(~F.col("wanted"), F.col("seq"))).over(Window.partitionBy(*keys))
    live = events.withColumn("_gone", gone).where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    note = F.max_by("note", F.when(F.coalesce("note", F.lit("")) != "", F.col("seq")))
    return live.groupBy(*keys).agg(F.coalesce(note, F.lit("")).alias("note"))


def preferences(stored: DataFrame, changes: DataFrame, defaults: dict[str, int]) -> DataFrame:
    """Preferences after updates (user_id, seq, reset and new values or nulls): each field's last value since the last reset."""
    reset = F.max(F.when(F.col("reset"), F.col("seq"))).over(Window.partitionBy("user_id"))
    live = changes.withColumn("_reset", reset).where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")) | F.col("reset"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & ~F.col("reset"), F.col("seq")))
    new = live.groupBy("user_id").agg(F.bool_or("reset").alias("_reset"), *[last(c).alias(f"_{c}") for c in defaults])
    kept = [F.coalesce(f"_{c}", F.when(F.col("_reset"), F.lit(d)).otherwise(F.col(c))).alias(c) for c, d in defaults.items()]
    return stored.join(new, "user_id", "left").select("user_id", *kept)


def without_users(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """A child table without the rows of deleted users."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def notification_log(attempts: DataFrame, longest: int = 2000) -> DataFrame:
    """Log rows of delivery attempts (ok, error, ts): errors are cut, and only sent ones have a time."""
    return attempts.select(
        "event_id",
        F.when(F.col("ok"), "sent").otherwise("failed").alias("status"),
        F.when(~F.col("ok"), F.substring("error", 1, longest)).alias("error"),
        F.when(F.col("ok"), F.col("ts")).alias("sent_at"),
    )


def next_runs(runs: DataFrame, frequency: Column, as_of: Column) -> DataFrame:
    """Per user of ``runs`` (user_id, started_at, running): whether a run is due, and when the next one is."""
    last = runs.groupBy("user_id").agg(F.max("started_at").alias("last"), F.max_by("running", F.struct("started_at", "event_id")).alias("running"))
    gap = F.make_dt_interval(mins=frequency)
    following = F.when(F.col("running"), as_of + gap).otherwise(F.greatest(F.col("last") + gap, as_of))
    return last.select("user_id", (F.col("last") + gap <= as_of).alias("is_due"), following.alias("next_run"))


# Levels that a preference takes for the level of a résumé.
LEVELS_FOR = {"junior": ["estagio", "trainee", "junior"], "estagio": ["estagio", "trainee", "junior"], "mid": ["junior", "pleno"], "senior": ["pleno", "senior"]}
KEYWORDS = 10


def derived_preferences(profiles: DataFrame) -> DataFrame:
    """Preferences after a résumé was read: its roles, its first ten skills and the levels for its own; what it doesn't say stays as it was."""
    known = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    table = F.create_map(*[x for k, v in LEVELS_FOR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return profiles.select(
        "profile_id",
        F.when(known("roles"), F.col("roles")).otherwise(F.col("desired_roles")).alias("desired_roles"),
        F.when(known("skills"), F.slice("skills", 1, KEYWORDS)).otherwise(F.col("preferred_keywords")).alias("preferred_keywords"),
        F.coalesce(F.try_element_at(table, F.col("profile_seniority")), "seniority_levels").alias("seniority_levels"),
    )


def mail_mode() -> Column:
    """When a profile wants mail: at once unless a digest is asked for."""
    return F.coalesce(F.nullif(F.col("digest_mode"), F.lit("")), F.lit("immediately"))


def digest(scores: DataFrame, channels: DataFrame, mode: str, most: int = 30) -> DataFrame:
    """(profile_id, posting_seq, score, place): what the mail of a digest, `hourly` or `daily`, lists for each profile that asked for that one."""
    asked = channels.where((F.col("channel") == "mail") & F.col("enabled") & (mail_mode() == mode))
    rows = scores.join(asked.select("profile_id", "minimum_score"), "profile_id").where(F.col("score") >= F.coalesce("minimum_score", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("score"), F.desc("posting_seq")))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("profile_id", "posting_seq", "score", "place")


def batch_differences(history: DataFrame, batch: DataFrame, changes: DataFrame) -> DataFrame:
    """new, updated, unchanged or not_seen for each posting of a batch or of history."""
    old, new = history.select("posting_seq", F.lit(True).alias("_old")), batch.select("posting_seq", F.lit(True).alias("_new"))
    changed = changes.select("posting_seq").distinct().withColumn("_changed", F.lit(True))
    both = old.join(new, "posting_seq", "full_outer").join(changed, "posting_seq", "left")
    return both.select(
        "posting_seq",
        F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "not_seen").when(F.col("_changed"), "updated").otherwise("unchanged").alias("difference"),
    )


def blended(rule: Column, external: Column) -> Column:
    """0.6 of the rule's score and 0.4 of an external one within 0 and 100; the rule's where there is none."""
    within = F.greatest(F.lit(0), F.least(F.lit(100), external))
    return F.when(external.isNotNull(), F.rint(F.lit(0.6) * rule + F.lit(0.4) * within).cast("int")).otherwise(rule)


def alternative_sources(duplicates: DataFrame) -> DataFrame:
    """Per posting, the other addresses that it was seen at: rows (target, target_source, target_url, source, url, seq).

    One of the same source or address adds none, and an address counts once, at its first sighting.
    """
    other = duplicates.where((F.col("source") != F.col("target_source")) & (F.col("url") != F.col("target_url")))
    return other.groupBy(F.col("target").alias("posting_seq"), "url").agg(F.min_by("source", "seq").alias("source"))
