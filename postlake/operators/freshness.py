"""Freshness of postings: age, signs of closure, and the verdict of both. Time is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import rules
from postlake.functions.text import let, says


def days_old(published: Column, as_of: Column) -> Column:
    return F.floor((F.unix_micros(as_of) - F.unix_micros(published)) / 86_400_000_000)


def age_reason(published: Column, as_of: Column, max_days: int = 60) -> Column:
    """Why a posting is too old: strictly older than ``max_days``; else null. Unknown dates pass."""
    old = published < as_of - F.make_dt_interval(F.lit(max_days))
    return F.when(old, F.concat(F.lit("published_"), days_old(published, as_of).cast("string"), F.lit(f"_days_ago (limit: {max_days})")))


def closure_reason(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.coalesce(*[F.when(says(low, p), F.lit(f"closure_signal: {p}")) for p in rules.CLOSURE]))


def freshness(postings: DataFrame, as_of: Column, max_days: int = 60) -> DataFrame:
    """Add is_ghost, status, ghost_reason and date_status; age is tried before closure."""
    age = age_reason(F.col("published_at"), as_of, max_days)
    closed = closure_reason(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    return postings.withColumns({"_age": age, "_closed": closed}).withColumns(
        {
            "is_ghost": F.col("_age").isNotNull() | F.col("_closed").isNotNull(),
            "status": F.when(F.col("_age").isNotNull(), "potential_ghost").when(F.col("_closed").isNotNull(), "closed").otherwise("active"),
            "ghost_reason": F.coalesce("_age", "_closed", F.lit("")),
            "date_status": F.when(F.col("published_at").isNull(), "unknown_date").when(F.col("_age").isNotNull(), "expired").otherwise("verified"),
        }
    ).drop("_age", "_closed")
