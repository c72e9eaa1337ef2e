"""Lists, counts and reports over postings and their scores."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.feed_text import search_predicate
from postlake.operators.dedup import best_per_url


def is_new(as_of: Column) -> Column:
    """Discovered or published within a day."""
    cutoff = as_of - F.expr("INTERVAL 24 HOURS")
    return F.coalesce(F.col("discovered_at") >= cutoff, F.lit(False)) | F.coalesce(F.col("published_at") >= cutoff, F.lit(False))


#: Optional predicates of the list: a column that equals the value, or has a variant of it, or has it within.
EQUAL = ("status", "seniority", "work_mode", "source", "employment_type")
SEARCHED = ("title", "company", "location", "description")
PREDICATES: dict[str, Callable[[object], Column]] = {
    **{name: lambda v, name=name: F.col(name) == v for name in EQUAL},
    "search": lambda v: search_predicate(v, list(SEARCHED)),
    "company": lambda v: search_predicate(v, ["company"]),
    "location": lambda v: search_predicate(re.split("[,/-]", v)[0], ["location"]),
    "area": lambda v: F.ilike(F.coalesce("area", F.lit("")), F.lit(f"%{v}%")),
    "min_score": lambda v: F.col("score") >= v,
}


def list_postings(rows: DataFrame, as_of: Column, *, status: str = "active", only_new: bool = False, dismissed: DataFrame | None = None, limit: int = 50, offset: int = 0, **given) -> DataFrame:
    """The interactive list: optional predicates, best scores first (nulls last), then the latest.

    ``given`` are values of PREDICATES; empty ones, 0 and the status `all` ask for nothing, and the usual status is `active`. Search, company and place (its part before a comma, dash or slash)
    match variants of accents; only_new takes what was discovered or published within a day; at most 200 rows are shown.
    """
    unknown = given.keys() - PREDICATES.keys()
    if unknown:
        raise TypeError(f"no such predicate: {sorted(unknown)}")
    for name, value in {"status": status, **given}.items():
        if value and (name, value) != ("status", "all"):
            rows = rows.where(PREDICATES[name](value))
    if only_new:
        rows = rows.where(is_new(as_of))
    if dismissed is not None:
        rows = rows.join(dismissed.select("posting_seq").distinct(), "posting_seq", "left_anti")
    return rows.orderBy(F.desc_nulls_last("score"), F.desc("posting_seq")).offset(offset).limit(min(limit, 200))


def status_counts(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.agg(F.count(F.lit(1)).alias("total"), n("active"), n("potential_ghost"), n("closed"))


def reason_histogram(rows: DataFrame, by: str, reason: str) -> DataFrame:
    return rows.groupBy(by, reason).agg(F.count(F.lit(1)).alias("n"))


def top_per(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n best rows of each key, with their place."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), F.desc("posting_seq"))
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def mode_class() -> Column:
    mode = F.lower(F.coalesce("work_mode", F.lit("")))
    return F.when(mode.isin("remote", "remoto"), "remote").when(mode.isin("hybrid", "hibrido"), "hybrid").otherwise("onsite")


def in_week(as_of: Column) -> Column:
    week = F.expr("INTERVAL 7 DAYS")
    return (F.col("published_at") >= as_of - week) | (F.col("discovered_at") >= as_of - week)


def is_internship() -> Column:
    kind, title = (F.lower(F.coalesce(c, F.lit(""))) for c in ("employment_type", "title"))
    return F.contains(kind, F.lit("estagio")) | F.contains(kind, F.lit("estágio")) | F.contains(title, F.lit("estagi"))


def changes_since(shown: DataFrame, changes: DataFrame) -> DataFrame:
    """(profile_id, posting_seq, n): the changes (posting_seq, changed_at) of each posting shown to a profile from ``since`` on.

    Changes and the times asked for stand in one line per posting, in which those yet to come are counted: no change meets a profile, however many of both a posting has.
    """
    asked = shown.select("posting_seq", F.col("since").alias("at"), "profile_id", F.lit(0).alias("one"))
    happened = changes.select("posting_seq", F.col("changed_at").alias("at"), F.lit(None).cast("int").alias("profile_id"), F.lit(1).alias("one"))
    # of equal times a change counts for who asks, so it stands after them
    onward = Window.partitionBy("posting_seq").orderBy("at", "one").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    line = asked.unionByName(happened).withColumn("n", F.sum("one").over(onward))
    return line.where("one = 0").select("profile_id", "posting_seq", "n")


def weekly_report(rows: DataFrame, reports: DataFrame, changes: DataFrame, as_of: Column, top: int = 20) -> DataFrame:
    """The week's active postings of every profile, each address once, with tag, changes, place and cut.

    ``rows`` are scored postings per profile, with minimum_match_score; ``reports`` (profile_id, report_id, created_at, presented) are those
    given before, of which the last ten by id count: what any of them presented isn't new, and changes count from five seconds before the latest that has a time.
    """
    week = rows.where((F.col("status") == "active") & F.coalesce(in_week(as_of), F.lit(False)))
    once = best_per_url(week, "profile_id").withColumn("score", F.coalesce("score", F.lit(0)))
    lately = Window.partitionBy("profile_id").orderBy(F.desc("report_id"))
    last = reports.withColumn("_n", F.row_number().over(lately)).where("_n <= 10")
    since = last.groupBy("profile_id").agg((F.max_by("created_at", F.when(F.col("created_at").isNotNull(), F.col("report_id"))) - F.expr("INTERVAL 5 SECONDS")).alias("since"))
    presented = last.select("profile_id", F.explode("presented").alias("posting_seq")).distinct().join(since, "profile_id")
    # without a time all changes count
    shown = presented.withColumn("since", F.coalesce("since", F.lit("0001-01-01").cast(changes.schema["changed_at"].dataType)))
    seen = shown.join(changes_since(shown, changes), ["profile_id", "posting_seq"]).select("profile_id", "posting_seq", F.col("n").alias("n_changes"))
    marked = once.join(seen, ["profile_id", "posting_seq"], "left")
    tag = F.when(F.col("n_changes").isNull(), "NOVA").when(F.col("n_changes") > 0, "ATUALIZADA").otherwise("ANTERIOR")
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy(F.desc("score"), F.desc("posting_seq")))
    placed = marked.withColumns({"tag": tag, "n_changes": F.coalesce("n_changes", F.lit(0)), "place": place})
    cut = F.when(F.col("place") <= 5, 5).when(F.col("place") <= 10, 10).when(F.col("place") <= top, top)
    return placed.withColumn("cut", cut)


def weekly_totals(report: DataFrame, default_minimum: int = 70) -> DataFrame:
    """Per profile of a `weekly_report`: analysed, compatible by its own minimum, new, by mode, and internships."""
    minimum = F.coalesce(F.nullif(F.col("minimum_match_score"), F.lit(0)), F.lit(default_minimum))
    n = lambda c, name: F.count_if(c).alias(name)
    return report.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("analysed"), n(F.col("score") >= minimum, "compatible"), n(F.col("tag") == "NOVA", "new"),
        n(mode_class() == "remote", "remote"), n(mode_class() == "hybrid", "hybrid"), n(mode_class() == "onsite", "onsite"), n(is_internship(), "internships"),
    )
