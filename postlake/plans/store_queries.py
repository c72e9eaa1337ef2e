"""Queries of runs that are kept: postings, matches, the changelog and the ledger, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.plans import oracle as O
from postlake.plans import persistence
from postlake.plans.queries import changes_sql, query, run_sql, versions_sql
from postlake.plans.stages import shared_path
from postlake.sinks.tables import Tables
from postlake.sources import adapters as A

#: Ids of the second batch are those of the first plus this.
LATER = 10_000_000

_FIRST = f"""b1 AS (SELECT * REPLACE (CASE WHEN posting_seq % 6 = 1 THEN 'Recife' ELSE location END AS location, CASE WHEN posting_seq % 5 = 2 THEN 'hybrid' ELSE work_mode END AS work_mode,
  CASE WHEN posting_seq % 3 = 1 THEN salary_min + 250 ELSE salary_min END AS salary_min) FROM p WHERE posting_seq % 4 <> 3)"""
_SECOND = f"b2 AS (SELECT * REPLACE (posting_seq + {LATER} AS posting_seq, CASE WHEN posting_seq % 5 = 1 THEN 'other' ELSE source END AS source) FROM p)"


def batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three quarters of the postings in an earlier version, and then all of them with ids of their own, some from another source."""
    p, seq = A.postings(spark, d), F.col("posting_seq")
    first = p.where(seq % 4 != 3).withColumns(
        {
            "location": F.when(seq % 6 == 1, "Recife").otherwise(F.col("location")), "work_mode": F.when(seq % 5 == 2, "hybrid").otherwise(F.col("work_mode")),
            "salary_min": F.when(seq % 3 == 1, F.col("salary_min") + 250).otherwise(F.col("salary_min")),
        }
    )
    return first, p.withColumn("source", F.when(seq % 5 == 1, "other").otherwise(F.col("source"))).withColumn("posting_seq", seq + LATER)


_STORES: dict[tuple[str, str], Tables] = {}


def store(spark: SparkSession, d: str) -> Tables:
    """The tables after both batches, once per session and folder; the second run is tried twice, which changes nothing."""
    key = spark.sparkContext.applicationId, d
    if key not in _STORES:
        tables = Tables(spark, shared_path(spark, "store"))
        failures = spark.createDataFrame([("src2", "timeout")], "source string, error string")
        for run_id, batch, failed in (("run-1", 0, None), ("run-2", 1, failures), ("run-2", 0, None)):
            persistence.run(tables, run_id, batches(spark, d)[batch], A.profiles(spark), A.as_of(), failures=failed)
        _STORES[key] = tables
    return _STORES[key]


_KEPT = f"""{O.POSTINGS}, {_FIRST}, {_SECOND}, {run_sql('b1', '(SELECT * FROM p WHERE false)', '1')},
jobs1 AS MATERIALIZED (SELECT * FROM f1 WHERE posting_seq IN (SELECT posting_seq FROM run1 WHERE outcome = 'new')),
{run_sql('b2', 'jobs1', '2')},
again AS MATERIALIZED (SELECT j.posting_seq AS kept, n.posting_seq AS by, j.source AS old_source, n.source, n.url, j.posting_seq || ':' || n.posting_seq AS pair, {versions_sql('j', 'n', 'n.status')}
  FROM verdicts2 n JOIN jobs1 j ON j.posting_seq = n.duplicate_of WHERE n.verdict = 'dup_history'),
{changes_sql('c', '(SELECT * REPLACE (pair AS posting_seq) FROM (SELECT *, kept AS posting_seq FROM again))')},
logged AS (SELECT CAST(split_part(posting_seq, ':', 1) AS BIGINT) AS posting_seq, CAST(split_part(posting_seq, ':', 2) AS BIGINT) AS by, field_name, old_value, new_value, change_type FROM c)"""


@query("s18_jobs", f"""WITH {_KEPT}, every AS (SELECT posting_seq, title, status FROM jobs1 UNION ALL SELECT posting_seq, title, status FROM f2 WHERE posting_seq IN (SELECT posting_seq FROM run2 WHERE outcome = 'new')),
other AS (SELECT kept, count(DISTINCT url) AS n FROM again WHERE source <> '' AND source <> old_source GROUP BY kept)
SELECT e.posting_seq, title, status, e.posting_seq IN (SELECT posting_seq FROM logged) AS updated, coalesce(other.n, 0) AS n_sources FROM every e LEFT JOIN other ON e.posting_seq = other.kept""")  # fmt: skip
def s18_jobs(spark: SparkSession, d: str) -> DataFrame:
    jobs = store(spark, d).read("jobs")
    return jobs.select("posting_seq", "title", "status", F.col("last_updated_at").isNotNull().alias("updated"), F.size("alternative_sources").cast("long").alias("n_sources"))


@query("s18_matches", f"WITH {_KEPT} SELECT posting_seq, profile_id, score FROM run1 WHERE outcome = 'new' UNION ALL SELECT posting_seq, profile_id, score FROM run2 WHERE outcome = 'new'")
def s18_matches(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).read("matches").select("posting_seq", "profile_id", "score")


@query("s18_changelog", f"WITH {_KEPT} SELECT * FROM logged")
def s18_changelog(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).read("changelog").select("posting_seq", "by", "field_name", "old_value", "new_value", "change_type")


def _counted(tag: str, updated: str, status: str) -> str:
    n = lambda test: f"(SELECT count(*) FROM run{tag} WHERE {test})"
    return f"""SELECT 'run-{tag}' AS run_id, '{status}' AS status, (SELECT count(*) FROM b{tag}) AS found, {n("outcome = 'new'")} AS valid, {n("outcome LIKE 'dup%'")} AS deduplicated,
  {n("outcome IN ('ghost', 'invalid')")} AS discarded, (SELECT count(DISTINCT posting_seq) FROM run{tag} WHERE outcome = 'new') AS new, {updated} AS updated, {n("score >= 70")} AS notified,
  (SELECT string_agg(reason || '=' || n, ';' ORDER BY reason) FROM (SELECT reason, count(*) AS n FROM run{tag} WHERE outcome IN ('ghost', 'invalid') GROUP BY reason)) AS reasons,
  (SELECT string_agg(source || '=' || n, ';' ORDER BY source) FROM (SELECT source, count(*) AS n FROM b{tag} GROUP BY source)) AS sources"""


@query("s19_runs", f"WITH {_KEPT} {_counted('1', 'CAST(0 AS BIGINT)', 'completed')} UNION ALL {_counted('2', '(SELECT count(DISTINCT "by") FROM logged)', 'partial_error')}")
def s19_runs(spark: SparkSession, d: str) -> DataFrame:
    shown = lambda m, value: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]).cast("string"))), ";")
    return store(spark, d).read("runs").select(
        "run_id", "status", *persistence.COUNTERS, shown("discard_reasons", lambda v: v).alias("reasons"), shown("source_stats", lambda v: v["found"]).alias("sources")
    )
