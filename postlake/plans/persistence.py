"""A search run that is kept: postings, matches, the changelog and the run's own row, committed together."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postlake.operators import changes, dedup, ranking
from postlake.plans import cycle
from postlake.plans.stages import staged
from postlake.sinks.tables import Tables

_FIELDS = ["salary_min", "salary_max", "work_mode", "location", "status", "description", "published_at"]
_SCORES = ["score", "role_score", "skills_score", "seniority_score", "location_score", "salary_score"]
#: Reasons that a match keeps at most.
REASONS = 8
OTHER = "array<struct<source:string,url:string,discovered_at:timestamp>>"


def _jobs_schema(incoming: DataFrame) -> StructType:
    """What a kept posting has: the incoming columns, what the run found, and the keys that later runs compare."""
    more = (
        "status string, status_reason string, date_status string, content_hash string, dedup_key string, url_key string, company_key string, title_key string, location_key string, "
        f"discovered_at timestamp, last_checked_at timestamp, last_updated_at timestamp, alternative_sources {OTHER}"
    )
    own = [f for f in incoming.schema.fields if f.name not in StructType.fromDDL(more).names]
    whole = StructType([*own, *StructType.fromDDL(more).fields]).json()
    return StructType.fromJson(json.loads(re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', whole)))


def new_jobs(batch: cycle.Judged, valid: DataFrame, schema: StructType, as_of: Column) -> DataFrame:
    """A row per posting that is valid for some profile, as the ids in ``valid`` tell."""
    rows = batch.marked.join(valid, "posting_seq", "left_semi").withColumns(
        {
            "status_reason": F.col("ghost_reason"), "discovered_at": as_of, "last_checked_at": as_of,
            "last_updated_at": F.lit(None).cast("timestamp"), "alternative_sources": F.array().cast(OTHER),
        }
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def seen_again(known: DataFrame, jobs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(kept postings with what their duplicates of the batch tell, changes in long form).

    A posting's fields stay; changes are told against them by each duplicate, so that one with several has a row for each. An
    address of another source is kept once, at its first sighting. The time of the last check, and with changes that of the last update, move on.
    """
    pairs = known.select(F.col("duplicate_of").alias("of"), "posting_seq", "source", "url", F.struct(*_FIELDS).alias("new"))
    old = jobs.select(F.col("posting_seq").alias("of"), F.struct(*_FIELDS).alias("old"), F.col("source").alias("_source"), F.col("alternative_sources").alias("_others"))
    both = staged(pairs.join(old, "of"), "seen-again")
    log = changes.changelog(both.select("of", "posting_seq", "old", "new").withColumn("posting_seq", F.struct("of", "posting_seq")))
    log = log.select("posting_seq.of", F.col("posting_seq.posting_seq").alias("by"), "field_name", "old_value", "new_value", "change_type")
    log = staged(log, "changelog").withColumnRenamed("of", "posting_seq")
    fresh = (F.coalesce("source", F.lit("")) != "") & (F.col("source") != F.col("_source")) & ~F.exists("_others", lambda o: o["url"].eqNullSafe(F.col("url")))
    others = both.where(fresh).groupBy("of", "url").agg(F.min_by("source", "posting_seq").alias("source"), F.min("posting_seq").alias("first"))
    # as many entries as a posting has other addresses
    listed = F.array_sort(F.collect_list(F.struct("first", "source", "url")))
    others = others.groupBy("of").agg(F.transform(listed, lambda o: F.struct(o["source"].alias("source"), o["url"].alias("url"), as_of.alias("discovered_at"))).alias("_more"))
    changed = log.select(F.col("posting_seq").alias("of")).distinct().withColumn("_changed", F.lit(True))
    touched = both.select("of").distinct().join(others, "of", "left").join(changed, "of", "left")
    rows = jobs.join(touched, jobs["posting_seq"] == touched["of"])
    rows = rows.withColumns(
        {
            "last_checked_at": as_of, "last_updated_at": F.when(F.col("_changed"), as_of).otherwise(F.col("last_updated_at")),
            "alternative_sources": F.concat("alternative_sources", F.coalesce("_more", F.array().cast(OTHER))),
        }
    )
    return rows.select(*jobs.columns), log


def run(store: Tables, run_id: str, incoming: DataFrame, profiles: DataFrame, as_of: Column, *, started_at: Column | None = None, minimum: int = 70, max_days: int = 60, failures: DataFrame | None = None) -> int:
    """Search over a batch, against the postings kept that aren't closed, and commit what it finds under ``run_id``.

    The commit holds jobs (by posting_seq), matches (by posting and profile), the changelog and a row of runs. Posting ids must be new. A run that
    was committed already is not run again; one that died before its commit left nothing that is read. ``failures`` (source, error)
    are sources that couldn't be read. Counters of runs, of one profile or of several: found, duplicates and ghosts are counted while the
    stages are written; valid, discarded and notified count a posting once a profile, new and updated once.
    """
    spark: SparkSession = store.spark
    done = store.version_of(run_id)
    if done is not None:
        return done
    schema = _jobs_schema(incoming)
    jobs = store.read("jobs", schema)
    batch = cycle.judge(incoming, lambda _: dedup.known(jobs.where("status <> 'closed'")), profiles, as_of, max_days)
    batch.scored = staged(ranking.reasoned(batch.scored).select("posting_seq", "profile_id", "is_valid", "discard_reason", *_SCORES, F.slice("reasoning", 1, REASONS).alias("reasoning")), "scored")
    counted = {k: Observation() for k in ("new", "scored", "log")}
    # ids are counted and kept; whole postings are first written by the commit
    ids = staged(batch.scored.where("is_valid").select("posting_seq").distinct().observe(counted["new"], F.count(F.lit(1)).alias("new")), "new-ids")
    fresh = new_jobs(batch, ids, schema, as_of)
    again, log = seen_again(batch.known, jobs, as_of)
    # one row per duplicate that tells of a change, as each is an update
    updates = staged(log.select("posting_seq", "by").distinct().observe(counted["log"], F.count(F.lit(1)).alias("updated")), "updates")
    valid = F.col("is_valid")
    score = F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid"), F.count_if(valid & (F.col("score") >= minimum)).alias("notified")
    matches = staged(batch.scored.observe(counted["scored"], *score), "matches").where("is_valid").select("posting_seq", "profile_id", *_SCORES, "reasoning")
    counts = {k: v for o in (*batch.counts.values(), *counted.values()) for k, v in o.get.items()}
    ghosts = batch.marked.where("is_ghost").select(F.coalesce(F.nullif("ghost_reason", F.lit("")), F.lit("ghost_vacancy")).alias("reason"))
    reasons = ghosts.unionByName(batch.scored.where(~valid).select(F.col("discard_reason").alias("reason"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    sources = batch.marked.groupBy("source").agg(F.count(F.lit(1)).alias("found"))
    failed = failures if failures is not None else spark.createDataFrame([], "source string, error string")
    sources = sources.join(failed.groupBy("source").agg(F.first("error").alias("error")), "source", "full_outer")
    stats = F.struct(F.coalesce("found", F.lit(0)).alias("found"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), F.coalesce("error", F.lit("")).alias("error"))
    # a row a reason and a row a source, as one map each
    as_map = lambda df, key, value: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value.alias("v"))))).alias("m"))
    ledger = (
        spark.range(1)
        .select(F.lit(run_id).alias("run_id"), (started_at if started_at is not None else as_of).cast("timestamp").alias("started_at"), as_of.cast("timestamp").alias("finished_at"))
        .withColumns({name: F.lit(n).cast("long") for name, n in counters(counts).items()})
        .crossJoin(as_map(reasons, "reason", F.col("n")).withColumnRenamed("m", "discard_reasons"))
        .crossJoin(as_map(sources.where("source is not null"), "source", stats).withColumnRenamed("m", "source_stats"))
        .withColumn("status", F.when(F.exists(F.map_values("source_stats"), lambda s: s["status"] == "error"), "partial_error").otherwise("completed"))
    )
    log = log.join(updates, ["posting_seq", "by"]).withColumns({"run_id": F.lit(run_id), "created_at": as_of})
    return store.commit(
        run_id,
        {
            "jobs": (fresh.unionByName(again), ["posting_seq"]),
            "matches": (matches, ["posting_seq", "profile_id"]),
            "changelog": (log, ["posting_seq", "by", "field_name"]),
            "runs": (ledger, ["run_id"]),
        },
    )


COUNTERS = ("found", "valid", "deduplicated", "discarded", "new", "updated", "notified")


def counters(n: dict[str, int]) -> dict[str, int]:
    """The run's seven counters."""
    return {
        "found": n["found"], "valid": n["valid"], "deduplicated": n["dup_in_batch"] + n["dup_history"], "discarded": n["ghosts"] + n["invalid"],
        "new": n["new"], "updated": n["updated"], "notified": n["notified"],
    }
