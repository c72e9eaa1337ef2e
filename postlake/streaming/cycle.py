"""The search cycle as streams: continuous deduplication, windowed counts, digests and the continuous run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postlake.operators import dedup, maintenance
from postlake.plans import cycle
from postlake.plans.stages import staged
from postlake.sinks.tables import Tables

#: The key tables: keys of each, and those by which it is bucketed.
KEY_TABLES = {
    "by_hash": (["content_hash"], ["content_hash"]), "by_url": (["url_key"], ["url_key"]), "by_id": (dedup.BY_ID, dedup.BY_ID), "by_kind": (dedup.KIND, ["company_key"]),
}

def new_postings(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Postings whose content hash didn't occur within the delay: state is bounded by the watermark."""
    return stream.withWatermark("discovered_at", delay).dropDuplicatesWithinWatermark(["content_hash"])


def source_counts(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Attempts and failures per source and window; the same on a table and on a stream."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "source")
        .agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))
        .select("source", F.col("w.start").alias("start"), "attempts", "failures")
    )


def digests(rows: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Per profile and window, how many postings there were and the best value; the same on a table and on a stream."""
    return (
        rows.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "profile_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("best"))
        .select("profile_id", F.col("w.start").alias("start"), "n", "best")
    )


def remember(store: Tables, postings: DataFrame) -> dict[str, tuple]:
    """Changes that add postings, with the columns of `dedup.with_keys`, to the key tables that `recalled` reads.

    Each has the largest id of a key; of the tables, only buckets of the postings' own keys are read.
    """
    rows = staged(dedup.slim(postings, "content_hash"), "remembered")
    changes = {}
    for name, (keys, by) in KEY_TABLES.items():
        own = dedup.latest_of(rows.where(" and ".join(f"{k} <> ''" for k in by)), *keys)
        old = store.lookup(name, own.select(*by), own.schema).join(own.select(*keys), keys, "left_semi")
        changes[name] = own.unionByName(old).groupBy(*keys).agg(F.max("duplicate_of").alias("duplicate_of")), keys, by
    return changes | {"names": (rows.where("company_key <> ''").select("company_key").distinct(), ["company_key"])}


def recalled(store: Tables, rows: DataFrame) -> dedup.Known:
    """What the key tables hold that can match the rows: of each only the buckets that their keys fall in, and of companies the names."""
    shape = lambda name: StructType.fromDDL(", ".join(f"{k} string" for k in KEY_TABLES[name][0]) + ", duplicate_of long")
    find = lambda name: store.lookup(name, rows.select(*KEY_TABLES[name][1]), shape(name))
    kinds = lambda companies: store.lookup("by_kind", companies.toDF("company_key"), shape("by_kind")).toDF(*dedup.HISTORY_KIND, "duplicate_of")
    return dedup.Known(find("by_hash"), find("by_url"), find("by_id"), store.read("names", StructType.fromDDL("company_key string")), kinds)


def continuous_cycle(stream: DataFrame, store: Tables, profiles: DataFrame, channels: DataFrame, as_of: Column, *, name: str, checkpoint: str, max_days: int = 60, **trigger) -> StreamingQuery:
    """Run the search cycle on each micro-batch of postings, and fill the outbox once for what is new.

    ``store`` gets the tables outcomes (with the batch), outbox and the key tables, which are all that is kept of history; a
    first commit of `remember` may fill them with postings known before. A batch reads the buckets of its own keys and the names of
    companies, not what came before it, and commits all it gives at once under ``name`` and its number, so one that is run again
    after a failure gives the same and sends nothing twice. What history takes are postings that were new for some profile.
    """

    def run(rows: DataFrame, batch: int) -> None:
        run_id = f"{name}-{batch}"
        if store.version_of(run_id) is not None:
            return
        judged = cycle.judge(staged(rows, "cycle-incoming"), lambda r: recalled(store, r), profiles, as_of, max_days)
        found = staged(cycle.outcomes_of(judged).withColumn("batch", F.lit(batch)), "cycle-outcomes")
        new = found.where("outcome = 'new'")
        fresh = judged.marked.join(new.select("posting_seq").distinct(), "posting_seq", "left_semi")
        key = ["profile_id", "posting_seq", "channel"]
        sent = store.lookup("outbox", new.select("posting_seq"), StructType.fromDDL("profile_id int, posting_seq long, channel string, score int"))
        due = maintenance.outbox(new.select("profile_id", "posting_seq", "score"), channels, sent.withColumn("status", F.lit("sent")))
        tables = {"outcomes": (found, ["posting_seq", "profile_id", "batch"], ["posting_seq"]), "outbox": (due, key, ["posting_seq"])}
        store.commit(run_id, tables | remember(store, fresh))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
