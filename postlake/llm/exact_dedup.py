"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest. A batch is first reduced
to its distinct digests, anti-joined with the index by sort-merge (the index side
needs no shuffle) and what is new is appended. What stays is then read from the index.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import SPACE, chosen, id_and, shared_path, stored


def digest(text: Column) -> Column:
    """SHA-256, as lowercase hex, of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


class DigestIndex:
    """A table (text_sha256, keep_id, batch) under ``path``, bucketed and sorted by text_sha256.

    The files under ``path`` are all that an index is: a later session that opens the same path, with the same number of
    ``buckets``, continues it. In the session's catalog it is an external table named after the path.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        columns = "text_sha256 STRING, keep_id BIGINT, batch STRING"
        how = f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{path}'"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet {how}")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """Append rows of digests that the index lacks: a file a bucket."""
        new.select("text_sha256", "keep_id", "batch").repartition(self.buckets, "text_sha256").write.insertInto(self.name)

    def add(self, docs: DataFrame, batch: str) -> DataFrame:
        """Deduplicate a batch, which needs a name of its own, and append its new digests.

        Returns doc_id, keep_id, group_size, kept and text_sha256 for every row of
        the batch. keep_id is the smallest doc_id of the batch's equal texts, or what
        the index holds from an earlier batch; group_size counts rows of the batch.
        Null texts count as empty. Rows that repeat the kept id and text are all
        marked kept; a null id is kept only in a group of null ids. An empty batch gives no row
        and appends none. Adding a batch again under its name, after a failure or not, appends nothing
        twice and gives the same rows; so under a name that was used before, a row with the id and text of one kept then
        is that one, and kept. One batch is added at a time: appends take no lock.
        """
        rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("text_sha256")), "digests")
        groups = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = stored(groups.withColumn("batch", F.lit(batch)), "digest-groups")
        self.append(groups.join(self.read().hint("merge"), "text_sha256", "left_anti"))
        found = groups.select("text_sha256", "group_size").join(self.read().hint("merge"), "text_sha256")
        # written, so that a digest with very many rows can be split over tasks in the next join
        found = stored(found, "digest-found")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)
        return rows.join(found, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """All documents as one batch against ``index``, by default a new one in the shared folder; see `DigestIndex.add`.

    With an index of the caller's, the batch must have a name.
    """
    if index is not None and batch is None:
        raise ValueError("a batch for an index that other batches use needs a name of its own")
    index = index or DigestIndex(docs.sparkSession, shared_path(docs.sparkSession, "digest-index"))
    return index.add(docs, batch or "first")


def deduplicated(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows that stay, one of each group of equal texts that the index didn't hold before, with the columns of ``docs``.

    Of rows that repeat the kept id and text one stays, of groups whose ids are all null too. An empty table stays empty.
    """
    winners = dedup(docs, index, batch).where("kept").select(id_and(F.col("doc_id"), F.col("text_sha256")).alias("name"))
    return chosen(docs, id_and(F.col("doc_id").cast("long"), digest(F.col("text"))), winners)
