"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session in local mode that names none (as in tests) gets a temporary one; on a cluster, where
    executors would write to disks of their own, that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[app]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a slim table to the shared folder and read it again.

    This cuts the lineage so that a lost executor repeats only reads, and it
    makes what follows see one fixed set of rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ranked(df: DataFrame, group: list[str], order: list[str], rows: int, least: int = 32, target: int = 50_000) -> DataFrame:
    """Add ``rank`` (from 0, gapless) within each group, without one task per group.

    Rows of a group are dealt by hash over sub-buckets; each sub-bucket is
    numbered on its own and starts where the counts of the earlier ones end.
    The table of counts has a row per group and sub-bucket. ``order`` should tell equal rows apart by
    a number that was written with them, as else they share a sub-bucket.
    """
    parts = max(least, -(-rows // target))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(parts)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    return (
        df.join(starts, [*group, "_part"])
        .withColumn("rank", F.row_number().over(inside) - 1 + F.col("_start"))
        .drop("_part", "_start")
    )


def id_and(doc_id: Column, digest: Column) -> Column:
    """A document's name, which no null in it makes null: its digest and its id."""
    return F.concat_ws(":", digest, F.coalesce(doc_id.cast("string"), F.lit("null")))


def chosen(docs: DataFrame, name: Column, names: DataFrame) -> DataFrame:
    """One row of ``docs``, with all its columns, for each ``name`` that is in ``names`` (name).

    Rows travel as one struct beside their name, so no column of theirs clashes; as the name alone is the
    key of the semi join and of what drops repeats, whole texts are shuffled once.
    """
    rows = docs.select(F.struct("*").alias("row"), name.alias("name"))
    return rows.join(names.select("name"), "name", "left_semi").dropDuplicates(["name"]).select("row.*")


#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and label of at most ``rows`` different texts of labelled documents outside the held-out fold.

    Texts that are equal but for runs of white space count once, lest copies weigh as
    evidence: the smallest doc_id stays, with its label (the smallest one if it has several). Of
    these, those with the smallest hashes of their ids are taken, so the same rows come each
    time; that table of ids and digests, bounded by ``rows``, is broadcast.
    """
    labelled = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.col(label).cast("int")).alias("label"))
    )
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(text, SPACE, " ").cast("binary"), 256)).alias("_digest")
    chosen = (
        docs.where(~held_out(F.col("doc_id")))
        .select("doc_id", digest)
        .join(labelled, "doc_id")
        .groupBy("_digest")
        .agg(F.min(F.struct("doc_id", "label")).alias("_first"))
        .select("_first.*", "_digest")
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "_digest")
        .limit(rows)
    )
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen.withColumnRenamed("_digest", "_kept")), "doc_id")
    found = found.withColumn("_digest", digest).where("_digest = _kept")
    # rows that repeat the id and text, if white space tells them apart, give the smallest text
    return stored(found.groupBy("_digest").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label"), "labelled")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, no_id, text and ``more``: no nulls, as a null among ids would make pandas round them."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"), *more
    )


def ids(batch):
    """The ids of a batch of `texts`, with their nulls."""
    return batch["doc_id"].astype("Int64").mask(batch["no_id"].astype(bool))
