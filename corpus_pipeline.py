"""A pipeline over `documents`: toxicity, exact and near duplicates, mixing, packing.

Every stage gets all that the one before it kept, written as Parquet and read
again; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlake.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from postlake.llm.common import shared_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, doesn't reject.

    Null and blank texts match nothing and stay; repeated rows share their fate; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id's, or one of those without an id if all lack one.

    Null texts count as empty, so of null and empty ones one document stays; repeated rows are one. An empty table stays empty.
    """
    return exact_dedup.deduplicated(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id.

    Blank texts are a class of their own; rows that repeat an id and a text are one. An empty table stays empty.
    """
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its slots.

    Blank texts have no words, so the mix takes none; a null source is one of its own. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences.

    A document that the mix repeats has the pieces of each copy; nulls and repeated rows are packed like others. An empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("exact_dedup", unique), ("ngram_join", distinct), ("mixing", mixed), ("packing", packed)]

#: SQL can't express the learned model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all of `documents`; each one's rows are written to the shared folder and read again.

    Null ids and texts, repeated rows and an empty table pass as each stage says.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
