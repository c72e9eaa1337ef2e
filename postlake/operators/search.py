"""Search in postings by trigrams: a table of grams says which postings can match, and only those are read and tested."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.feed_text import search_predicate, search_variants

#: Folders that grams are dealt over by hash.
BUCKETS = 64


def _trigrams(low: Column) -> Column:
    """The trigrams of a text, with built-in functions, so that no batch of lists is built outside a row; none begins within a pair of surrogates."""
    return F.regexp_extract_all(low, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(...))"), 1)


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, fields: list[str], path: str) -> None:
    """Write (gram, posting_seq): the trigrams of the fields in lower case, in a folder a bucket of grams.

    A gram that most postings have is spread over all files of its bucket; no group of it is formed.
    """
    own = F.array_distinct(F.concat(*[_trigrams(F.lower(F.coalesce(c, F.lit("")))) for c in fields]))
    grams = rows.select("posting_seq", F.explode(own).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    grams.write.partitionBy("bucket").mode("overwrite").parquet(path)


def needed(pattern: str) -> list[str]:
    """The trigrams that whatever a LIKE pattern matches must hold: those of its runs without a wildcard."""
    return sorted({run[k : k + 3] for run in re.split("[%_]", pattern.lower()) for k in range(len(run) - 2)})


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """(posting_seq) of those that hold all trigrams of a variant of the term; None if a variant has none, as it can match anything."""
    variants = [needed(v) for v in search_variants(term)]
    if not variants or not all(variants):
        return None
    wanted = sorted({g for v in variants for g in v})
    buckets = [r["b"] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct().collect()]
    table = spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    held = table.groupBy("posting_seq").agg(F.collect_set("gram").alias("grams"))  # the term's own grams at most
    every = [F.size(F.array_intersect("grams", F.array(*map(F.lit, v)))) == len(v) for v in variants]
    return held.where(reduce(lambda a, b: a | b, every)).select("posting_seq")


def search(rows: DataFrame, fields: list[str], path: str, term: str) -> DataFrame:
    """The rows of which a field matches a variant of the term: exactly, after the index that `build` wrote has left out most others."""
    found = candidates(rows.sparkSession, path, term)
    if found is not None:
        rows = rows.join(found, "posting_seq", "left_semi")
    return rows.where(search_predicate(term, fields))
