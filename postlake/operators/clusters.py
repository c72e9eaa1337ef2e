"""Duplicates that follow from more than one key: the batch rule over two keys, and transitive clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.operators import dedup
from postlake.plans.stages import staged


def admitted(rows: DataFrame, one: str = "content_hash", two: str = "dedup_key") -> DataFrame:
    """(posting_seq) of the rows that stay when a row whose ``one`` or ``two`` an earlier admitted row has is dropped.

    Rows arrive by posting_seq, which must be unique; null keys count as empty texts. Of rows equal in both keys only
    the first can stay. A pair of keys that is the earliest open one for both is admitted; all others with either
    key are then dropped. Rounds go on until no pair is open: one for most pairs, more where keys chain. Each
    round aggregates minima by key, so a frequent key is no larger group than others. No rows give no rows.
    """
    keys = [F.coalesce(F.col(k), F.lit("")).alias(n) for k, n in ((one, "one"), (two, "two"))]
    pairs = staged(rows.select("posting_seq", *keys).groupBy("one", "two").agg(F.min("posting_seq").alias("posting_seq")), "admitted-open")
    found = []
    while True:
        firsts = [pairs.groupBy(k).agg(F.min("posting_seq").alias("posting_seq")).select("posting_seq") for k in ("one", "two")]
        won = staged(pairs.join(firsts[0].join(firsts[1], "posting_seq"), "posting_seq"), "admitted-won")
        found.append(won.select("posting_seq"))
        pairs = staged(pairs.join(won.select("one"), "one", "left_anti").join(won.select("two"), "two", "left_anti"), "admitted-open")
        if pairs.isEmpty():
            return reduce(DataFrame.unionByName, found)


def smallest_reached(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that links reach from it.

    Each round ties a node's larger neighbours, then its smaller ones, to the smallest that it knows, so that a
    component shrinks to a star in about the logarithm of its longest path. Only minima by node are aggregated.
    """
    ties = staged(edges.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("low")).where("big <> low").distinct(), "cluster-ties")
    while True:
        both = ties.unionByName(ties.select(F.col("low").alias("big"), F.col("big").alias("low")))
        known = both.groupBy("big").agg(F.least(F.min("low"), F.col("big")).alias("least"))
        up = both.join(known, "big").where("low > big").select(F.col("low").alias("big"), F.col("least").alias("low")).distinct()
        known = up.groupBy("big").agg(F.min("low").alias("least"))
        down = up.join(known, "big").select(F.col("low").alias("big"), F.col("least").alias("low"))
        after = staged(down.unionByName(known.select("big", F.col("least").alias("low"))).where("big <> low").distinct(), "cluster-ties")
        changed = not after.exceptAll(ties).isEmpty() or not ties.exceptAll(after).isEmpty()
        ties = after
        if not changed:
            roots = ties.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            return ties.select(F.col("big").alias("node"), F.col("low").alias("root")).unionByName(roots)


def duplicate_clusters(postings: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(posting_seq, cluster_id, cluster_size): postings that matches of `dedup.fuzzy_duplicates` join, directly or through others.

    ``cluster_id`` is the smallest posting_seq of the cluster, whatever the order of rows; a posting without a match is
    its own cluster. Postings must have the columns of `dedup.with_keys` and work_mode, and unique ids. Postings of one
    URL, one source and id, or one company, title, place and mode are tied to the first of them, and of the latter only
    the firsts are compared.
    """
    rows = staged(dedup.slim(postings), "cluster-rows")
    kind = ["company_key", "title_key", "location_key", "mode"]

    def star(df: DataFrame, *keys: str) -> DataFrame:
        first = df.groupBy(*keys).agg(F.min("posting_seq").alias("a"))
        return df.join(first, list(keys)).select("a", F.col("posting_seq").alias("b"))

    named = rows.where("company_key <> ''")
    kinds = staged(named.groupBy(*kind).agg(F.min("posting_seq").alias("a")), "cluster-kinds")
    others = kinds.toDF(*dedup.HISTORY_KIND, "b")
    alike = dedup.similar_kinds(kinds, others, dedup.company_pairs(kinds, kinds), threshold).select("a", "b")
    by_id = rows.where("external_id <> '' and source <> ''")
    edges = star(rows.where("url_key <> ''"), "url_key").unionByName(star(by_id, "source", "external_id")).unionByName(star(named, *kind)).unionByName(alike)
    reached = staged(smallest_reached(edges), "cluster-roots")
    named_roots = rows.select("posting_seq").join(reached, F.col("posting_seq") == F.col("node"), "left").select("posting_seq", F.coalesce("root", "posting_seq").alias("cluster_id"))
    sizes = named_roots.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return named_roots.join(sizes, "cluster_id").select("posting_seq", "cluster_id", "cluster_size")
