"""Deduplication of postings: by keys, against history, and fuzzily by company and title."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import text
from postlake.plans.stages import staged


def with_keys(postings: DataFrame) -> DataFrame:
    """Add the keys of title, company, location and URL, and the two keys made of them."""
    c = F.col
    keys = {"url_key": text.normalize_url(c("url")), "company_key": text.normalize_company(c("company")), "title_key": text.title_key(c("title")), "location_key": text.normalize_location(c("location"))}
    made = postings.withColumns(keys).withColumn("dedup_key", F.concat_ws("|", "title_key", "company_key", "location_key"))
    return made.withColumn("content_hash", text.hash_of(c("dedup_key"), c("url"), c("external_id")))


def first_per(postings: DataFrame, *keys: str) -> DataFrame:
    """The earliest posting of each group of equal keys, by partial aggregation rather than a window."""
    first = F.min_by(F.struct(*postings.columns), "posting_seq").alias("p")
    return postings.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first).select("p.*")


def not_known(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """Incoming postings whose canonical URL and (source, external id) history lacks: two anti joins."""
    urls = history.where("url_key <> ''").select("url_key").distinct()
    ids = history.where("external_id <> ''").select("source", "external_id").distinct()
    return incoming.join(urls, "url_key", "left_anti").join(ids, ["source", "external_id"], "left_anti")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel additions."""
    masks: dict[str, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _indel(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def _jaccard(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return 100.0 * len(x & y) / len(x | y) if x and y else 0.0


def token_sort_ratio(a: Column, b: Column, similarity: str = "indel") -> Column:
    """Similarity, 0 to 100, of two texts of sorted words: normalised Indel, or Jaccard of the words."""
    one: Callable[[str, str], float] = {"indel": _indel, "jaccard": _jaccard}[similarity]

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(" ".join(sorted(p.split())), " ".join(sorted(q.split()))) for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def _sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " +")), " ")


def _grams(c: Column) -> Column:
    positions = F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1)))
    return F.array_distinct(F.transform(positions, lambda k: F.substring(c, k, F.lit(3))))


def _numbered_grams(c: Column) -> Column:
    """All n + 2 grams of three characters of a text of n with two edge signs at either end; the k-th equal one has the number k."""
    edged = F.concat(F.lit("\x01\x01"), c, F.lit("\x02\x02"))
    grams = F.transform(F.sequence(F.lit(1), F.length(c) + 2), lambda k: F.substring(edged, k, F.lit(3)))
    number = lambda all_, x, k: F.size(F.filter(F.slice(all_, 1, k + 1), lambda y: y == x)).cast("string")
    return text.let(grams, lambda g: F.transform(g, lambda x, k: F.concat(x, number(g, x, k))))


def similar_texts(left: DataFrame, right: DataFrame, threshold: float, *group: str) -> DataFrame:
    """(a, b): pairs of different texts of ``text``, of one ``group``, whose normalised Indel similarity is at least ``threshold``.

    Of texts of n and m characters with a common subsequence of L, taking out the n - L others ends at most 3 grams each and
    putting in m - L at most 2 each. So a text that is similar enough keeps all but ``ended`` of its n + 2 grams, and the
    ``ended`` + k rarest of either have k in common, where that many are left: only texts with k rare grams in common, and of
    lengths that can do, are compared. No pair is lost, and a group of many texts isn't compared pair by pair.
    """
    t = threshold
    shortest = t / (2 - t) if 2.5 * t > 2 else (2 - t) / t  # the other length, by this one's, at which most grams end
    ended = F.floor(F.length("text") * ((3 - 2.5 * t) + shortest * (2 - 2.5 * t)) + 1e-9).cast("int")
    common = F.least(F.lit(4), F.length("text") + 2 - ended)

    def own(df: DataFrame, name: str) -> DataFrame:
        return staged(df.select(*group, "text").distinct(), name)

    left, right = own(left, "texts-left"), own(right, "texts-right")
    texts = staged(left.select("text").union(right.select("text")).distinct().withColumn("grams", _numbered_grams(F.col("text"))), "texts-grams")
    each = texts.select("text", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("order")  # a text's own grams
    listed = each.join(counts, "gram").groupBy("text").agg(order).withColumns({"length": F.length("text"), "common": common})
    # texts go by number through the join of grams
    rare = staged(listed.select(F.xxhash64("text").alias("name"), "text", "length", "common", F.explode(F.slice("order", 1, ended + common)).alias("o")).select("name", "text", "length", "common", "o.gram"), "texts-rare")
    sides = []
    for df, x in ((left, "a"), (right, "b")):
        sides.append(df.join(rare, "text").select(*group, "gram", F.struct("length", "common", "name").alias(x)))
    can = 200 * F.least("a.length", "b.length") >= 100 * t * (F.col("a.length") + F.col("b.length"))
    met = sides[0].join(sides[1], [*group, "gram"]).where(can & (F.col("a.name") != F.col("b.name")))
    often = met.groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.least("a.common", "b.common"))
    names = rare.select("name", "text").distinct()
    pairs = often.select(F.col("a.name").alias("_a"), F.col("b.name").alias("_b")).distinct()
    pairs = pairs.join(names.toDF("_a", "a"), "_a").join(names.toDF("_b", "b"), "_b").where("a <> b").select("a", "b").distinct()
    return pairs.where(token_sort_ratio(F.col("a"), F.col("b")) >= 100 * t)


def company_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) of matching company keys: equal, one within the other, or nearly equal sorted words.

    Only distinct names are compared, and candidates come from rare grams of three characters alone: of a name that
    another holds, its rarest gram is in the other; nearly equal ones are found by `similar_texts`.
    """

    def named(df: DataFrame) -> DataFrame:
        names = df.where("company_key <> ''").select(F.col("company_key").alias("name")).distinct()
        # written, as names are read several times
        return staged(names.withColumn("words", _sorted_words(F.col("name"))).withColumn("grams", _grams(F.col("name"))), "company-names")

    a, b = named(left), named(right)
    every = a.select(F.explode("grams").alias("gram")).unionByName(b.select(F.explode("grams").alias("gram")))
    counts = staged(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "company-grams")

    def held(inner: DataFrame, outer: DataFrame) -> DataFrame:
        """(inner, outer): names of four characters or more that lie within others."""
        long = inner.where("length(name) >= 4").select("name", F.explode("grams").alias("gram"))
        rare = long.join(counts, "gram").groupBy(F.col("name").alias("inner")).agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
        every = outer.where("length(name) >= 4").select(F.col("name").alias("outer"), F.explode("grams").alias("gram"))
        return rare.join(every, "gram").where(F.contains("outer", "inner")).select("inner", "outer")

    words = lambda df: df.select(F.col("words").alias("text"))
    near = similar_texts(words(a), words(b), 0.9).toDF("a_words", "b_words")
    of = lambda df, x: df.select(F.col("name").alias(x), F.col("words").alias(f"{x}_words"))
    close = near.join(of(a, "a"), "a_words").join(of(b, "b"), "b_words").select("a", "b")
    same = a.select(F.col("name").alias("a"), "words").join(b.select(F.col("name").alias("b"), "words"), "words").select("a", "b")
    within = held(a, b).toDF("a", "b").unionByName(held(b, a).toDF("b", "a").select("a", "b"))
    return same.unionByName(within).unionByName(close).distinct()


#: columns that say what kind of posting a row of history is, in the order of those of incoming rows
HISTORY_KIND = ("h_company", "h_title", "h_location", "h_mode")


def slim(postings: DataFrame, *more: str) -> DataFrame:
    """The columns that matching reads; a missing work mode counts as empty."""
    mode = F.lower(F.coalesce("work_mode", F.lit(""))).alias("mode")
    return postings.select("posting_seq", "source", "external_id", "url_key", "company_key", "title_key", "location_key", mode, *more)


def similar_kinds(mine: DataFrame, theirs: DataFrame, companies: DataFrame, threshold: float) -> DataFrame:
    """Pairs of kinds with matching companies, compatible places and similar titles, with all columns of both.

    ``companies`` holds the pairs (a, b) of matching names. Titles are compared by `similar_texts` within a company's names, each
    distinct pair once; kinds meet only by a pair of titles that is similar.
    """
    place = (
        (F.col("location_key") == "") | (F.col("h_location") == "") | (F.col("location_key") == "remoto") | (F.col("h_location") == "remoto")
        | (F.col("mode") == "remote") | (F.col("h_mode") == "remote") | F.contains("location_key", "h_location") | F.contains("h_location", "location_key")
    )
    of = mine.join(companies.toDF("company_key", "h_company"), "company_key")
    titles = of.select("h_company", F.col("title_key").alias("text")), theirs.select("h_company", F.col("h_title").alias("text"))
    alike = similar_texts(*titles, threshold, "h_company").toDF("title_key", "h_title")
    met = of.withColumn("h_title", F.col("title_key")).unionByName(of.join(alike, "title_key").select(*of.columns, "h_title"))
    return met.join(theirs, ["h_company", "h_title"]).where(place)


@dataclass
class Known:
    """What history has, with the largest id (``duplicate_of``) of each: by content_hash, url_key, source and external_id, and by kind.

    ``names`` are its companies (company_key); ``kinds`` gives the kinds of at least the companies (h_company) that it is asked for.
    """

    by_hash: DataFrame
    by_url: DataFrame
    by_id: DataFrame
    names: DataFrame
    kinds: Callable[[DataFrame], DataFrame]


BY_ID = ["source", "external_id"]
KIND = ["company_key", "title_key", "location_key", "mode"]


def latest_of(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max("posting_seq").alias("duplicate_of"))


def known(history: DataFrame) -> Known:
    """Of a table with the columns of `with_keys` and work_mode."""
    rows = staged(slim(history, "content_hash"), "known-history")  # keys are read several times
    # of history postings alike in company, title, place and mode, only the latest can win
    kinds = latest_of(rows, *KIND).toDF(*HISTORY_KIND, "duplicate_of")
    return Known(latest_of(rows, "content_hash"), latest_of(rows, "url_key"), latest_of(rows, *BY_ID), rows.select("company_key").distinct(), lambda _: kinds)


def matches(incoming: DataFrame, history: Known, threshold: float = 0.88) -> DataFrame:
    """(posting_seq, duplicate_of): for each incoming posting the matching one of history with the largest id.

    A match is an equal URL, or the same source and external id, or matching companies with compatible places and similar titles.
    """
    mine = staged(slim(incoming), "fuzzy-incoming")
    by_url = mine.where("url_key <> ''").join(history.by_url, "url_key")
    by_id = mine.where("external_id <> '' and source <> ''").join(history.by_id, BY_ID)
    pairs = staged(company_pairs(mine, history.names), "fuzzy-companies")
    theirs = history.kinds(pairs.select(F.col("b").alias("h_company")).distinct())
    by_kind = similar_kinds(mine.select(*KIND).distinct(), theirs, pairs, threshold).groupBy(*KIND).agg(F.max("duplicate_of").alias("duplicate_of"))
    every = [df.select("posting_seq", "duplicate_of") for df in (by_url, by_id, mine.join(by_kind, KIND))]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("posting_seq").agg(F.max("duplicate_of").alias("duplicate_of"))


def fuzzy_duplicates(incoming: DataFrame, history: DataFrame, threshold: float = 0.88) -> DataFrame:
    """`matches` with a table of history; both sides have the columns of `with_keys` and work_mode."""
    return matches(incoming, known(history), threshold)


def best_per_url(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per ``keys`` and lower-case URL: the best score, nulls last, then the largest id; empty URLs all stay."""
    url = F.lower(F.trim(F.coalesce("url", F.lit(""))))
    order = Window.partitionBy(*keys, url).orderBy(F.desc_nulls_last("score"), F.desc("posting_seq"))
    kept = rows.where(url != "").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return kept.unionByName(rows.where(url == ""))
