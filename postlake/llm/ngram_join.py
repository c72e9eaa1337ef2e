"""Similarity self-join of documents by the Jaccard index of their n-gram sets.

Documents with equal sets are one class, which takes part once. MinHash signatures are
cut into bands; classes that share a band's hash, a bucket, are candidates. The candidates of a
bucket are compared on their full sets, block by block, so no pair is ever a row: what leaves a
block is a count of links per class and a spanning forest of them. A pair that shares several
buckets counts in the first of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import chosen, id_and, ids, stored, texts
from postlake.llm.components import components

U = np.uint64
#: Classes, and n-grams, that a side of a block holds about.
BLOCK_ROWS, BLOCK_GRAMS = 256, 400_000


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): as many rows a band as reach ``recall`` at ``threshold`` within the hashes allowed.

    More rows mean fewer candidates below the threshold; recall is 1 - (1 - t^rows)^bands.
    """
    for rows in range(most_hashes, 0, -1):
        bands = most_hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            while bands > 1 and 1 - (1 - threshold**rows) ** (bands - 1) >= recall:
                bands -= 1
            return bands, rows
    raise ValueError("no number of bands reaches that recall")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Grams:
    """Sets of 64-bit hashes of the word n-grams of texts."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: bytes) -> np.ndarray:
        """Sorted; a text of fewer than n words, if not blank, has the one n-gram of all its words."""
        words, known = text.split(), self.known
        if not words:
            return np.empty(0, U)
        if len(known) > 500_000:
            known.clear()
        try:
            h = np.array([known[w] for w in words], U)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], U)
        n = min(self.n, len(h))
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = out * U(0x9E3779B97F4A7C15) + h[k : k + len(out)]
        return np.unique(_mix(out + U(n)))


def _key(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _print(text: Column) -> Column:
    """With its id, what a class's text is found by again; see `_linked` for the check of it."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signed(docs: DataFrame, n: int, bands: int, rows: int, digest: bool = False) -> DataFrame:
    """doc_id, print, set (its n-gram set's name), grams (its size), band hashes and, if asked for, the text's digest.

    Blank texts have no band hashes.
    """
    more = [_print(F.col("text")).alias("print")] + [_digest(F.col("text")).alias("digest")] * digest
    k = bands * rows
    seeds = _mix(np.arange(1, 2 * k + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    a, b = seeds[:k] | U(1), seeds[k:]
    spread = _mix(np.arange(1, rows + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
    label = _mix(np.arange(1, bands + 1, dtype=U))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams_of = _Grams(n)
        for batch in batches:
            out = []
            for text in batch["text"]:
                grams = grams_of(text.encode())
                if not len(grams):
                    out.append((_key(grams), 0, None))
                    continue
                low = None
                for at in range(0, len(grams), 2048):
                    # the high bits of a product with an odd number are well mixed
                    part = (np.multiply.outer(a, grams[at : at + 2048]) + b[:, None]).min(axis=1)
                    low = part if low is None else np.minimum(low, part)
                hashed = _mix((_mix(low).reshape(bands, rows) * spread).sum(axis=1, dtype=U) + label)
                out.append((_key(grams), len(grams), hashed.view(np.int64)))
            frame = pd.DataFrame(out, columns=["set", "grams", "bands"])
            frame.insert(0, "doc_id", ids(batch).array)
            frame.insert(1, "print", batch["print"].array)
            if digest:
                frame["digest"] = batch["digest"].array
            yield frame

    return texts(docs, *more).mapInPandas(run, "doc_id long, print long, set long, grams long, bands array<long>" + ", digest string" * digest)


def _similar(sets: list[np.ndarray], left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs with a Jaccard index of at least ``threshold``.

    All pairs if ``left`` is 0; else only those of one of the first ``left`` sets and one of the others.
    """
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        shared = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
    else:
        owner = np.repeat(np.arange(len(sets)), size)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        fresh = np.concatenate([[True], every[1:] != every[:-1]])
        column = np.cumsum(fresh) - 1
        often = np.bincount(column) > 1  # an n-gram of one set alone is in no intersection
        keep = often[column]
        owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        step = 4096
        cuts = np.searchsorted(column, np.arange(0, int(often.sum()) + step, step))
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            m = np.zeros((len(sets), step), np.float32)
            m[owner[lo:hi], column[lo:hi] - k * step] = 1
            shared += m @ m.T
    union = size[:, None] + size[None, :] - shared
    good = np.triu(shared >= threshold * union - 1e-6, 1)
    if left:
        good[:left, :left] = good[left:, left:] = False
    return np.nonzero(good)


def _hashed(docs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """(set, hashes): the sorted n-gram hashes, 8 bytes each, of each of ``sets`` (set, member, print), found again by id and print of its text.

    Texts are cut into n-grams once here, however many blocks a set takes part in.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams_of = _Grams(n)
        for batch in batches:
            found = [(name, grams_of(text.encode())) for name, text in zip(batch["set"], batch["text"], strict=True)]
            # else a row with the same id and print, and another text
            yield pd.DataFrame([(name, grams.tobytes()) for name, grams in found if _key(grams) == name], columns=["set", "hashes"])

    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), _print(F.col("text")).alias("_print"), F.coalesce("text", F.lit("")).alias("text"))
    texts = whole.join(sets, F.col("_id").eqNullSafe(F.col("member")) & (F.col("_print") == F.col("print"))).select("set", "text")
    return texts.mapInPandas(run, "set long, hashes binary").dropDuplicates(["set"])


def _linked(rows: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Compare the classes of each block; rows come sorted by block.

    Yields, for each class with links in a block, their number and the class that it
    hangs on in the block's spanning forest.
    """
    block, members = None, {}

    def closed() -> pd.DataFrame | None:
        sides = sorted(members.items(), key=lambda x: (x[1][0], x[0]))
        left = sum(m[0] == 0 for _, m in sides) if block[1] else 0
        if len(sides) < 2 or block[1] and left in (0, len(sides)):
            return None
        i, j = _similar([m[1] for _, m in sides], left, threshold)
        # a pair counts in the first bucket that it shares
        own = np.array([m[2] for _, m in sides])
        kept = np.zeros(len(i), bool)
        for at in range(0, len(i), 50_000):
            x, y = own[i[at : at + 50_000]], own[j[at : at + 50_000]]
            first = ((x == y) & (x != 0)).argmax(axis=1)
            kept[at : at + 50_000] = x[np.arange(len(x)), first] == block[2]
        i, j = i[kept], j[kept]
        if not len(i):
            return None
        names = np.array([k for k, _ in sides])
        parent = list(range(len(sides)))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = top(x), top(y)
            parent[max(x, y)] = min(x, y)
        links = np.bincount(i, minlength=len(sides)) + np.bincount(j, minlength=len(sides))
        at = np.flatnonzero(links)
        return pd.DataFrame({"set": names[at], "links": links[at], "to": names[[top(int(x)) for x in at]]})

    columns = ("block", "two", "bucket", "side", "set", "own", "hashes")
    for batch in rows:
        for b, two, bucket, side, name, own, hashes in zip(*(batch[c] for c in columns), strict=True):
            if block is not None and block[0] != b:
                if (out := closed()) is not None:
                    yield out
                members = {}
            block = (b, two, bucket)
            members[name] = (side, np.frombuffer(hashes, U), own)
    if block is not None and (out := closed()) is not None:
        yield out


def _buckets(sets: DataFrame) -> DataFrame:
    """(set, bucket, n, g): the buckets of several sets that each set is in, their sets and n-grams.

    Of buckets with the same sets one stays: equal numbers, ends and hashes of them name a bucket's sets.
    """
    every = sets.where("grams > 0").select("set", "grams", F.explode("bands").alias("bucket"))
    per = every.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("grams").alias("g"), F.min("set").alias("low"), F.max("set").alias("high"),
        F.bit_xor(F.xxhash64("set")).alias("h"), F.bit_xor(F.xxhash64("set", F.lit(7))).alias("i"),
    ).where("n > 1")
    # written, so that in the join a bucket with very many sets can be split over tasks
    kept = stored(per.groupBy("n", "low", "high", "h", "i").agg(F.min(F.struct("bucket", "g")).alias("b")).select("b.bucket", "n", "b.g"), "buckets")
    return every.select("set", "bucket").join(kept, "bucket")


def _blocks(placed: DataFrame, threshold: float) -> DataFrame:
    """A row per class and block that it takes part in: set, member, print, own, bucket, block, two and side.

    A small bucket is one block. A larger one is cut by size, into cells whose bounds grow
    by 1 / threshold, so that links lie within a cell or between neighbouring ones, and
    cells into parts by hash; every two parts of a cell or of neighbours are a block.
    """
    cell = F.floor(F.log(F.col("grams").cast("double")) / -math.log(threshold) + 1e-9)
    parts = lambda n, grams: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(grams / BLOCK_GRAMS)).cast("int")
    whole = (F.col("n") <= BLOCK_ROWS) & (F.col("g") <= BLOCK_GRAMS)
    keep = ["set", "member", "print", "own", "bucket"]
    small = placed.where(whole).select(*keep, F.col("bucket").alias("block"), F.lit(False).alias("two"), F.lit(0).alias("side"))
    base = placed.where(~whole).withColumn("cell", cell)
    cells = base.groupBy("bucket", "cell").agg(parts(F.count(F.lit(1)), F.sum("grams")).alias("parts"))
    cells = stored(cells, "cells")
    after = cells.select("bucket", (F.col("cell") - 1).alias("cell"), F.col("parts").alias("parts_above"))
    before = cells.select("bucket", (F.col("cell") + 1).alias("cell"), F.col("parts").alias("parts_below"))
    # written, as the counts of buckets are, so that the next join can split a cell
    shape = stored(cells.join(after, ["bucket", "cell"], "left").join(before, ["bucket", "cell"], "left"), "cell-shapes")
    own = base.join(shape, ["bucket", "cell"])
    part = F.pmod(F.xxhash64("set", F.lit(5)), F.col("parts")).cast("int")

    def named(c: Column, p: Column, d: Column, q: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("bucket", c, p, d, q).alias("block"), (~((c == d) & (p == q))).alias("two"), side.alias("side"))

    every = lambda n: F.sequence(F.lit(0), n - 1)
    c, me = F.col("cell"), F.col("_part")
    none = F.array().cast("array<struct<block:bigint,two:boolean,side:int>>")
    same = F.transform(every(F.col("parts")), lambda q: named(c, F.least(me, q), c, F.greatest(me, q), F.when(me <= q, 0).otherwise(1)))
    above = F.when(F.col("parts_above").isNotNull(), F.transform(every(F.col("parts_above")), lambda q: named(c, me, c + 1, q, F.lit(0)))).otherwise(none)
    below = F.when(F.col("parts_below").isNotNull(), F.transform(every(F.col("parts_below")), lambda q: named(c - 1, q, c, me, F.lit(1)))).otherwise(none)
    large = own.withColumn("_part", part).select(*keep, F.explode(F.concat(same, above, below)).alias("p")).select(*keep, "p.*")
    return small.unionByName(large)


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, set_id and set_size.

    set_id is the smallest doc_id of the documents with the same n-gram set, set_size
    counts them, and n_links counts the other sets with a Jaccard index of at
    least ``threshold``. class_id is the smallest doc_id of those reached over links.
    Null and blank texts have the empty set and no links; shorter texts than n words have one
    n-gram. A null doc_id is never a class_id unless all of the class are null. An empty table gives no row.
    Pairs at the threshold become candidates with a probability of ``recall`` at least, more similar ones more often.
    """
    table, named = _classes(docs, n, threshold, recall)
    return table.select("doc_id", "set").join(named, "set").select("doc_id", "class_id", "n_links", "set_id", "set_size")


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The signatures, and a row per set: set, root (the set that names its class), class_id, n_links, set_id and set_size."""
    bands, rows = bands_for(threshold, recall)
    table = stored(signed(docs, n, bands, rows, digest), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print")).alias("least")
    sets = table.groupBy("set").agg(least, F.count(F.lit(1)).alias("set_size"), F.max("grams").alias("grams"), F.first("bands").alias("bands"))
    sets = stored(sets.select("set", F.col("least.doc_id").alias("member"), F.col("least.print").alias("print"), "set_size", "grams", "bands"), "sets")
    # ``own``: a set's band hashes, those of buckets that stayed; a set is in as many as there are bands at most
    mine = F.collect_set("bucket").over(Window.partitionBy("set"))
    placed = _buckets(sets).withColumn("_mine", mine).join(sets.select("set", "member", "print", "grams", "bands"), "set")
    own = F.transform("bands", lambda b: F.when(F.array_contains("_mine", b), b).otherwise(F.lit(0)))
    placed = stored(placed.withColumn("own", own).drop("_mine", "bands"), "placed")
    hashes = stored(_hashed(docs, placed.select("set", "member", "print").distinct(), n), "set-hashes")
    blocks = _blocks(placed, threshold).select("block", "two", "bucket", "side", "set", "own")
    dealt = blocks.join(hashes, "set").repartition("block").sortWithinPartitions("block", "side", "set")
    found = dealt.mapInPandas(lambda it: _linked(it, threshold), "set long, links long, to long")
    found = stored(found, "links")
    links = found.groupBy("set").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("set").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("set"), "root")
    named = sets.select("set", "member", "set_size").join(links, "set", "left").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    classes = named.groupBy("root").agg(F.min("member").alias("class_id"))
    n_links = F.coalesce("n_links", F.lit(0)).alias("n_links")
    return table, named.join(classes, "root").select("set", "root", "class_id", n_links, F.col("member").alias("set_id"), "set_size")


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does: one with the class id.

    A document is an id and a text, so each class keeps its own, whatever ids are null or
    shared with other classes. Of a class's texts with that id, the one of the smallest set
    and digest stays; rows that repeat its id and text are reduced to one row. Blank texts are a class.
    An empty table stays empty.
    """
    table, named = _classes(docs, n, threshold, recall, digest=True)
    rows = table.select("doc_id", "set", "digest").join(named.select("set", "root", "class_id"), "set")
    least = F.min(F.struct("set", "doc_id", "digest")).alias("least")
    keep = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(least)
    name = id_and(F.col("doc_id").cast("long"), _digest(F.col("text")))
    return chosen(docs, name, keep.select(id_and(F.col("least.doc_id"), F.col("least.digest")).alias("name")))
