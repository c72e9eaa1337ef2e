"""Ranked lexical search of a set of queries (items) over all documents, by pipelined term partitioning.

Terms are dealt over owners by their frequency, the rarest to the first one. Each item's bundle, its sparse
accumulators of documents, passes through the owners' stages in turn: a stage cogroups the bundles with its owner's
postings by block of documents and adds integer contributions. The last stage selects.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import stored

#: Items and their terms that are searched for at a time: what is sent to all tasks.
GROUP_ITEMS, GROUP_TERMS = 512, 200_000
#: Documents of a block, about, and blocks at least.
BLOCK_DOCS, LEAST_BLOCKS = 4096, 64
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: No document has a larger contribution for a term of weight 1.
MOST = 1_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def counted(text: bytes) -> tuple[int, Counter]:
    """Number of the terms of a text, and each term's occurrences.

    Terms are runs of ASCII letters, in lower case, digits and characters beyond ASCII.
    """
    text, n, found, at = text.translate(_FOLD), 0, Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        words = text[at : end if end >= 0 else len(text)].split()
        n += len(words)
        found.update(words)
        at = end if end >= 0 else len(text)
    return n, found


def _item_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id, term and how often the item's text has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(t or b"")[1] for t in batch.column("text").to_pylist()]
            again = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            terms, times = [t for x in found for t in x], [n for x in found for n in x.values()]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(again), batch.column("item_id").take(again), pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["item", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, "item long, item_id long, term binary, times long"), "item-terms")


def _groups(terms: DataFrame) -> tuple[DataFrame, int]:
    """The items' terms with a group, and the number of groups, none of which is over the limits unless it is one item."""
    n = terms.agg(F.count_distinct("item").alias("items"), F.count(F.lit(1)).alias("terms")).first()
    groups = max(1, -(-n["items"] // GROUP_ITEMS), -(-n["terms"] // GROUP_TERMS))
    while True:
        dealt = terms.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
        sizes = dealt.groupBy("group").agg(F.count_distinct("item").alias("items"), F.count(F.lit(1)).alias("terms"))
        if sizes.where(f"items > 1 and (items > {GROUP_ITEMS} or terms > {GROUP_TERMS})").isEmpty():
            return dealt, groups
        groups *= 2


def _held(docs: DataFrame, names: dict[bytes, int]) -> DataFrame:
    """row (a number), doc_id, n (its terms), and the searched terms that it has (numbers) with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, times = [], [], []
            for text in batch.column("text"):
                size, found = counted(text.as_py() or b"")
                own = {names[t]: k for t, k in found.items() if t in names}
                n.append(size)
                terms.append(list(own))
                times.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")
    # numbered as it is written, so that rows keep their numbers
    return stored(held.select(F.monotonically_increasing_id().alias("row"), "*"), "held-terms")


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of lists, and their numbers per list."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(values).to_numpy(zero_copy_only=False), pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)


def _list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _owned(held: DataFrame, block: Column, owner: np.ndarray, stage: int, every: bool) -> DataFrame:
    """Postings of an owner's terms, a row per document: those that have one, or ``every`` one with a searched term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (terms, sizes), (times, _) = _lists(batch.column("terms")), _lists(batch.column("times"))
            mine = owner[terms] == stage
            kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=mine, minlength=len(sizes)).astype(np.int64)
            rows = np.flatnonzero(sizes if every else kept)
            if len(rows):
                named = [batch.column(c).take(pa.array(rows)) for c in ("block", "row", "doc_id", "n")]
                lists = [_list_array(x[mine], kept[rows], kind) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*named, *lists], ["block", "row", "doc_id", "n", "terms", "times"])

    columns = "block int, row long, doc_id long, n long, terms array<int>, times array<long>"
    return held.select(block.alias("block"), "row", "doc_id", "n", "terms", "times").mapInArrow(run, columns)


BUNDLES = "block int, item int, rows array<long>, scores array<long>"
PICKED = "item int, doc_id long, score long"


class _Stage:
    """What a stage does to a block: ``uses`` has, per term, the items that have it and how often, ``rest`` what later stages can add at most."""

    def __init__(self, uses: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, rest: np.ndarray, top: int, last: bool):
        self.uses, self.weights, self.n_docs, self.n_terms, self.rest, self.top, self.last = uses, weights, n_docs, n_terms, rest, top, last

    def function(self) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda bundles, postings: self(bundles, postings)

    def __call__(self, bundles: pa.Table, postings: pa.Table) -> pa.Table:
        (before, sizes), (scores, _) = _lists(bundles.column("rows")), _lists(bundles.column("scores"))
        mine = postings.column("row").to_numpy()
        rows = np.union1d(before, mine)
        total = np.zeros((len(self.rest), len(rows)), np.int64)
        total[np.repeat(bundles.column("item").to_numpy(), sizes), np.searchsorted(rows, before)] = scores
        self._add(total, np.searchsorted(rows, mine), postings)
        return self._picked(total, rows, mine, postings) if self.last else self._kept(total, rows, postings, bundles)

    def _add(self, total: np.ndarray, at: np.ndarray, postings: pa.Table) -> None:
        (terms, sizes), (times, _) = _lists(postings.column("terms")), _lists(postings.column("times"))
        long = 75 + 25 * self.n_docs * postings.column("n").to_numpy() // self.n_terms
        at, long = np.repeat(at, sizes), np.repeat(long, sizes)
        gained = self.weights[terms] * (1_000_000_000 * times // (1000 * times + 12 * long))
        order = np.argsort(terms, kind="stable")
        cuts = np.flatnonzero(np.diff(terms[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            items, often = self.uses[terms[part[0]]]
            total[np.ix_(items, at[part])] += np.multiply.outer(often, gained[part])

    def _kept(self, total: np.ndarray, rows: np.ndarray, postings: pa.Table, bundles: pa.Table) -> pa.Table:
        """Accumulators that can still reach the block's best: a document that ``top`` others have passed for good can't."""
        if total.shape[1] > self.top:
            least = np.partition(total, total.shape[1] - self.top, axis=1)[:, total.shape[1] - self.top]
        else:
            least = np.zeros(len(total), np.int64)
        item, at = np.nonzero((total > 0) & (total + self.rest[:, None] >= least[:, None]))
        sizes = np.bincount(item, minlength=len(total))
        items = np.flatnonzero(sizes)
        block = (postings if postings.num_rows else bundles).column("block")[0].as_py()
        lists = [_list_array(x, sizes[items], pa.int64()) for x in (rows[at], total[item, at])]
        return pa.Table.from_arrays([pa.array([block] * len(items), pa.int32()), pa.array(items, pa.int32()), *lists], ["block", "item", "rows", "scores"])

    def _picked(self, total: np.ndarray, rows: np.ndarray, mine: np.ndarray, postings: pa.Table) -> pa.Table:
        """The best documents of the block for each item; the last stage's postings name every document."""
        column = postings.column("doc_id").combine_chunks()
        place = np.empty(len(rows), np.int64)
        place[np.searchsorted(rows, mine)] = np.arange(len(mine))
        no_id, doc_id = column.is_null().to_numpy(zero_copy_only=False)[place], column.fill_null(0).to_numpy()[place]
        first = np.empty(len(rows), np.int64)
        first[np.lexsort((rows, doc_id, no_id))] = np.arange(len(rows))
        items, at = [], []
        for item, row in enumerate(total):
            found = np.flatnonzero(row)
            found = found[np.lexsort((first[found], -row[found]))][: self.top]
            items += [item] * len(found)
            at += found.tolist()
        at = np.array(at, np.int64)
        return pa.Table.from_arrays([pa.array(items, pa.int32()), column.take(pa.array(place[at])), pa.array(total[items, at] if items else [], pa.int64())], ["item", "doc_id", "score"])


def _search_group(docs: DataFrame, terms: DataFrame, top: int, owners: int) -> DataFrame:
    """item_id, doc_id, score and rank for the items of a group of `_groups`, whose terms are sent to all tasks."""
    spark = docs.sparkSession
    found = [(r["item"], r["item_id"], bytes(r["term"]), r["times"]) for r in terms.select("item", "item_id", "term", "times").collect()]
    items = sorted({(item, item_id) for item, item_id, *_ in found}, key=lambda x: x[0])
    number, names = {item: k for k, (item, _) in enumerate(items)}, {t: k for k, t in enumerate(sorted({x[2] for x in found}))}
    uses: list[list] = [[] for _ in names]
    for item, _, term, times in found:
        uses[names[term]].append((number[item], times))
    uses = [(np.array([x[0] for x in u]), np.array([x[1] for x in u], np.int64)) for u in uses]

    held = _held(docs, names)
    size = held.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    n_docs, n_terms = size["n_docs"], size["n_terms"]
    # a row per searched term
    df = np.zeros(len(names), np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    # rare terms come first, and every owner has about as many postings
    order = np.argsort(df, kind="stable")
    before = np.concatenate([[0], np.cumsum(df[order])[:-1]])
    owner = np.empty(len(names), np.int64)
    owner[order] = np.minimum(owners - 1, before * owners // max(1, int(df.sum())))
    block = F.pmod(F.xxhash64("row"), F.lit(max(LEAST_BLOCKS, -(-n_docs // BLOCK_DOCS)))).cast("int")

    bundles = spark.createDataFrame([], BUNDLES)
    for k in range(owners):
        rest = np.zeros(len(items), np.int64)
        for t in np.flatnonzero(owner > k):
            rest[uses[t][0]] += uses[t][1] * weights[t] * MOST
        last = k == owners - 1
        stage = _Stage(uses, weights, n_docs, max(1, n_terms), rest, top, last)
        postings = _owned(held, block, owner, k, last)
        bundles = bundles.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(stage.function(), PICKED if last else BUNDLES)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = bundles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    known = spark.createDataFrame([(k, item_id) for k, (_, item_id) in enumerate(items)], "item int, item_id long")
    return ranked.join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 20, owners: int = 3) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents, of all whose score is above 0.

    A document's score sums, over the item's terms with their repeats, w * ((1e9 * tf) div (1000 * tf + 12 * m)), with
    w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 75 + (25 * n * N) div L; N documents have a term, L are their terms,
    n the document's, df the documents with the term and tf its occurrences. Equal scores rank by doc_id, null last.
    Each row of ``docs`` is a document, each row of ``items`` an item, whatever ids repeat or are null; null and blank
    texts have no terms, so they are never found and find nothing. Empty tables give no row. Columns besides the ids
    and texts are not read. Items are searched for in groups of a bounded number of terms, each over all documents.
    An accumulator is dropped only when ``top`` documents of its block are past what it can still reach.
    """
    dealt, groups = _groups(_item_terms(items))
    parts = [dealt.where(F.col("group") == k) for k in range(groups)]
    found = [_search_group(docs, part, top, owners) for part in parts if not part.isEmpty()]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
