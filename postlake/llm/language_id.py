"""Language of texts by Bloom filters of character n-grams, one a language, whose bits lie side by side.

The filters share their hash functions, so the bits of all languages at a position make up one word, a slice; the AND of
an n-gram's slices is the bitmask of the languages that contain it. A text's masks are counted per language, less
what the filter's false positives add on average; the language with most decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ids, stored, texts

U = np.uint64
#: Documents of a language that its n-grams are learned from, about.
LANG_ROWS = 1000
#: Bits of a language's filter for each of its n-grams, and hash functions.
BITS, HASHES = 16, 4
#: An n-gram belongs to a language where it is at least this part as frequent as in the language where it is most so.
SHARE = 0.1
#: Characters that are looked up at a time.
PIECE = 1 << 19
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """The fold that isn't learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, n-gram) of all texts, in bounded parts: each letter, in lower case, with the characters beside it.

    Whatever isn't a letter counts as a space.
    """
    letters = _letters()
    pieces: list[tuple[int, str, bool, bool]] = []
    size = 0

    def read() -> tuple[np.ndarray, np.ndarray]:
        # a space ends each piece, so no n-gram spans two
        codes = np.frombuffer((" " + " ".join(p for _, p, _, _ in pieces) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(p) + 1 for _, p, _, _ in pieces])
        owner = np.repeat([k for k, *_ in pieces], lengths)
        middle = letters[codes]
        ends = np.cumsum(lengths)
        starts = ends - lengths + 1
        # neighbours of a cut are context only
        middle[starts[[before for _, _, before, _ in pieces]]] = False
        middle[ends[[after for *_, after in pieces]] - 1] = False
        plain = np.where(letters[codes], codes, 32).astype(U)
        at = np.flatnonzero(middle)
        return owner[at - 1], plain[at - 1] | plain[at] << U(21) | plain[at + 1] << U(42)

    for k, text in enumerate(found):
        low = text.lower()
        for a in range(0, len(low), PIECE):
            b = min(len(low), a + PIECE)
            part = low[max(0, a - 1) : b + 1]
            pieces.append((k, part, a > 0, b < len(low)))
            size += len(part)
            if size >= PIECE:
                yield read()
                pieces, size = [], 0
    if pieces:
        yield read()


def _positions(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The grams' positions in a filter of ``size``, a power of two, by each hash function."""
    x = (grams ^ (grams >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    step = (x >> U(32)) | U(1)
    for k in range(HASHES):
        yield ((x + U(k) * step) & U(size - 1)).astype(np.int64)


@dataclass
class Filters:
    """Languages, the commonest first, and slices: (position, word), a bit a language, 64 languages a word."""

    languages: list[str]
    slices: np.ndarray

    @classmethod
    def of(cls, languages: list[str], sets: list[np.ndarray]) -> Filters:
        size = 1 << max(6, int(BITS * max(map(len, sets), default=0)).bit_length())
        slices = np.zeros((size, -(-max(1, len(languages)) // 64)), U)
        for k, grams in enumerate(sets):
            for at in _positions(grams.astype(U), size):
                slices[at, k // 64] |= U(1) << U(k % 64)
        return cls(languages, slices)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits; a few more by chance."""
        out = None
        for at in _positions(grams, len(self.slices)):
            out = self.slices[at] if out is None else out & self.slices[at]
        return out

    def chance(self) -> np.ndarray:
        """Per language, the part of the n-grams that it lacks which its filter returns anyway."""
        every = range(len(self.languages))
        return np.array([((self.slices[:, k // 64] >> U(k % 64)) & U(1)).mean() for k in every]) ** HASHES

    def counts(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams per text, per text and language how many n-grams the language has, false positives taken off)."""
        n, own = np.zeros(len(found), np.int64), np.zeros((len(found), len(self.languages)), np.int64)
        for owner, grams in ngrams(found):
            if not len(grams):
                continue
            # the n-grams of a text follow each other
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            n[owner[first]] += np.diff(np.append(first, len(owner)))
            masks = self.masks(grams)
            for k in range(len(self.languages)):
                bits = (masks[:, k // 64] >> U(k % 64)) & U(1)
                own[owner[first], k] += np.add.reduceat(bits, first).astype(np.int64)
        p = self.chance()
        return n, np.clip((own - n[:, None] * p) / np.maximum(1 - p, 1e-9), 0, n[:, None])

    def predict(self, found: list[str]) -> tuple[list[str], np.ndarray]:
        n, own = self.counts(found)
        if not self.languages:
            return [UNKNOWN] * len(found), np.zeros(len(found))
        best = own.argmax(axis=1)
        names = [self.languages[k] if m else UNKNOWN for k, m in zip(best, n, strict=True)]
        return names, own[np.arange(len(found)), best] / np.maximum(n, 1)


def _known(docs: DataFrame) -> DataFrame:
    """Documents outside the held-out fold that have an id, a text and a language."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))


def sample(docs: DataFrame, counts: dict[str, int], rows: int = LANG_ROWS) -> DataFrame:
    """lang and text of about ``rows`` different documents of each language, all where there are no more, outside the held-out fold.

    Taken are those whose hash, of 32 bits, is below the language's share, so that the same ones come each time and no
    language's rows meet in a task; rows that repeat count once. ``counts`` has a row a language and is broadcast.
    """
    shares = docs.sparkSession.createDataFrame([(x, min(1 << 32, (rows << 32) // n)) for x, n in counts.items()], "lang string, below long")
    name = F.xxhash64("doc_id", "lang", "text").alias("name")
    found = _known(docs).select("lang", "text", name).join(F.broadcast(shares), "lang").where(F.col("name").bitwiseAND(0xFFFFFFFF) < F.col("below"))
    return stored(found.dropDuplicates(["name"]).select("lang", "text"), "languages")


def train(docs: DataFrame, rows: int = LANG_ROWS) -> Filters:
    """Filters of the n-grams of each value of ``lang``, of about ``rows`` documents each outside the held-out fold.

    An n-gram belongs to all languages in which the part of documents with it is at least SHARE of its largest such part, and, where
    there are 20 documents or more, two of them have it. The n-grams come to the driver, bounded by the sample's texts.
    """
    order = {r["lang"]: r["count"] for r in _known(docs).groupBy("lang").count().collect()}
    languages = sorted(order, key=lambda x: (-order[x], x))
    spread = sample(docs, order, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                seen = [np.unique(np.stack([owner.astype(U), grams], axis=1), axis=0) for owner, grams in ngrams(part["text"].tolist())]
                every = np.unique(np.concatenate(seen), axis=0) if seen else np.empty((0, 2), U)
                grams, n = np.unique(every[:, 1], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n})

    counts = spread.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = spread.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    rate = F.col("n") / F.col("docs")
    rated = counts.join(sizes, "lang").withColumn("rate", rate)
    rated = rated.join(rated.groupBy("gram").agg(F.max("rate").alias("most")), "gram")
    own = rated.where((F.col("rate") >= SHARE * F.col("most")) & (F.col("n") >= F.when(F.col("docs") >= 20, 2).otherwise(1)))
    found = own.select("lang", "gram").toPandas()
    sets = {lang: part["gram"].to_numpy() for lang, part in found.groupby("lang")}
    return Filters.of(languages, [sets.get(x, np.empty(0, np.int64)) for x in languages])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its whole text.

    The score is the part of the text's n-grams that the language predicted has, without those that false positives
    add. Of equal languages the commonest learned one is predicted, then the first by name; a text with letters of which no language
    has an n-gram gets the commonest with score 0. Null texts, those without a letter, and all where nothing was learned give `und` and 0.
    Repeated rows get the same each; an empty table gives no row. Columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, score = filters.predict(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": ids(batch).array, "held_out": batch["held_out"], "lang_pred": names, "score": score})

    rows = texts(docs, held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
