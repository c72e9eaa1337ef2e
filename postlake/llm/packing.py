"""Best-fit packing of tokenised documents into sequences of a fixed length.

The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries, so the driver's work does not depend on the number of
documents. Pieces then take the planned slots by an equi-join on their length
and a block of their rank within that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ids, ranked, stored, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
#: Chunks that a worker remembers, and the longest one that it remembers, in bytes.
MEMO_CHUNKS, MEMO_BYTES = 400_000, 48
_TOKENIZERS: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


#: The byte-level alphabet writes the bytes that are no printable Latin-1 characters as others.
_SPELLED = {b: 162 + b for b in range(127, 161)} | {173: 323}


def _letters(chunk: bytes) -> str:
    """A run of Latin-1 letters in lower case and in the byte-level alphabet; empty if it isn't one."""
    text = chunk.decode()
    if not text.isalpha() or max(text) > "\xff":
        return ""
    return text.lower().encode().decode("latin-1").translate(_SPELLED)


class _Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer ignores case, breaks at white space and drops it, so a text is
    encoded chunk by chunk, and the ids of short chunks are remembered. Runs of
    Latin-1 letters go to the BPE model at once, as the steps before it only spell
    their bytes; so does such a run before a comma or full stop, which is a
    token run of its own. All other chunks take the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.tokenizer.no_truncation()
        self.model, self.memo = self.tokenizer.model, {}
        self.ends = {c: self._ids([c])[0] for c in (b",", b".")}

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in chunks], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, new: set[bytes]) -> None:
        memo, rest = self.memo, []
        for x in new:
            stem, end = (x[:-1], self.ends[x[-1:]]) if x[-1:] in self.ends else (x, b"")
            run = stem.lower().decode() if stem.isalpha() else _letters(stem)  # chunks beside '<|' keep their case
            if run:
                memo[x] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(run)]) + end
            else:
                rest.append(x)
        memo.update(zip(rest, self._ids(rest), strict=True))

    def __call__(self, text: bytes) -> bytes:
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        chunks = (text if b"<|" in text else text.lower()).split()
        try:
            return b"".join([memo[x] for x in chunks])
        except KeyError:
            new = {x for x in chunks if x not in memo}
        self._learn(new)
        ids = b"".join([memo[x] for x in chunks])
        for x in new:
            if len(x) > MEMO_BYTES:
                del memo[x]
        return ids


_ENCODERS: dict[str, _Encoder] = {}


def _encoder(path: str) -> _Encoder:
    """The worker's encoder, whose memory outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length and crc32 of its ids, and a salt that tells equal rows apart.

    A null text counts as empty and is one piece that holds the end id alone.
    Only documents of more than ``capacity`` ids are cut; the last piece may be
    shorter. Columns besides doc_id and text are not read.
    """
    end, width = int(end_id).to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, done = _encoder(tokenizer), 0
        for batch in batches:
            rows = []
            for at_row, text in enumerate(batch["text"]):
                found = encoder(text.encode()) + end
                for k, at in enumerate(range(0, len(found), width)):
                    part = found[at : at + width]
                    rows.append((at_row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = ids(batch).take(out["doc_id"].to_numpy(int)).array
            out["salt"] = np.arange(done, done + len(out))
            done += len(out)
            yield out

    return texts(docs).mapInPandas(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs (length, first rank, last rank + 1, first sequence, pieces a
    sequence, offset): pieces of that length with those ranks go in order into
    consecutive sequences, so many to each, from that offset on. Sequences with
    equal free space are handled together.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, how many)
    spaces: list[int] = []
    runs, opened = [], 0

    def keep(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in free:
                free[space] = []
                bisect.insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                space, n = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + n
            each = space // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, rank + whole * each, first, each, capacity - space))
                keep(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            first, n = first + whole, n - whole
            if n and 0 < left < each:  # what is left goes into one more of these sequences
                runs.append((length, rank, rank + left, first, left, capacity - space))
                keep(space - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            keep(space, first, n)
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents; returns the columns of `pieces` but the salt, and sequence_id and offset.

    Nulls, blank and repeated texts are pieces like any other; equal rows get a
    slot each; an empty table packs into nothing.
    """
    spark = docs.sparkSession
    table = stored(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    block = max(4096, -(-total // 100_000))
    rows = [
        (length, b, lo, hi, first, each, offset)
        for length, lo, hi, first, each, offset in plan(counts, capacity)
        for b in range(lo // block, (hi - 1) // block + 1)
    ]
    runs = spark.createDataFrame(rows, "length long, _block long, _lo long, _hi long, _first long, _each long, _offset long")
    placed = ranked(table, ["length"], ["doc_id", "piece", "ids_crc32", "salt"], total).withColumn("_block", F.expr(f"rank div {block}"))
    at = F.col("rank") - F.col("_lo")
    return (
        placed.join(runs, ["length", "_block"])
        .where((F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("_first") + F.expr("(rank - _lo) div _each")).alias("sequence_id"),
            (F.col("_offset") + at % F.col("_each") * F.col("length")).alias("offset"),
        )
    )
