"""Consistent-hash sharding with virtual nodes and bounded loads.

A ring holds virtual nodes of every shard. A key belongs to the first node at
or clockwise of its hash; where that node's shard is full, the key continues
clockwise. How many keys of each arc go where is planned on the counts of the
arcs (shards times virtual nodes of them); keys follow the plan by their rank
within the arc.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ranked, stored


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the virtual nodes in order, and the shard of each."""
    spots = sorted(
        (int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
        for s in range(shards)
        for v in range(nodes)
    )
    return np.array([p for p, _ in spots], np.int64), np.array([s for _, s in spots])


def plan(counts: dict[int, int], owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, last rank + 1, shard, first slot).

    Shard s may hold total // shards keys, and one more if s < total % shards, so
    counts differ by one at most. In step k every arc's remaining keys try the
    shard of the k-th node clockwise of them.
    """
    total, n = sum(counts.values()), len(owners)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    left = {a: (0, c) for a, c in sorted(counts.items()) if c}
    runs = []
    for step in range(n):
        if not left:
            break
        for arc, (rank, count) in list(left.items()):
            shard = int(owners[(arc + step) % n])
            take = min(count, room[shard] - used[shard])
            if take > 0:
                runs.append((arc, rank, rank + take, shard, used[shard]))
                used[shard] += take
                left[arc] = (rank + take, count - take)
        left = {a: x for a, x in left.items() if x[1]}
    return runs


def shard(docs: DataFrame, shards: int = 24, nodes: int = 128) -> DataFrame:
    """Assign every row of (doc_id, text) to a shard; the law is `rows`.

    size is the UTF-8 length plus 8; a null text has none and counts as empty.
    Null ids hash like a value; repeated rows get a slot each; an empty table gives no row. Other columns are
    not read. grown_shard is null, as the law is not `key`.
    """
    spark = docs.sparkSession
    positions, owners = ring(shards, nodes)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    @F.pandas_udf("int")
    def arc(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, h.to_numpy(np.int64)) % len(positions), dtype="int32")

    keyed = docs.select(
        "doc_id",
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        arc(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("arc"),
        F.monotonically_increasing_id().alias("salt"),
    )
    table = stored(keyed, "shard-keys")
    counts = {r["arc"]: r["n"] for r in table.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    block = max(4096, -(-total // 100_000))
    rows = [
        (a, b, lo, hi, s, slot)
        for a, lo, hi, s, slot in plan(counts, owners, shards)
        for b in range(lo // block, (hi - 1) // block + 1)
    ]
    runs = spark.createDataFrame(rows, "arc int, _block long, _lo long, _hi long, shard int, _slot long")
    placed = ranked(table, ["arc"], ["doc_id", "text_crc32", "size", "salt"], total // 32, least=8).withColumn("_block", F.expr(f"rank div {block}"))
    return (
        placed.join(runs, ["arc", "_block"])
        .where((F.col("rank") >= F.col("_lo")) & (F.col("rank") < F.col("_hi")))
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("_slot") + F.col("rank") - F.col("_lo")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
