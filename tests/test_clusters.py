import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import clusters, dedup
from postlake.sources import adapters as A
from tests.test_operators import brute_match

KEYS = "posting_seq long, content_hash string, dedup_key string, title string"


def greedy(rows):
    hashes, keys, stay = set(), set(), set()
    for seq, h, k, *_ in sorted(rows):
        if (h or "") not in hashes and (k or "") not in keys:
            hashes.add(h or "")
            keys.add(k or "")
            stay.add(seq)
    return stay


@pytest.mark.parametrize("kinds", [3, 12, 60])
def test_admitted_equals_one_by_one(spark, kinds):
    rng = random.Random(kinds)
    rows = [(s, rng.choice([None, "", *(f"h{k}" for k in range(kinds))]), rng.choice([None, *(f"k{k}" for k in range(kinds))]), "x") for s in range(150)]
    got = [r["posting_seq"] for r in clusters.admitted(spark.createDataFrame(rows, KEYS)).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(rows)


def test_admitted_in_chains_and_none(spark):
    # each row shares one key with the row before it, so every second one stays
    rows = [(s, f"h{s // 2}", f"k{(s + 1) // 2}", "x") for s in range(12)]
    assert {r["posting_seq"] for r in clusters.admitted(spark.createDataFrame(rows, KEYS)).collect()} == greedy(rows) == set(range(0, 12, 2))
    assert clusters.admitted(spark.createDataFrame([], KEYS)).count() == 0


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_smallest_reached(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 190), rng.randrange(100, 190)) for _ in range(70)] + [(500, k) for k in range(200, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in clusters.smallest_reached(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == closure(nodes, [(a, b) for a, b in links if a != b])
    assert clusters.smallest_reached(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_equal_brute_force(spark):
    every = A.postings(spark, "/root/testdata/sf0.001")
    # some rows lack their mode, and all have a column that helpers could clash with
    rows = dedup.with_keys(every.withColumn("work_mode", F.when(F.col("posting_seq") % 5 > 0, F.col("work_mode")))).withColumn("a", F.lit(1)).cache()
    plain = [{**r.asDict(), "work_mode": r["work_mode"] or ""} for r in rows.collect()]
    links = [(x["posting_seq"], y["posting_seq"]) for x in plain for y in plain if x["posting_seq"] < y["posting_seq"] and brute_match(x, y, 0.88)]
    want = closure([x["posting_seq"] for x in plain], links)
    got = clusters.duplicate_clusters(rows).collect()
    assert {r["posting_seq"]: r["cluster_id"] for r in got} == want and len(got) == len(plain)
    assert all(r["cluster_size"] == sum(1 for c in want.values() if c == r["cluster_id"]) for r in got)
    assert len(set(want.values())) < len(plain)
    assert clusters.duplicate_clusters(rows.limit(0)).count() == 0
