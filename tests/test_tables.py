"""Kept tables: commits of several tables at once, runs that die or come twice, and what a run keeps."""

import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlake.plans import persistence, store_queries
from postlake.sinks.tables import Tables
from postlake.sources import adapters as A


def new_path():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"


def rows(spark, *found, schema="k long, part string, v string"):
    return spark.createDataFrame(list(found), schema)


def table(store, name="t"):
    return sorted(map(tuple, store.read(name).select("k", "part", "v").collect()), key=str)


def test_upserts_equal_a_dictionary(spark):
    import random

    rng, store, want = random.Random(3), Tables(spark, new_path(), buckets=4), {}
    for run in range(5):
        batch = {(rng.choice([None, *range(30)]), rng.choice("ab")): rng.choice(["x", "y", None]) for _ in range(12)}
        store.commit(f"r{run}", {"t": (rows(spark, *((*k, v) for k, v in batch.items())), ["k", "part"])})
        want |= batch
        assert table(store) == sorted(((*k, v) for k, v in want.items()), key=str)
    assert store.expire(keep=1) > 0
    assert table(store) == sorted(((*k, v) for k, v in want.items()), key=str) and store.version_of("r4") == 5


def test_commits_touch_only_their_buckets(spark):
    store = Tables(spark, new_path(), buckets=8)
    store.commit("a", {"t": (rows(spark, *((k, "a", "x") for k in range(100))), ["k"])})
    store.commit("b", {"t": (rows(spark, (5, "a", "new")), ["k"])})
    folders = Counter(r["folder"] for r in store.manifests().where("version = 2 and bucket >= 0").collect())
    assert folders == {1: 7, 2: 1} and dict((k, v) for k, _, v in table(store))[5] == "new" and len(table(store)) == 100
    # tables that a commit doesn't name stay; columns may be added
    store.commit("c", {"other": (rows(spark, (1, "a", "z")), ["k"])})
    store.commit("d", {"t": (rows(spark, (200, "b", "w", 1.5), schema="k long, part string, v string, more double"), ["k"])})
    assert store.read("t").count() == 101 and store.read("t").where("more = 1.5").count() == 1 and table(store, "other") == [(1, "a", "z")]
    with pytest.raises(ValueError):
        store.commit("e", {"t": (rows(spark, (1, "a", "z")), ["part"])})
    with pytest.raises(ValueError):
        store.read("none")


def test_empty_commits(spark):
    store = Tables(spark, new_path())
    none = rows(spark)
    assert store.read("t", none.schema).count() == 0
    store.commit("a", {"t": (none, ["k"])})
    assert store.read("t").columns == ["k", "part", "v"] and store.read("t").count() == 0
    store.commit("b", {"t": (rows(spark, (1, "a", None)), ["k"])})
    assert table(store) == [(1, "a", None)]


def test_a_run_that_dies_changes_nothing_and_can_run_again(spark, monkeypatch):
    store = Tables(spark, new_path(), buckets=4)
    store.commit("a", {"t": (rows(spark, (1, "a", "x"), (2, "a", "x")), ["k"]), "u": (rows(spark, (1, "a", "x")), ["k"])})
    before, create = (table(store), table(store, "u")), type(spark).createDataFrame

    def die(self, data, schema=None, **more):
        if data and len(data[0]) == 7:
            raise RuntimeError("before the manifest")
        return create(self, data, schema, **more)

    monkeypatch.setattr(type(spark), "createDataFrame", die)
    change = {"t": (rows(spark, (1, "a", "new")), ["k"]), "u": (rows(spark, (9, "a", "new")), ["k"])}
    with pytest.raises(RuntimeError):
        store.commit("b", change)
    assert (table(store), table(store, "u")) == before
    monkeypatch.undo()
    assert store.commit("b", change) == 2 and table(store) == [(1, "a", "new"), (2, "a", "x")] and len(table(store, "u")) == 2
    # a committed run isn't run again, whatever it brings
    assert store.commit("b", {"t": (rows(spark, (1, "a", "other")), ["k"])}) == 2 and table(store)[0] == (1, "a", "new")


def test_runs_of_one_profile(spark):
    """Counters of one profile's runs, recounted from what was kept."""
    d = "/root/testdata/sf0.001"
    store = Tables(spark, new_path(), buckets=4)
    profile = A.profiles(spark).where("profile_id = 4")
    first, second = store_queries.batches(spark, d)
    for run_id, batch in (("one", first), ("two", second)):
        persistence.run(store, run_id, batch, profile, A.as_of())
    runs = {r["run_id"]: r for r in store.read("runs").collect()}
    jobs, matches, log = store.read("jobs"), store.read("matches"), store.read("changelog")
    assert runs["one"]["new"] + runs["two"]["new"] == jobs.count() == matches.count() == runs["one"]["valid"] + runs["two"]["valid"]
    for r in runs.values():
        assert r["found"] == r["valid"] + r["deduplicated"] + r["discarded"] and sum(r["discard_reasons"].values()) == r["discarded"]
        assert sum(s["found"] for s in r["source_stats"].values()) == r["found"] and r["status"] == "completed"
    assert runs["one"]["updated"] == 0 and runs["two"]["updated"] == log.select("by").distinct().count() > 0
    assert matches.where("score >= 70").count() == sum(r["notified"] for r in runs.values())
    seen = jobs.where("last_updated_at is not null").select("posting_seq")
    assert seen.exceptAll(log.select("posting_seq").distinct()).count() == 0 and matches.where(F.size("reasoning") > 8).count() == 0
    # the keys that later runs compare are kept, so history isn't normalised again
    assert jobs.where("content_hash is null or company_key is null").count() == 0
