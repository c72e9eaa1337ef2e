"""The pipeline against a brute-force version of its stages, on a small folder of tables."""

import hashlib
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from postlake.llm import mixing, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["grobbel", "snarfid", "blaggot"]


def corpus():
    rng = random.Random(8)
    words = ["the", "of", "river", "house", "seven", "über", "light", "stone", "walks", "early"]
    clean = lambda: [rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.randrange(30, 90))]
    rows = []
    for k in range(400):
        text = clean()
        if k % 5 == 0:
            for _ in range(8):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((k, " ".join(text), "en", f"s{k % 4}" if k % 9 else None, None))
    for k in range(400, 520):  # exact copies but for white space, and near ones
        of = rows[rng.randrange(400)]
        text = of[1].replace(" ", rng.choice([" ", "  ", "\n"])) if k % 2 else of[1] + " extra" + str(k)
        rows.append((k, text, "en", of[3], None))
    long = " ".join(f"w{k}" for k in range(6000))
    rows += [(600, long, "en", "s0", None), (601, None, None, None, None), (602, "", "en", "s1", None), (None, "of two rivers", None, "s1", None), (None, "of one house", None, None, None)]
    return [*rows, rows[7], rows[8]]


@pytest.fixture(scope="module")
def folder(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 1, int(any(x in (t or "") for x in INSULTS))) for k, t, *_ in rows[:400]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def without_copies(rows):
    """The rows of the smallest id of each normalised text, one of them each; a null id only where all are null."""
    kept = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if key not in kept or (r[0] is not None and (kept[key][0] is None or r[0] < kept[key][0])):
            kept[key] = r
    return list(kept.values())


def without_near_copies(rows, threshold=0.8):
    grams = []
    for r in rows:
        w = (r[1] or "").split()
        grams.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(grams):
        for j in range(i):
            b = grams[j]
            if a == b or a and b and len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(root(i), []).append(r)
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]


def test_pipeline_equals_brute_force(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert all(any(w.startswith(t.strip()) for t in model.lexicon.weights) for w in INSULTS)
    machine = model.lexicon.automaton()
    rows = [r for r in corpus() if model.score(np.array([toxicity.features(machine, toxicity.fold(r[1] or ""))]))[0] < 0.3]
    assert not any(x in (r[1] or "") for r in rows for x in INSULTS) and len(rows) > 350
    rows = without_near_copies(without_copies(rows))
    # each document's words taken over its size, a half counting as a whole
    taken = {(r["doc_id"], r["digest"]): r["taken"] for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    whole, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for doc_id, text, *_ in rows:
        size = len((text or "").split())
        times = int(taken[doc_id, hashlib.md5((text or "").encode()).hexdigest()] / max(size, 1) + 0.5)
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[doc_id, k // 2048, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += times
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == +want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert sorted(p)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:]))
        assert sum(n for _, n in p) <= 2048


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        assert found.count() == 0 and (name == "packing" or found.columns == docs.columns)


def test_scores_equal_brute_force(spark, folder):
    """The lexicon's score without an automaton: each term looked for at each word."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    again = toxicity.train(docs.repartition(7), spark.read.parquet(f"{folder}/labels.parquet").repartition(5))
    assert model.lexicon == again.lexicon and np.allclose(model.coefficients, again.coefficients)
    got = {(r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()}
    want = set()
    for doc_id, text, *_ in corpus():
        folded, weights = toxicity.fold(text or ""), []
        spared = [(m, m + len(p) - 1) for p in model.lexicon.exceptions for m in range(len(folded)) if folded.startswith(p, m)]
        for at, c in enumerate(folded):
            terms = [t for t in model.lexicon.weights if c == " " and folded.startswith(t, at)]
            if terms and not any(a <= at < b for a, b in spared):
                weights.append(model.lexicon.weights[max(terms, key=len)])
        x = np.log1p([sum(weights), 100 * sum(weights) / max(1, len(folded.split())), len(weights)])
        want.add((doc_id, float(1 / (1 + np.exp(-(x @ model.coefficients[1:] + model.coefficients[0]))))))
    assert {(k, round(v, 9)) for k, v in got} == {(k, round(v, 9)) for k, v in want}
