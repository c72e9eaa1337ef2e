"""Whitening, ranked search and languages against brute force, on rows with nulls, ties, repeats and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import language_id, lexical_search, queries, whitening

CLASHING = ("v", "component", "n", "i", "j", "row", "block", "item", "score", "rank", "terms", "times", "name", "_n", "no_id", "held_out", "group", "term")


def vector_rows():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    rows = [(k, (rng.normal(size=6) @ mix).tolist()) for k in range(300)]
    rows += [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [math.nan] * 6), (404, [0.0] * 5 + [math.inf]), (405, [1.0] * 5), (406, [1e30] * 6)]
    return [*rows, rows[3], rows[3], (None, [-0.5, 0.25, 1e-9, -1e-9, 3.0, 2.0]), (None, [0.0] * 6)]


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def test_whitening_equals_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = whitening.whitening(df.withColumns({c: F.lit("x") for c in CLASHING})).collect()
    kept = [(k, whole(v)) for k, v in rows if v and len(v) == 6 and all(c is not None and abs(c) < 1e20 for c in v)]
    n, sums = len(kept), [sum(x[d] for _, x in kept) for d in range(6)]
    v = np.array([[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in kept) / n**3 for b in range(6)] for a in range(6)])
    values = np.linalg.eigvalsh(v)[::-1]
    assert Counter(r["vec_id"] for r in got) == Counter({k: 6 * m for k, m in Counter(k for k, _ in kept).items()})
    assert {(r["vec_id"], r["n"], r["deviation"]) for r in got} == {(k, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for k, x in kept}
    columns = np.empty((n, 6))
    for c in range(6):
        own = [r for r in got if r["component"] == c + 1]
        columns[:, c] = [r["whitened"] for r in own]
        assert all(abs(r["explained"] / (values[c] / np.trace(v)) - 1) < 1e-9 for r in own)
    assert np.abs(columns.T @ columns / n - np.eye(6)).max() < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    length = Counter()  # all components, each times sqrt(e), keep each row's distance from the mean
    for r in got:
        length[r["vec_id"]] += r["whitened"] ** 2 * values[r["component"] - 1]
    for k, x in kept:
        times = sum(j == k for j, _ in kept)
        if k is not None:
            assert abs(length[k] / times / (sum((a - s / n) ** 2 for a, s in zip(x, sums, strict=True))) - 1) < 1e-9


@pytest.mark.parametrize("top", [2, 300, 1 << 26, 1 << 40])
def test_cross_products_are_exact(top):
    rng = np.random.default_rng(top)
    for n in (1, 63, 64, 65, 200):
        y = rng.integers(0, top, (n, 5))
        y[:, 2] = 0
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(5)] for i in range(5)]
        assert whitening.cross_products(y).tolist() == want


def test_whitening_of_wide_flat_and_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    # entries too wide for a product in a long, beside a dimension that never varies
    rows = [(k, [(-1.0) ** k * 2.0**50 + k, 0.5, float(k)]) for k in range(40)]
    got = whitening.whitening(make(rows)).collect()
    flat = [r for r in got if r["component"] == 3]
    assert len(got) == 120 and all(r["whitened"] is None for r in flat) and all(r["deviation"] is None for r in got) and got[0]["identity_error"] < 1e-4
    one = whitening.whitening(make([(1, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 2
    assert whitening.whitening(make([])).count() == 0 and whitening.whitening(make([(1, None), (2, [])])).count() == 0
    tie = whitening.whitening(make([(1, [1.0]), (2, [2.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])])).collect()
    assert {r["vec_id"] for r in tie} == {3, 4}


def test_whitening_query(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op11_embedding_whitening"](spark, d).toPandas()
    table = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(table["embedding"]).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    w = got.pivot(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    assert w.shape == (n, 32) and np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9
    assert (got.groupby("vec_id")["deviation"].first().loc[table["vec_id"]].to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()
    # each whitened component is the centred rows along one direction: eigenvectors of V
    centred, v = x - s / n, (x - s / n).T @ (x - s / n) / n
    for c in range(32):
        direction = centred.T @ w[:, c]
        direction /= np.linalg.norm(direction)
        assert np.abs(v @ direction - (direction @ v @ direction) * direction).max() < 1e-6 * np.trace(v)


def search_rows():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "gamma", "über", "Über", "x1", "delta", "the", "of", "𝛼β"]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(k, text(rng.randrange(0, 40))) for k in range(260)]
    docs += [(300, None), (301, ""), (302, " .,;"), (None, "alpha beta"), (None, "alpha beta"), docs[7], docs[7], (303, "the " * 5000 + "alpha"), (2**62 + 1, "gamma")]
    items = [(k, text(rng.randrange(1, 12))) for k in range(14)] + [(20, None), (21, "?!"), (22, "nowhere"), (None, "alpha alpha of"), (3, "delta delta x1"), (23, "the"), (23, "the")]
    return docs, items


def brute_search(docs, items, top=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(k, terms(t)) for k, t in docs]
    n_docs, total = sum(bool(x) for _, x in held), sum(len(x) for _, x in held)
    df = Counter(t for _, x in held for t in set(x))
    out = []
    for item, t in items:
        scores = []
        for k, x in held:
            tf, score = Counter(x), 0
            for term in terms(t):
                if tf[term]:
                    m = 75 + (25 * len(x) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * ((10**9 * tf[term]) // (1000 * tf[term] + 12 * m))
            if score > 0:
                scores.append((-score, k is None, k or 0))
        out += [(item, rank, None if null else k, -score) for rank, (score, null, k) in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("top, owners, block, group", [(20, 3, 4096, 512), (2, 4, 8, 3), (1, 1, 16, 512), (5, 6, 64, 5)])
def test_search_equals_brute_force(spark, monkeypatch, top, owners, block, group):
    for name, value in (("BLOCK_DOCS", block), ("LEAST_BLOCKS", 2), ("GROUP_ITEMS", group), ("PIECE", 50)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = search_rows()
    make = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string").withColumns({c: F.lit("x") for c in CLASHING})
    got = lexical_search.search(make(docs, "doc_id").repartition(3), make(items, "item_id").repartition(2), top, owners).collect()
    assert Counter(map(tuple, got)) == brute_search(docs, items, top)


def test_accumulators_are_dropped_only_past_hope(spark):
    """With few best documents asked for, stages carry fewer accumulators, and the result is the same."""
    import pyarrow as pa

    uses = [(np.array([0]), np.array([1]))] * 2
    rows = pa.table({"block": pa.array([0] * 4, pa.int32()), "row": [0, 1, 2, 3], "doc_id": [10, 11, 12, 13], "n": [4] * 4, "terms": pa.array([[0]] * 4, pa.list_(pa.int32())), "times": pa.array([[9], [1], [1], [5]], pa.list_(pa.int64()))})
    none = pa.table({"block": pa.array([], pa.int32()), "item": pa.array([], pa.int32()), "rows": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.int64()))})
    carried = lambda rest: lexical_search._Stage(uses, np.array([1000, 1]), 4, 16, np.array([rest]), 1, False)(none, rows).column("rows").to_pylist()
    assert carried(10**12) == [[0, 1, 2, 3]] and carried(0) == [[0]] and carried(200_000_000) == [[0, 3]]


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(docs, items).count() == lexical_search.search(some, items).count() == 0
    assert lexical_search.search(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_search_query_equals_its_sql(same):
    same(queries.QUERIES["op12_ranked_search"], queries.SQL["op12_ranked_search"], "/root/testdata/sf0.001")


def brute_grams(text):
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    return [" "[k:] + plain[k - 1 : k] + plain[k] + (plain[k + 1 : k + 2] or " ") if k else " " + plain[0] + (plain[1:2] or " ") for k in range(len(plain)) if plain[k] != " "]


def code(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(gram))


TEXTS = ["", "a", "Hello, World!", "  é è", "日本 語x", "İstanbul ΣΑΣ", "1234 ...", "ab" * 300, "𝛼𝛽 z", "x\ny"]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 19])
def test_ngrams_equal_brute_force(monkeypatch, piece):
    monkeypatch.setattr(language_id, "PIECE", piece)
    got = [[] for _ in TEXTS]
    for owner, grams in language_id.ngrams(TEXTS):
        for k, g in zip(owner.tolist(), grams.tolist(), strict=True):
            got[k].append(g)
    assert got == [[code(g) for g in brute_grams(t)] for t in TEXTS]


def test_masks_hold_every_language_of_an_ngram():
    rng = np.random.default_rng(1)
    sets = [rng.choice(1 << 40, 900, replace=False) for _ in range(70)]
    sets[69] = np.concatenate([sets[69], sets[0]])
    filters = language_id.Filters.of([f"l{k}" for k in range(70)], sets)
    for k in (0, 5, 63, 64, 69):
        masks = filters.masks(sets[k].astype(np.uint64))
        assert all(m[k // 64] >> np.uint64(k % 64) & np.uint64(1) for m in masks)
    assert all(m[69 // 64] >> np.uint64(69 % 64) & np.uint64(1) for m in filters.masks(sets[0].astype(np.uint64)))
    others = filters.masks(rng.choice(1 << 41, 50_000).astype(np.uint64) + np.uint64(1 << 41))
    found = np.array([((others[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(70)])
    assert np.abs(found - filters.chance()).max() < 0.002


def language_rows():
    rng = random.Random(2)
    syllables = {"en": ["the", "ing", "tion", "ough"], "de": ["sch", "ung", "ä", "ber"], "fr": ["eau", "é", "ment", "tion"], "xx": ["qq"]}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60)))
    rows = []
    for k in range(240):
        lang = ["en", "en", "de", "fr"][k % 4] if k % 80 else "xx"
        rows.append((k, text(lang), lang))
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 .. 34", "de"), (503, "жжж", None), (None, "the thing", "en"), (504, text("de"), None)]
    return [*rows, rows[9], rows[9], (505, "thetionough " * 20_000, None)]


def test_languages_equal_brute_force(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    filters = language_id.train(docs)
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in language_id.predict(docs.withColumns({c: F.lit("x") for c in CLASHING}), filters).collect())
    learn = lambda k, t, lang: k is not None and t is not None and lang is not None and zlib.crc32(str(k).encode()) % 5 != 0
    fit = {r for r in rows if learn(*r)}
    n_rows = Counter(r[2] for r in rows if learn(*r))
    names = sorted(n_rows, key=lambda x: (-n_rows[x], x))
    docs_of = Counter(r[2] for r in fit)
    df = {x: Counter(g for _, t, lang in fit if lang == x for g in set(brute_grams(t))) for x in names}
    most = Counter()
    for x in names:
        for g, n in df[x].items():
            most[g] = max(most[g], n / docs_of[x])
    sets = {x: {code(g) for g, n in df[x].items() if n / docs_of[x] >= 0.1 * most[g] and n >= (2 if docs_of[x] >= 20 else 1)} for x in names}
    assert filters.languages == names
    # chance hits are what the filter itself tells; sets without them are brute
    want, chance = Counter(), dict(zip(names, filters.chance(), strict=True))
    for k, t, _ in rows:
        grams = [code(g) for g in brute_grams(t or "")] if t else []
        held = k is not None and zlib.crc32(str(k).encode()) % 5 == 0
        if not grams:
            want[k, held, "und", 0.0] += 1
            continue
        masks = filters.masks(np.array(grams, np.uint64))[:, 0]
        own = {}
        for b, x in enumerate(names):
            hit = [bool(int(m) >> b & 1) for m in masks]
            assert all(h for h, g in zip(hit, grams, strict=True) if g in sets[x])
            assert sum(h and g not in sets[x] for h, g in zip(hit, grams, strict=True)) <= max(3, 0.2 * len(grams))
            own[x] = min(max((sum(hit) - len(grams) * chance[x]) / (1 - chance[x]), 0), len(grams))
        best = max(names, key=lambda x: own[x])
        want[k, held, best, round(own[best] / len(grams), 6)] += 1
    assert got == want
    right = [(r[2], language_id_of) for r in rows if r[2] and r[1] and not learn(*r) for language_id_of in [next(x[2] for x in got if x[0] == r[0])]]
    assert sum(a == b or b == "und" for a, b in right) >= 0.95 * len(right)


def test_languages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    some = spark.createDataFrame([(1, "abc", None), (2, None, None)], none.schema)
    assert language_id.predict(none, language_id.train(none)).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(some, language_id.train(some)).collect()} == {("und", 0.0)}


def test_languages_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op13_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out and lang is not null")
    rows = [(r["lang"], r["lang_pred"]) for r in got.collect()]
    assert len(rows) > 100 and sum(a == b for a, b in rows) / len(rows) > 0.97
