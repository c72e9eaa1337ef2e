"""Keys in all scripts, similar texts, searches by trigrams, reports and messages against plain rules."""

import datetime as dt
import random
import re
import tempfile
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlake.functions import text
from postlake.operators import accounts, dedup, messages, search, views
from postlake.plans import queries, report_queries  # noqa: F401  adds to the same table
from postlake.sources import feeds


def values(spark, rows, column, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).coalesce(1).select(column).collect()]


def test_hangul_is_decomposed_as_elsewhere(spark):
    every = "".join(map(chr, range(0xAC00, 0xD7A4)))
    assert len(every) == 11_172
    parts = [every[k : k + 500] for k in range(0, len(every), 500)] + ["a가b", "힣é", "각"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", p) if not unicodedata.combining(c)) for p in parts]
    assert values(spark, parts, text.strip_accents(F.col("c"))) == want


def test_keys_keep_letters_of_all_scripts(spark):
    names = ["Яндекс", "Straße Łódź AB", "株式会社アクメ", "삼성 Inc", "Ελλάδα ME", "Ирме ME", "a_b-c²", "Acme S/A", "Acme SA!", None, ""]
    jamo = unicodedata.normalize("NFKD", "삼성")
    assert values(spark, names, text.normalize_company(F.col("c"))) == ["яндекс", "straße łodz ab", "株式会社アクメ", jamo, "ελλαδα", "ирме", "a_bc2", "acme", "acme", "", ""]
    titles = ["Разработчик Python", "ソフトウェア・エンジニア", "Pessoa Desenvolvedora Sênior", "dévelopeur", "я dev", "ingeniero/a"]
    assert values(spark, titles, text.normalize_title(F.col("c"))) == ["разработчик python", "ソフトウェア エンシニア", "dev sr", "develop eur".replace(" ", ""), "dev", "ingeniero"]
    assert values(spark, ["Москва", "São Paulo", "Ñsp", "x sp", "REMOTO já"], text.normalize_location(F.col("c"))) == ["москва", "sp", "nsp", "x sp", "remoto"]
    rows = [("Разработчик", "Яндекс", "Москва"), ("Бухгалтер", "Сбер", "Казань"), ("백엔드 개발자", "삼성", "서울"), ("データ", "アクメ", "東京")]
    keyed = dedup.with_keys(spark.createDataFrame([(*r, "", "") for r in rows], "title string, company string, location string, url string, external_id string"))
    assert keyed.select("content_hash").distinct().count() == 4 and keyed.where("company_key = '' or title_key = ''").count() == 0


def test_safe_and_cut_texts(spark):
    assert values(spark, ["a\"b'c&<d>", None], text.escape_html(F.col("c"))) == ["a&quot;b&#x27;c&amp;&lt;d&gt;", ""]
    got = values(spark, ["x" * 4000, "y" * 4001, None], text.truncate(F.col("c")))
    assert got == ["x" * 4000, "y" * 3985 + "... [truncado]", ""] and len(got[1]) == 3999


@pytest.mark.parametrize("threshold", [0.88, 0.9, 0.7])
def test_similar_texts_equal_brute_force(spark, threshold):
    rng = random.Random(6)
    words = ["dev", "pl", "sr", "analista", "dados", "python", "aaa", "aa", "backend", "front end", "ti", "é", "ab"]
    found = {""}
    for k in range(260):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
        at = rng.randrange(len(t))
        found |= {t, t[:at] + rng.choice(["", "x", "q "]) + t[at + rng.randrange(2) :]}
    texts = sorted({" ".join(sorted(t.split())) for t in found})
    rows = [(k % 3, t) for k, t in enumerate(texts)] + [((k + 1) % 3, t) for k, t in enumerate(texts) if k % 2]
    df = spark.createDataFrame(rows, "g int, text string")
    got = {tuple(r) for r in dedup.similar_texts(df, df, threshold, "g").collect()}
    groups = {g: [t for h, t in rows if h == g] for g in range(3)}
    want = {(a, b) for own in groups.values() for a in own for b in own if a != b and dedup._indel(a, b) >= 100 * threshold}
    assert got == want and len(want) > 100


def test_search_reads_no_posting_without_the_trigrams(spark):
    rng = random.Random(2)
    words = ["estágio", "estagio", "programação", "Programacao", "ti", "dados", "pão", "João", "area", "100%", "a_b"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(3)), rng.choice([None, "x"])) for k in range(300)]
    df, path = spark.createDataFrame(rows, "posting_seq long, title string, description string"), tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/grams"
    search.build(df, ["title", "description"], path)
    for term in ["Estágio", "programacao", "joao", "ti", "dados", "nowhere", "dados dados", "ea"]:
        got = {r[0] for r in search.search(df, ["title", "description"], path, term).select("posting_seq").collect()}
        from postlake.functions.feed_text import search_predicate

        assert got == {r[0] for r in df.where(search_predicate(term, ["title", "description"])).select("posting_seq").collect()}, term
        found = search.candidates(spark, path, term)
        if found is None:
            assert min(len(x) for x in map(search.needed, search.search_variants(term))) == 0
        else:
            held = {r[0] for r in found.collect()}
            grams = [search.needed(v) for v in search.search_variants(term)]
            assert held == {k for k, t, d in rows if any(all(g in t.lower() or g in (d or "").lower() for g in own) for own in grams)} and got <= held


def test_weekly_report_equals_a_walk(spark):
    rng, now = random.Random(1), dt.datetime(2024, 1, 31)
    rows = [(p, k, rng.choice([None, 10, 50, 90]), f"http://{rng.choice('ABab')}/{k % 40}" if k % 9 else "", rng.choice(["active", "closed"]), now - dt.timedelta(days=rng.randrange(10)), None if k % 4 else now - dt.timedelta(days=20),
             rng.choice(["remote", "Hibrido", "x", None]), rng.choice(["Estágio CLT", "clt", None]), rng.choice(["Estagiária", "Dev"]), rng.choice([None, 0, 40])) for p in (1, 2, 3) for k in range(120)]
    schema = "profile_id int, posting_seq long, score int, url string, status string, discovered_at timestamp_ntz, published_at timestamp_ntz, work_mode string, employment_type string, title string, minimum_match_score int"
    rows = [(*r[:-1], {1: None, 2: 0, 3: 40}[r[0]]) for r in rows]
    reports = [(p, n, None if n % 3 == 0 else now - dt.timedelta(days=30 - n), [rng.randrange(120) for _ in range(6)]) for p in (1, 2) for n in range(14)]
    changes = [(rng.randrange(120), now - dt.timedelta(days=17, seconds=rng.choice([-10, 0, 3, 5, 6, 9999]))) for _ in range(400)]
    got = views.weekly_report(
        spark.createDataFrame(rows, schema), spark.createDataFrame(reports, "profile_id int, report_id long, created_at timestamp_ntz, presented array<long>"),
        spark.createDataFrame(changes, "posting_seq long, changed_at timestamp_ntz"), F.lit(now).cast("timestamp_ntz"),
    )
    want, totals = {}, {}
    for p in (1, 2, 3):
        own = sorted((r for r in reports if r[0] == p), key=lambda r: -r[1])[:10]
        seen, last = {k for r in own for k in r[3]}, next((r[2] for r in own if r[2]), None)
        week = [r for r in rows if r[0] == p and r[4] == "active" and any(t and t >= now - dt.timedelta(days=7) for t in (r[5], r[6]))]
        urls, kept = set(), []
        for r in sorted(week, key=lambda r: (r[2] is None, -(r[2] or 0), -r[1])):
            if r[3].lower() not in urls or not r[3]:
                urls.add(r[3].lower())
                kept.append(r)
        kept.sort(key=lambda r: (-(r[2] or 0), -r[1]))
        for place, r in enumerate(kept, 1):
            n = sum(k == r[1] and (last is None or t >= last - dt.timedelta(seconds=5)) for k, t in changes) if r[1] in seen else 0
            want[p, r[1]] = ("NOVA" if r[1] not in seen else "ATUALIZADA" if n else "ANTERIOR", n, place, next((c for c in (5, 10, 20) if place <= c), None))
        minimum = {1: 70, 2: 70, 3: 40}[p]
        mode = Counter({"remote": "remote", "Hibrido": "hybrid"}.get(r[7], "onsite") for r in kept)
        intern = sum("estagio" in (r[8] or "").lower() or "estágio" in (r[8] or "").lower() or "estagi" in r[9].lower() for r in kept)
        totals[p] = (len(kept), sum((r[2] or 0) >= minimum for r in kept), sum(want[p, r[1]][0] == "NOVA" for r in kept), mode["remote"], mode["hybrid"], mode["onsite"], intern)
    assert {(r["profile_id"], r["posting_seq"]): (r["tag"], r["n_changes"], r["place"], r["cut"]) for r in got.collect()} == want
    assert {r[0]: tuple(r[1:]) for r in views.weekly_totals(got).collect()} == totals and {w[0] for w in want.values()} == {"NOVA", "ATUALIZADA", "ANTERIOR"}


def test_lists_refuse_unknown_predicates(spark):
    with pytest.raises(TypeError):
        views.list_postings(spark.range(1), F.current_timestamp(), colour="red")


def test_preferences_and_sources(spark):
    schema = "profile_id int, roles array<string>, desired_roles array<string>, skills array<string>, preferred_keywords array<string>, profile_seniority string, seniority_levels array<string>"
    rows = [(1, ["a"], ["z"], [str(k) for k in range(12)], ["w"], "mid", ["x"]), (2, [], ["z"], None, ["w"], None, ["x"]), (3, None, None, [], None, "lead", None)]
    got = [tuple(r) for r in accounts.derived_preferences(spark.createDataFrame(rows, schema)).orderBy("profile_id").collect()]
    assert got == [(1, ["a"], [str(k) for k in range(10)], ["junior", "pleno"]), (2, ["z"], ["w"], ["x"]), (3, None, None, None)]
    names = [[" FLAT ", "rss", None, "gone"], [], None, [" "]]
    assert values(spark, names, feeds.enabled(F.col("c")), "c array<string>") == [["flat", "rss"], feeds.USUAL, feeds.USUAL, []]


def test_cards_of_sparse_postings(spark):
    schema = "title string, company string, location string, work_mode string, employment_type string, source string, url string, published_at timestamp, reasoning array<string>, score int, area string, seniority string"
    df = spark.createDataFrame([("<b>&", None, None, "", None, "", None, None, None, 90, None, None), ("t" * 5000, "c", "l", "rEMOTE", "pj", "bOARD", "u", dt.datetime(2024, 2, 1), ["r1<", "r2", "r3", "r4", "r5"], 71, "A", "s")], schema)
    chat = [r[0] for r in df.select(messages.chat_card()).collect()]
    assert "💼 <b>&lt;b&gt;&amp;</b>" in chat[0] and "Empresa:</b> Empresa\n" in chat[0] and "Recente" in chat[0] and "Motivos" not in chat[0] and "href" not in chat[0]
    assert len(chat[1]) == 4000
    import json

    cards = [json.loads(r[0]) for r in df.select(messages.webhook_card(F.lit("2024-01-31").cast("timestamp"))).collect()]
    assert [c["embeds"][0]["color"] for c in cards] == [0x2ECC71, 0x3498DB]
    fields = [{f["name"]: f["value"] for f in c["embeds"][0]["fields"]} for c in cards]
    assert fields[0]["Modelo"] == "N/a" and fields[0]["Tipo"] == "N/A" and fields[0]["Fonte"] == "Web" and "Destaques" not in fields[0]
    assert fields[1]["Modelo"] == "Remote" and fields[1]["Fonte"] == "Board" and fields[1]["Destaques"] == "• r1<\n• r2\n• r3\n• r4" and fields[1]["Data de Publicação"] == "01/02/2024"


@pytest.mark.parametrize("name", ["w3_top_new", "a9_weekly_totals", "v14_validate", "n9_dedup_key", "r10_rank"])
def test_generated_code_compiles(spark, name):
    """No stage falls back to interpretation because its code is too large."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_classes_of_many_ranges_are_trees(spark):
    """A character is tested against few ranges; what the class holds stays as the tables of Unicode have it."""
    for pattern in (text._MARKS, text._MORE_CLASS):
        assert max(x.count("-") for x in re.findall(r"\[((?:\\x\{\w+\}-\\x\{\w+\})+)", pattern)) <= 4
    codes = [k for k in range(0x80, 0x30000) if not 0xD800 <= k < 0xE000]
    chars = spark.createDataFrame([("".join(chr(k) for k in codes[at : at + 2000]),) for at in range(0, len(codes), 2000)], "c string")
    found = "".join(r[0] for r in chars.select(F.array_join(F.regexp_extract_all("c", F.lit(f"({text._MARKS})"), 1), "")).collect())
    assert sorted(found) == [chr(k) for k in codes if unicodedata.combining(chr(k))]
    told = ["Estagiário", "trainee", "xjrx", "jr.", "Entry level", "mid-level", "leads", "lead", "staffing", "Pleno", "middle", None]
    assert values(spark, told, text.infer_seniority(F.col("c"), F.lit(None))) == ["estagio", "trainee", "", "junior", "junior", "mid", "", "senior", "senior", "mid", "", ""]


def test_trigrams_need_no_python_worker(spark):
    """Lists of grams grow with texts, so no batch of rows may hold them at once; characters beyond the BMP count as one."""
    texts = ["a😀b😀\n cd", "ab", "", "😀😀😀😀", "aaaa", "ção"]
    rows = spark.createDataFrame([(x,) for x in texts], "c string").coalesce(1).select(search._trigrams(F.col("c")).alias("g"))
    assert [sorted(set(r.g)) for r in rows.collect()] == [sorted({x[k : k + 3] for k in range(len(x) - 2)}) for x in texts]
    assert "Python" not in rows._jdf.queryExecution().optimizedPlan().toString()
