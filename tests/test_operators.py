import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from postlake.functions import text
from postlake.operators import breaker, changes, dedup, freshness, maintenance
from postlake.plans import cycle
from postlake.sinks.tables import Tables
from postlake.sources import adapters as A
from postlake.sources import feeds
from postlake.streaming import cycle as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.normalize_url(F.lit("https://Example.com/jobs/1/?utm=x#top"))) == "https://example.com/jobs/1"
    hashes = [one(spark, text.content_hash(F.lit(t), F.lit("c"), F.lit("l"), F.lit(t), F.lit("77"))) for t in ("a", "b")]
    assert hashes[0] == hashes[1]
    assert one(spark, text.title_key(F.lit("Estagiária de Desenvolvimento"))) == one(spark, text.title_key(F.lit("Estágio em Desenvolvimento")))
    assert one(spark, text.normalize_company(F.lit("Grupo Ação Ltda."))) == "acao"
    assert one(spark, text.normalize_location(F.lit("São Paulo - SP"))) == "sp  sp"
    assert one(spark, text.clean_html(F.lit("<p>a &amp; b<br>c&nbsp;d</p>"))) == "a & b c d"
    assert tuple(one(spark, text.parse_salary(F.lit("R$ 1.234,56 - R$ 2.000,00")))) == (1234.56, 2000.0)
    assert tuple(one(spark, text.parse_salary(F.lit("a combinar")))) == (None, None)


def test_freshness(spark):
    now = dt.datetime(2024, 3, 31)
    rows = [(1, "Dev", "x", now - dt.timedelta(days=61)), (2, "Dev", "x", None), (3, "Dev", "This position has been closed.", now), (4, "Dev", "x", now - dt.timedelta(days=60))]
    df = spark.createDataFrame(rows, "posting_seq long, title string, description string, published_at timestamp")
    got = {r["posting_seq"]: r for r in freshness.freshness(df, F.lit(now).cast("timestamp")).collect()}
    assert "published_61_days_ago" in got[1]["ghost_reason"] and got[1]["date_status"] == "expired"
    assert not got[2]["is_ghost"] and got[2]["date_status"] == "unknown_date"
    assert got[3]["status"] == "closed" and not got[4]["is_ghost"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[-1]))
    return row[-1]


def test_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.randrange(12))) for _ in range(2))
        assert dedup.lcs_length(a, b) == lcs(a, b)


def brute_match(a, b, threshold):
    sim = lambda x, y: dedup._indel(" ".join(sorted(x.split())), " ".join(sorted(y.split())))
    if a["url_key"] and a["url_key"] == b["url_key"]:
        return True
    if a["external_id"] and a["source"] and (a["external_id"], a["source"]) == (b["external_id"], b["source"]):
        return True
    x, y = a["company_key"], b["company_key"]
    if not x or not y or not (x == y or (len(x) >= 4 and len(y) >= 4 and (x in y or y in x)) or sim(x, y) >= 90):
        return False
    p, q = a["location_key"], b["location_key"]
    if not (not p or not q or "remoto" in (p, q) or "remote" in (a["work_mode"].lower(), b["work_mode"].lower()) or p in q or q in p):
        return False
    return a["title_key"] == b["title_key"] or sim(a["title_key"], b["title_key"]) >= 100 * threshold


def test_fuzzy_duplicates(spark):
    rows = dedup.with_keys(A.postings(spark, "/root/testdata/sf0.001")).cache()
    new, old = rows.where("posting_seq % 2 = 1"), rows.where("posting_seq % 2 = 0")
    got = {r["posting_seq"]: r["duplicate_of"] for r in dedup.fuzzy_duplicates(new, old).collect()}
    history = sorted(old.collect(), key=lambda r: -r["posting_seq"])
    want = {}
    for a in new.collect():
        hit = next((b["posting_seq"] for b in history if brute_match(a, b, 0.88)), None)
        if hit is not None:
            want[a["posting_seq"]] = hit
    assert got == want and got


def test_changes(spark):
    fields = "struct<salary_min: double, salary_max: double, work_mode: string, location: string, status: string, description: string, published_at: timestamp>"
    old, new = (1000.0, None, "onsite", "Recife", "active", "x", None), (12345678.0, 2.5, "remote", "recife", "active", "y", None)
    df = spark.createDataFrame([(1, old, new)], f"posting_seq long, old {fields}, new {fields}")
    got = changes.changelog(df).collect()
    assert [(r["field_name"], r["old_value"], r["new_value"]) for r in got] == [("salary_min", "1000.0", "12345678.0"), ("salary_max", None, "2.5"), ("work_mode", "onsite", "remote")]
    assert changes.critical(changes.changelog(df)).first()["is_critical"]


def test_feedback(spark):
    rows = [(1, dt.datetime(2024, 1, 1), 1, 1, True, 70), (2, dt.datetime(2024, 1, 2), 1, 1, False, 70)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, profile_id int, posting_seq long, is_positive boolean, score int")
    assert maintenance.feedback_score(df.where("event_id = 1")).first()["score"] == 75
    assert maintenance.feedback_score(df).first()["score"] == 65


def test_breaker():
    s = breaker.step("CLOSED", 0, 0.0, False, 0.0, 2, 60)[1:]
    assert s[0] == "CLOSED"
    s = breaker.step(*s, False, 1.0, 2, 60)[1:]
    assert s[0] == "OPEN"
    assert breaker.step(*s, True, 30.0, 2, 60) == ("OPEN", "OPEN", 2, 61.0)  # refused while it rests
    assert breaker.step(*s, True, 90.0, 2, 60) == ("HALF_OPEN", "CLOSED", 0, 0.0)
    assert breaker.step(*s, False, 90.0, 2, 60) == ("HALF_OPEN", "OPEN", 3, 150.0)


def test_rest_of_the_breaker_matters(spark):
    rows = [("s", k, dt.datetime(2024, 1, 1, 0, 0, 10 * k), k > 2) for k in range(5)]
    df = spark.createDataFrame(rows, "source string, event_id long, ts timestamp, ok boolean")
    found = {r: [x["state"] for x in sorted(breaker.source_health(df, recovery=r).collect(), key=lambda x: x["event_id"])] for r in (5.0, 300.0)}
    assert found == {5.0: ["CLOSED", "CLOSED", "OPEN", "CLOSED", "CLOSED"], 300.0: ["CLOSED", "CLOSED", "OPEN", "OPEN", "OPEN"]}


def test_company_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["ab", "cd", "3m", "br", "alpha", "alphas", "beta", "betta", "gamma", "sol", "x", "industrias", "industria", "aaaaaa", "aaaaab"]
    names = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(220)} | {"ab cd", "cd ab", "3m br", "br 3m", ""})
    left, right = (spark.createDataFrame([(n,) for n in names if hash_of(n) % 3 != k], "company_key string") for k in (0, 1))
    got = {tuple(r) for r in dedup.company_pairs(left, right).collect()}
    ratio = lambda x, y: dedup._indel(*(" ".join(sorted(z.split())) for z in (x, y)))
    match = lambda x, y: x == y or (len(x) >= 4 and len(y) >= 4 and (x in y or y in x)) or ratio(x, y) >= 90
    want = {(x, y) for x in names if x and hash_of(x) % 3 != 0 for y in names if y and hash_of(y) % 3 != 1 and match(x, y)}
    assert got == want and ("ab cd", "cd ab") in {tuple(r) for r in dedup.company_pairs(left.unionByName(right), right.unionByName(left)).collect()}


def hash_of(name):
    return sum(map(ord, name))


def test_decomposition_and_entities(spark):
    import html
    import unicodedata

    texts = ["Ação São ế ǎ", "ﬁm ½ ™ №", "𝐀𝛼 x", "e\u0301", "plain", "", "Ⅷ ㎏ …", "हिन्दी"]
    for t in texts:
        want = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        assert one(spark, text.strip_accents(F.lit(t))) == want
    for t in ("a &amp; b &lt;p&gt; &eacute;&#233;&#xE9; &nosuch; & &;", "&amp;lt;", "&#128512;&copy;", "x"):
        assert one(spark, text.unescape_html(F.lit(t))) == html.unescape(t)
    assert one(spark, text.clean_html(F.lit("&lt;p&gt;a&nbsp;&amp;amp; b&lt;/p&gt;"))) == "a & b"


def test_feedback_in_any_number_of_hours(spark):
    rng = random.Random(3)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(9000)), 1, k % 3, rng.random() < 0.6, 70) for k in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, profile_id int, posting_seq long, is_positive boolean, score int")
    want = {}
    for _, _, _, p, good, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        want[p] = max(0, min(100, want.get(p, 70) + (5 if good else -10)))
    for folded in (7, 1 << 20):
        assert {r["posting_seq"]: r["score"] for r in maintenance.feedback_score(df, folded).collect()} == want
    assert maintenance.feedback_score(df.limit(0)).count() == 0


def test_run_batch_has_one_outcome_each(spark):
    d = "/root/testdata/sf0.001"
    new = A.postings(spark, d).where("posting_seq % 2 = 1")
    out = cycle.run_batch(new, dedup.with_keys(A.earlier_postings(spark, d).where("posting_seq % 2 = 0")), A.profiles(spark), A.as_of())
    per = out.groupBy("posting_seq").agg(F.countDistinct("outcome").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("outcome").alias("outcome")).collect()
    assert len(per) == new.count()
    assert all(r["rows"] == (4 if r["outcome"] in ("new", "invalid") else 1) for r in per)


def test_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = dedup.with_keys(A.postings(spark, "/root/testdata/sf0.001")).select("posting_seq", "content_hash", "discovered_at")
    rows.repartition(1).write.parquet(f"{folder}/in")
    stream = streams.new_postings(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "200 days")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.read.parquet(f"{folder}/out")
    assert got.count() == rows.select("content_hash").distinct().count() == got.select("content_hash").distinct().count()


def test_feeds_skip_what_is_no_posting(spark):
    payloads = ['{"jobs":[{"id":1,"title":"Dev","company_name":"A","url":"u"},{"id":2,"title":""}]}', "not json", None]
    df = spark.createDataFrame([("s", p) for p in payloads], "source string, payload string")
    assert [r["external_id"] for r in feeds.parse_json_feed(df, feeds.FEEDS["flat"]).collect()] == ["1"]


@pytest.mark.parametrize("name", ["j1_not_known", "j3_fuzzy_duplicates"])
def test_no_nested_loops(spark, name):
    from postlake.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blend_and_favourites(spark):
    from postlake.operators import accounts

    df = spark.createDataFrame([(1, 75, None), (2, 75, 150), (3, 75, -5)], "k int, rule int, external int")
    got = {r["k"]: r["s"] for r in df.select("k", accounts.blended(F.col("rule"), F.col("external")).alias("s")).collect()}
    assert got == {1: 75, 2: 85, 3: 45}
    rows = [(1, 1, 1, True, "a"), (1, 1, 2, True, ""), (1, 2, 1, True, "x"), (1, 2, 2, False, ""), (1, 3, 1, True, "old"), (1, 3, 2, False, ""), (1, 3, 3, True, "")]
    df = spark.createDataFrame(rows, "profile_id int, posting_seq int, seq int, wanted boolean, note string")
    assert {(r["posting_seq"], r["note"]) for r in accounts.favourites(df).collect()} == {(1, "a"), (3, "")}


def test_reasons(spark):
    from postlake.operators import outcomes

    rows = [("Dev", "Python e SQL", ["Git"], ["SQL", "Python", "Rust"], "remote", 90), ("Dev", None, None, [], "onsite", 40)]
    df = spark.createDataFrame(rows, "title string, description string, requirements array<string>, skills array<string>, work_mode string, seniority_score int")
    a, b = (r["reasons"] for r in outcomes.reasons(df).collect())
    assert a == ["python é um match forte", "sql é um match forte", "Trabalho remoto compatível com preferência", "Senioridade compatível"]
    assert b == ["Perfil geral compatível com a descrição", "Gap de senioridade: verificar requisitos"]


def test_search_and_dates(spark):
    from postlake.functions import feed_text

    rows = [("Estágio em TI",), ("estagio",), ("Dev",), (None,)]
    df = spark.createDataFrame(rows, "title string")
    assert df.where(feed_text.search_predicate("Estagio", ["title"])).count() == 2
    read = feed_text.parse_posted_at(F.lit("Wed, 31 Jan 2024 10:00:00 +0000"), "rfc2822")
    assert one(spark, read)["published_at"] == dt.datetime(2024, 1, 31, 10) or one(spark, read)["date_status"] == "verified"
    assert one(spark, feed_text.parse_posted_at(F.lit("?"), "epoch"))["date_status"] == "unknown_date"


def test_history_duplicates_and_funnel(spark):
    from postlake.plans import feed_queries

    d = "/root/testdata/sf0.001"
    found = feed_queries.d3(spark, d).collect()
    assert len({r["posting_seq"] for r in found}) == len(found) and {r["kind"] for r in found} == {"exact", "similar"}
    per = {r["outcome"]: r["n"] for r in feed_queries.a7(spark, d).collect()}
    assert set(per) <= {"ghost", "dup_in_batch", "dup_history", "invalid", "new"} and sum(per.values()) >= 100


def test_continuous_cycle(spark):
    d, folder = "/root/testdata/sf0.001", tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    new = A.postings(spark, d).where("posting_seq % 2 = 1")
    history = dedup.with_keys(A.earlier_postings(spark, d).where("posting_seq % 2 = 0").withColumns({"seniority": F.lit(""), "employment_type": F.lit(""), "discovered_at": A.as_of(), "requirements": F.array().cast("array<string>")}))
    channels = spark.createDataFrame([(k, "chat", True, 40) for k in (1, 2, 3, 4)], "profile_id int, channel string, enabled boolean, minimum_score int")
    for k in (0, 1):
        new.where(f"posting_seq % 4 = {1 + 2 * k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")

    store = Tables(spark, f"{folder}/store", buckets=64)
    store.commit("before", streams.remember(store, history))

    def start(checkpoint):
        source = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        run = streams.continuous_cycle(source, store, A.profiles(spark), channels, A.as_of(), name="feed", checkpoint=f"{folder}/{checkpoint}")
        run.awaitTermination(300)
        assert run.exception() is None
        return {name: sorted(map(str, store.read(name).collect())) for name in ("outcomes", "outbox", "by_hash", "by_kind", "names")}

    once = start("state")
    out = store.read("outcomes")
    assert out.select("batch").distinct().count() == 2 and len(once["outbox"]) > 0
    halves = [new.where(f"posting_seq % 4 = {k}") for k in (1, 3)]
    if out.where("batch = 0").first()["posting_seq"] % 4 == 3:
        halves.reverse()
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    first = cycle.run_batch(halves[0], history, A.profiles(spark), A.as_of())
    assert same(out.where("batch = 0").drop("batch").select(*first.columns), first)
    # the second batch sees what the first one added, as if history had been read whole
    added = dedup.with_keys(halves[0]).join(first.where("outcome = 'new'").select("posting_seq").distinct(), "posting_seq", "left_semi")
    second = cycle.run_batch(halves[1], history.unionByName(added, allowMissingColumns=True), A.profiles(spark), A.as_of())
    assert same(out.where("batch = 1").drop("batch").select(*second.columns), second)
    sent = store.read("outbox").groupBy("profile_id", "posting_seq", "channel").count()
    assert sent.where("count > 1").count() == 0
    assert start("state") == once  # nothing new: nothing is sent
    assert start("other-state") == once  # batches that are run again change nothing
    # of the key tables, a batch of one posting reads a bucket each
    probe = added.limit(1)
    one = streams.recalled(store, probe)
    assert len(one.by_hash.inputFiles()) <= 1 and len(one.by_url.inputFiles()) <= 1 and store.read("by_hash").inputFiles()[1:]
