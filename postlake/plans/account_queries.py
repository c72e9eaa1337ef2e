"""Queries of feeds' text functions, users' tables, reports and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import feed_text as T
from postlake.operators import accounts, changes, dedup, freshness, ranking, resumes, validation, views
from postlake.plans import oracle as O
from postlake.plans.queries import _C6, _VALID, pairs, query, versions
from postlake.sources import adapters as A

NOW = O.NOW


def _named(c: str, table) -> str:
    return "CASE " + " ".join(f"WHEN {O.anyof(c, words)} THEN {O.q(v)}" for v, words in table)


@query("n12_feed_seniority", f"""WITH {O.POSTINGS} SELECT posting_seq, coalesce({_named('lower(seniority)', T.DECLARED)} END, {_named('lower(title)', T.FEED_LEVELS['global'])} ELSE 'mid' END) AS level,
  {_named('lower(title)', T.FEED_LEVELS['latin'])} ELSE 'mid' END AS latin, {_named('lower(title)', T.FEED_LEVELS['remote'])} ELSE 'mid' END AS remote FROM p""")  # fmt: skip
def n12(spark: SparkSession, d: str) -> DataFrame:
    title = F.col("title")
    return A.postings(spark, d).select(
        "posting_seq", T.infer_seniority_feed(title, F.col("seniority")).alias("level"),
        T.infer_seniority_feed(title, feed="latin").alias("latin"), T.infer_seniority_feed(title, feed="remote").alias("remote"),
    )


@query("n13_kinds", f"WITH {O.POSTINGS} SELECT posting_seq, {_named('lower(employment_type)', T.EMPLOYMENT_TYPES)} ELSE 'clt' END AS kind, CASE WHEN posting_seq % 7 = 0 THEN 'remote' ELSE {_named('lower(work_mode)', T.WORK_MODES)} ELSE 'onsite' END END AS mode FROM p")
def n13(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).select("posting_seq", T.map_employment_type(F.col("employment_type")).alias("kind"), T.map_work_mode(F.col("work_mode"), F.col("posting_seq") % 7 == 0).alias("mode"))


@query("n15_posted_at", f"""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN t END AS iso, CASE WHEN event_id % 4 = 0 THEN 'unknown_date' ELSE 'verified' END AS iso_status,
  CASE WHEN event_id % 4 <> 1 THEN t END AS rfc, t AS epoch FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events) e""")  # fmt: skip
def n15(spark: SparkSession, d: str) -> DataFrame:
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    shown = A.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"),
        F.when(F.col("event_id") % 4 == 1, "").otherwise(F.date_format(t, "EEE, d MMM yyyy HH:mm:ss '+0000'")).alias("rfc"),
        F.unix_seconds(t).cast("string").alias("epoch"),
    )
    plain = lambda c: c.cast("timestamp_ntz")
    parsed = shown.select("event_id", T.parse_posted_at(F.col("iso")).alias("i"), T.parse_posted_at(F.col("rfc"), "rfc2822").alias("r"), T.parse_posted_at(F.col("epoch"), "epoch").alias("e"))
    return parsed.select("event_id", plain(F.col("i.published_at")).alias("iso"), F.col("i.date_status").alias("iso_status"), plain(F.col("r.published_at")).alias("rfc"), plain(F.col("e.published_at")).alias("epoch"))


@query("n16_to_float", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS amount FROM events")
def n16(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("event_id") % 3 == 0, "a combinar").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return A.table(spark, d, "events").select("event_id", T.to_float(shown).alias("amount"))


@query("n17_external_id", f"WITH {O.POSTINGS} SELECT posting_seq, CASE WHEN regexp_matches(url, '/v([0-9]+)') THEN 'v-' || regexp_extract(url, '/v([0-9]+)', 1) ELSE url END AS external_id FROM p")
def n17(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).select("posting_seq", T.external_id_from_url(F.col("url"), prefix="v-").alias("external_id"))


_VARIANTS = " OR ".join(f"{c} ILIKE {O.q(v)}" for c in ("title", "company", "location") for v in T.search_variants("estagio"))


@query("n19_search", f"WITH {O.POSTINGS} SELECT posting_seq FROM p WHERE {_VARIANTS}")
def n19(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).where(T.search_predicate("estagio", ["title", "company", "location"])).select("posting_seq")


# Users' events, in SQL that Spark and other engines read alike.
_MARKS = """SELECT event_id AS seq, CAST(user_id % 4 + 1 AS INT) AS profile_id, event_id % 97 AS posting_seq, event_type <> 'error' AS wanted,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('note ', CAST(event_id % 50 AS STRING)) END AS note FROM {events}"""
_PREFS = "SELECT c_custkey AS user_id, CAST(c_custkey % 100 AS INT) AS minimum_score, CAST(30 + c_custkey % 60 AS INT) AS max_age_days FROM {customer}"
_UPDATES = """SELECT o_custkey AS user_id, o_orderkey AS seq, o_orderstatus = 'P' AS reset, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 90 END AS INT) AS minimum_score,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 300 + 1 END AS INT) AS max_age_days FROM {orders}"""


def derived(spark: SparkSession, d: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: A.table(spark, d, name)})


_M4 = f"""WITH e AS ({_MARKS.format(events='events')}), m AS (SELECT *, max(seq) FILTER (NOT wanted) OVER (PARTITION BY profile_id, posting_seq) AS gone FROM e),
fav AS (SELECT profile_id, posting_seq, coalesce(arg_max(note, seq) FILTER (note <> ''), '') AS note FROM m WHERE gone IS NULL OR seq > gone GROUP BY 1, 2)"""


@query("m4_favourites", _M4 + " SELECT * FROM fav")
def m4(spark: SparkSession, d: str) -> DataFrame:
    return accounts.favourites(derived(spark, d, _MARKS, "events"))


@query("m5_feedback", f"SELECT profile_id, posting_seq, arg_max(wanted, seq) AS wanted, max(seq) AS seq FROM ({_MARKS.format(events='events')}) e GROUP BY 1, 2")
def m5(spark: SparkSession, d: str) -> DataFrame:
    e = derived(spark, d, _MARKS, "events")
    return e.groupBy("profile_id", "posting_seq").agg(F.max_by("wanted", "seq").alias("wanted"), F.max("seq").alias("seq"))


@query("m6_preferences", f"""WITH s AS ({_PREFS.format(customer='customer')}), u AS (SELECT *, max(seq) FILTER (reset) OVER (PARTITION BY user_id) AS cut FROM ({_UPDATES.format(orders='orders')}) q),
n AS (SELECT user_id, bool_or(reset) AS r, arg_max(minimum_score, seq) FILTER (NOT reset AND minimum_score IS NOT NULL) AS a, arg_max(max_age_days, seq) FILTER (NOT reset AND max_age_days IS NOT NULL) AS b
  FROM u WHERE cut IS NULL OR seq > cut OR reset GROUP BY user_id)
SELECT user_id, coalesce(a, CASE WHEN r THEN 70 ELSE minimum_score END) AS minimum_score, coalesce(b, CASE WHEN r THEN 60 ELSE max_age_days END) AS max_age_days FROM s LEFT JOIN n USING (user_id)""")  # fmt: skip
def m6(spark: SparkSession, d: str) -> DataFrame:
    return accounts.preferences(derived(spark, d, _PREFS, "customer"), derived(spark, d, _UPDATES, "orders"), {"minimum_score": 70, "max_age_days": 60})


@query("m8_user_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def m8(spark: SparkSession, d: str) -> DataFrame:
    deleted = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return accounts.without_users(A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), deleted, "o_custkey").select("o_orderkey")


_ATTEMPTS = "SELECT event_id, ts, event_type <> 'error' AS ok, repeat(props, 400) AS error FROM {events}"


@query("m9_log", f"""SELECT event_id, CASE WHEN ok THEN 'sent' ELSE 'failed' END AS status, CASE WHEN NOT ok THEN substr(error, 1, 2000) END AS error, CASE WHEN ok THEN ts END AS sent_at
FROM ({_ATTEMPTS.format(events='events')}) a""")  # fmt: skip
def m9(spark: SparkSession, d: str) -> DataFrame:
    return accounts.notification_log(derived(spark, d, _ATTEMPTS, "events"))


@query("a4_sent_count", "SELECT count(*) FILTER (event_type <> 'error') AS sent FROM events")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return accounts.notification_log(derived(spark, d, _ATTEMPTS, "events")).agg(F.count_if(F.col("status") == "sent").alias("sent"))


@query("j7_posting_match", f"""WITH {O.PAIRS}, m AS (SELECT posting_seq, profile_id, score FROM {O.ranked('pairs')} WHERE {_VALID} = 'valid')
SELECT p.posting_seq, m.profile_id, m.score FROM p LEFT JOIN m ON p.posting_seq = m.posting_seq""")  # fmt: skip
def j7(spark: SparkSession, d: str) -> DataFrame:
    rows = validation.validate(pairs(spark, d)).where("is_valid")
    matches = ranking.rank(rows, A.as_of()).select("posting_seq", "profile_id", "score")
    return A.postings(spark, d).select("posting_seq").join(matches, "posting_seq", "left")


@query("j8_favourite_postings", f"{_M4}, {O.POSTINGS} SELECT fav.profile_id, posting_seq, note, title FROM fav JOIN p USING (posting_seq)")
def j8(spark: SparkSession, d: str) -> DataFrame:
    return m4(spark, d).join(A.postings(spark, d).select("posting_seq", "title"), "posting_seq")


@query("j9_notification_postings", f"WITH {O.POSTINGS} SELECT event_id, title FROM events LEFT JOIN p ON event_id % 400 = posting_seq")
def j9(spark: SparkSession, d: str) -> DataFrame:
    log = A.table(spark, d, "events").select("event_id", (F.col("event_id") % 400).alias("posting_seq"))
    return log.join(A.postings(spark, d).select("posting_seq", "title"), "posting_seq", "left").select("event_id", "title")


@query("j10_without_dismissed", f"WITH {O.POSTINGS} SELECT posting_seq FROM p WHERE posting_seq NOT IN (SELECT event_id % 500 FROM events WHERE event_type = 'error')")
def j10(spark: SparkSession, d: str) -> DataFrame:
    dismissed = A.table(spark, d, "events").where("event_type = 'error'").select((F.col("event_id") % 500).alias("posting_seq")).distinct()
    return A.postings(spark, d).select("posting_seq").join(dismissed, "posting_seq", "left_anti")


@query("u4_presented", "SELECT DISTINCT CAST(user_id % 4 + 1 AS INT) AS profile_id, event_id % 300 AS posting_seq FROM events WHERE event_type = 'view'")
def u4(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").where("event_type = 'view'").select((F.col("user_id") % 4 + 1).cast("int").alias("profile_id"), (F.col("event_id") % 300).alias("posting_seq")).distinct()


@query("c8_batch_differences", _C6 + f""", old AS (SELECT * FROM e WHERE posting_seq % 7 <> 1), new AS (SELECT * FROM p WHERE posting_seq % 5 <> 1)
SELECT coalesce(o.posting_seq, n.posting_seq) AS posting_seq, CASE WHEN o.posting_seq IS NULL THEN 'new' WHEN n.posting_seq IS NULL THEN 'not_seen'
  WHEN o.posting_seq IN (SELECT posting_seq FROM c) THEN 'updated' ELSE 'unchanged' END AS difference FROM old o FULL JOIN new n ON o.posting_seq = n.posting_seq""")  # fmt: skip
def c8(spark: SparkSession, d: str) -> DataFrame:
    old, new = A.earlier_postings(spark, d).where("posting_seq % 7 <> 1"), A.postings(spark, d).where("posting_seq % 5 <> 1")
    return accounts.batch_differences(old, new, changes.changelog(versions(spark, d)))


@query("a3_run_totals", "SELECT count(*) AS runs, coalesce(sum(event_id % 7), 0)::BIGINT AS duplicates, coalesce(sum(CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 11 END), 0)::BIGINT AS discards FROM events")
def a3(spark: SparkSession, d: str) -> DataFrame:
    runs = A.table(spark, d, "events").select((F.col("event_id") % 7).alias("duplicates"), F.when(F.col("event_type") != "error", F.col("event_id") % 11).alias("discards"))
    return runs.agg(F.count(F.lit(1)).alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("duplicates", "discards")])


@query("a5_dashboard", f"WITH {O.PAIRS} SELECT profile_id, count(*) AS total, count(*) FILTER (score >= 70) AS matches, max(score) AS best FROM {O.ranked('pairs')} GROUP BY profile_id")
def a5(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d), A.as_of())
    return rows.groupBy("profile_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("score") >= 70).alias("matches"), F.max("score").alias("best"))


@query("a11_title_count", f"WITH {O.POSTINGS} SELECT count(*) FILTER (title ILIKE '%python%') AS n FROM p")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).agg(F.count_if(F.ilike("title", F.lit("%python%"))).alias("n"))


@query("w4_top_active", f"WITH {O.PAIRS} SELECT posting_seq, score FROM {O.ranked('pairs')} WHERE profile_id = 3 AND status = 'active' ORDER BY score DESC, posting_seq DESC LIMIT 5")
def w4(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d).where("profile_id = 3 and status = 'active'"), A.as_of())
    return rows.orderBy(F.desc("score"), F.desc("posting_seq")).limit(5).select("posting_seq", "score")


@query("w5_latest_run", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("r11_blend", f"WITH {O.PAIRS} SELECT posting_seq, profile_id, CASE WHEN posting_seq % 3 = 0 THEN CAST(round_even(0.6::DOUBLE * score + 0.4::DOUBLE * greatest(0, least(100, posting_seq * 7 % 140 - 20)), 0) AS INT) ELSE score END AS score FROM {O.ranked('pairs')}")
def r11(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d), A.as_of()).select("posting_seq", "profile_id", "score")
    external = A.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("posting_seq"), (F.col("doc_id") * 7 % 140 - 20).alias("_external"))
    return rows.join(external, "posting_seq", "left").select("posting_seq", "profile_id", accounts.blended(F.col("score"), F.col("_external")).alias("score"))


@query("t4_in_week", f"WITH {O.POSTINGS}, {O.FRESH} SELECT posting_seq FROM f WHERE status = 'active' AND (published_at >= {NOW} - INTERVAL 7 DAY OR discovered_at >= {NOW} - INTERVAL 7 DAY)")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return freshness.freshness(A.postings(spark, d), A.as_of()).where((F.col("status") == "active") & views.in_week(A.as_of())).select("posting_seq")


@query("t8_next_runs", """WITH l AS (SELECT user_id, max(ts) AS last, arg_max(event_type = 'error', (ts, event_id)) AS running FROM events GROUP BY user_id), n AS (SELECT max(ts) AS t FROM events)
SELECT user_id, last + to_minutes(CAST(60 + user_id % 5 * 600 AS BIGINT)) <= t AS is_due, CASE WHEN running THEN t + to_minutes(CAST(60 + user_id % 5 * 600 AS BIGINT)) ELSE greatest(last + to_minutes(CAST(60 + user_id % 5 * 600 AS BIGINT)), t) END AS next_run FROM l, n""")  # fmt: skip
def t8(spark: SparkSession, d: str) -> DataFrame:
    runs = A.table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("started_at"), (F.col("event_type") == "error").alias("running"))
    now = F.lit(runs.agg(F.max("started_at")).first()[0]).cast("timestamp_ntz")
    return accounts.next_runs(runs, (60 + F.col("user_id") % 5 * 600).cast("int"), now)


@query("t9_event_time", f"WITH {O.POSTINGS} SELECT posting_seq, coalesce(published_at, discovered_at) AS event_time FROM p")
def t9(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).select("posting_seq", F.coalesce("published_at", "discovered_at").alias("event_time"))


@query("d5_alternative_sources", f"""WITH {O.KEYED}, g AS (SELECT *, first_value(source) OVER w AS s, first_value(url) OVER w AS u, min(posting_seq) OVER (PARTITION BY content_hash) AS target FROM k
  WINDOW w AS (PARTITION BY content_hash ORDER BY posting_seq))
SELECT target AS posting_seq, url, arg_min(source, posting_seq) AS source FROM g WHERE source <> s AND url <> u GROUP BY target, url""")  # fmt: skip
def d5(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.with_keys(A.postings(spark, d)).select("posting_seq", "source", "url", "content_hash")
    first = rows.groupBy("content_hash").agg(F.min_by(F.struct(F.col("posting_seq").alias("target"), F.col("source").alias("target_source"), F.col("url").alias("target_url")), "posting_seq").alias("t"))
    return accounts.alternative_sources(rows.join(first.select("content_hash", "t.*"), "content_hash").withColumnRenamed("posting_seq", "seq"))


_LETTER = r"[\p{L}\p{N}_]"
_CLEAN = "coalesce(text, '')"
for _old, _new in resumes.LIGATURES.items():
    _CLEAN = f"replace({_CLEAN}, '{_old}', '{_new}')"
_CLEAN = O.rx(_CLEAN, rf"({_LETTER}+)-[ \t\r\n\f]*\n[ \t\r\n\f]*({_LETTER}+)", r"\1\2")
_CLEAN = O.rx(O.rx(O.rx(_CLEAN, resumes.BULLETS, "•"), r"\n{3,}", "\n\n"), r"^[ \t\r\n\f]+|[ \t\r\n\f]+\z")


@query("x1_clean_text", f"SELECT doc_id, sha256({_CLEAN}) AS digest FROM documents")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", F.sha2(resumes.clean_text(F.col("text")), 256).alias("digest"))


_MARKED = rf"list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{_LETTER}+'))"


@query("x7_is_english", f"SELECT doc_id, len(list_intersect({_MARKED}, {O.lst(resumes.ENGLISH)})) > len(list_intersect({_MARKED}, {O.lst(resumes.PORTUGUESE)})) AS english FROM documents")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", resumes.is_english(F.col("text")).alias("english"))
