"""The operators as queries over the supplied tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import text
from postlake.operators import breaker, changes, clusters, dedup, freshness, maintenance, ranking, validation, views
from postlake.plans import cycle
from postlake.plans import oracle as O
from postlake.sources import adapters as A
from postlake.sources import feeds
from postlake.streaming import cycle as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _scalar(name: str, column: str, make: Callable, sql: str) -> None:
    """A query of one text function over all postings."""
    query(name, f"WITH {O.POSTINGS} SELECT posting_seq, {sql} AS {column} FROM p")(
        lambda spark, d: A.postings(spark, d).select("posting_seq", make().alias(column))
    )


_scalar("n1_strip_accents", "bare", lambda: text.strip_accents(F.col("title")), O.bare("title"))
_scalar("n2_normalize_text", "plain", lambda: text.normalize_text(F.col("title")), O.ntext("title"))
_scalar("n3_normalize_url", "url_key", lambda: text.normalize_url(F.col("url")), O.url("url"))
_scalar("n4_normalize_company", "company_key", lambda: text.normalize_company(F.col("company")), O.company("company"))
_scalar("n5_normalize_title", "title_words", lambda: text.normalize_title(F.col("title")), O.title("title"))
_scalar("n6_title_key", "title_key", lambda: text.title_key(F.col("title")), O.title_key("title"))
_scalar("n7_normalize_location", "location_key", lambda: text.normalize_location(F.col("location")), O.location("location"))
_scalar("n8_content_hash", "content_hash", lambda: text.content_hash(*map(F.col, ("title", "company", "location", "url", "external_id"))), O.chash())
_scalar("n9_dedup_key", "dedup_key", lambda: text.dedup_key(*map(F.col, ("title", "company", "location"))), O.key())
_scalar("n11_infer_seniority", "level", lambda: text.infer_seniority(F.col("title"), F.col("description")), O.seniority())
_scalar("n20_city_part", "city", lambda: text.city_part(F.col("location")), "trim(string_split_regex(location, '[,/-]')[1])")
_scalar("n21_escape_html", "safe", lambda: text.escape_html(F.col("description")), "replace(replace(replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')")
_scalar("n21_truncate", "cut", lambda: text.truncate(F.col("description")), "CASE WHEN length(description) <= 4000 THEN description ELSE description[1:3985] || '... [truncado]' END")


# the entities that the pages hold, apart from those that start another one
_UNESCAPED = "{0}"
for _name, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", chr(34)), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", chr(0xA0)), ("&#39;", "''"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_name}', '{_char}')"
_N10 = _UNESCAPED.replace("{0}", f"regexp_replace({_UNESCAPED.replace('{0}', 'html')}, '<[^>]+>', ' ', 'g')")


@query("n10_clean_html", f"SELECT page_id, substr(trim(regexp_replace(coalesce({_N10}, ''), '[\\s\u00a0]+', ' ', 'g')), 1, 2000) AS plain FROM pages")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("plain"))


@query("n14_parse_salary", f"""WITH {O.POSTINGS} SELECT posting_seq, CASE WHEN salary_min IS NOT NULL THEN 1000.5 + posting_seq % 9 END AS low,
  CASE WHEN salary_min IS NOT NULL THEN CASE WHEN posting_seq % 2 = 0 THEN 2000.0 ELSE 1000.5 + posting_seq % 9 END END AS high FROM p""")  # fmt: skip
def n14(spark: SparkSession, d: str) -> DataFrame:
    amount = F.concat(F.lit("R$ 1.00"), (F.col("posting_seq") % 9).cast("string"), F.lit(",50"), F.when(F.col("posting_seq") % 2 == 0, " – R$ 2.000,00").otherwise(""))
    shown = A.postings(spark, d).withColumn("shown", F.when(F.col("salary_min").isNotNull(), F.concat(F.lit("Salário: "), amount)).otherwise("a combinar"))
    return shown.select("posting_seq", text.parse_salary(F.col("shown")).alias("s")).select("posting_seq", "s.low", "s.high")


@query("f3_freshness", f"WITH {O.POSTINGS}, {O.FRESH} SELECT posting_seq, is_ghost, status, ghost_reason, date_status FROM f")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return freshness.freshness(A.postings(spark, d), A.as_of()).select("posting_seq", "is_ghost", "status", "ghost_reason", "date_status")


@query("f1_age_status", f"WITH {O.POSTINGS} SELECT posting_seq, {O.AGE} AS reason FROM p")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).select("posting_seq", freshness.age_reason(F.col("published_at"), A.as_of()).alias("reason"))


@query("f2_closure_signal", f"WITH {O.POSTINGS} SELECT posting_seq, {O.CLOSED} AS reason FROM p")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).select("posting_seq", freshness.closure_reason(F.concat_ws(" ", "title", "description")).alias("reason"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every posting, with what rules and scores find in it alone, with every profile."""
    fresh = freshness.freshness(A.postings(spark, d), A.as_of())
    return ranking.with_signals(validation.with_signals(fresh)).crossJoin(A.small(A.profiles(spark)))


def _rule(name: str, sql: str) -> None:
    query(f"{name}_rule", f"WITH {O.PAIRS} SELECT posting_seq, profile_id, {sql} AS reason FROM pairs")(
        lambda spark, d: pairs(spark, d).select("posting_seq", "profile_id", validation.rule_table()[name].alias("reason"))
    )


_V = O.v_rules()
for _name, _sql in _V.items():
    _rule(_name, _sql)
_VALID = f"coalesce({', '.join(_V.values())}, 'valid')"


@query("v14_validate", f"WITH {O.PAIRS} SELECT posting_seq, profile_id, {_VALID} AS discard_reason, {_VALID} = 'valid' AS is_valid FROM pairs")
def v14(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate(pairs(spark, d)).select("posting_seq", "profile_id", "discard_reason", "is_valid")


@query("h1_hard_filter", f"WITH {O.PAIRS} SELECT posting_seq, profile_id, {O.hard()} AS filter_reason FROM pairs")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return validation.hard_filter(pairs(spark, d)).select("posting_seq", "profile_id", "filter_reason")


@query("a6_discard_reasons", f"WITH {O.PAIRS} SELECT profile_id, {_VALID} AS discard_reason, count(*) AS n FROM pairs GROUP BY 1, 2")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return views.reason_histogram(validation.validate(pairs(spark, d)), "profile_id", "discard_reason")


_SCORES = ["role_score", "skills_score", "seniority_score", "location_score", "recency_score"]


@query("r10_rank", f"WITH {O.PAIRS} SELECT posting_seq, profile_id, {', '.join(_SCORES)}, recency_score AS salary_score, score FROM {O.ranked('pairs')}")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank(pairs(spark, d), A.as_of()).select("posting_seq", "profile_id", *_SCORES, "salary_score", "score")


@query("r9_reasoning", f"WITH {O.PAIRS} SELECT posting_seq, profile_id, {O.reasoning()} AS reasoning FROM pairs")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return ranking.reasoned(pairs(spark, d)).select("posting_seq", "profile_id", "reasoning")


def _score(name: str, column: str, make: Callable) -> None:
    query(name, f"WITH {O.PAIRS} SELECT posting_seq, profile_id, {O.r_scores()[column]} AS {column} FROM pairs")(
        lambda spark, d: pairs(spark, d).select("posting_seq", "profile_id", make().alias(column))
    )


_score("r1_role_score", "role_score", ranking.role_score)
_score("r2_skills_score", "skills_score", ranking.skills_score)
_score("r3_seniority_score", "seniority_score", ranking.seniority_score)
_score("r4_location_score", "location_score", ranking.location_score)
_score("r5_recency_score", "recency_score", lambda: ranking.recency_score(A.as_of()))


@query("w1_top_per_profile", f"""WITH {O.PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC NULLS LAST, posting_seq DESC) AS place FROM {O.ranked('pairs')})
SELECT profile_id, posting_seq, score, place FROM r WHERE place <= 30""")  # fmt: skip
def w1(spark: SparkSession, d: str) -> DataFrame:
    return views.top_per(ranking.rank(pairs(spark, d), A.as_of()), "profile_id", 30).select("profile_id", "posting_seq", "score", "place")


_SAID = " OR ".join(f"{c} ILIKE '%{v}%'" for c in ("title", "company", "location", "description") for v in ("estágio", "estagio", "estag_o"))


@query("w3_list", f"""WITH {O.PAIRS} SELECT posting_seq, title, score FROM {O.ranked('pairs')} WHERE profile_id = 1 AND status = 'active' AND score >= 40
  AND ({_SAID}) ORDER BY score DESC NULLS LAST, posting_seq DESC LIMIT 50""")  # fmt: skip
def w3(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d).where("profile_id = 1"), A.as_of())
    return views.list_postings(rows, A.as_of(), status="active", search="estágio", min_score=40).select("posting_seq", "title", "score")


@query("a1_status_counts", f"WITH {O.POSTINGS}, {O.FRESH} SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'potential_ghost') AS potential_ghost, count(*) FILTER (status = 'closed') AS closed FROM f")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return views.status_counts(freshness.freshness(A.postings(spark, d), A.as_of()))


@query("a2_by_source", f"WITH {O.POSTINGS} SELECT source, count(*) AS n FROM p GROUP BY source")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_WEEK = f"(status = 'active' AND coalesce(published_at >= {O.NOW} - INTERVAL 7 DAY OR discovered_at >= {O.NOW} - INTERVAL 7 DAY, false))"


@query("d2_first_per_id", f"WITH {O.POSTINGS} SELECT min(posting_seq) AS posting_seq, source, external_id FROM p WHERE external_id <> '' GROUP BY source, external_id")
def d2(spark: SparkSession, d: str) -> DataFrame:
    rows = A.postings(spark, d).where("external_id <> ''").select("posting_seq", "source", "external_id")
    return dedup.first_per(rows, "source", "external_id")


@query("d1_first_per_hash", f"WITH {O.KEYED} SELECT min(posting_seq) AS posting_seq, content_hash FROM k GROUP BY content_hash")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_per(dedup.with_keys(A.postings(spark, d)).select("posting_seq", "content_hash"), "content_hash")


# rows one by one, each with the keys that those before it left behind
@query("d1_admitted", f"""WITH RECURSIVE {O.POSTINGS}, t AS MATERIALIZED (SELECT posting_seq, row_number() OVER (ORDER BY posting_seq) AS i,
  dense_rank() OVER (ORDER BY h) AS h, dense_rank() OVER (ORDER BY d) AS d FROM (SELECT posting_seq, {O.chash()} AS h, {O.key()} AS d FROM p)),
s(i, posting_seq, stays, hs, ds) AS (SELECT 0::BIGINT, NULL::BIGINT, false, []::BIGINT[], []::BIGINT[] UNION ALL
  SELECT i, posting_seq, fresh, CASE WHEN fresh THEN list_append(hs, h) ELSE hs END, CASE WHEN fresh THEN list_append(ds, d) ELSE ds END
  FROM (SELECT t.*, hs, ds, NOT (list_contains(hs, h) OR list_contains(ds, d)) AS fresh FROM s JOIN t ON t.i = s.i + 1))
SELECT posting_seq FROM s WHERE stays""")  # fmt: skip
def d1_admitted(spark: SparkSession, d: str) -> DataFrame:
    return clusters.admitted(dedup.with_keys(A.postings(spark, d)))


@query("d4_duplicate_clusters", f"""WITH RECURSIVE {O.POSTINGS}, {O.keyed('k', 'p')}, {O.similar('k', 'k')},
cc(id, low) USING KEY (id) AS (SELECT posting_seq, posting_seq FROM k UNION
  SELECT dup.duplicate_of, min(u.low) FROM cc u JOIN dup ON dup.posting_seq = u.id JOIN recurring.cc v ON v.id = dup.duplicate_of WHERE u.low < v.low GROUP BY 1)
SELECT id AS posting_seq, low AS cluster_id, count(*) OVER (PARTITION BY low) AS cluster_size FROM cc""")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return clusters.duplicate_clusters(dedup.with_keys(A.postings(spark, d)))


@query("d6_best_per_url", f"""WITH {O.PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY profile_id, lower(trim(url)) ORDER BY score DESC NULLS LAST, posting_seq DESC) AS n FROM {O.ranked('pairs')})
SELECT profile_id, posting_seq, score FROM r WHERE n = 1 OR url = ''""")  # fmt: skip
def d6(spark: SparkSession, d: str) -> DataFrame:
    return dedup.best_per_url(ranking.rank(pairs(spark, d), A.as_of()), "profile_id").select("profile_id", "posting_seq", "score")


@query("j1_not_known", f"""WITH {O.KEYED} SELECT posting_seq FROM k WHERE posting_seq % 2 = 1
  AND url_key NOT IN (SELECT url_key FROM k WHERE posting_seq % 2 = 0 AND url_key <> '')
  AND NOT EXISTS (SELECT 1 FROM k h WHERE h.posting_seq % 2 = 0 AND h.external_id <> '' AND h.source = k.source AND h.external_id = k.external_id)""")  # fmt: skip
def j1(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.with_keys(A.postings(spark, d))
    return dedup.not_known(rows.where("posting_seq % 2 = 1"), rows.where("posting_seq % 2 = 0")).select("posting_seq")


@query("j2_known_hash", f"WITH {O.KEYED} SELECT a.posting_seq, max(b.posting_seq) AS known FROM k a JOIN k b USING (content_hash) WHERE a.posting_seq % 2 = 1 AND b.posting_seq % 2 = 0 GROUP BY a.posting_seq")
def j2(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.with_keys(A.postings(spark, d)).select("posting_seq", "content_hash")
    known = rows.where("posting_seq % 2 = 0").groupBy("content_hash").agg(F.max("posting_seq").alias("known"))
    return rows.where("posting_seq % 2 = 1").join(known, "content_hash").select("posting_seq", "known")


_HALVES = f"""{O.POSTINGS}, {O.keyed('k', 'p')}, mine AS MATERIALIZED (SELECT * FROM k WHERE posting_seq % 2 = 1), theirs AS MATERIALIZED (SELECT * FROM k WHERE posting_seq % 2 = 0), {O.similar('mine', 'theirs')}"""


@query("j3_fuzzy_duplicates", f"WITH {_HALVES} SELECT posting_seq, max(duplicate_of) AS duplicate_of FROM dup GROUP BY posting_seq")
def j3(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.with_keys(A.postings(spark, d))
    return dedup.fuzzy_duplicates(rows.where("posting_seq % 2 = 1"), rows.where("posting_seq % 2 = 0"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    old = A.earlier_postings(spark, d)
    new = A.postings(spark, d).withColumn("status", F.lit("active"))
    fields = ["salary_min", "salary_max", "work_mode", "location", "status", "description", "published_at"]
    return old.select("posting_seq", F.struct(*fields).alias("old")).join(new.select("posting_seq", F.struct(*fields).alias("new")), "posting_seq")


_LOWS = "lower(trim({0}))"
def changes_sql(c: str, v: str) -> str:
    """A CTE of changes, of one whose rows have posting_seq and old and new values o1 to o7 and n1 to n7."""
    return f"""{c} AS (
SELECT posting_seq, 'salary_min' AS field_name, CAST(o1 AS VARCHAR) AS old_value, CAST(n1 AS VARCHAR) AS new_value, 'salary_update' AS change_type FROM {v} WHERE o1 IS DISTINCT FROM n1
UNION ALL SELECT posting_seq, 'salary_max', CAST(o2 AS VARCHAR), CAST(n2 AS VARCHAR), 'salary_update' FROM {v} WHERE o2 IS DISTINCT FROM n2
UNION ALL SELECT posting_seq, 'work_mode', lower(trim(o3)), lower(trim(n3)), 'work_mode_update' FROM {v} WHERE trim(o3) <> '' AND trim(n3) <> '' AND lower(trim(o3)) <> lower(trim(n3))
UNION ALL SELECT posting_seq, 'location', o4, n4, 'location_update' FROM {v} WHERE trim(o4) <> '' AND trim(n4) <> '' AND lower(trim(o4)) <> lower(trim(n4))
UNION ALL SELECT posting_seq, 'status', o5, n5, 'status_update' FROM {v} WHERE o5 <> n5
UNION ALL SELECT posting_seq, 'description', concat('Tamanho anterior: ', length(o6), ' caracteres'), concat('Novo tamanho: ', length(n6), ' caracteres'), 'description_update' FROM {v}
  WHERE o6 <> '' AND n6 <> '' AND o6 <> n6 AND (abs(length(n6) - length(o6)) > 80 OR abs(length(n6) - length(o6)) / greatest(length(o6), 1) > 0.2)
UNION ALL SELECT posting_seq, 'published_at', strftime(o7, '%Y-%m-%d %H:%M:%S'), strftime(n7, '%Y-%m-%d %H:%M:%S'), 'date_update' FROM {v} WHERE o7 <> n7)
"""


def versions_sql(o: str, n: str, new_status: str) -> str:
    names = ["salary_min", "salary_max", "work_mode", "location", "status", "description", "published_at"]
    value = lambda t, c: f"trim({t}.{c})" if c == "description" else f"{t}.{c}"
    return ", ".join(f"{value(o, c)} AS o{k}, {new_status if c == 'status' else value(n, c)} AS n{k}" for k, c in enumerate(names, 1))


_C6 = f"""WITH {O.POSTINGS}, {O.EARLIER}, v AS (SELECT e.posting_seq, {versions_sql('e', 'p', "'active'")} FROM e JOIN p USING (posting_seq)),
{changes_sql('c', 'v')}"""


@query("c6_changelog", _C6 + "SELECT * FROM c")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return changes.changelog(versions(spark, d))


@query("c7_critical_update", _C6 + "SELECT posting_seq, bool_or(change_type IN ('salary_update', 'status_update', 'work_mode_update')) AS is_critical, count(*) AS n_changes FROM c GROUP BY posting_seq")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return changes.critical(changes.changelog(versions(spark, d)))


_OLD = f"coalesce(published_at, discovered_at) < {O.NOW} - INTERVAL 60 DAY AND posting_seq % 10 <> 0"


@query("m1_purge_expired", f"WITH {O.POSTINGS} SELECT posting_seq FROM p WHERE {_OLD}")
def m1(spark: SparkSession, d: str) -> DataFrame:
    rows = A.postings(spark, d)
    return maintenance.expired(rows, rows.where("posting_seq % 10 = 0"), A.as_of(), 60).select("posting_seq")


@query("m2_cascade", f"WITH {O.PAIRS} SELECT profile_id, posting_seq FROM pairs WHERE NOT coalesce({_OLD}, false)")
def m2(spark: SparkSession, d: str) -> DataFrame:
    rows = A.postings(spark, d)
    purged = maintenance.expired(rows, rows.where("posting_seq % 10 = 0"), A.as_of(), 60)
    return maintenance.without(pairs(spark, d).select("profile_id", "posting_seq"), purged)


@query("m3_purge_examples", f"WITH {O.POSTINGS} SELECT posting_seq FROM p WHERE NOT (title ILIKE '%[teste]%' OR title ILIKE '%[mock]%' OR company ILIKE '%empresa alpha%' OR company ILIKE '%vagas testes%' OR url ILIKE '%/jobs/mock%' OR url ILIKE '%-demo.gupy.io%' OR source ILIKE 'mock')")
def m3(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).where(~maintenance.is_example()).select("posting_seq")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").where("event_type in ('view', 'click', 'purchase')")
    return e.select("event_id", "ts", (F.col("user_id") % 4 + 1).alias("profile_id"), (F.col("event_id") % 50).alias("posting_seq"), (F.col("event_type") != "view").alias("is_positive"), F.lit(70).alias("score"))


@query("r13_feedback", """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY profile_id, posting_seq ORDER BY ts, event_id) AS n FROM (
  SELECT event_id, ts, user_id % 4 + 1 AS profile_id, event_id % 50 AS posting_seq, CASE WHEN event_type = 'view' THEN -10 ELSE 5 END AS delta FROM events WHERE event_type IN ('view', 'click', 'purchase')) x),
s AS (SELECT profile_id, posting_seq, n, greatest(0, least(100, 70 + delta)) AS score FROM e WHERE n = 1
  UNION ALL SELECT e.profile_id, e.posting_seq, e.n, greatest(0, least(100, s.score + e.delta)) FROM e JOIN s ON e.profile_id = s.profile_id AND e.posting_seq = s.posting_seq AND e.n = s.n + 1)
SELECT profile_id, posting_seq, CAST(arg_max(score, n) AS INT) AS score, count(*) AS n_events FROM s GROUP BY profile_id, posting_seq""")  # fmt: skip
def r13(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.feedback_score(feedback(spark, d))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events")
    return e.select(F.concat(F.lit("src"), (F.col("user_id") % 13).cast("string")).alias("source"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))


@query("t10_source_counts", """SELECT concat('src', user_id % 13) AS source, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failures
FROM events GROUP BY 1, 2""")  # fmt: skip
def t10(spark: SparkSession, d: str) -> DataFrame:
    return streams.source_counts(attempts(spark, d)).select("source", F.date_format("start", "yyyy-MM-dd").alias("day"), "attempts", "failures")


@query("t5_source_health", """WITH RECURSIVE e AS (SELECT concat('src', user_id % 13) AS source, event_id, ts, event_type <> 'error' AS ok,
  row_number() OVER (PARTITION BY user_id % 13 ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT source, event_id, n, ok, 'CLOSED' AS tried_in, 'CLOSED' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, CAST(NULL AS TIMESTAMP) AS until FROM e WHERE n = 1
  UNION ALL SELECT source, event_id, n, ok, tried_in,
    CASE WHEN tried_in = 'OPEN' THEN 'OPEN' WHEN ok THEN 'CLOSED' WHEN tried_in = 'HALF_OPEN' OR failures + 1 >= 3 THEN 'OPEN' ELSE tried_in END,
    CASE WHEN tried_in = 'OPEN' THEN failures WHEN ok THEN 0 ELSE failures + 1 END,
    CASE WHEN tried_in = 'OPEN' THEN until WHEN ok THEN NULL WHEN tried_in = 'HALF_OPEN' OR failures + 1 >= 3 THEN ts + INTERVAL 300 SECOND END
  FROM (SELECT e.*, s.failures, s.until, CASE WHEN s.state = 'OPEN' AND e.ts >= s.until THEN 'HALF_OPEN' ELSE s.state END AS tried_in FROM e JOIN s ON e.source = s.source AND e.n = s.n + 1) x)
SELECT source, event_id, ok, tried_in, state, failures FROM s""")  # fmt: skip
def t5(spark: SparkSession, d: str) -> DataFrame:
    return breaker.source_health(attempts(spark, d))


@query("s1_json_feed", f"WITH {O.POSTINGS} SELECT source, CAST(posting_seq AS VARCHAR) AS external_id, title, company, url, salary_min FROM p")
def s1(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("posting_seq").alias("id"), "title", F.col("company").alias("company_name"), "url", F.col("salary_min").alias("salaryMin"))
    bronze = A.postings(spark, d).select("source", F.to_json(F.struct(F.array(item).alias("jobs"))).alias("payload"))
    return feeds.parse_json_feed(bronze, feeds.FEEDS["flat"]).select("source", "external_id", "title", "company", "url", "salary_min")


@query("s7_embedded_json", f"WITH {O.POSTINGS} SELECT source, CAST(posting_seq AS VARCHAR) AS external_id, title, url, location FROM p")
def s7(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("posting_seq").alias("id"), F.col("title").alias("name"), F.col("url").alias("jobUrl"), F.col("location").alias("city"))
    json = F.to_json(F.struct(F.struct(F.struct(F.struct(F.array(item).alias("data")).alias("initialJobList")).alias("pageProps")).alias("props")))
    bronze = A.postings(spark, d).select("source", F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), json, F.lit("</script></html>")).alias("payload"))
    return feeds.parse_json_feed(bronze, feeds.FEEDS["embedded"]).select("source", "external_id", "title", "url", "location")


@query("s8_rss", f"WITH {O.POSTINGS} SELECT source, url, title, company, location FROM p")
def s8(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), text.escape_html(c), F.lit(f"</{name}>"))
    item = F.concat(tag("title", F.concat_ws(": ", "company", "title")), tag("link", F.col("url")), tag("region", F.col("location")))
    bronze = A.postings(spark, d).select("source", F.concat(F.lit("<rss><channel><item>"), item, F.lit("</item></channel></rss>")).alias("payload"))
    return feeds.parse_rss(bronze).select("source", "url", "title", "company", "location")


_ANCHOR = _N10.replace("html", "card")


@query("s10_html_cards", rf"""WITH c AS (SELECT regexp_extract(url, '^(https?://[^/]+)', 1) AS base, unnest(regexp_extract_all(coalesce(html, ''), '(?is)(<a\s[^>]*href=[^>]*>.*?</a>)')) AS card FROM pages),
h AS (SELECT *, regexp_extract(card, '(?is)href=["'']?([^"''\s>]*)', 1) AS href, substr(trim(regexp_replace({_ANCHOR}, '[\s\x{{A0}}]+', ' ', 'g')), 1, 200) AS title FROM c)
SELECT 'pages' AS source, CASE WHEN starts_with(href, '/') THEN base || href ELSE href END AS url, title FROM h WHERE title <> ''""")  # fmt: skip
def s10(spark: SparkSession, d: str) -> DataFrame:
    return feeds.parse_html_cards(A.table(spark, d, "pages").select(F.lit("pages").alias("source"), "url", F.col("html").alias("payload")))


def run_sql(source: str, history: str, tag: str = "") -> str:
    """CTEs of a batch, what history and batch make of each posting: verdicts has a row a posting, run one a posting or a posting and profile."""
    pairs_of = f"(SELECT * FROM (SELECT * FROM verdicts{tag} WHERE verdict = 'open') v, ({A.profiles_sql()}) pr)"
    return f"""{O.fresh('f' + tag, source)}, {O.keyed('mine' + tag, 'f' + tag)}, {O.keyed('theirs' + tag, history)}, {O.similar('mine' + tag, 'theirs' + tag, tag)},
firsts{tag} AS (SELECT content_hash, min(posting_seq) AS first_seq FROM mine{tag} WHERE NOT is_ghost GROUP BY content_hash),
same{tag} AS (SELECT content_hash, max(posting_seq) AS same_of FROM theirs{tag} GROUP BY content_hash),
likes{tag} AS (SELECT posting_seq, max(duplicate_of) AS like_of FROM dup{tag} GROUP BY posting_seq),
verdicts{tag} AS MATERIALIZED (SELECT m.*, coalesce(same_of, like_of) AS duplicate_of,
  CASE WHEN is_ghost THEN 'ghost' WHEN posting_seq <> first_seq THEN 'dup_in_batch' WHEN same_of IS NOT NULL OR like_of IS NOT NULL THEN 'dup_history' ELSE 'open' END AS verdict,
  CASE WHEN is_ghost THEN ghost_reason WHEN posting_seq <> first_seq OR same_of IS NOT NULL THEN 'same_content_hash' ELSE 'similar' END AS why
  FROM mine{tag} m LEFT JOIN firsts{tag} USING (content_hash) LEFT JOIN same{tag} USING (content_hash) LEFT JOIN likes{tag} USING (posting_seq)),
judged{tag} AS MATERIALIZED (SELECT *, {_VALID} AS discard_reason FROM {O.ranked(pairs_of)} r),
run{tag} AS (SELECT posting_seq, CAST(NULL AS INT) AS profile_id, verdict AS outcome, why AS reason, CAST(NULL AS INT) AS score FROM verdicts{tag} WHERE verdict <> 'open'
  UNION ALL SELECT posting_seq, profile_id, CASE WHEN discard_reason = 'valid' THEN 'new' ELSE 'invalid' END, discard_reason, CASE WHEN discard_reason = 'valid' THEN score END FROM judged{tag})"""


_RUN = f"{O.POSTINGS}, {O.EARLIER}, {run_sql('(SELECT * FROM p WHERE posting_seq % 2 = 1)', '(SELECT * FROM e WHERE posting_seq % 2 = 0)')}"


@query("t1_run_batch", f"WITH {_RUN} SELECT * FROM run")
def t1(spark: SparkSession, d: str) -> DataFrame:
    history = dedup.with_keys(A.earlier_postings(spark, d).where("posting_seq % 2 = 0"))
    return cycle.run_batch(A.postings(spark, d).where("posting_seq % 2 = 1"), history, A.profiles(spark), A.as_of())


@query("w3_top_new", f"""WITH {O.POSTINGS}, {O.FRESH}, k AS (SELECT *, {O.chash()} AS content_hash, {O.r_scores()['recency_score']} AS recency_score FROM f WHERE NOT is_ghost),
first AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY posting_seq) = 1)
SELECT posting_seq, title, company, content_hash, recency_score FROM first WHERE coalesce({_V['v1']}, {_V['v2']}, {_V['v3']}, {_V['v4']}) IS NULL ORDER BY recency_score DESC, posting_seq DESC LIMIT 20""")  # fmt: skip
def top_new(spark: SparkSession, d: str) -> DataFrame:
    return cycle.top_new(A.postings(spark, d), A.as_of())
