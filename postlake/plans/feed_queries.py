"""Queries of further feeds, of runs and of what is derived from matches, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.functions import text
from postlake.operators import breaker, dedup, freshness, outcomes, ranking
from postlake.plans import cycle
from postlake.plans import oracle as O
from postlake.plans.queries import _HALVES, _RUN, SQL, attempts, pairs, query, s1, s8
from postlake.plans.stages import shared_path
from postlake.sources import adapters as A
from postlake.sources import feeds
from postlake.streaming import cycle as streams


def _payload(spark: SparkSession, d: str, path: str, **fields: str) -> DataFrame:
    """Raw payloads, one item each, at a path of names like ``$.jobs``, as feeds would send them."""
    item = F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])
    json = F.array(item)
    for name in reversed([x for x in path.removeprefix("$").split(".") if x]):
        json = F.struct(json.alias(name))
    return A.postings(spark, d).select("source", F.to_json(json).alias("payload"))


@query("s2_array_feed", f"WITH {O.POSTINGS} SELECT CASE WHEN posting_seq % 2 = 0 THEN CAST(posting_seq AS VARCHAR) ELSE 'p' || posting_seq END AS external_id, title, company, location FROM p")
def s2(spark: SparkSession, d: str) -> DataFrame:
    raw = _payload(spark, d, "$", id="if(posting_seq % 2 = 0, posting_seq, null)", slug="concat('p', posting_seq)", position="title", company="company", location="location")
    return feeds.parse_json_feed(raw, feeds.FEEDS["array"]).select("external_id", "title", "company", "location")


@query("s4_nested_feed", f"WITH {O.POSTINGS} SELECT CAST(posting_seq AS VARCHAR) AS external_id, title, url, c_name AS company FROM p LEFT JOIN customer ON c_custkey = posting_seq % 100 + 1")
def s4(spark: SparkSession, d: str) -> DataFrame:
    attributes = "named_struct('title', title, 'description', '', 'company', named_struct('data', named_struct('id', cast(posting_seq % 100 + 1 as string))))"
    raw = _payload(spark, d, "$.data", id="posting_seq", attributes=attributes, links="named_struct('public_url', url)")
    names = A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("company"), F.col("c_name").alias("name"))
    found = feeds.parse_json_feed(raw, feeds.FEEDS["nested"])
    return found.join(names, "company", "left").select("external_id", "title", "url", F.col("name").alias("company"))


@query("s5_board_feed", f"WITH {O.POSTINGS} SELECT CAST(posting_seq AS VARCHAR) AS external_id, title FROM p WHERE contains(lower(title), 'desenvolvedor') OR contains(lower(title), 'dados')")
def s5(spark: SparkSession, d: str) -> DataFrame:
    raw = _payload(spark, d, "$.jobs", id="posting_seq", title="title", url="url")
    roles = F.array(F.lit("desenvolvedor"), F.lit("dados"))
    found = feeds.parse_json_feed(raw, feeds.FEEDS["flat"])
    return found.where(F.exists(roles, lambda r: F.contains(F.lower("title"), r))).select("external_id", "title")


@query("s6_alternative_keys", f"WITH {O.POSTINGS} SELECT CAST(posting_seq AS VARCHAR) AS external_id, title, company FROM p")
def s6(spark: SparkSession, d: str) -> DataFrame:
    raw = _payload(spark, d, "$.itens", codigo="if(posting_seq % 3 = 0, '', cast(posting_seq as string))", id="posting_seq", titulo="if(posting_seq % 2 = 0, title, null)", curso="title", empresa="company")
    return feeds.parse_json_feed(raw, feeds.FEEDS["alternative"]).select("external_id", "title", "company")


@query("s15_collect", f"WITH {O.POSTINGS} SELECT source, count(*) AS payloads, count(*) FILTER (posting_seq % 5 <> 0) AS found, count(*) FILTER (posting_seq % 5 = 0) AS rejected FROM p GROUP BY source")
def s15(spark: SparkSession, d: str) -> DataFrame:
    payload = F.when(F.col("posting_seq") % 5 == 0, "{broken").otherwise(F.to_json(F.struct("title")))
    return outcomes.collected(A.postings(spark, d).select("source", payload.alias("payload")))


@query("n18_to_posting", f"""WITH {O.POSTINGS} SELECT posting_seq, CASE WHEN seniority <> '' THEN seniority ELSE {O.seniority()} END AS seniority,
  CASE WHEN published_at IS NULL THEN 'unknown_date' ELSE 'verified' END AS date_status, 'Tecnologia' AS area, 'BRL' AS currency FROM p""")  # fmt: skip
def n18(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.to_posting(A.postings(spark, d)).select("posting_seq", "seniority", "date_status", "area", "currency")


@query("n22_render", f"WITH {O.PAIRS} SELECT posting_seq, profile_id, concat(upper(title), ' - ', company, ' (', score, '/100)') AS message, CASE WHEN score >= 85 THEN 'high' WHEN score >= 70 THEN 'middle' ELSE 'low' END AS band FROM {O.ranked('pairs')} WHERE score >= 60")
def n22(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d), A.as_of()).where("score >= 60")
    return outcomes.rendered(rows).select("posting_seq", "profile_id", "message", "band")


@query("j5_company_pairs", f"WITH {O.POSTINGS}, {O.keyed('k', 'p')}, {O.similar('k', 'k')} SELECT a, b FROM cp")
def j5(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.with_keys(A.postings(spark, d)).select("posting_seq", "company_key")
    return dedup.company_pairs(rows, rows)


@query("j15_source_states", f"""SELECT s.source, coalesce(l.state, 'CLOSED') AS state FROM (SELECT DISTINCT concat('src', doc_id % 20) AS source FROM documents) s
LEFT JOIN (SELECT h.source, arg_max(h.state, (e.ts, e.event_id)) AS state FROM ({SQL['t5_source_health']}) h JOIN events e USING (event_id) GROUP BY h.source) l ON s.source = l.source""")  # fmt: skip
def j15(spark: SparkSession, d: str) -> DataFrame:
    listed = A.table(spark, d, "documents").select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("source")).distinct()
    events = attempts(spark, d)
    health = breaker.source_health(events).select("source", "event_id", "state").join(events.select("event_id", "ts"), "event_id")
    last = health.groupBy("source").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    return listed.join(last, "source", "left").select("source", F.coalesce("state", F.lit("CLOSED")).alias("state"))


@query("d3_history_duplicates", f"""WITH {_HALVES}, x AS (SELECT m.posting_seq, max(t.posting_seq) AS duplicate_of FROM mine m JOIN theirs t USING (content_hash) GROUP BY 1)
SELECT posting_seq, duplicate_of, 'exact' AS kind FROM x UNION ALL SELECT posting_seq, max(duplicate_of), 'similar' FROM dup WHERE posting_seq NOT IN (SELECT posting_seq FROM x) GROUP BY posting_seq""")  # fmt: skip
def d3(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.with_keys(A.postings(spark, d))
    new, old = rows.where("posting_seq % 2 = 1"), rows.where("posting_seq % 2 = 0")
    known = old.groupBy("content_hash").agg(F.max("posting_seq").alias("duplicate_of"))
    exact = new.join(known, "content_hash").select("posting_seq", "duplicate_of", F.lit("exact").alias("kind"))
    rest = new.join(known.select("content_hash"), "content_hash", "left_anti")
    return exact.unionByName(dedup.fuzzy_duplicates(rest, old).withColumn("kind", F.lit("similar")))


@query("a7_funnel", f"WITH {_RUN} SELECT outcome, count(DISTINCT posting_seq) AS n FROM run GROUP BY outcome")
def a7(spark: SparkSession, d: str) -> DataFrame:
    history = dedup.with_keys(A.earlier_postings(spark, d).where("posting_seq % 2 = 0"))
    run = cycle.run_batch(A.postings(spark, d).where("posting_seq % 2 = 1"), history, A.profiles(spark), A.as_of())
    return outcomes.funnel(run)


@query("a8_source_stats", "SELECT concat('src', user_id % 13) AS source, count(*) AS pages, count(*) FILTER (event_type <> 'error') AS found, arg_max(event_type = 'error', (ts, event_id)) AS failed FROM events GROUP BY 1")
def a8(spark: SparkSession, d: str) -> DataFrame:
    e = attempts(spark, d)
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count_if("ok").alias("found"), F.max_by(~F.col("ok"), F.struct("ts", "event_id")).alias("failed"))


@query("a10_changes_since", "SELECT event_id % 300 AS posting_seq, count(*) AS n FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def a10(spark: SparkSession, d: str) -> DataFrame:
    late = A.table(spark, d, "events").where("event_type = 'click' and ts > timestamp_ntz '2024-01-10 00:00:00'")
    return late.groupBy((F.col("event_id") % 300).alias("posting_seq")).agg(F.count(F.lit(1)).alias("n"))


@query("w6_latest_reports", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def w6(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return A.table(spark, d, "events").withColumn("_n", place).where("_n <= 10").select("user_id", "event_id")


@query("u2_orphans", f"WITH {O.POSTINGS} SELECT DISTINCT event_id % 5000 AS posting_seq FROM events WHERE event_id % 5000 NOT IN (SELECT posting_seq FROM p)")
def u2(spark: SparkSession, d: str) -> DataFrame:
    listed = A.table(spark, d, "events").select((F.col("event_id") % 5000).alias("posting_seq")).distinct()
    return listed.join(A.postings(spark, d).select("posting_seq"), "posting_seq", "left_anti")


@query("u3_dismissed", "SELECT CAST(user_id % 4 + 1 AS INT) AS profile_id, event_id % 97 AS posting_seq FROM events GROUP BY 1, 2 HAVING arg_max(event_type <> 'error', event_id)")
def u3(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select((F.col("user_id") % 4 + 1).cast("int").alias("profile_id"), (F.col("event_id") % 97).alias("posting_seq"), "event_id", (F.col("event_type") != "error").alias("wanted"))
    return e.groupBy("profile_id", "posting_seq").agg(F.max_by("wanted", "event_id").alias("_w")).where("_w").drop("_w")


@query("t7_digest", "SELECT CAST(user_id % 4 + 1 AS INT) AS profile_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, max(value) AS best FROM events GROUP BY 1, 2")
def t7(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select((F.col("user_id") % 4 + 1).cast("int").alias("profile_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    found = streams.digests(e, "1 hour")
    return found.select("profile_id", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n", "best")


@query("t2_first_in_batch", f"WITH {O.KEYED} SELECT content_hash, min(posting_seq) AS posting_seq FROM k GROUP BY content_hash")
def t2(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.with_keys(A.postings(spark, d)).select("posting_seq", "content_hash")
    return dedup.first_per(rows, "content_hash")


@query("t2_stream_distinct", f"WITH {O.KEYED} SELECT content_hash, count(DISTINCT content_hash) AS n FROM k GROUP BY content_hash")
def t2_stream(spark: SparkSession, d: str) -> DataFrame:
    """The postings as a stream of files, deduplicated within the watermark in keyed state; all that is there is read, then the stream ends."""
    folder = shared_path(spark, "stream")
    dedup.with_keys(A.postings(spark, d)).select("posting_seq", "content_hash", "discovered_at").write.parquet(f"{folder}/in")
    read = spark.readStream.schema("posting_seq long, content_hash string, discovered_at timestamp").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    writer = streams.new_postings(read, "200 days").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("posting_seq long, content_hash string, discovered_at timestamp").parquet(f"{folder}/out")
    return found.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


@query("s9_rss_right_split", f"WITH {O.POSTINGS} SELECT url, title, company FROM p WHERE company <> ''")
def s9(spark: SparkSession, d: str) -> DataFrame:
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), text.escape_html(c), F.lit(f"</{name}>"))
    item = F.concat(tag("title", F.concat_ws(" - ", "title", "company")), tag("link", F.col("url")))
    raw = A.postings(spark, d).where("company <> ''").select("source", F.concat(F.lit("<rss><channel><item>"), item, F.lit("</item></channel></rss>")).alias("payload"))
    return feeds.split_last(feeds.parse_rss(raw)).select("url", "title", "company")


# Cards as boards send them, in SQL that Spark and other engines read alike.
_CARD = """SELECT source, concat('<html><ul><li class="vaga odd">', CASE WHEN posting_seq % 10 = 9 THEN '<b>no link</b>' ELSE concat('<a class="x link-detalhes-vaga" href="',
  CASE WHEN posting_seq % 2 = 0 THEN 'https://www.vagas.com.br' ELSE '' END, '/vagas/', CASE WHEN posting_seq % 3 = 0 THEN '' ELSE 'v' END, CAST(posting_seq AS STRING), '/x">', title, '</a>') END,
  CASE WHEN company = '' THEN '' ELSE concat('<span class="emprVaga">', company, '</span>') END,
  CASE WHEN location = '' THEN '' ELSE concat('<span class="vaga-local">', location, '</span>') END, '</li></ul></html>') AS payload FROM {p}"""
_RESULT = """SELECT source, concat('<table><td class="a resultContent"><a class="jcs-JobTitle" href="/j', CAST(posting_seq AS STRING), '">', title, '</a><span class="companyName">', company,
  '</span><div class="companyLocation">', location, '</div>', CASE WHEN posting_seq % 3 = 0 THEN concat('<p>R$ 1.', CAST(200 + posting_seq % 700 AS STRING), ',50 - R$ 3.000,00</p>') ELSE '' END, '</td></table>') AS payload FROM {p}"""
_LISTED = """SELECT source, concat('<ul><li><a class="base-card__full-link" href="https://b/jobs/view/', CAST(posting_seq AS STRING), '">go</a><h3 class="base-search-card__title">', title,
  '</h3><h4 class="base-search-card__subtitle">', company, '</h4><span class="job-search-card__location">', location, '</span>',
  CASE WHEN posting_seq % 4 = 0 THEN '' ELSE concat('<time datetime="2024-01-', CAST(10 + posting_seq % 20 AS STRING), '">x</time>') END, '</li></ul>') AS payload FROM {p}"""


def _cards(spark: SparkSession, d: str, sql: str, name: str) -> DataFrame:
    return feeds.parse_cards(spark.sql(sql, p=A.postings(spark, d)), feeds.CARDS[name])


def _between(tag: str, missing: str = "''") -> str:
    """SQL of the trimmed text within a tag of a payload."""
    return rf"coalesce(nullif(trim(regexp_replace(regexp_extract(payload, '{tag}([^<]*)<', 1), '\s+', ' ', 'g')), ''), {missing})"


@query("s10_cards", f"""WITH {O.POSTINGS}, b AS ({_LISTED.format(p='p')}) SELECT source, regexp_extract(payload, 'href="([^"]*)"', 1) AS url, {_between('__title">')} AS title,
  {_between('__subtitle">', "'Empresa Confidencial'")} AS company, {_between('card__location">', "'Brasil'")} AS location, TRY_CAST(nullif(regexp_extract(payload, 'datetime="([^"]*)"', 1), '') AS TIMESTAMP) AS published_at
FROM b""")  # fmt: skip
def s10_cards(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d, _LISTED, "listed").select("source", "url", "title", "company", "location", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


_S11 = f"""WITH {O.POSTINGS}, b AS ({_CARD.format(p='p')}), u AS (SELECT *, regexp_extract(payload, 'href="([^"]*)"', 1) AS href FROM b),
c AS (SELECT *, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://www.vagas.com.br' || href END AS url FROM u WHERE href <> '')"""


@query("s11_coded_cards", f"""{_S11} SELECT source, url, coalesce(nullif(regexp_extract(url, '/v([0-9]+)/', 1), ''), url) AS external_id, {_between('/x">')} AS title,
  {_between('emprVaga">', "'Confidencial'")} AS company, {_between('vaga-local">', "'Brasil'")} AS location FROM c""")  # fmt: skip
def s11(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d, _CARD, "coded").select("source", "url", "external_id", "title", "company", "location")


def _relative(sql: str) -> str:
    for old, new in (("vaga odd", "react-job-listing"), ("vagas.com.br", "glassdoor.com.br"), ("emprVaga", "EmployerName"), ("vaga-local", "location")):
        sql = sql.replace(old, new)
    return sql


@query("s12_relative_cards", f"""{_relative(_S11)} SELECT source, url, {_between('/x">')} AS title,
  {_between('EmployerName">', "'Empresa Confidencial'")} AS company, {_between('location">', "'Brasil'")} AS location FROM c""")  # fmt: skip
def s12(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d, _relative(_CARD), "relative").select("source", "url", "title", "company", "location")


_AMOUNT = r"CAST(replace(replace(regexp_extract_all(payload, 'R\$ ([0-9.,]+)', 1)[{0}], '.', ''), ',', '.') AS DOUBLE)"


@query("s13_salaried_cards", f"""WITH {O.POSTINGS}, b AS ({_RESULT.format(p='p')}) SELECT 'https://br.indeed.com' || regexp_extract(payload, 'href="([^"]*)"', 1) AS url, {_between('companyName">', "'Empresa Não Informada'")} AS company,
  {_AMOUNT.format(1)} AS salary_min, {_AMOUNT.format(2)} AS salary_max,
  CASE WHEN contains(lower(payload), 'remoto') THEN 'remote' WHEN contains(lower(payload), 'híbrido') THEN 'hybrid' ELSE 'onsite' END AS work_mode FROM b""")  # fmt: skip
def s13(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d, _RESULT, "salaried").select("url", "company", "salary_min", "salary_max", "work_mode")


_ITEM = {
    "id": "posting_seq % 400", "jobTitle": "title", "companyName": "company", "url": "url", "jobGeo": "location", "jobExcerpt": "concat('<b>', title, '</b> x')",
    "salaryMin": "salary_min", "salaryMax": "if(posting_seq % 5 = 0, 0.0, salary_max)", "salaryCurrency": "if(posting_seq % 3 = 0, 'EUR', null)",
}


@query("s3_salaried_feed", f"""WITH {O.POSTINGS}, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY posting_seq % 400 ORDER BY posting_seq) = 1)
SELECT CAST(posting_seq % 400 AS VARCHAR) AS external_id, trim(title) AS title, coalesce(nullif(company, ''), 'Empresa Remota (Jobicy)') AS company, coalesce(nullif(location, ''), 'USA / Worldwide') AS location,
  salary_min, CASE WHEN posting_seq % 5 <> 0 THEN salary_max END AS salary_max, CASE WHEN posting_seq % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM f""")  # fmt: skip
def s3(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(*[F.expr(e).alias(n) for n, e in _ITEM.items()])
    raw = A.postings(spark, d).select("source", "posting_seq", F.to_json(F.struct(F.array(item).alias("jobs"))).alias("payload"))
    # a payload holds one item here, so the first payload of an id holds its first item
    first = raw.groupBy((F.col("posting_seq") % 400).alias("k")).agg(F.min_by(F.struct("source", "payload"), "posting_seq").alias("r")).select("r.*")
    return feeds.parse_json_feed(first, feeds.FEEDS["salaried"]).select("external_id", "title", "company", "location", "salary_min", "salary_max", "currency")


_GATED = "lower(title || ' ' || array_to_string(requirements, ' '))"


@query("f4_relevance_gate", f"WITH {O.POSTINGS} SELECT posting_seq FROM p WHERE {O.anyof(_GATED, ['desenvolvedor', 'python', 'django', 'backend'])}")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return feeds.relevant(A.postings(spark, d).withColumnRenamed("requirements", "tags"), ["Desenvolvedor"]).select("posting_seq")


@query("u1_union", f"""WITH {O.POSTINGS} SELECT source, CAST(posting_seq AS VARCHAR) AS external_id, title, company, url, salary_min, NULL AS location FROM p
UNION ALL SELECT source, NULL, title, company, url, NULL, location FROM p""")  # fmt: skip
def u1(spark: SparkSession, d: str) -> DataFrame:
    """A JSON feed and an RSS one, by name; what a feed lacks is null."""
    return s1(spark, d).unionByName(s8(spark, d), allowMissingColumns=True)


@query("w7_recent_history", f"WITH {O.POSTINGS}, {O.FRESH} SELECT posting_seq, source FROM f WHERE status = 'active' ORDER BY discovered_at DESC, posting_seq DESC LIMIT 300")
def w7(spark: SparkSession, d: str) -> DataFrame:
    fresh = freshness.freshness(A.postings(spark, d), A.as_of()).where("status = 'active'")
    return fresh.orderBy(F.desc("discovered_at"), F.desc("posting_seq")).limit(300).select("posting_seq", "source")


@query("j17_feedback_match", f"""WITH {O.PAIRS}, m AS (SELECT posting_seq, profile_id, score FROM {O.ranked('pairs')}),
e AS (SELECT CAST(user_id % 4 + 1 AS INT) AS profile_id, event_id % 97 AS posting_seq, arg_max(event_type = 'purchase', event_id) AS is_positive FROM events GROUP BY 1, 2)
SELECT e.profile_id, e.posting_seq, m.score, greatest(0, least(100, m.score + CASE WHEN is_positive THEN 5 ELSE -10 END)) AS adjusted FROM e JOIN m ON e.profile_id = m.profile_id AND e.posting_seq = m.posting_seq""")  # fmt: skip
def j17(spark: SparkSession, d: str) -> DataFrame:
    matches = ranking.rank(pairs(spark, d), A.as_of()).select("profile_id", "posting_seq", "score")
    e = A.table(spark, d, "events").select((F.col("user_id") % 4 + 1).cast("int").alias("profile_id"), (F.col("event_id") % 97).alias("posting_seq"), "event_id", (F.col("event_type") == "purchase").alias("good"))
    last = e.groupBy("profile_id", "posting_seq").agg(F.max_by("good", "event_id").alias("good"))
    adjusted = F.greatest(F.lit(0), F.least(F.lit(100), F.col("score") + F.when(F.col("good"), 5).otherwise(-10)))
    return last.join(matches, ["profile_id", "posting_seq"]).select("profile_id", "posting_seq", "score", adjusted.alias("adjusted"))
