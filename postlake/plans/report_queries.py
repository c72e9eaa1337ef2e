"""Queries of lists, searches, reports, messages and preferences, and their SQL, written from the rules and not from the code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.operators import accounts, maintenance, messages, outcomes, ranking, search, views
from postlake.plans import oracle as O
from postlake.plans.queries import _WEEK, pairs, query
from postlake.plans.stages import shared_path
from postlake.plans.store_queries import _KEPT, store
from postlake.sources import adapters as A
from postlake.sources import feeds, plugin

NOW = O.NOW

_DAY = f"(coalesce(discovered_at >= {NOW} - INTERVAL 24 HOUR, false) OR coalesce(published_at >= {NOW} - INTERVAL 24 HOUR, false))"


@query("t3_new_in_day", f"WITH {O.POSTINGS} SELECT posting_seq FROM p WHERE {_DAY}")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).where(views.is_new(A.as_of())).select("posting_seq")


@query("w4_top_new", f"WITH {O.PAIRS} SELECT posting_seq, score FROM {O.ranked('pairs')} WHERE profile_id = 3 AND status = 'active' AND {_DAY} ORDER BY score DESC NULLS LAST, posting_seq DESC LIMIT 5")
def w4_new(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d).where("profile_id = 3"), A.as_of())
    return views.list_postings(rows, A.as_of(), status="active", only_new=True, limit=5).select("posting_seq", "score")


_INTERN = "(contains(lower(employment_type), 'estagio') OR contains(lower(employment_type), 'estágio') OR contains(lower(title), 'estagi'))"


@query("f7_classify", f"WITH {O.POSTINGS} SELECT posting_seq, {O.fold('lower(work_mode)')} AS mode, {_INTERN} AS internship FROM p")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return A.postings(spark, d).select("posting_seq", views.mode_class().alias("mode"), views.is_internship().alias("internship"))


# the list's twelve predicates, one case each, and all together
_AREA = "CASE WHEN posting_seq % 3 = 0 THEN 'Tecnologia' ELSE 'Dados e IA' END"
_CASES: dict[str, tuple[dict, str]] = {
    "status": ({"status": "closed"}, "status = 'closed'"),
    "all": ({}, "true"),
    "usual": ({"status": None}, "status = 'active'"),
    "dismissed": ({}, "posting_seq % 5 <> 0"),
    "only_new": ({"only_new": True}, _DAY),
    "search": ({"search": " São "}, " OR ".join(f"{c} ILIKE '%{v}%'" for c in ("title", "company", "location", "description") for v in ("São", "Sao", "S_o"))),
    "min_score": ({"min_score": 60}, "score >= 60"),
    "seniority": ({"seniority": "junior"}, "seniority = 'junior'"),
    "work_mode": ({"work_mode": "remote"}, "work_mode = 'remote'"),
    "company": ({"company": "épsilon"}, "company ILIKE '%épsilon%' OR company ILIKE '%epsilon%'"),
    "source": ({"source": "src3"}, "source = 'src3'"),
    "location": ({"location": "Curitiba - PR"}, "location ILIKE '%Curitiba%'"),
    "area": ({"area": "dados"}, f"{_AREA} ILIKE '%dados%'"),
    "employment_type": ({"employment_type": "pj"}, "employment_type = 'pj'"),
    "together": ({"status": "active", "search": "estágio", "location": "são paulo/sp", "min_score": 1},
                 "status = 'active' AND score >= 1 AND (" + " OR ".join(f"{c} ILIKE '%{v}%'" for c in ("title", "company", "location", "description") for v in ("estágio", "estagio", "estag_o"))
                 + ") AND (" + " OR ".join(f"location ILIKE '%{v}%'" for v in ("são paulo", "sao paulo", "s_o paulo")) + ")"),
}


@query("f5_predicates", f"WITH {O.PAIRS}, r AS MATERIALIZED (SELECT * FROM {O.ranked('(SELECT * FROM pairs WHERE profile_id = 1)')}) " + " UNION ALL ".join(
    f"(SELECT '{case}' AS predicate, posting_seq, row_number() OVER (ORDER BY score DESC NULLS LAST, posting_seq DESC) AS place FROM r WHERE {test} QUALIFY place BETWEEN 4 AND 203)" for case, (_, test) in _CASES.items()))
def f5(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d).where("profile_id = 1"), A.as_of()).withColumn("area", F.expr(_AREA))
    dismissed = rows.where("posting_seq % 5 = 0").select("posting_seq")
    found = []
    for case, (given, _) in _CASES.items():
        wanted = {k: v for k, v in ({"status": "all"} | given).items() if v is not None}
        listed = views.list_postings(rows, A.as_of(), dismissed=dismissed if case == "dismissed" else None, limit=500, offset=3, **wanted)
        ids = listed.agg(F.collect_list("posting_seq").alias("ids"))  # a page
        found.append(ids.select(F.lit(case).alias("predicate"), F.posexplode("ids").alias("at", "posting_seq")).select("predicate", "posting_seq", (F.col("at") + 4).cast("long").alias("place")))
    return reduce(DataFrame.unionByName, found)


_TERMS = {"estágio": ("estágio", "estagio", "estag_o"), "Programacao": ("Programacao", "programação", "Programac_o"), "ti": ("ti",), "ção de": ("ção de", "cao de", "c_o de"), "the of": ("the of",), "Berlin": ("Berlin",)}


@query("n19_index_search", f"WITH {O.POSTINGS} " + " UNION ALL ".join(
    f"SELECT '{term}' AS term, posting_seq FROM p WHERE {' OR '.join(f"{c} ILIKE '%{v}%'" for c in views.SEARCHED for v in variants)}" for term, variants in _TERMS.items()))
def n19_index(spark: SparkSession, d: str) -> DataFrame:
    rows, path = A.postings(spark, d), shared_path(spark, "trigrams")
    search.build(rows, list(views.SEARCHED), path)
    return reduce(DataFrame.unionByName, [search.search(rows, list(views.SEARCHED), path, t).select(F.lit(t).alias("term"), "posting_seq") for t in _TERMS])


_REPORTS = "SELECT event_id AS report_id, CAST(user_id % 4 + 1 AS INT) AS profile_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS created_at, {array}(event_id % 300, event_id * 7 % 300, event_id * 11 % 300) AS presented FROM {events} WHERE event_type = 'purchase'"
_CHANGED = "SELECT event_id % 300 AS posting_seq, ts AS changed_at FROM {events} WHERE event_type = 'click'"


def report(spark: SparkSession, d: str) -> DataFrame:
    events = A.table(spark, d, "events")
    reports = spark.sql(_REPORTS.replace("{array}", "array"), events=events)
    return views.weekly_report(ranking.rank(pairs(spark, d), A.as_of()), reports, spark.sql(_CHANGED, events=events), A.as_of())


_REPORT = f"""{O.PAIRS}, w AS (SELECT * FROM {O.ranked('pairs')} WHERE {_WEEK}),
once AS (SELECT * FROM w QUALIFY url = '' OR row_number() OVER (PARTITION BY profile_id, lower(trim(url)) ORDER BY score DESC NULLS LAST, posting_seq DESC) = 1),
reps AS (SELECT * FROM ({_REPORTS.format(array='list_value', events='events')}) QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY report_id DESC) <= 10),
since AS (SELECT profile_id, arg_max(created_at, report_id) FILTER (created_at IS NOT NULL) - INTERVAL 5 SECOND AS since FROM reps GROUP BY profile_id),
pres AS (SELECT DISTINCT profile_id, posting_seq FROM (SELECT profile_id, unnest(presented) AS posting_seq FROM reps)),
told AS (SELECT p.profile_id, p.posting_seq, count(c.changed_at) AS n FROM pres p JOIN since s USING (profile_id) LEFT JOIN ({_CHANGED.format(events='events')}) c ON c.posting_seq = p.posting_seq AND (s.since IS NULL OR c.changed_at >= s.since) GROUP BY 1, 2),
report AS (SELECT o.*, CASE WHEN t.n IS NULL THEN 'NOVA' WHEN t.n > 0 THEN 'ATUALIZADA' ELSE 'ANTERIOR' END AS tag, coalesce(t.n, 0) AS n_changes,
  row_number() OVER (PARTITION BY o.profile_id ORDER BY score DESC, o.posting_seq DESC) AS place FROM once o LEFT JOIN told t ON t.profile_id = o.profile_id AND t.posting_seq = o.posting_seq),
totals AS (SELECT profile_id, count(*) AS analysed, count(*) FILTER (score >= CASE WHEN coalesce(minimum_match_score, 0) = 0 THEN 70 ELSE minimum_match_score END) AS compatible, count(*) FILTER (tag = 'NOVA') AS new,
  count(*) FILTER ({O.fold('lower(work_mode)')} = 'remote') AS remote, count(*) FILTER ({O.fold('lower(work_mode)')} = 'hybrid') AS hybrid,
  count(*) FILTER ({O.fold('lower(work_mode)')} = 'onsite') AS onsite, count(*) FILTER ({_INTERN}) AS internships FROM report GROUP BY profile_id)"""


@query("a9_weekly_totals", f"WITH {_REPORT} SELECT * FROM totals")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return views.weekly_totals(report(spark, d))


@query("w8_tags", f"WITH {_REPORT} SELECT profile_id, posting_seq, tag, n_changes FROM report")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).select("profile_id", "posting_seq", "tag", "n_changes")


@query("w2_report_cuts", f"WITH {_REPORT} SELECT profile_id, posting_seq, place, CASE WHEN place <= 5 THEN 5 WHEN place <= 10 THEN 10 ELSE 20 END AS cut FROM report WHERE place <= 20")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return report(spark, d).where("cut is not null").select("profile_id", "posting_seq", "place", "cut")


@query("n22_weekly_summary", f"""WITH {_REPORT}, items AS (SELECT profile_id, count(*) AS n, string_agg(concat('<b>', place, '. ', CASE tag WHEN 'ATUALIZADA' THEN '🔄 [Atualizada] ' WHEN 'NOVA' THEN '✨ [Nova] ' ELSE '' END, title, '</b>', chr(10), '   🏢 ', company, ' | 📍 ',
  upper(work_mode[1]), lower(work_mode[2:]), ' | 🎯 <b>', score, '% Match</b>', chr(10), '   🔗 <a href=''', url, '''>Ver Vaga Completa</a>', chr(10)), chr(10) ORDER BY place) AS lines FROM report WHERE place <= 10 GROUP BY profile_id)
SELECT profile_id, concat_ws(chr(10), '📊 <b>RELATÓRIO SEMANAL DE VAGAS (7 DIAS)</b>', '<i>Período: Últimos 7 dias</i>' || chr(10), '📈 <b>Resumo do Mercado:</b>', '• Vagas analisadas: <b>' || analysed || '</b>',
  '• Compatíveis com seu perfil: <b>' || compatible || '</b>', '• Novas descobertas: <b>' || new || '</b>', '• Remotas: ' || remote || ' | Híbridas: ' || hybrid || ' | Presenciais: ' || onsite,
  '• Vagas de estágio: <b>' || internships || '</b>' || chr(10), '🏆 <b>Top ' || n || ' Oportunidades Selecionadas:</b>' || chr(10), lines, '<i>Envie /favoritos para consultar suas vagas salvas ou /ajuda para mais comandos.</i>') AS message
FROM totals JOIN items USING (profile_id)""")  # fmt: skip
def n22_summary(spark: SparkSession, d: str) -> DataFrame:
    found = report(spark, d)
    return messages.weekly_summary(found, views.weekly_totals(found))


_SAFE = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
_CAP = "upper(({0})[1]) || lower(({0})[2:])"
_MODE = "CASE WHEN work_mode = '' THEN 'N/A' ELSE work_mode END"
_HIGH = f"(SELECT *, {O.reasoning()} AS reasons FROM {O.ranked('pairs')} WHERE score >= 60)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return ranking.reasoned(ranking.rank(pairs(spark, d), A.as_of())).where("score >= 60").withColumn("area", F.lit("Tecnologia"))


@query("n22_chat_card", f"""WITH {O.PAIRS} SELECT posting_seq, profile_id, concat('🎯 <b>OPORTUNIDADE EM DESTAQUE (', score, '% Match)</b>', chr(10), chr(10), '💼 <b>', {_SAFE.format('title')}, '</b>', chr(10), '🏢 <b>Empresa:</b> ', {_SAFE.format('company')}, chr(10),
  '📍 <b>Local:</b> ', {_SAFE.format('location')}, ' (', {_CAP.format('work_mode')}, ')', chr(10), '📋 <b>Contrato:</b> ', upper(employment_type), ' | <b>Área:</b> Tecnologia', chr(10),
  '📅 <b>Publicação:</b> ', coalesce(strftime(published_at, '%d/%m/%Y'), 'Recente'), ' | <b>Fonte:</b> ', upper(source), chr(10), chr(10), '💡 <b>Motivos do Match:</b>', chr(10),
  array_to_string(list_transform(reasons[1:3], lambda x: '• ' || {_SAFE.format('x')}), chr(10)), chr(10), CASE WHEN url = '' THEN '' ELSE concat(chr(10), '🔗 <a href=''', url, '''>Clique aqui para ver a vaga completa</a>', chr(10)) END)[1:4000] AS card FROM {_HIGH}""")  # fmt: skip
def n22_chat(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("posting_seq", "profile_id", messages.chat_card().alias("card"))


def _field(name: str, value: str, inline: str = "true") -> str:
    return f"{{'name': '{name}', 'value': {value}, 'inline': {inline}}}"


_FIELDS = ", ".join(_field(*x) for x in (
    ("Empresa", "company"), ("Área", "'Tecnologia'"), ("Localização", "location"), ("Modelo", _CAP.format(_MODE)), ("Tipo", "CASE WHEN employment_type = '' THEN 'N/A' ELSE upper(employment_type) END"),
    ("Fonte", _CAP.format("source")), ("Data de Publicação", "coalesce(strftime(published_at, '%d/%m/%Y'), 'Não informada')"), ("Score de Relevância", "concat('**', score, '/100**')"),
    ("Destaques", "array_to_string(list_transform(reasons[1:4], lambda x: '• ' || x), chr(10))", "false")))


@query("n22_webhook_card", f"""WITH {O.PAIRS} SELECT posting_seq, profile_id, CAST(to_json({{'content': concat('🚨 **Nova Oportunidade Encontrada!** Match: **', score, '%**'), 'embeds': [{{'title': '🎯 ' || title, 'url': url,
  'color': CASE WHEN score >= 85 THEN 3066993 WHEN score >= 70 THEN 3447003 ELSE 15105570 END, 'fields': [{_FIELDS}], 'footer': {{'text': '{messages.BRAND}'}}, 'timestamp': strftime({NOW}, '%Y-%m-%dT%H:%M:%S') || '+00:00'}}]}}) AS VARCHAR) AS card FROM {_HIGH}""")  # fmt: skip
def n22_webhook(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("posting_seq", "profile_id", messages.webhook_card(A.as_of()).alias("card"))


@query("n22_mail", f"""WITH {O.PAIRS} SELECT posting_seq, profile_id, concat('[{messages.BRAND} ', score, '%] ', title, ' @ ', company) AS subject,
  concat('<h2>🚨 ', title, '</h2><p><b>', company, '</b> — ', location, ' (', work_mode, ' / ', seniority, ')</p><p>⭐ Match: <b>', score, '%</b></p><ul>',
  array_to_string(list_transform(reasons[1:6], lambda x: '<li>' || x || '</li>'), ''), '</ul><p><a href="', url, '">Ver vaga</a></p>') AS body FROM {_HIGH}""")  # fmt: skip
def n22_mail(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("posting_seq", "profile_id", messages.mail().alias("m")).select("posting_seq", "profile_id", "m.*")


_CHANNELS = [
    (1, "chat", True, 60, None), (1, "mail", True, 55, "hourly"), (2, "chat", True, None, None), (2, "mail", False, None, "daily"), (3, "webhook", True, 50, ""), (3, "mail", True, 55, ""),
    (4, "mail", True, None, "daily"),
]


def channels(spark: SparkSession) -> DataFrame:
    return A.small(spark.createDataFrame(_CHANNELS, "profile_id int, channel string, enabled boolean, minimum_score int, digest_mode string"))


# of these, mail of profile 3 goes out at once, and profiles 1 and 4 wait for a digest
@query("m10_outbox", f"""WITH {O.PAIRS}, ch(profile_id, channel, minimum_score) AS (VALUES (1, 'chat', 60), (2, 'chat', 70), (3, 'webhook', 50), (3, 'mail', 55))
SELECT r.profile_id, r.posting_seq, ch.channel, r.score FROM {O.ranked('pairs')} r JOIN ch USING (profile_id) WHERE r.score >= ch.minimum_score AND NOT (ch.channel = 'chat' AND r.posting_seq % 4 = 0)""")  # fmt: skip
def m10(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d), A.as_of()).select("profile_id", "posting_seq", "score")
    log = rows.where("posting_seq % 2 = 0").select("profile_id", "posting_seq", F.lit("chat").alias("channel"), F.when(F.col("posting_seq") % 4 == 0, "sent").otherwise("failed").alias("status"))
    return maintenance.outbox(rows, channels(spark), log)


_DIGEST = f"(SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, posting_seq DESC) AS place FROM {O.ranked('pairs')} WHERE (profile_id = 1 AND score >= 55) OR profile_id = 4)"


@query("j13_digest", f"WITH {O.PAIRS} SELECT CASE profile_id WHEN 1 THEN 'hourly' ELSE 'daily' END AS mode, profile_id, posting_seq, score, place FROM {_DIGEST} WHERE place <= 30")
def j13(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d), A.as_of()).select("profile_id", "posting_seq", "score")
    each = [accounts.digest(rows, channels(spark), mode).withColumn("mode", F.lit(mode)) for mode in ("hourly", "daily")]
    return each[0].unionByName(each[1])


@query("n22_digest_mail", f"""WITH {O.PAIRS}, g AS (SELECT profile_id, count(*) AS n, string_agg(concat('<li><b>', title, '</b> @ ', company, ' — ', score, '% — <a href="', url, '">ver</a></li>'), '' ORDER BY place) AS items FROM {_DIGEST} WHERE place <= 30 AND profile_id = 1 GROUP BY profile_id)
SELECT profile_id, concat('[{messages.BRAND}] Resumo hourly: ', n, ' vagas') AS subject, concat('<h2>{messages.BRAND} — resumo hourly (', n, ' vagas)</h2><ul>', items, '</ul>') AS body FROM g""")  # fmt: skip
def n22_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.rank(pairs(spark, d), A.as_of())
    listed = accounts.digest(rows, channels(spark), "hourly").join(A.postings(spark, d).select("posting_seq", "title", "company", "url"), "posting_seq")
    return messages.digest_mail(listed, "hourly")


# parsed résumés: a profile's own, with what a customer's segment changes
_PARSED = """SELECT CAST(c_custkey AS INT) AS profile_id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN {array}() ELSE {array}('Dev ' || c_mktsegment, 'QA') END AS roles, {array}('old role') AS desired_roles,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE transform(sequence(1, c_custkey % 15 + 1), x -> 'skill ' || x) END AS skills, {array}('old word') AS preferred_keywords,
  CASE c_custkey % 6 WHEN 0 THEN 'junior' WHEN 1 THEN 'estagio' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' WHEN 4 THEN '' END AS profile_seniority, {array}('old level') AS seniority_levels FROM {customer}"""


@query("m7_derived_preferences", """SELECT CAST(c_custkey AS INT) AS profile_id, CASE WHEN c_custkey % 3 = 2 THEN ['Dev ' || c_mktsegment, 'QA'] ELSE ['old role'] END AS desired_roles,
  CASE WHEN c_custkey % 4 = 0 THEN ['old word'] ELSE list_transform(range(1, CAST(least(10, c_custkey % 15 + 1) + 1 AS BIGINT)), lambda x: 'skill ' || x) END AS preferred_keywords,
  CASE WHEN c_custkey % 6 IN (0, 1) THEN ['estagio', 'trainee', 'junior'] WHEN c_custkey % 6 = 2 THEN ['junior', 'pleno'] WHEN c_custkey % 6 = 3 THEN ['pleno', 'senior'] ELSE ['old level'] END AS seniority_levels FROM customer""")  # fmt: skip
def m7(spark: SparkSession, d: str) -> DataFrame:
    parsed = spark.sql(_PARSED.replace("{array}()", "cast(array() as array<string>)").replace("{array}", "array"), customer=A.table(spark, d, "customer"))
    return accounts.derived_preferences(parsed)


@query("s14_enabled_sources", f"""WITH {O.POSTINGS}, u AS (SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN NULL WHEN 2 THEN ['src1', 'src9'] WHEN 3 THEN ['src4'] ELSE [] END AS own, c_custkey % 5 AS k FROM customer),
e AS (SELECT user_id, unnest(CASE WHEN k IN (0, 1) THEN ['src0', 'src2'] ELSE own END) AS source FROM u), n AS (SELECT source, count(*) AS n FROM p GROUP BY source)
SELECT user_id, source, n FROM e JOIN n USING (source)""")  # fmt: skip
def s14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    names = F.when(k == 0, F.array().cast("array<string>")).when(k == 2, F.array(F.lit(" SRC1 "), F.lit("src9"), F.lit(""))).when(k == 3, F.array(F.lit("src4"), F.lit("nowhere"))).when(k == 4, F.array(F.lit("  "), F.lit("gone")))
    known = [f"src{j}" for j in range(13)]
    users = A.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(feeds.enabled(names, ["src0", "src2", "mock"], known)).alias("source"))
    found = A.postings(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return users.join(found, "source").select("user_id", "source", "n")


@query("w9_changelog", f"WITH {_KEPT} SELECT posting_seq, logged.by AS \"by\", field_name, row_number() OVER (PARTITION BY posting_seq ORDER BY logged.by DESC, field_name) AS place FROM logged")
def w9(spark: SparkSession, d: str) -> DataFrame:
    """A posting's changes, newest first: by the time of the run, then the duplicate that told of them."""
    log = store(spark, d).read("changelog")
    listed = F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("late"), (-F.col("by")).alias("later"), "field_name", "by"))).alias("log")
    each = log.groupBy("posting_seq").agg(listed).select("posting_seq", F.posexplode("log").alias("at", "c"))
    return each.select("posting_seq", "c.by", "c.field_name", (F.col("at") + 1).cast("long").alias("place"))


@query("r12_reasons", f"""WITH {O.PAIRS}, r AS (SELECT *, lower(concat_ws(' ', title, description, array_to_string(requirements, ' '))) AS blob FROM {O.ranked('pairs')}),
h AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(skills, lambda x: lower(x)), lambda x: x <> '' AND contains(blob, x))))[1:4] AS hits FROM r)
SELECT posting_seq, profile_id, list_filter(list_concat(CASE WHEN len(hits) > 0 THEN list_transform(hits, lambda x: x || ' é um match forte') ELSE ['Perfil geral compatível com a descrição'] END,
  [CASE WHEN lower(work_mode) IN ('remote', 'remoto', 'remot') THEN 'Trabalho remoto compatível com preferência' END, CASE WHEN seniority_score >= 80 THEN 'Senioridade compatível' ELSE 'Gap de senioridade: verificar requisitos' END]),
  lambda x: x IS NOT NULL)[1:6] AS reasons FROM h""")  # fmt: skip
def r12(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.reasons(ranking.rank(pairs(spark, d), A.as_of())).select("posting_seq", "profile_id", "reasons")


def payload_folder(spark: SparkSession, d: str) -> str:
    """Payloads of all postings, a JSON feed each, written a folder a source."""
    path = shared_path(spark, "payloads")
    item = F.struct(F.col("posting_seq").alias("id"), "title", F.col("company").alias("company_name"), "url")
    A.postings(spark, d).select("source", F.to_json(F.struct(F.array(item).alias("jobs"))).alias("payload")).write.partitionBy("source").text(path)
    return path


@query("p1_payload_source", f"WITH {O.POSTINGS} SELECT source, CAST(posting_seq AS VARCHAR) AS external_id, title, company, url FROM p WHERE source IN ('src1', 'src4', 'src11')")
def p1(spark: SparkSession, d: str) -> DataFrame:
    plugin.register(spark)
    spark.read.format("payloads").option("path", payload_folder(spark, d)).load().where("source in ('src1', 'src4', 'src11')").createOrReplaceTempView("payloads_read")
    return spark.sql("SELECT source, f.external_id, f.title, f.company, f.url FROM payloads_read, LATERAL feed_items(payload, 'flat') f")


_WORDS = "array_to_string(list_sort(list_filter(string_split({0}, ' '), lambda x: x <> '')), ' ')"


@query("p3_similarity", f"WITH {O.POSTINGS}, t AS (SELECT DISTINCT title, company FROM p) SELECT title, company, {O.ratio('x', 'y')} AS ratio FROM (SELECT *, {_WORDS.format('title')} AS x, {_WORDS.format('company')} AS y FROM t)")
def p3(spark: SparkSession, d: str) -> DataFrame:
    plugin.register(spark)
    A.postings(spark, d).select("title", "company").distinct().createOrReplaceTempView("titles_and_companies")
    return spark.sql("SELECT title, company, token_sort_ratio(title, company) AS ratio FROM titles_and_companies")
