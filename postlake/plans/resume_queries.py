"""Queries of résumés, which are documents under the titles of sections, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.operators import resumes as X
from postlake.plans import oracle as O
from postlake.plans.account_queries import _CLEAN
from postlake.plans.queries import query
from postlake.sources import adapters as A

YEAR = 2024

# Pools that résumés are drawn from, by doc_id.
CALLINGS = ["Desenvolvedora Python", "Backend Developer", "Ana | Beto", "Analista de Dados", "Cozinheiro", "Cloud Engineer"]
PLACES = ["Experiência Profissional:", "Work Experience", "## Experiência", "- EXPERIENCIA LABORAL"]
DONE = [
    "Loja Um, 2016 - 2021, sênior", "Estágio em 2023 e 2024", "3 anos de experiência com C++, Java e Node.js", "Pleno desde 2020, antes 2018", "No dates here", "12 years experience, CI/CD; tech lead",
    "2021 e 2024 em React, React Native e k8s", "Jr. developer, spring boot, asp.net e .NET",
]
LISTED = [
    "Backend: Python, Django ORM, FastAPI e Docker Compose", "Figma; Photoshop/Illustrator and Excel", "react | Node.js | TypeScript & Vue.js", "sql, postgres, git, linux, KAFKA, Kafka", "projetos, Anos de rua, X",
    "C#, .NET, ci/cd, 12-factor app", "",
]
SPOKEN = ["Português nativo, Inglês avançado", "English: fluent. Spanish basic", "Espanhol intermediário; inglês b2", "Inglês", "", "portuguese, English a2"]
AIMS = ["", "Objetivo: vaga de estágio", "Cargo desejado - Pessoa de Suporte", "Contato: eu@lugar.example", "https://lugar.example/eu"]


def _pool(values: list[str], step: int) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE CAST((doc_id * {step}) % {len(values)} AS INT) {whens} END"


# In SQL that Spark and other engines read alike; each seventh is a document without titles.
_RESUMES = f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') ELSE concat('Ana Souza', chr(10), {_pool(CALLINGS, 1)}, chr(10), chr(10), 'Resumo', chr(10), {_pool(AIMS, 3)}, chr(10),
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(text, '') END, chr(10), {_pool(PLACES, 1)}, chr(10), {_pool(DONE, 3)}, chr(10), CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE '' END, chr(10),
  'Habilidades Técnicas', chr(10), {_pool(LISTED, 5)}, chr(10), {_pool(LISTED, 3)}, chr(10), 'Idiomas', chr(10), {_pool(SPOKEN, 5)}, chr(10), 'Education', chr(10), 'Escola Dois') END AS text FROM {{documents}}"""


def resumes(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_RESUMES, documents=A.table(spark, d, "documents"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return X.profiles(resumes(spark, d), YEAR)


# The SQL: lines are rows, a line's section is the last title before it, and terms are searched one by one.
L = r"[^\p{L}\p{N}_]"
SPACES = r"[\s\x0B\p{Z}]+"


def has(c: str, words: str) -> str:
    return f"regexp_matches({c}, {O.q(f'(?:^|{L})(?:{words})(?:$|{L})')})"


def strip(c: str) -> str:
    return O.rx(c, rf"^{SPACES}|{SPACES}$")


_TITLE = "CASE " + " ".join(f"WHEN regexp_full_match(trim(lower(line), ':•-# '), {O.q(rf'(?:{t})[:\s]*')}) THEN {O.q(n)}" for n, t in X.SECTIONS.items()) + " END"
_NAMES = ["header", *X.SECTIONS]
_SECTIONS = f"""r AS ({_RESUMES.format(documents='documents')}),
ln AS (SELECT doc_id, {strip('unnest(v)')} AS line, generate_subscripts(v, 1) AS k FROM (SELECT doc_id, string_split_regex(text, {O.q(r'\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')}) AS v FROM r)),
tl AS (SELECT doc_id, k, line, CASE WHEN length(line) < 50 THEN {_TITLE} END AS title FROM ln WHERE line <> ''),
pl AS (SELECT *, last_value(title IGNORE NULLS) OVER w AS title_before, count(*) OVER w AS n FROM tl WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
sl AS (SELECT doc_id, k, line, coalesce(title_before, CASE WHEN n > 6 THEN 'summary' ELSE 'header' END) AS section FROM pl WHERE title IS NULL),
s AS (SELECT r.doc_id, any_value(r.text) AS text, {', '.join(f"coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (section = '{n}'), '') AS {n}" for n in _NAMES)} FROM r LEFT JOIN sl ON r.doc_id = sl.doc_id GROUP BY r.doc_id)"""


def _in_text(term: str) -> str:
    word = "".join("\\" + x if not (x.isalnum() or x == " ") else x for x in term)
    edge = (r"(?:^|[\s,;|(/])", r"(?:[\s,;|)/]|$)") if term in X.SEPARATED else (f"(?:^|{L})", f"(?:$|{L})")
    return f"regexp_matches(lower(text), {O.q(edge[0] + word + edge[1])})"


_CATALOGUE = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN {_in_text(t)} THEN {O.q(x)} END" for t, x in X.SKILLS.items()) + "], lambda x: x IS NOT NULL))"
_MAP = "MAP {" + ", ".join(f"{O.q(t)}: {O.q(x)}" for t, x in X.SKILLS.items()) + "}"
_FREE = f"""cut AS (SELECT doc_id, CASE WHEN contains(line, ':') AND length(split_part(line, ':', 1)) < 35 THEN substr(line, strpos(line, ':') + 1) ELSE line END AS line, k FROM sl WHERE section = 'skills'),
pieces AS (SELECT doc_id, k, generate_subscripts(v, 1) AS nth, unnest(v) AS item FROM (SELECT doc_id, k, flatten(list_transform(string_split_regex(line, '[,;•|/]'), lambda x: string_split_regex(x, '\\s+(?:e|and|&)\\s+'))) AS v FROM cut)),
clean AS (SELECT doc_id, k, nth, trim({strip('item')}, '•-*[]()., ') AS item FROM pieces),
fs AS (SELECT doc_id, lower(item) AS key, k, nth, coalesce({_MAP}[lower(item)], CASE WHEN regexp_matches(item, '\\p{{Lu}}') THEN item END) AS skill FROM clean
  WHERE length(item) BETWEEN 2 AND 30 AND NOT {has('lower(item)', X.NO_SKILL)}),
fr AS (SELECT doc_id, list_distinct(list(skill)) AS free FROM (SELECT doc_id, arg_max(skill, (k, nth)) AS skill FROM fs WHERE skill IS NOT NULL GROUP BY doc_id, key) GROUP BY doc_id)"""
_ORDERED = f"list_transform(list_sort(list_transform(list_distinct(list_concat({_CATALOGUE}, coalesce(free, []))), lambda x: {{'place': coalesce(list_position({O.lst(X.FIRST_SKILLS)}, x), 99), 'skill': x}})), lambda x: x.skill)"
_STORY = "lower(concat_ws(chr(10), header, summary, experience, education, projects))"
_SPAN = f"least({YEAR} - list_min(dates), list_max(dates) - list_min(dates))"
_EXPERIENCE = f"""st AS (SELECT doc_id, {_STORY} AS story, list_filter(list_transform(regexp_extract_all({_STORY}, {O.q(X.YEARS)}, 1), lambda x: TRY_CAST(x AS INT)), lambda x: x IS NOT NULL) AS said,
  list_transform(list_filter(regexp_extract_all(CASE WHEN experience <> '' THEN experience ELSE {_STORY} END, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '20[0-2][0-9]')), lambda x: CAST(x AS INT)) AS dates FROM s),
sp AS (SELECT doc_id, {has('story', X.STUDENT)} AS student, {has('story', X.SENIOR)} AS senior, {has('story', X.MIDDLE)} AS middle, {has('story', X.JUNIOR)} AS junior,
  CASE WHEN len(said) > 0 THEN list_max(said) WHEN len(dates) >= 2 AND {_SPAN} BETWEEN 0 AND 30 THEN {_SPAN} ELSE 0 END AS y FROM st),
ex AS (SELECT doc_id, CASE WHEN senior THEN greatest(y, 5) WHEN middle THEN greatest(y, 3) WHEN student AND y = 0 THEN 1 WHEN student OR y <= 2 OR junior THEN least(y, 2) ELSE y END AS years_experience,
  CASE WHEN senior THEN 'senior' WHEN middle THEN 'mid' WHEN student OR y <= 2 OR junior THEN 'junior' ELSE 'mid' END AS seniority FROM sp)"""
_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
_ENGLISH = f"(len(list_intersect({_WORDS}, {O.lst(X.ENGLISH)})) > len(list_intersect({_WORDS}, {O.lst(X.PORTUGUESE)})))"
_BOTH = "lower(languages || chr(10) || text)"


def _language(name: str, plain: str, unnamed: str) -> str:
    names, levels = X.LEVELS[name]
    before = names.split("|")[0] if name == "Português" else names
    after = lambda w: rf"(?:{before})(?:[^\n.,;]*[^\p{{L}}\p{{N}}_\n.,;])(?:{w})(?:$|{L})"
    ladder = " ".join(f"WHEN regexp_matches({_BOTH}, {O.q(after(w))}) THEN {O.q(f'{name} ({shown})')}" for shown, w in levels)
    return f"CASE WHEN {has(_BOTH, names)} THEN CASE {ladder} ELSE {O.q(plain)} END ELSE {unnamed} END"


_SPOKEN = f"""list_filter([{_language('Português', 'Português', f"CASE WHEN NOT {_ENGLISH} THEN 'Português (Nativo)' END")}, {_language('Inglês', 'Inglês', f"CASE WHEN {_ENGLISH} THEN 'Inglês (Fluente)' END")},
  {_language('Espanhol', 'Espanhol (Básico)', 'NULL')}], lambda x: x IS NOT NULL)"""
_PARAGRAPH = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {strip('x')}), lambda x: length(x) >= 60 AND NOT contains(x, '@') AND NOT {has('lower(x)', X.CONTACT_WORDS)})[1]"
_RAW = f"CASE WHEN length({strip('summary')}) < 30 THEN coalesce({_PARAGRAPH}, summary) ELSE summary END"
_TOLD = f"""list_filter(list_transform(string_split_regex({_RAW}, {O.q(r'\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')}), lambda x: {strip('x')}), lambda x: NOT contains(x, '@') AND NOT regexp_matches(x, {O.q(rf'(?i)\b(?:{X.CONTACTS})\b')}) AND length(x) >= 3)"""
_SUMMARY = f"substr({strip(O.rx(f"array_to_string({_TOLD}, ' ')", SPACES, ' '))}, 1, 750)"
_LEVEL = f"CASE seniority WHEN 'junior' THEN '{X.SUFFIX['junior']}' WHEN 'mid' THEN '{X.SUFFIX['mid']}' ELSE '{X.SUFFIX['senior']}' END"
_NEAR = f"list_filter(string_split(header, chr(10))[2:5], lambda x: NOT regexp_matches(x, '[@•/|]') AND length(x) < 70 AND {has('lower(x)', X.CALLING)})[1]"
_AIM = strip(f"regexp_extract(CASE WHEN summary <> '' THEN summary ELSE text END, {O.q(X.AIM)}, 1)")
_HEADLINE = f"""coalesce({_NEAR}, CASE WHEN length({_AIM}) BETWEEN 6 AND 64 THEN {_AIM} END, CASE WHEN list_has_all(sk, ['Python', 'Django']) THEN 'Desenvolvedor Backend Python | Django | APIs REST'
  WHEN list_contains(sk, 'Python') THEN 'Desenvolvedor Python ' || {_LEVEL} || ' | Backend' WHEN list_has_all(sk, ['React', 'Node.js']) THEN 'Desenvolvedor Full Stack ' || {_LEVEL} || ' | React & Node.js'
  WHEN list_contains(sk, 'React') THEN 'Desenvolvedor Frontend ' || {_LEVEL} || ' | React' WHEN list_contains(sk, 'Java') THEN 'Desenvolvedor Java ' || {_LEVEL} || ' | Spring Boot'
  WHEN list_has_any(sk, {O.lst(X.CLOUD_SKILLS)}) THEN 'Engenheiro DevOps ' || {_LEVEL} || ' | Cloud' ELSE 'Desenvolvedor de Software ' || {_LEVEL} END)"""
_PLACED = lambda items: "[" + ", ".join(f"replace({O.q(x)}, '{{}}', {_LEVEL})" for x in items) + "]"
_KINDS = f"""CASE WHEN contains(lower(headline), 'python') OR list_contains(sk, 'Python') THEN CASE seniority {' '.join(f"WHEN '{k}' THEN {O.lst(v)}" for k, v in X.PYTHON_ROLES.items())} END
  WHEN contains(lower(headline), 'front') OR list_contains(sk, 'React') THEN {_PLACED(X.FRONT_ROLES)} WHEN regexp_matches(lower(headline), 'devops|cloud') THEN {_PLACED(X.CLOUD_ROLES)} ELSE list_prepend(headline, {_PLACED(X.OTHER_ROLES)}) END"""
# a headline may equal a role, the others are distinct
_ROLES = f"(list_filter({_KINDS}, lambda x, i: i = 1 OR x <> ({_KINDS})[1]))[1:8]"
_RECORD = f"""{_SECTIONS}, {_FREE}, {_EXPERIENCE}, a AS (SELECT s.*, years_experience, seniority, {_ORDERED} AS sk FROM s JOIN ex USING (doc_id) LEFT JOIN fr USING (doc_id)),
b AS (SELECT *, {_HEADLINE} AS headline FROM a), rec AS (SELECT doc_id, headline, {_SUMMARY} AS summary, years_experience, seniority, sk AS skills, {_ROLES} AS roles, {_SPOKEN} AS languages FROM b)"""


@query("x2_sections", f"WITH {_SECTIONS} SELECT doc_id, {', '.join(_NAMES)} FROM s")
def x2(spark: SparkSession, d: str) -> DataFrame:
    return X.sections(resumes(spark, d)).select("doc_id", "sections.*")


@query("x3_catalogue_skills", f"WITH {_SECTIONS} SELECT doc_id, list_sort({_CATALOGUE}) AS skills FROM s")
def x3(spark: SparkSession, d: str) -> DataFrame:
    return resumes(spark, d).select("doc_id", F.array_sort(X.catalogue_skills(F.col("text"))).alias("skills"))


@query("x4_free_skills", f"WITH {_SECTIONS}, {_FREE} SELECT doc_id, list_sort(coalesce(free, [])) AS skills FROM s LEFT JOIN fr USING (doc_id)")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return X.sections(resumes(spark, d)).select("doc_id", F.array_sort(X.free_skills(F.col("sections.skills"))).alias("skills"))


@query("x5_ordered_skills", f"WITH {_SECTIONS}, {_FREE} SELECT doc_id, {_ORDERED} AS skills FROM s LEFT JOIN fr USING (doc_id)")
def x5(spark: SparkSession, d: str) -> DataFrame:
    found = F.concat(X.catalogue_skills(F.col("text")), X.free_skills(F.col("sections.skills")))
    return X.sections(resumes(spark, d)).select("doc_id", X.ordered_skills(found).alias("skills"))


@query("x6_languages", f"WITH {_SECTIONS} SELECT doc_id, {_SPOKEN} AS languages FROM s")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return X.sections(resumes(spark, d)).select("doc_id", X.languages(F.col("sections.languages"), F.col("text")).alias("languages"))


@query("x8_experience", f"WITH {_SECTIONS}, {_EXPERIENCE} SELECT * FROM ex")
def x8(spark: SparkSession, d: str) -> DataFrame:
    found = X.sections(resumes(spark, d)).select("doc_id", X.experience(F.col("sections"), YEAR).alias("e"))
    return found.select("doc_id", F.col("e.years").alias("years_experience"), "e.seniority")


@query("x9_headline_roles", f"WITH {_RECORD} SELECT doc_id, headline, roles FROM rec")
def x9(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("doc_id", "headline", "roles")


@query("x10_summary", f"WITH {_SECTIONS} SELECT doc_id, {_SUMMARY} AS summary FROM s")
def x10(spark: SparkSession, d: str) -> DataFrame:
    return X.sections(resumes(spark, d)).select("doc_id", X.summary(F.col("sections.summary"), F.col("text")).alias("summary"))


_FIELDS = ["headline", "summary", "years_experience", "seniority", "skills", "roles", "languages"]


@query("x11_profile", f"WITH {_RECORD} SELECT doc_id, {', '.join(_FIELDS)} FROM rec")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("doc_id", *_FIELDS)


# What another extractor says of two thirds of the documents.
_EXTERNAL = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Pessoa de Dados' ELSE '' END AS headline, CASE WHEN doc_id % 5 = 0 THEN concat('Sobre ', lang) END AS summary,
  CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 9 AS INT) END AS years_experience, CASE WHEN doc_id % 3 = 1 THEN 'mid' ELSE '' END AS seniority,
  {list}('Excel', CASE WHEN doc_id % 2 = 0 THEN 'Python' ELSE 'Go' END) AS skills, {list}('Analista', 'Engenheiro de Software') AS roles, CASE WHEN doc_id % 4 = 1 THEN {list}('Klingon') END AS languages FROM {documents} WHERE doc_id % 3 <> 0"""
_OVER = ", ".join(f"coalesce(CASE WHEN CAST(o.{c} AS VARCHAR) <> '' THEN o.{c} END, rec.{c}) AS {c}" for c in _FIELDS[:4])
_JOINED = lambda a, b: f"list_concat({a}, list_filter({b}, lambda x: NOT list_contains({a}, x)))"


@query("x12_merged_profile", f"""WITH {_RECORD}, o AS ({_EXTERNAL.format(list='list_value', documents='documents')}) SELECT rec.doc_id, {_OVER},
  CASE WHEN o.doc_id IS NULL THEN rec.skills ELSE {_JOINED('rec.skills', 'o.skills')} END AS skills, CASE WHEN o.doc_id IS NULL THEN rec.roles ELSE {_JOINED('o.roles', 'rec.roles')} END AS roles,
  coalesce(o.languages, rec.languages) AS languages FROM rec LEFT JOIN o ON rec.doc_id = o.doc_id""")  # fmt: skip
def x12(spark: SparkSession, d: str) -> DataFrame:
    external = spark.sql(_EXTERNAL.format(list="array", documents="{documents}"), documents=A.table(spark, d, "documents"))
    return X.merged(_profiles(spark, d).select("doc_id", *_FIELDS), external, "doc_id")


_FILES = """SELECT page_id, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN 'CV.PDF' WHEN 1 THEN 'cv.v2.docx' WHEN 2 THEN 'cv' WHEN 3 THEN '.txt' WHEN 4 THEN 'my.dir/cv' WHEN 5 THEN 'cv.exe' WHEN 6 THEN 'cv.' ELSE 'cv.md' END AS filename,
  CASE WHEN page_id % 3 = 0 THEN 'text/plain' ELSE 'image/png' END AS content_type, CASE WHEN page_id % 11 = 0 THEN 0 ELSE CAST(coalesce(length(html), 0) AS BIGINT) * (page_id % 13) * (page_id % 13) * 100 END AS length FROM {pages}"""


@query("s17_upload_gate", f"""SELECT page_id, CASE WHEN length = 0 THEN 'empty' WHEN length > 10485760 THEN 'too_large' WHEN ext <> '' THEN CASE WHEN ext IN ({', '.join(map(O.q, X.EXTENSIONS))}) THEN NULL ELSE 'extension' END
  WHEN content_type NOT IN ({', '.join(map(O.q, X.TYPES))}) THEN 'type' END AS reason
FROM (SELECT *, CASE WHEN contains(base, '.') THEN '.' || split_part(base, '.', -1) ELSE '' END AS ext FROM (SELECT *, ltrim(split_part(lower(filename), '/', -1), '.') AS base FROM ({_FILES.format(pages='pages')}) f))""")  # fmt: skip
def s17(spark: SparkSession, d: str) -> DataFrame:
    files = spark.sql(_FILES, pages=A.table(spark, d, "pages"))
    return files.select("page_id", X.refusal(F.col("filename"), F.col("content_type"), F.col("length")).alias("reason"))


_RTF = O.rx(O.rx(r"'{\rtf1{\fonttbl{\f0 Arial;}}\b ' || coalesce(text, '') || '\par \{end\}}'", X.RTF_GROUP), X.RTF_WORD, " ")
for _mark in ("\\", "{", "}"):
    _RTF = f"replace({_RTF}, '\\{_mark}', '{_mark}')"
_RTF = strip(O.rx(O.rx(_RTF, "[{}]"), SPACES, " "))


@query("s16_read_files", f"""SELECT path, sha256(text) AS digest, CASE WHEN text IS NULL THEN 'unsupported' WHEN text = '' THEN 'empty' ELSE 'read' END AS status FROM (SELECT doc_id || CASE doc_id % 5 WHEN 1 THEN '.rtf' WHEN 2 THEN '.txt' WHEN 3 THEN '.pdf' ELSE '' END AS path,
  CASE doc_id % 5 WHEN 0 THEN 'Formação ' || doc_id WHEN 3 THEN NULL WHEN 2 THEN {_CLEAN.replace("coalesce(text, '')", strip("coalesce(text, '')"))} ELSE {_RTF} END AS text FROM documents)""")  # fmt: skip
def s16(spark: SparkSession, d: str) -> DataFrame:
    seq, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    rtf = F.concat(F.lit(r"{\rtf1{\fonttbl{\f0 Arial;}}\b "), text, F.lit(r"\par \{end\}}"))
    at = seq % 5
    content = F.when(at == 0, F.encode(F.concat(F.lit("Formação "), seq.cast("string")), "ISO-8859-1")).when(at == 2, F.encode(text, "UTF-8")).when(at == 3, F.lit("%PDF").cast("binary")).otherwise(F.encode(rtf, "UTF-8"))
    ending = F.when(at == 1, ".rtf").when(at == 2, ".txt").when(at == 3, ".pdf").otherwise("")
    files = A.table(spark, d, "documents").select(F.concat(seq.cast("string"), ending).alias("path"), content.alias("content"))
    return X.read_files(files).select("path", F.sha2("text", 256).alias("digest"), "status")
