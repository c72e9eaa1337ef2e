"""The operators' rules written as DuckDB expressions, apart from the Spark code."""

from __future__ import annotations

import re

from postlake.functions import rules as R
from postlake.operators import ranking as RK
from postlake.operators import validation as V
from postlake.sources.adapters import AS_OF, earlier_sql, postings_sql, profiles_sql

NOW = f"TIMESTAMP '{AS_OF}'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def rx(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(edges(pattern))})"


def edges(pattern: str) -> str:
    """Word edges that also hold next to letters with accents, as the other engine's patterns do."""
    pattern = re.sub(r"\|\\b(\w+)\\b", r"|\1", pattern)  # the group around it has edges of its own
    return pattern.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])") if any(ord(c) > 127 for c in pattern) or "Unicode" in pattern else pattern


LETTER = r"[\p{L}\p{N}_]"


def wx(c: str, pattern: str, to: str = "") -> str:
    """Replace a pattern, of which both ends are edges of words, wherever it is a whole word in any script; twice, as matches share what lies between them."""
    core = re.sub(r"\((?!\?)", "(?:", pattern.removeprefix(r"\b").removesuffix(r"\b")).replace(r"\w", LETTER)
    once = lambda x: rx(x, rf"(^|[^\p{{L}}\p{{N}}_])(?:{core})($|[^\p{{L}}\p{{N}}_])", rf"\1{to}\2")
    return once(once(c))


def ntext(c: str) -> str:
    return f"lower(trim({rx(f"coalesce({c}, '')", r'\s+', ' ')}))"


def bare(c: str) -> str:
    """Without marks, and with syllables of Hangul taken apart by their codes."""
    jamo = "chr(CAST(4352 + (unicode(x) - 44032) // 588 AS INT)) || chr(CAST(4449 + (unicode(x) - 44032) % 588 // 28 AS INT)) || CASE WHEN (unicode(x) - 44032) % 28 = 0 THEN '' ELSE chr(CAST(4519 + (unicode(x) - 44032) % 28 AS INT)) END"
    return f"array_to_string(list_transform(string_split(strip_accents({c}), ''), lambda x: CASE WHEN unicode(x) BETWEEN 44032 AND 55203 THEN {jamo} ELSE x END), '')"


def url(c: str) -> str:
    return f"rtrim({rx(f"lower(trim(coalesce({c}, '')))", '[?#].*$')}, '/')"


def company(c: str) -> str:
    e = bare(ntext(c))
    for w in R.COMPANY_SUFFIXES:
        e = wx(e, w)
    return f"trim({rx(rx(e, r'[^\p{L}\p{N}_\s]'), r'\s+', ' ')})"


def title_words(c: str) -> str:
    e = bare(ntext(c))
    for a, b in R.TITLE_SYNONYMS:
        e = wx(e, a, b)
    return f"list_filter(string_split_regex({rx(e, r'[^\p{L}\p{N}_\s]', ' ')}, '\\s+'), lambda x: length(x) > 1 AND x NOT IN ({', '.join(map(q, R.TITLE_STOP_WORDS))}))"


def title(c: str) -> str:
    return f"array_to_string({title_words(c)}, ' ')"


def title_key(c: str) -> str:
    return f"array_to_string(list_sort({title_words(c)}), ' ')"


def anyof(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def location(c: str) -> str:
    e = bare(ntext(c))
    s = e
    for long, short in R.STATES:
        s = wx(s, f"({long}|{short})", short)
    return f"CASE WHEN {anyof(e, R.REMOTE_WORDS)} THEN 'remoto' WHEN {anyof(e, R.HYBRID_WORDS)} THEN 'hibrido' ELSE trim({rx(s, r'[^\p{L}\p{N}_\s]')}) END"


def key() -> str:
    return f"concat_ws('|', {title_key('title')}, {company('company')}, {location('location')})"


def chash() -> str:
    return f"sha256(CASE WHEN external_id <> '' THEN 'ext:' || external_id WHEN url <> '' THEN 'url:' || {url('url')} ELSE {key()} END)"


def seniority() -> str:
    e = f"lower({bare("concat_ws(' ', title, substr(description, 1, 500))")})"
    return "CASE " + " ".join(f"WHEN regexp_matches({e}, {q(p)}) THEN {q(level)}" for level, p in R.SENIORITY) + " ELSE '' END"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: a row of the usual table for each character of ``a``, best values up to each of ``b``."""
    signs = lambda c: f"list_transform(list_filter(string_split({c}, ''), lambda w: w <> ''), lambda w: unicode(w))"
    row = f"list_transform(range(1, CAST(length({b}) + 1 AS BIGINT)), lambda j: CASE WHEN unicode({b}[j]) = x[1] THEN 1 + (CASE WHEN j = 1 THEN 0 ELSE acc[j - 1] END) ELSE acc[j] END)"
    best = f"list_transform(range(1, CAST(length({b}) + 1 AS BIGINT)), lambda k: list_max(list_slice({row}, 1, k)))"
    start = f"list_transform(range(1, CAST(length({b}) + 1 AS BIGINT)), lambda j: 0)"
    return f"coalesce(list_reduce(list_transform({signs(a)}, lambda c: [c]), lambda acc, x: {best}, {start})[-1], 0)"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {lcs(a, b)} / (length({a}) + length({b})) END"


POSTINGS = f"p AS ({postings_sql()})"
KEYED = f"""{POSTINGS}, k AS (SELECT *, {chash()} AS content_hash, {url('url')} AS url_key, {company('company')} AS company_key,
  {title_key('title')} AS title_key, {location('location')} AS location_key FROM p)"""
EARLIER = f"e AS ({earlier_sql()})"


def similar(mine: str, theirs: str, tag: str = "", threshold: float = 88) -> str:
    """CTEs cp, tp and dup (posting_seq, duplicate_of): all matches of two keyed tables."""
    words = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
    return f"""na{tag} AS MATERIALIZED (SELECT DISTINCT company_key AS a, {words('company_key')} AS aw FROM {mine} WHERE company_key <> ''),
nb{tag} AS MATERIALIZED (SELECT DISTINCT company_key AS b, {words('company_key')} AS bw FROM {theirs} WHERE company_key <> ''),
cp{tag} AS MATERIALIZED (SELECT a, b FROM na{tag}, nb{tag} WHERE a = b OR (length(a) >= 4 AND length(b) >= 4 AND (contains(a, b) OR contains(b, a))) OR {ratio('aw', 'bw')} >= 90),
tp{tag} AS MATERIALIZED (SELECT a, b FROM (SELECT DISTINCT title_key AS a FROM {mine}), (SELECT DISTINCT title_key AS b FROM {theirs}) WHERE a = b OR {ratio('a', 'b')} >= {threshold}),
dup{tag} AS MATERIALIZED (
  SELECT m.posting_seq, t.posting_seq AS duplicate_of FROM {mine} m JOIN {theirs} t ON m.url_key = t.url_key WHERE m.url_key <> ''
  UNION SELECT m.posting_seq, t.posting_seq FROM {mine} m JOIN {theirs} t ON m.source = t.source AND m.external_id = t.external_id WHERE m.source <> '' AND m.external_id <> ''
  UNION SELECT m.posting_seq, t.posting_seq FROM {mine} m JOIN cp{tag} cp ON cp.a = m.company_key JOIN {theirs} t ON t.company_key = cp.b JOIN tp{tag} tp ON tp.a = m.title_key AND tp.b = t.title_key
    WHERE m.location_key = '' OR t.location_key = '' OR m.location_key = 'remoto' OR t.location_key = 'remoto' OR lower(m.work_mode) = 'remote' OR lower(t.work_mode) = 'remote'
      OR contains(m.location_key, t.location_key) OR contains(t.location_key, m.location_key))"""


def keyed(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT *, {chash()} AS content_hash, {url('url')} AS url_key, {company('company')} AS company_key,
  {title_key('title')} AS title_key, {location('location')} AS location_key FROM {source})"""

AGE = f"CASE WHEN published_at < {NOW} - INTERVAL 60 DAY THEN concat('published_', CAST(floor((epoch_us({NOW}) - epoch_us(published_at)) / 86400000000.0) AS BIGINT), '_days_ago (limit: 60)') END"
CLOSED = "CASE " + " ".join(f"WHEN {has("lower(concat_ws(' ', title, description))", p)} THEN {q('closure_signal: ' + p)}" for p in R.CLOSURE) + " END"
def fresh(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, age IS NOT NULL OR closed IS NOT NULL AS is_ghost,
  CASE WHEN age IS NOT NULL THEN 'potential_ghost' WHEN closed IS NOT NULL THEN 'closed' ELSE 'active' END AS status,
  coalesce(age, closed, '') AS ghost_reason,
  CASE WHEN published_at IS NULL THEN 'unknown_date' WHEN age IS NOT NULL THEN 'expired' ELSE 'verified' END AS date_status
  FROM (SELECT *, {AGE} AS age, {CLOSED} AS closed FROM {source}))"""


FRESH = fresh("f", "p")
PAIRS = f"{POSTINGS}, {FRESH}, pairs AS (SELECT * FROM f, ({profiles_sql()}) pr)"

LOW = "list_transform({0}, lambda x: lower(trim(x)))"


def low(c: str) -> str:
    return LOW.format(c)


def some(items: str, test: str) -> str:
    return f"(len(list_filter({items}, lambda x: {test})) > 0)"


def first(items: str, test: str) -> str:
    return f"list_filter({items}, lambda x: {test})[1]"


BLOB = "concat_ws(' ', lower(trim(title)), lower(trim(description)))"
MODE = "lower(trim(work_mode))"
KIND = "lower(trim(employment_type))"


def fold(m: str) -> str:
    return f"CASE WHEN {m} IN ('remote', 'remoto') THEN 'remote' WHEN {m} IN ('hybrid', 'hibrido') THEN 'hybrid' ELSE 'onsite' END"


def pylist(items: str) -> str:
    return f"concat('[', array_to_string(list_transform({items}, lambda x: concat('''', x, '''')), ', '), ']')"


def types() -> str:
    more = "CASE x " + " ".join(f"WHEN {q(k)} THEN {lst(v)}" for k, v in R.EMPLOYMENT.items()) + " ELSE [] END"
    return f"list_concat({low('employment_types')}, flatten(list_transform({low('employment_types')}, lambda x: {more})))"


def reg(c: str, p: str) -> str:
    return has(f"lower({c})", p)


def v_rules() -> dict[str, str]:
    ex = f"(source = 'mock' OR {anyof('url', V.EXAMPLES['url'])} OR {anyof('lower(title)', V.EXAMPLES['title'])} OR {anyof('lower(company)', V.EXAMPLES['company'])})"
    roles, pref, kws = low("desired_roles"), low("preferred_keywords"), low("excluded_keywords")
    tech_profile = f"(len(desired_roles) = 0 OR {some(roles, anyof('x', V.TECH_PROFILE))})"
    signal = f"({reg(BLOB, V.TECH)} OR {some(f'list_concat({roles}, {pref})', f'contains({BLOB}, x)')})"
    kw = first(kws, f"contains(concat(' ', {BLOB}, ' '), concat(' ', x, ' ')) OR contains(lower(trim(title)), x)")
    firm = first(low("excluded_companies"), "contains(lower(trim(company)), x) OR contains(x, lower(trim(company)))")
    foreign = f"({R.FOREIGN})"
    return {
        "v0": "CASE WHEN list_contains(excluded_postings, posting_seq) THEN 'user_excluded_job' END",
        "v1": "CASE WHEN length(trim(title)) < 3 THEN 'missing_or_invalid_title' WHEN NOT regexp_matches(url, '^https?://') THEN 'invalid_url' WHEN trim(company) = '' THEN 'missing_company_name' END",
        "v2": f"CASE WHEN {ex} THEN 'example_or_mock_job' END",
        "v3": "CASE " + " ".join(f"WHEN {reg(BLOB, p)} THEN {q('spam_pattern_detected: ' + p)}" for p in R.SPAM) + " END",
        "v4": "CASE WHEN status IN ('closed', 'potential_ghost') THEN concat('status_', status) END",
        "v5": f"CASE WHEN {kw} IS NOT NULL THEN concat('excluded_keyword: ', {kw}) END",
        "v6": f"CASE WHEN {firm} IS NOT NULL THEN concat('excluded_company: ', {firm}) END",
        "v7": f"CASE WHEN NOT {tech_profile} THEN NULL WHEN {reg('title', V.NON_TECH)} AND NOT {reg('title', V.TECH_TITLE)} THEN concat('unrelated_career_domain: ', trim(title)) WHEN NOT {signal} THEN 'no_tech_or_software_relevance' END",
        "v8": f"CASE WHEN len(mandatory_keywords) > 0 AND NOT {some(low('mandatory_keywords'), f'contains({BLOB}, x)')} THEN concat('missing_mandatory_keyword: ', {pylist(low('mandatory_keywords'))}) END",
        "v9": f"CASE WHEN len(work_modes) > 0 AND {MODE} <> '' AND NOT {some(low('work_modes'), f'{fold("x")} = {fold(MODE)}')} THEN concat('work_mode_mismatch: ', {MODE}, ' not in ', {pylist(low('work_modes'))}) END",
        "v10": f"CASE WHEN NOT {some(low('locations'), has('x', foreign))} AND {fold(MODE)} <> 'remote' AND {has('lower(location)', foreign)} THEN concat('foreign_onsite_location_mismatch: ', location) END",
        "v11": f"CASE WHEN len(employment_types) > 0 AND {KIND} <> '' AND NOT {some(types(), f'contains({KIND}, x) OR contains(x, {KIND})')} THEN concat('employment_type_mismatch: ', {KIND}, ' not in ', {pylist(low('employment_types'))}) END",
        "v12": f"CASE WHEN {reg('title', R.EXECUTIVE)} THEN concat('executive_management_mismatch: ', trim(title)) END",
        "v13": "CASE WHEN minimum_salary <> 0 AND salary_max <> 0 AND salary_max < minimum_salary THEN concat('salary_below_minimum: max=', salary_max, ' < min_required=', minimum_salary)"
               " WHEN maximum_salary <> 0 AND salary_min <> 0 AND salary_min > maximum_salary THEN concat('salary_above_maximum: min=', salary_min, ' > max_required=', maximum_salary) END",
    }


def hard() -> str:
    blob = "concat_ws(' ', lower(title), lower(description))"
    return f"""CASE WHEN {some(low('excluded_keywords'), f'contains({blob}, x)')} THEN 'excluded_keyword'
 WHEN company <> '' AND {some(low('excluded_companies'), 'contains(lower(company), x)')} THEN 'excluded_company'
 WHEN len(seniority_levels) > 0 AND NOT list_contains({low('seniority_levels')}, lower(seniority)) THEN 'seniority'
 WHEN len(work_modes) > 0 AND NOT list_contains({low('work_modes')}, lower(work_mode)) THEN 'work_mode'
 WHEN len(employment_types) > 0 AND employment_type <> '' AND NOT {some(types(), f'contains({KIND}, x) OR contains(x, {KIND})')} THEN 'employment_type'
 WHEN minimum_salary <> 0 AND salary_max <> 0 AND salary_max < minimum_salary THEN 'salary_below_minimum'
 WHEN maximum_salary <> 0 AND salary_min <> 0 AND salary_min > maximum_salary THEN 'salary_above_maximum' ELSE 'ok' END"""


def r_scores() -> dict[str, str]:
    t, d, given = "lower(title)", "lower(description)", "list_concat(desired_roles, roles)"
    wanted = low(given)
    blob = "lower(concat_ws(' ', title, description, array_to_string(requirements, ' ')))"
    target = f"list_distinct(list_concat({low('skills')}, {low('preferred_keywords')}))"
    need = low("requirements")
    own = "(CASE WHEN profile_seniority = '' THEN 'junior' ELSE profile_seniority END)"
    points = " + ".join(f"CASE WHEN {anyof(blob, w)} THEN {n} ELSE 0 END" for w, n in ((["python"], 40), (["django"], 25), (["rest", "api"], 15), (["sql"], 10), (["git", "docker", "linux"], 10)))
    total = f"({points} + least(20, 5 * len(list_filter({target}, lambda x: contains({blob}, x) AND x NOT IN ('python', 'django')))))"
    rank = lambda c: "(CASE " + c + " " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in R.SENIORITY_RANK.items()) + " ELSE 2 END)"
    gap = f"abs({rank('seniority')} - {rank(own)})"
    by_gap = f"CASE {gap} WHEN 0 THEN 100 WHEN 1 THEN 75 WHEN 2 THEN 40 ELSE 15 END"
    entry = f"({own} IN ('junior', 'estagio', 'intern') OR (len(seniority_levels) > 0 AND NOT {some('seniority_levels', "lower(x) IN ('senior', 'pleno', 'mid', 'lead')")}))"
    places, place = low("locations"), "lower(location)"
    specific = f"list_filter({places}, lambda x: x NOT IN ({', '.join(map(q, R.ANYWHERE))}))"
    near = lambda sep: some(specific, f"contains({place}, x) OR (length(trim(string_split_regex(x, '{sep}')[1])) >= 3 AND contains({place}, trim(string_split_regex(x, '{sep}')[1])))")
    hours = f"((epoch_us({NOW}) - epoch_us(published_at)) / 3600000000.0)"
    senior = f"({anyof(t, R.SENIOR_WORDS)} OR seniority IN ({', '.join(map(q, R.SENIOR_LEVELS))}))"
    return {
        "role_score": f"""CASE WHEN len({given}) = 0 THEN 65 WHEN {some(wanted, f'contains({t}, x)')} THEN 100 WHEN {anyof(t, ['python', 'django'])} THEN 96
 WHEN {anyof(t, ['estagio', 'estágio'])} AND {anyof(t, ['ti', 'dev', 'software', 'computação', 'sistemas', 'tecnologia'])} THEN 95
 WHEN {anyof(t, ['desenvolvedor', 'developer', 'software', 'backend', 'devops', 'engenheiro de software', 'programador'])} THEN 88
 WHEN {some(wanted, f'contains({d}, x)')} THEN 72
 WHEN NOT ({anyof(t, R.TECH_ROLES)} OR {anyof(f"concat_ws(' ', {t}, {d})", ['python', 'django', 'software', 'desenvolvedor'])}) THEN 0 ELSE 45 END""",
        "skills_score": f"CASE WHEN len({target}) = 0 THEN 60 WHEN len({need}) > 0 AND list_has_all({target}, {need}) THEN 100 ELSE least(100, {total}) END",
        "seniority_score": f"""CASE WHEN {entry} THEN CASE WHEN {senior} THEN 25
 WHEN {anyof('seniority', ['estagio', 'intern', 'trainee'])} OR {anyof(t, ['estágio', 'estagio'])} THEN 100
 WHEN contains(seniority, 'junior') OR {anyof(t, ['júnior', 'junior', 'trainee'])} THEN 100
 WHEN seniority IN ('pleno', 'mid') OR contains({t}, 'pleno') THEN 55 WHEN seniority = '' THEN 80 ELSE {by_gap} END ELSE {by_gap} END""",
        "location_score": f"""CASE WHEN len(locations) = 0 THEN 80 WHEN {near('[,-]')} THEN 100 WHEN lower(work_mode) IN ('remote', 'remoto') OR contains({place}, 'remoto') THEN 100
 WHEN {anyof(place, R.ABROAD)} THEN 0 WHEN lower(work_mode) IN ('onsite', 'presencial') AND len({specific}) > 0 THEN 35
 WHEN {some(places, f'contains({place}, x)')} THEN 80 ELSE 50 END""",
        "recency_score": f"CASE WHEN published_at IS NULL THEN 50 WHEN {hours} <= 24 THEN 100 WHEN {hours} <= 72 THEN 90 WHEN {hours} <= 168 THEN 80 WHEN {hours} <= 336 THEN 65 ELSE 40 END",
        "_senior_brake": f"({own} IN ('junior', 'estagio', 'intern') AND {senior})",
        "_far_brake": f"(len({specific}) > 0 AND lower(work_mode) IN ('onsite', 'presencial') AND NOT {near(',')})",
    }


def reasoning() -> str:
    """The list of reasons, by the same ladders."""
    t, d, given = "lower(title)", "lower(description)", "list_filter(list_concat(desired_roles, roles), lambda x: x <> '')"
    need, target = low("requirements"), f"list_distinct(list_concat({low('skills')}, {low('preferred_keywords')}))"
    blob = "lower(concat_ws(' ', title, description, array_to_string(requirements, ' ')))"
    hits = f"list_sort(list_filter({target}, lambda x: contains({blob}, x)))"
    terms = f"list_filter({lst(RK.TITLE_TERMS)}, lambda x: contains({t}, x))"
    own = "(CASE WHEN profile_seniority = '' THEN 'junior' ELSE profile_seniority END)"
    entry = f"({own} IN ('junior', 'estagio', 'intern') OR (len(seniority_levels) > 0 AND NOT {some('seniority_levels', "lower(x) IN ('senior', 'pleno', 'mid', 'lead')")}))"
    places, place = low("locations"), "lower(location)"
    specific = f"list_filter({places}, lambda x: x NOT IN ({', '.join(map(q, R.ANYWHERE))}))"
    near = some(specific, f"contains({place}, x) OR (length(trim(string_split_regex(x, '[,-]')[1])) >= 3 AND contains({place}, trim(string_split_regex(x, '[,-]')[1])))")
    in_title, in_text = (f"contains({x}, lower(x))" for x in (t, d))
    quoted = lambda before, what, after: f"concat({q(before)}, {what}, {q(after)})"
    role = f"""CASE WHEN len(list_concat(desired_roles, roles)) = 0 THEN 'Cargo compatível com perfil geral'
 WHEN {some(given, in_title)} THEN {quoted("🎯 Cargo exato '", first(given, in_title), "' no título")}
 WHEN {anyof(t, ['python', 'django'])} THEN '🐍 Vaga com foco direto em Python/Django no título'
 WHEN {anyof(t, ['estagio', 'estágio'])} AND {anyof(t, RK.TECH_INTERN)} THEN '🎓 Oportunidade de Estágio na área de Tecnologia'
 WHEN len({terms}) > 0 THEN concat('💻 Cargo de Engenharia/Desenvolvimento: ', array_to_string({terms}, ', '))
 WHEN {some(given, in_text)} THEN {quoted("Cargo '", first(given, in_text), "' citado no escopo da vaga")}
 WHEN NOT ({anyof(t, R.TECH_ROLES)} OR {anyof(f"concat_ws(' ', {t}, {d})", ['python', 'django', 'software', 'desenvolvedor'])}) THEN 'Título não pertence à área de Tecnologia/Software'
 ELSE 'Título não coincide diretamente com os cargos desejados' END"""
    skills = f"""CASE WHEN len({target}) = 0 THEN ['Sem lista de tecnologias específicas'] ELSE list_filter([
 CASE WHEN contains({blob}, 'python') THEN '🐍 Requisito essencial atendido: Python' END, CASE WHEN contains({blob}, 'django') THEN '⚡ Framework desejado atendido: Django' END,
 CASE WHEN len({need}) > 0 AND list_has_all({target}, {need}) THEN '🎯 Todos os requisitos técnicos da vaga atendidos' END,
 CASE WHEN len({hits}) > 0 AND NOT {anyof(blob, ['python', 'django'])} THEN concat('Tecnologias encontradas: ', array_to_string({hits}[1:4], ', ')) END,
 CASE WHEN len({hits}) = 0 THEN 'Nenhuma das tecnologias preferidas identificada' END], lambda x: x IS NOT NULL) END"""
    other = "concat('Nível de senioridade (', CASE WHEN seniority = '' THEN 'não especificado' ELSE seniority END, ')')"
    level = f"""CASE WHEN NOT {entry} THEN {other} WHEN {anyof(t, R.SENIOR_WORDS)} THEN 'Nível Sênior/Lead (acima da faixa inicial)'
 WHEN seniority IN ({', '.join(map(q, R.SENIOR_LEVELS))}) THEN 'Nível Sênior (acima da faixa inicial)'
 WHEN {anyof('seniority', ['estagio', 'intern', 'trainee'])} OR {anyof(t, ['estágio', 'estagio'])} THEN '🎓 Nível Estágio ideal para seu momento acadêmico'
 WHEN contains(seniority, 'junior') OR {anyof(t, ['júnior', 'junior', 'trainee'])} THEN '🌱 Nível Júnior perfeitamente compatível'
 WHEN seniority IN ('pleno', 'mid') OR contains({t}, 'pleno') THEN 'Nível Pleno (exige experiência intermediária)'
 WHEN seniority = '' THEN 'Nível aberto / acessível para início de carreira' ELSE {other} END"""
    where = f"""CASE WHEN len(locations) = 0 THEN 'Localização flexível' WHEN {near} THEN concat('📍 Oportunidade na sua localização prioritária (', location, ')')
 WHEN lower(work_mode) IN ('remote', 'remoto') OR contains({place}, 'remoto') THEN '🌐 Oportunidade 100% Remota'
 WHEN {anyof(place, R.ABROAD)} THEN concat('⚠️ Presencial no exterior (', location, ')')
 WHEN lower(work_mode) IN ('onsite', 'presencial') AND len({specific}) > 0 THEN concat('Presencial fora da sua região (', location, ')')
 WHEN {some(places, f'contains({place}, x)')} THEN concat('Localização compatível: ', location) ELSE 'Localização ampla' END"""
    return f"list_concat(list_concat([{role}], {skills}), [{level}, {where}])[1:6]"


def ranked(source: str) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in r_scores().items())
    total = "(0.3::DOUBLE * role_score + 0.3::DOUBLE * skills_score + 0.2::DOUBLE * seniority_score + 0.15::DOUBLE * location_score + 0.05::DOUBLE * recency_score)"
    return f"""(SELECT *, CAST(least(CASE WHEN _far_brake THEN 60 ELSE 100 END, CASE WHEN _senior_brake THEN 50 ELSE 100 END, round_even({total}, 0)) AS INT) AS score
 FROM (SELECT *, {cols} FROM {source}) s)"""
