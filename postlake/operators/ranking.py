"""Relevance of postings for profiles, 0 to 100, from five scores and two brakes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import rules
from postlake.functions.text import any_of
from postlake.operators.validation import first_that, listed


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


# Terms of titles in technology and of internships there, and points for skills.
TITLE_TERMS = ["desenvolvedor", "developer", "software", "backend", "devops", "engenheiro de software", "programador"]
TECH_INTERN = ["ti", "dev", "software", "computação", "sistemas", "tecnologia"]
_POINTS = [(["python"], 40), (["django"], 25), (["rest", "api"], 15), (["sql"], 10), (["git", "docker", "linux"], 10)]


def with_signals(postings: DataFrame) -> DataFrame:
    """Add what the scores find in a posting alone, so that its texts are searched once and not once a profile."""
    title, desc = _low("title"), _low("description")
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.array_join(_list("requirements"), " ")))
    return postings.withColumns({"_desc": desc, "_skill_blob": blob}).withColumns(
        {
            "_tech_role": any_of(title, rules.TECH_ROLES) | any_of(F.concat_ws(" ", title, F.col("_desc")), ["python", "django", "software", "desenvolvedor"]),
            "_points": reduce(lambda a, b: a + b, [F.when(any_of(F.col("_skill_blob"), w), n).otherwise(0) for w, n in _POINTS]),
        }
    )


def _signalled(rows: DataFrame) -> DataFrame:
    return rows if "_skill_blob" in rows.columns else with_signals(rows)


def role_score() -> Column:
    title, desc = _low("title"), F.col("_desc")
    given = F.concat(_list("desired_roles"), _list("roles"))
    wanted = F.transform(F.filter(given, lambda r: r != ""), F.lower)
    tech = F.col("_tech_role")
    return (
        F.when(F.size(given) == 0, 65)
        .when(F.exists(wanted, lambda r: F.contains(title, r)), 100)
        .when(any_of(title, ["python", "django"]), 96)
        .when(any_of(title, ["estagio", "estágio"]) & any_of(title, TECH_INTERN), 95)
        .when(any_of(title, TITLE_TERMS), 88)
        .when(F.exists(wanted, lambda r: F.contains(desc, r)), 72)
        .when(~tech, 0)
        .otherwise(45)
    )


def skills_score() -> Column:
    target = F.array_distinct(F.concat(listed("skills"), listed("preferred_keywords")))
    blob = F.col("_skill_blob")
    others = F.size(F.filter(target, lambda s: F.contains(blob, s) & ~s.isin("python", "django")))
    total = F.col("_points") + F.least(F.lit(20), others * 5)
    needed = listed("requirements")
    met = (F.size(needed) > 0) & (F.size(F.array_except(needed, target)) == 0)
    return F.when(F.size(target) == 0, 60).otherwise(F.least(F.lit(100), F.when(met, F.greatest(total, F.lit(100))).otherwise(total)))


def _rank(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.SENIORITY_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, level), F.lit(2))


def _entry() -> Column:
    """Whether the profile looks for entry-level positions."""
    own = F.trim(F.lower(F.coalesce(F.nullif(F.col("profile_seniority"), F.lit("")), F.lit("junior"))))
    levels = F.transform(_list("seniority_levels"), F.lower)
    return own.isin("junior", "estagio", "intern") | ((F.size(levels) > 0) & ~F.exists(levels, lambda s: s.isin("senior", "pleno", "mid", "lead")))


def seniority_score() -> Column:
    level, own, title = F.trim(_low("seniority")), F.trim(F.lower(F.coalesce(F.nullif(F.col("profile_seniority"), F.lit("")), F.lit("junior")))), _low("title")
    entry = _entry()
    gap = F.abs(_rank(level) - _rank(own))
    by_gap = F.when(gap == 0, 100).when(gap == 1, 75).when(gap == 2, 40).otherwise(15)
    return F.when(
        entry,
        F.when(any_of(title, rules.SENIOR_WORDS) | level.isin(rules.SENIOR_LEVELS), 25)
        .when(any_of(level, ["estagio", "intern", "trainee"]) | any_of(title, ["estágio", "estagio"]), 100)
        .when(F.contains(level, F.lit("junior")) | any_of(title, ["júnior", "junior", "trainee"]), 100)
        .when(level.isin("pleno", "mid") | F.contains(title, F.lit("pleno")), 55)
        .when(level == "", 80)
        .otherwise(by_gap),
    ).otherwise(by_gap)


def _near(place: Column, separators: str) -> Column:
    """Whether the location is one of the places asked for, other than the whole country or remote."""
    specific = F.filter(listed("locations"), lambda p: ~p.isin(rules.ANYWHERE))
    city = lambda p: F.trim(F.get(F.split(p, separators), F.lit(0)))
    return F.exists(specific, lambda p: F.contains(place, p) | ((F.length(city(p)) >= 3) & F.contains(place, city(p))))


def location_score() -> Column:
    places, mode, place = listed("locations"), _low("work_mode"), _low("location")
    specific = F.size(F.filter(places, lambda p: ~p.isin(rules.ANYWHERE))) > 0
    return (
        F.when(F.size(places) == 0, 80)
        .when(_near(place, "[,-]"), 100)
        .when(mode.isin("remote", "remoto") | F.contains(place, F.lit("remoto")), 100)
        .when(any_of(place, rules.ABROAD), 0)
        .when(mode.isin("onsite", "presencial") & specific, 35)
        .when(F.exists(places, lambda p: F.contains(place, p)), 80)
        .otherwise(50)
    )


def recency_score(as_of: Column) -> Column:
    hours = (F.unix_micros(as_of) - F.unix_micros("published_at")) / 3_600_000_000
    return F.when(hours.isNull(), 50).when(hours <= 24, 100).when(hours <= 72, 90).when(hours <= 168, 80).when(hours <= 336, 65).otherwise(40)


def rank(pairs: DataFrame, as_of: Column) -> DataFrame:
    """Add the five scores and ``score`` to rows of posting, profile and preferences.

    The weighted sum is rounded half to even. Entry-level profiles see senior postings at 50 at
    most, and on-site ones outside the places asked for score 60 at most.
    """
    scored = _signalled(pairs).withColumns(
        {"role_score": role_score(), "skills_score": skills_score(), "seniority_score": seniority_score(), "location_score": location_score(), "recency_score": recency_score(as_of)}
    )
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"{k}_score") for k, w in rules.WEIGHTS.items()])
    score = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).cast("int")
    own = F.trim(F.lower(F.coalesce(F.nullif(F.col("profile_seniority"), F.lit("")), F.lit("junior"))))
    senior = any_of(_low("title"), rules.SENIOR_WORDS) | F.trim(_low("seniority")).isin(rules.SENIOR_LEVELS)
    specific = F.size(F.filter(listed("locations"), lambda p: ~p.isin(rules.ANYWHERE))) > 0
    far = specific & _low("work_mode").isin("onsite", "presencial") & ~_near(_low("location"), ",")
    braked = F.when(own.isin("junior", "estagio", "intern") & senior, F.least(F.lit(50), score)).otherwise(score)
    return scored.withColumn("score", F.when(far, F.least(F.lit(60), braked)).otherwise(braked)).withColumn("salary_score", F.col("recency_score"))


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# The wording of reasons, in the functions below.
def _role_reason() -> Column:
    title, given = _low("title"), F.filter(F.concat(_list("desired_roles"), _list("roles")), lambda r: r != "")
    hit = first_that(given, lambda r: F.contains(title, F.lower(r)))
    scope = first_that(given, lambda r: F.contains(F.col("_desc"), F.lower(r)))
    terms = F.filter(F.array(*map(F.lit, TITLE_TERMS)), lambda t: F.contains(title, t))
    return (
        F.when(F.size(F.concat(_list("desired_roles"), _list("roles"))) == 0, "Cargo compatível com perfil geral")
        .when(hit.isNotNull(), _joined("🎯 Cargo exato '", hit, "' no título"))
        .when(any_of(title, ["python", "django"]), "🐍 Vaga com foco direto em Python/Django no título")
        .when(any_of(title, ["estagio", "estágio"]) & any_of(title, TECH_INTERN), "🎓 Oportunidade de Estágio na área de Tecnologia")
        .when(F.size(terms) > 0, _joined("💻 Cargo de Engenharia/Desenvolvimento: ", F.array_join(terms, ", ")))
        .when(scope.isNotNull(), _joined("Cargo '", scope, "' citado no escopo da vaga"))
        .when(~F.col("_tech_role"), "Título não pertence à área de Tecnologia/Software")
        .otherwise("Título não coincide diretamente com os cargos desejados")
    )


def _skill_reasons() -> Column:
    target, blob, needed = F.array_distinct(F.concat(listed("skills"), listed("preferred_keywords"))), F.col("_skill_blob"), listed("requirements")
    hits = F.array_sort(F.filter(target, lambda s: F.contains(blob, s)))
    main = any_of(blob, ["python", "django"])
    found = F.array_compact(
        F.array(
            F.when(any_of(blob, ["python"]), "🐍 Requisito essencial atendido: Python"),
            F.when(any_of(blob, ["django"]), "⚡ Framework desejado atendido: Django"),
            F.when((F.size(needed) > 0) & (F.size(F.array_except(needed, target)) == 0), "🎯 Todos os requisitos técnicos da vaga atendidos"),
            F.when((F.size(hits) > 0) & ~main, _joined("Tecnologias encontradas: ", F.array_join(F.slice(hits, 1, 4), ", "))),
            F.when(F.size(hits) == 0, "Nenhuma das tecnologias preferidas identificada"),
        )
    )
    return F.when(F.size(target) == 0, F.array(F.lit("Sem lista de tecnologias específicas"))).otherwise(found)


def _seniority_reason() -> Column:
    level, title = F.trim(_low("seniority")), _low("title")
    other = _joined("Nível de senioridade (", F.when(level == "", "não especificado").otherwise(level), ")")
    return F.when(
        _entry(),
        F.when(any_of(title, rules.SENIOR_WORDS), "Nível Sênior/Lead (acima da faixa inicial)")
        .when(level.isin(rules.SENIOR_LEVELS), "Nível Sênior (acima da faixa inicial)")
        .when(any_of(level, ["estagio", "intern", "trainee"]) | any_of(title, ["estágio", "estagio"]), "🎓 Nível Estágio ideal para seu momento acadêmico")
        .when(F.contains(level, F.lit("junior")) | any_of(title, ["júnior", "junior", "trainee"]), "🌱 Nível Júnior perfeitamente compatível")
        .when(level.isin("pleno", "mid") | F.contains(title, F.lit("pleno")), "Nível Pleno (exige experiência intermediária)")
        .when(level == "", "Nível aberto / acessível para início de carreira")
        .otherwise(other),
    ).otherwise(other)


def _location_reason() -> Column:
    places, mode, place = listed("locations"), _low("work_mode"), _low("location")
    specific, shown = F.size(F.filter(places, lambda p: ~p.isin(rules.ANYWHERE))) > 0, F.coalesce("location", F.lit(""))
    return (
        F.when(F.size(places) == 0, "Localização flexível")
        .when(_near(place, "[,-]"), _joined("📍 Oportunidade na sua localização prioritária (", shown, ")"))
        .when(mode.isin("remote", "remoto") | F.contains(place, F.lit("remoto")), "🌐 Oportunidade 100% Remota")
        .when(any_of(place, rules.ABROAD), _joined("⚠️ Presencial no exterior (", shown, ")"))
        .when(mode.isin("onsite", "presencial") & specific, _joined("Presencial fora da sua região (", shown, ")"))
        .when(F.exists(places, lambda p: F.contains(place, p)), _joined("Localização compatível: ", shown))
        .otherwise("Localização ampla")
    )


def reasoned(pairs: DataFrame) -> DataFrame:
    """Add ``reasoning``: the first six reasons, of role, skills, seniority and location in that order."""
    every = F.concat(F.array(_role_reason()), _skill_reasons(), F.array(_seniority_reason(), _location_reason()))
    return _signalled(pairs).withColumn("reasoning", F.slice(every, 1, 6))
