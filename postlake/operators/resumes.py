"""Documents as résumés: clean text, its sections, and what a profile takes from them, with built-in functions.

A null text is an empty one and gives empty sections, lists and summaries.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import let

# Ligatures and characters of no width, and what replaces them.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "\xad": "", "\u200b": ""}
# Signs that count as bullets.
BULLETS = "[•●▪▸▹○◦✔✓]"

# Words that mark a document as English or as Portuguese.
ENGLISH = ["experience", "education", "skills", "summary", "university", "projects", "languages", "work", "years"]
PORTUGUESE = ["experiência", "experiencia", "formação", "formacao", "habilidades", "resumo", "universidade", "projetos", "idiomas", "anos"]

# Terms that are looked for, and the skills that they stand for.
SKILLS = {
    "python": "Python", "django": "Django", "django orm": "Django ORM", "fastapi": "FastAPI",
    "flask": "Flask", "sql": "SQL", "sqlite": "SQLite", "postgresql": "PostgreSQL",
    "postgres": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB", "redis": "Redis",
    "elasticsearch": "Elasticsearch", "java": "Java", "spring boot": "Spring Boot", "spring": "Spring Boot",
    "c#": "C#", ".net": ".NET", "asp.net": "ASP.NET", "node.js": "Node.js", "nodejs": "Node.js",
    "node": "Node.js", "express": "Express", "nest.js": "NestJS", "nestjs": "NestJS",
    "php": "PHP", "laravel": "Laravel", "golang": "Go", "go": "Go", "rust": "Rust",
    "ruby": "Ruby", "ruby on rails": "Ruby on Rails", "rails": "Ruby on Rails",
    "c++": "C++", "c": "C", "kotlin": "Kotlin", "swift": "Swift",
    "typescript": "TypeScript", "javascript": "JavaScript",
    "react": "React", "react.js": "React", "reactjs": "React", "next.js": "Next.js",
    "nextjs": "Next.js", "vue": "Vue.js", "vue.js": "Vue.js", "vuejs": "Vue.js",
    "angular": "Angular", "svelte": "Svelte", "html5": "HTML5", "html": "HTML5",
    "css3": "CSS3", "css": "CSS3", "tailwind": "Tailwind CSS", "tailwind css": "Tailwind CSS",
    "tailwindcss": "Tailwind CSS", "bootstrap": "Bootstrap", "sass": "Sass",
    "redux": "Redux", "flutter": "Flutter", "react native": "React Native",
    "apis rest": "APIs REST", "api rest": "APIs REST", "rest": "APIs REST",
    "restful": "APIs REST", "graphql": "GraphQL", "grpc": "gRPC", "microservices": "Microsserviços",
    "microsserviços": "Microsserviços", "modelagem relacional": "Modelagem Relacional",
    "modelagem de dados": "Modelagem Relacional", "bancos relacionais": "Modelagem Relacional",
    "sqlalchemy": "SQLAlchemy", "prisma": "Prisma", "hibernate": "Hibernate",
    "pandas": "Pandas", "numpy": "NumPy", "scikit-learn": "Scikit-Learn", "power bi": "Power BI",
    "git": "Git", "github": "GitHub", "gitlab": "GitLab", "linux": "Linux",
    "docker": "Docker", "docker compose": "Docker Compose", "kubernetes": "Kubernetes",
    "k8s": "Kubernetes", "helm": "Helm", "terraform": "Terraform", "ansible": "Ansible",
    "ci/cd": "CI/CD", "github actions": "GitHub Actions", "jenkins": "Jenkins",
    "aws": "AWS", "azure": "Azure", "gcp": "GCP", "google cloud": "GCP", "nginx": "Nginx",
    "testes unitários": "Testes Unitários", "unit testing": "Testes Unitários", "unit tests": "Testes Unitários",
    "testes de integração": "Testes de Integração", "integration tests": "Testes de Integração",
    "tdd": "TDD", "pytest": "Pytest", "unittest": "Unittest", "jest": "Jest", "cypress": "Cypress",
    "prompt engineering": "Prompt Engineering", "ia generativa": "IA Generativa",
    "inteligência artificial": "Inteligência Artificial", "artificial intelligence": "Inteligência Artificial",
    "machine learning": "Machine Learning", "deep learning": "Deep Learning",
    "llms": "LLMs", "llm": "LLMs", "langchain": "LangChain",
    "scrum": "Scrum", "kanban": "Kanban", "metodologias ágeis": "Metodologias Ágeis",
    "agile": "Metodologias Ágeis", "clean code": "Clean Code", "clean architecture": "Clean Architecture",
    "arquitetura limpa": "Clean Architecture", "solid": "SOLID", "12-factor": "12-Factor App",
    "12-factor app": "12-Factor App",
}
# Terms that stand between separators, not between word edges.
SEPARATED = ["c++", "c#", ".net", "ci/cd", "12-factor", "12-factor app"]
# Skills that come first.
FIRST_SKILLS = ["Python", "Django", "Django ORM", "FastAPI", "SQL", "PostgreSQL", "SQLite", "APIs REST", "Docker", "Git", "Linux"]

# Titles of sections, in the order in which they are tried.
SECTIONS = {
    "summary": r"resumo\s+profissional|resumo|sobre\s+mim|perfil\s+profissional|perfil|apresenta[çc][ãa]o|objetivo\s+profissional|objetivo|professional\s+summary|summary|about\s+me|profile|career\s+objective|executive\s+summary|resumen\s+profesional|resumen",
    "experience": r"experi[êe]ncia\s+profissional|experi[êe]ncias?\s+profissionais|experi[êe]ncia|experi[êe]ncias|hist[óo]rico\s+profissional|atua[çc][ãa]o\s+profissional|trajet[óo]ria\s+profissional|work\s+experience|professional\s+experience|employment\s+history|experience|experiencia\s+laboral",
    "education": r"forma[çc][ãa]o\s+acad[êe]mica|forma[çc][ãa]o|educa[çc][ãa]o|escolaridade|ensino\s+superior|educaci[óo]n|academic\s+background|education|degrees?",
    "skills": r"conhecimentos?\s+t[ée]cnicos?|habilidades?\s+t[ée]cnicas?|habilidades|compet[êe]ncias|conhecimentos|tecnologias|stacks?|ferramentas|technical\s+skills|core\s+competencies|skills|technologies|tools|hard\s+skills",
    "languages": r"idiomas?|l[íi]nguas?|languages?|language\s+proficiency",
    "projects": r"projetos?\s+relevantes?|projetos?\s+pessoais|projetos?|pr[áa]tica\s+de\s+desenvolvimento|projects?|key\s+projects?|personal\s+projects?|portfolio|portf[óo]lio",
}

# A language, its names and the levels that are tried after them, best first.
LEVELS = {
    "Português": ("portugu[êe]s|portuguese", [("Nativo", "nativo|nativa|materno|materna|fluente")]),
    "Inglês": ("ingl[êe]s|english", [
        ("Fluente", "fluente|fluent|nativo|native"), ("Avançado", "avan[çc]ado|advanced|c1|c2"),
        ("Intermediário - Leitura técnica", r"intermedi[áa]rio|intermediate|b1|b2|leitura\s+t[ée]cnica"), ("Básico", "b[áa]sico|basic|a1|a2|iniciante"),
    ]),
    "Espanhol": ("espanhol|spanish", [("Fluente", "fluente|fluent|nativo"), ("Avançado", "avan[çc]ado|advanced"), ("Intermediário", "intermedi[áa]rio|intermediate")]),
}

# What tells a student, years of experience and levels of seniority.
STUDENT = r"cursando|graduando|estudante\s+de|previs[ãa]o\s+de\s+formatura|bacharelado\s+em\s+andamento|est[áa]gio|estagi[áa]ri[oa]|trainee"
YEARS = r"(\d+)\s*(?:\+|anos?|years?|yrs?)\s*(?:de\s+)?(?:experi[êe]ncia|experience)"
SENIOR = r"s[eê]nior|sr\.?|lead|tech\s+lead|especialista|principal"
MIDDLE = r"pleno|mid-level|pl\.?"
JUNIOR = r"j[úu]nior|jr\.?|iniciante|entry-level"
NO_SKILL = "experi[êe]ncia|anos|projetos?|conhecimento|trabalho|habilidade"
CONTACT_WORDS = "telefone|linkedin|github|celular|whatsapp"
CONTACTS = r"https?://|linkedin\.com|github\.com|\+?\d{2,}\s*\d{4,}"
CALLING = r"desenvolvedor[a]?|developer|engenheir[oa]|software|analista|backend|frontend|full\s*stack|estagi[áa]ri[oa]|engineer|architect|devops|cloud|data|sre"
AIM = r"(?i)(?:objetivo|cargo\s+desejado|área\s+de\s+interesse)[:\-]?\s*([^\n\.]+)"
SUFFIX = {"junior": "Júnior", "mid": "Pleno", "senior": "Sênior"}
CLOUD_SKILLS = ["Docker", "Kubernetes", "AWS", "Terraform", "CI/CD"]
# Roles by kind of headline; {} is the level's name.
PYTHON_ROLES = {
    "junior": ["Desenvolvedor Python Júnior", "Desenvolvedor Backend Júnior", "Desenvolvedor de Software Júnior", "Estagiário de Desenvolvimento de Software", "Estágio em TI", "Junior Python Developer", "Desenvolvedor Backend"],
    "mid": ["Desenvolvedor Python Pleno", "Desenvolvedor Backend Pleno", "Desenvolvedor de Software Pleno", "Engenheiro de Software", "Backend Developer"],
    "senior": ["Desenvolvedor Python Sênior", "Desenvolvedor Backend Sênior", "Senior Python Developer", "Tech Lead Python"],
}
FRONT_ROLES = ["Desenvolvedor Frontend {}", "Desenvolvedor React {}", "Desenvolvedor Web", "Engenheiro de Software"]
CLOUD_ROLES = ["Engenheiro DevOps {}", "Analista Cloud {}", "SRE", "Engenheiro de Infraestrutura"]
OTHER_ROLES = ["Desenvolvedor de Software {}", "Desenvolvedor Backend {}", "Engenheiro de Software"]

WORD = r"[\p{L}\p{N}_]"
GAP = r"[ \t\r\n\f]*"
# White space and separators, [\s\x0B\p{Z}].
SPACE = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean_text(c: Column) -> Column:
    """Text without ligatures, hyphens at line ends and runs of blank lines; bullets are alike."""
    text = F.coalesce(c, F.lit(""))
    for old, new in LIGATURES.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, rf"({WORD}+)-{GAP}\n{GAP}({WORD}+)", "$1$2")
    text = F.regexp_replace(F.regexp_replace(text, BULLETS, "•"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[ \t\r\n\f]+|[ \t\r\n\f]+\z", "")


def is_english(c: Column) -> Column:
    """Whether more of the English marks than of the Portuguese ones occur."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_edged(_tree(ENGLISH + PORTUGUESE))), 0))
    n = lambda words, marks: F.size(F.array_intersect(words, F.array(*[F.lit(m) for m in marks])))
    return let(found, lambda words: n(words, ENGLISH) > n(words, PORTUGUESE))


def _edged(pattern: str) -> str:
    """A pattern between word edges; letters with accents are letters."""
    return rf"(?<!{WORD})(?:{pattern})(?!{WORD})"


def _tree(terms: list[str]) -> str:
    """A pattern of fixed terms, the longest that matches first, in which terms with a common beginning share it: a place in a text fails after few steps."""
    rest: dict[str, list[str]] = {}
    for t in filter(None, terms):
        rest.setdefault(t[0], []).append(t[1:])
    branches = "|".join(re.escape(first) + _tree(more) for first, more in rest.items())
    if not branches:
        return ""
    return f"(?:{branches})?" if "" in terms else f"(?:{branches})" if len(rest) > 1 else branches


def _may(low: Column, words: str) -> Column:
    """Whether a text in lower case holds, of one alternative, all letters that its matches must hold: cheap, and never false where ``words`` match."""
    # a choice of letters is written out, so that a word stays whole
    branches = [b for branch in words.split("|") for b in map("".join, product(*[x[1:-1] if x[0] == "[" else [x] for x in re.findall(r"\[\w+\](?![?*])|\\.|.", branch)]))]
    runs = [re.findall(r"[^\W_]+", re.sub(r"\\.|\[[^]]*\]|\w[?*]", " ", branch)) for branch in branches]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(low, F.lit(r)) for r in branch], F.lit(True)) for branch in runs])


def _names(low: Column, words: str, before: str = "") -> Column:
    """Whether a text in lower case has one of the words between word edges, after ``before``; the pattern, which is slow, is tried only where it may match."""
    return _may(low, words) & F.rlike(low, F.lit(before + _edged(words)))


def _folded(c: Column) -> Column:
    """Lower case, also of the four signs beyond ASCII that (?iu) takes for letters of ASCII."""
    return F.lower(reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), (("ſ", "s"), ("ı", "i"), ("İ", "i"), ("\u212a", "k")), c))


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _lines(c: Column) -> Column:
    """The lines of a text that aren't blank, without space around them."""
    return F.filter(F.transform(F.split(c, r"[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"), _strip), lambda x: x != "")


def _heading(line: Column) -> Column:
    """The section that a short line is the title of, or null."""

    def named(bare: Column) -> Column:
        return F.coalesce(*[F.when(F.rlike(bare, F.lit(rf"^(?:{titles})[:\s]*\z")), name) for name, titles in SECTIONS.items()])

    return F.when(F.length(line) < 50, let(F.btrim(F.lower(line), F.lit(":•-# ")), named))


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``sections``: the lines under each title, and those before the first as header.

    With more than six lines before the first title, the seventh and later ones belong to the summary. Titles cut
    the lines into runs, and a section is its runs one after another, so a document is one row throughout.
    """
    heads = F.filter(F.transform("_lines", lambda x, i: F.struct((i + 1).alias("at"), _heading(x).alias("name"))), lambda h: h["name"].isNotNull())
    run = lambda at, name: F.struct(F.lit(at).alias("at"), F.lit(name).alias("name"))
    first = F.coalesce(F.get("_heads", F.lit(0))["at"], F.size("_lines") + 1)
    # a run begins after the line at ``at``: the first at 0, the overflow of the header at 6
    runs = F.concat(F.array(run(0, "header")), F.when(first > 7, F.array(run(6, "summary"))).otherwise(F.array().cast("array<struct<at:int,name:string>>")), "_heads")
    following = F.transform(
        "_runs",
        lambda r, i: F.struct(
            r["name"].alias("name"), (r["at"] + 1).alias("start"),
            # the overflow has no title of its own, so the run before it ends with the line itself
            (F.coalesce(F.get("_runs", i + 1)["at"] + F.when((i == 0) & (first > 7), 1).otherwise(0), F.size("_lines") + 1) - r["at"] - 1).alias("n"),
        ),
    )

    def under(parts: Column, name: str) -> Column:
        own = F.transform(F.filter(parts, lambda r: r["name"] == name), lambda r: F.slice("_lines", r["start"], r["n"]))
        return F.array_join(F.flatten(own), "\n").alias(name)

    # a struct that is made in plain sight would be made again for each use of a field
    made = let(F.col("_parts"), lambda parts: F.struct(*[under(parts, name) for name in ("header", *SECTIONS)]))

    steps = df.withColumn("_lines", _lines(F.coalesce(text, F.lit("")))).withColumn("_heads", heads).withColumn("_runs", runs).withColumn("_parts", following)
    return steps.withColumn("sections", made).drop("_lines", "_heads", "_runs", "_parts")


def _any_term() -> str:
    """Terms, longest first, with what stands around each kind stated once, so most places in a text fail at once."""
    listed = lambda some: [t for t in SKILLS if (t in SEPARATED) == some]
    first = "".join(sorted({re.escape(t[0]) for t in SEPARATED}))
    return rf"(?=[{first}])(?:^|(?<=[\s,;|(/]))(?:{_tree(listed(True))})(?=[\s,;|)/]|\z)|{_edged(_tree(listed(False)))}"


def _within(term: str) -> list[str]:
    """Skills of all terms that lie in ``term``, its own among them."""
    edge = lambda t: rf"(?:^|[\s,;|(/]){re.escape(t)}(?:[\s,;|)/]|$)" if t in SEPARATED else rf"\b{re.escape(t)}\b"
    return sorted({skill for t, skill in SKILLS.items() if re.search(edge(t), term)})


def catalogue_skills(text: Column) -> Column:
    """Skills whose terms the text holds: one pass finds the longest terms, and those give the shorter ones within."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_any_term()), 0))
    table = F.create_map(*[x for t in SKILLS for x in (F.lit(t), F.array(*map(F.lit, _within(t))))])
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.element_at(table, t))))


def free_skills(section: Column) -> Column:
    """Skills listed in a section of skills: those of the catalogue by its names, others if they hold a capital; of one in several cases the last."""
    line = lambda x: F.when(F.contains(x, F.lit(":")) & (F.length(F.substring_index(x, ":", 1)) < 35), F.regexp_replace(x, r"^[^:]*:", "")).otherwise(x)
    items = F.flatten(F.transform(_lines(section), lambda x: F.split(line(x), r"[,;•|/]")))
    items = F.flatten(F.transform(items, lambda x: F.split(x, r"\s+(?:e|and|&)\s+")))
    items = F.transform(items, lambda x: F.btrim(_strip(x), F.lit("•-*[]()., ")))
    items = F.filter(items, lambda x: F.length(x).between(2, 30) & ~F.rlike(x, F.lit(f"(?iu){_edged(NO_SKILL)}")))
    table = F.create_map(*[F.lit(x) for pair in SKILLS.items() for x in pair])
    named = F.transform(items, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("at"), F.coalesce(F.try_element_at(table, F.lower(x)), F.when(F.rlike(x, F.lit(r"\p{Lu}")), x)).alias("skill")))
    ordered = F.array_sort(F.filter(named, lambda x: x["skill"].isNotNull()))
    again = lambda each: F.transform(each, lambda x, i: F.struct(x["skill"].alias("skill"), (F.get(each, i + 1)["key"] == x["key"]).alias("again")))
    last = F.filter(let(ordered, again), lambda x: ~F.coalesce(x["again"], F.lit(False)))
    return F.array_distinct(F.transform(last, lambda x: x["skill"]))


def ordered_skills(found: Column) -> Column:
    """Skills that come first in their order, then the others by name."""
    first = F.array(*map(F.lit, FIRST_SKILLS))
    ranked = F.transform(F.array_distinct(found), lambda x: F.struct(F.coalesce(F.nullif(F.array_position(first, x), F.lit(0)), F.lit(len(FIRST_SKILLS) + 1)).alias("place"), x.alias("skill")))
    return F.transform(F.array_sort(ranked), lambda x: x["skill"])


def languages(section: Column, text: Column) -> Column:
    """Languages with their levels; the document's own language counts as known if it isn't named."""
    lower = F.lower(F.concat(F.coalesce(section, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    plain = {"Espanhol": "Espanhol (Básico)"}

    def known(low: Column, english: Column) -> Column:
        unnamed = {"Português": F.when(~english, "Português (Nativo)"), "Inglês": F.when(english, "Inglês (Fluente)"), "Espanhol": F.lit(None)}
        found = []
        for language, (names, levels) in LEVELS.items():
            before = "portugu[êe]s" if language == "Português" else f"(?:{names})"
            level = F.lit(plain.get(language, language))
            for shown, words in reversed(levels):
                level = F.when(_names(low, words, rf"{before}[^\n.,;]*"), f"{language} ({shown})").otherwise(level)
            found.append(F.when(_names(low, names), level).otherwise(unnamed[language]))
        return F.array_compact(F.array(*found))

    return let(F.struct(lower.alias("low"), is_english(text).alias("english")), lambda x: known(x["low"], x["english"]))


def experience(s: Column, year: int) -> Column:
    """Struct of years of experience and seniority; ``year`` is the present one. Numbers beyond an int are none."""
    story = F.lower(F.concat_ws("\n", s["header"], s["summary"], s["experience"], s["education"], s["projects"]))

    def told(x: Column) -> Column:
        """What the text says, each found once."""
        text = x["story"]
        said = F.when(F.contains(text, F.lit("experi")), F.regexp_extract_all(text, F.lit(YEARS), 1)).otherwise(F.array().cast("array<string>"))
        dated = F.when(x["experience"] != "", x["experience"]).otherwise(text)
        dates = F.regexp_extract_all(dated, F.lit(rf"2(?<!{WORD}2)0[0-2][0-9](?!{WORD})"), 0)
        return F.struct(
            F.array_compact(F.transform(said, lambda y: y.try_cast("int"))).alias("said"), F.transform(dates, lambda y: y.cast("int")).alias("dates"),
            *[_names(text, words).alias(name) for name, words in (("student", STUDENT), ("senior", SENIOR), ("middle", MIDDLE), ("junior", JUNIOR))],
        )

    def years(x: Column) -> Column:
        dates = x["dates"]
        span = F.least(year - F.array_min(dates), F.array_max(dates) - F.array_min(dates))
        return F.when(F.size(x["said"]) > 0, F.array_max(x["said"])).when((F.size(dates) >= 2) & span.between(0, 30), span).otherwise(0)

    def judged(x: Column) -> Column:
        years, few = x["years"], F.least(x["years"], F.lit(2))
        level = F.when(x["senior"], "senior").when(x["middle"], "mid").when(x["student"] | (years <= 2) | x["junior"], "junior").otherwise("mid")
        held = F.when(x["senior"], F.greatest(years, F.lit(5))).when(x["middle"], F.greatest(years, F.lit(3)))
        held = held.when(level == "junior", F.when((few == 0) & x["student"], 1).otherwise(few)).otherwise(years)
        return F.struct(held.alias("years"), level.alias("seniority"))

    found = let(F.struct(story.alias("story"), s["experience"].alias("experience")), told)
    return let(let(found, lambda x: F.struct(years(x).alias("years"), *[x[n].alias(n) for n in ("student", "senior", "middle", "junior")])), judged)


def _level(seniority: Column) -> Column:
    return F.when(seniority == "junior", SUFFIX["junior"]).when(seniority == "mid", SUFFIX["mid"]).otherwise(SUFFIX["senior"])


def headline(s: Column, text: Column, skills: Column, seniority: Column) -> Column:
    """The line near the name that tells a calling, else the stated aim, else one made of skills and seniority."""
    near = F.filter(F.slice(F.split(s["header"], "\n"), 2, 4), lambda x: ~F.rlike(x, F.lit("[@•/|]")) & (F.length(x) < 70) & F.rlike(x, F.lit(f"(?iu){_edged(CALLING)}")))
    aim = _strip(F.regexp_extract(F.when(s["summary"] != "", s["summary"]).otherwise(F.coalesce(text, F.lit(""))), AIM.replace("(?i)", "(?iu)"), 1))
    has = lambda x: F.array_contains(skills, x)
    made = lambda before, after="": F.concat(F.lit(before), _level(seniority), F.lit(after))
    own = (
        F.when(has("Python") & has("Django"), "Desenvolvedor Backend Python | Django | APIs REST")
        .when(has("Python"), made("Desenvolvedor Python ", " | Backend"))
        .when(has("React") & has("Node.js"), made("Desenvolvedor Full Stack ", " | React & Node.js"))
        .when(has("React"), made("Desenvolvedor Frontend ", " | React"))
        .when(has("Java"), made("Desenvolvedor Java ", " | Spring Boot"))
        .when(F.arrays_overlap(skills, F.array(*map(F.lit, CLOUD_SKILLS))), made("Engenheiro DevOps ", " | Cloud"))
        .otherwise(made("Desenvolvedor de Software "))
    )
    return F.coalesce(F.get(near, F.lit(0)), F.when(F.length(aim).between(6, 64), aim), own)


def roles(head: Column, skills: Column, seniority: Column) -> Column:
    """At most eight roles that suit a headline, skills and seniority, each once."""
    listed = lambda items: F.array(*[F.concat(F.lit(x.split("{}")[0]), _level(seniority)) if "{}" in x else F.lit(x) for x in items])
    says = lambda *words: F.rlike(F.lower(head), F.lit("|".join(words)))
    python = F.when(seniority == "junior", listed(PYTHON_ROLES["junior"])).when(seniority == "mid", listed(PYTHON_ROLES["mid"])).otherwise(listed(PYTHON_ROLES["senior"]))
    kind = (
        F.when(says("python") | F.array_contains(skills, "Python"), python)
        .when(says("front") | F.array_contains(skills, "React"), listed(FRONT_ROLES))
        .when(says("devops", "cloud"), listed(CLOUD_ROLES))
        .otherwise(F.concat(F.array(head), listed(OTHER_ROLES)))
    )
    return F.slice(F.array_distinct(kind), 1, 8)


def summary(section: Column, text: Column, longest: int = 750) -> Column:
    """The summary's section, or the first long paragraph that names no contact, without lines of contacts."""
    told = F.coalesce(section, F.lit(""))
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), _strip)
    contact = lambda x: _may(_folded(x), CONTACT_WORDS) & F.rlike(x, F.lit(f"(?iu){_edged(CONTACT_WORDS)}"))
    plain = F.filter(blocks, lambda x: (F.length(x) >= 60) & ~F.contains(x, F.lit("@")) & ~contact(x))
    raw = F.when(F.length(_strip(told)) < 30, F.coalesce(F.get(plain, F.lit(0)), told)).otherwise(told)
    # what a contact begins with is a quicker test than an edge
    kept = F.filter(_lines(raw), lambda x: ~F.contains(x, F.lit("@")) & ~F.rlike(x, F.lit(rf"(?i)(?=[hlg+\d])\b(?:{CONTACTS})\b")) & (F.length(x) >= 3))
    # a single blank stays as it is
    return F.substring(_strip(F.regexp_replace(F.array_join(kept, " "), r"[\s\x0B\p{Z}]{2,}|[\s\x0B\p{Z}&&[^ ]]", " ")), 1, longest)


def profiles(df: DataFrame, year: int, text: str = "text") -> DataFrame:
    """``df`` with headline, summary, years_experience, seniority, skills, roles and languages of each text; ``sections`` too."""
    t, s = F.col(text), F.col("sections")
    rows = sections(df, text).withColumn("skills", ordered_skills(F.concat(catalogue_skills(t), free_skills(s["skills"]))))
    rows = rows.withColumn("_experience", experience(s, year))
    rows = rows.withColumns({"years_experience": F.col("_experience.years"), "seniority": F.col("_experience.seniority"), "languages": languages(s["languages"], t), "summary": summary(s["summary"], t)})
    rows = rows.withColumn("headline", headline(s, t, F.col("skills"), F.col("seniority")))
    return rows.withColumn("roles", roles(F.col("headline"), F.col("skills"), F.col("seniority"))).drop("_experience")


def merged(own: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Profiles of ``own`` with those of ``external``: its values win unless null or empty, skills are added to the own ones, roles precede them."""
    other = external.select(key, *[F.col(c).alias(f"_{c}") for c in external.columns if c != key])
    rows = own.join(other, key, "left")
    filled = {c: F.coalesce(F.when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}")), F.col(c)) for c in ("headline", "summary", "years_experience", "seniority")}
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    skills, found = F.array_distinct(F.concat("skills", none("_skills"))), F.array_distinct(F.concat(none("_roles"), "roles"))
    filled |= {
        "skills": F.when(F.size(none("_skills")) > 0, skills).otherwise(F.col("skills")),
        "roles": F.when(F.size(none("_roles")) > 0, found).otherwise(F.col("roles")),
        "languages": F.when(F.size(none("_languages")) > 0, F.col("_languages")).otherwise(F.col("languages")),
    }
    return rows.select(key, *[c.alias(n) for n, c in filled.items()])


# Uploads that are let in, and the largest one.
EXTENSIONS = [".pdf", ".docx", ".doc", ".txt", ".rtf", ".md"]
TYPES = [
    "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword", "text/plain", "text/markdown",
    "text/x-markdown", "application/rtf", "text/rtf", "text/x-python", "application/octet-stream",
]
LARGEST = 10 * 1024 * 1024
# Groups and control words of RTF.
RTF_GROUP = r"\{\*?\\[^{}]+(?:\{[^{}]*\})*\}"
RTF_WORD = r"\\[a-zA-Z]+-?[0-9]* ?"


def refusal(filename: Column, content_type: Column, length: Column, largest: int = LARGEST) -> Column:
    """Why an upload is refused, or null: it is empty (as is one of unknown length), too large, or of another kind; the type counts only without an extension."""
    extension = F.regexp_extract(F.lower(F.coalesce(filename, F.lit(""))), r"[^./][^/]*(\.[^./]*)\z", 1)
    return (
        F.when(F.coalesce(length, F.lit(0)) == 0, "empty")
        .when(length > largest, "too_large")
        .when((extension != "") & ~extension.isin(EXTENSIONS), "extension")
        .when((extension == "") & ~F.coalesce(content_type, F.lit("")).isin(TYPES), "type")
    )


def rtf_text(c: Column) -> Column:
    """The words of an RTF source, a space between them."""
    text = F.regexp_replace(F.regexp_replace(c, RTF_GROUP, ""), RTF_WORD, " ")
    for mark in ("\\", "{", "}"):
        text = F.replace(text, F.lit("\\" + mark), F.lit(mark))
    return _strip(F.regexp_replace(F.regexp_replace(text, "[{}]", ""), r"[\s\x0B\p{Z}]+", " "))


def read_files(files: DataFrame) -> DataFrame:
    """(path, text, status) of files with path and content, as Spark's binaryFile reader gives them.

    Extensions tell the kind, else leading bytes. Text is UTF-8, or Latin-1 where it isn't valid. Status is read, empty
    (null content too), or unsupported for kinds that need a codec (PDF and DOCX), whose text is null.
    """
    content = F.coalesce("content", F.lit("").cast("binary"))
    extension = F.regexp_extract(F.lower(F.coalesce("path", F.lit(""))), r"[^./][^/]*(\.[^./]*)\z", 1)
    head = F.hex(F.substring(content, 1, 5))
    kind = (
        F.when(extension == ".rtf", "rtf").when(extension.isin(".txt", ".md", ".text"), "text").when(extension.isin(".pdf", ".docx"), "codec")
        .when(head.startswith("25504446") | head.startswith("504B0304"), "codec").when(head == "7B5C727466", "rtf").otherwise("text")
    )
    valid = F.try_validate_utf8(content.cast("string"))
    text = F.when(kind == "rtf", rtf_text(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))))
    text = text.when(kind == "text", clean_text(_strip(F.coalesce(valid, F.decode(content, "ISO-8859-1")))))
    rows = files.select("path", text.alias("text"))
    return rows.withColumn("status", F.when(F.col("text").isNull(), "unsupported").when(F.col("text") == "", "empty").otherwise("read"))
