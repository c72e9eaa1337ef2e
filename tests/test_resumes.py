"""Résumés against rules written out per term and on texts of few lines."""

import re

from pyspark.sql import functions as F

from postlake.operators import resumes as X


def test_terms_equal_a_search_one_by_one(spark):
    """All pairs of neighbouring terms, under several separators, against one search per term."""
    terms = list(X.SKILLS)
    texts = [f"{a}{gap}{b}" for a, b in zip(terms, terms[1:] + terms[:1], strict=True) for gap in (" ", ", ", "/", "-", "x", ". ")]
    texts += ["tailwind css3", "12-factor apps", "(c++)", "c+++", "goé", "ágit", "react.js.net", "", "C# C++ C", "a/c++/b"]

    def one(text):
        found = set()
        for t, skill in X.SKILLS.items():
            edge = (r"(?:^|[\s,;|\(/])", r"(?:[\s,;|\)/]|$)") if t in X.SEPARATED else (r"\b", r"\b")
            if re.search(edge[0] + re.escape(t) + edge[1], text.lower()):
                found.add(skill)
        return sorted(found)

    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", X.catalogue_skills(F.col("text")).alias("s")).collect()
    assert [(r.text, sorted(r.s)) for r in rows] == [(x, one(x)) for x in texts]


def test_sections_of_short_texts(spark):
    nine = "\n".join(f"l{k}" for k in range(1, 9))
    texts = [None, "", " \r\n ", "Skills", "a\nSkills:\nb\nc\nResumo\nd\nSKILLS\ne", nine, nine + "\nIdiomas\nx", "x" * 60 + "\nSkills " + "y" * 60]
    rows = X.sections(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").select("sections.*").collect()
    got = [{k: v for k, v in r.asDict().items() if v} for r in rows]
    assert got[:4] == [{}, {}, {}, {}]
    assert got[4] == {"header": "a", "skills": "b\nc\ne", "summary": "d"}
    assert got[5] == {"header": "l1\nl2\nl3\nl4\nl5\nl6", "summary": "l7\nl8"}
    assert got[6] == got[5] | {"languages": "x"}
    assert set(got[7]) == {"header"}


def test_profile(spark):
    text = "Ana\nDesenvolvedora Python Júnior\neu@x.example\nExperiência\nEstágio 2022 - 2023\nSkills\nDjango, Figma e figma\nIdiomas\nInglês: avançado"
    r = X.profiles(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), 2024).orderBy("id").collect()
    assert (r[0].headline, r[0].years_experience, r[0].seniority) == ("Desenvolvedora Python Júnior", 1, "junior")
    assert r[0].skills == ["Python", "Django", "Figma"] and r[0].languages == ["Português (Nativo)", "Inglês (Avançado)"]
    assert r[0].roles[0] == "Desenvolvedor Python Júnior" and len(r[0].roles) == 7
    assert (r[1].years_experience, r[1].seniority, r[1].skills, r[1].summary) == (0, "junior", [], "")
    none = X.profiles(spark.createDataFrame([], "id int, text string"), 2024)
    assert none.count() == 0


def test_files_and_uploads(spark):
    files = [("a.TXT", "olá".encode()), ("b", "olá".encode("latin-1")), ("c.rtf", rb"{\rtf1 x}"), ("d", rb"{\rtf y \b z"), ("e", b"PK\x03\x04"), ("f.md", None), (None, b" \n ")]
    got = {r.path: (r.text, r.status) for r in X.read_files(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {
        "a.TXT": ("olá", "read"), "b": ("olá", "read"), "c.rtf": ("", "empty"), "d": ("y z", "read"), "e": (None, "unsupported"), "f.md": ("", "empty"), None: ("", "empty"),
    }
    uploads = [("a.pdf", "", 1), ("a.exe", "text/plain", 1), (None, "text/plain", 1), ("", None, 1), (".txt", "x", 1), ("a.md", "", 0), ("a.md", "", None), ("a.md", "", 10 * 2**20 + 1)]
    rows = spark.createDataFrame(uploads, "f string, t string, n long").select(X.refusal(F.col("f"), F.col("t"), F.col("n")).alias("r")).collect()
    assert [r.r for r in rows] == [None, "extension", None, "type", "type", "empty", "empty", "too_large"]


def test_quick_tests_lose_nothing(spark):
    """Patterns behind a test of their letters find what they find alone, and a tree of terms what a list of them finds."""
    texts = ["", "sênior", "senior.", "xsênior", "sr", "sr.", "tech  lead", "leads", "est\u00e1gio em 2020", "estagiária", "previsão de\tformatura", "mid-level", "pl", "pl.x", "entry-level", "inglês: avançado, b2", "english c1", "WhatsApp", "linKedIn", "anos 3", "full stack"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    low = F.lower("text")
    for words in (X.STUDENT, X.SENIOR, X.MIDDLE, X.JUNIOR, X.CONTACT_WORDS, X.CALLING, X.NO_SKILL, *[w for _, levels in X.LEVELS.values() for _, w in levels], *[n for n, _ in X.LEVELS.values()]):
        plain = F.rlike(low, F.lit(X._edged(words)))
        assert rows.where(X._names(low, words) != plain).count() == 0, words
    odd = spark.createDataFrame([("lin\u212aed\u0131n",), ("GitHub",), ("celular",), ("what\u017fapp",), ("linke",)], "text string")
    assert odd.where(F.rlike("text", F.lit(f"(?iu){X._edged(X.CONTACT_WORDS)}")) & ~X._may(X._folded(F.col("text")), X.CONTACT_WORDS)).count() == 0
    assert re.fullmatch(X._tree(["go", "golang", "c", "spring", "spring boot"]), "spring boot") and not re.fullmatch(X._tree(["go", "golang"]), "gola")


def test_a_text_is_cut_into_sections_once(spark):
    """A profile uses its sections often; each of the seven is put together in one place of the plan."""
    found = X.profiles(spark.createDataFrame([(1, "a")], "id int, text string"), 2024)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join(flatten(") == 7


def test_a_section_of_many_skills(spark):
    items = ", ".join(f"Skill{k}" for k in range(3000)) + ", SKILL7"
    found = spark.createDataFrame([(items,)], "text string").select(X.free_skills(F.col("text")).alias("s"))
    assert len(found.first().s) == 3000 and "SKILL7" in found.first().s
    # a list that names itself for each of its items is made again for each
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 1
