"""Column functions over what feeds say: levels, kinds of employment, dates, ids and search terms."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.functions.text import any_of

# Substrings that name a level, per kind of feed, in the order in which they are tried.
FEED_LEVELS = {
    "global": [("senior", ["principal", "staff", "lead", "architect", "head of"]), ("senior", ["senior", "sr", "sênior"]), ("junior", ["junior", "jr", "júnior", "trainee", "entry", "intern"])],
    "latin": [("senior", ["principal", "staff", "lead", "arquitecto", "architect"]), ("senior", ["senior", "sr", "sênior", "avanzado"]), ("junior", ["junior", "jr", "júnior", "trainee", "entry", "inicial"])],
    "remote": [("senior", ["principal", "staff", "lead"]), ("senior", ["senior", "sr ", "sênior"]), ("junior", ["junior", "jr ", "júnior", "entry"])],
}
DECLARED = [("senior", ["senior", "lead", "staff", "principal"]), ("junior", ["junior", "entry", "intern"])]

# Employment types and work modes by substring, in order, and what is left.
EMPLOYMENT_TYPES = [("estagio", ["estag", "intern"]), ("trainee", ["trainee"]), ("jovem_aprendiz", ["aprendiz", "apprentice"]), ("pj_contrato", ["pj", "contract"])]
WORK_MODES = [("remote", ["remot"]), ("hybrid", ["hibrid", "hybrid"])]

# Search terms and how they are written with accents.
ACCENTED = {"estagio": "estágio", "junior": "júnior", "senior": "sênior", "tecnico": "técnico", "analise": "análise", "programacao": "programação"}


def first_named(c: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The first value of a table whose words occur in the text; else null."""
    return F.coalesce(*[F.when(any_of(c, words), F.lit(value)) for value, words in table])


def infer_seniority_feed(text: Column, declared: Column | None = None, feed: str = "global") -> Column:
    """Level by substrings: the declared one first, then the text's, else mid."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    named = [first_named(low(declared), DECLARED)] if declared is not None else []
    return F.coalesce(*named, first_named(low(text), FEED_LEVELS[feed]), F.lit("mid"))


def map_employment_type(c: Column) -> Column:
    return F.coalesce(first_named(F.lower(F.coalesce(c, F.lit(""))), EMPLOYMENT_TYPES), F.lit("clt"))


def map_work_mode(c: Column, is_remote: Column | None = None) -> Column:
    named = first_named(F.lower(F.coalesce(c, F.lit(""))), WORK_MODES)
    flag = [F.when(is_remote, F.lit("remote"))] if is_remote is not None else []
    return F.coalesce(*flag, named, F.lit("onsite"))


def to_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def parse_posted_at(c: Column, kind: str = "iso") -> Column:
    """struct(published_at, date_status) of ISO-8601, RFC-2822 or epoch text; what can't be read is null, `unknown_date`."""
    read = {
        "iso": lambda: F.trim(c).try_cast("timestamp"),
        "rfc2822": lambda: F.try_to_timestamp(F.regexp_replace(F.trim(c), "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        "epoch": lambda: F.timestamp_seconds(F.trim(c).try_cast("long")),
    }[kind]()
    return F.struct(read.alias("published_at"), F.when(read.isNull(), "unknown_date").otherwise("verified").alias("date_status"))


def external_id_from_url(c: Column, pattern: str = r"/v(\d+)", prefix: str = "") -> Column:
    """The id that a pattern finds in the address, prefixed; without one, the address."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1)
    return F.when(found != "", F.concat(F.lit(prefix), found)).otherwise(F.coalesce(c, F.lit("")))


def search_variants(term: str) -> list[str]:
    """LIKE patterns of a term: as it is, without accents, with wildcards for vowel pairs, and with usual accents."""
    plain = term.strip()
    bare = unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode()
    pairs = ((r"ao\b", "_o"), ("ai", "a_"), (r"io\b", "_o"), ("ea", "_a"))
    loose = reduce(lambda s, p: re.sub(p[0], p[1], s, flags=re.IGNORECASE), pairs, bare)
    low, found = plain.lower(), {plain, bare, loose}
    for without, marked in ACCENTED.items():
        found |= {re.sub(rf"\b{a}\b", b, low) for a, b in ((without, marked), (marked, without)) if a in low}
    return sorted(f"%{v}%" for v in found if v)


def search_predicate(term: str, columns: list[str]) -> Column:
    """Whether one of the columns matches a variant of the term; an empty term matches all."""
    tests = [F.ilike(F.coalesce(F.col(c), F.lit("")), F.lit(v)) for c in columns for v in search_variants(term)]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)
