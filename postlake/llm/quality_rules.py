"""Quality rules: a table of thresholds compiled into one Spark projection.

The rules and all that they read are built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import SPACE, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in a is it for on as was by this are at or an from not "
    "le la les de des du et en un une que qui dans pour pas sur est au avec par "
    "der die das und ein eine zu von mit ist den im nicht auf für sich als dem auch "
    "el los las del y por con para se su al lo como más no es"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` is a SQL expression over the measured columns; outside [least, most] the rule fails."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Shares are of the text's words unless the name says otherwise; a measure of null passes.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 3, 10),
    Rule("symbols_to_words", "n_symbols / n_words", None, 0.1),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", None, 0.4),
    Rule("exclamation_word_share", "n_exclaimed / n_words", None, 0.1),
    Rule("stop_word_share", "if(n_words >= 30, n_stop / n_words, null)", 0.06, None),
    Rule("bullet_line_share", "n_bullets / n_lines", None, 0.9),
    Rule("ellipsis_line_share", "n_ellipsis / n_lines", None, 0.3),
    Rule("words_over_1000_characters", "n_long_words", None, 0),
)


def with_repeats(df: DataFrame, words: str) -> DataFrame:
    """Add ``n_repeat_words``: words in a window of five words found twice or more in the same text.

    Windows are compared by a 64-bit hash, and sorted only where hashes repeat; each
    repeated window, in order of place, adds the words that the one before it doesn't cover.
    """
    c = F.col(words)
    hashes = F.when(F.size(c) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(c) - WINDOW + 1), lambda i: F.xxhash64(F.slice(c, i, WINDOW))))
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    h = lambda i: F.get("_placed", i)["h"]
    twice = F.filter("_placed", lambda x, i: (h(i - 1) == x["h"]) | (h(i + 1) == x["h"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_at", start, lambda s, at: F.struct(at.alias("last"), (s["n"] + F.least(F.lit(WINDOW), at - s["last"])).alias("n")), lambda s: s["n"])
    return (
        df.withColumn("_hashes", hashes)
        .withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed))
        .withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["at"])))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_hashes", "_placed", "_at")
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each whole text; null and blank texts have no word and measures of 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.select("doc_id", text.alias("_text"), words(F.col("text")).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_in = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    edge, end = r"(?<![^\x20\x09-\x0D])", r"(?![^\x20\x09-\x0D])"
    return with_repeats(with_words, "_words").withColumn("_lines", lines).select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        n_in(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("_lines").alias("n_lines"),
        n_in("!!" + end).alias("n_exclaimed"),
        F.size(F.filter("_words", lambda x: x.isin(*STOP_WORDS))).alias("n_stop"),
        n_in(r"(?m)^[\x20\x09]*[-*•]").alias("n_bullets"),
        n_in(r"(?m)(\.\.\.|…)[\x20\x09]*$").alias("n_ellipsis"),
        n_in(edge + r"[^\x20\x09-\x0D]{1001,}").alias("n_long_words"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that fail, as an array: one expression for the whole table."""
    failed = []
    for r in rules:
        m = F.expr(r.measure)
        bounds = [m < r.least] * (r.least is not None) + [m > r.most] * (r.most is not None)
        bad = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
        failed.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*failed))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, failed_rules and kept for every row.

    The base fails texts of fewer than 10 words and those with more than a fifth
    of their words in repeated windows; ``kept`` needs the base and all rules. Null and blank texts have no
    words and fail the base; null ids stay null; repeated rows get the same verdict each; an empty table
    gives no row. Columns besides doc_id and text are not read.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        measured(docs)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", F.when(~F.col("base_failed"), verdict(rules)).otherwise(F.array().cast("array<string>")))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )
