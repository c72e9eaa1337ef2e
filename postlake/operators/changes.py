"""Field-level changes between two versions of postings, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRITICAL = ["salary_update", "status_update", "work_mode_update"]


def _change(when: Column, name: str, old: Column, new: Column, kind: str) -> Column:
    return F.when(
        when,
        F.struct(F.lit(name).alias("field_name"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), F.lit(kind).alias("change_type")),
    )


def money(c: Column) -> Column:
    """A double without exponent and with one decimal place at least."""
    return F.regexp_replace(F.format_string("%.6f", c), r"(\.\d+?)0+$", "$1")


def changelog(pairs: DataFrame) -> DataFrame:
    """Rows of changes of ``pairs``, which has structs old and new, and posting_seq: one scan, up to seven rows a pair."""
    o, n = (lambda x: F.col(f"old.{x}")), (lambda x: F.col(f"new.{x}"))
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    differ = lambda f, x: (f(o(x)) != "") & (f(n(x)) != "") & (f(o(x)) != f(n(x)))
    gap = F.abs(F.length(text(n("description"))) - F.length(text(o("description"))))
    size = lambda label, c: F.concat(F.lit(f"{label}: "), F.length(text(c)).cast("string"), F.lit(" caracteres"))
    rows = [_change(~o(x).eqNullSafe(n(x)), x, F.when(o(x).isNotNull(), money(o(x))), F.when(n(x).isNotNull(), money(n(x))), "salary_update") for x in ("salary_min", "salary_max")]
    rows += [
        _change(differ(low, "work_mode"), "work_mode", low(o("work_mode")), low(n("work_mode")), "work_mode_update"),
        _change(differ(low, "location"), "location", o("location"), n("location"), "location_update"),
        _change(o("status") != n("status"), "status", o("status"), n("status"), "status_update"),
        _change(
            differ(text, "description") & ((gap > 80) | (gap / F.greatest(F.length(text(o("description"))), F.lit(1)) > 0.2)),
            "description", size("Tamanho anterior", o("description")), size("Novo tamanho", n("description")), "description_update",
        ),
        _change(o("published_at") != n("published_at"), "published_at", o("published_at"), n("published_at"), "date_update"),
    ]
    return pairs.select("posting_seq", F.inline(F.array_compact(F.array(*rows))))


def critical(changes: DataFrame) -> DataFrame:
    return changes.groupBy("posting_seq").agg(F.bool_or(F.col("change_type").isin(CRITICAL)).alias("is_critical"), F.count(F.lit(1)).alias("n_changes"))
