"""What runs tell: collected payloads, funnels of outcomes, staged postings, messages and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.functions import text

OUTCOMES = ["ghost", "dup_in_batch", "dup_history", "invalid", "new"]


def collected(bronze: DataFrame) -> DataFrame:
    """Per source: payloads, those that can be read and those that can't; a broken one fails no run."""
    good = F.try_parse_json(F.col("payload")).isNotNull()
    return bronze.groupBy("source").agg(F.count(F.lit(1)).alias("payloads"), F.count_if(good).alias("found"), F.count_if(~good).alias("rejected"))


def to_posting(rows: DataFrame) -> DataFrame:
    """Staged postings: an empty level is inferred, and dates, area and currency have defaults."""
    level = F.when(F.coalesce("seniority", F.lit("")) != "", F.col("seniority")).otherwise(text.infer_seniority(F.col("title"), F.col("description")))
    status = F.when(F.col("published_at").isNull(), "unknown_date").otherwise("verified")
    return rows.withColumns({"seniority": level, "date_status": status, "area": F.lit("Tecnologia"), "currency": F.lit("BRL")})


def funnel(run: DataFrame) -> DataFrame:
    """(outcome, n): postings per outcome, from a run's rows; those judged for several profiles count once an outcome."""
    return run.where(F.col("outcome").isin(OUTCOMES)).groupBy("outcome").agg(F.count_distinct("posting_seq").alias("n"))


def rendered(rows: DataFrame) -> DataFrame:
    """Add the message of a scored posting and its score's band."""
    message = F.concat(F.upper("title"), F.lit(" - "), F.col("company"), F.lit(" ("), F.col("score").cast("string"), F.lit("/100)"))
    return rows.withColumns({"message": message, "band": F.when(F.col("score") >= 85, "high").when(F.col("score") >= 70, "middle").otherwise("low")})


def reasons(rows: DataFrame) -> DataFrame:
    """Add up to six reasons: four skills that the posting names, remote work, and the verdict on the level."""
    blob = F.lower(F.concat_ws(" ", "title", "description", F.array_join("requirements", " ")))
    skills = F.array_sort(F.array_distinct(F.filter(F.transform("skills", F.lower), lambda s: (s != "") & F.contains(blob, s))))
    hits = F.transform(F.slice(skills, 1, 4), lambda s: F.concat(s, F.lit(" é um match forte")))
    first = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("Perfil geral compatível com a descrição")))
    remote = F.when(F.lower("work_mode").isin("remote", "remoto", "remot"), "Trabalho remoto compatível com preferência")
    level = F.when(F.col("seniority_score") >= 80, "Senioridade compatível").otherwise("Gap de senioridade: verificar requisitos")
    return rows.withColumn("reasons", F.slice(F.concat(first, F.array_compact(F.array(remote, level))), 1, 6))
