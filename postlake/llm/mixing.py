"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are laid out in a shuffled order as one stream of
words, read at most twice. The schedule is a row of slots of equal numbers of
words; the golden-ratio point of a slot falls into one source's share of the
weights. The r-th slot of a source takes the r-th block of its stream, so the slots
are the order of the mix, any stretch of which has the sources in about their shares.
Everything here is DataFrame and SQL operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import WORD, id_and, stored

#: Tables of sources up to this many rows are broadcast (about 100 bytes a row); larger ones are shuffled.
BROADCAST_SOURCES = 10_000
#: Words in a slot.
BLOCK = 1024
#: Slots that are numbered together.
CHUNK = 65_536
#: Documents that are laid out together, about.
PART_ROWS = 50_000
GOLDEN = 0.6180339887498949


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the shuffle key and the text's digest of each document."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
        _digest().alias("digest"),
    )


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target of each source.

    Sources by code point, null last, weigh ``weights``, repeating, and share
    ``share`` times all words. A target stops at ``most`` times the source's
    size; the excess is shared again by weight. With sources in the order of
    most * size / weight, those before the first one whose level suffices are the
    capped ones, so no iteration is needed. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    by_level = Window.orderBy("_level", "sid")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    table = (
        per.withColumn("sid", n.cast("int"))
        .withColumn("weight", weight)
        .withColumn("_cap", F.lit(most) * F.col("source_size"))
        .withColumn("_level", F.col("_cap") / F.col("weight"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_water", (F.lit(share) * F.sum("source_size").over(whole) - F.col("_capped")) / F.col("_rest"))
        .withColumn("_fits", F.when(F.col("_water") <= F.col("_level"), F.col("_water")))
    )
    first = F.first("_fits", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = F.coalesce(first, F.col("_level"))
    return table.withColumn("target", F.least(F.col("_cap"), level * F.col("weight"))).select("sid", "source", "source_size", "weight", "target")


def laid_out(sizes: DataFrame, rows: int) -> DataFrame:
    """Give each of ``rows`` documents its ``begin`` in the shuffled stream of its source.

    Documents of a source are dealt by the first digits of their shuffle key, as many digits as make parts of about PART_ROWS
    rows if all were of one source; a part begins where the parts with smaller digits end.
    """
    digits = max(3, math.ceil(math.log(max(1, rows / PART_ROWS), 16)))
    cut = sizes.withColumn("part", F.substring("key", 1, digits))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("sid", "part").agg(F.sum("size").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("sid", "part").orderBy("key", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(parts, ["sid", "part"]).withColumn("begin", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("part", "_start", "key")


def schedule(spark, sources: DataFrame, n_sources: int, slots: int, block: int) -> DataFrame:
    """Slots of the mix: slot, sid, rank (of the slot within its source, from 0).

    The point of slot j is the fraction of j times the golden ratio; the source
    is the one whose part of the cumulative targets holds it. A source whose slots
    fall short of its target (by a few, as the points are of low discrepancy) gets
    the missing ones, by turns, after the others. Slots beyond the target are left out.
    """
    whole = Window.orderBy("sid")
    shares = sources.where("target > 0").select(
        "sid",
        F.ceil(F.col("target") / block).alias("need"),
        (F.sum("target").over(whole) / F.sum("target").over(Window.partitionBy())).alias("_to"),
        ((F.sum("target").over(whole) - F.col("target")) / F.sum("target").over(Window.partitionBy())).alias("_from"),
    )
    point = F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(1.0))
    # a point's cell of the unit interval names the few sources that may hold it
    cells = max(64, 2 * n_sources)
    cell = F.least(F.floor(point * cells), F.lit(cells - 1))
    within = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_from") * cells), F.least(F.floor(F.col("_to") * cells), F.lit(cells - 1)))))
    drawn = (
        spark.range(slots)
        .withColumnRenamed("id", "slot")
        .withColumn("point", point)
        .withColumn("cell", cell)
        .join(_small(within, n_sources), "cell")
        .where((F.col("point") >= F.col("_from")) & (F.col("point") < F.col("_to")))
        .select("slot", "sid", "need", F.expr(f"slot div {CHUNK}").alias("chunk"))
    )
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1 + F.col("_start")
    placed = drawn.join(starts, ["sid", "chunk"]).withColumn("rank", rank).where("rank < need").select("slot", "sid", "rank")
    got = counts.groupBy("sid").agg(F.sum("_n").alias("_got"))
    missing = (
        shares.join(got, "sid", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .where("_got < need")
        .select("sid", "_got", F.explode(F.sequence(F.col("_got"), F.col("need") - 1)).alias("rank"))
        .select((F.lit(slots) + (F.col("rank") - F.col("_got")) * n_sources + F.col("sid")).alias("slot"), "sid", "rank")
    )
    return placed.unionByName(missing)


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK,
) -> DataFrame:
    """How many words of each document the mix takes, and when.

    Returns doc_id, source, size, source_size, target, taken, first_slot (the first slot that takes any of it, else null),
    slots (the first one of each pass) and digest (of the text) for every row.
    ``most`` is a whole number of passes over a source; taken is at most
    ``most`` times size. The words taken of a source are its target, rounded down.
    Null texts and blank ones have size 0; null sources are one source. Equal rows
    are laid out one after the other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sizes = stored(sized(docs), "mix-sizes")
    sources = stored(targets(sizes, weights, share, most), "mix-sources")
    n_sources = sources.count()
    n_slots = int(sources.agg(F.ceil(F.round(F.sum("target"), 3) / block)).first()[0] or 0)
    named = sizes.join(
        _small(sources.withColumnRenamed("source", "_source"), n_sources),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source", "weight")
    lay = stored(laid_out(named, sizes.count()), "mix-layout")
    slots = schedule(spark, sources, n_sources, n_slots, block)

    passes = range(int(most))
    goal = F.floor("target")
    spans = (
        lay.where("size > 0")
        .withColumn("pass", F.explode(F.array(*map(F.lit, passes))))
        .withColumn("from", F.col("begin") + F.col("pass") * F.col("source_size"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), goal))
        .where(F.col("from") < F.col("to"))
        .withColumn("rank", F.explode(F.sequence(F.expr(f"from div {block}"), F.expr(f"(to - 1) div {block}"))))
        .select("sid", "rank", "begin", "pass", "from", "to")
    )
    low, high = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    firsts = [F.min(F.when(F.col("pass") == p, F.col("slot"))) for p in passes]
    taken = spans.join(slots, ["sid", "rank"]).groupBy("sid", "begin").agg(F.sum(high - low).alias("taken"), F.min("slot").alias("first_slot"), F.array(*firsts).alias("slots"))
    # blank documents share a begin with their neighbour, so they stay out of this join
    full = lay.where("size > 0").join(taken, ["sid", "begin"], "left")
    cols: list[str | Column] = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "slots", "digest"]
    blank = lay.where("size = 0").withColumns({"taken": F.lit(0), "first_slot": F.lit(None).cast("long"), "slots": F.lit(None).cast("array<long>")})
    return full.select(*cols).unionByName(blank.select(*cols))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, in the order of the schedule's slots, with the columns of ``docs``.

    A document comes once for each whole time that the mix takes it, a part of half
    or more of its words counting as a whole, each time at the first slot of that pass; others are
    left out. Blank documents are never taken. Rows equal in id, source and text share their words evenly.
    """
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    name = F.concat_ws(":", id_and(F.col("doc_id"), F.col("digest")), source)
    copies = (
        mix(docs, **options)
        .groupBy(name.alias("name"))
        .agg(
            (F.sum("taken") / (F.count(F.lit(1)) * F.greatest(F.max("size"), F.lit(1)))).alias("times"),
            F.min_by("slots", "first_slot").alias("slots"),
        )
        .select("name", "slots", F.explode(F.sequence(F.lit(0), F.floor(F.col("times") + 0.5).cast("int"))).alias("copy"))
        .where("copy > 0")
        .select("name", "copy", F.coalesce(F.get("slots", F.col("copy") - 1), F.array_max("slots")).alias("slot"))
    )
    own = F.concat_ws(":", id_and(F.col("doc_id"), _digest()), source)
    rows = docs.select(F.struct("*").alias("row"), own.alias("name")).join(copies, "name")
    return rows.repartitionByRange("slot", "name").sortWithinPartitions("slot", "name", "copy").select("row.*")
