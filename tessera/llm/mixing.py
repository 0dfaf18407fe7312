"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_hot_key, cut, running_totals

#: The golden ratio's fraction in units of 2**-42, and that fraction of 2**20 steps, so that points stay exact for 2**40 slots.
UNIT = 1 << 42
GOLDEN = 2718142227965
GOLDEN_20 = (GOLDEN << 20) % UNIT
#: A source has so many blocks at least, if it has as many words: a slot more or less is then no great part of it.
LEAST_BLOCKS = 64


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size) with `target`: `share` of all words, split by weight, none above `most` times its
    source's words, the excess split again by weight until none is above; and `sid`, the source's number.

    Sources in code-point order, null last, take the weights in turn. That splitting ends at the level x where the sum of
    least(most * size, x * weight) is the whole: sources by their most * size / weight, the first so many stop at their
    most. Both orders are range partitions with running totals, so that sources may be as many as documents.
    """
    s = running_totals(sources, [F.col("source").isNull(), F.col("source").cast("binary")], "source_size").drop("before").withColumnRenamed("nth", "sid")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    s = cut(s.withColumn("weight", w.cast("long")))
    words, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    whole = min(share, most) * words
    ratio = most * F.col("source_size") / F.col("weight")
    s = running_totals(s, [ratio, F.col("sid")], ["source_size", "weight"])
    # the level if this and all later sources stay open; it falls from source to source, and the first whose own ratio reaches it sets it
    s = cut(s.withColumn("level", (whole - most * F.col("before_source_size")) / (F.lit(weight) - F.col("before_weight"))))
    level = s.agg(F.max(F.when(ratio >= F.col("level"), F.col("level")))).first()[0]
    target = most * F.col("source_size") if level is None else F.least(most * F.col("source_size"), F.lit(float(level)) * F.col("weight"))
    return s.select("source", "source_size", "sid", "weight", target.cast("double").alias("target"))


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """Slots (sid, nth) of sources (sid, slots, before: running total of slots), nth from 0 to slots - 1, with the place `at` of each in the mix.

    Slot k has the point frac(k * golden ratio), which the cumulative shares of slots map to a source; its rank among the source's slots is nth.
    The points give a source its slots to within a few: what is over is left out, what is missing follows at the end.
    """
    spark = sources.sparkSession
    k = F.col("id")
    point = F.pmod(F.shiftright(k, 20) * GOLDEN_20 + k.bitwiseAND((1 << 20) - 1) * GOLDEN, F.lit(UNIT))
    n_sources = sources.count()
    cells = 4 * n_sources + 64
    # a source is found by the cell of its point: one equal part of the line of all shares, each with the sources that reach into it
    place = lambda x: F.floor(x / n_slots * cells).cast("long")
    spans = sources.where("slots > 0").withColumn("cell", F.explode(F.sequence(place(F.col("before")), place(F.col("before") + F.col("slots")))))
    spans = spans.select("cell", "sid", F.col("before").alias("lo"), (F.col("before") + F.col("slots")).alias("hi"))
    slots = spark.range(n_slots).withColumn("x", point / UNIT * n_slots).withColumn("cell", place(F.col("x")))
    joined = slots.join(F.broadcast(spans) if n_sources + cells <= BROADCAST_ROWS else spans.hint("shuffle_merge"), "cell").where("x >= lo and x < hi")
    ranked = _rank_in_source(joined.select("id", "sid"))
    kept = cut(ranked.join(_small(sources.select("sid", "slots"), n_sources), "sid").where("nth < slots").select("sid", "nth", F.col("id").alias("at")))
    had = sources.where("slots > 0").select("sid", "slots").join(_small(kept.groupBy("sid").agg(F.count(F.lit(1)).alias("had")), n_sources), "sid", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    missed = had.where("had < slots").select("sid", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("nth"), F.lit(n_slots).cast("long").alias("at"))
    return kept.unionByName(missed)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("shuffle_merge")


def _rank_in_source(slots: DataFrame) -> DataFrame:
    """nth: the slot's number among those of its source, by slot. Slots are ranges already: a count per range, an offset, a window inside."""
    ranges = slots.withColumn("part", F.floor(F.col("id") / 50_000))
    counts = ranges.groupBy("part", "sid").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", "sid", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    inside = F.row_number().over(Window.partitionBy("part", "sid").orderBy("id"))
    return ranges.withColumn("in_part", inside).join(before, ["part", "sid"]).select("id", "sid", (F.col("off") + F.col("in_part") - 1).alias("nth"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 2000, seed: int = 17) -> DataFrame:
    """For every row of docs (doc_id, text, source): doc_id, source, size (words), source_size, target (of its source), taken (words the mix takes).

    Each source's rows, shuffled by a hash of seed and doc_id, are one stream of words cut in equal blocks of `block` words, fewer in
    sources of under LEAST_BLOCKS such. A source has as many slots as its target has blocks, to the nearest whole and `most` times its
    blocks at most; the slots of a source, by their rank in the schedule, take its blocks in turn, from the first again after the last.
    A row takes what the blocks taken cover of it. Rows without words take none; a null source is a source of its own;
    repeated rows are each a row of the stream; an empty table gives an empty one; other columns of docs are not looked at.
    """
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("_at"))
    stream = running_totals(base, [F.col("source"), F.col("_at"), F.col("doc_id"), F.col("size")], "size", "source")
    # the source as a key that is never null
    stream = cut(stream.withColumns({"_row": F.monotonically_increasing_id(), "_s": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))}))
    per_source = targets(stream.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    words = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("source_size") / LEAST_BLOCKS)))
    plan = per_source.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / words)))
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.floor(most * F.col("blocks"))).cast("long")
    plan = running_totals(plan.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0)), [F.col("sid")], "slots")
    plan = cut(plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_s"), "source_size", "target", "sid", "blocks", "slots", F.col("before").alias("slots_before")))
    n_slots = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    out = ["doc_id", "source", "size", "source_size", "target"]
    placed = by_hot_key(stream, plan, "_s", "inner")
    if not n_slots:
        return placed.select(*out, F.lit(0).cast("long").alias("taken"))
    taken_slots = schedule(plan.select("sid", "slots", F.col("slots_before").alias("before")), n_slots)
    blocks = taken_slots.join(_small(plan.select("sid", "blocks"), plan.count()), "sid")
    times = blocks.groupBy("sid", F.pmod("nth", F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))
    # block i of a source covers its words from floor(i * size / blocks)
    edge = lambda i: F.floor(i * F.col("source_size") / F.col("blocks"))
    first, last = F.floor(F.col("before") * F.col("blocks") / F.col("source_size")), F.floor((F.col("before") + F.col("size") - 1) * F.col("blocks") / F.col("source_size"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first - 1), F.least(F.col("blocks") - 1, last + 1))))
    covered = F.least(F.col("before") + F.col("size"), edge(F.col("block") + 1)) - F.greatest(F.col("before"), edge(F.col("block")))
    pieces = pieces.select("_row", "sid", "block", covered.alias("covered")).where("covered > 0")
    taken = pieces.join(times, ["sid", "block"]).groupBy("_row").agg(F.sum(F.col("covered") * F.col("times")).alias("taken"))
    return placed.join(taken, "_row", "left").select(*out, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
