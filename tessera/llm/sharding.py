"""Sharding by global byte-size prefix sums, cut at equal targets; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, running_totals


def shard(docs: DataFrame, shards: int = 16, whole_group: float = 1 / 64) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, size (UTF-8 bytes + 1), text_crc32, law ('bytes'), shard (0 to shards - 1), slot (from 0, without
    gaps, in each shard), grown_shard (null: this law has no growth rule).

    Rows are put in the order of (md5 of the text, doc_id), so equal texts are neighbours, and cut into contiguous shards at equal targets of the
    sum of all sizes; a row lies where its middle byte does. A group of equal texts goes whole into the shard of its middle byte while it has at most
    `whole_group` of a target; a larger one is cut like anything else, so that sizes stay near equal. A null text counts
    as an empty one; repeated rows are each placed, a null doc_id first; an empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("_md5"))
    placed = running_totals(base, [F.col("_md5"), F.col("doc_id")], "size")
    placed = cut(placed)
    total = placed.agg(F.sum("size")).first()[0] or 1
    groups = placed.groupBy("_md5").agg(F.min("before").alias("_start"), F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    groups = cut(groups.where("_n > 1"))
    large = F.col("_bytes") * shards > F.lit(whole_group * total)
    # each large group has more than its share of all bytes, so there are fewer than shards / whole_group of them; no other key is hot in the join
    cut_up = F.broadcast(groups.where(large).select("_md5"))
    small = groups.where(~large).select("_md5", (F.col("_start") + F.col("_bytes") / 2).alias("_middle"))
    rest = placed.join(cut_up, "_md5", "left_anti").join(small, "_md5", "left")
    rest = rest.unionByName(placed.join(cut_up, "_md5", "left_semi"), allowMissingColumns=True)
    at = rest.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.coalesce("_middle", F.col("before") + F.col("size") / 2) * shards / F.lit(total))).cast("int"))
    at = cut(at.select("doc_id", "size", "text_crc32", "shard", "nth"))
    starts = at.groupBy("shard").agg(F.min("nth").alias("_first"))  # at most `shards` rows
    return at.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
