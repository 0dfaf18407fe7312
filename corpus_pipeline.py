"""A training corpus from documents: toxic texts go, one of each near-duplicate group stays, benchmark passages are cut out,
sources are mixed to their targets, the rest is laid out in shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_ids, cut, scratch, table
from tessera.llm.decontaminate import decontaminate
from tessera.llm.mixing import mix
from tessera.llm.ngram_join import ngram_join
from tessera.llm.sharding import shard
from tessera.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic: each row is judged by its own text, whatever its id, repeated rows too."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near duplicates. Rows without an id are kept; rows that repeat an id leave one."""
    classes = ngram_join(docs)
    dropped = cut(classes.where("doc_id != component_id").select("doc_id").distinct())
    kept = by_ids(docs, dropped, "doc_id", "left_anti")
    repeated = cut(classes.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if repeated.limit(1).count():
        kept = by_ids(kept, repeated, "doc_id", "left_anti").union(by_ids(kept, repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that the benchmark holds; those of which no word is left go. Each row by itself, with or without an id;
    a row without text has no words and stays."""
    judged = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars"))
    left = judged.where("not contaminated or n_hit < n_words")
    return left.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(F.col("contaminated"), F.length("clean_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole; documents without words once. Rows that share an id go by
    the one of them that is taken most; a row without an id, which no other table can name, stays once."""
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    times = cut(mix(docs).select("doc_id", copies.alias("copies")).groupBy("doc_id").agg(F.max("copies").alias("copies")))
    some = by_ids(docs, times, "doc_id", "left")
    return some.withColumn("_n", F.explode(F.expr("sequence(1, coalesce(copies, 1))"))).where("coalesce(copies, 1) > 0").select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies: its shard and slot; rows that share an id or have none are each placed."""
    return shard(docs)


STAGES = [("toxicity", without_toxic), ("ngram_join", one_of_a_kind), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: The classifier and the mix's shuffle are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as s:
        for name, stage in STAGES[:-1]:
            docs = s.keep(stage(spark, docs, sf_dir), name)
        return cut(STAGES[-1][1](spark, docs, sf_dir))
