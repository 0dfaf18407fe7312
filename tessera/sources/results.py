"""Tables that a run leaves and reads again: generations, factors, scores, tokens, what is done. Parquet under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_generations(records: DataFrame, path: str) -> None:
    """All candidates, a folder a generation, so that a snapshot reads no later one."""
    records.write.mode("overwrite").partitionBy("generation").parquet(path)


def snapshot(spark: SparkSession, path: str, through: int) -> DataFrame:
    """The candidates up to a generation."""
    return spark.read.parquet(path).where(F.col("generation") <= through)


def write_factors(df: DataFrame, names: list[str], path: str) -> None:
    """Columns of a panel as factor, period, entity, value (single precision), a folder a factor."""
    long = df.unpivot(["entity", "period"], names, "factor", "value").where("value is not null")
    long.withColumn("value", F.col("value").cast("float")).write.mode("overwrite").partitionBy("factor").parquet(path)


def factor_wide(spark: SparkSession, path: str, factor: str, by: str = "period") -> DataFrame:
    """One factor as a wide table: a row a period and a column an entity, or the other way round."""
    other = "entity" if by == "period" else "period"
    df = spark.read.parquet(path).where(F.col("factor") == factor)
    return df.groupBy(by).pivot(other).agg(F.first("value"))


def finished(spark: SparkSession, path: str) -> DataFrame:
    """The factors that are written already (factor); none where nothing is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if "=" in s.getPath().getName()] if fs.exists(p) else []
    return spark.createDataFrame([(n,) for n in names], "factor string")


def append_scores(scores: DataFrame, path: str) -> None:
    """Scores (expression, model, score, at) added to the table; reading takes one of each."""
    scores.write.mode("append").parquet(path)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """One score for each expression and model: the first that was stored."""
    return spark.read.parquet(path).groupBy("expression", "model").agg(F.min_by("score", "at").alias("score"), F.min("at").alias("at"))


def token_usage(spark: SparkSession, path: str) -> DataFrame:
    """Sums of a usage log (a JSON object a line): requests, prompt_tokens, completion_tokens, total_tokens; a line without a number counts 0."""
    log = spark.read.schema("prompt_tokens long, completion_tokens long, total_tokens long").json(path)
    return log.agg(F.count(F.lit(1)).alias("requests"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in log.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames one after another; a column that one lacks is null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
