"""What a search has found out, kept between runs: ICs of expressions by date, scores of expressions, results of runs. Parquet in folders that are
each written once and take their name by one rename, so writers that run at once, or twice, leave whole folders and no half ones."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def commit(df: DataFrame, root: str, name: str) -> bool:
    """Writes df as folder `name` of the table at root, all of it or nothing; False, and nothing written, where that folder is there, also where another writer was faster."""
    spark = df.sparkSession
    target, fs = _fs(spark, f"{root}/{name}")
    if fs.exists(target):
        return False
    staged, _ = _fs(spark, f"{root}/_staged-{uuid.uuid4().hex}")
    df.write.parquet(staged.toString())
    try:
        done = not fs.exists(target) and fs.rename(staged, target)
        # a rename onto a folder that came up meanwhile moves into it; that copy is not the table's
        inside, _ = _fs(spark, f"{root}/{name}/{staged.getName()}")
        if fs.exists(inside):
            fs.delete(inside, True)
            done = False
    finally:
        fs.delete(staged, True)
    return bool(done)


def committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of the table's folders, with `batch`, the folder's name; none where there is none."""
    p, fs = _fs(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("_")) if fs.exists(p) else []
    if not names:
        return spark.createDataFrame([], f"{schema}, batch string")
    rows = spark.read.schema(schema).parquet(*[f"{root}/{n}" for n in names])
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1))


def digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:32]


class IcStore:
    """ICs by date of canonical expressions, under the rule, the label and the data (a name of one's own) they were computed with."""

    SCHEMA = "key string, formulation string, period date, ic double"

    def __init__(self, spark: SparkSession, root: str, data: str = ""):
        self.spark, self.root, self.data = spark, root, data

    def _rule(self, rule, label: str) -> str:
        return digest([rule.metric, rule.coverage, rule.pairs, rule.share, list(rule.styles), label, self.data])

    def read(self, rule, label: str, formulations: set[str]) -> dict[str, dict]:
        """ICs by date of those of the expressions that are there; an expression without ICs is there with none, a figure of a whole factor is under no date."""
        wanted = self.spark.createDataFrame([(f,) for f in sorted(formulations)], "formulation string")
        rows = committed(self.spark, f"{self.root}/{self._rule(rule, label)}", self.SCHEMA).join(F.broadcast(wanted), "formulation")
        out: dict[str, dict] = {}
        for r in rows.select("formulation", "period", "ic").distinct().collect():
            ics = out.setdefault(r.formulation, {})
            if r.period is not None or r.ic is not None:
                ics[r.period] = r.ic
        return {f: dict(sorted(ics.items())) for f, ics in out.items()}

    def add(self, rule, label: str, series: dict[str, dict]) -> None:
        """One folder, named after what is in it; a second writer of the same leaves it as it is."""
        key = self._rule(rule, label)
        rows = [(key, f, p, ic) for f, ics in sorted(series.items()) for p, ic in (sorted(ics.items()) or [(None, None)])]
        commit(self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1), f"{self.root}/{key}", digest(sorted(series)))

    def arrays(self) -> DataFrame:
        """formulation, ics (of all dates in order): the table of IC arrays."""
        p, fs = _fs(self.spark, self.root)
        keys = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        rows = self.spark.createDataFrame([], f"{self.SCHEMA}, batch string")
        for key in keys:
            rows = rows.unionByName(committed(self.spark, f"{self.root}/{key}", self.SCHEMA))
        steps = F.array_sort(F.collect_set(F.when(F.col("period").isNotNull(), F.struct("period", "ic"))))
        return rows.groupBy("key", "formulation").agg(F.transform(steps, lambda s: s.ic).alias("ics"))

    def evict(self, rule, label: str, keep: set[str]) -> None:
        """Leaves only the expressions in keep: what stays is written first, the folders before it go then."""
        key = self._rule(rule, label)
        root = f"{self.root}/{key}"
        p, fs = _fs(self.spark, root)
        old = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        kept = self.read(rule, label, keep)
        name = digest(["kept", sorted(kept)])
        if kept and not _exists(self.spark, f"{root}/{name}"):
            rows = [(key, f, d, ic) for f, ics in sorted(kept.items()) for d, ic in (sorted(ics.items()) or [(None, None)])]
            commit(self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1), root, name)
        for o in old:
            if o.getName() != name:
                fs.delete(o, True)


class ScoreStore:
    """One score for each expression and model, and an audit of every attempt. Adding is idempotent: a batch is a folder named after its content, and of several scores of
    one expression, from writers that ran at once, the least (at, score) is the one that counts for every reader."""

    SCHEMA = "expression string, model string, score double, at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def scores(self) -> DataFrame:
        rows = committed(self.spark, f"{self.root}/scores", self.SCHEMA)
        return rows.groupBy("expression", "model").agg(F.min(F.struct("at", "score")).alias("first")).select("expression", "model", "first.score", "first.at")

    def add(self, scores: DataFrame) -> bool:
        """Scores of expressions that have none yet; True if a folder came of it. Every row goes to the audit too, once a batch."""
        rows = scores.select("expression", "model", F.col("score").cast("double").alias("score"), F.col("at").cast("timestamp").alias("at"))
        each = F.xxhash64("expression", "model", "score", "at").cast("decimal(38,0)")
        name = digest([str(x) for x in rows.agg(F.count(F.lit(1)), F.sum(each), F.sum(each % 1_000_003)).first()])
        commit(rows.withColumn("outcome", F.when(F.col("score").isNull(), "failed").otherwise("scored")), f"{self.root}/audit", name)
        new = rows.where("score is not null").join(self.scores().select("expression", "model"), ["expression", "model"], "left_anti")
        return commit(new, f"{self.root}/scores", name)

    def audit(self) -> DataFrame:
        return committed(self.spark, f"{self.root}/audit", f"{self.SCHEMA}, outcome string")


def once(df_of, spark: SparkSession, root: str, name: str, *parts) -> DataFrame:
    """The table that df_of() gives, written under its name and what it depends on (dates, a version of the data, ...) the first time and read after that."""
    at = f"{name}-{digest([str(p) for p in parts])}"
    if not _exists(spark, f"{root}/{at}"):
        commit(df_of(), root, at)
    return spark.read.parquet(f"{root}/{at}")


def write_results(root: str, run: str, ics: DataFrame, returns: DataFrame, summary: DataFrame) -> None:
    """The ICs by date, the groups' returns by date and the summary of one factor's backtest, each a table of all runs. A run is written once."""
    for name, df in (("ics", ics), ("returns", returns), ("summary", summary)):
        commit(df.withColumn("run", F.lit(run)), f"{root}/{name}", digest(run))


def results(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the three tables, of all runs."""
    p, fs = _fs(spark, f"{root}/{name}")
    folders = [s.getPath().toString() for s in fs.listStatus(p) if not s.getPath().getName().startswith("_")]
    return spark.read.option("mergeSchema", True).parquet(*sorted(folders))
