"""Where a plan is cut: rows go to the shared folder and are read from there, so that what follows reads them and not their lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that orders rows, on average at most.
ROWS = 1 << 18

#: Folders of tables that go at the end of passing().
_PASSING: ContextVar[list | None] = ContextVar("passing", default=None)


#: Tables that written() gave.
_WRITTEN: weakref.WeakSet = weakref.WeakSet()

#: Where they lie, into how many buckets of entities they are dealt, and their numbers of rows, where asked for.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_BUCKETS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_ROWS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

#: Spark's setting by which the files of a job's shuffles go when the job is done, and not when the driver collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a bucket that is worth a task of its own.
FEW = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the context's own; in a local session without either a temporary one. A cluster without it is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    there = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tasks(rows: int, spark: SparkSession) -> int | None:
    """So many tasks that one has ROWS rows on average, where the session's shuffles have fewer."""
    n = -(-rows // ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(rows: int, df: DataFrame, *by: str) -> DataFrame:
    """df dealt by `by` to as many tasks as so many rows ask for, where the session's shuffles have fewer."""
    n = tasks(rows, df.sparkSession)
    return df.repartition(n, *by) if n else df


def written(df: DataFrame, buckets: int = 0) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: smaller than a cut, and only columns that are asked for are read; neither order nor partitions stay.

    With `buckets`, rows are dealt to so many buckets by entity, and windows along time read that table without an exchange. Each task should hold a bucket then.
    """
    name = f"{'buckets' if buckets else 'table'}_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    if (passing_ := _PASSING.get()) is not None:
        passing_.append(path)
    if buckets:
        df.write.bucketBy(buckets, "entity").option("path", path).saveAsTable(name, format="parquet")
        out = df.sparkSession.table(name)
        _BUCKETS[out] = buckets
    else:
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN.add(out)
    _PATHS[out] = path
    return out


def dealt(df: DataFrame) -> DataFrame:
    """A table that written() gave, in buckets: a task for ROWS rows, and no more tasks than the session's shuffles have where there are fewer rows."""
    n, most = table_rows(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-n // ROWS), min(most, n // FEW))
    out = written(df.repartition(n, "entity").sortWithinPartitions("entity", "qidx"), n)
    dropped(df)
    return out


def buckets(df: DataFrame) -> int:
    """Into how many buckets of entities a table is dealt; 0 for any other frame."""
    return _BUCKETS.get(df, 0)


def table_rows(df: DataFrame) -> int | None:
    """The number of rows of a table that written() gave, which its files know; None for any other frame."""
    if df in _WRITTEN and df not in _ROWS:
        _ROWS[df] = df.count()
    return _ROWS.get(df)


def dropped(df: DataFrame) -> None:
    """Inside passing(), a table that written() gave goes now; nothing may read it any more."""
    if (passing_ := _PASSING.get()) is not None and (path := _PATHS.get(df)) in passing_:
        passing_.remove(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    if (name := path.rpartition("/")[2]).startswith("buckets_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def passing(spark: SparkSession):
    """Tables that are written inside go when it is left, and files of shuffles with their job: for work whose result has reached the driver by then."""
    token, before = _PASSING.set([]), spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
        for path in _PASSING.get():
            _delete(spark, path)
        _PASSING.reset(token)
