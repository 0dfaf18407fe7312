"""What several operators share: places to cut lineage, tokens, prefix sums, joins by a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Up to so many (id) rows one side of a join is broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Partitions that the rows of one key are spread over where its side is too large to be broadcast.
SALTS = 64
#: Bytes of an Arrow batch of texts sent to Python, where the session has left Spark's default as it is.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir, or the one the context has been given; a folder of our own only where
    neither is set and driver and executors are one process, as in tests. A cluster without a shared folder is an error: files
    that one machine writes to its own disk are not found from the others."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    there = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(there)
    return there


def small_batches(spark: SparkSession) -> None:
    """Has texts sent to Python in batches of BATCH_BYTES, however long they are, unless the session has a limit of its own.

    A batch is held in the JVM's buffers, as Arrow data and as Python objects at once, for every task that runs on an executor.
    """
    if spark.conf.get(BATCH_SETTING) == f"{64 << 20}b":
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from files in the shared folder, without the lineage. They are there until the session ends, or as long as it refers to
    them where spark.cleaner.referenceTracking.cleanCheckpoints is set; what an operator needs for itself alone goes to its scratch()."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables in the shared folder that go when the operator is done with them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.kept = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def cut(self, df: DataFrame) -> DataFrame:
        """The rows of df without the lineage, under a name of no interest."""
        self.kept += 1
        return self.keep(df, f"cut{self.kept}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    s = Scratch(spark)
    try:
        yield s
    finally:
        s.drop()


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """A left_semi, left_anti or inner join, or a left join to few columns, that leaves the wide side where it is
    while `ids` has at most BROADCAST_ROWS rows, and shuffles both beyond that. `ids` is read twice: pass a cut table."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_merge"), key, how)


def by_hot_key(df: DataFrame, few: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A left or inner join to `few` (one row a key) of rows of which any share may have one key: by broadcast while `few` has
    at most BROADCAST_ROWS rows; beyond that each key's rows are spread over SALTS partitions. `few` is read twice: pass a cut table."""
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(few), key, how)
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("_salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})"))).hint("shuffle_merge"), [key, "_salt"], how).drop("_salt")


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, A-Z in lower case (bytes.lower and bytes.split know ASCII only)."""
    return text.lower().split() if text else []


_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9FB21C651E98DF25


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class WordHashes:
    """64-bit hashes of the words space_words gives, for many texts at once, without a Python object a word.

    A word's hash is a polynomial of its bytes modulo 2**64, taken as a difference of prefix sums over the joined texts.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in turn, and where each text's begin (one more than texts)."""
        joined = b" ".join([t or b"" for t in texts]).lower() + b" "
        code = np.frombuffer(joined, np.uint8)
        if len(self.up) < len(code):
            n = 2 * len(code)
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        space = _SPACE[code]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.up[: len(code)])])
        hashes = mixed((sums[end] - sums[start]) * self.down[start])
        begin = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        return hashes, np.searchsorted(start, begin)


def chunks(texts: list[bytes | None], size: int = 1 << 18) -> Iterator[slice]:
    """Slices of texts of about size bytes; a longer text is a slice of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or b"") > size:
            yield slice(first, i)
            first, held = i, 0
        held += len(t or b"") + 1
    if first < len(texts):
        yield slice(first, len(texts))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose high and low bits all depend on every input bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def running_totals(df: DataFrame, order: list, values: str | list[str], group: str | None = None) -> DataFrame:
    """Adds `before`, the sum of the value over the rows that come earlier in `order` (within `group`, where given;
    then `order` starts with it), and `nth`, their number. Of several values the sums are `before_<value>`.

    Rows are range-partitioned by `order` and cut there, so that the partitions stay as they are; totals per
    partition give each one its offset; a window inside the partition does the rest. A hot group spreads over
    as many partitions as its rows need. Ties in `order` should be broken by its last columns; rows that tie
    altogether fall into one partition, in any order. Values are whole numbers. df should be narrow: it is cut first, or the
    sampling that finds the ranges would compute it a second time.
    """
    g = [group] if group else []
    names = {values: "before"} if isinstance(values, str) else {v: f"before_{v}" for v in values}
    df = cut(df)
    ranged = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sums = ranged.groupBy("_pid", *g).agg(*[F.sum(v).alias(f"_sum_{v}") for v in names], F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*(F.col(c) for c in g)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0))
    offsets = cut(sums.select("_pid", *[F.col(c).alias("_g") for c in g], *[offset(f"_sum_{v}").alias(f"_off_{v}") for v in names], offset("_rows").alias("_rows0")))
    on = ranged["_pid"] == offsets["_pid"]
    if group:
        on = on & ranged[group].eqNullSafe(offsets["_g"])
    # one row per partition and group that has rows in it; no more rows than a partition holds can meet at one of them
    few = offsets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = ranged.join(F.broadcast(offsets) if few else offsets.hint("shuffle_merge"), on).drop(offsets["_pid"])
    inside = Window.partitionBy("_pid", *g).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_off_{v}") + F.sum(v).over(upto) - F.col(v)).cast("long").alias(n) for v, n in names.items()],
        (F.col("_rows0") + F.row_number().over(inside) - 1).cast("long").alias("nth"),
    )
