"""Ranks over a whole table or a date, without its rows meeting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import cut, spread, written

c = F.col

#: Groups that a key's rows without a value are dealt to.
SPREAD = 64


def mean_ranks(df: DataFrame, x: str, name: str, parts: int = 64) -> DataFrame:
    """x (distinct, not null), name: the mean rank of its rows among all rows of df, 1 for the least.

    Equal values are counted first; ranges between approximate quantiles are then ranked apart, each from the number of rows below it.
    """
    values = df.where(c(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n"))
    bounds = sorted(set(df.approxQuantile(x, [i / parts for i in range(1, parts)], 0.5 / parts)))
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < c(x))) if bounds else F.lit(0)
    values = values.withColumn("_part", part)
    # one row a range
    below = values.groupBy("_part").agg(F.sum("_n").alias("_m"))
    below = below.select("_part", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    return values.join(F.broadcast(below), "_part").select(x, (c("_below") + inside - c("_n") + (c("_n") + 1) / 2).alias(name))


def with_ranks(df: DataFrame, columns: dict[str, Column | str], keys: tuple[str, ...] = ("period",), parts: int = 16) -> DataFrame:
    """df with, for each name and column, the mean rank (1 for the least, null for null) among the values of the keys' rows, and in name_n their number.

    The rows of a key are ranked in ranges between approximate quantiles, each from the number of values below it: one aggregation for the bounds and one for
    the sizes of the ranges, which come back by broadcast (a row a key; a calendar bounds dates). df is written once first, as it is read three times, and so are
    the bounds: they are estimates, and sizes and rows must see the same ones. A row takes along the number below its range, not the arrays; rows without a value are dealt out.
    """
    x = {n: f"_{n}_x" for n in columns}
    less = lambda name: lambda b: b < c(name)
    d = written(df.withColumns({x[n]: c(v) if isinstance(v, str) else v for n, v in columns.items()}))
    whole = [F.count(F.lit(1)).alias("_rows"), *[F.count(x[n]).alias(f"{n}_n") for n in x]]
    bounds = cut(d.groupBy(*keys).agg(*[F.percentile_approx(x[n], [i / parts for i in range(1, parts)], 100 * parts).alias(f"_{n}_b") for n in x], *whole))
    rows = bounds.agg(F.sum("_rows")).first()[0] or 0
    none = -1 - F.pmod(F.xxhash64(*d.columns), F.lit(SPREAD)).cast("int")
    d = d.join(F.broadcast(bounds.drop("_rows")), [*keys]).withColumns({f"_{n}_part": F.when(c(x[n]).isNotNull(), F.size(F.filter(f"_{n}_b", less(x[n])))).otherwise(none) for n in x})
    d = d.drop(*[f"_{n}_b" for n in x])
    sizes = d.groupBy(*keys).agg(*[F.array(*[F.count(F.when(c(f"_{n}_part") == i, 1)) for i in range(parts)]).alias(f"_{n}_s") for n in x])
    below = lambda n: F.when(c(f"_{n}_part") >= 0, F.aggregate(F.slice(f"_{n}_s", 1, F.greatest(c(f"_{n}_part"), F.lit(0))), F.lit(0).cast("long"), lambda a, m: a + m))
    d = d.join(F.broadcast(sizes), [*keys]).withColumns({f"_{n}_below": below(n) for n in x}).drop(*[f"_{n}_s" for n in x])
    for n in x:
        part = Window.partitionBy(*keys, f"_{n}_part")
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, f"_{n}_part", x[n]))
        d = spread(rows, d, *keys, f"_{n}_part").withColumn(n, c(f"_{n}_below") + F.rank().over(part.orderBy(x[n])) + (ties - 1) / 2)
    return d.select(*[k for k in df.columns if k not in x], *x, *[f"{n}_n" for n in x])


def with_bucket(df: DataFrame, x: str, n: int, keys: tuple[str, ...] = ("period",), name: str = "bucket") -> DataFrame:
    """df with the bucket, 1 to n, of x's percentile rank among the values of the keys' rows: n - floor((1 - pct) * n)."""
    r = with_ranks(df, {"_rank_of": x}, keys)
    return r.withColumn(name, F.when(c(x).isNotNull(), (n - F.floor((1 - c("_rank_of") / c("_rank_of_n")) * n)).cast("int"))).drop("_rank_of", "_rank_of_n")
