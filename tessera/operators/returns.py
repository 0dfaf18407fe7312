"""Returns: over report periods and coming days, above an index, spread from quarters to days, of buckets by thresholds and of weekly rebalanced ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.panel import report_period
from .fitness import own_ranks
from .ranking import with_ranks

c = F.col


def period_return(daily: DataFrame, value: str) -> DataFrame:
    """entity, period, value: daily values summed over the window in which a quarter's report is in force, to a year's scale; dates without any value count 0."""
    k = F.when(F.month("period") == 3, 3).when(F.month("period") == 6, 6).otherwise(2)
    g = daily.withColumn("period", report_period(c("day"))).groupBy("entity", "period").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("_sum"))
    return g.select("entity", "period", (c("_sum") * k).alias(value))


def excess(daily: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """daily with value less the index's of the day; null on days without one. The index has one row a day, which a calendar bounds."""
    i = index.select("day", c(value).alias("_index"))
    return daily.join(F.broadcast(i), "day", "left").withColumn(value, c(value) - c("_index")).drop("_index")


def month_end_values(daily: DataFrame, value: str) -> DataFrame:
    """entity, period, value: what stood on the last trading day of April, August and October, for the first, second and third quarter. The fourth has none."""
    quarter = F.when(F.month("day") == 4, 3).when(F.month("day") == 8, 6).when(F.month("day") == 10, 9)
    d = daily.withColumn("_q", quarter).where("_q is not null")
    last = d.groupBy(F.year("day").alias("_y"), "_q").agg(F.max("day").alias("day"))  # three rows a year
    return d.join(F.broadcast(last.select("day")), "day").select("entity", F.last_day(F.make_date(F.year("day"), c("_q"), F.lit(1))).alias("period"), value)


def spread_to_days(quarterly: DataFrame, days: DataFrame) -> DataFrame:
    """quarterly (entity, period, ...) on each of days (day): the quarter whose report is in force then. Days before the first one with a report have no row."""
    at = days.select("day", report_period(c("day")).alias("period"))
    return quarterly.join(F.broadcast(at), "period")  # one row a day, which a calendar bounds


def forward_mean(df: DataFrame, value: str, h: int) -> Column:
    """Mean of the next h rows of the entity, over h; null for the last h rows, where fewer follow."""
    by = Window.partitionBy("entity").orderBy("day")
    return F.when(F.lead(F.lit(1), h).over(by).isNotNull(), F.sum(value).over(by.rowsBetween(1, h)) / h)


def offset_days(starts: DataFrame, calendar: DataFrame, offset: int) -> DataFrame:
    """starts (day, ...) with `to`, the trading day `offset` days on (or back, below 0). A day off the calendar counts as if it stood in it. Null beyond its ends.

    Only dates meet in one task: the calendar's and the distinct ones of starts.
    """
    if not offset:
        raise ValueError("an offset is not 0")
    w = Window.orderBy("day")
    known = calendar.select("day").distinct().withColumn("_n", (F.row_number().over(w) - 1).cast("long"))
    both = starts.select("day").distinct().join(known, "day", "full")
    # trading days before it, and whether it is one
    before = F.coalesce(F.sum(F.when(c("_n").isNotNull(), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.lit(offset) if offset < 0 else F.when(c("_n").isNotNull(), offset).otherwise(offset - 1)
    at = both.select("day", (before + step).alias("_to")).join(known.select(c("day").alias("to"), c("_n").alias("_to")), "_to", "left").select("day", "to")
    return starts.join(F.broadcast(at), "day", "left")


def group_returns_by_threshold(df: DataFrame, x: str, ret: str, n: int = 10) -> DataFrame:
    """period, bucket 1..n, ret: means by rank / count in (k / n, (k + 1) / n], of rows that have both and are not restricted, from the second date on;
    0 for an empty bucket, and for all of a date of fewer than n rows."""
    ok = c(x).isNotNull() & c(ret).isNotNull() & ~c("restricted")
    d = df.select("period", F.when(ok, c(x)).alias("_x"), F.when(ok, c(ret)).alias("_y"))
    d = own_ranks(d, {"_p": "_x"}).withColumn("bucket", reduce(lambda a, b: a + b, [(c("_p") > k / n).cast("int") for k in range(1, n)], F.lit(1)))
    first = df.agg(F.min("period").alias("_first"))  # one row
    d = d.crossJoin(F.broadcast(first)).where("period > _first")
    means = d.groupBy("period").agg(F.count("_p").alias("_n"), *[F.avg(F.when(c("bucket") == k, c("_y"))).alias(f"_b{k}") for k in range(1, n + 1)])
    each = F.array(*[F.struct(F.lit(k).alias("bucket"), F.when(c("_n") >= n, F.coalesce(f"_b{k}", F.lit(0.0))).otherwise(0.0).alias("ret")) for k in range(1, n + 1)])
    return means.select("period", F.explode(each).alias("g")).select("period", "g.*")


def weekly_rebalanced(df: DataFrame, x: str, ret: str, n: int = 10) -> DataFrame:
    """period, bucket, cumret: buckets of the day before, as they stand at a week's first day, held the whole week; running sums of their mean returns.

    df is daily (entity, period, x, ret, restricted). A day of fewer than n values, or of one value only, has no buckets; a bucket's return is the sum
    of its members' over their number. Before a first bucket an entity is in none.
    """
    ok = ~F.coalesce(c("restricted"), F.lit(True)) & c(ret).isNotNull()
    spread = df.groupBy("period").agg((F.stddev_samp(x) > 0).alias("_varies"))  # one row a day
    d = df.join(F.broadcast(spread), "period").withColumn("_x", F.when(ok & c("_varies"), c(x)))
    d = with_ranks(d, {"_p": "_x"}).withColumn("_p", F.when(c("_p_n") >= n, c("_p") / c("_p_n")))
    d = d.withColumn("_g", F.coalesce((n - F.floor((1 - c("_p")) * n)).cast("int"), F.lit(-1)))
    by = Window.partitionBy("entity").orderBy("period")
    d = d.withColumn("_was", F.lag("_g").over(by)).withColumn("_week", F.date_trunc("week", "period"))
    week = Window.partitionBy("entity", "_week").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("bucket", F.first("_was", ignorenulls=True).over(week)).where("bucket > 0")
    rets = d.groupBy("period", "bucket").agg((F.sum(ret) / F.count(F.lit(1))).alias("_r"))
    run = Window.partitionBy("bucket").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return rets.select("period", "bucket", F.sum("_r").over(run).alias("cumret"))
