"""Dense panels: every entity at every date, facts joined to the grid, missing cells as nulls."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(cells: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """cells (entity, period, ...) on the grid of all their periods and entities, with qidx, the number of the period from 0. Those are read from `of`, the rows that
    cells were summed from, where it is given.

    Periods are few (one row each, joined by broadcast); entities are not, so the grid grows from them.
    """
    of = cells if of is None else of
    periods = of.select("period").distinct()
    periods = periods.withColumn("qidx", (F.row_number().over(Window.orderBy("period")) - 1).cast("int"))
    grid = of.select("entity").distinct().crossJoin(F.broadcast(periods))  # the grid itself is the result
    return grid.join(cells, ["entity", "period"], "left")


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by part and quarter of shipping: x (price, in steps so that values tie), y (quantity, centred), z; industry 0 is none.

    Sums, grid and the window along time are dealt to as many tasks as the table's rows ask for."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.count()
    li = li.select(F.col("l_partkey").alias("entity"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period"), "l_extendedprice", "l_quantity")
    cells = spread(rows, li, "entity", "period").groupBy("entity", "period").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.round("l_quantity").cast("long")).alias("q"))
    cells = cells.select("entity", "period", (F.expr("cents div 10000").cast("double") / 97).alias("x"), (F.col("q").cast("double") / 10 - 3).alias("y"))
    p = spread(rows, dense(cells, li), "entity").withColumns({"z": F.col("x") - 4, "industry": (F.col("entity") % 5).cast("int"), "restricted": (F.col("entity") + F.col("qidx")) % 7 == 0})
    ahead = F.lead("x").over(Window.partitionBy("entity").orderBy("qidx"))
    return p.withColumn("fwd_ret", F.when(F.col("x") > 0, ahead / F.col("x") - 1))


PART_PANEL_SQL = """
cells AS (SELECT l_partkey AS entity, date_trunc('quarter', l_shipdate)::DATE AS period, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, sum(round(l_quantity)::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1, 2),
per AS (SELECT period, (row_number() OVER (ORDER BY period) - 1)::INTEGER AS qidx FROM (SELECT DISTINCT period FROM cells)),
grid AS (SELECT entity, period, qidx FROM (SELECT DISTINCT entity FROM cells), per),
p0 AS (SELECT entity, period, qidx, (cents // 10000)::DOUBLE / 97::DOUBLE AS x, q::DOUBLE / 10::DOUBLE - 3 AS y FROM grid LEFT JOIN cells USING (entity, period)),
p AS (SELECT *, x - 4 AS z, (entity % 5)::INTEGER AS industry, (entity + qidx) % 7 = 0 AS restricted, CASE WHEN x > 0 THEN lead(x) OVER (PARTITION BY entity ORDER BY qidx) / x - 1 END AS fwd_ret FROM p0)"""


def standalone_quarter(df: DataFrame, values: list[str]) -> DataFrame:
    """Year-to-date values (entity, year, quarter, ...) as those of the quarter alone: less the row before of the same year; the first quarter as it is."""
    w = Window.partitionBy("entity", "year").orderBy("quarter")
    return df.withColumns({v: F.when(F.col("quarter") == 1, F.col(v)).otherwise(F.col(v) - F.lag(v).over(w)) for v in values})


def first_disclosed(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order, nulls last."""
    w = Window.partitionBy(*keys).orderBy(*[o.asc_nulls_last() for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def report_period(day: Column) -> Column:
    """The quarter end whose report is in force: May to August the first quarter, September and October the second, November to April the third."""
    m, y = F.month(day), F.year(day)
    return F.when(m.between(5, 8), F.make_date(y, F.lit(3), F.lit(31))).when(m.between(9, 10), F.make_date(y, F.lit(6), F.lit(30))).otherwise(F.make_date(F.when(m >= 11, y).otherwise(y - 1), F.lit(9), F.lit(30)))


def unpivoted(wide: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """A wide entity x date matrix as long rows."""
    return wide.unpivot([key], [c for c in wide.columns if c != key], name, value)


def statements(spark: SparkSession, path: str, schema: str, fields: list[str], industry: str | None = None) -> DataFrame:
    """A statement CSV: only its named fields; main consolidated rows (of one INDUSTRY_CATEGORY, where given) of tickers of six digits on the two exchanges,
    at quarter ends; entity is the ticker with its suffix, period the end of the quarter that END_DATE lies in."""
    df = spark.read.schema(schema).option("header", True).csv(path).select(*fields)
    end = F.last_day(F.add_months(F.date_trunc("quarter", F.try_to_timestamp("END_DATE")), 2))
    ok = (F.col("MERGED_FLAG") == 1) & F.col("EXCHANGE_CD").isin("XSHG", "XSHE") & F.col("TICKER_SYMBOL").rlike("^[0-9]{6}$") & end.isNotNull()
    if industry is not None:
        ok &= F.col("INDUSTRY_CATEGORY") == industry
    return df.where(ok).withColumns({"entity": entity_id(F.col("TICKER_SYMBOL"), F.col("EXCHANGE_CD")), "period": end})


def entity_id(ticker: Column, exchange: Column) -> Column:
    """The ticker, filled up to six digits, with its exchange's suffix; none for an exchange unknown."""
    suffix = F.when(exchange == "XSHG", ".SH").when(exchange == "XSHE", ".SZ").when(exchange == "XBSE", ".BJ").otherwise("")
    return F.concat(F.lpad(ticker, 6, "0"), suffix)


def features_of(df: DataFrame, names: list[str]) -> DataFrame:
    """The panel's keys and the named features, in that order; a feature that is not there is an error that names it."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"no such feature: {', '.join(missing)}")
    return df.select("entity", "period", *names)


def checked_coverage(df: DataFrame, names: list[str], least: float = 0.9) -> DataFrame:
    """feature, period, coverage of every feature and period; an error that names those below `least`."""
    cover = df.groupBy("period").agg(*[(F.count(n) / F.count(F.lit(1))).alias(n) for n in names]).unpivot(["period"], names, "feature", "coverage")
    low = cover.where(F.col("coverage") < least).limit(5).collect()
    if low:
        raise ValueError("coverage below " + f"{least}: " + ", ".join(f"{r.feature} at {r.period} {r.coverage:.3f}" for r in low))
    return cover


def union_of_axes(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames (entity, period, ...) on the union of their entities and of their periods; columns are named frame_column."""
    keys = [df.select("entity", "period") for df in frames.values()]
    every = keys[0]
    for k in keys[1:]:
        every = every.unionByName(k)
    grid = dense(every.distinct()).select("entity", "period", "qidx")
    for name, df in frames.items():
        grid = grid.join(df.select("entity", "period", *[F.col(x).alias(f"{name}_{x}") for x in df.columns if x not in ("entity", "period")]), ["entity", "period"], "left")
    return grid


def shared_dates(a: DataFrame, b: DataFrame, date: str) -> DataFrame:
    """The rows of a on dates that b has too; dates are few, as a calendar bounds them."""
    return a.join(F.broadcast(b.select(date).distinct()), date, "left_semi")


def between(df: DataFrame, date: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows of a span of dates, both ends included; an end that is not given is open."""
    if first is not None:
        df = df.where(F.col(date) >= F.lit(first).cast("date"))
    return df if last is None else df.where(F.col(date) <= F.lit(last).cast("date"))


def evaluated(date: Column, first: str, last: str) -> Column:
    """Whether a date counts in an evaluation."""
    return F.coalesce(date.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))


def daily_wide(spark: SparkSession, folder: str, name: str, key: str = "entity", first: str | None = None, last: str | None = None) -> DataFrame:
    """entity, day, value of a wide CSV (a row an entity, a column a date) of a folder; of one named <name>_fill where <name> is not there."""
    fs = spark._jvm.org.apache.hadoop.fs
    here = [fs.Path(f"{folder}/{n}.csv") for n in (name, f"{name}_fill")]
    there = [p.toString() for p in here if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    if not there:
        raise FileNotFoundError(f"{folder} has neither {name}.csv nor {name}_fill.csv")
    wide = spark.read.option("header", True).csv(there[0])
    long = unpivoted(wide, key, "day", "value").select(F.col(key).alias("entity"), F.to_date("day").alias("day"), F.expr("try_cast(value as double)").alias("value"))
    return between(long, "day", first, last)


def write_panel(df: DataFrame, names: list[str], path: str, about: dict | None = None) -> dict:
    """Writes the features of a panel, and beside them a JSON line of what is known of them: names, rows, each one's coverage over all cells, and `about`. Coverage is counted in
    the job that writes, so the panel is computed once; it is returned too."""
    seen = Observation()
    counted = df.select("entity", "period", *names).observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(n).alias(f"n{i}") for i, n in enumerate(names)])
    counted.write.mode("overwrite").parquet(f"{path}/data")
    got = seen.get
    known = {**(about or {}), "features": names, "rows": got["rows"], "coverage": {n: got[f"n{i}"] / max(1, got["rows"]) for i, n in enumerate(names)}}
    df.sparkSession.createDataFrame([(json.dumps(known, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return known


def read_panel(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The features asked for (all without), and what is known of the panel; a feature that is not there is an error."""
    known = json.loads(spark.read.text(f"{path}/about").first().value)
    return features_of(spark.read.parquet(f"{path}/data"), names or known["features"]), known
