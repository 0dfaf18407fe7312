"""Queries of returns, periods and portfolios by days; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import returns
from ..sources.panel import dense, part_panel, table
from .operator_sql import avg_rank
from .reports import R, _DAYS, c, daily, panel_sql, report

#: Daily values of customers (in units of 9,700, so that means have no few-digit values), and their mean as an index.
_ORDERS = "od AS (SELECT o_custkey AS entity, o_orderdate::DATE AS day, sum(round(o_totalprice * 100)::BIGINT)::BIGINT::DOUBLE / 970000::DOUBLE AS v FROM orders GROUP BY 1, 2), ix AS (SELECT day, avg(v) AS i FROM od GROUP BY 1)"
_PERIOD = "CASE WHEN month({d}) BETWEEN 5 AND 8 THEN make_date(year({d}), 3, 31) WHEN month({d}) IN (9, 10) THEN make_date(year({d}), 6, 30) ELSE make_date(year({d}) - CASE WHEN month({d}) >= 11 THEN 0 ELSE 1 END, 9, 30) END"
_TIMES = "CASE month({p}) WHEN 3 THEN 3 WHEN 6 THEN 6 ELSE 2 END"


def _orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("day"), F.round(c("o_totalprice") * 100).cast("long").alias("v"))
    return o.groupBy("entity", "day").agg((F.sum("v").cast("double") / 970_000).alias("v"))


def _index(days: DataFrame) -> DataFrame:
    return days.groupBy("day").agg(F.avg("v").alias("v"))


def _text(x: str):
    return c(x).cast("string").alias(x)


@report(f"WITH {_ORDERS}, q AS (SELECT {_PERIOD.format(d='day')} AS period, sum(i) AS s FROM ix GROUP BY 1) SELECT period::VARCHAR AS period, round(s * {_TIMES.format(p='period')}, 4) AS ret FROM q")
def index_period_return(spark, sf_dir):
    i = _index(_orders(spark, sf_dir)).withColumn("entity", F.lit("index"))
    return returns.period_return(i, "v").select(_text("period"), R("v", 4).alias("ret"))


@report(f"WITH {_ORDERS}, q AS (SELECT entity, {_PERIOD.format(d='day')} AS period, sum(v - i) AS s FROM od JOIN ix USING (day) GROUP BY 1, 2) SELECT entity, period::VARCHAR AS period, round(s * {_TIMES.format(p='period')}, 4) + 0 AS ret FROM q")
def excess_period_return(spark, sf_dir):
    d = _orders(spark, sf_dir)
    # some values lie half-way between two fourth digits; rounding errors of sums, which change with the order of rows, go first
    return returns.period_return(returns.excess(d, _index(d), "v"), "v").select("entity", _text("period"), R(F.round("v", 9), 4).alias("ret"))


@report(f"WITH {_ORDERS}, ld AS (SELECT max(day) AS day FROM od WHERE month(day) IN (4, 8, 10) GROUP BY year(day), month(day)) SELECT entity, last_day(make_date(year(day), CASE month(day) WHEN 4 THEN 3 WHEN 8 THEN 6 ELSE 9 END, 1))::VARCHAR AS period, round(v, 4) AS v FROM od JOIN ld USING (day)")
def month_end_code(spark, sf_dir):
    return returns.month_end_values(_orders(spark, sf_dir), "v").select("entity", _text("period"), R("v", 4).alias("v"))


_QUARTERS = "qf AS (SELECT o_orderpriority AS entity, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period, count(*) AS n FROM orders GROUP BY 1, 2), dd AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)"


@report(f"WITH {_QUARTERS} SELECT entity, day::VARCHAR AS day, n FROM qf JOIN dd ON period = {_PERIOD.format(d='day')}")
def quarter_to_day(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    quarterly = o.groupBy(c("o_orderpriority").alias("entity"), F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2)).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    days = o.select(F.to_date("o_orderdate").alias("day")).distinct()
    return returns.spread_to_days(quarterly, days).select("entity", _text("day"), "n")


@report(f"WITH {_ORDERS} SELECT day::VARCHAR AS day, round(CASE WHEN row_number() OVER (ORDER BY day DESC) > 5 THEN sum(i) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / 5 END + 1e-9, 6) AS fwd FROM ix")
def index_forward_return(spark, sf_dir):
    i = _index(_orders(spark, sf_dir)).withColumn("entity", F.lit("index"))
    return i.select(_text("day"), R(returns.forward_mean(i, "v", 5) + 1e-9).alias("fwd"))


@report("""WITH cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS n FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderkey % 3 = 0)), st AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders),
pos AS (SELECT st.day, (SELECT count(*) FROM cal WHERE cal.day < st.day) AS before, st.day IN (SELECT day FROM cal) AS known FROM st)
SELECT pos.day::VARCHAR AS day, a.day::VARCHAR AS ahead, b.day::VARCHAR AS back FROM pos LEFT JOIN cal a ON a.n = before + CASE WHEN known THEN 2 ELSE 1 END LEFT JOIN cal b ON b.n = before - 3""")
def trading_day_offset(spark, sf_dir):
    """Two trading days on and three back, on a calendar that lacks some of the days asked for."""
    o = table(spark, sf_dir, "orders")
    calendar = o.where("o_orderkey % 3 = 0").select(F.to_date("o_orderdate").alias("day"))
    days = o.select(F.to_date("o_orderdate").alias("day")).distinct()
    ahead = returns.offset_days(days, calendar, 2).withColumnRenamed("to", "ahead")
    return returns.offset_days(ahead, calendar, -3).select(_text("day"), _text("ahead"), c("to").cast("string").alias("back"))


_ABOVE = " + ".join(f"(pct > {k}::DOUBLE / 10)::INTEGER" for k in range(1, 10))


@report(panel_sql(f"a AS (SELECT period, CASE WHEN fwd_ret IS NOT NULL AND NOT restricted THEN x END AS f, CASE WHEN x IS NOT NULL AND NOT restricted THEN fwd_ret END AS y FROM p), b AS (SELECT *, {avg_rank('f')} / count(f) OVER (PARTITION BY period) AS pct FROM a), g AS (SELECT *, 1 + {_ABOVE} AS bucket FROM b), n AS (SELECT period, count(f) AS n FROM a GROUP BY 1 HAVING period > (SELECT min(period) FROM p)), m AS (SELECT period, bucket, avg(y) AS r FROM g WHERE f IS NOT NULL GROUP BY 1, 2) SELECT n.period::VARCHAR AS period, k.k::INTEGER AS bucket, round(CASE WHEN n.n >= 10 THEN coalesce(r, 0) ELSE 0 END, 6) + 0 AS ret FROM n CROSS JOIN (SELECT unnest(range(1, 11)) AS k) k LEFT JOIN m ON m.period = n.period AND m.bucket = k.k"))
def group_returns_by_threshold(spark, sf_dir):
    return returns.group_returns_by_threshold(part_panel(spark, sf_dir), "x", "fwd_ret").select(_text("period"), "bucket", R("ret").alias("ret"))


@report(f"""WITH {_DAYS}, ds AS (SELECT DISTINCT day FROM dy), es AS (SELECT DISTINCT entity FROM dy), gd AS (SELECT entity, day AS period, ret AS x, CASE WHEN (entity + day(day)) % 5 <> 0 THEN ret / 100 END AS y, entity % 11 = 0 AS restricted FROM es CROSS JOIN ds LEFT JOIN dy USING (entity, day)),
a AS (SELECT *, CASE WHEN NOT restricted AND y IS NOT NULL AND stddev_samp(x) OVER (PARTITION BY period) > 0 THEN x END AS f FROM gd), b AS (SELECT *, {avg_rank('f')} / count(f) OVER (PARTITION BY period) AS pct, count(f) OVER (PARTITION BY period) AS n FROM a),
g AS (SELECT *, coalesce(CASE WHEN n >= 10 THEN (10 - floor((1 - pct) * 10))::INTEGER END, -1) AS grp FROM b), l AS (SELECT *, lag(grp) OVER (PARTITION BY entity ORDER BY period) AS was FROM g),
w AS (SELECT *, first_value(was IGNORE NULLS) OVER (PARTITION BY entity, date_trunc('week', period) ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS bucket FROM l),
r AS (SELECT period, bucket, sum(y) / count(*) AS r FROM w WHERE bucket > 0 GROUP BY 1, 2) SELECT period::VARCHAR AS period, bucket::INTEGER AS bucket, round(sum(r) OVER (PARTITION BY bucket ORDER BY period), 6) + 0 AS cumret FROM r""")
def weekly_rebalanced(spark, sf_dir):
    g = dense(daily(spark, sf_dir).withColumnRenamed("day", "period"))
    g = g.select("entity", "period", c("ret").alias("x"), F.when((c("entity") + F.dayofmonth("period")) % 5 != 0, c("ret") / 100).alias("y"), (c("entity") % 11 == 0).alias("restricted"))
    return returns.weekly_rebalanced(g, "x", "y").select(_text("period"), "bucket", R("cumret").alias("cumret"))
