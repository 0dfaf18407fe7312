"""Queries beyond single operators: flagship, metrics, portfolios, period mapping, ingestion, summaries; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evolve as gp
from ..operators import fitness, metrics, selection
from ..sources.panel import PART_PANEL_SQL, dense, first_disclosed, part_panel, report_period, standalone_quarter, table, unpivoted
from .expression import parse
from .expression import canonical, evaluate
from .operator_sql import avg_rank, change, query, w, z
from .stage import cut

c = F.col
R = lambda x, n=6: (F.round(x, n) + 0.0)

#: name -> (query, SQL or None)
REPORTS: dict[str, tuple] = {}


def report(sql: str | None = None):
    def keep(f):
        REPORTS[f.__name__] = (f, sql)
        return f

    return keep


def panel_sql(rest: str) -> str:
    return f"WITH {PART_PANEL_SQL}, {rest}"


_IC = "SELECT period::VARCHAR AS period, count(*) AS pairs, round(corr(f, y1), 6) + 0 AS ic FROM s WHERE f IS NOT NULL AND y1 IS NOT NULL GROUP BY 1 HAVING count(*) >= 30"


@report(panel_sql(f"g AS (SELECT *, {change('x', 4)} AS g FROM p), s AS (SELECT period, {z('g')} AS f, fwd_ret AS y1 FROM g) {_IC}"))
def flagship_ic(spark: SparkSession, sf_dir: str, min_pairs: int = 30) -> DataFrame:
    """IC per quarter of the standardised yearly growth against the next quarter's return."""
    df = evaluate(part_panel(spark, sf_dir), {"f": parse("cs_zscore(ts_growth_4(x))")})[0]
    return metrics.ic_rows(df, "f", "fwd_ret").where(c("pairs") >= min_pairs).select(c("period").cast("string").alias("period"), "pairs", R("ic").alias("ic"))


_PAIRS = "pr AS (SELECT *, CASE WHEN fwd_ret IS NOT NULL THEN x END AS a, CASE WHEN x IS NOT NULL THEN fwd_ret END AS b FROM p)"
_RANKED = f"{_PAIRS}, rk AS (SELECT *, {avg_rank('a')} AS ra, {avg_rank('b')} AS rb, count(a) OVER (PARTITION BY period) AS n FROM pr)"


@report(panel_sql(f"{_RANKED}, ic AS (SELECT period, corr(ra, rb) AS ic FROM rk WHERE a IS NOT NULL GROUP BY 1) SELECT round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) AS icir, count(ic) AS periods FROM ic"))
def metric_rank_icir(spark, sf_dir):
    s = metrics.icir(metrics.ic_rows(part_panel(spark, sf_dir), "x", "fwd_ret", "spearman"))
    return s.select(R("mean_ic").alias("mean_ic"), R("icir").alias("icir"), "periods")


_COVER = "cv AS (SELECT period, count(x) FILTER (NOT restricted) / nullif(count(*) FILTER (NOT restricted), 0)::DOUBLE AS coverage FROM p GROUP BY 1), mc AS (SELECT avg(coverage) AS m FROM cv)"


@report(panel_sql(f"{_COVER} SELECT entity, qidx, round(CASE WHEN NOT restricted AND coverage >= 0.6 AND m >= 0.6 THEN x END, 6) AS x FROM p JOIN cv USING (period), mc"))
def mask_coverage(spark, sf_dir):
    return metrics.masked(part_panel(spark, sf_dir), "x", 0.6).select("entity", "qidx", R("x").alias("x"))


@report(panel_sql(f"{_COVER}, k AS (SELECT period, CASE WHEN NOT restricted AND coverage >= 0.6 AND m >= 0.6 THEN x END AS f, fwd_ret AS y FROM p JOIN cv USING (period), mc), ic AS (SELECT period, corr(f, y) AS ic FROM k WHERE f IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) >= 30), n AS (SELECT count(DISTINCT period) AS n FROM p WHERE fwd_ret IS NOT NULL) SELECT round(CASE WHEN count(ic) > 0 AND count(ic) >= ceil(2/3::DOUBLE * any_value(n)) THEN abs(avg(ic)) ELSE -1 END, 6) AS fitness, count(ic) AS valid FROM n LEFT JOIN ic ON true"))
def metric_ic(spark, sf_dir):
    return metrics.fitness(part_panel(spark, sf_dir), "x", "fwd_ret", min_pairs=30, least=0.6).select(R("fitness").alias("fitness"), "valid")


_HALF = "hf AS (SELECT *, ra / n AS pct FROM rk WHERE a IS NOT NULL)"
_HIC = "{n} AS (SELECT avg(ic) AS {n} FROM (SELECT corr(qa, qb) AS ic FROM (SELECT period, {qa} AS qa, {qb} AS qb FROM hf WHERE {w}) GROUP BY period))"


@report(panel_sql(f"{_RANKED}, {_HALF}, al AS (SELECT avg(ic) AS al FROM (SELECT corr(ra, rb) AS ic FROM hf GROUP BY period)), " + ", ".join(_HIC.format(n=n, qa=avg_rank("a"), qb=avg_rank("b"), w=w_) for n, w_ in (("up", "pct > 0.5"), ("down", "pct <= 0.5"))) + " SELECT round(abs(CASE WHEN al >= 0 THEN up ELSE down END), 6) AS long_only_ic FROM al, up, down"))
def metric_long_only(spark, sf_dir):
    return metrics.long_only_ic(part_panel(spark, sf_dir), "x", "fwd_ret").select(R("long_only_ic").alias("long_only_ic"))


_BUCKETS = f"bk AS (SELECT *, (10 - floor((1 - {avg_rank('x')} / count(x) OVER (PARTITION BY period)) * 10))::INTEGER AS bucket FROM p), gr AS (SELECT period, bucket, avg(fwd_ret) AS ret, count(fwd_ret) AS members FROM bk WHERE x IS NOT NULL GROUP BY 1, 2)"
_STATS = f"{_BUCKETS}, cu AS (SELECT *, sum(ret) OVER (PARTITION BY bucket ORDER BY period) AS cum FROM gr), dd AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY bucket ORDER BY period)) - cum AS dd FROM cu)"


@report(panel_sql(f"{_BUCKETS} SELECT period::VARCHAR AS period, bucket, round(ret, 6) AS ret, members FROM gr"))
def group_returns(spark, sf_dir):
    return metrics.group_returns(part_panel(spark, sf_dir), "x", "fwd_ret").select(c("period").cast("string").alias("period"), "bucket", R("ret").alias("ret"), "members")


@report(panel_sql(f"{_STATS} SELECT bucket, round(avg(ret) * 4, 6) AS annual, round(avg(ret) / stddev_pop(ret) * sqrt(4), 6) AS sharpe, round(max(dd), 6) AS drawdown FROM dd GROUP BY 1"))
def portfolio_stats(spark, sf_dir):
    s = metrics.portfolio_stats(metrics.group_returns(part_panel(spark, sf_dir), "x", "fwd_ret"), periods=4)
    return s.select("bucket", R("annual").alias("annual"), R("sharpe").alias("sharpe"), R("drawdown").alias("drawdown"))


#: The hedged side's figure of buckets `bucket` and returns `r` of rows of k, over 4 periods a year.
_HEDGE = """hb AS (SELECT period, count(*) FILTER (bucket = 1) AS n1, sum(r) FILTER (bucket = 1) AS s1, count(*) FILTER (bucket = 10) AS n2, sum(r) FILTER (bucket = 10) AS s2, count(r) AS any_r FROM bk GROUP BY 1),
hr AS (SELECT CASE WHEN n1 > 0 AND any_r > 0 THEN coalesce(s1, 0) / n1 END AS lo, CASE WHEN n2 > 0 AND any_r > 0 THEN coalesce(s2, 0) / n2 END AS hi FROM hb)
SELECT round(coalesce(CASE WHEN coalesce(sum(lo), 0) > coalesce(sum(hi), 0) THEN avg(lo) / stddev_samp(lo) ELSE avg(hi) / stddev_samp(hi) END * sqrt(4), -100), 6) AS {out} FROM hr"""


# factor f (masked), label y1 and its residual yr on the style y, and their percentile ranks among a date's own values
_K = "k AS (SELECT period, entity, y AS style, fwd_ret AS y1, CASE WHEN NOT restricted AND coverage >= 0.6 AND m >= 0.6 THEN x END AS f FROM p JOIN cv USING (period), mc)"
_FIT = "ft AS (SELECT period, regr_slope(y1, style) AS b, avg(y1) FILTER (style IS NOT NULL) AS my, avg(style) FILTER (y1 IS NOT NULL) AS ms FROM k GROUP BY 1), kr AS (SELECT k.*, y1 - my - b * (style - ms) AS yr FROM k JOIN ft USING (period))"
_OWN = lambda x, over="period": f"({avg_rank(x, over)} / count({x}) OVER (PARTITION BY {over}))"
_PCT = f"pk AS (SELECT *, {_OWN('f')} AS pf, {_OWN('y1')} AS p1, {_OWN('yr')} AS pr FROM kr)"
_METRIC = lambda rest: panel_sql(f"{_COVER}, {_K}, {_FIT}, {_PCT}, {rest}")
_ICS = lambda a, b: f"ic AS (SELECT period, corr({a}, {b}) AS ic FROM pk WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)"


#: The SQL of the metrics, after what _METRIC puts before it.
_FIGURES: dict[str, str] = {}


def _metric(name: str, sql: str):
    _FIGURES[name] = sql

    def run(spark, sf_dir):
        return fitness.metric(name, part_panel(spark, sf_dir), "x", "fwd_ret", styles=["y"], least=0.6).select(R("value").alias("value"))

    run.__name__ = f"metric_{name}"
    report(_METRIC(sql))(run)


_metric("pearson", f"{_ICS('f', 'y1')} SELECT round(coalesce(abs(avg(ic)), 0), 6) AS value FROM ic")
_metric("alert_pearson", f"{_ICS('f', 'y1')} SELECT round(coalesce(avg(ic), -1), 6) + 0 AS value FROM ic")
_metric("spearman", f"{_ICS('pf', 'p1')} SELECT round(coalesce(abs(avg(ic)), 0), 6) AS value FROM ic")
_metric("alert_ic", f"{_ICS('pf', 'p1')} SELECT round(coalesce(avg(ic), -1), 6) + 0 AS value FROM ic")
_metric("neutral_ic", f"{_ICS('pf', 'pr')} SELECT round(coalesce(abs(avg(ic)), 0), 6) AS value FROM ic")
_metric("alert_icir", f"""q AS (SELECT *, CASE WHEN p1 IS NOT NULL THEN pf END AS a, CASE WHEN pf IS NOT NULL THEN p1 END AS b FROM pk), qr AS (SELECT period, {avg_rank('a')} AS ra, {avg_rank('b')} AS rb FROM q WHERE a IS NOT NULL),
ic AS (SELECT corr(ra, rb) AS ic FROM qr GROUP BY period HAVING count(*) >= 2) SELECT round(coalesce(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), -100), 6) + 0 AS value FROM ic""")
_SIDES = f"sd AS (SELECT *, CASE WHEN pf > 0.5 THEN yr END AS yt, CASE WHEN pf < 0.5 THEN yr END AS yb FROM pk), sr AS (SELECT *, {_OWN('yt')} AS pt, {_OWN('yb')} AS pb FROM sd), hv AS (SELECT period, corr(pf, pr) AS ic, corr(pf, pt) AS top, corr(pf, pb) AS bottom FROM sr GROUP BY 1)"
_metric("long_only_neutral_ic", f"{_SIDES} SELECT round(coalesce(abs(CASE WHEN avg(ic) > 0 THEN avg(top) ELSE avg(bottom) END), 0), 6) AS value FROM hv")
_metric("hedge_sharpe", "bk AS (SELECT period, y1 AS r, (10 - floor((1 - pf) * 10))::INTEGER AS bucket FROM pk), " + _HEDGE.format(out="value"))
_metric("neutral_hedge_sharpe", "bk AS (SELECT period, yr AS r, (10 - floor((1 - pf) * 10))::INTEGER AS bucket FROM pk), " + _HEDGE.format(out="value"))


@report(_METRIC(f"{_SIDES} SELECT period::VARCHAR AS period, round(ic, 6) + 0 AS ic, round(CASE WHEN (SELECT avg(ic) FROM hv) > 0 THEN top ELSE -bottom END, 6) + 0 AS long_ic FROM hv"))
def two_ics(spark, sf_dir):
    """Whole and long-only IC of each date, as the selection of factors goes by."""
    d = fitness.neutral(metrics.masked(part_panel(spark, sf_dir), "x", 0.6), "fwd_ret", ["y"])
    return fitness.two_ics(d, "x", "_residual").select(c("period").cast("string").alias("period"), R("ic").alias("ic"), R("long_ic").alias("long_ic"))


@report(_METRIC(f"{_SIDES} SELECT period::VARCHAR AS period, entity, round(CASE WHEN (SELECT avg(ic) FROM hv) > 0 THEN CASE WHEN pf >= 0.5 THEN f END ELSE CASE WHEN pf <= 0.5 THEN -f END END, 6) + 0 AS f FROM pk"))
def long_only_mask(spark, sf_dir):
    d = fitness.neutral(metrics.masked(part_panel(spark, sf_dir), "x", 0.6), "fwd_ret", ["y"])
    return fitness.long_only_mask(d, "x", "_residual").select(c("period").cast("string").alias("period"), "entity", R("x").alias("f"))


@report(panel_sql(f"{_BUCKETS}, mm AS (SELECT bucket, avg(ret) AS r FROM gr GROUP BY 1) SELECT round(sum(abs(bucket - k)) / 50::DOUBLE, 6) AS mono FROM (SELECT bucket, rank() OVER (ORDER BY r) AS k FROM mm)"))
def monotonicity(spark, sf_dir):
    return metrics.monotonicity(metrics.group_returns(part_panel(spark, sf_dir), "x", "fwd_ret")).select(R("mono").alias("mono"))


@report(panel_sql(f"{_BUCKETS}, mm AS (SELECT bucket, avg(ret) AS r FROM gr WHERE bucket <= 5 GROUP BY 1) SELECT round(sum(abs(bucket - k)) / 12::DOUBLE, 6) AS mono FROM (SELECT bucket, rank() OVER (ORDER BY r DESC) AS k FROM mm)"))
def monotonicity_long_only(spark, sf_dir):
    return metrics.monotonicity(metrics.group_returns(part_panel(spark, sf_dir), "x", "fwd_ret"), False, "longonly").select(R("mono").alias("mono"))


@report(panel_sql("q AS (SELECT quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM p) SELECT entity, qidx, round(CASE WHEN x IS NOT NULL THEN greatest(lo, least(hi, x)) END, 6) AS x FROM p, q"))
def winsor_whole(spark, sf_dir):
    return metrics.winsorized(part_panel(spark, sf_dir), "x").select("entity", "qidx", R("x").alias("x"))


@report(panel_sql("SELECT entity, round(count(*) FILTER (y > 0) / count(*)::DOUBLE, 6) AS positive, round(coalesce(sum(x * (y + 4)), 0) / CASE WHEN coalesce(sum(y + 4), 0) = 0 THEN 1 ELSE sum(y + 4) END, 4) + 0 AS weighted FROM p GROUP BY 1"))
def entity_figures(spark, sf_dir):
    g = part_panel(spark, sf_dir).withColumn("w", c("y") + 4).groupBy("entity").agg(metrics.positive_share("y").alias("positive"), metrics.weighted_sum("x", "w").alias("weighted"))
    return g.select("entity", R("positive").alias("positive"), R("weighted", 4).alias("weighted"))


@report(panel_sql("ok AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), ft AS (SELECT period, CASE WHEN var_pop(y) > 0 THEN covar_pop(x, y) / var_pop(y) ELSE 0 END AS b, avg(x) AS mx, avg(y) AS my FROM ok GROUP BY period HAVING count(*) >= 2) SELECT p.entity, p.qidx, round(p.x - (ft.b * (p.y - ft.my) + ft.mx), 5) + 0 AS residual FROM p LEFT JOIN ft ON ft.period = p.period"))
def neutral_residual(spark, sf_dir):
    p = part_panel(spark, sf_dir)
    r = metrics.residual_of_many(p, "x", ["y"])
    return p.select("entity", "period", "qidx").join(r, ["entity", "period"]).select("entity", "qidx", R("residual", 5).alias("residual"))


@report(panel_sql("e AS (SELECT period, corr(x, y) AS xy, corr(x, fwd_ret) AS xr, corr(y, fwd_ret) AS yr FROM p GROUP BY 1) SELECT a, b, round(v, 6) AS corr FROM (SELECT 'x' AS a, 'y' AS b, avg(CASE WHEN isfinite(xy) THEN xy END) AS v FROM e UNION ALL SELECT 'x', 'fwd_ret', avg(CASE WHEN isfinite(xr) THEN xr END) FROM e UNION ALL SELECT 'y', 'fwd_ret', avg(CASE WHEN isfinite(yr) THEN yr END) FROM e)"))
def factor_correlations(spark, sf_dir):
    return metrics.correlations(part_panel(spark, sf_dir), ["x", "y", "fwd_ret"]).select("a", "b", R("corr").alias("corr"))


_DAYS = "dy AS (SELECT user_id AS entity, ts::DATE AS day, sum(round(value * 100)::BIGINT)::BIGINT::DOUBLE / 100::DOUBLE AS ret FROM events GROUP BY 1, 2)"


def daily(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return e.groupBy(c("user_id").alias("entity"), F.to_date("ts").alias("day")).agg((F.sum(F.round(c("value") * 100).cast("long")).cast("double") / 100).alias("ret"))


@report("WITH o AS (SELECT o_custkey AS entity, o_orderdate::DATE AS d, round(o_totalprice * 100)::BIGINT AS v FROM orders) SELECT entity, CASE WHEN month(d) BETWEEN 5 AND 8 THEN make_date(year(d), 3, 31) WHEN month(d) IN (9, 10) THEN make_date(year(d), 6, 30) ELSE make_date(year(d) - CASE WHEN month(d) >= 11 THEN 0 ELSE 1 END, 9, 30) END::VARCHAR AS period, round(sum(v)::DOUBLE / 100 * any_value(CASE WHEN month(d) BETWEEN 5 AND 8 THEN 3 WHEN month(d) IN (9, 10) THEN 6 ELSE 2 END), 4) AS fwd FROM o GROUP BY 1, 2")
def forward_by_report_period(spark, sf_dir):
    """Daily values summed over the window in which a quarter's report is in force, to a year's scale."""
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d"), F.round(c("o_totalprice") * 100).cast("long").alias("v"))
    k = F.when(F.month("period") == 3, 3).when(F.month("period") == 6, 6).otherwise(2)
    g = o.withColumn("period", report_period(c("d"))).groupBy("entity", "period").agg(F.sum("v").alias("v"))
    return g.select("entity", c("period").cast("string").alias("period"), R(c("v").cast("double") / 100 * k, 4).alias("fwd"))


@report(f"WITH {_DAYS}, ds AS (SELECT DISTINCT day FROM dy), es AS (SELECT DISTINCT entity FROM dy), gd AS (SELECT entity, day, ret FROM es CROSS JOIN ds LEFT JOIN dy USING (entity, day)), f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY day DESC) > 5 THEN sum(ret) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / 5 END AS f FROM gd), q AS (SELECT day, quantile_cont(f, 0.025) AS lo, quantile_cont(f, 0.975) AS hi FROM f GROUP BY 1) SELECT entity, day::VARCHAR AS day, round(CASE WHEN f IS NOT NULL THEN greatest(lo, least(hi, f)) END, 6) AS fwd FROM f JOIN q USING (day)")
def winsor_forward_return(spark, sf_dir):
    """Mean of the next five days, held to each day's 2.5 and 97.5 percentiles."""
    g = dense(daily(spark, sf_dir).withColumnRenamed("day", "period"))
    by = Window.partitionBy("entity").orderBy("qidx")
    last = F.lead(F.lit(1), 5).over(by)
    f = g.withColumn("f", F.when(last.isNotNull(), F.sum("ret").over(by.rowsBetween(1, 5)) / 5))
    f = cut(f.select("entity", "period", "f"))
    held = f.groupBy("period").agg(*[F.percentile("f", F.lit(q)).alias(n) for n, q in (("lo", 0.025), ("hi", 0.975))])  # one row a day
    return f.join(F.broadcast(held), "period").select("entity", c("period").cast("string").alias("day"), R(F.when(c("f").isNotNull(), F.greatest("lo", F.least("hi", "f")))).alias("fwd"))


@report(f"WITH {_DAYS}, s AS (SELECT entity, day, CASE WHEN ret > 300 THEN 1 ELSE 0 END AS restricted FROM dy) SELECT entity, (date_trunc('month', day)::DATE)::VARCHAR AS period, avg(CASE WHEN restricted = 0 THEN 1 ELSE 0 END) <= 0.5 AS restricted FROM s GROUP BY 1, 2")
def restricted_by_period(spark, sf_dir):
    d = daily(spark, sf_dir)
    open_ = F.avg(F.when(c("ret") > 300, 0).otherwise(1))
    return d.groupBy("entity", F.to_date(F.date_trunc("month", "day")).cast("string").alias("period")).agg((open_ <= 0.5).alias("restricted"))


@report("WITH o AS (SELECT o_custkey AS entity, o_orderdate::DATE AS d, o_orderkey AS k, o_orderpriority AS code FROM orders), per AS (SELECT DISTINCT (date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period FROM o), e AS (SELECT DISTINCT entity FROM o) SELECT entity, period::VARCHAR AS period, (SELECT arg_max(code, (d, k)) FROM o WHERE o.entity = e.entity AND o.d <= per.period) AS code FROM e, per")
def asof_code(spark, sf_dir):
    """The last code known at each quarter's end: the last of each quarter, carried forward on the dense calendar."""
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("d"), "o_orderkey", "o_orderpriority")
    end = F.last_day(F.add_months(F.date_trunc("quarter", "d"), 2))
    last = o.groupBy("entity", end.alias("period")).agg(F.max_by("o_orderpriority", F.struct("d", "o_orderkey")).alias("code"))
    w_ = Window.partitionBy("entity").orderBy("qidx").rowsBetween(Window.unboundedPreceding, 0)
    return dense(last).select("entity", c("period").cast("string").alias("period"), F.last("code", ignorenulls=True).over(w_).alias("code"))


_YTD = "cq AS (SELECT o_custkey AS entity, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS v FROM orders GROUP BY 1, 2, 3), yt AS (SELECT entity, year, quarter, sum(v) OVER (PARTITION BY entity, year ORDER BY quarter)::BIGINT AS ytd FROM cq)"


def _ytd(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    q = o.groupBy(c("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum(F.round(c("o_totalprice") * 100).cast("long")).alias("v"))
    return q.select("entity", "year", "quarter", F.sum("v").over(Window.partitionBy("entity", "year").orderBy("quarter")).alias("ytd"))


@report(f"WITH {_YTD} SELECT entity, year::BIGINT AS year, quarter::BIGINT AS quarter, CASE WHEN quarter = 1 THEN ytd ELSE ytd - lag(ytd) OVER (PARTITION BY entity, year ORDER BY quarter) END AS v FROM yt")
def ytd_to_quarter(spark, sf_dir):
    s = standalone_quarter(_ytd(spark, sf_dir), ["ytd"])
    return s.select("entity", c("year").cast("long").alias("year"), c("quarter").cast("long").alias("quarter"), c("ytd").alias("v"))


@report(query(f"CASE WHEN count(x) {w(4)} = 4 THEN sum(x) {w(4)} END"))
def ttm_sum(spark, sf_dir):
    w_ = Window.partitionBy("entity").orderBy("qidx").rowsBetween(-3, 0)
    return part_panel(spark, sf_dir).select("entity", "qidx", R(F.when(F.count("x").over(w_) == 4, F.sum("x").over(w_))).alias("value"))


@report("SELECT o_custkey AS entity, quarter::BIGINT AS quarter, o_orderkey FROM (SELECT *, quarter(o_orderdate) AS quarter, row_number() OVER (PARTITION BY o_custkey, quarter(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_disclosed_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("quarter", F.quarter("o_orderdate").cast("long"))
    return first_disclosed(o, ["o_custkey", "quarter"], [c("o_orderdate"), c("o_orderkey")]).select(c("o_custkey").alias("entity"), "quarter", "o_orderkey")


@report("SELECT r_regionkey, name, value FROM (UNPIVOT (SELECT r_regionkey, count(*) FILTER (n_nationkey % 2 = 0) AS even, count(*) FILTER (n_nationkey % 2 = 1) AS odd FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1) ON even, odd INTO NAME name VALUE value)")
def wide_to_long(spark, sf_dir):
    j = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), c("n_regionkey") == c("r_regionkey"))
    wide = j.groupBy("r_regionkey").agg(F.count(F.when(c("n_nationkey") % 2 == 0, 1)).alias("even"), F.count(F.when(c("n_nationkey") % 2 == 1, 1)).alias("odd"))
    return unpivoted(wide, "r_regionkey", "name", "value")


#: Parts as candidates: a generation by size, a formulation by brand and type, the price as score.
_CANDS = "cd AS (SELECT p_partkey AS idx, p_size % 5 AS generation, p_brand || '-' || p_type AS formulation, p_retailprice / 10000 - 0.1::DOUBLE AS ic, CASE p_partkey % 3 WHEN 0 THEN 'constant_only' WHEN 1 THEN 'contains_step1' ELSE 'base_only' END AS kind FROM part)"


def _candidates(spark, sf_dir) -> DataFrame:
    features = F.when(c("p_partkey") % 3 == 0, F.array().cast("array<string>")).when(c("p_partkey") % 3 == 1, F.array(F.lit("f0"), F.lit("s1"))).otherwise(F.array(F.lit("f0")))
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("idx"), (c("p_size") % 5).alias("generation"), F.concat_ws("-", "p_brand", "p_type").alias("formulation"), (c("p_retailprice") / 10000 - 0.1).alias("ic"), selection.dependency_kind(features, ["f0"], ["s1"]).alias("kind")
    )


@report(f"WITH {_CANDS}, f AS (SELECT *, row_number() OVER (PARTITION BY formulation ORDER BY generation, idx) AS n FROM cd WHERE generation <= 3) SELECT idx, formulation, round(ic, 6) AS ic FROM f WHERE n = 1 AND abs(ic) > 0.001 AND kind = 'contains_step1'")
def select_final(spark, sf_dir):
    return selection.select_final(_candidates(spark, sf_dir), 3, 0.001).select("idx", "formulation", R("ic").alias("ic"))


@report(f"WITH {_CANDS} SELECT generation::BIGINT AS generation, count(*) AS n, count(DISTINCT formulation) AS n_formulas, round(avg(ic), 6) + 0 AS avg_ic, round(max(ic), 6) + 0 AS best_ic, arg_max(formulation, (ic, idx)) AS best FROM cd GROUP BY ROLLUP (generation)")
def generation_summary(spark, sf_dir):
    return selection.generation_summary(_candidates(spark, sf_dir)).select(c("generation").cast("long").alias("generation"), "n", "n_formulas", R("avg_ic").alias("avg_ic"), R("best_ic").alias("best_ic"), "best")


@report(f"WITH {_CANDS}, s AS (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY idx) AS k FROM cd) SELECT idx, generation::BIGINT AS generation FROM s ORDER BY k, generation LIMIT 40")
def stratified_sample(spark, sf_dir):
    return selection.stratified(_candidates(spark, sf_dir), c("generation"), [c("idx")], 40).select("idx", c("generation").cast("long").alias("generation"))


@report(f"WITH {_CANDS} SELECT kind AS outcome, count(*) AS n, round(min(ic), 6) + 0 AS lo, round(avg(ic), 6) + 0 AS mean, round(max(ic), 6) + 0 AS hi FROM cd GROUP BY 1")
def audit_counts(spark, sf_dir):
    a = selection.audit_counts(_candidates(spark, sf_dir).withColumnsRenamed({"kind": "outcome", "ic": "score"}))
    return a.select("outcome", "n", *[R(x).alias(x) for x in ("lo", "mean", "hi")])


@report(panel_sql("u AS (SELECT qidx, 'x' AS feature, x AS v FROM p UNION ALL SELECT qidx, 'y', y FROM p UNION ALL SELECT qidx, 'fwd_ret', fwd_ret FROM p) SELECT feature, qidx, round(count(v) / count(*)::DOUBLE, 6) AS coverage FROM u GROUP BY 1, 2"))
def input_coverage(spark, sf_dir):
    u = part_panel(spark, sf_dir).select("qidx", "entity", "x", "y", "fwd_ret").unpivot(["qidx", "entity"], ["x", "y", "fwd_ret"], "feature", "v")
    return u.groupBy("feature", "qidx").agg(R(F.count("v") / F.count(F.lit(1))).alias("coverage"))


@report(None)
def evolution(spark, sf_dir):
    """A seeded search of the module's own size; the records of all generations."""
    panel = part_panel(spark, sf_dir).select("entity", "period", "qidx", "industry", "x", "y", "fwd_ret")
    ops = ["cs_add", "cs_sub", "cs_mul", "cs_div", "cs_rank", "cs_zscore", "cs_abs", "cs_neg", "cs_demean", "ts_mean_4", "ts_delta_1", "ts_std_2", "ts_delay_1", "ts_max_4", "ts_min_4", "ts_pct_1"]
    records = gp.evolve(panel, ops, ["x", "y"], rule=gp.Rule(coverage=0.5))
    return spark.createDataFrame(records, "generation int, idx int, formulation string, ic double, method string, n_nodes int")


#: Programs that a search scores at once, and the same in SQL.
_PROGRAMS = {"x": "x", "cs_add(x, y)": "x + y", "cs_neg(y)": "-y", "cs_zscore(x)": "(x - avg(x) OVER (PARTITION BY period)) / stddev_samp(x) OVER (PARTITION BY period)", "cs_mul(x, x)": "x * x"}


def _searched(name: str, picked: str):
    def run(spark, sf_dir):
        rule = gp.Rule(name, 0.6, 2, 0.0, ("y",))
        got = gp.score(part_panel(spark, sf_dir), [parse(t) for t in _PROGRAMS], "fwd_ret", rule=rule)
        rows = [(t, got[str(canonical(parse(t)))]) for t in _PROGRAMS]
        return spark.createDataFrame(rows, "program string, value double").select("program", R("value").alias("value"))

    run.__name__ = f"search_by_{name}"
    parts = f"{_COVER}, {_K}, {_FIT}, {_PCT}, {picked}".replace("y AS style", "y0 AS style").replace("FROM p ", "FROM pz ")
    of = lambda text, sql: f"SELECT '{text}' AS program, value FROM (WITH pz AS (SELECT entity, period, restricted, fwd_ret, y AS y0, {sql} AS x FROM p), {parts})"
    report(panel_sql("every AS (" + " UNION ALL ".join(of(*pair) for pair in _PROGRAMS.items()) + ") SELECT program, value FROM every"))(run)


_searched("pearson", f"{_ICS('f', 'y1')} SELECT round(coalesce(abs(avg(ic)), -1), 6) AS value FROM ic")
_searched("spearman", f"{_ICS('pf', 'p1')} SELECT round(coalesce(abs(avg(ic)), -1), 6) AS value FROM ic")
_searched("neutral_ic", f"{_ICS('pf', 'pr')} SELECT round(coalesce(abs(avg(ic)), -1), 6) AS value FROM ic")
_searched("alert_ic", f"{_ICS('pf', 'p1')} SELECT round(coalesce(avg(ic), -1), 6) + 0 AS value FROM ic")
for _name in ("hedge_sharpe", "neutral_hedge_sharpe", "alert_icir", "long_only_neutral_ic"):
    _searched(_name, _FIGURES[_name])


_PD = "pd AS (SELECT x, y * 1000 AS y, y * 1000 - x AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL)"


@report(panel_sql(f"{_PD}, rr AS (SELECT d, {avg_rank('x', '1')} AS ra, {avg_rank('y', '1')} AS rb, CASE WHEN d <> 0 THEN rank() OVER (PARTITION BY d <> 0 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY d <> 0, abs(d)) - 1) / 2::DOUBLE END AS rd FROM pd) SELECT count(*) AS pairs, round(avg(d), 4) AS mean_diff, round(avg(abs(d)), 4) AS mad, round(quantile_cont(abs(d), 0.95), 4) AS p95, round(corr(ra, rb), 6) AS spearman, count(rd) AS nonzero, coalesce(sum(rd) FILTER (d > 0), 0)::DOUBLE AS w_plus, round((coalesce(sum(rd) FILTER (d > 0), 0) - sum(rd) / 2) / (sqrt(sum(rd * rd)) / 2), 6) AS z FROM rr"))
def paired_stats(spark, sf_dir):
    """Two scores of all cells of the panel, compared."""
    s = selection.paired_stats(part_panel(spark, sf_dir).withColumn("y", c("y") * 1000), "x", "y")
    return s.select("pairs", *[R(n, 4).alias(n) for n in ("mean_diff", "mad", "p95")], R("spearman").alias("spearman"), "nonzero", "w_plus", R("z").alias("z"))


@report(None)
def bootstrap_interval(spark, sf_dir):
    return selection.bootstrap_mean(part_panel(spark, sf_dir).withColumn("cell", F.xxhash64("entity", "qidx")), "cell", "x")


def _guarded(a: str, b: str) -> str:
    return f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 1e-12 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


def _taken(i: int, rest: str, names: str) -> str:
    """The i-th choice t{i} by what is left of the label in `rest`, among `names`, and n{i}, the names that stay."""
    per = f"SELECT name, period, {_guarded('v', 'r')} AS ic FROM long JOIN {rest} USING (entity, period) WHERE r IS NOT NULL AND name IN ({names}) GROUP BY ALL"
    like = f"SELECT b.name, b.period, {_guarded('a.v', 'b.v')} AS k FROM long a JOIN t{i} ON a.name = t{i}.name JOIN long b ON a.entity = b.entity AND a.period = b.period WHERE b.name <> a.name GROUP BY ALL"
    return (
        f"i{i} AS (SELECT name, avg(ic) AS m FROM ({per}) GROUP BY 1 HAVING count(ic) > 0), t{i} AS (SELECT * FROM i{i} ORDER BY abs(m) DESC, name DESC LIMIT 1), "
        f"n{i} AS (SELECT name FROM i{i} JOIN (SELECT name, coalesce(avg(k), 0) AS k FROM ({like}) GROUP BY 1) USING (name) WHERE abs(k) <= 0.9)"
    )


_SELECTION = f"""f AS (SELECT entity, period, fwd_ret AS r, {avg_rank('x')} AS f1, {z('y')} AS f2, avg(x) {w(5)} AS f3, y - lag(y) OVER (PARTITION BY entity ORDER BY qidx) AS f4 FROM p),
long AS (SELECT entity, period, name, v FROM (SELECT entity, period, f1, f2, f3, f4 FROM f) UNPIVOT (v FOR name IN (f1, f2, f3, f4))),
{_taken(1, 'f', "'f1', 'f2', 'f3', 'f4'")},
q1 AS (SELECT f.entity, f.period, v AS a, r FROM f JOIN long USING (entity, period) JOIN t1 ON long.name = t1.name WHERE r IS NOT NULL),
g1 AS (SELECT period, avg(a) AS ma, avg(r) AS mr, CASE WHEN var_pop(a) > 0 THEN covar_pop(a, r) / var_pop(a) ELSE 0 END AS s FROM q1 GROUP BY 1 HAVING count(*) >= 2),
r1 AS (SELECT entity, period, r - mr - s * (a - ma) AS r FROM q1 JOIN g1 USING (period)),
{_taken(2, 'r1', 'SELECT name FROM n1')},
q2 AS (SELECT q1.entity, q1.period, a, v AS b, r FROM q1 JOIN long USING (entity, period) JOIN t2 ON long.name = t2.name),
g2 AS (SELECT period, avg(a) AS ma, avg(b) AS mb, avg(r) AS mr, CASE WHEN var_pop(a) > 0 THEN covar_pop(a, r) / var_pop(a) ELSE 0 END AS s, CASE WHEN var_pop(a) > 0 THEN covar_pop(a, b) / var_pop(a) ELSE 0 END AS sb FROM q2 GROUP BY 1 HAVING count(*) >= 2),
h2 AS (SELECT entity, period, r - mr - s * (a - ma) AS u, b - mb - sb * (a - ma) AS g FROM q2 JOIN g2 USING (period)),
s2 AS (SELECT period, CASE WHEN var_pop(g) > 1e-18 THEN covar_pop(u, g) / var_pop(g) ELSE 0 END AS s FROM h2 GROUP BY 1),
r2 AS (SELECT entity, period, u - s * g AS r FROM h2 JOIN s2 USING (period)),
{_taken(3, 'r2', 'SELECT name FROM n2')}
SELECT name AS factor, round(m, 6) + 0 AS ic FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)"""


@report(panel_sql(_SELECTION))
def forward_selection(spark, sf_dir):
    p = evaluate(part_panel(spark, sf_dir), {n: parse(t) for n, t in {"f1": "cs_rank(x)", "f2": "cs_zscore(y)", "f3": "ts_mean_4(x)", "f4": "ts_delta_1(y)"}.items()})[0]
    return spark.createDataFrame(selection.forward_selection(p, ["f1", "f2", "f3", "f4"], "fwd_ret", [], 0.0, 0.9, 3), "factor string, ic double").select("factor", R("ic").alias("ic"))
