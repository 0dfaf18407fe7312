"""Queries of a search's candidates, of axes, formulas and sets; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates
from ..operators import evolve as gp
from ..sources.formula import with_formulas
from ..sources.panel import between, evaluated, part_panel, shared_dates, table, union_of_axes
from ..sources.results import union_all
from .expression import parse
from .operator_sql import avg_rank, lag, z
from .reports import R, _CANDS, _candidates, c, panel_sql, report

#: The candidates with tokens of an operator across, one along, and a feature; a length; coverage and a Sharpe ratio that some lack.
_FULL = f"WITH {_CANDS}, fc AS (SELECT idx, generation, formulation, kind, p_retailprice / 1000 - 0.95::DOUBLE AS ic, p_size AS length, ['cs_' || (p_size % 3)::VARCHAR, 'ts_mean_' || (p_size % 4)::VARCHAR, 'f' || (p_partkey % 3)::VARCHAR] AS tokens, (p_partkey % 7) / 6::DOUBLE AS coverage, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice / 1000 - p_size / 20::DOUBLE END AS sharpe FROM cd JOIN part ON idx = p_partkey)"


def _full(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        c("p_partkey").alias("idx"), c("p_size").alias("length"), (c("p_retailprice") / 1000 - 0.95).alias("ic"),
        F.array(F.concat(F.lit("cs_"), (c("p_size") % 3).cast("string")), F.concat(F.lit("ts_mean_"), (c("p_size") % 4).cast("string")), F.concat(F.lit("f"), (c("p_partkey") % 3).cast("string"))).alias("tokens"),
        (c("p_partkey") % 7 / 6).alias("coverage"), F.when(c("p_partkey") % 5 > 0, c("p_retailprice") / 1000 - c("p_size") / 20).alias("sharpe"),
    )
    return _candidates(spark, sf_dir).drop("ic").join(p, "idx")


@report(f"{_FULL} SELECT idx, round(ic - (SELECT covar_samp(length, ic) / var_pop(length) FROM fc) * length + 1e-9, 6) + 0 AS adjusted FROM fc")
def parsimony(spark, sf_dir):
    return candidates.parsimonious(_full(spark, sf_dir), "ic", "length").select("idx", R(c("adjusted") + 1e-9).alias("adjusted"))


@report(f"{_FULL}, sc AS (SELECT formulation, arg_max(length / 4::DOUBLE - 1, idx) AS score FROM fc WHERE idx % 2 = 0 GROUP BY 1), j AS (SELECT idx, ic, CASE WHEN score IS NOT NULL AND ic >= 0 THEN 0.5 * (1 - least(10, greatest(0, score)) / 10) ELSE 0 END AS penalty FROM fc LEFT JOIN sc USING (formulation)) SELECT idx, round(penalty, 6) AS penalty, round(ic - penalty + 1e-9, 6) + 0 AS rewarded FROM j")
def penalised_fitness(spark, sf_dir):
    f = _full(spark, sf_dir)
    scores = f.where("idx % 2 = 0").select("formulation", (c("length") / 4 - 1).alias("score"), c("idx").alias("at"))
    return candidates.penalised(f, scores, "formulation", "ic", 0.5).select("idx", R("penalty").alias("penalty"), R(c("rewarded") + 1e-9).alias("rewarded"))


@report(f"{_FULL} SELECT idx FROM fc WHERE ic >= 0.01")
def ic_gate(spark, sf_dir):
    return candidates.gated(_full(spark, sf_dir), "ic", 0.01).select("idx")


@report(f"{_FULL} SELECT idx FROM fc WHERE formulation NOT IN (SELECT formulation FROM fc WHERE idx % 3 = 0)")
def unfinished(spark, sf_dir):
    f = _full(spark, sf_dir)
    return candidates.to_do(f, f.where("idx % 3 = 0"), "formulation").select("idx")


@report(f"{_FULL} SELECT a.idx, round(b.sharpe, 6) AS sharpe FROM fc a LEFT JOIN (SELECT idx, sharpe FROM fc WHERE idx % 4 = 1) b USING (idx)")
def results_joined(spark, sf_dir):
    f = _full(spark, sf_dir)
    return candidates.with_results(f.select("idx"), f.where("idx % 4 = 1").select("idx", "sharpe"), "idx").select("idx", R("sharpe").alias("sharpe"))


@report(f"{_FULL} SELECT formulation, count(DISTINCT length) AS n FROM fc GROUP BY 1 HAVING count(DISTINCT length) > 1")
def inconsistent_candidates(spark, sf_dir):
    return candidates.inconsistent(_full(spark, sf_dir), "formulation", "length")


@report(f"{_FULL} SELECT idx FROM fc WHERE sharpe IS NOT NULL AND abs(ic) > 0.005 AND coverage > 0.4")
def quality_filter(spark, sf_dir):
    f = _full(spark, sf_dir).withColumn("sharpe", c("sharpe").cast("string"))
    return candidates.quality(f, ["ic", "sharpe", "coverage"], {"ic": (0.005, True), "coverage": (0.4, False)}).select("idx")


@report(f"{_FULL}, s AS (SELECT *, ic >= 0.01 AS good, coverage >= 0.9 AS covered, sharpe IS NOT NULL AS traded FROM fc), r AS (SELECT {avg_rank('ic', '1')} AS a, {avg_rank('sharpe', '1')} AS b FROM fc WHERE sharpe IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (ic > 0) AS positive, count(*) FILTER (good) AS good, count(*) FILTER (covered) AS covered, count(*) FILTER (traded) AS traded, count(*) FILTER (good AND covered AND traded) AS all_of_them, round((SELECT corr(a, b) FROM r), 6) AS rank_corr FROM s")
def quality_counts(spark, sf_dir):
    q = candidates.quality_counts(_full(spark, sf_dir))
    return q.withColumn("rank_corr", R("rank_corr"))


@report(f"{_FULL} SELECT generation::BIGINT AS generation, count(*) AS n, round(avg(ic) + 1e-9, 6) + 0 AS avg_ic, round(max(ic), 6) + 0 AS best_ic, round(avg(len(tokens)), 6) AS avg_length, arg_max(len(tokens), (ic, idx))::BIGINT AS best_length, count(DISTINCT formulation) AS n_formulas, count(DISTINCT ic) AS n_scores, count(*)::BIGINT AS n_across, count(*)::BIGINT AS n_along FROM fc GROUP BY ROLLUP (generation)")
def generation_table(spark, sf_dir):
    g = candidates.generations(_full(spark, sf_dir))
    return g.select(c("generation").cast("long").alias("generation"), "n", R(c("avg_ic") + 1e-9).alias("avg_ic"), R("best_ic").alias("best_ic"), R("avg_length").alias("avg_length"), c("best_length").cast("long").alias("best_length"), "n_formulas", "n_scores", "n_across", "n_along")


@report(f"{_FULL}, t AS (SELECT unnest(tokens) AS t FROM fc), k AS (SELECT CASE WHEN t LIKE 'f%' THEN 'feature' ELSE 'function' END AS kind, CASE WHEN t LIKE 'ts%' THEN 'ts_mean' ELSE t END AS name, count(*) AS n FROM t GROUP BY 1, 2) SELECT kind, name, n, round(n / sum(n) OVER (PARTITION BY kind), 6) AS rate FROM k")
def token_histogram(spark, sf_dir):
    return candidates.histogram(_full(spark, sf_dir)).withColumn("rate", R("rate"))


@report(f"{_FULL} SELECT round(avg(abs(ic)) + 1e-9, 6) AS ic, round(avg(abs(sharpe)), 6) AS sharpe FROM fc")
def mean_of_abs(spark, sf_dir):
    return candidates.mean_of_abs(_full(spark, sf_dir), ["ic", "sharpe"]).select(R(c("ic") + 1e-9).alias("ic"), R("sharpe").alias("sharpe"))


@report(f"{_FULL}, w AS (SELECT idx, ic, CASE WHEN idx % 2 = 0 THEN tokens[1] || '_' || tokens[3] || '(' || tokens[3] || ')' ELSE tokens[3] END AS text FROM fc) SELECT idx, text FROM w WHERE text LIKE 'cs%(%)' ORDER BY ic DESC, idx DESC LIMIT 1")
def best_nontrivial(spark, sf_dir):
    """The best candidate that applies an operator: a top-1 report."""
    t = c("tokens")
    f = _full(spark, sf_dir).withColumn("text", F.when(c("idx") % 2 == 0, F.concat(t[0], F.lit("_"), t[2], F.lit("("), t[2], F.lit(")"))).otherwise(t[2]))
    return f.where(candidates.nontrivial(c("text"))).orderBy(F.desc("ic"), F.desc("idx")).limit(1).select("idx", "text")


@report(f"{_FULL}, l AS (SELECT *, row_number() OVER (PARTITION BY formulation ORDER BY idx) AS k FROM fc WHERE generation = (SELECT max(generation) FROM fc)) SELECT idx, formulation FROM l WHERE k = 1 ORDER BY ic DESC, idx DESC LIMIT 25")
def hall_of_fame(spark, sf_dir):
    """The best 25 of the last generation: a top-k report."""
    return gp.hall_of_fame(_full(spark, sf_dir), 25).select("idx", "formulation")


_NODE = "{n} AS (SELECT '{t}' AS formulation, avg(ic) AS mean_ic, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS icir, avg(cover) AS coverage, avg(CASE WHEN cover >= 0.6 THEN 1.0 ELSE 0 END) AS passed, count(ic) AS periods, CASE WHEN avg(ic) < 0 THEN -1 ELSE 1 END * avg(spread) AS spread FROM (SELECT period, CASE WHEN count(fwd_ret) FILTER ({v} IS NOT NULL) >= 2 THEN corr({v}, fwd_ret) END AS ic, count({v}) / count(*) AS cover, avg(fwd_ret) FILTER (b{v} = 10) - avg(fwd_ret) FILTER (b{v} = 1) AS spread FROM m GROUP BY 1))"
_BUCKET = lambda v: f"(10 - floor((1 - {avg_rank(v)} / count({v}) OVER (PARTITION BY period)) * 10))::INTEGER AS b{v}"


@report(panel_sql(f"l1 AS (SELECT *, x - {lag('x')} AS d FROM p), l2 AS (SELECT *, {z('d')} AS z1 FROM l1), m AS (SELECT *, {_BUCKET('z1')}, {_BUCKET('d')}, {_BUCKET('x')} FROM l2), " + ", ".join(_NODE.format(n=n, t=t, v=v) for n, t, v in (("na", "cs_zscore(ts_delta_1(`x`))", "z1"), ("nb", "ts_delta_1(`x`)", "d"), ("nc", "`x`", "x"))) + " SELECT formulation, round(mean_ic, 6) + 0 AS mean_ic, round(icir, 6) + 0 AS icir, round(coverage, 6) AS coverage, round(passed, 6) AS passed, periods, round(spread, 6) + 0 AS spread FROM (FROM na UNION ALL FROM nb UNION ALL FROM nc)"))
def node_lineage(spark, sf_dir):
    """Every part of an expression tested by itself."""
    n = candidates.node_metrics(part_panel(spark, sf_dir), {"f": parse("cs_zscore(ts_delta_1(x))")}, "fwd_ret", least=0.6)
    return n.select("formulation", *[R(k).alias(k) for k in ("mean_ic", "icir", "coverage", "passed")], "periods", R("spread").alias("spread"))


@report(panel_sql("e AS (SELECT period, corr(x, x * 2) AS ab, corr(x, y) AS ac FROM p GROUP BY 1), g AS (SELECT avg(CASE WHEN isfinite(ab) THEN ab END) AS ab, avg(CASE WHEN isfinite(ac) THEN ac END) AS ac FROM e) SELECT 'a' AS factor FROM g UNION ALL SELECT 'b' FROM g WHERE abs(ab) <= 0.6 UNION ALL SELECT 'c' FROM g WHERE abs(ac) <= 0.6"))
def postrun_filter(spark, sf_dir):
    """Of a factor, its double, another and one below the cut: what is left of the snapshot."""
    snapshot = [("a", parse("x"), 0.08), ("b", parse("cs_mul(x, 2.0)"), 0.07), ("c", parse("y"), 0.06), ("low", parse("z"), 0.039)]
    report_ = candidates.post_run(snapshot, part_panel(spark, sf_dir))
    return spark.createDataFrame([(n,) for n in report_["kept"]], "factor string")


_QUARTER = "(date_trunc('quarter', {d}) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE"
_AXES = f"oq AS (SELECT o_custkey AS entity, {_QUARTER.format(d='o_orderdate')} AS period, count(*) AS n FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1, 2), sq AS (SELECT l_suppkey AS entity, {_QUARTER.format(d='l_shipdate')} AS period, sum(round(l_quantity)::BIGINT)::BIGINT AS q FROM lineitem GROUP BY 1, 2), ent AS (SELECT entity FROM oq UNION SELECT entity FROM sq), pers AS (SELECT period FROM oq UNION SELECT period FROM sq)"


def _frames(spark, sf_dir) -> dict[str, DataFrame]:
    end = lambda d: F.last_day(F.add_months(F.date_trunc("quarter", d), 2)).alias("period")
    o = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").groupBy(c("o_custkey").alias("entity"), end("o_orderdate")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("entity"), end("l_shipdate")).agg(F.sum(F.round("l_quantity").cast("long")).alias("q"))
    return {"orders": o, "supply": s}


@report(f"WITH {_AXES} SELECT entity, period::VARCHAR AS period, n AS orders_n, q AS supply_q FROM ent CROSS JOIN pers LEFT JOIN oq USING (entity, period) LEFT JOIN sq USING (entity, period)")
def axes_union(spark, sf_dir):
    return union_of_axes(_frames(spark, sf_dir)).select("entity", c("period").cast("string").alias("period"), "orders_n", "supply_q")


@report(f"WITH {_AXES} SELECT entity, period::VARCHAR AS period, n FROM oq WHERE period IN (SELECT period FROM sq WHERE entity <= 5) AND period BETWEEN DATE '1995-01-01' AND DATE '1997-06-30'")
def dates_shared(spark, sf_dir):
    f = _frames(spark, sf_dir)
    d = shared_dates(f["orders"], f["supply"].where("entity <= 5"), "period")
    return between(d, "period", "1995-01-01", "1997-06-30").select("entity", c("period").cast("string").alias("period"), "n")


@report(f"WITH {_AXES} SELECT entity, period::VARCHAR AS period, period BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AS counts FROM sq")
def evaluation_mask(spark, sf_dir):
    return _frames(spark, sf_dir)["supply"].select("entity", c("period").cast("string").alias("period"), evaluated(c("period"), "1994-01-01", "1996-12-31").alias("counts"))


@report(f"WITH {_AXES} SELECT 'orders' AS origin, entity, n, NULL::BIGINT AS q FROM oq UNION ALL SELECT 'supply', entity, NULL, q FROM sq")
def frames_in_one(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return union_all([f[k].drop("period").withColumn("origin", F.lit(k)) for k in f]).select("origin", "entity", "n", "q")


@report(f"WITH {_AXES} SELECT entity, CASE WHEN entity IN (SELECT entity FROM oq) THEN CASE WHEN entity IN (SELECT entity FROM sq) THEN 'both' ELSE 'orders' END ELSE 'supply' END AS lies FROM ent")
def key_sets(spark, sf_dir):
    """Union and differences of two sets of keys."""
    a, b = (f.select("entity").distinct() for f in _frames(spark, sf_dir).values())
    only = lambda x, y, n: x.join(y, "entity", "left_anti").withColumn("lies", F.lit(n))
    return union_all([only(a, b, "orders"), only(b, a, "supply"), a.join(b, "entity", "left_semi").withColumn("lies", F.lit("both"))])


_W = "(PARTITION BY entity ORDER BY qidx"


@report(panel_sql(f"t AS (SELECT *, CASE WHEN count(x) OVER {_W} ROWS 3 PRECEDING) = 4 THEN sum(x) OVER {_W} ROWS 3 PRECEDING) END AS ttm FROM p), r AS (SELECT *, CASE WHEN y <> 0 THEN ttm / y END AS q FROM t), d AS (SELECT *, q - lag(q, 4) OVER {_W}) AS f1, x - lag(x) OVER {_W}) AS f2 FROM r) SELECT entity, qidx, round(f1, 5) + 0 AS f1, round(f2, 6) + 0 AS f2, round(CASE WHEN f2 <> 0 THEN x / f2 END + 1e-9, 4) + 0 AS f3 FROM d"))
def feature_formulas(spark, sf_dir):
    formulas = {"f1": "diff4q(TTM(x) / y)", "f2": "diff1q(x)", "f3": "QTR(x) / diff1q(x)"}
    return with_formulas(part_panel(spark, sf_dir).select("entity", "qidx", "x", "y"), formulas).select("entity", "qidx", R("f1", 5).alias("f1"), R("f2").alias("f2"), R(c("f3") + 1e-9, 4).alias("f3"))


_DAY = """{n}a AS (SELECT period, {v} AS v, fwd_ret AS r, pr FROM lr WHERE NOT restricted AND {v} IS NOT NULL), {n}b AS (SELECT *, {rank} / count(*) OVER (PARTITION BY period) AS pv FROM {n}a),
{n}i AS (SELECT avg(ic) AS mean_ic, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS icir, count(ic) AS days FROM (SELECT corr(pv, pr) AS ic FROM {n}b WHERE pr IS NOT NULL GROUP BY period HAVING count(*) >= 2)),
{n}g AS (SELECT period, (10 - floor((1 - pv) * 10))::INTEGER AS b, avg(r) AS ret FROM {n}b WHERE r IS NOT NULL GROUP BY 1, 2),
{n}s AS (SELECT period, CASE WHEN mean_ic < 0 THEN -1 ELSE 1 END * (arg_max(ret, b) - arg_min(ret, b)) AS ret FROM {n}g, {n}i GROUP BY period, mean_ic HAVING count(*) > 1),
{n}c AS (SELECT *, sum(ret) OVER (ORDER BY period) AS cum FROM {n}s), {n}d AS (SELECT *, greatest(0, max(cum) OVER (ORDER BY period)) - cum AS dd FROM {n}c),
{n} AS (SELECT '{t}' AS formulation, any_value(mean_ic) AS mean_ic, any_value(icir) AS icir, any_value(days) AS days, avg(ret) * 4 AS annual, avg(ret) / stddev_pop(ret) * sqrt(4) AS sharpe, max(dd) AS drawdown FROM {n}d, {n}i)"""


@report(panel_sql(f"l1 AS (SELECT *, x - {lag('x')} AS d FROM p), lr AS (SELECT *, {avg_rank('fwd_ret')} / count(fwd_ret) OVER (PARTITION BY period) AS pr FROM l1), " + ", ".join(_DAY.format(n=n, v=v, t=t, rank=avg_rank("v")) for n, v, t in (("ka", "d", "ts_delta_1(`x`)"), ("kb", "x", "`x`"))) + " SELECT formulation, round(mean_ic, 6) + 0 AS mean_ic, round(icir, 6) + 0 AS icir, days, round(annual, 6) + 0 AS annual, round(sharpe, 6) + 0 AS sharpe, round(drawdown, 6) + 0 AS drawdown FROM (FROM ka UNION ALL FROM kb)"))
def daily_node_metrics(spark, sf_dir):
    """Every part of a program, date by date: rank ICs and the hedged return's figures."""
    n = candidates.daily_node_metrics(part_panel(spark, sf_dir), {"f": parse("ts_delta_1(x)")}, "fwd_ret", periods=4)
    return n.select("formulation", R("mean_ic").alias("mean_ic"), R("icir").alias("icir"), "days", *[R(k).alias(k) for k in ("annual", "sharpe", "drawdown")])
