"""Queries of what a run writes and reads again, and of what a user adds to it (operators, metrics, transformers); each with its SQL. Tables lie in a folder of
their own in the shared one, one for each call."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batch, fitness, metrics
from ..operators import evolve as gp
from ..sources import panel as source
from ..sources import results, store
from ..sources.panel import part_panel, table
from . import expression
from .expression import canonical, evaluate, parse
from .flow import Flow
from .operator_sql import lag, z
from .reports import _BUCKETS, _CANDS, _DAYS, R, _candidates, c, daily, panel_sql, report
from .search_reports import _FULL, _full
from .stage import shared_dir


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def _text(name: str):
    return c(name).cast("string").alias(name)


# what a backtest leaves

_ICS = "ic AS (SELECT period, corr(x, fwd_ret) AS ic FROM p GROUP BY 1)"


@report(panel_sql(f"{_BUCKETS}, {_ICS} SELECT 'ics' AS part, period::VARCHAR AS period, NULL::INTEGER AS bucket, round(CASE WHEN isfinite(ic) THEN ic END, 6) + 0 AS value FROM ic WHERE period IN (SELECT period FROM p WHERE x IS NOT NULL AND fwd_ret IS NOT NULL) UNION ALL SELECT 'returns', period::VARCHAR, bucket, round(ret, 6) + 0 FROM gr UNION ALL SELECT 'summary', NULL, NULL, round(avg(CASE WHEN isfinite(ic) THEN ic END), 6) + 0 FROM ic"))
def stored_backtest(spark, sf_dir):
    """The three tables of a factor's backtest, written twice as a repeated run would and read once."""
    root, p = _folder(spark), part_panel(spark, sf_dir)
    ics = metrics.ic_rows(p, "x", "fwd_ret")
    for _ in range(2):
        store.write_results(root, "x", ics, metrics.group_returns(p, "x", "fwd_ret"), metrics.icir(ics))
    read = lambda name: store.results(spark, root, name)
    none = F.lit(None)
    return (
        read("ics").select(F.lit("ics").alias("part"), _text("period"), none.cast("int").alias("bucket"), R("ic").alias("value"))
        .unionByName(read("returns").select(F.lit("returns").alias("part"), _text("period"), "bucket", R("ret").alias("value")))
        .unionByName(read("summary").select(F.lit("summary").alias("part"), none.cast("string").alias("period"), none.cast("int").alias("bucket"), R("mean_ic").alias("value")))
    )


_SERIES = {"x": "x", "cs_add(x, y)": "x + y", "ts_delta_1(x)": f"x - {lag('x')}"}
_SERIES_SQL = "sv AS (SELECT *, " + ", ".join(f"{sql} AS s{i}" for i, sql in enumerate(_SERIES.values())) + " FROM p), si AS (" + " UNION ALL ".join(f"SELECT '{t}' AS formulation, period, corr(s{i}, fwd_ret) AS ic FROM sv WHERE NOT restricted AND s{i} IS NOT NULL AND fwd_ret IS NOT NULL GROUP BY 2 HAVING count(*) >= 30" for i, t in enumerate(_SERIES)) + ")"


def _series(spark, sf_dir) -> dict[str, dict]:
    """ICs by date of the programs, under their texts."""
    got = batch.ic_series(part_panel(spark, sf_dir), [parse(t) for t in _SERIES], "fwd_ret")
    return {t: got[str(canonical(parse(t)))] for t in _SERIES}


@report(panel_sql(f"{_SERIES_SQL} SELECT formulation, row_number() OVER (PARTITION BY formulation ORDER BY period) AS nth, round(ic, 6) + 0 AS ic FROM si"))
def stored_ic_arrays(spark, sf_dir):
    """ICs of programs in the store of a search, read as one array a program."""
    kept = store.IcStore(spark, _folder(spark), "parts")
    kept.add(gp.Rule(), "fwd_ret", _series(spark, sf_dir))
    return kept.arrays().select("formulation", F.posexplode("ics").alias("nth", "ic")).select("formulation", (c("nth") + 1).cast("long").alias("nth"), R("ic").alias("ic"))


@report(panel_sql("SELECT entity, qidx, round(fwd_ret, 6) + 0 AS fwd_ret FROM p WHERE fwd_ret IS NOT NULL"))
def stored_forward_return(spark, sf_dir):
    """A forward return that is computed for the first reader and read by the second."""
    root = _folder(spark)
    made = lambda: part_panel(spark, sf_dir).where("fwd_ret is not null").select("entity", "qidx", "fwd_ret")
    store.once(made, spark, root, "forward", "fwd_ret", 1)
    return store.once(made, spark, root, "forward", "fwd_ret", 1).select("entity", "qidx", R("fwd_ret").alias("fwd_ret"))


# scores and candidates

_WRITES = f"{_FULL}, ba AS (SELECT formulation, kind, CASE WHEN length % 9 > 0 THEN length / 4::DOUBLE END AS score, idx FROM fc), w1 AS (SELECT * FROM ba WHERE idx % 3 < 2), w2 AS (SELECT * FROM ba WHERE idx % 3 > 0)"
_FIRST = "SELECT formulation, kind, min(idx) AS k, arg_min(score, idx) AS score FROM"
_WON = f"s1 AS ({_FIRST} w1 WHERE score IS NOT NULL GROUP BY 1, 2), s2 AS ({_FIRST} w2 ANTI JOIN s1 USING (formulation, kind) WHERE score IS NOT NULL GROUP BY 1, 2)"


def _scored(spark, sf_dir) -> store.ScoreStore:
    """Scores of candidates from two writers whose rows overlap; the first one's twice."""
    f = _full(spark, sf_dir)
    rows = f.select(c("formulation").alias("expression"), c("kind").alias("model"), F.when(c("length") % 9 > 0, c("length") / 4).alias("score"), F.timestamp_seconds("idx").alias("at"), "idx")
    kept = store.ScoreStore(spark, _folder(spark))
    for part in ("idx % 3 < 2", "idx % 3 < 2", "idx % 3 > 0"):
        kept.add(rows.where(part).drop("idx"))
    return kept


@report(f"{_WRITES}, {_WON} SELECT formulation, kind, k::BIGINT AS at, round(score, 6) AS score FROM (FROM s1 UNION ALL FROM s2)")
def score_cache(spark, sf_dir):
    s = _scored(spark, sf_dir).scores()
    return s.select(c("expression").alias("formulation"), c("model").alias("kind"), F.unix_timestamp("at").alias("at"), R("score").alias("score"))


@report(f"{_WRITES} SELECT outcome, count(*) AS n, round(min(score), 6) AS lo, round(max(score), 6) AS hi FROM (SELECT CASE WHEN score IS NULL THEN 'failed' ELSE 'scored' END AS outcome, score FROM (FROM w1 UNION ALL FROM w2)) GROUP BY 1")
def score_audit(spark, sf_dir):
    """Every attempt that writers made, once a batch."""
    a = _scored(spark, sf_dir).audit()
    return a.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), R(F.min("score")).alias("lo"), R(F.max("score")).alias("hi"))


@report(f"WITH {_CANDS} SELECT generation::BIGINT AS generation, count(*) AS n, count(DISTINCT formulation) AS n_formulas FROM cd WHERE generation <= 2 GROUP BY 1")
def generation_snapshot(spark, sf_dir):
    """Candidates written a folder a generation, read through the third, and counted."""
    at = _folder(spark)
    results.write_generations(_candidates(spark, sf_dir), at)
    s = results.snapshot(spark, at, 2)
    return s.groupBy(c("generation").cast("long").alias("generation")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("formulation").alias("n_formulas"))


# factors, statements and logs

@report(panel_sql("SELECT factor, entity, period::VARCHAR AS period, round(value::DOUBLE, 3) + 0 AS value FROM (SELECT 'x' AS factor, entity, period, x::FLOAT AS value FROM p UNION ALL SELECT 'y', entity, period, y::FLOAT FROM p) WHERE value IS NOT NULL"))
def factor_export(spark, sf_dir):
    """Two factors in single precision, a folder each; the folders that are there are the factors read."""
    at = _folder(spark)
    results.write_factors(part_panel(spark, sf_dir), ["x", "y"], at)
    there = results.finished(spark, at)
    f = spark.read.parquet(at).join(F.broadcast(there), "factor", "left_semi")
    return f.select("factor", "entity", _text("period"), R(c("value").cast("double"), 3).alias("value"))


@report(f"WITH {_DAYS} SELECT day::VARCHAR AS day, count(*) AS entities, round(sum(round(ret::FLOAT::DOUBLE * 100)::BIGINT)::DOUBLE / 100, 2) AS total FROM dy WHERE ret IS NOT NULL GROUP BY 1")
def daily_factor(spark, sf_dir):
    """A factor of days, written and read as a table of a row an entity and a column a day, whose columns are then added up."""
    at = _folder(spark)
    results.write_factors(daily(spark, sf_dir).withColumnRenamed("day", "period"), ["ret"], at)
    wide = results.factor_wide(spark, at, "ret", "entity")
    long = source.unpivoted(wide, "entity", "day", "value").where("value is not null")
    return long.groupBy("day").agg(F.count(F.lit(1)).alias("entities"), R(F.sum(F.round(c("value").cast("double") * 100).cast("long")).cast("double") / 100, 2).alias("total"))


_TICKER = "CASE WHEN o_custkey % 10 = 0 THEN 'A' || o_custkey ELSE lpad(o_custkey::VARCHAR, 6, '0') END"
_EXCHANGE = "CASE o_custkey % 4 WHEN 0 THEN 'XSHG' WHEN 1 THEN 'XSHE' WHEN 2 THEN 'XBSE' ELSE 'XSHG' END"


@report(f"WITH st AS (SELECT {_TICKER} AS t, {_EXCHANGE} AS x, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate::DATE END AS d, 1 + o_orderkey % 2 AS m, CASE WHEN o_orderkey % 3 = 0 THEN 'bank' ELSE 'other' END AS i, round(o_totalprice * 100)::BIGINT AS v FROM orders) SELECT lpad(t, 6, '0') || CASE WHEN x = 'XSHG' THEN '.SH' ELSE '.SZ' END AS entity, ((date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE)::VARCHAR AS period, count(*) AS n, sum(v)::BIGINT AS v FROM st WHERE m = 1 AND i = 'other' AND x IN ('XSHG', 'XSHE') AND t NOT LIKE 'A%' AND d IS NOT NULL GROUP BY 1, 2")
def statement_scan(spark, sf_dir):
    """Orders as statements of companies in a CSV file: the main consolidated ones of an industry, by company and quarter."""
    o, at = table(spark, sf_dir, "orders"), _folder(spark)
    cust = c("o_custkey")
    rows = o.select(
        F.when(cust % 10 == 0, F.concat(F.lit("A"), cust)).otherwise(F.lpad(cust.cast("string"), 6, "0")).alias("TICKER_SYMBOL"),
        F.when(cust % 4 == 1, "XSHE").when(cust % 4 == 2, "XBSE").otherwise("XSHG").alias("EXCHANGE_CD"), F.when(c("o_orderkey") % 11 == 0, "unknown").otherwise(F.to_date("o_orderdate").cast("string")).alias("END_DATE"),
        (1 + c("o_orderkey") % 2).cast("int").alias("MERGED_FLAG"), F.when(c("o_orderkey") % 3 == 0, "bank").otherwise("other").alias("INDUSTRY_CATEGORY"),
        c("o_orderstatus").alias("unused"), F.round(c("o_totalprice") * 100).cast("long").alias("REVENUE"),
    )
    rows.write.option("header", True).csv(at)
    schema = "TICKER_SYMBOL string, EXCHANGE_CD string, END_DATE string, MERGED_FLAG int, INDUSTRY_CATEGORY string, unused string, REVENUE long"
    s = source.statements(spark, at, schema, ["TICKER_SYMBOL", "EXCHANGE_CD", "END_DATE", "MERGED_FLAG", "INDUSTRY_CATEGORY", "REVENUE"], "other")
    return s.groupBy("entity", _text("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("REVENUE").alias("v"))


@report("SELECT count(*) AS requests, sum(o_custkey)::BIGINT AS prompt_tokens, coalesce(sum(o_orderkey) FILTER (o_orderkey % 5 > 0), 0)::BIGINT AS completion_tokens, (sum(o_custkey) + coalesce(sum(o_orderkey) FILTER (o_orderkey % 5 > 0), 0))::BIGINT AS total_tokens FROM orders")
def token_usage(spark, sf_dir):
    """A log of a JSON object a line, of which some lack a number, added up."""
    at, done = _folder(spark), F.when(c("o_orderkey") % 5 > 0, c("o_orderkey").cast("long"))
    o = table(spark, sf_dir, "orders").select(c("o_custkey").cast("long").alias("prompt_tokens"), done.alias("completion_tokens"), (c("o_custkey") + F.coalesce(done, F.lit(0))).cast("long").alias("total_tokens"))
    o.write.json(at)
    return results.token_usage(spark, at)


@report(panel_sql("SELECT feature, round(count(v) / count(*)::DOUBLE, 6) AS coverage, count(*) AS cells, round(sum(v), 2) + 0 AS total FROM (SELECT 'x' AS feature, x AS v FROM p UNION ALL SELECT 'y', y FROM p) GROUP BY 1"))
def panel_with_coverage(spark, sf_dir):
    """A panel written with its coverage, counted as it is written, and read by feature."""
    at, names = _folder(spark), ["x", "y"]
    known = source.write_panel(part_panel(spark, sf_dir), names, at)
    read, about = source.read_panel(spark, at, names)
    told = spark.createDataFrame([(n, about["coverage"][n], known["rows"]) for n in names], "feature string, coverage double, cells long")
    sums = read.agg(*[F.sum(n).alias(n) for n in names]).unpivot([], names, "feature", "total")
    return told.join(sums, "feature").select("feature", R("coverage").alias("coverage"), "cells", R("total", 2).alias("total"))


# what a user adds

def _sample(spark) -> DataFrame:
    """A small panel on which what a user adds is tried first."""
    return spark.sql("SELECT e AS entity, q AS qidx, make_date(2020, 1 + 3 * q, 1) AS period, 1 AS industry, false AS restricted, CAST(e AS double) AS x, CAST(e * q AS double) AS y FROM (SELECT explode(sequence(1L, 6L)) AS e), (SELECT explode(sequence(0, 2)) AS q)")


@report(panel_sql(f"u AS (SELECT *, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN (abs(x) - abs(y)) / (1 + abs(x) + abs(y)) END AS u FROM p) SELECT entity, qidx, round({z('u')}, 6) + 0 AS value FROM u"))
def user_operator(spark, sf_dir):
    """An operator of one's own under one of the library's."""
    size = lambda f, a, b: f.ew((F.abs(a) - F.abs(b)) / (1 + F.abs(a) + F.abs(b)), a, b)
    if "cs_user_balance" not in expression.USER:
        expression.register_operator("cs_user_balance", 2, size, _sample(spark))
    f = Flow(part_panel(spark, sf_dir))
    return f.run({"value": expression.build(f, parse("cs_zscore(cs_user_balance(x, y))"))}).select("entity", "qidx", R("value").alias("value"))


@report(panel_sql("SELECT round(avg(agree), 6) AS value FROM (SELECT period, avg(CASE WHEN sign(x - m) = sign(fwd_ret - r) THEN 1.0 ELSE 0 END) AS agree FROM (SELECT *, avg(x) OVER (PARTITION BY period) AS m, avg(fwd_ret) OVER (PARTITION BY period) AS r FROM p WHERE x IS NOT NULL AND fwd_ret IS NOT NULL) GROUP BY 1)"))
def user_metric(spark, sf_dir):
    """A metric of one's own: how often factor and label lie on the same side of their means."""

    def agreement(df, x, y):
        d = df.where(c(x).isNotNull() & c(y).isNotNull()).select("period", c(x).alias("_x"), c(y).alias("_y"))
        mean = d.groupBy("period").agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))  # one row a date
        same = F.signum(c("_x") - c("_mx")) == F.signum(c("_y") - c("_my"))
        per = d.join(F.broadcast(mean), "period").groupBy("period").agg(F.avg(same.cast("double")).alias("agree"))
        return per.agg(F.avg("agree").alias("value"))

    fitness.register_metric("agreement", agreement, True, _sample(spark))
    return fitness.metric("agreement", part_panel(spark, sf_dir), "x", "fwd_ret").select(R("value").alias("value"))


@report(panel_sql(f"t AS (SELECT entity, qidx, {z('x')} AS v FROM p) SELECT entity, qidx, round(1 / (1 + exp(-v)), 6) AS value FROM t"))
def transformed_output(spark, sf_dir):
    """A program's output through the sigmoid."""
    (df,) = evaluate(part_panel(spark, sf_dir), {"v": parse("cs_zscore(x)")})
    return expression.transformed(df, ["v"], "sigmoid").select("entity", "qidx", R("v").alias("value"))


# what a search does with its candidates

@report(panel_sql(f"{_SERIES_SQL.replace('si AS', 's0 AS')}, si AS (SELECT * FROM s0 WHERE formulation IN ('x', 'ts_delta_1(x)')), al AS (SELECT DISTINCT period FROM si), fm AS (SELECT formulation, avg(ic) AS m FROM si GROUP BY 1), d AS (SELECT period, coalesce(a.ic - fa.m, 0) AS a, coalesce(b.ic - fb.m, 0) AS b FROM al LEFT JOIN (SELECT * FROM si WHERE formulation = 'x') a USING (period) LEFT JOIN (SELECT * FROM si WHERE formulation <> 'x') b USING (period), (SELECT m FROM fm WHERE formulation = 'x') fa, (SELECT m FROM fm WHERE formulation <> 'x') fb), g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM d), e AS (SELECT *, (aa + bb + sqrt((aa - bb) ** 2 + 4 * ab * ab)) / 2 AS l FROM g), v AS (SELECT *, ab * ab / (ab * ab + (l - aa) ** 2) AS ua FROM e) SELECT 'x' AS formulation, round(l * ua / aa, 6) AS explained FROM v UNION ALL SELECT 'ts_delta_1(x)', round(l * (1 - ua) / bb, 6) FROM v"))
def explained_ics(spark, sf_dir):
    """How much of each program's ICs the leading component of both explains; the SQL has the axes of a two by two matrix in closed form."""
    s = _series(spark, sf_dir)
    got = gp.explained({t: s[t] for t in ("x", "ts_delta_1(x)")}, 1)
    return spark.createDataFrame(list(got.items()), "formulation string, explained double").select("formulation", R("explained").alias("explained"))


_HALL = {"cs_add(x, y)": "x + y", "ts_delta_1(x)": f"x - {lag('x')}", "cs_mul(x, y)": "x * y", "cs_neg(y)": "-y"}
_CELLS = "hv AS (SELECT *, " + ", ".join(f"{sql} AS v{i}" for i, sql in enumerate(_HALL.values())) + " FROM p), hc AS (SELECT " + ", ".join(f"coalesce(v{i} - avg(v{i}) OVER (), 0) AS c{i}" for i in range(4)) + " FROM hv)"
_PAIRED = "pc AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, abs(corr(c{i}, c{j})) AS k FROM hc" for i in range(4) for j in range(i + 1, 4)) + ")"


def _hall(spark) -> DataFrame:
    """The programs as records of a last generation, in falling order of score; one of the generation before is better."""
    rows = [(0, 0, "x", 0.5), *((1, i, t, 0.4 - 0.1 * i) for i, t in enumerate(_HALL))]
    return spark.createDataFrame(rows, "generation int, idx int, formulation string, ic double")


@report(panel_sql(f"{_CELLS}, {_PAIRED}, o1 AS (SELECT j FROM pc ORDER BY k DESC, i, j LIMIT 1), p2 AS (SELECT * FROM pc WHERE i NOT IN (FROM o1) AND j NOT IN (FROM o1)), o2 AS (SELECT j FROM p2 ORDER BY k DESC, i, j LIMIT 1), nm AS (" + " UNION ALL ".join(f"SELECT {i} AS i, '{t}' AS formulation" for i, t in enumerate(_HALL)) + ") SELECT i AS nth, formulation FROM nm WHERE i NOT IN (FROM o1) AND i NOT IN (FROM o2)"))
def uncorrelated_hall(spark, sf_dir):
    """Of a hall of fame of four the two that are left when the worse of the most correlated two goes, twice."""
    left = gp.best_programs(part_panel(spark, sf_dir), _hall(spark), 4, 2)
    return spark.createDataFrame([(list(_HALL).index(t), t) for t in left], "nth int, formulation string")


@report(panel_sql(f"a AS (SELECT entity, qidx, x + y AS p0, x - {lag('x')} AS p1 FROM p) SELECT entity, qidx, round(p0, 6) + 0 AS p0, round(p1, 6) + 0 AS p1 FROM a"))
def best_programs_applied(spark, sf_dir):
    """Texts of programs, as a search leaves them, applied to a panel."""
    out = gp.execute(part_panel(spark, sf_dir), list(_HALL)[:2])
    return out.select("entity", "qidx", R("p0").alias("p0"), R("p1").alias("p1"))


#: Small searches' settings as they are kept between runs.
_SETTINGS = json.dumps({"population": 4, "warm_start": 1, "generations": 1, "seed": 3, "parsimony": 0.001})


@report(None)
def production_search(spark, sf_dir):
    """A short search whose mutations draw from the production operators and whose first trees from those for crossover, with settings from JSON."""
    from .subsets import CROSSOVER, MUTATION

    p = part_panel(spark, sf_dir).select("entity", "period", "qidx", "industry", "x", "y", "z", "fwd_ret")
    records = gp.evolve(p, list(MUTATION), ["x", "y", "z"], s=gp.Settings.from_json(_SETTINGS), crossover_ops=list(CROSSOVER), rule=gp.Rule(coverage=0.3, pairs=30, share=0.3))
    return spark.createDataFrame(records, "generation int, idx int, formulation string, ic double, fitness double, method string, n_nodes int")
