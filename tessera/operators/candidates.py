"""Candidates after a run: policy, what is left to do, summaries by generation, feature and function, quality, post-run filter, lineage."""

from __future__ import annotations

import math
from numbers import Integral

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.expression import Node, evaluate
from ..plans.stage import cut
from ..sources.results import union_all
from . import batch, metrics
from .ranking import with_bucket, with_ranks
from .selection import without_correlated

c = F.col


#: What a group of features comes from; groups of mined features are named after the window they were mined in. Fixed values.
ORIGINS = {"base": "base", "gate1": "base", "step1": "step1", "x20_": "step1", "x40_": "step1", "x60_": "step1", "x100_": "step1"}


def generation_size(features: int, per_feature: int) -> int:
    """How many candidates a generation has, `per_feature` for each feature. Both are whole numbers from 1."""
    for n in (features, per_feature):
        if type(n) is bool or not isinstance(n, Integral) or n < 1:
            raise ValueError(f"{n!r} is no whole number from 1")
    return int(features) * int(per_feature)


def with_origins(features: DataFrame) -> DataFrame:
    """features (name, source_group, origin) with the origin that the group has in ORIGINS where a row has none of its own; an error names features without one."""
    known = features.sparkSession.createDataFrame(list(ORIGINS.items()), "_group string, _origin string")
    window = F.regexp_extract("source_group", "^x[0-9]+_", 0)
    group = F.when(window == "", c("source_group")).otherwise(window)
    found = features.withColumn("_group", group).join(F.broadcast(known), "_group", "left").withColumn("origin", F.coalesce("origin", "_origin")).drop("_group", "_origin")
    strange = found.where("origin is null or origin not in ('base', 'step1')").select("name").limit(5).collect()
    if strange:
        raise ValueError("no known origin: " + ", ".join(str(r.name) for r in strange))
    return found


def gated(cands: DataFrame, score: str, least: float | None) -> DataFrame:
    """Candidates whose score is a number, `least` at least where given; an error if none is left."""
    ok = c(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    kept = cands.where(ok if least is None else ok & (c(score) >= least))
    if not kept.limit(1).count():
        raise ValueError(f"no candidate has {score} of {least} or more")
    return kept


def parsimonious(cands: DataFrame, score: str, length: str, coefficient: float | str = "auto") -> DataFrame:
    """cands with `adjusted`: the score less coefficient times length; auto takes the covariance of length and score over the variance of length."""
    if coefficient != "auto":
        return cands.withColumn("adjusted", c(score) - float(coefficient) * c(length))
    k = cands.agg(F.coalesce(F.try_divide(F.covar_samp(length, score), F.var_pop(length)), F.lit(0.0)).alias("_k"))  # one row
    return cands.crossJoin(F.broadcast(k)).withColumn("adjusted", c(score) - c("_k") * c(length)).drop("_k")


def penalised(cands: DataFrame, scores: DataFrame, key: str, fitness: str, weight: float) -> DataFrame:
    """cands with `score` (of scores, by key; the last of repeated ones counts by `at`), `penalty` = weight * (1 - score / 10) and `rewarded`; no
    penalty without a score, with weight 0, or for a fitness that is no number or below 0."""
    one = scores.groupBy(key).agg(F.max_by("score", "at").alias("score"))
    held = F.least(F.lit(10.0), F.greatest(F.lit(0.0), c("score")))
    due = c("score").isNotNull() & c(fitness).isNotNull() & ~F.isnan(fitness) & (c(fitness) >= 0)
    out = cands.join(one, key, "left").withColumn("penalty", F.when(due, weight * (1 - held / 10)).otherwise(0.0))
    return out.withColumn("rewarded", c(fitness) - c("penalty"))


def to_do(cands: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates that have no result yet."""
    return cands.join(done.select(key).distinct(), key, "left_anti")


def with_results(cands: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Candidates with their backtest figures where there are any."""
    return cands.join(results, key, "left")


def inconsistent(cands: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that stand for more than one value."""
    return cands.groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")


def quality(summary: DataFrame, needed: list[str], limits: dict[str, tuple[float, bool]]) -> DataFrame:
    """Rows whose needed columns all read as finite numbers and whose limited ones are above (their absolute, where asked) limit."""
    for n in needed:
        v = F.expr(f"try_cast(`{n}` as double)")
        summary = summary.withColumn(n, F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))
    out = summary.dropna(subset=needed)
    for n, (least, absolute) in limits.items():
        out = out.where((F.abs(n) if absolute else c(n)) > least)
    return out


def quality_counts(results: DataFrame) -> DataFrame:
    """One row: candidates, those of positive ic, of ic from 0.01, of coverage from 0.9, with a Sharpe ratio, and with all of these; the rank correlation of ic and sharpe."""
    from .ranking import mean_ranks

    tests = {"positive": c("ic") > 0, "good": c("ic") >= 0.01, "covered": c("coverage") >= 0.9, "traded": c("sharpe").isNotNull()}
    every = tests["good"] & tests["covered"] & tests["traded"]
    counts = results.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(t, 1)).alias(n) for n, t in tests.items()], F.count(F.when(every, 1)).alias("all_of_them"))
    pairs = results.where("ic is not null and sharpe is not null").select("ic", "sharpe")
    ranked = pairs.join(mean_ranks(pairs, "ic", "_a"), "ic").join(mean_ranks(pairs, "sharpe", "_b"), "sharpe")
    return counts.crossJoin(ranked.agg(F.corr("_a", "_b").alias("rank_corr")))


def generations(cands: DataFrame) -> DataFrame:
    """By generation and over all (null): number, mean and best score, mean and best one's length, different formulas and scores, operators across and along.

    cands: generation, idx, formulation, tokens (operator and feature names), ic.
    """
    d = cands.withColumn("_len", F.size("tokens"))
    n_of = lambda kind: F.sum(F.size(F.filter("tokens", lambda t: t.startswith(kind))))
    return d.rollup("generation").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ic").alias("avg_ic"), F.max("ic").alias("best_ic"), F.avg("_len").alias("avg_length"), F.max_by("_len", F.struct("ic", "idx")).alias("best_length"),
        F.countDistinct("formulation").alias("n_formulas"), F.countDistinct("ic").alias("n_scores"), n_of("cs_").alias("n_across"), n_of("ts_").alias("n_along"),
    )


def histogram(cands: DataFrame) -> DataFrame:
    """kind (feature or function), name, n, rate (within its kind) of all tokens; a function along time without its window."""
    t = cands.select(F.explode("tokens").alias("t"))
    name = F.when(c("t").startswith("ts_"), F.regexp_replace("t", r"_[0-9]+$", "")).otherwise(c("t"))
    counts = t.groupBy(F.when(c("t").rlike("^(cs|ts)_"), "function").otherwise("feature").alias("kind"), name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("kind").agg(F.sum("n").alias("_all"))  # two rows
    return counts.join(F.broadcast(whole), "kind").select("kind", "name", "n", (c("n") / c("_all")).alias("rate"))


def mean_of_abs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(F.abs(n)).alias(n) for n in columns])


def nontrivial(formulation: Column) -> Column:
    """Whether a text applies an operator to something."""
    return formulation.rlike(r"(cs|ts)_\w+\(.+\)")


def nodes_of(trees: dict[str, Node]) -> dict[str, tuple[str, Node]]:
    """Every distinct part of every tree: a name of its own, whose tree it is of first, and the part."""
    out: dict[str, tuple[str, Node]] = {}
    for name, t in trees.items():
        for part in t.nodes():
            if part.op != "const" and part not in [p for _, p in out.values()]:
                out[f"n{len(out)}"] = (name, part)
    return out


def node_metrics(panel: DataFrame, trees: dict[str, Node], label: str, least: float = 0.9, n: int = 10) -> DataFrame:
    """node, of, formulation, length, mean_ic, icir, coverage, passed (share of dates covered `least` or more), periods, spread (mean of top less bottom
    bucket, turned to the mean IC's sign): every part of the expressions tested by itself, all from one evaluation of the panel."""
    parts = nodes_of(trees)
    spark = panel.sparkSession
    rows = []
    for df in evaluate(panel, {k: t for k, (_, t) in parts.items()}):
        names = [k for k in parts if k in df.columns]
        long = df.select("period", "entity", label, F.explode(F.array(*[F.struct(F.lit(k).alias("node"), c(k).cast("double").alias("v")) for k in names])).alias("s")).select("period", "entity", label, "s.node", "s.v")
        rows.append(long)
    long = rows[0]
    for more in rows[1:]:
        long = long.unionByName(more)
    both = c("v").isNotNull() & c(label).isNotNull()
    sd = F.stddev_pop(F.when(both, c("v"))) * F.stddev_pop(F.when(both, c(label)))
    d = with_bucket(long, "v", n, ("node", "period"), "_b")
    per = d.groupBy("node", "period").agg(
        F.when((F.count(F.when(both, 1)) >= 2) & (sd > 1e-12), F.covar_pop(F.when(both, c("v")), F.when(both, c(label))) / sd).alias("ic"), (F.count("v") / F.count(F.lit(1))).alias("cover"),
        (F.avg(F.when(c("_b") == n, c(label))) - F.avg(F.when(c("_b") == 1, c(label)))).alias("spread"),
    )
    sign = F.when(F.avg("ic") < 0, -1.0).otherwise(1.0)
    got = per.groupBy("node").agg(
        F.avg("ic").alias("mean_ic"), (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic"))).alias("icir"), F.avg("cover").alias("coverage"),
        F.avg((c("cover") >= least).cast("double")).alias("passed"), F.count("ic").alias("periods"), (sign * F.avg("spread")).alias("spread"),
    )
    names = spark.createDataFrame([(k, of, str(t), t.length()) for k, (of, t) in parts.items()], "node string, of string, formulation string, length int")
    return names.join(got, "node", "left")


def daily_node_metrics(panel: DataFrame, trees: dict[str, Node], label: str, n: int = 10, periods: int = 250) -> DataFrame:
    """node, formulation, mean_ic, icir, days (of rank ICs), annual, sharpe, drawdown: every part of the expressions day by day. The return of a day is that of the
    highest bucket of the part's values less that of the lowest (of n; with few different values the outermost that there are), turned round if the mean rank IC is negative.

    All parts are ranked in one table that is range-partitioned by part, day and value, and only sums by part, day and bucket go on; the largest fall is over a row a part and day.
    """
    parts = nodes_of(trees)
    ranked = with_ranks(panel, {"_rank": label}).withColumn("_rank", c("_rank") / c("_rank_n")).drop("_rank_n")
    frames = evaluate(ranked, {k: t for k, (_, t) in parts.items()})
    names = [[k for k in parts if k in df.columns] for df in frames]
    ics = union_all([batch.rank_ics(batch._long(df, some, "_rank"), 2) for df, some in zip(frames, names)])
    long = union_all([batch._long(df, some, label) for df, some in zip(frames, names)])
    buckets = with_bucket(long, "v", n, ("name", "period")).where("label is not null").groupBy("name", "period", "bucket").agg(F.avg("label").alias("ret"))
    spread = buckets.groupBy("name", "period").agg((F.max_by("ret", "bucket") - F.min_by("ret", "bucket")).alias("spread"), F.count(F.lit(1)).alias("k")).where("k > 1")
    total = ics.groupBy("name").agg(F.avg("ic").alias("mean_ic"), (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic"))).alias("icir"), F.count("ic").alias("days"))
    total = cut(total)  # a row a part
    signed = spread.join(F.broadcast(total.select("name", F.when(c("mean_ic") < 0, -1.0).otherwise(1.0).alias("sign"))), "name").select("name", "period", (c("sign") * c("spread")).alias("ret"))
    texts = panel.sparkSession.createDataFrame([(k, str(t)) for k, (_, t) in parts.items()], "name string, formulation string")
    stats = metrics.portfolio_stats(signed, "name", periods)
    return texts.join(total, "name", "left").join(stats, "name", "left").withColumnRenamed("name", "node")


def post_run(cands: list[tuple[str, Node, float]], panel: DataFrame, least: float = 0.04, most_corr: float = 0.6, materialise=evaluate) -> dict:
    """What is left of a snapshot (name, tree, score): scores from `least` on, then the best first, each that no better one that stays correlates with
    above most_corr (mean over dates). The report says how many were tested and left, or which stage failed; below the cut nothing is computed."""
    able = [(n, t, s) for n, t, s in cands if s is not None and math.isfinite(s) and s >= least]
    report = {"status": "completed", "candidates": len(cands), "materialised": len(able), "after_filter": 0, "kept": []}
    if not able:
        return report
    try:
        names = {f"c{i}": n for i, (n, _, _) in enumerate(able)}
        dfs = materialise(panel, {f"c{i}": t for i, (_, t, _) in enumerate(able)}, max(50, len(able)))
        corr = {} if len(able) < 2 else {(names[r.a], names[r.b]): r["corr"] for r in metrics.correlations(dfs[0], list(names)).collect()}
    except Exception as e:
        return {**report, "status": "failed", "stage": "materialise", "error": str(e)}
    kept = without_correlated([(n, s) for n, _, s in able], corr, most_corr)
    return {**report, "after_filter": len(kept), "kept": kept}
