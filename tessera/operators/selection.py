"""Candidates: provenance, forward selection, paired comparisons, final selection, summaries, greedy de-correlation, samples, score audit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import cut
from .metrics import residual_of_many
from .moments import Moments
from .ranking import mean_ranks, with_bucket

c = F.col


def dependency_kind(features: Column, base: list[str], step1: list[str]) -> Column:
    """constant_only without features; contains_step1 if any is derived; else base_only. A feature of neither kind is an error."""
    known = lambda names: F.array(*[F.lit(s) for s in names]).cast("array<string>")
    stranger = F.exists(features, lambda f: ~F.array_contains(known([*base, *step1]), f))
    kind = F.when(F.size(features) == 0, "constant_only").when(F.exists(features, lambda f: F.array_contains(known(step1), f)), "contains_step1").otherwise("base_only")
    return F.when(stranger, F.raise_error(F.lit("a feature without an origin"))).otherwise(kind)


def passes_gate(score: Column, least: float) -> Column:
    return F.coalesce((score >= least) & ~F.isnan(score), F.lit(False))


def select_final(cands: DataFrame, generation: int, least: float, metric: str = "ic") -> DataFrame:
    """Candidates up to a generation, the first of each formulation, abs(metric) above least, that use a derived feature."""
    w = Window.partitionBy("formulation").orderBy("generation", "idx")
    first = cands.where(c("generation") <= generation).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.where((F.abs(c(metric)) > least) & (c("kind") == "contains_step1"))


def generation_summary(cands: DataFrame) -> DataFrame:
    """Per generation, and over all (generation null): averages, bests, counts."""
    return cands.rollup("generation").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("formulation").alias("n_formulas"), F.avg("ic").alias("avg_ic"), F.max("ic").alias("best_ic"), F.max_by("formulation", F.struct("ic", "idx")).alias("best")
    )


def without_correlated(scores: list[tuple[str, float]], corr: dict[tuple[str, str], float], most: float) -> list[str]:
    """Greedy by score: a factor stays if no better one that stays has abs(correlation) above most. As many rows as candidates, on the driver."""
    kept: list[str] = []
    for name, _ in sorted(scores, key=lambda s: (-s[1], s[0])):
        if all(abs(corr.get((name, k), corr.get((k, name), 0.0)) or 0.0) <= most for k in kept):
            kept.append(name)
    return kept


def stratified(df: DataFrame, bins: Column, order: list[Column], n: int) -> DataFrame:
    """n rows, taken in turn from each bin in order."""
    at = df.withColumn("_bin", bins).withColumn("_k", F.row_number().over(Window.partitionBy("_bin").orderBy(*order)))
    return at.orderBy("_k", "_bin").limit(n).drop("_bin", "_k")


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.avg("score").alias("mean"), F.max("score").alias("hi"))


def penalty(score: Column, weight: float) -> Column:
    """weight * (1 - score / 10), the score held to 0..10; none without a score."""
    return F.coalesce(weight * (1 - F.least(F.lit(10.0), F.greatest(F.lit(0.0), score)) / 10), F.lit(0.0))


def forward_selection(
    df: DataFrame, factors: list[str], label: str, styles: list[str], least: float, most_corr: float, most: int, by: str = "ic", alike: str = "values"
) -> list[tuple[str, float]]:
    """Factors in the order they are taken, each with the mean period IC it had then: in every round the label is what styles and the factors
    taken leave of it, the factor of best abs(IC), `least` at least, is taken (with by="mono" the one whose buckets' returns are most in order), and those
    too like it go: those that correlate with it above most_corr, in the mean of the periods (alike="values") or by their series of ICs of this round
    (alike="ics"). Rows without a period take no part.

    By IC the rows are read once: all rounds follow from products summed by date, a small job each, unless nulls come in too many combinations for that.
    Then, and by order, a round reads the rows. Only scores, and returns of buckets, reach the driver.
    """
    if by not in ("ic", "mono") or alike not in ("values", "ics"):
        raise ValueError("by is ic or mono, alike is values or ics")
    taken, left = [], list(dict.fromkeys(factors))
    df = df.where(c("period").isNotNull())
    sums = Moments.of(df, [*styles, *left, label]) if by == "ic" and left else None
    while left and len(taken) < most:
        known = [*styles, *(n for n, _ in taken)]
        if sums:
            per = sums.ics(label, known, left)
        else:
            rest = residual_of_many(df, label, known).select("entity", "period", c("residual").alias("_r")) if known else df.select("entity", "period", c(label).alias("_r"))
            rows = df.select("entity", "period", *dict.fromkeys([*left, *(n for n, _ in taken)])).join(rest, ["entity", "period"])
            per = rows.groupBy("period").agg(*[_corr(n, "_r").alias(n) for n in left])
        if alike == "ics":
            per = cut(per)
        got = per.agg(*[F.avg(n).alias(n) for n in left]).first()
        able = [n for n in left if got[n] is not None and abs(got[n]) >= least]
        if not able:
            break
        order = lambda n: (abs(got[n]), n)  # noqa: B023, E731
        if by == "mono":
            mono = _disorder(rows, able, got)
            new = min(able, key=lambda n: (mono[n], *(-v if isinstance(v, float) else v for v in order(n))))
        else:
            new = max(able, key=order)
        taken.append((new, float(got[new])))
        left = [n for n in able if n != new]
        if left and len(taken) < most:
            if alike == "ics":
                like = per.agg(*[_corr(n, new).alias(n) for n in left]).first()
            else:
                per = sums.like(new, left) if sums else df.groupBy("period").agg(*[_corr(n, new).alias(n) for n in left])
                like = per.agg(*[F.avg(n).alias(n) for n in left]).first()
            left = [n for n in left if abs(like[n] or 0.0) <= most_corr]
    return taken


def _disorder(rows: DataFrame, names: list[str], ic, n: int = 10) -> dict[str, float]:
    """For each factor how far its buckets' mean returns are from the order that its IC's sign says."""
    long = rows.select("period", "_r", *names).unpivot(["period", "_r"], names, "name", "v").where("v is not null")
    buckets = with_bucket(long, "v", n, ("name", "period")).groupBy("name", "bucket").agg(F.avg("_r").alias("ret")).collect()
    out = {}
    for name in names:
        own = {r.bucket: (r.ret or 0.0) * (1 if ic[name] > 0 else -1) for r in buckets if r.name == name}
        out[name] = sum(abs(b - 1 - sum(v < own[b] for v in own.values())) for b in own) / 50
    return out


def both_selections(df: DataFrame, factors: list[str], label: str, styles: list[str], least: float, most_corr: float, most: int) -> list[str]:
    """Factors that a selection by IC or one by order takes, as they stand in factors."""
    taken = {n for by in ("ic", "mono") for n, _ in forward_selection(df, factors, label, styles, least, most_corr, most, by)}
    return [n for n in factors if n in taken]


def _corr(a: str, b: str) -> Column:
    x, y = F.when(c(b).isNotNull(), c(a)), F.when(c(a).isNotNull(), c(b))
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sd > 1e-12, F.covar_pop(x, y) / sd)


def paired_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row on the differences b - a of the pairs that have both: pairs, mean_diff, mad, p95 (of the absolute differences), spearman, and the
    signed-rank sum w_plus with its z and two-sided p of the normal approximation. A row a compared candidate; ranks are over all of them, by ranges of values."""
    p = df.where(c(a).isNotNull() & c(b).isNotNull()).select(c(a).alias("_a"), c(b).alias("_b"), (c(b) - c(a)).alias("_d"))
    size = F.abs("_d")
    ranked = p.join(mean_ranks(p, "_a", "_ra"), "_a").join(mean_ranks(p, "_b", "_rb"), "_b")
    base = p.agg(F.count(F.lit(1)).alias("pairs"), F.avg("_d").alias("mean_diff"), F.avg(size).alias("mad"), F.percentile(size, F.lit(0.95)).alias("p95"))
    # rows of one size of difference share a rank, so sizes are counted and the rows themselves stay
    moved = p.where("_d != 0").select(size.alias("_s"), (c("_d") > 0).alias("_up"))
    sizes = moved.groupBy("_s").agg(F.count(F.lit(1)).alias("_m"), F.count(F.when(c("_up"), 1)).alias("_plus")).join(mean_ranks(moved, "_s", "_rd"), "_s")
    plus, all_ = F.coalesce(F.sum(c("_plus") * c("_rd")), F.lit(0.0)), F.sum(c("_m") * c("_rd"))
    z = F.try_divide(plus - all_ / 2, F.sqrt(F.sum(c("_m") * c("_rd") * c("_rd"))) / 2)
    signed = sizes.agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("nonzero"), plus.alias("w_plus"), z.alias("z"))
    return base.crossJoin(ranked.agg(_corr("_ra", "_rb").alias("spearman"))).crossJoin(signed.withColumn("p", _two_sided(c("z"))))


def _two_sided(z: Column) -> Column:
    """Probability that a normal variable is further from 0, by the rational approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def bootstrap_mean(df: DataFrame, key: str, x: str, reps: int = 1000, seed: int = 11, share: float = 0.95) -> DataFrame:
    """mean, lo, hi: the mean of x and the bounds that `share` of its bootstrap means lie in. Each row counts in each repeat as often as a Poisson
    variable of mean 1, drawn from a hash of seed, repeat and key: a task adds up all repeats of its rows and gives one row a repeat, so rows are
    never gathered or copied, and reruns agree."""
    bounds = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def add_up(batches):
        sums = np.zeros((2, reps))
        rep = np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                h = pdf.h.to_numpy()[i : i + 256].view(np.uint64)[:, None] ^ rep
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
                u = ((h ^ (h >> np.uint64(33))) >> np.uint64(11)) / float(1 << 53)
                w = np.searchsorted(bounds, u)
                sums += (w * pdf.x.to_numpy()[i : i + 256, None]).sum(axis=0), w.sum(axis=0)
        yield pd.DataFrame({"rep": np.arange(reps), "s": sums[0], "w": sums[1]})

    rows = df.where(c(x).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), c(x).cast("double").alias("x"))
    means = rows.mapInPandas(add_up, "rep int, s double, w double").groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))  # one row a repeat
    whole = df.agg(F.avg(x).alias("mean"))
    return whole.crossJoin(means.agg(F.percentile("m", F.lit((1 - share) / 2)).alias("lo"), F.percentile("m", F.lit((1 + share) / 2)).alias("hi")))
