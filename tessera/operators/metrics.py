"""Scores of expressions: coverage mask, information coefficients per period, decile and backtest figures."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import cut
from .ranking import with_bucket, with_ranks

c = F.col


def masked(df: DataFrame, x: str, least: float = 0.9, by: tuple[str, ...] = ()) -> DataFrame:
    """x is null where restricted, in periods whose coverage (values over unrestricted entities) is below `least`, and everywhere if the mean coverage is; for each of `by` apart."""
    per = df.groupBy(*by, "period").agg((F.count(F.when(~c("restricted"), c(x))) / F.nullif(F.count(F.when(~c("restricted"), 1)), F.lit(0))).alias("coverage"))
    whole = per.groupBy(*by).agg(F.avg("coverage").alias("mean_coverage"))  # one row, or one for each of by
    at = df.join(F.broadcast(per), [*by, "period"])
    at = at.join(F.broadcast(whole), [*by]) if by else at.crossJoin(F.broadcast(whole))
    ok = ~c("restricted") & (c("coverage") >= least) & (c("mean_coverage") >= least)
    return at.withColumn(x, F.when(ok, c(x)))


def ic_rows(df: DataFrame, x: str, y: str, method: str = "pearson", min_pairs: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) period, pairs, ic: the correlation of x and y over the entities of a period that have both; null below min_pairs or where a side is constant."""
    p = df.where(c(x).isNotNull() & c(y).isNotNull()).select(*by, "period", c(x).alias("_a"), c(y).alias("_b"))
    if method == "spearman":
        p = with_ranks(p, {"_ra": "_a", "_rb": "_b"}, (*by, "period")).select(*by, "period", c("_ra").alias("_a"), c("_rb").alias("_b"))
    s = p.groupBy(*by, "period").agg(F.count(F.lit(1)).alias("pairs"), F.covar_pop("_a", "_b").alias("_c"), (F.stddev_pop("_a") * F.stddev_pop("_b")).alias("_s"))
    return s.select(*by, "period", "pairs", F.when((c("pairs") >= min_pairs) & (c("_s") > 1e-12), c("_c") / c("_s")).alias("ic"))


def icir(rows: DataFrame) -> DataFrame:
    """mean, and mean over deviation times the root of the number of periods."""
    return rows.agg(F.avg("ic").alias("mean_ic"), (F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic"))).alias("icir"), F.count("ic").alias("periods"))


def fitness(df: DataFrame, x: str, y: str, min_pairs: int = 100, share: float = 2 / 3, least: float = 0.9) -> DataFrame:
    """abs of the mean period IC of the masked factor; -1 if fewer than `share` of the periods that have a label are valid."""
    rows = ic_rows(masked(df, x, least), x, y, min_pairs=min_pairs)
    labelled = df.where(c(y).isNotNull()).agg(F.countDistinct("period").alias("n"))
    got = rows.agg(F.count("ic").alias("valid"), F.abs(F.avg("ic")).alias("m"))
    return got.crossJoin(labelled).select(F.when((c("valid") > 0) & (c("valid") >= F.ceil(F.lit(share) * c("n"))), c("m")).otherwise(-1.0).alias("fitness"), "valid")


def half(df: DataFrame, x: str, y: str, top: bool = True) -> DataFrame:
    """The rows of the better (or worse) half of x's percentile ranks in each period."""
    p = with_ranks(df.where(c(x).isNotNull() & c(y).isNotNull()), {"_p": x}).withColumn("_p", c("_p") / c("_p_n"))
    return p.where(c("_p") > 0.5 if top else c("_p") <= 0.5).drop("_p", "_p_n")


def long_only_ic(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean rank IC inside the half that the sign of the whole factor's mean IC says to hold."""
    sign = icir(ic_rows(df, x, y, "spearman")).select("mean_ic")
    up = icir(ic_rows(half(df, x, y, True), x, y, "spearman")).select(c("mean_ic").alias("up"))
    down = icir(ic_rows(half(df, x, y, False), x, y, "spearman")).select(c("mean_ic").alias("down"))
    return sign.crossJoin(up).crossJoin(down).select(F.abs(F.when(c("mean_ic") >= 0, c("up")).otherwise(c("down"))).alias("long_only_ic"))


def bucketed(df: DataFrame, x: str, n: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows that have x, with their bucket."""
    return with_bucket(df.where(c(x).isNotNull()), x, n, (*by, "period"))


def group_returns(df: DataFrame, x: str, ret: str, n: int = 10) -> DataFrame:
    """period, bucket, ret: equal-weight means."""
    return bucketed(df.select("period", x, ret), x, n).groupBy("period", "bucket").agg(F.avg(ret).alias("ret"), F.count(ret).alias("members"))


def portfolio_stats(returns: DataFrame, by: str = "bucket", periods: int = 250) -> DataFrame:
    """Per bucket: annual return, Sharpe ratio (deviation over all), largest drawdown of the summed returns."""
    w = Window.partitionBy(by).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    s = returns.withColumn("_cum", F.sum("ret").over(w))
    s = s.withColumn("_dd", F.greatest(F.lit(0.0), F.max("_cum").over(w)) - c("_cum"))
    return s.groupBy(by).agg((F.avg("ret") * periods).alias("annual"), (F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * math.sqrt(periods)).alias("sharpe"), F.max("_dd").alias("drawdown"))


def hedge_sharpe(df: DataFrame, x: str, ret: str, periods: int = 250, n: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) hedge_sharpe: mean over deviation of the returns of the first or the last bucket, whichever sums to more, times the root of `periods`; -100 where
    that is no number. A date's return of a bucket is the sum of its members' returns over their number, those without a return counted too."""
    keys = (*by, "period")
    b = bucketed(df.select(*keys, x, ret), x, n, by).select(*keys, "bucket", ret).unionByName(df.where(c(x).isNull()).select(*keys, F.lit(None).cast("int").alias("bucket"), ret))
    side = lambda k: F.when((F.count(F.when(c("bucket") == k, 1)) > 0) & (F.count(ret) > 0), F.coalesce(F.sum(F.when(c("bucket") == k, c(ret))), F.lit(0.0)) / F.count(F.when(c("bucket") == k, 1)))
    per = b.groupBy(*keys).agg(side(1).alias("_lo"), side(n).alias("_hi"))
    sharpe = lambda k: F.try_divide(F.avg(k), F.stddev_samp(k)) * math.sqrt(periods)
    total = lambda k: F.coalesce(F.sum(k), F.lit(0.0))
    return per.groupBy(*by).agg(F.coalesce(F.when(total("_lo") > total("_hi"), sharpe("_lo")).otherwise(sharpe("_hi")), F.lit(-100.0)).alias("hedge_sharpe"))


def monotonicity(returns: DataFrame, rising: bool = True, mode: str = "full") -> DataFrame:
    """Sum of the distances between each bucket's number and the rank of its mean return (falling ones ranked from the top), over 50. longonly looks at
    the half that is held: the upper five buckets if returns rise with the factor, else the lower five, over 12."""
    m = returns.groupBy("bucket").agg(F.avg("ret").alias("ret"))  # one row a bucket
    if mode not in ("full", "longonly"):
        raise ValueError("mode is full or longonly")
    first, out_of = 0, 50
    if mode == "longonly":
        first, out_of = (5 if rising else 0), 12
        m = m.where(c("bucket") > 5 if rising else c("bucket") <= 5)
    r = m.withColumn("_r", F.rank().over(Window.orderBy(c("ret").asc() if rising else c("ret").desc())) + first)
    return r.agg((F.sum(F.abs(c("bucket") - c("_r"))) / out_of).alias("mono"))


def winsorized(df: DataFrame, x: str, share: float = 0.975) -> DataFrame:
    """df with x held to its quantiles at share and 1 - share over all rows."""
    q = df.agg(F.percentile(x, F.lit(1 - share)).alias("_lo"), F.percentile(x, F.lit(share)).alias("_hi"))  # one row
    held = F.when(c(x).isNotNull(), F.greatest(c("_lo"), F.least(c("_hi"), c(x))))
    return df.crossJoin(F.broadcast(q)).withColumn(x, held).drop("_lo", "_hi")


def positive_share(x: str) -> Column:
    """Rows above 0 over all rows of a group, missing ones counted among all."""
    return F.count(F.when(c(x) > 0, 1)) / F.count(F.lit(1))


def weighted_sum(x: str, weight: str) -> Column:
    """Sum of x by weights made to sum to 1 over the group; weights that sum to 0 stay as they are; missing values add nothing."""
    whole = F.coalesce(F.sum(weight), F.lit(0.0))
    return F.coalesce(F.sum(c(x) * c(weight)), F.lit(0.0)) / F.when(whole == 0, 1.0).otherwise(whole)


def slopes(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Least-squares slopes of the last column on the others, from means and covariances; by the pseudo-inverse of the correlations."""
    k = len(mean) - 1
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    scale = np.where(sd > 1e-12 * np.maximum(1, np.abs(mean[:k])), sd, np.inf)
    return np.linalg.pinv(cov[:k, :k] / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (cov[:k, k] / scale) / scale


def with_residual(df: DataFrame, y: str, xs: list[str], name: str = "residual") -> DataFrame:
    """df with `name`, the residual of y on xs and a constant, by least squares in each period, over the rows that have them all; null elsewhere and in
    periods of fewer than two such rows.

    Means and covariances of a period are summed where its rows are; one small system a period is solved (by the pseudo-inverse of the correlations,
    so regressors may be constant or follow from others) and its coefficients come back by broadcast. A calendar bounds their number.
    """
    cols, k = [*xs, y], len(xs)
    ok = reduce(lambda a, b: a & b, [c(n).isNotNull() for n in cols])
    v = [F.when(ok, c(n)) for n in cols]
    sums = df.groupBy("period").agg(
        F.count(F.when(ok, 1)).alias("_n"), F.array(*[F.avg(a) for a in v]).alias("_mean"), F.array(*[F.covar_pop(v[i], v[j]) for i in range(k + 1) for j in range(i, k + 1)]).alias("_cov")
    )

    @F.pandas_udf("array<double>")
    def coefficients(mean: pd.Series, cov: pd.Series) -> pd.Series:
        out = []
        for m, flat in zip(mean, cov):
            a = np.zeros((k + 1, k + 1))
            a[np.triu_indices(k + 1)] = flat
            a = np.triu(a) + np.triu(a, 1).T
            b = slopes(m, a)
            out.append([float(m[k] - b @ m[:k]), *b.tolist()])
        return pd.Series(out)

    fit = sums.where("_n >= 2").select("period", coefficients("_mean", "_cov").alias("_b"))
    line = reduce(lambda a, b: a + b, [c("_b")[i + 1] * c(x) for i, x in enumerate(xs)], c("_b")[0])
    return df.join(F.broadcast(fit), "period", "left").withColumn(name, F.when(ok, c(y) - line)).drop("_b")


def residual_of_many(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """entity, period and that residual."""
    return with_residual(df, y, xs).select("entity", "period", "residual")


#: Columns of a tile of the matrix of correlations, and states of tiles that a task holds.
TILE, STATES = 64, 64


def _tile_state(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each column of x and each of y, over the rows that have both: their number, either's mean, the sum of products and of either's squares about the means."""
    here, there = ~np.isnan(x), ~np.isnan(y)
    mid = lambda v, ok: np.where(ok.any(axis=0), np.where(ok, v, 0.0).sum(axis=0) / np.maximum(1, ok.sum(axis=0)), 0.0)
    cx, cy = mid(x, here), mid(y, there)
    u, w = np.where(here, x - cx, 0.0), np.where(there, y - cy, 0.0)
    here, there = here.astype(float), there.astype(float)
    n = here.T @ there
    su, sw, one = u.T @ there, here.T @ w, np.maximum(n, 1)
    return np.stack([n, cx[:, None] + su / one, cy[None, :] + sw / one, u.T @ w - su * sw / one, (u * u).T @ there - su * su / one, here.T @ (w * w) - sw * sw / one])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of the rows of two states."""
    n = a[0] + b[0]
    share, both = b[0] / np.maximum(n, 1), a[0] * b[0] / np.maximum(n, 1)
    du, dw = b[1] - a[1], b[2] - a[2]
    return np.stack([n, a[1] + du * share, a[2] + dw * share, a[3] + b[3] + du * dw * both, a[4] + b[4] + du * du * both, a[5] + b[5] + dw * dw * both])


def correlations(df: DataFrame, xs: list[str]) -> DataFrame:
    """a, b, corr: the mean over periods of the correlation of each two columns, each over the rows that have both.

    One pass: rows are dealt out in ranges of dates, a task turns those of a date into matrices of products of TILE columns by TILE, and what several tasks have of
    a date and tile is put together from their states, one at a time. Work on a row is a matrix product, and no row is copied for a pair.
    """
    k, starts = len(xs), range(0, len(xs), TILE)
    tiles = [(i, j) for i in starts for j in starts if i <= j]
    d = cut(df.select("period", *[c(n).cast("double").alias(f"_{i}") for i, n in enumerate(xs)]))
    if k < 2:
        return d.sparkSession.createDataFrame([], "a string, b string, corr double")
    days = d.schema["period"].dataType.simpleString()

    def states(batches):
        held: dict = {}

        def out():
            rows = [(p, i, j, s.tobytes()) for (p, i, j), s in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["period", "i", "j", "state"])

        for pdf in batches:
            code, day = pd.factorize(pdf.period)
            m = pdf[[f"_{i}" for i in range(k)]].to_numpy(float)
            for n, p in enumerate(day):
                own = m[code == n]
                for i, j in tiles:
                    s = _tile_state(own[:, i : i + TILE], own[:, j : j + TILE])
                    held[p, i, j] = _merged(held[p, i, j], s) if (p, i, j) in held else s
                if len(held) > STATES:
                    yield out()
        if held:
            yield out()

    def ends(batches):
        key, state = None, None

        def out():
            n, s = state[0], np.sqrt(np.maximum(state[4], 0) * np.maximum(state[5], 0)) / np.maximum(state[0], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where(s > 1e-12, state[3] / np.maximum(n, 1) / s, np.nan)
            i, j = np.nonzero(n > 0)
            on = i + key[1] < j + key[2]
            i, j = i[on], j[on]
            return pd.DataFrame({"i": i + key[1], "j": j + key[2], "r": r[i, j]})

        for pdf in batches:
            for p, i, j, raw in zip(pdf.period, pdf.i, pdf.j, pdf.state):
                s = np.frombuffer(raw).reshape(6, min(TILE, k - i), min(TILE, k - j))
                if (p, i, j) == key:
                    state = _merged(state, s)
                    continue
                if key is not None:
                    yield out()
                key, state = (p, i, j), s
        if key is not None:
            yield out()

    parts = d.repartitionByRange("period", F.xxhash64(*d.columns)).mapInPandas(states, f"period {days}, i int, j int, state binary")
    per = parts.repartition("period", "i", "j").sortWithinPartitions("period", "i", "j").mapInPandas(ends, "i int, j int, r double")
    names = F.array(*[F.lit(n) for n in xs])
    return per.groupBy("i", "j").agg(F.avg(F.when(~F.isnan("r"), c("r"))).alias("corr")).select(names[c("i")].alias("a"), names[c("j")].alias("b"), "corr")
