"""Metrics that a search can go by, under their names: each gives one number for a factor against a label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .metrics import ic_rows, masked, with_residual
from .ranking import with_ranks

c = F.col


def own_ranks(df: DataFrame, columns: dict[str, Column | str], keys: tuple[str, ...] = ("period",)) -> DataFrame:
    """df with percentile ranks among each date's (or the keys') values, ties by their mean; null stays null."""
    r = with_ranks(df, columns, keys)
    return r.withColumns({n: c(n) / c(f"{n}_n") for n in columns}).drop(*[f"{n}_n" for n in columns])


def _value(x: Column, otherwise: float) -> Column:
    return F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.lit(otherwise)).alias("value")


def _ranked(df: DataFrame, x: str, y: str) -> DataFrame:
    return own_ranks(df.select("period", c(x).alias("_x"), c(y).alias("_y")), {"_f": "_x", "_r": "_y"})


def neutral(df: DataFrame, y: str, styles: list[str]) -> DataFrame:
    """df with `_residual`, what the styles leave of y on each date. Rows stay where they are."""
    return with_residual(df, y, styles, "_residual")


def halves(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), ranks: str | None = None) -> DataFrame:
    """(by,) period, ic (of the percentile ranks of x and y), top and bottom (x's ranks above and below the middle against the ranks of y among those rows). `ranks` are
    y's percentile ranks, where df has them; rows without x are of no account then. A row is above the middle or below it, so both sides are ranked at once."""
    keys = (*by, "period")
    d = df.select(*keys, c(x).alias("_x"), c(y).alias("_y"), *([c(ranks).alias("_r")] if ranks else []))
    d = own_ranks(d, {"_f": "_x"} if ranks else {"_f": "_x", "_r": "_y"}, keys).drop("_x")
    d = d.withColumn("_side", F.when(c("_f") > 0.5, 1).when(c("_f") < 0.5, -1).otherwise(0))
    d = own_ranks(d, {"_s": F.when(c("_side") != 0, c("_y"))}, (*keys, "_side"))

    def corr(side: str, of: Column) -> Column:
        ok = c("_f").isNotNull() & c(side).isNotNull() & of
        f, y_ = F.when(ok, c("_f")), F.when(ok, c(side))
        sd = F.stddev_pop(f) * F.stddev_pop(y_)
        return F.when((F.count(f) >= 2) & (sd > 1e-12), F.covar_pop(f, y_) / sd)

    return d.groupBy(*keys).agg(corr("_r", F.lit(True)).alias("ic"), corr("_s", c("_side") == 1).alias("top"), corr("_s", c("_side") == -1).alias("bottom"))


def two_ics(df: DataFrame, x: str, y: str) -> DataFrame:
    """period, ic, long_ic: the whole IC, and that of the upper half if the whole mean is positive, else the negative of the lower half's."""
    h = halves(df, x, y)
    sign = h.agg((F.avg("ic") > 0).alias("_up"))  # one row
    return h.crossJoin(F.broadcast(sign)).select("period", "ic", F.when(c("_up"), c("top")).otherwise(-c("bottom")).alias("long_ic"))


def long_only_mask(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with x null in the half that its mean IC says not to hold, and turned round if that is the upper one."""
    sign = halves(df, x, y).agg((F.avg("ic") > 0).alias("_up"))  # one row
    d = own_ranks(df, {"_p": x}).crossJoin(F.broadcast(sign))
    held = F.when(c("_up"), F.when(c("_p") >= 0.5, c(x))).otherwise(F.when(c("_p") <= 0.5, -c(x)))
    return d.withColumn(x, held).drop("_p", "_up")


def pearson(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9) -> DataFrame:
    """abs of the mean period correlation; 0 without one."""
    return ic_rows(masked(df, x, least), x, y).agg(_value(F.abs(F.avg("ic")), 0.0))


def alert_pearson(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9) -> DataFrame:
    """The mean period correlation with its sign; -1 without one."""
    return ic_rows(masked(df, x, least), x, y).agg(_value(F.avg("ic"), -1.0))


def spearman(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9) -> DataFrame:
    """abs of the mean correlation of percentile ranks, each side ranked among all its own values; 0 without one."""
    return ic_rows(_ranked(masked(df, x, least), x, y), "_f", "_r").agg(_value(F.abs(F.avg("ic")), 0.0))


def alert_ic(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9) -> DataFrame:
    """The mean correlation of percentile ranks with its sign; -1 without one."""
    return ic_rows(_ranked(masked(df, x, least), x, y), "_f", "_r").agg(_value(F.avg("ic"), -1.0))


def alert_icir(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean rank IC over its deviation, times the root of the number of dates; -100 without one. Ranks among the cells that have both: percentile ranks among all of a date's would
    have the same order, so they aren't taken first."""
    rows = ic_rows(masked(df, x, least, by), x, y, "spearman", by=by)
    return rows.groupBy(*by).agg(_value(F.try_divide(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.count("ic")), -100.0))


def neutral_ic(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9) -> DataFrame:
    """abs of the mean correlation of x's percentile ranks with those of what the styles leave of y; 0 without one."""
    d = neutral(masked(df, x, least), y, list(styles))
    return ic_rows(_ranked(d, x, "_residual"), "_f", "_r").agg(_value(F.abs(F.avg("ic")), 0.0))


def long_only_neutral_ic(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9, by: tuple[str, ...] = ()) -> DataFrame:
    """abs of the mean IC in the upper half of x if the whole mean IC is positive, else in the lower, against what the styles leave of y; 0 without one."""
    if by:
        h = halves(masked(df, x, least, by).where(c(x).isNotNull()), x, "_residual", by, "_residual_rank")
    else:
        h = halves(neutral(masked(df, x, least), y, list(styles)), x, "_residual")
    return h.groupBy(*by).agg(_value(F.abs(F.when(F.avg("ic") > 0, F.avg("top")).otherwise(F.avg("bottom"))), 0.0))


def hedge_sharpe(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9, periods: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """See metrics.hedge_sharpe; y are the excess returns."""
    return metrics.hedge_sharpe(masked(df, x, least, by), x, y, periods, by=by).select(*by, c("hedge_sharpe").alias("value"))


def neutral_hedge_sharpe(df: DataFrame, x: str, y: str, styles=(), least: float = 0.9, periods: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """The same on what the styles leave of y."""
    d = masked(df, x, least, by)
    return metrics.hedge_sharpe(d if by else neutral(d, y, list(styles)), x, "_residual", periods, by=by).select(*by, c("hedge_sharpe").alias("value"))


def prepared(name: str, df: DataFrame, y: str, styles: list[str]) -> DataFrame:
    """df with what a metric that takes `by` needs of the label, whatever the factor: its residual, and that one's ranks."""
    if "neutral" in name:
        df = neutral(df, y, styles)
    return own_ranks(df, {"_residual_rank": "_residual"}) if name == "long_only_neutral_ic" else df


#: name -> (function(df, x, y, styles, least) that gives one row with `value`, whether more is better)
METRICS: dict[str, tuple[Callable, bool]] = {
    f.__name__: (f, True) for f in (pearson, alert_pearson, spearman, alert_ic, alert_icir, neutral_ic, long_only_neutral_ic, hedge_sharpe, neutral_hedge_sharpe)
}


def register_metric(name: str, f: Callable, greater_is_better: bool, sample: DataFrame) -> None:
    """A metric of one's own: f(df, x, y) gives one row with a number `value`. It is tried on `sample` (entity, period, x, y, restricted) first."""
    if not isinstance(greater_is_better, bool):
        raise ValueError("greater_is_better is True or False")
    if f.__code__.co_argcount < 3:
        raise ValueError("a metric takes (df, x, y)")
    got = f(sample, "x", "y").collect()
    if len(got) != 1 or not isinstance(got[0]["value"], (int, float)):
        raise ValueError("a metric gives one row with a number")
    METRICS[name] = (f, greater_is_better)


def metric(name: str, df: DataFrame, x: str, y: str, **options) -> DataFrame:
    if name not in METRICS:
        raise KeyError(f"no metric {name}")
    return METRICS[name][0](df, x, y, **options)
