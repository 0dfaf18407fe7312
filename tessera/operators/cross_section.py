"""Operators across the entities of one date. Each takes the flow and names of columns and gives the name of its result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.elementwise import BINARY, TERNARY, UNARY, both, ratio
from ..plans.flow import Flow
from .ranking import SPREAD

c = F.col


def average_rank(f: Flow, x: str, *by: str) -> str:
    """1 for the smallest of a date (and of `by`); ties share their mean rank; null stays null.

    In f.parts ranges, between approximate quantiles of the date: a value's rank is the number of values in the ranges below and its rank in its own.
    """
    if f.parts < 2:
        w = Window.partitionBy("period", *by, c(x).isNotNull())
        ties = F.count(F.lit(1)).over(Window.partitionBy("period", *by, x))
        return f.cs(F.when(c(x).isNotNull(), F.rank().over(w.orderBy(x)) + (ties - 1) / 2), x, *by, by=("period", *by))
    group = ("period", *by)
    bounds = f.ag(F.percentile_approx(x, [i / f.parts for i in range(1, f.parts)], 100 * f.parts), x, *by, by=group)
    # rows without a value are dealt out
    none = -1 - F.pmod(F.xxhash64("entity", "period"), F.lit(SPREAD)).cast("int")
    part = f.ew(F.when(c(x).isNotNull(), F.size(F.filter(bounds, lambda b: b < c(x)))).otherwise(none), x, bounds)
    sizes = f.ag(F.array(*[F.count(F.when(c(part) == i, 1)) for i in range(f.parts)]), part, *by, by=group)
    # a number goes along with the rows, no array
    below = f.ew(F.when(c(part) >= 0, F.aggregate(F.slice(sizes, 1, F.greatest(c(part), F.lit(0))), F.lit(0).cast("long"), lambda a, n: a + n)), part, sizes)
    w = Window.partitionBy(*group, part)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, part, x))
    return f.cs(c(below) + F.rank().over(w.orderBy(x)) + (ties - 1) / 2, x, part, below, *by, by=(*group, part))


def mean_and_dev(f: Flow, x: str, by: tuple[str, ...] = ("period",)) -> tuple[str, str]:
    return f.ag(F.avg(x), x, by=by), f.ag(F.stddev_samp(x), x, by=by)


def zscore(f: Flow, x: str) -> str:
    m, sd = mean_and_dev(f, x)
    return f.ew(F.when(c(sd) >= 1e-10, (c(x) - c(m)) / c(sd)), x, m, sd)


def rank(f: Flow, x: str) -> str:
    return average_rank(f, x)


def pct_rank(f: Flow, x: str, *by: str) -> str:
    """The rank over the number of values."""
    r, n = average_rank(f, x, *by), f.ag(F.count(x), x, *by, by=("period", *by))
    return f.ew(c(r) / c(n), r, n)


def residual(f: Flow, y: str, x: str) -> str:
    pair = c(x).isNotNull() & c(y).isNotNull()
    fit = f.ag(
        F.struct(
            F.regr_slope(c(y), c(x)).alias("slope"), F.regr_intercept(c(y), c(x)).alias("cut"), F.count(F.when(pair, 1)).alias("pairs"),
            F.avg(both(c(x), c(y), c(y))).alias("mean"), (F.var_pop(both(c(y), c(x), c(x))) < 1e-24).alias("flat"),
        ), y, x,
    )
    line = F.when(c(fit)["flat"], c(y) - c(fit)["mean"]).otherwise(c(y) - (c(fit)["cut"] + c(fit)["slope"] * c(x)))
    return f.ew(F.when(c(fit)["pairs"] >= 2, both(c(x), c(y), line)), y, x, fit)


def regressor(f: Flow, y: str, x: str) -> str:
    slope = f.ag(F.when(F.regr_sxx(c(y), c(x)) > 1e-12, F.regr_slope(c(y), c(x))), y, x)
    return f.ew(both(c(x), c(y), c(slope)), y, x, slope)


def ind_neutral(f: Flow, x: str) -> str:
    m, sd = mean_and_dev(f, x, ("period", "industry"))
    z = F.when((c("industry") > 0) & (c(sd) > 0), (c(x) - c(m)) / c(sd))
    return f.ew(F.when(z.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z))), x, m, sd)


def ind_rank(f: Flow, x: str) -> str:
    r = pct_rank(f, x, "industry")
    return f.ew(F.when(c("industry") > 0, c(r)), r)


def demean(f: Flow, x: str) -> str:
    m = f.ag(F.avg(x), x)
    return f.ew(c(x) - c(m), x, m)


def sign_mul(f: Flow, x: str, y: str) -> str:
    m = f.ag(F.avg(x), x)
    return f.ew(F.signum((c(x) - c(m)) * c(y)), x, y, m)


def from_median(f: Flow, x: str) -> str:
    m = f.ag(F.percentile(x, F.lit(0.5)), x)
    return f.ew(-F.abs(c(x) - c(m)), x, m)


def of_two(each, out):
    """An operator that applies `each` to both arguments and then combines."""

    def op(f: Flow, x: str, y: str) -> str:
        a, b = each(f, x), each(f, y)
        return f.ew(out(c(a), c(b)), a, b)

    return op


def fold(f: Flow, x: str) -> str:
    r = rank(f, x)
    return f.ew(F.abs(2 * c(r) - 1), r)


def double_scored(f: Flow, x: str, y: str) -> str:
    """Half the percentile rank of x, half that of y inside x's quintile (edges from the linear percentiles, repeated ones once)."""
    px, py = f.ew(both(c(y), c(x), c(x)), x, y), f.ew(both(c(x), c(y), c(y)), x, y)
    r, n = average_rank(f, px), f.ag(F.count(px), px)
    rx = f.ew(F.when(c(n) >= 5, c(r) / c(n)), r, n)
    edges = f.ag(F.array_distinct(F.percentile(rx, F.array(*[F.lit(i / 5) for i in range(6)]))), rx)
    # right-closed bins, the lowest value in the first
    bin_ = f.ew(F.when(c(rx).isNotNull(), F.greatest(F.lit(1), F.size(F.filter(edges, lambda e: e < c(rx))))), rx, edges)
    inside = f.ag(F.count(py), py, bin_, by=("period", bin_))
    ry = pct_rank(f, py, bin_)
    return f.ew(F.when(c(rx).isNotNull() & (c(inside) >= 2), 0.5 * c(rx) + 0.5 * c(ry)), rx, ry, inside)


def _ew(build, arity):
    return lambda f, *x: f.ew(build(*[c(a) for a in x]), *x)


OPERATORS = {name: (n, _ew(build, n)) for n, table in ((1, UNARY), (2, BINARY), (3, TERNARY)) for name, build in table.items()}
OPERATORS |= {
    "cs_rank": (1, rank), "cs_ortho": (2, residual), "cs_residual": (2, residual), "cs_regressor": (2, regressor), "cs_indneutral": (1, ind_neutral), "cs_indrank": (1, ind_rank), "cs_fold": (1, fold),
    "cs_demean": (1, demean), "cs_signmul": (2, sign_mul), "cs_zscore": (1, zscore), "cs_switch_packet_flexible": (1, from_median),
    "cs_zscore_diff": (2, of_two(zscore, lambda a, b: a - b)), "cs_rank_diff": (2, of_two(rank, lambda a, b: a - b)), "cs_zscore_add": (2, of_two(zscore, lambda a, b: a + b)),
    "cs_zscore_min": (2, of_two(zscore, lambda a, b: both(a, b, F.least(a, b)))), "cs_zscore_max": (2, of_two(zscore, lambda a, b: both(a, b, F.greatest(a, b)))),
    "cs_zscore_mul": (2, of_two(zscore, lambda a, b: a * b)), "cs_zscore_ratio": (2, of_two(zscore, lambda a, b: ratio(a, b, 1e-10) - 1)),
    "cs_zscore_imbalance_coef": (2, of_two(zscore, lambda a, b: ratio(a - b, a + b, 1e-10))), "cs_zscore_harmonic_mean": (2, of_two(zscore, lambda a, b: ratio(a * b, a + b, 1e-10))),
    "cs_double_scored": (2, double_scored),
}
