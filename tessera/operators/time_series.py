"""Operators along the rows of one entity, on a dense calendar. d is the operator's parameter; w the window it spans."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.elementwise import both
from ..plans.flow import Flow, along, entity_rows

c = F.col


def enough(w: int) -> int:
    return max(1, math.floor(0.75 * w))


def n(x, k: int) -> Column:
    return F.count(x).over(along(k))


def avg(x, k: int) -> Column:
    return F.avg(x).over(along(k))


def hi(x, k: int) -> Column:
    return F.max(x).over(along(k))


def lo(x, k: int) -> Column:
    return F.min(x).over(along(k))


def lag(x, k: int) -> Column:
    return F.lag(x, k).over(entity_rows())


def full(k: int) -> Column:
    """Whether the calendar has k rows up to here."""
    return c("qidx") >= k - 1


def varies(x, k: int) -> Column:
    return hi(x, k) - lo(x, k) > 1e-8


def values(x: str, k: int) -> Column:
    """The window as an array, missing rows as nulls."""
    return F.transform(F.collect_list(F.struct(c(x).alias("v"))).over(along(k)), lambda s: s["v"])


def one(build):
    """An operator of one layer: build(x, d) is its column."""
    return lambda f, x, d: f.ts(build(x, d), x)


def two(build):
    return lambda f, x, y, d: f.ts(build(x, y, d), x, y)


def _change(x: str, d: int) -> Column:
    return F.try_divide(c(x) - lag(x, d), F.abs(lag(x, d)))


def _guarded_change(x: str, d: int) -> Column:
    return F.when(F.abs(lag(x, d)) > 1e-10, (c(x) - lag(x, d)) / F.abs(lag(x, d)))


def growth_stability(f: Flow, x: str, d: int) -> str:
    g = f.ts(_change(x, 1), x)
    w = d + 1
    return f.ts(F.when(n(g, w) >= enough(w), F.try_divide(avg(g, w), F.stddev_pop(g).over(along(w)))), g)


def _zscore(x: str, d: int) -> Column:
    w = d + 1
    sd = F.stddev_pop(x).over(along(w))
    return F.when((n(x, w) >= enough(w)) & (sd > 1e-6), (c(x) - avg(x, w)) / sd)


def _product(x: str, d: int) -> Column:
    w = d + 1
    p = F.aggregate(values(x, w), F.lit(1.0), lambda a, v: a * F.coalesce(v, F.lit(1.0)))
    return F.when(n(x, w) == w, F.greatest(F.lit(-10000.0), F.least(F.lit(10000.0), p)))


def rank(f: Flow, x: str, d: int) -> str:
    a = f.ts(values(x, d + 1), x)
    below, same = F.size(F.filter(c(a), lambda v: v < c(x))), F.size(F.filter(c(a), lambda v: v == c(x)))
    k = F.size(F.filter(c(a), lambda v: v.isNotNull()))
    return f.ew(F.when(c(x).isNotNull() & (k >= 2), (below + 0.5 * (same - 1)) / (k - 1)), a, x)


def pairs(f: Flow, x: str, y: str) -> tuple[str, str]:
    return f.ew(both(c(y), c(x), c(x)), x, y), f.ew(both(c(x), c(y), c(y)), x, y)


def cov(f: Flow, x: str, y: str, d: int) -> str:
    a, b = pairs(f, x, y)
    w = d + 2
    return f.ts(F.when(n(a, w) >= 3, F.covar_samp(a, b).over(along(w))), a, b)


def _corr(f: Flow, x: str, y: str, w: int) -> str:
    """Pearson's correlation of the pairs; 1 where the product of variances is tiny, missing where a side hardly moves."""
    a, b = pairs(f, x, y)
    scale = F.sqrt(F.var_samp(a).over(along(w)) * F.var_samp(b).over(along(w)))
    r = F.when(scale > 1e-6, F.covar_samp(a, b).over(along(w)) / scale).otherwise(1.0)
    return f.ts(F.when((n(a, w) >= 2) & varies(a, w) & varies(b, w), r), a, b)


def corr(f: Flow, x: str, y: str, d: int) -> str:
    return _corr(f, x, y, d + 2)


def autocorr(k: int):
    return lambda f, x, d: _corr(f, x, f.ts(lag(x, k), x), d + 2)


def _skew(x: str, k: int) -> Column:
    m = n(x, k)
    return F.when((m >= 3) & varies(x, k), F.skewness(x).over(along(k)) * F.sqrt(m * (m - 1)) / (m - 2))


def _kurt(x: str, k: int) -> Column:
    m = n(x, k)
    return F.when((m >= 4) & varies(x, k), ((m + 1) * F.kurtosis(x).over(along(k)) + 6) * (m - 1) / ((m - 2) * (m - 3)))


def _time(x: str) -> Column:
    return F.when(c(x).isNotNull(), c("qidx").cast("double"))


def autoslope(f: Flow, x: str, d: int) -> str:
    w = d + 2
    t = f.ew(_time(x), x)
    s = f.ts(F.when((n(x, w) >= 2) & (F.var_samp(x).over(along(w)) > 1e-4), F.covar_samp(x, t).over(along(w)) / F.var_samp(x).over(along(w))), x, t)
    return f.ts(F.when(varies(x, w), lag(s, 1)), s, x)


def _position(x: str, d: int, least: bool) -> Column:
    a = values(x, d + 1)
    known = F.filter(a, lambda v: v.isNotNull())
    return F.when(n(x, d + 1) >= 1, (F.array_position(a, F.array_min(known) if least else F.array_max(known)) - 1).cast("double"))


def forecast(f: Flow, x: str, w: int) -> str:
    """The next row's value on the least-squares line of the window."""
    t = f.ew(_time(x), x)
    slope = F.regr_slope(c(x), c(t)).over(along(w))
    return f.ts(F.when(n(x, w) >= max(2, int(w * 2 / 3)), avg(x, w) + slope * (c("qidx") + 1 - avg(t, w))), x, t)


def _cut(up: bool):
    def op(f: Flow, x: str, y: str, d: int) -> str:
        """Mean of x over the window before this row, where y lies beyond its lowest tenth."""
        w = d + 1
        rows = f.ts(F.collect_list(F.struct(c(x).alias("x"), c(y).alias("y"))).over(entity_rows().rowsBetween(-w, -1)), x, y)
        known = F.array_sort(F.filter(F.transform(c(rows), lambda r: F.when(r.x.isNotNull(), r.y)), lambda v: v.isNotNull()))
        m = F.size(known)
        at = (F.ceil if up else F.floor)((m - 1) * 0.1).cast("int") + 1
        edge = f.ew(F.when(m > 2, F.try_element_at(known, at)), rows)
        beyond = F.transform(F.filter(c(rows), lambda r: r.x.isNotNull() & ((r.y > c(edge)) if up else (r.y < c(edge)))), lambda r: r.x)
        mean = F.aggregate(beyond, F.lit(0.0), lambda s, v: s + v) / F.size(beyond)
        ok = (F.size(rows) == w) if up else F.lit(True)
        return f.ew(F.when(ok & (F.size(beyond) > 0), mean), rows, edge)

    return op


def _count(any_: bool):
    def build(f: Flow, x: str, y: str, z: str, d: int) -> str:
        cond = ((c(y) > 0) | (c(z) > 0)) if any_ else ((c(y) > 0) & (c(z) > 0))
        return f.ts(F.sum(F.when(c(x).isNotNull() & cond, 1.0)).over(along(d)), x, y, z)

    return build


def surprise(intercept: bool):
    def op(f: Flow, x: str, d: int) -> str:
        """Distance of x from its first-order autoregression over the previous d rows, in residual deviations."""
        z = f.ts(lag(x, 1), x)
        a, b = pairs(f, x, z)
        w = entity_rows().rowsBetween(-d, -1)
        k, sx, sz = F.count(a).over(w), F.sum(a).over(w), F.sum(b).over(w)
        sxx, szz, sxz = F.sum(c(a) * c(a)).over(w), F.sum(c(b) * c(b)).over(w), F.sum(c(a) * c(b)).over(w)
        if intercept:
            cxx, czz, cxz = sxx - sx * sx / k, szz - sz * sz / k, sxz - sx * sz / k
            beta = F.when(czz > 1e-10, cxz / czz)
            alpha, sse, free = (sx - beta * sz) / k, cxx - beta * cxz, k - 2
        else:
            beta = F.when(szz > 1e-10, sxz / szz)
            alpha, sse, free = F.lit(0.0), sxx - beta * sxz, k - 1
        fit = f.ts(F.when((k >= max(3, math.floor(0.75 * d))) & (free > 0), F.struct(alpha.alias("a"), beta.alias("b"), F.sqrt(F.greatest(sse, F.lit(0.0)) / F.nullif(free, F.lit(0))).alias("e"))), a, b)
        return f.ew(F.when((c("qidx") > d) & (c(fit)["e"] > 1e-10), (c(x) - (c(fit)["a"] + c(fit)["b"] * c(z))) / c(fit)["e"]), fit, x, z)

    return op


def first_slope(f: Flow, x: str, d: int) -> str:
    t = f.ew(_time(x), x)
    return f.ts(F.when(full(d) & (n(x, d) >= max(3, math.floor(0.75 * d))), F.regr_slope(c(x), c(t)).over(along(d))), x, t)


def second_slope(f: Flow, x: str, d: int) -> str:
    """The quadratic coefficient of the least-squares parabola; time counts from the window's first row."""
    rows = f.ts(values(x, d), x)
    pts = F.filter(F.transform(c(rows), lambda v, i: F.struct(v.alias("v"), (i - (d - 1) / 2).alias("t"))), lambda p: p.v.isNotNull())
    s = lambda g: F.aggregate(pts, F.lit(0.0), lambda a, p: a + g(p))
    sums = f.ew(F.struct(*[s(lambda p, k=k: F.pow(p.t, F.lit(float(k)))).alias(f"t{k}") for k in range(5)], *[s(lambda p, k=k: p.v * F.pow(p.t, F.lit(float(k)))).alias(f"v{k}") for k in range(3)]), rows)
    m = c(sums)
    det = m.t0 * (m.t2 * m.t4 - m.t3 * m.t3) - m.t1 * (m.t1 * m.t4 - m.t2 * m.t3) + m.t2 * (m.t1 * m.t3 - m.t2 * m.t2)
    top = m.t0 * (m.t2 * m.v2 - m.t3 * m.v1) - m.t1 * (m.t1 * m.v2 - m.t2 * m.v1) + m.v0 * (m.t1 * m.t3 - m.t2 * m.t2)
    return f.ew(F.when(full(d) & (m.t0 >= max(5, math.floor(0.75 * d))) & (F.abs(det) > 1e-10), top / det), sums)


def roll_resid(f: Flow, y: str, x: str, d: int) -> str:
    a, b = pairs(f, y, x)
    ok = full(d) & (n(a, d) >= max(3, math.floor(0.75 * d))) & (F.regr_sxx(c(a), c(b)).over(along(d)) > 1e-10)
    return f.ts(F.when(ok, c(y) - (avg(a, d) + F.regr_slope(c(a), c(b)).over(along(d)) * (c(x) - avg(b, d)))), a, b, x, y)


def _over(f: Flow, x: str, w: int, out, least: int | None = None) -> str:
    """A function of (array, mean, sample deviation) of a full window that has enough values."""
    a = f.ts(F.struct(values(x, w).alias("a"), avg(x, w).alias("m"), F.stddev_samp(x).over(along(w)).alias("s"), n(x, w).alias("n")), x)
    s = c(a)
    return f.ew(F.when(full(w) & (s.n >= (least or enough(w))), out(s.a, s.m, s.s)), a)


def median_abs_deviation(f: Flow, x: str, d: int) -> str:
    def out(a, m, s):
        v = F.array_sort(F.transform(F.filter(a, lambda v: v.isNotNull()), lambda v: F.abs(v - m)))
        k = F.size(v)
        return (F.try_element_at(v, F.floor((k + 1) / 2).cast("int")) + F.try_element_at(v, (F.floor(k / 2) + 1).cast("int"))) / 2

    return _over(f, x, d + 1, out)


def beyond_sigma(r: float):
    return lambda f, x, d: _over(f, x, d + 1, lambda a, m, s: F.when(s > 1e-10, F.size(F.filter(a, lambda v: F.abs(v - m) > r * s)) / float(d + 1)))


def mass_quantile(q: float):
    def out(a, m, s):
        mass = F.aggregate(a, F.lit(0.0), lambda t, v: t + F.coalesce(F.abs(v), F.lit(0.0)))
        state = F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("i"), F.lit(-1).alias("at"))

        def add(z, v):
            t = z.t + F.coalesce(F.abs(v), F.lit(0.0))
            return F.struct(t.alias("t"), (z.i + 1).alias("i"), F.when((z["at"] < 0) & (t / mass >= q), z.i).otherwise(z["at"]).alias("at"))

        return F.when(mass > 1e-10, F.aggregate(a, state, add)["at"].cast("double"))

    return lambda f, x, d: _over(f, x, d + 1, out)


def crosses_mean(f: Flow, x: str, d: int) -> str:
    def out(a, m, s):
        signs = F.transform(F.filter(a, lambda v: v.isNotNull()), lambda v: F.signum(v - m))
        state = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("n"))
        return F.aggregate(signs, state, lambda z, v: F.struct(v.alias("last"), (z.n + F.when(z.last * v < 0, 1.0).otherwise(0.0)).alias("n")))["n"]

    return _over(f, x, d + 1, out, max(2, enough(d + 1)))


def longest(above: bool):
    def out(a, m, s):
        state = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("best"))

        def add(z, v):
            run = F.when((v > m) if above else (v < m), z.run + 1).otherwise(0.0)
            return F.struct(run.alias("run"), F.greatest(z.best, run).alias("best"))

        return F.aggregate(a, state, add)["best"]

    return lambda f, x, d: _over(f, x, d + 1, out)


def asymmetry(f: Flow, x: str, d: int) -> str:
    w = max(d + 1, 3)
    p = f.ts((c(x) - lag(x, 1)) * (c(x) - lag(x, 1)) * (lag(x, 1) - lag(x, 2)), x)
    return f.ts(F.when(full(w) & (n(x, w) >= enough(w)), avg(p, w - 2)), p, x)


def _normed(top):
    def build(x: str, d: int) -> Column:
        w = d + 1
        rms = F.sqrt(avg(c(x) * c(x), w))
        return F.when((n(x, w) >= enough(w)) & (rms > 1e-10), top(x, w) / rms)

    return build


def _rms(x: str, d: int) -> Column:
    return F.when(n(x, d + 1) >= enough(d + 1), F.sqrt(avg(c(x) * c(x), d + 1)))


def _mean_over_norm(x: str, d: int) -> Column:
    w = d + 1
    return F.when((n(x, w) >= enough(w)) & (avg(F.abs(c(x)), w) > 1e-10), avg(x, w) / avg(F.abs(c(x)), w))


def _quantile(q: float):
    return lambda x, d: F.when(n(x, max(d + 1, 3)) >= enough(max(d + 1, 3)), F.percentile(x, F.lit(q)).over(along(max(d + 1, 3))))


def weighted(weights, renormed: bool):
    """Sum of weights by age; over the weights of the rows present, if renormed."""

    def op(f: Flow, x: str, d: int) -> str:
        w = max(d + 1, 3)
        ws = weights(w)  # from the newest row to the oldest
        v = [c(x) if i == 0 else lag(x, i) for i in range(w)]
        total = sum((F.coalesce(a, F.lit(0.0)) * k for a, k in zip(v, ws)), F.lit(0.0))
        there = sum((F.when(a.isNotNull(), k).otherwise(0.0) for a, k in zip(v, ws)), F.lit(0.0))
        return f.ts(F.when(full(w) & (n(x, w) >= enough(w)), F.try_divide(total, there) if renormed else total), x)

    return op


def exponential(w: int) -> list[float]:
    return [math.exp(1 - 2 * i / (w - 1)) for i in range(w)]


def half_difference(w: int) -> list[float]:
    out = [1.0]
    for k in range(1, w):
        out.append(-out[-1] * (0.5 - k + 1) / k)
    return out


def rolling_ic(f: Flow, x: str, y: str, d: int) -> str:
    w = d + 1
    a, b = pairs(f, x, y)
    var = F.var_samp(x).over(along(w))
    beta = f.ts(F.when((n(a, w) > enough(w)) & (n(x, w) >= enough(w)) & (var > 1e-10), F.covar_samp(a, b).over(along(w)) / var), a, b, x)
    return f.ts(c(x) * lag(beta, 1), x, beta)


def change_long_short(f: Flow, x: str, d: int) -> str:
    w = max(d + 1, 4)
    return f.ts(_change(x, w) - _change(x, w // 2), x)


def _guarded(stat, need):
    return lambda x, k: F.when(n(x, k) >= need(k), stat(x, k))


def long_short(stat, long_w, short_w, need):
    """A statistic over the long window less that over the short one."""

    def op(f: Flow, x: str, d: int) -> str:
        w = long_w(d)
        s = short_w(w)
        return f.ts(_guarded(stat, need)(x, w) - _guarded(stat, need)(x, s), x)

    return op


def _sharp(x: str, k: int) -> Column:
    sd = F.stddev_pop(x).over(along(k))
    return F.when(sd > 1e-10, avg(x, k) / sd)


def forecast_change(f: Flow, x: str, d: int) -> str:
    w = max(d + 1, 4)
    a, b = forecast(f, x, w), forecast(f, x, max(2, w // 2))
    return f.ew(F.when(F.abs(c(b)) > 1e-10, c(a) / c(b) - 1), a, b)


def smooth_position(f: Flow, x: str, d: int) -> str:
    w = max(d + 1, 4)
    s = w // 2
    span = hi(x, w) - lo(x, w)
    ok = (n(x, w) >= enough(w)) & (n(x, s) >= enough(max(2, s))) & (span > 1e-10)
    return f.ts(F.when(ok, (avg(x, s) - lo(x, w)) / span), x)


def over_cs_mean(f: Flow, x: str, d: int) -> str:
    w = d + 1
    m, sd = f.ag(F.avg(x), x), f.ag(F.stddev_pop(x), x)
    z = f.ew(F.when(c(sd) > 1e-10, F.when(c(x) > c(m), 1.0).when(c(x).isNotNull(), 0.0)), x, m, sd)
    return f.ts(F.when(n(z, w) >= enough(w), F.sum(z).over(along(w))), z)


def rsi(f: Flow, x: str, d: int) -> str:
    w = d + 1
    e = f.ts(c(x) - lag(x, 1), x)
    gain, loss = F.greatest(c(e), F.lit(0.0)), F.greatest(-c(e), F.lit(0.0))
    up, down = avg(F.when(c(e).isNotNull(), gain), w), avg(F.when(c(e).isNotNull(), loss), w)
    return f.ts(F.when((n(e, w) >= enough(w)) & (down > 1e-10), 100 - 100 / (1 + up / down)), e)


def rsi_of_change(f: Flow, x: str, d: int) -> str:
    return rsi(f, f.ts(_change(x, 1), x), d)


FAMILIES = {
    "min": (1, one(lambda x, d: lo(x, d + 1))), "max": (1, one(lambda x, d: hi(x, d + 1))), "mean": (1, one(lambda x, d: avg(x, d + 1))),
    "median": (1, one(lambda x, d: F.percentile(x, F.lit(0.5)).over(along(d + 1)))), "grstable": (1, growth_stability), "zscore": (1, one(_zscore)),
    "demean": (1, one(lambda x, d: F.when(n(x, d + 1) >= enough(d + 1), c(x) - avg(x, d + 1)))), "delay": (1, one(lag)), "delta": (1, one(lambda x, d: c(x) - lag(x, d))), "product": (1, one(_product)),
    "ttm": (1, one(lambda x, d: F.sum(x).over(along(d)))), "pct": (1, one(_change)), "growth": (1, one(_change)), "rank": (1, rank), "std": (1, one(lambda x, d: F.when(n(x, d + 2) >= 2, F.stddev_samp(x).over(along(d + 2))))),
    "cov": (2, cov), "corr": (2, corr), "skew": (1, one(lambda x, d: _skew(x, d + 2))), "kurt": (1, one(lambda x, d: _kurt(x, d + 2))), **{f"autocorr_lag{k}": (1, autocorr(k)) for k in range(1, 6)},
    "autoslope": (1, autoslope), "argmin": (1, one(lambda x, d: _position(x, d, True))), "argmax": (1, one(lambda x, d: _position(x, d, False))), "decay_linear": (1, lambda f, x, d: forecast(f, x, d + 1)),
    "cut_up_q1": (2, _cut(True)), "cut_down_q1": (2, _cut(False)), "count_and": (3, _count(False)), "count_or": (3, _count(True)), "last": (1, one(lag)), "avg": (1, one(lambda x, d: (c(x) + lag(x, d)) / 2)),
    "qoq": (1, one(_guarded_change)), "yoy": (1, one(_guarded_change)), "diff1q": (1, one(lambda x, d: c(x) - lag(x, d))), "diff4q": (1, one(lambda x, d: c(x) - lag(x, d))),
    "sue0_score": (1, surprise(False)), "sue1_score": (1, surprise(True)), "first_slope": (1, first_slope), "second_slope": (1, second_slope), "roll_resid": (2, roll_resid),
    "median_abs_deviation": (1, median_abs_deviation), "rms": (1, one(_rms)), "norm_mean": (1, one(_normed(avg))), "norm_max": (1, one(_normed(hi))), "norm_min": (1, one(_normed(lo))),
    "norm_min_max": (1, one(_normed(lambda x, w: hi(x, w) - lo(x, w)))), "ratio_beyond_sigma_2": (1, beyond_sigma(2)), "ratio_beyond_sigma_3": (1, beyond_sigma(3)), "index_mass_quantile_q25": (1, mass_quantile(0.25)),
    "number_cross_mean": (1, crosses_mean), "time_asymmetry_stats": (1, asymmetry), "longest_strike_above_mean": (1, longest(True)), "longest_strike_below_mean": (1, longest(False)), "mean_over_1norm": (1, one(_mean_over_norm)),
    "quantile_q25": (1, one(_quantile(0.25))), "decay_exp": (1, weighted(exponential, True)), "fw_fracdiff": (1, weighted(half_difference, False)), "rolling_ic": (2, rolling_ic), "pctchg_lms": (1, change_long_short),
    "stddev_lms": (1, long_short(lambda x, k: F.stddev_samp(x).over(along(k)), lambda d: max(d + 2, 4), lambda w: w // 2, lambda k: enough(max(2, k)))),
    "sharp": (1, one(lambda x, d: F.when(n(x, d + 2) >= enough(d + 2), _sharp(x, d + 2)))), "sharp_lms": (1, long_short(_sharp, lambda d: max(d + 2, 4), lambda w: w // 2, enough)),
    "skew_lms": (1, long_short(_skew, lambda d: max(d + 2, 6), lambda w: max(3, w // 2), lambda k: max(3, enough(k)))), "kurtosis_lms": (1, long_short(_kurt, lambda d: max(d + 2, 8), lambda w: max(4, w // 2), lambda k: max(4, enough(k)))),
    "decay_linear_pctchg": (1, forecast_change), "smooth_pos_gp": (1, smooth_position), "count_over_cs_mean": (1, over_cs_mean), "rsi": (1, rsi), "rsi_of_pctchg": (1, rsi_of_change),
    "signmul": (2, two(lambda x, y, d: F.when(n(x, d + 1) >= enough(d + 1), F.signum(c(x) - avg(x, d + 1)) * c(y)))),
}
