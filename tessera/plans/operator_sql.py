"""DuckDB SQL for each operator, over the part panel."""

from __future__ import annotations

import math

from ..sources.panel import PART_PANEL_SQL

D = "OVER (PARTITION BY period)"


def w(k: int) -> str:
    return f"OVER (PARTITION BY entity ORDER BY qidx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def m(k: int) -> int:
    return max(1, math.floor(0.75 * k))


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY entity ORDER BY qidx)"


def avg_rank(x: str, by: str = "period") -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2::DOUBLE END)"


def z(x: str) -> str:
    return f"(CASE WHEN stddev_samp({x}) {D} >= 1e-10 THEN ({x} - avg({x}) {D}) / stddev_samp({x}) {D} END)"


def query(value: str, *layers: dict[str, str], nudge: float = 0.0) -> str:
    """value over the panel; each layer's columns are computed on the one before."""
    ctes, at = [PART_PANEL_SQL], "p"
    for i, layer in enumerate(layers):
        ctes.append(f"l{i} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {at})")
        at = f"l{i}"
    return f"WITH {', '.join(ctes)}, r AS (SELECT entity, qidx, ({value})::DOUBLE AS v FROM {at}) SELECT entity, qidx, round(v + {nudge!r}::DOUBLE, 6) + 0 AS value FROM r"


XY = {"px": "CASE WHEN y IS NOT NULL THEN x END", "py": "CASE WHEN x IS NOT NULL THEN y END"}
ZZ = {"zx": z("x"), "zy": z("y")}
IND = "OVER (PARTITION BY period, industry)"

CROSS = {
    "cs_sin": ("sin(x)",), "cs_cos": ("cos(x)",), "cs_tan": ("tan(x)",), "cs_add": ("x + y",), "cs_sub": ("x - y",), "cs_mul": ("x * y",),
    "cs_div": ("CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN abs(y) > 1e-3 THEN x / y ELSE 1 END",),
    "cs_max": ("CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END",), "cs_min": ("CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END",),
    "cs_abs": ("abs(y)",), "cs_neg": ("-x",), "cs_sqrt": ("sqrt(abs(x))",), "cs_inv": ("CASE WHEN x IS NULL THEN NULL WHEN abs(x) > 1e-3 THEN 1 / x ELSE 0 END",), "cs_log": ("ln(1 + abs(x))",),
    "cs_rank": (avg_rank("x"),), "cs_power_third": ("sign(x) * pow(abs(x), 1/3::DOUBLE)",), "cs_power_2": ("x * x",), "cs_power_3": ("x * x * x",), "cs_sigmoid": ("1 / (1 + exp(-x))",),
    "cs_condition_and": ("CASE WHEN y > 0 AND z > 0 THEN x END",), "cs_condition_or": ("CASE WHEN y > 0 OR z > 0 THEN x END",), "cs_mask_ifelse": ("CASE WHEN x > 0 THEN y WHEN x <= 0 THEN z END",),
    "cs_sign": ("sign(y)",), "cs_signed_square": ("sign(y) * y * y",), "cs_demean": (f"x - avg(x) {D}",), "cs_signmul": (f"sign((x - avg(x) {D}) * y)",), "cs_zscore": (z("x"),),
    "cs_switch_packet_flexible": (f"-abs(x - quantile_cont(x, 0.5) {D})",), "cs_fold": (f"abs(2 * {avg_rank('x')} - 1)",),
    "cs_indneutral": (f"CASE WHEN industry > 0 AND stddev_samp(x) {IND} > 0 AND x IS NOT NULL THEN greatest(-3, least(3, (x - avg(x) {IND}) / stddev_samp(x) {IND})) END",),
    "cs_indrank": (f"CASE WHEN industry > 0 THEN {avg_rank('x', 'period, industry')} / count(x) {IND} END",),
    "cs_zscore_diff": ("zx - zy", ZZ), "cs_rank_diff": (f"{avg_rank('x')} - {avg_rank('y')}",), "cs_zscore_add": ("zx + zy", ZZ), "cs_zscore_mul": ("zx * zy", ZZ),
    "cs_zscore_min": ("CASE WHEN zx IS NOT NULL AND zy IS NOT NULL THEN least(zx, zy) END", ZZ), "cs_zscore_max": ("CASE WHEN zx IS NOT NULL AND zy IS NOT NULL THEN greatest(zx, zy) END", ZZ),
    "cs_zscore_ratio": ("CASE WHEN abs(zy) > 1e-10 THEN zx / zy - 1 END", ZZ), "cs_imbalance_coef": ("CASE WHEN abs(x + y) > 1e-10 THEN (x - y) / (x + y) END",),
    "cs_zscore_imbalance_coef": ("CASE WHEN abs(zx + zy) > 1e-10 THEN (zx - zy) / (zx + zy) END", ZZ), "cs_zscore_harmonic_mean": ("CASE WHEN abs(zx + zy) > 1e-10 THEN zx * zy / (zx + zy) END", ZZ),
    "cs_residual": (f"CASE WHEN count(px) {D} >= 2 AND px IS NOT NULL THEN px - avg(px) {D} - CASE WHEN var_pop(py) {D} < 1e-24 THEN 0 ELSE covar_pop(px, py) {D} / var_pop(py) {D} * (py - avg(py) {D}) END END", XY),
    "cs_regressor": (f"CASE WHEN px IS NOT NULL AND count(px) {D} * var_pop(py) {D} > 1e-12 THEN covar_pop(px, py) {D} / var_pop(py) {D} END", XY),
    "cs_double_scored": (
        "CASE WHEN rx IS NOT NULL AND count(py) OVER (PARTITION BY period, bin) >= 2 THEN 0.5::DOUBLE * rx + 0.5::DOUBLE * ry / count(py) OVER (PARTITION BY period, bin) END", XY,
        {"rx": f"CASE WHEN count(px) {D} >= 5 THEN {avg_rank('px')} / count(px) {D} END"},
        {"e": f"list_distinct(quantile_cont(rx, [0, 0.2, 0.4, 0.6, 0.8, 1]) {D})"},
        {"bin": "CASE WHEN rx IS NOT NULL THEN greatest(1, len(list_filter(e, lambda t: t < rx))) END"},
        {"ry": avg_rank("py", "period, bin")},
    ),
}
CROSS["cs_ortho"] = CROSS["cs_residual"]

#: families of the shapes that several share
A = "list_filter(a, lambda t: t IS NOT NULL)"


def arr(k: int, x: str = "x") -> dict[str, str]:
    return {"a": f"list({x}) {w(k)}", "mu": f"avg({x}) {w(k)}", "sd": f"stddev_samp({x}) {w(k)}", "n": f"count({x}) {w(k)}"}


def on_full(k: int, value: str, least: int | None = None) -> str:
    return f"CASE WHEN qidx >= {k - 1} AND n >= {least or m(k)} THEN {value} END"


def varies(x: str, k: int) -> str:
    return f"max({x}) {w(k)} - min({x}) {w(k)} > 1e-8"


def corr(a: str, b: str, k: int) -> str:
    s = f"sqrt(var_samp({a}) {w(k)} * var_samp({b}) {w(k)})"
    return f"CASE WHEN count({a}) {w(k)} >= 2 AND {varies(a, k)} AND {varies(b, k)} THEN CASE WHEN {s} > 1e-6 THEN covar_samp({a}, {b}) {w(k)} / {s} ELSE 1 END END"


def skew(k: int) -> str:
    n = f"(count(x) {w(k)})"
    return f"CASE WHEN {n} >= 3 AND {varies('x', k)} THEN skewness(x) {w(k)} END"


def kurt(k: int) -> str:
    n = f"(count(x) {w(k)})"
    return f"CASE WHEN {n} >= 4 AND {varies('x', k)} THEN kurtosis(x) {w(k)} END"


def change(x: str, k: int) -> str:
    return f"CASE WHEN {lag(x, k)} <> 0 THEN ({x} - {lag(x, k)}) / abs({lag(x, k)}) END"


def normed(top: str, k: int) -> str:
    return f"CASE WHEN count(x) {w(k)} >= {m(k)} AND sqrt(avg(x * x) {w(k)}) > 1e-10 THEN ({top}) / sqrt(avg(x * x) {w(k)}) END"


def forecast(k: int) -> str:
    return f"CASE WHEN count(x) {w(k)} >= {max(2, int(2 * k / 3))} AND var_pop(t) {w(k)} > 0 THEN avg(x) {w(k)} + covar_pop(x, t) {w(k)} / var_pop(t) {w(k)} * (qidx + 1 - avg(t) {w(k)}) END"


T = {"t": "CASE WHEN x IS NOT NULL THEN qidx::DOUBLE END"}


def sharp(k: int) -> str:
    return f"CASE WHEN count(x) {w(k)} >= {m(k)} AND stddev_pop(x) {w(k)} > 1e-10 THEN avg(x) {w(k)} / stddev_pop(x) {w(k)} END"


def cut(up: bool, d: int) -> tuple:
    k = d + 1
    rows = f"list({{'x': x, 'y': y}}) OVER (PARTITION BY entity ORDER BY qidx ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    ys = "list_sort(list_transform(list_filter(s, lambda r: r.x IS NOT NULL AND r.y IS NOT NULL), lambda r: r.y))"
    at = f"({'ceil' if up else 'floor'}((len(ys) - 1) * 0.1::DOUBLE))::INTEGER + 1"
    sel = f"list_filter(s, lambda r: r.x IS NOT NULL AND r.y {'>' if up else '<'} edge)"
    return (f"CASE WHEN {'len(s) = ' + str(k) if up else 'true'} THEN list_avg(list_transform({sel}, lambda r: r.x)) END", {"s": rows}, {"ys": ys}, {"edge": f"CASE WHEN len(ys) > 2 THEN ys[{at}] END"})


def surprise(intercept: bool, d: int) -> tuple:
    o = f"OVER (PARTITION BY entity ORDER BY qidx ROWS BETWEEN {d} PRECEDING AND 1 PRECEDING)"
    s = {"k": f"count(pa) {o}", "sx": f"sum(pa) {o}", "sz": f"sum(pb) {o}", "sxx": f"sum(pa * pa) {o}", "szz": f"sum(pb * pb) {o}", "sxz": f"sum(pa * pb) {o}"}
    if intercept:
        c = {"czz": "szz - sz * sz / k", "cxz": "sxz - sx * sz / k", "cxx": "sxx - sx * sx / k", "free": "k - 2"}
        fit = {"beta": "CASE WHEN czz > 1e-10 THEN cxz / czz END"}
        more = {"alpha": "(sx - beta * sz) / k", "sse": "cxx - beta * cxz"}
    else:
        c, fit, more = {"free": "k - 1"}, {"beta": "CASE WHEN szz > 1e-10 THEN sxz / szz END"}, {"alpha": "0", "sse": "sxx - beta * sxz"}
    err = {"e": "CASE WHEN free > 0 THEN sqrt(greatest(sse, 0) / free) END"}
    ok = f"k >= {max(3, math.floor(0.75 * d))} AND qidx > {d} AND e > 1e-10"
    return (f"CASE WHEN {ok} THEN (x - (alpha + beta * zl)) / e END", {"zl": lag("x")}, {"pa": "CASE WHEN zl IS NOT NULL THEN x END", "pb": "CASE WHEN x IS NOT NULL THEN zl END"}, s, c, fit, more, err)


def second(d: int) -> tuple:
    s = {f"t{i}": f"coalesce(list_sum(list_transform(pts, lambda q: pow(q.t, {i}))), 0)" for i in range(5)} | {f"v{i}": f"coalesce(list_sum(list_transform(pts, lambda q: q.v * pow(q.t, {i}))), 0)" for i in range(3)}
    det = "t0*(t2*t4-t3*t3) - t1*(t1*t4-t2*t3) + t2*(t1*t3-t2*t2)"
    top = "t0*(t2*v2-t3*v1) - t1*(t1*v2-t2*v1) + v0*(t1*t3-t2*t2)"
    pts = f"list_filter(list_transform(a, lambda v, i: {{'v': v, 't': i - 1 - {(d - 1) / 2}::DOUBLE}}), lambda q: q.v IS NOT NULL)"
    return (f"CASE WHEN qidx >= {d - 1} AND t0 >= {max(5, math.floor(0.75 * d))} AND abs({det}) > 1e-10 THEN ({top}) / ({det}) END", arr(d), {"pts": pts}, s)


def strike(sign: str, d: int) -> tuple:
    runs = f"list_transform(string_split(array_to_string(list_transform(a, lambda v: CASE WHEN v {sign} mu THEN '1' ELSE '0' END), ''), '0'), lambda s: len(s))"
    return (on_full(d + 1, f"list_max({runs})"), arr(d + 1))


def weighted(ws: list[float], renormed: bool) -> tuple:
    k = len(ws)
    v = {f"v{i}": "x" if i == 0 else lag("x", i) for i in range(k)}
    total = " + ".join(f"coalesce(v{i}, 0) * {c!r}::DOUBLE" for i, c in enumerate(ws))
    there = " + ".join(f"CASE WHEN v{i} IS NOT NULL THEN {c!r}::DOUBLE ELSE 0 END" for i, c in enumerate(ws))
    return (on_full(k, f"({total}) / nullif({there}, 0)" if renormed else total), {**v, "n": f"count(x) {w(k)}"})


def along(family: str, d: int, nudge: float = 0.0) -> str:
    """The query of ts_<family>_<d>."""
    k, j = d + 1, d + 2
    frac = [1.0]
    for i in range(1, max(k, 3)):
        frac.append(-frac[-1] * (0.5 - i + 1) / i)
    kk, lms, sl, ku = max(k, 3), max(j, 4), max(j, 6), max(j, 8)
    four = max(k, 4)
    table = {
        "min": (f"min(x) {w(k)}",), "max": (f"max(x) {w(k)}",), "mean": (f"avg(x) {w(k)}",), "median": (f"quantile_cont(x, 0.5) {w(k)}",),
        "grstable": (f"CASE WHEN count(g) {w(k)} >= {m(k)} AND stddev_pop(g) {w(k)} > 0 THEN avg(g) {w(k)} / stddev_pop(g) {w(k)} END", {"g": change("x", 1)}),
        "zscore": (f"CASE WHEN count(x) {w(k)} >= {m(k)} AND stddev_pop(x) {w(k)} > 1e-6 THEN (x - avg(x) {w(k)}) / stddev_pop(x) {w(k)} END",), "demean": (f"CASE WHEN count(x) {w(k)} >= {m(k)} THEN x - avg(x) {w(k)} END",),
        "delay": (lag("x", d),), "last": (lag("x", d),), "delta": (f"x - {lag('x', d)}",), "diff1q": (f"x - {lag('x', d)}",), "diff4q": (f"x - {lag('x', d)}",), "avg": (f"(x + {lag('x', d)}) / 2",),
        "product": (f"CASE WHEN count(x) {w(k)} = {k} THEN greatest(-10000, least(10000, list_product(list(x) {w(k)}))) END",), "ttm": (f"sum(x) {w(d)}",), "pct": (change("x", d),), "growth": (change("x", d),),
        "qoq": (f"CASE WHEN abs({lag('x', d)}) > 1e-10 THEN (x - {lag('x', d)}) / abs({lag('x', d)}) END",), "yoy": (f"CASE WHEN abs({lag('x', d)}) > 1e-10 THEN (x - {lag('x', d)}) / abs({lag('x', d)}) END",),
        "rank": (f"CASE WHEN x IS NOT NULL AND n >= 2 THEN (len(list_filter(a, lambda t: t < x)) + 0.5::DOUBLE * (len(list_filter(a, lambda t: t = x)) - 1)) / (n - 1) END", arr(k)),
        "std": (f"stddev_samp(x) {w(j)}",), "cov": (f"CASE WHEN count(px) {w(j)} >= 3 THEN covar_samp(px, py) {w(j)} END", XY), "corr": (corr("px", "py", j), XY), "skew": (skew(j),), "kurt": (kurt(j),),
        **{f"autocorr_lag{i}": (corr("pa", "pb", j), {"l": lag("x", i)}, {"pa": "CASE WHEN l IS NOT NULL THEN x END", "pb": "CASE WHEN x IS NOT NULL THEN l END"}) for i in range(1, 6)},
        "autoslope": (f"CASE WHEN {varies('x', j)} THEN {lag('s')} END", T, {"s": f"CASE WHEN count(x) {w(j)} >= 2 AND var_samp(x) {w(j)} > 1e-4 THEN covar_samp(x, t) {w(j)} / var_samp(x) {w(j)} END"}),
        "argmin": (f"CASE WHEN n >= 1 THEN list_position(a, list_min(a)) - 1 END", arr(k)), "argmax": (f"CASE WHEN n >= 1 THEN list_position(a, list_max(a)) - 1 END", arr(k)), "decay_linear": (forecast(k), T),
        "cut_up_q1": cut(True, d), "cut_down_q1": cut(False, d), "count_and": (f"sum(CASE WHEN x IS NOT NULL AND y > 0 AND z > 0 THEN 1 END) {w(d)}",), "count_or": (f"sum(CASE WHEN x IS NOT NULL AND (y > 0 OR z > 0) THEN 1 END) {w(d)}",),
        "sue0_score": surprise(False, d), "sue1_score": surprise(True, d), "second_slope": second(d),
        "first_slope": (f"CASE WHEN qidx >= {d - 1} AND count(x) {w(d)} >= {max(3, math.floor(0.75 * d))} THEN covar_pop(x, t) {w(d)} / var_pop(t) {w(d)} END", T),
        "roll_resid": (f"CASE WHEN qidx >= {d - 1} AND count(px) {w(d)} >= {max(3, math.floor(0.75 * d))} AND count(py) {w(d)} * var_pop(py) {w(d)} > 1e-10 THEN x - avg(px) {w(d)} - covar_pop(px, py) {w(d)} / var_pop(py) {w(d)} * (y - avg(py) {w(d)}) END", XY),
        "median_abs_deviation": (on_full(k, f"list_median(list_transform({A}, lambda t: abs(t - mu)))"), arr(k)),
        "rms": (f"CASE WHEN count(x) {w(k)} >= {m(k)} THEN sqrt(avg(x * x) {w(k)}) END",), "norm_mean": (normed(f"avg(x) {w(k)}", k),), "norm_max": (normed(f"max(x) {w(k)}", k),), "norm_min": (normed(f"min(x) {w(k)}", k),),
        "norm_min_max": (normed(f"max(x) {w(k)} - min(x) {w(k)}", k),), **{f"ratio_beyond_sigma_{r}": (on_full(k, f"CASE WHEN sd > 1e-10 THEN len(list_filter(a, lambda t: abs(t - mu) > {r} * sd)) / {k}::DOUBLE END"), arr(k)) for r in (2, 3)},
        "index_mass_quantile_q25": (on_full(k, f"CASE WHEN list_sum(b) > 1e-10 THEN list_min(list_filter(list_transform(b, lambda t, i: CASE WHEN list_sum(b[1:i]) / list_sum(b) >= 0.25 THEN i - 1 END), lambda t: t IS NOT NULL)) END"), arr(k), {"b": "list_transform(a, lambda t: coalesce(abs(t), 0))"}),
        "number_cross_mean": (on_full(k, "len(list_filter(list_transform(sg, lambda t, i: CASE WHEN i > 1 THEN t * sg[i - 1] ELSE 0 END), lambda t: t < 0))", max(2, m(k))), arr(k), {"sg": f"list_transform({A}, lambda t: sign(t - mu))"}),
        "time_asymmetry_stats": (on_full(kk, f"avg(pr) {w(kk - 2)}"), {"l1": lag("x"), "l2": lag("x", 2), "n": f"count(x) {w(kk)}"}, {"pr": "(x - l1) * (x - l1) * (l1 - l2)"}),
        "longest_strike_above_mean": strike(">", d), "longest_strike_below_mean": strike("<", d), "mean_over_1norm": (f"CASE WHEN count(x) {w(k)} >= {m(k)} AND avg(abs(x)) {w(k)} > 1e-10 THEN avg(x) {w(k)} / avg(abs(x)) {w(k)} END",),
        "quantile_q25": (f"CASE WHEN count(x) {w(kk)} >= {m(kk)} THEN quantile_cont(x, 0.25) {w(kk)} END",), "decay_exp": weighted([math.exp(1 - 2 * i / (kk - 1)) for i in range(kk)], True), "fw_fracdiff": weighted(frac, False),
        "rolling_ic": (f"x * {lag('beta')}", XY, {"beta": f"CASE WHEN count(px) {w(k)} > {m(k)} AND count(x) {w(k)} >= {m(k)} AND var_samp(x) {w(k)} > 1e-10 THEN covar_samp(px, py) {w(k)} / var_samp(x) {w(k)} END"}),
        "pctchg_lms": (f"({change('x', four)}) - ({change('x', four // 2)})",),
        "stddev_lms": (f"CASE WHEN count(x) {w(lms)} >= {m(lms)} AND count(x) {w(lms // 2)} >= {m(max(2, lms // 2))} THEN stddev_samp(x) {w(lms)} - stddev_samp(x) {w(lms // 2)} END",),
        "sharp": (sharp(j),), "sharp_lms": (f"({sharp(lms)}) - ({sharp(lms // 2)})",),
        "skew_lms": (f"CASE WHEN count(x) {w(sl)} >= {max(3, m(sl))} AND count(x) {w(max(3, sl // 2))} >= {max(3, m(max(3, sl // 2)))} THEN ({skew(sl)}) - ({skew(max(3, sl // 2))}) END",),
        "kurtosis_lms": (f"CASE WHEN count(x) {w(ku)} >= {max(4, m(ku))} AND count(x) {w(max(4, ku // 2))} >= {max(4, m(max(4, ku // 2)))} THEN ({kurt(ku)}) - ({kurt(max(4, ku // 2))}) END",),
        "decay_linear_pctchg": ("CASE WHEN abs(fs) > 1e-10 THEN fl / fs - 1 END", T, {"fl": forecast(four), "fs": forecast(max(2, four // 2))}),
        "smooth_pos_gp": (f"CASE WHEN count(x) {w(four)} >= {m(four)} AND count(x) {w(four // 2)} >= {m(max(2, four // 2))} AND max(x) {w(four)} - min(x) {w(four)} > 1e-10 THEN (avg(x) {w(four // 2)} - min(x) {w(four)}) / (max(x) {w(four)} - min(x) {w(four)}) END",),
        "count_over_cs_mean": (f"CASE WHEN count(o) {w(k)} >= {m(k)} THEN sum(o) {w(k)} END", {"o": f"CASE WHEN stddev_pop(x) {D} > 1e-10 THEN CASE WHEN x > avg(x) {D} THEN 1 WHEN x IS NOT NULL THEN 0 END END"}),
        **{name: (f"CASE WHEN count(e) {w(k)} >= {m(k)} AND avg(-least(e, 0)) {w(k)} > 1e-10 THEN 100 - 100 / (1 + avg(CASE WHEN e > 0 THEN e WHEN e IS NOT NULL THEN 0 END) {w(k)} / avg(CASE WHEN e < 0 THEN -e WHEN e IS NOT NULL THEN 0 END) {w(k)}) END".replace("avg(-least(e, 0))", "avg(CASE WHEN e < 0 THEN -e WHEN e IS NOT NULL THEN 0 END)"), {"s": src}, {"e": f"s - {lag('s')}"}) for name, src in (("rsi", "x"), ("rsi_of_pctchg", change("x", 1)))},
        "signmul": (f"CASE WHEN count(x) {w(k)} >= {m(k)} THEN sign(x - avg(x) {w(k)}) * y END",),
    }
    return query(*table[family], nudge=nudge)
