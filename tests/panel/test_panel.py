"""Operators on hand-made panels, expected values by hand; expressions; the search; ingestion."""

import datetime
import math
from collections import Counter

import pytest

from tessera.operators import evolve as gp
from tessera.operators import metrics, selection
from tessera.operators.cross_section import OPERATORS
from tessera.operators.time_series import FAMILIES
from tessera.plans import catalog, expression
from tessera.plans.expression import build, canonical, from_stack, parse, to_stack
from tessera.plans.flow import Flow
from tessera.sources.panel import dense, first_disclosed, report_period, standalone_quarter, statements, unpivoted

SCHEMA = "entity long, qidx int, period date, industry int, restricted boolean, x double, y double"


def day(q):
    return datetime.date(2020 + q // 4, 3 * (q % 4) + 1, 1)


def panel(spark, xs: dict, ys: dict | None = None, industry=1):
    ys = ys or {}
    rows = [(e, q, day(q), industry if isinstance(industry, int) else industry[e], False, v, (ys.get(e) or [None] * len(x))[q]) for e, x in xs.items() for q, v in enumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, text):
    f = Flow(df)
    out = f.run({"v": build(f, parse(text))}).select("entity", "qidx", "v").collect()
    got = {}
    for r in sorted(out):
        got.setdefault(r.entity, []).append(r.v)
    return got


def near(got, want):
    assert len(got) == len(want) and all((g is None) == (v is None) and (v is None or math.isclose(g, v, rel_tol=1e-9, abs_tol=1e-9)) for g, v in zip(got, want)), (got, want)


N = None
#: For panels of a few entities.
LOOSE = gp.Rule(coverage=0.0, pairs=2, share=0.0)


@pytest.mark.parametrize(
    "text, x, want",
    [
        ("ts_mean_1(x)", [1, N, 3, 5], [1, 1, 3, 4]),
        ("ts_mean_1(x)", [N, N, N, N], [N, N, N, N]),
        ("ts_delay_2(x)", [1, N, 3, 4], [N, N, 1, N]),
        ("ts_ttm_2(x)", [1, N, 3, 4], [1, 1, 3, 7]),
        ("ts_pct_1(x)", [0, 2, -2, 1], [N, N, -2, 1.5]),
        ("ts_product_1(x)", [2, 3, N, 200000, 3], [N, 6, N, N, 10000]),
        ("ts_rank_2(x)", [1, 1, 2, N, 0], [N, 0.5, 1, N, 0]),
        ("ts_argmax_2(x)", [5, 5, 1, 7], [0, 0, 0, 2]),
        ("ts_argmin_2(x)", [N, 5, 1, 7], [N, 1, 2, 1]),
        ("ts_std_1(x)", [1, N, 3, 5], [N, N, math.sqrt(2), math.sqrt(2)]),
        ("ts_zscore_2(x)", [4, 4, 4, 4], [N, N, N, N]),
        ("ts_avg_1(x)", [1, 3, N, 5], [N, 2, N, N]),
        ("ts_rsi_2(x)", [1, 2, 3, 4], [N, N, N, N]),
        ("ts_rsi_2(x)", [1, 2, 1, 2], [N, N, 50, 100 - 100 / 3]),
        ("ts_longest_strike_above_mean_3(x)", [1, 5, 6, 1], [N, N, N, 2]),
        ("ts_number_cross_mean_3(x)", [1, 5, 1, 5], [N, N, N, 3]),
        ("ts_first_slope_3(x)", [1, 3, 5, 7], [N, N, 2, 2]),
        ("ts_first_slope_2(x)", [1, 3, 5, 7], [N, N, N, N]),
        ("ts_second_slope_6(x)", [0, 1, 4, 9, 16, 25, 36], [N, N, N, N, N, 1, 1]),
        ("ts_decay_linear_2(x)", [1, 2, 3, 5], [N, 3, 4, 19 / 3]),
        ("ts_index_mass_quantile_q25_3(x)", [1, 1, 1, 1], [N, N, N, 0]),
        ("ts_quantile_q25_1(x)", [1, 2, 3, 4], [N, 1.25, 1.5, 2.5]),
        ("ts_fw_fracdiff_1(x)", [1, 1, 1, 1], [N, N, 0.375, 0.375]),
        ("ts_ratio_beyond_sigma_2_3(x)", [1, 1, 1, 1], [N, N, N, N]),
        ("ts_median_abs_deviation_1(x)", [1, 3, 3, 7], [N, 1, 0, 2]),
        ("cs_div(x, 0.0005)", [1, N, 3, 4], [1, N, 1, 1]),
        ("cs_inv(x)", [0.0005, N, 2, 4], [0, N, 0.5, 0.25]),
        ("cs_max(x, ts_delay_1(x))", [1, 3, N, 2], [N, 3, N, N]),
    ],
)
def test_along_time(spark, text, x, want):
    near(values(panel(spark, {1: [None if v is None else float(v) for v in x]}), text)[1], want)


def test_across_entities(spark):
    df = panel(spark, {e: [v] for e, v in enumerate([3.0, 1.0, 3.0, None, 7.0])}, industry=[1, 1, 1, 1, 0])
    at = lambda text: [v[0] for _, v in sorted(values(df, text).items())]
    near(at("cs_rank(x)"), [2.5, 1, 2.5, N, 4])
    near(at("cs_indrank(x)"), [2.5 / 3, 1 / 3, 2.5 / 3, N, N])
    near(at("cs_demean(x)"), [-0.5, -2.5, -0.5, N, 3.5])
    near(at("cs_switch_packet_flexible(x)"), [0, -2, 0, N, -4])
    near(at("cs_fold(x)"), [4, 1, 4, N, 7])
    one = panel(spark, {0: [4.0], 1: [4.0]}, industry=[1, 2])
    assert values(one, "cs_indneutral(x)") == {0: [None], 1: [None]} and values(one, "cs_zscore(x)") == {0: [None], 1: [None]}


def test_residual_of_flat_predictor(spark):
    df = panel(spark, {0: [1.0], 1: [3.0]}, {0: [2.0], 1: [2.0]})
    assert values(df, "cs_residual(x, y)") == {0: [-1.0], 1: [1.0]} and values(df, "cs_regressor(x, y)") == {0: [None], 1: [None]}


def test_double_scored_needs_five(spark):
    four = panel(spark, {e: [float(e)] for e in range(4)}, {e: [float(-e)] for e in range(4)})
    assert all(v == [None] for v in values(four, "cs_double_scored(x, y)").values())
    ten = panel(spark, {e: [float(e)] for e in range(10)}, {e: [float(e)] for e in range(10)})
    got = values(ten, "cs_double_scored(x, y)")
    # the first quintile holds ranks .1 to .28, that is two entities
    near(got[0], [0.5 * 0.1 + 0.5 * 0.5])
    near(got[1], [0.5 * 0.2 + 0.5 * 1.0])


def test_counts():
    assert len(OPERATORS) == 45 and len(FAMILIES) == 73
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"evolution", "bootstrap_interval"}
    assert len(catalog.queries()) > 180


def test_expressions(spark):
    t = parse("cs_add(`a b`, ts_growth_4(cs_mul(x, 0.5)))")
    assert parse(str(t)) == t and from_stack(to_stack(t, ["x", "a b"]), ["x", "a b"]) == t
    assert canonical(parse("cs_add(y, x)")) == canonical(parse("cs_add(x, y)")) and canonical(parse("ts_last_3(x)")) == canonical(parse("ts_delay_3(x)"))
    assert canonical(parse("ts_qoq_1(x)")) != canonical(parse("ts_pct_1(x)"))
    assert t.depth() == 3 and t.length() == 6
    with pytest.raises(KeyError):
        parse("nope(x)")
    f = Flow(panel(spark, {1: [1.0, 2.0]}))
    a, b = build(f, parse("cs_add(ts_delay_1(x), 1.0)")), build(f, parse("cs_add(1.0, ts_last_1(x))"))
    assert a == b


def test_layers_share_exchanges(spark):
    f = Flow(panel(spark, {1: [1.0, 2.0]}).repartition(3))
    a = build(f, parse("cs_zscore(ts_mean_2(x))"))
    b = build(f, parse("ts_std_2(ts_delta_1(x))"))
    plan = f.run({"a": a, "b": b})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 4


def test_user_operator(spark):
    sample = panel(spark, {1: [1.0, 2.0]})
    from pyspark.sql import functions as F

    expression.register_operator("twice", 1, lambda f, x: f.ew(2 * F.col(x), x), sample)
    assert values(panel(spark, {1: [1.0, None]}), "twice(x)") == {1: [2.0, None]}
    with pytest.raises(ValueError):
        expression.register_operator("bad", 1, lambda f, x: f.ew(F.lit(float("inf")) * F.abs(F.col(x) + 2), x), sample)


def test_metrics(spark):
    xs = {e: [float(e), float(e)] for e in range(20)}
    ys = {e: [float(e), float(-e)] for e in range(20)}
    df = panel(spark, xs, ys)
    assert [round(r.ic, 9) for r in metrics.ic_rows(df, "x", "y").orderBy("period").collect()] == [1, -1]
    assert metrics.fitness(df, "x", "y", min_pairs=20).first().fitness == pytest.approx(0, abs=1e-12)
    assert metrics.fitness(df, "x", "y", min_pairs=21).first().fitness == -1
    g = metrics.group_returns(df, "x", "y").where("period = date'2020-01-01'").collect()
    assert {r.bucket: r.members for r in g} == Counter(10 - math.floor((1 - k / 20) * 10) for k in range(1, 21))
    r = metrics.residual_of_many(panel(spark, xs, ys), "x", ["y"]).collect()
    assert len(r) == 40 and all(abs(x.residual) < 1e-9 for x in r)


def test_selection(spark):
    assert selection.without_correlated([("a", 0.3), ("b", 0.2), ("c", 0.1)], {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.2}, 0.6) == ["a", "c"]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.009,), (0.01,), (float("nan"),), (None,)], "s double")
    assert [r.s for r in rows.where(selection.passes_gate(F.col("s"), 0.01)).collect()] == [0.01]


def test_search_is_seeded_and_prefix(spark):
    import random

    rng = random.Random(1)
    p = panel(spark, {e: [rng.random() for _ in range(4)] for e in range(40)}, {e: [rng.random() for _ in range(4)] for e in range(40)})
    ops = ["cs_add", "cs_rank", "ts_delay_1"]
    s = gp.Settings(population=4, generations=1)
    short = gp.evolve(p, ops, ["x", "y"], "y", s, rule=LOOSE)
    long = gp.evolve(p, ops, ["x", "y"], "y", gp.Settings(population=4, generations=2), rule=LOOSE)
    assert long[: len(short)] == short and len(short) == 4 * 2 + 4


def test_ingest(spark, tmp_path):
    d = spark.createDataFrame([(1, 2020, 1, 10.0), (1, 2020, 2, 25.0), (1, 2020, 4, 60.0), (1, 2021, 2, 7.0)], "entity long, year int, quarter int, v double")
    assert [r.v for r in standalone_quarter(d, ["v"]).orderBy("year", "quarter").collect()] == [10, 15, 35, None]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, None, 1), (1, "b", 2), (1, "a", 3)], "k int, at string, id int")
    assert first_disclosed(rows, ["k"], [F.col("at"), F.col("id")]).first().id == 3
    days = spark.createDataFrame([("2020-11-03",), ("2021-02-01",), ("2021-05-01",), ("2021-10-31",)], "d string").select(report_period(F.to_date("d")).cast("string").alias("p"))
    assert [r.p for r in days.collect()] == ["2020-09-30", "2020-09-30", "2021-03-31", "2021-06-30"]
    assert dense(spark.createDataFrame([(1, day(0), 1.0), (2, day(2), 2.0)], "entity long, period date, x double")).count() == 4
    assert unpivoted(spark.createDataFrame([(1, 2.0, 3.0)], "k int, a double, b double"), "k", "n", "v").count() == 2
    (tmp_path / "s.csv").write_text("TICKER_SYMBOL,EXCHANGE_CD,END_DATE,MERGED_FLAG,A,B\n1,XSHE,2020-03-31,1,5,6\n000001,XSHE,2020-03-30,1,5,6\n600000,XSHG,2020-06-30,2,5,6\nAB,XSHG,2020-06-30,1,1,1\n600002,XSHG,bad,1,1,1\n600003,XBSE,2020-06-30,1,1,1\n")
    s = statements(spark, str(tmp_path / "s.csv"), "TICKER_SYMBOL string, EXCHANGE_CD string, END_DATE string, MERGED_FLAG int, A double, B double", ["TICKER_SYMBOL", "EXCHANGE_CD", "END_DATE", "MERGED_FLAG", "A"])
    assert [(r.entity, str(r.period), r.A) for r in s.collect()] == [("000001.SZ", "2020-03-31", 5.0)]


def test_replacement_modes():
    value = {"a": 3, "b": 1, "c": 2, "d": 4}.get
    kept, born = [("a", "a"), ("b", "b")], [("c", "a"), ("d", "b")]
    tops = lambda mode: [t for t, _ in gp.survivors(kept, born, value, mode, 2)]
    assert tops("generational") == ["d", "c"] and tops("elitist") == ["d", "a"] and tops("parent") == ["a", "d"]
    with pytest.raises(ValueError):
        tops("other")


def test_original_first():
    series = {"a": {1: 0.1, 2: 0.3, 3: 0.2}, "b": {1: 0.2, 2: 0.6, 3: 0.4}, "c": {1: 0.5, 2: 0.5, 3: 0.5}, "d": {1: 0.1, 2: 0.1, 3: 0.7}, "e": {}}
    got = gp.explained(series, 1)
    assert got["c"] == got["e"] == 0.0 and got["a"] == pytest.approx(got["b"]) and 0 <= got["a"] <= 1
    assert gp.explained(series, 2)["a"] == pytest.approx(1.0)
    assert gp.original_first(series, 0.0)["c"] == 5 and gp.original_first(series, 0.0)["e"] == 1
    assert gp.explained({}) == {} and gp.explained({"a": {}}) == {"a": 0.0}


def test_evolution_with_originality_and_elitists(spark):
    p = panel(spark, {e: [float(e * q % 7) for q in range(4)] for e in range(1, 41)}, {e: [float(e + q) for q in range(4)] for e in range(1, 41)})
    s = gp.Settings(population=4, generations=2, replacement="elitist", originality=0.3)
    first = gp.evolve(p, ["cs_add", "cs_rank", "cs_mul"], ["x", "y"], "y", s, rule=LOOSE)
    assert {r["generation"] for r in first} == {0, 1, 2} and len(first) == 8 + 4 + 4


def test_forward_selection(spark):
    rows = [(e, day(0), float(e), float(2 * e), float((e * 7) % 11), float(3 * e + 5 * ((e * 7) % 11))) for e in range(30)]
    df = spark.createDataFrame(rows, "entity long, period date, a double, twin double, b double, r double")
    taken = selection.forward_selection(df, ["a", "twin", "b"], "r", [], 0.05, 0.9, 5)
    assert [n for n, _ in taken] == ["twin", "b"] and taken[1][1] == pytest.approx(1.0, abs=0.05)
    assert selection.forward_selection(df, ["a", "b"], "r", ["a", "b"], 0.05, 0.9, 5) == []


def test_forward_selection_by_order(spark):
    import random

    rng = random.Random(8)
    # a and r rise together in every bucket; b goes with r in the two outer buckets alone, and correlates better there
    rows = [(e, day(q), float(e), float((e // 10 == 9) - (e // 10 == 0)) * 50 + rng.random(), 0.2 * e + ((e // 10 == 9) - (e // 10 == 0)) * 100.0) for e in range(100) for q in range(2)]
    df = spark.createDataFrame(rows, "entity long, period date, a double, b double, r double")
    by = lambda how: selection.forward_selection(df, ["a", "b"], "r", [], 0.05, 0.1, 1, how)[0][0]
    assert (by("ic"), by("mono")) == ("b", "a") and selection.both_selections(df, ["a", "b"], "r", [], 0.05, 0.1, 1) == ["a", "b"]
    with pytest.raises(ValueError):
        by("other")


def test_monotonicity_of_halves(spark):
    rets = lambda v: spark.createDataFrame([(day(0), b + 1, float(x)) for b, x in enumerate(v)], "period date, bucket int, ret double")
    up = [*range(10)]
    mono = lambda *a: metrics.monotonicity(rets(a[0]), *a[1:]).first().mono
    assert mono(up) == 0 and mono(up[::-1]) == 1 and mono(up[::-1], False) == 0
    assert mono(up, True, "longonly") == 0 and mono(up, False, "longonly") == 1 and mono([0, 1, 2, 3, 4, 9, 8, 7, 6, 5], True, "longonly") == 1
    with pytest.raises(ValueError):
        mono(up, True, "half")


def test_production_subsets():
    from tessera.plans.expression import lookup
    from tessera.plans.subsets import CROSSOVER, MUTATION, PRODUCTION

    assert (len(MUTATION), len(CROSSOVER), len(set(PRODUCTION))) == (66, 24, 90)
    assert {lookup(n)[2] for n in MUTATION} == {1} and {lookup(n)[2] for n in CROSSOVER} == {2}


def test_paired_stats(spark):
    pairs = [(1, 1.0, 2.0), (2, 5.0, 3.0), (3, 2.0, 2.0), (4, 4.0, 7.0), (5, None, 1.0), (6, 3.0, 4.0)]
    df = spark.createDataFrame(pairs, "k long, a double, b double")
    r = selection.paired_stats(df, "a", "b").first()
    assert (r.pairs, r.nonzero, r.w_plus) == (5, 4, 7.0) and r.mean_diff == pytest.approx(0.6) and r.mad == pytest.approx(1.4)
    assert r.z == pytest.approx((7 - 5) / (math.sqrt(1.5**2 + 1.5**2 + 9 + 16) / 2))
    empty = selection.paired_stats(df.limit(0), "a", "b").first()
    assert empty.pairs == 0 and empty.z is None
    wide = spark.range(400).selectExpr("id as k", "cast(id % 20 as double) as x")
    b = selection.bootstrap_mean(wide, "k", "x", reps=400).first()
    half = 1.96 * math.sqrt(33.25 / 400)
    assert b.mean == 9.5 and b.lo == pytest.approx(9.5 - half, abs=0.2) and b.hi == pytest.approx(9.5 + half, abs=0.2)
    assert selection.bootstrap_mean(wide.limit(0), "k", "x", reps=3).first().mean is None


def test_policy(spark):
    from tessera.operators import candidates

    assert candidates.generation_size(249, 50) == 12450
    for features, per in ((249, 0), (249, -1), (249, 2.5), (249, True), (0, 3)):
        with pytest.raises(ValueError):
            candidates.generation_size(features, per)
    table = lambda rows: spark.createDataFrame(rows, "name string, source_group string, origin string")
    groups = [(g, g, None) for g in ("gate1", "base", "x20_ic0.02_corr0.8", "x100_b", "step1")] + [("own", "?", "step1")]
    got = {r.name: r.origin for r in candidates.with_origins(table(groups)).collect()}
    assert got == {"gate1": "base", "base": "base", "x20_ic0.02_corr0.8": "step1", "x100_b": "step1", "step1": "step1", "own": "step1"}
    for row in (("a", "unknown", None), ("a", None, None), ("a", "x30_z", None), ("a", "base", "step2")):
        with pytest.raises(ValueError, match="a"):
            candidates.with_origins(table([row]))


def test_formula_language():
    from tessera.sources.formula import parse_formula

    f = lambda n: ("field", n)
    assert parse_formula("a / b / c") == ("over", f("a"), ("over", f("b"), f("c")))
    assert parse_formula("diff4q( TTM(net income) / y )") == ("call", "diff4q", ("over", ("call", "TTM", f("net income")), f("y")))
    assert parse_formula("(a / b) / QTR(c)") == ("over", ("over", f("a"), f("b")), ("call", "QTR", f("c")))
    for bad in ("", "a /", "TTM(a", "a)", "/ a", "()", "TTM(a) b"):
        with pytest.raises(ValueError):
            parse_formula(bad)


def test_provenance_and_gate(spark):
    from pyspark.sql import functions as F

    from tessera.operators import candidates

    rows = spark.createDataFrame([(["b0"],), (["b0", "s1"],), ([],)], "f array<string>")
    kind = selection.dependency_kind(F.col("f"), ["b0"], ["s1"])
    assert [r[0] for r in rows.select(kind).collect()] == ["base_only", "contains_step1", "constant_only"]
    with pytest.raises(Exception, match="without an origin"):
        spark.createDataFrame([(["x9"],)], "f array<string>").select(kind).collect()
    pool = spark.createDataFrame([(0.009,), (0.01,), (float("nan"),), (None,)], "s double")
    assert [r.s for r in candidates.gated(pool, "s", 0.01).collect()] == [0.01] and candidates.gated(pool, "s", None).count() == 2
    with pytest.raises(ValueError):
        candidates.gated(pool, "s", 0.5)


def test_post_run(spark):
    import random

    from tessera.operators import candidates

    rng = random.Random(42)
    p = panel(spark, {e: [rng.gauss(0, 1) for _ in range(8)] for e in range(60)}, {e: [rng.gauss(0, 1) for _ in range(8)] for e in range(60)})
    three = [("a", parse("x"), 0.08), ("b", parse("cs_mul(x, 2.0)"), 0.07), ("c", parse("y"), 0.06)]
    assert candidates.post_run(three[:2], p)["kept"] == ["a"] and candidates.post_run(three, p)["kept"] == ["a", "c"]

    def forbidden(*_):
        raise RuntimeError("must not be computed")

    low = candidates.post_run([("low", parse("x"), 0.039), ("none", parse("x"), None)], p, materialise=forbidden)
    assert (low["status"], low["materialised"], low["after_filter"]) == ("completed", 0, 0) and candidates.post_run([], p, materialise=forbidden)["after_filter"] == 0
    failed = candidates.post_run(three, p, materialise=forbidden)
    assert (failed["status"], failed["stage"]) == ("failed", "materialise")


def test_search_controls(spark):
    import random

    rng = random.Random(1)
    p = panel(spark, {e: [rng.random() for _ in range(4)] for e in range(40)}, {e: [rng.random() for _ in range(4)] for e in range(40)})
    ops = ["cs_add", "cs_rank", "ts_delay_1"]
    first = gp.evolve(p, ops, ["x", "y"], "y", gp.Settings(population=4, generations=2, stop=-2.0), rule=LOOSE)
    assert {r["generation"] for r in first} == {0}
    plain = gp.evolve(p, ops, ["x", "y"], "y", gp.Settings(population=4, generations=0), rule=LOOSE)
    costly = gp.evolve(p, ops, ["x", "y"], "y", gp.Settings(population=4, generations=0, parsimony=0.5, penalty_weight=0.2), rule=LOOSE, judged={plain[0]["formulation"]: 5.0})
    for a, b in zip(plain, costly):
        owed = 0.1 if a["formulation"] == plain[0]["formulation"] and a["ic"] >= 0 else 0.0
        assert a["fitness"] == a["ic"] and b["fitness"] == pytest.approx(b["ic"] - owed - 0.5 * b["n_nodes"])
    auto = gp.Settings(parsimony="auto")
    assert gp.parsimony_coefficient([1, 2, 3], [1.0, 2.0, 3.0], auto) == pytest.approx(1.5) and gp.parsimony_coefficient([2, 2], [1.0, 3.0], auto) == 0
    only = gp.evolve(p, ops, ["x", "y"], "y", gp.Settings(population=4, generations=0), rule=LOOSE, crossover_ops=["cs_mul"])
    assert all("cs_rank(" not in r["formulation"] or r["n_nodes"] == 2 for r in only)
    records = spark.createDataFrame([(0, i, t, v) for i, (t, v) in enumerate([("x", 0.5), ("cs_mul(x, 2.0)", 0.4), ("y", 0.3), ("x", 0.2)])], "generation int, idx int, formulation string, ic double")
    assert gp.best_programs(p, records, 3, 2) == ["x", "y"] and gp.best_programs(p, records, 9, 9) == ["x", "cs_mul(x, 2.0)", "y"]
    assert gp.execute(p, ["cs_add(x, y)"]).where("abs(p0 - x - y) < 1e-12").count() == 160


def test_scores_see_through_lines(spark):
    import random

    rng = random.Random(2)
    p = panel(spark, {e: [rng.random() if q < 3 else 0.5 for q in range(4)] for e in range(40)}, {e: [rng.random() for _ in range(4)] for e in range(40)})
    got = gp.ic_series(p, [parse("cs_zscore(cs_demean(x))"), parse("cs_neg(x)"), parse("x")], "y")
    a, b, c_ = (got[str(canonical(parse(t)))] for t in ("cs_zscore(cs_demean(x))", "cs_neg(x)", "x"))
    assert len(a) == len(c_) == 3 and all(a[d] == pytest.approx(c_[d]) == pytest.approx(-b[d]) for d in c_)


def test_metric_registry(spark):
    from pyspark.sql import functions as F

    from tessera.operators import fitness

    p = panel(spark, {e: [float(e), float(-e)] for e in range(30)}, {e: [float(e * e), float(e)] for e in range(30)})
    assert fitness.metric("alert_ic", p, "x", "y").first().value == pytest.approx(0) and fitness.metric("spearman", p, "x", "x").first().value == pytest.approx(1)
    nothing = p.withColumn("x", F.lit(None).cast("double"))
    assert [fitness.metric(n, nothing, "x", "y", styles=["x"]).first().value for n in ("pearson", "alert_pearson", "alert_icir", "neutral_ic", "hedge_sharpe")] == [0, -1, -100, 0, -100]
    fitness.register_metric("most", lambda df, x, y: df.agg(F.max(x).alias("value")), True, p)
    assert fitness.metric("most", p, "x", "y").first().value == 29
    for bad in ((lambda df, x, y: df.select(F.col(x).alias("value")), True), (lambda df, x: df, True), (lambda df, x, y: df, "yes")):
        with pytest.raises(ValueError):
            fitness.register_metric("bad", *bad, p)
    with pytest.raises(KeyError):
        fitness.metric("bad", p, "x", "y")


def test_residual_of_dependent_regressors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(e, day(q), *map(float, rng.normal(size=2)), 7.0, float(rng.normal())) for e in range(40) for q in range(2)] + [(99, day(0), None, 1.0, 7.0, 1.0), (1, day(2), 1.0, 1.0, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "entity long, period date, a double, b double, flat double, y double").selectExpr("*", "a + 2 * b as twin")
    got = {(r.entity, r.period): r.residual for r in metrics.residual_of_many(df, "y", ["a", "b", "flat", "twin"]).collect()}
    for q in range(2):
        own = [r for r in rows if r[1] == day(q) and r[2] is not None]
        x = np.array([[1, r[2], r[3]] for r in own])
        y = np.array([r[5] for r in own])
        want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert all(got[r[0], r[1]] == pytest.approx(w, abs=1e-8) for r, w in zip(own, want))
    assert got[99, day(0)] is None and got[1, day(2)] is None


def test_mean_ranks(spark):
    from tessera.operators.ranking import mean_ranks

    xs = [float(i % 37 if i % 3 else 5) for i in range(900)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = {r.x: r.k for r in mean_ranks(df, "x", "k", 8).collect()}
    assert got == {v: sum(x < v for x in xs) + (xs.count(v) + 1) / 2 for v in set(xs)}
    assert mean_ranks(df.limit(0), "x", "k").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.sources import formula, results
    from tessera.sources import panel as source

    p = panel(spark, {1: [1.0, None, 3.0], 2: [4.0, 5.0, 6.0]}, {1: [1.0, 2.0, 0.0], 2: [1.0, 1.0, 1.0]})
    with pytest.raises(KeyError, match="nope"):
        source.features_of(p, ["x", "nope"])
    assert source.features_of(p, ["y", "x"]).columns == ["entity", "period", "y", "x"]
    with pytest.raises(ValueError, match="x at 2020-04-01 0.500"):
        source.checked_coverage(p, ["x", "y"])
    assert source.checked_coverage(p, ["y"]).count() == 3
    with pytest.raises(KeyError):
        formula.with_formulas(p, {"f": "TTM(nope)"})
    got = formula.with_formulas(p, {"f": "diff1q(x / y)", "g": "x / y"}).orderBy("entity", "qidx").collect()
    assert [(r.f, r.g) for r in got] == [(None, 1.0), (None, None), (None, None), (None, 4.0), (1.0, 5.0), (1.0, 6.0)]
    results.write_factors(p, ["x", "y"], f"{tmp_path}/factors")
    wide = results.factor_wide(spark, f"{tmp_path}/factors", "x").orderBy("period").collect()
    assert [(r["1"], r["2"]) for r in wide] == [(1.0, 4.0), (None, 5.0), (3.0, 6.0)] and results.factor_wide(spark, f"{tmp_path}/factors", "x", "entity").count() == 2
    assert {r.factor for r in results.finished(spark, f"{tmp_path}/factors").collect()} == {"x", "y"} and results.finished(spark, f"{tmp_path}/none").count() == 0
    results.write_generations(spark.createDataFrame([(g, f"f{g}") for g in range(9)], "generation int, formulation string"), f"{tmp_path}/run")
    assert results.snapshot(spark, f"{tmp_path}/run", 4).count() == 5
    for at, v in ((1, 7.0), (2, 3.0)):
        results.append_scores(spark.createDataFrame([("e", "m", v, at)], "expression string, model string, score double, at int"), f"{tmp_path}/scores")
    assert [tuple(r) for r in results.scores(spark, f"{tmp_path}/scores").collect()] == [("e", "m", 7.0, 1)]
    (tmp_path / "usage.jsonl").write_text('{"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}\n{"prompt_tokens": 5}\n')
    assert tuple(results.token_usage(spark, f"{tmp_path}/usage.jsonl").first()) == (2, 8, 4, 7)
    (tmp_path / "ret_fill.csv").write_text("entity,2024-01-02,2024-01-03\na,1.5,\nb,x,2\n")
    daily = source.daily_wide(spark, str(tmp_path), "ret", first="2024-01-03").orderBy("entity").collect()
    assert [(r.entity, str(r.day), r.value) for r in daily] == [("a", "2024-01-03", None), ("b", "2024-01-03", 2.0)]
    with pytest.raises(FileNotFoundError):
        source.daily_wide(spark, str(tmp_path), "other")
    assert results.union_all([p.select("entity"), p.select("entity", "x")]).where(F.col("x").isNull()).count() == 7


def test_period_sums_of_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.streaming.incremental import period_sums

    rows = [("2024-12-10", 1, 2.0), ("2025-01-10", 1, 3.0), ("2024-11-01", 2, 1.0), ("2025-05-02", 1, 9.0)]
    days = spark.createDataFrame(rows, "d string, k long, v double").select(F.to_timestamp("d").alias("ts"), "k", "v")
    want = {(1, "2024-09-30"): (5.0, 2), (2, "2024-09-30"): (1.0, 1), (1, "2025-03-31"): (9.0, 1)}
    read = lambda df: {(r.k, str(r.period)): (r.total, r.rows) for r in df.collect()}
    assert read(period_sums(days, "ts", "k", "v")) == want
    days.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(days.schema).parquet(f"{tmp_path}/in")
    q = period_sums(stream, "ts", "k", "v").writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert read(spark.table("sums")) == want


@pytest.mark.parametrize("text", ["cs_rank(x)", "cs_indrank(x)", "cs_fold(x)", "cs_rank_diff(x, y)", "cs_double_scored(x, y)"])
def test_ranks_in_parts(spark, text):
    """A date's rows ranked in ranges of values apart have the ranks of the whole date, with ties, nulls and dates without a value."""
    import random

    rng = random.Random(5)
    cell = lambda q: None if rng.random() < 0.2 or q == 2 else float(rng.randrange(30)) if q else 7.0
    df = panel(spark, {e: [cell(q) for q in range(4)] for e in range(90)}, {e: [cell(q) for q in range(4)] for e in range(90)}, industry=[e % 4 for e in range(90)])
    got = []
    for parts in (1, 6):
        f = Flow(df, parts)
        got.append({(r.entity, r.qidx): r.v for r in f.run({"v": build(f, parse(text))}).select("entity", "qidx", "v").collect()})
    assert got[0].keys() == got[1].keys() and any(v is not None for v in got[0].values())
    assert all(got[1][k] == (v if v is None else pytest.approx(v)) for k, v in got[0].items())
