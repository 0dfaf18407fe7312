"""Searches by any metric, masked as asked; what they find out is kept and read again."""

import datetime
import math
import random

import pytest

from tessera.operators import batch, fitness, metrics
from tessera.operators import evolve as gp
from tessera.plans.expression import canonical, evaluate, parse
from tessera.sources import store

TEXTS = ["x", "cs_add(x, y)", "cs_zscore(x)", "ts_delta_1(x)", "cs_sign(x)", "cs_mul(sparse, y)"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(4)
    rows = []
    for q in range(6):
        for e in range(40):
            x = None if rng.random() < 0.04 else round(rng.gauss(0, 1), 1)
            rows.append((e, q, datetime.date(2020 + q // 4, 3 * (q % 4) + 1, 1), e % 3, rng.random() < 0.1, x, rng.gauss(0, 1), None if rng.random() < 0.5 else 1.0, None if q == 5 else rng.gauss(0, 1) + (x or 0.0)))
    return spark.createDataFrame(rows, "entity long, qidx int, period date, industry int, restricted boolean, x double, y double, sparse double, r double").cache()


@pytest.mark.parametrize("name", ["alert_pearson", "spearman", "neutral_ic"])
def test_scores_are_the_metrics(panel, name):
    """What a search gives a program is what the metric of its name gives the factor, whatever the width of a batch."""
    got = gp.score(panel, [parse(t) for t in TEXTS], "r", width=4, rule=gp.Rule(name, 0.7, 2, 0.0, ("y",)))
    for text in TEXTS:
        (df,) = evaluate(panel, {"f": parse(text)})
        want = fitness.metric(name, df, "f", "r", styles=["y"], least=0.7).first()["value"]
        have = got[str(canonical(parse(text)))]
        assert math.isclose(have, want, abs_tol=1e-9) or (have == -1 and want == 0), text
    assert got[str(canonical(parse("cs_mul(sparse, y)")))] == -1


def test_search_scores_are_the_masked_fitness(panel):
    """100 pairs, two thirds of the dates and nine tenths of coverage, as the fitness has them."""
    for rule in (gp.Rule(coverage=0.8, pairs=30, share=2 / 3), gp.Rule(coverage=0.8, pairs=34, share=2 / 3), gp.Rule()):
        got = gp.score(panel, [parse(t) for t in TEXTS], "r", rule=rule)
        for text in TEXTS:
            (df,) = evaluate(panel, {"f": parse(text)})
            want = metrics.fitness(df, "f", "r", min_pairs=rule.pairs, share=rule.share, least=rule.coverage).first().fitness
            assert got[str(canonical(parse(text)))] == pytest.approx(want, abs=1e-9), (text, rule)
    records = gp.evolve(panel, ["cs_add", "cs_rank"], ["x", "y"], "r", gp.Settings(population=4, generations=1), rule=gp.Rule("neutral_ic", 0.7, 5, 0.5, ("y",)))
    assert max(r["ic"] for r in records) > 0.2
    with pytest.raises(KeyError):
        gp.score(panel, [parse("x")], "r", rule=gp.Rule("no_such_metric"))


@pytest.mark.parametrize("name", ["hedge_sharpe", "neutral_hedge_sharpe", "alert_icir", "long_only_neutral_ic"])
def test_a_search_goes_by_figures_of_whole_factors(panel, name):
    got = gp.score(panel, [parse(t) for t in TEXTS], "r", width=4, rule=gp.Rule(name, 0.7, styles=("y",)))
    for text in TEXTS:
        (df,) = evaluate(panel, {"f": parse(text)})
        assert got[str(canonical(parse(text)))] == pytest.approx(fitness.metric(name, df, "f", "r", styles=["y"], least=0.7).first()["value"], abs=1e-9), text


def test_a_search_goes_by_a_metric_of_ones_own(panel, spark, tmp_path, monkeypatch):
    """Less is better by this one, so the search turns it round; its figures are kept and read as ICs are."""
    from pyspark.sql import functions as F

    def distance(df, x, y):
        return df.agg(F.avg(F.abs(F.col(x) - F.col(y))).alias("value"))

    fitness.register_metric("distance", distance, False, panel.select("*", F.col("r").alias("fwd")))
    try:
        rule = gp.Rule("distance")
        got = gp.score(panel, [parse(t) for t in ("x", "y", "cs_sub(sparse, sparse)")], "r", rule=rule)
        want = {t: -distance(panel, t, "r").first()["value"] for t in ("x", "y")}
        assert all(got[f"`{t}`"] == pytest.approx(v) for t, v in want.items()) and len(got) == 3
        nothing = panel.withColumn("x", F.lit(None).cast("double"))
        assert gp.score(nothing, [parse("x")], "r", rule=rule) == {"`x`": -100.0}
        kept, asked, real = store.IcStore(spark, f"{tmp_path}/figures"), [], gp.ic_series
        monkeypatch.setattr(gp, "ic_series", lambda p, trees, *a, **k: asked.append(len(trees)) or real(p, trees, *a, **k))
        run = lambda: gp.evolve(panel, ["cs_add", "cs_sub"], ["x", "y"], "r", gp.Settings(population=4, generations=1, originality=0.2, parsimony="auto"), rule=rule, store=kept)
        first, n = run(), len(asked)
        assert run() == first and len(asked) == n and max(r["ic"] for r in first) >= got["`x`"] - 1
    finally:
        del fitness.METRICS["distance"]


def test_no_date_and_no_expression_is_one_task(panel):
    """The only windows over a name and date are over the table of ranges, a row each."""
    plan = batch.rank_ics(batch._long(panel, ["x", "y"], "r"), 2)._jdf.queryExecution().optimizedPlan().toString()
    windows = [w.split("windowspecdefinition(")[1] for w in plan.splitlines() if "Window [" in w]
    assert windows and all("range" in w or "Aggregate" in plan.split(w)[1][:2000] for w in windows)


def test_a_warm_start_reads(panel, spark, tmp_path, monkeypatch):
    kept, asked = store.IcStore(spark, f"{tmp_path}/ics", "v1"), []
    real = gp.ic_series
    monkeypatch.setattr(gp, "ic_series", lambda p, trees, *a, **k: asked.append(len(trees)) or real(p, trees, *a, **k))
    run = lambda rule: gp.evolve(panel, ["cs_add", "cs_rank", "cs_mul"], ["x", "y"], "r", gp.Settings(population=4, generations=1), rule=rule, store=kept)
    rule = gp.Rule(coverage=0.5, pairs=5, share=0.0)
    first, n = run(rule), len(asked)
    assert n and run(rule) == first and len(asked) == n  # nothing is computed twice
    assert run(gp.Rule("spearman", 0.5, 5, 0.0)) and len(asked) > n  # another rule is another table
    arrays = {r.formulation: r.ics for r in kept.arrays().where("size(ics) > 0").collect()}
    assert arrays and all(len(a) <= 5 for a in arrays.values())
    some = set(list(kept.read(rule, "r", set(arrays)))[:1])
    kept.evict(rule, "r", some)
    assert set(kept.read(rule, "r", set(arrays))) == some
    assert store.IcStore(spark, f"{tmp_path}/ics", "v2").read(rule, "r", some) == {}


def test_scores_of_two_writers(spark, tmp_path):
    at = lambda s: datetime.datetime(2020, 1, 1, 0, 0, s)
    table = lambda rows: spark.createDataFrame(rows, "expression string, model string, score double, at timestamp")
    one, two = store.ScoreStore(spark, f"{tmp_path}/s"), store.ScoreStore(spark, f"{tmp_path}/s")
    a = table([("x", "m", 3.0, at(2)), ("y", "m", 4.0, at(2)), ("bad", "m", None, at(2))])
    assert one.add(a) and not two.add(a)  # a repeated batch is there already
    # a writer that did not see the first one's scores: both folders are there, one score counts
    store.commit(table([("x", "m", 9.0, at(1))]), f"{tmp_path}/s/scores", "late")
    two.add(table([("x", "m", 7.0, at(5)), ("z", "m", 1.0, at(5))]))
    got = {(r.expression, r.score) for r in one.scores().collect()}
    assert got == {("x", 9.0), ("y", 4.0), ("z", 1.0)}
    audit = [(r.expression, r.outcome) for r in one.audit().collect()]
    assert sorted(audit) == [("bad", "failed"), ("x", "scored"), ("x", "scored"), ("y", "scored"), ("z", "scored")]


def test_tables_written_once(spark, tmp_path):
    made = []

    def forward():
        made.append(1)
        return spark.range(3)

    for dates in (("a", "b"), ("a", "b"), ("a", "c")):
        assert store.once(forward, spark, str(tmp_path), "forward", *dates).count() == 3
    assert len(made) == 2
    ics, rets, summary = (spark.createDataFrame([(i, float(i))], "period int, v double") for i in range(3))
    for _ in range(2):
        store.write_results(str(tmp_path), "factor1", ics, rets, summary)
    store.write_results(str(tmp_path), "factor2", ics, rets, summary)
    for k, name in enumerate(("ics", "returns", "summary")):
        assert sorted((r.run, r.period) for r in store.results(spark, str(tmp_path), name).collect()) == [("factor1", k), ("factor2", k)]
