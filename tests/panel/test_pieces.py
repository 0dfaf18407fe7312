"""Correlations by tiles, settings as JSON, output transformers, the tensor source, panels with their coverage, parts of programs day by day."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import candidates, metrics
from tessera.operators import evolve as gp
from tessera.plans import expression
from tessera.plans.expression import parse
from tessera.sources import panel as sources
from tessera.sources.tensor import TensorReader, TensorSource


def frame(columns, days=3, rows=40):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(days * rows, columns)) + 1e6
    m[:, 1] = m[:, 0] * 2
    m[rng.random(m.shape) < 0.2] = np.nan
    m[:, 2] = 7.0
    m[: days * rows // 2, 3] = np.nan
    out = pd.DataFrame(m, columns=[f"f{i}" for i in range(columns)])
    out.insert(0, "period", [datetime.date(2020, 1, 1 + i % days) for i in range(len(out))])
    return out


@pytest.mark.parametrize("tile, states", [(64, 64), (3, 2)])
def test_correlations_by_tiles(spark, monkeypatch, tile, states):
    monkeypatch.setattr(metrics, "TILE", tile)
    monkeypatch.setattr(metrics, "STATES", states)
    pdf = frame(8)
    names = list(pdf.columns[1:])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "period date, " + ", ".join(f"{n} double" for n in names)).repartition(7)
    got = {(r.a, r.b): r["corr"] for r in metrics.correlations(df, names).collect()}
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    for (a, b), r in got.items():
        each = [d[[a, b]].dropna() for _, d in pdf.groupby("period")]
        want = [np.corrcoef(d[a], d[b])[0, 1] for d in each if d[a].std(ddof=0) * d[b].std(ddof=0) > 1e-12]
        assert (r is None and not want) or math.isclose(r, np.mean(want), abs_tol=1e-7), (a, b)
    assert metrics.correlations(df, names[:1]).count() == 0 and metrics.correlations(df.limit(0), names).count() == 0


def test_two_hundred_factors_in_one_pass(spark):
    pdf = frame(200, 2, 60)
    names = list(pdf.columns[1:])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "period date, " + ", ".join(f"{n} double" for n in names))
    out = metrics.correlations(df, names)
    assert out.count() == 200 * 199 // 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Generate" not in plan


def test_settings_as_json():
    s = gp.Settings(population=7, depth=(2, 4), stop=0.5, parsimony="auto")
    assert gp.Settings.from_json(s.to_json()) == s and gp.Settings.from_json(gp.Settings().to_json()) == gp.Settings()
    assert gp.Settings.from_json('{"depth": [1, 2]}').depth == (1, 2)
    with pytest.raises(KeyError, match="poplation"):
        gp.Settings.from_json('{"poplation": 3}')
    for bad in ('{"population": 0}', '{"replacement": "none"}'):
        with pytest.raises(ValueError):
            gp.Settings.from_json(bad)


def test_output_transformers(spark):
    df = spark.createDataFrame([(0.0,), (None,)], "v double")
    assert [r.v for r in expression.transformed(df, ["v"], "sigmoid").collect()] == [0.5, None]
    assert expression.transformed(df, ["v"], None) is df
    expression.register_transformer("twice", lambda x: 2 * x, spark)
    assert expression.transformed(df.fillna(3.0), ["v"], "twice").first().v == 0.0
    with pytest.raises(ValueError):
        expression.register_transformer("log", lambda x: F.log(x + 1e-320) * 1e308 * 10, spark)
    with pytest.raises(KeyError):
        expression.transformed(df, ["v"], "none")


def test_tensor_source(spark, tmp_path):
    cube = np.arange(2 * 3 * 5, dtype=np.float32).reshape(2, 3, 5)
    cube[1, 2, 4] = np.nan
    np.save(f"{tmp_path}/t.npy", cube)
    spark.dataSource.register(TensorSource)
    read = lambda **o: spark.read.format("tensor").options(path=f"{tmp_path}/t.npy", names="a,b,c", **o).load()
    df = read(features="c, a", rows="4")
    assert df.columns == ["entity", "qidx", "c", "a"] and df.rdd.getNumPartitions() == 3
    got = {(r.entity, r.qidx): (r.c, r.a) for r in df.collect()}
    assert got == {(e, q): (None if (q, e) == (1, 4) else float(cube[q, 2, e]), float(cube[q, 0, e])) for e in range(5) for q in range(2)}
    with pytest.raises(Exception, match="no such feature: d"):
        read(features="d").count()
    with pytest.raises(ValueError, match="features x entities"):
        TensorReader(f"{tmp_path}/t.npy", ["a", "b"], ["a"], 10)


def test_features_not_asked_for_are_not_read(tmp_path, monkeypatch):
    np.save(f"{tmp_path}/t.npy", np.zeros((2, 3, 4), np.float32))
    touched = []

    class Watched:
        def __init__(self, a):
            self.a, self.shape = a, a.shape

        def __getitem__(self, at):
            touched.append(at[1])
            return self.a[at]

    real = np.load
    monkeypatch.setattr(np, "load", lambda *a, **k: Watched(real(*a, **k)))
    r = TensorReader(f"{tmp_path}/t.npy", ["a", "b", "c"], ["b"], 100)
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 8 and set(touched) == {1}


def test_panel_with_its_coverage(spark, tmp_path):
    rows = [(e, q, float(e), None if (e + q) % 4 == 0 else 1.0) for e in range(8) for q in range(2)]
    df = spark.createDataFrame(rows, "entity long, period int, x double, y double")
    known = sources.write_panel(df, ["x", "y"], f"{tmp_path}/p", {"unit": "quarter"})
    back, read = sources.read_panel(spark, f"{tmp_path}/p", ["y"])
    assert known == read and read["unit"] == "quarter" and read["rows"] == 16 and back.columns == ["entity", "period", "y"]
    want = {r.feature: r.m for r in sources.checked_coverage(df, ["x", "y"], 0.0).groupBy("feature").agg(F.avg("coverage").alias("m")).collect()}
    assert read["coverage"] == want == {"x": 1.0, "y": 0.75}
    with pytest.raises(KeyError):
        sources.read_panel(spark, f"{tmp_path}/p", ["z"])


def test_parts_day_by_day(spark):
    rng = random.Random(3)
    rows = [(e, q, q, e % 2, float(rng.randrange(30)), float(e % 2), rng.gauss(0, 0.02) - e / 1000) for q in range(8) for e in range(40)]
    df = spark.createDataFrame(rows, "entity long, qidx int, period int, industry int, x double, two double, r double")
    got = {r.formulation: r for r in candidates.daily_node_metrics(df, {"f": parse("cs_add(x, two)")}, "r", periods=250).collect()}
    assert set(got) == {str(parse(t)) for t in ("cs_add(x, two)", "x", "two")}
    pdf = pd.DataFrame(rows, columns=["entity", "qidx", "period", "industry", "x", "two", "r"])
    pdf["s"] = pdf.x + pdf.two
    for text, col in (("cs_add(x, two)", "s"), ("x", "x"), ("two", "two")):
        ics, spreads = [], []
        for _, d in pdf.groupby("period"):
            pct = d[col].rank(pct=True)
            ics.append(np.corrcoef(pct, d.r.rank(pct=True))[0, 1])
            b = 10 - np.floor((1 - pct) * 10)
            m = d.r.groupby(b).mean()
            spreads.append(m.iloc[-1] - m.iloc[0])
        ret = np.array(spreads) * (-1 if np.mean(ics) < 0 else 1)
        cum = np.cumsum(ret)
        r = got[str(parse(text))]
        assert (r.days, r.mean_ic, r.icir) == (8, pytest.approx(np.mean(ics)), pytest.approx(np.mean(ics) / np.std(ics, ddof=1) * math.sqrt(8)))
        assert (r.annual, r.sharpe) == (pytest.approx(ret.mean() * 250), pytest.approx(ret.mean() / ret.std() * math.sqrt(250)))
        assert r.drawdown == pytest.approx((np.maximum(np.maximum.accumulate(cum), 0.0) - cum).max())
