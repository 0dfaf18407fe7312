"""Tasks of panels, windows along time and ranks of values do not grow with the rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import batch
from tessera.plans import stage
from tessera.plans.expression import evaluate, parse
from tessera.plans.stage import written
from tessera.sources.panel import part_panel

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(stage, "ROWS", 500)


def _most(df) -> int:
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_panel_of_many_rows_has_more_tasks(spark, monkeypatch):
    at_once = part_panel(spark, SMALL)
    rows, same, largest = at_once.count(), set(at_once.collect()), _most(at_once)
    monkeypatch.setattr(stage, "ROWS", 500)
    p = part_panel(spark, SMALL)
    assert _most(p) < largest / 2 and p.count() == rows and set(p.collect()) == same
    plan = p._jdf.queryExecution().sparkPlan().toString()
    n = stage.tasks(spark.read.parquet(f"{SMALL}/lineitem.parquet").count(), spark)
    assert plan.count(f", {n})") + plan.count(f", {n}, ") >= 2, plan


def test_windows_along_time_of_a_written_table(spark, few):
    panel = written(part_panel(spark, SMALL))
    (df,) = evaluate(panel, {"f": parse("ts_mean_4(x)")})
    assert df.rdd.getNumPartitions() >= panel.count() // 500
    (own,) = evaluate(part_panel(spark, SMALL), {"f": parse("ts_mean_4(x)")})
    assert {(r.entity, r.qidx, r.f) for r in df.collect()} == {(r.entity, r.qidx, r.f) for r in own.collect()}


def test_ranks_of_values_in_more_tasks(spark, monkeypatch):
    panel = part_panel(spark, SMALL).select("entity", "period", "qidx", "industry", "restricted", "x", "y", "z", "fwd_ret")
    rule, trees = batch.Rule("spearman", 0.0, 5, 0.0), [parse(t) for t in ("x", "cs_add(x, y)")]
    plain = batch.ic_series(panel, trees, "fwd_ret", rule=rule)
    monkeypatch.setattr(stage, "ROWS", 500)
    dealt = []
    monkeypatch.setattr(batch, "spread", lambda rows, df, *by: dealt.append((by, stage.tasks(rows, spark))) or stage.spread(rows, df, *by))
    got = batch.ic_series(panel, trees, "fwd_ret", rule=rule)
    assert [by for by, n in dealt if n] == [("name", "period", "v"), ("name", "period", "range")]
    assert all(plain[t].keys() == got[t].keys() and all(abs(plain[t][p] - got[t][p]) < 1e-9 for p in got[t]) for t in plain)
