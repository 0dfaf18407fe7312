"""Ranks by ranges of values, whatever the bounds are."""

import random

from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.operators.cross_section import average_rank
from tessera.plans import stage
from tessera.plans.flow import Flow


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _table(spark):
    return spark.range(600).select((F.col("id") % 2).alias("period"), F.col("id").alias("entity"), F.when(F.col("id") % 5 > 0, (F.col("id") * 37 % 101).cast("double")).alias("x"))


def _expected(rows) -> dict:
    out = {}
    for r in rows:
        own = [s.x for s in rows if s.period == r.period and s.x is not None]
        out[r.entity] = None if r.x is None else sum(v < r.x for v in own) + (sum(v == r.x for v in own) + 1) / 2
    return out


def test_bounds_are_estimated_once(spark, monkeypatch):
    """Quantiles that come out otherwise each time they are taken, as approximate ones of a shuffle do."""
    exact = F.percentile_approx
    shaken = F.udf(lambda b: [v + random.uniform(-3, 3) for v in b], "array<double>").asNondeterministic()
    monkeypatch.setattr(ranking.F, "percentile_approx", lambda *a: F.sort_array(shaken(exact(*a))))
    df = _table(spark)
    got = {r.entity: (r.rank, r.rank_n) for r in ranking.with_ranks(df, {"rank": "x"}).collect()}
    assert got == {e: (v, 240) for e, v in _expected(df.collect()).items()}


def test_rows_take_no_arrays_along(spark):
    """Neither windows nor exchanges of rows hold bounds or sizes of ranges."""
    df = _table(spark).withColumn("qidx", F.col("entity").cast("int"))
    f = Flow(df)
    flow = f.run({"rank": average_rank(f, "x")}).select("entity", "rank")
    assert {r.entity: r.rank for r in flow.collect()} == _expected(df.collect())
    for p in (_plan(flow), _plan(ranking.with_ranks(df, {"rank": "x"}).select("entity", "rank"))):
        above = p[: p.rindex("Window")]
        assert "slice(" not in above and "aggregate(" not in above


def test_missing_values_and_large_tables_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(stage, "ROWS", 20)
    df = _table(spark).withColumn("x", F.when(F.col("entity") % 10 == 1, F.col("x")))
    ranked = ranking.with_ranks(df, {"rank": "x"})
    assert {r.entity: r.rank for r in ranked.collect()} == _expected(df.collect())
    assert ranked.rdd.getNumPartitions() == 30
    most = ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 120  # all 540 rows without a value were in two tasks before
