"""Tables that searches write, and figures that lie half-way between two digits."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tessera.operators import batch, fitness
from tessera.plans.expression import parse
from tessera.plans.return_reports import excess_period_return
from tessera.plans.stage import passing, shared_dir, written


def _panel(spark):
    rows = spark.range(480).select((F.col("id") % 60).alias("entity"), F.floor(F.col("id") / 60).cast("int").alias("qidx"))
    x = (F.col("entity") * 37 + F.col("qidx") * 11) % 61
    return rows.withColumns({"period": F.date_add(F.lit("2020-01-01").cast("date"), F.col("qidx")), "x": F.when(F.col("entity") % 9 > 0, x.cast("double")), "y": ((F.col("entity") * 13 + F.col("qidx") * 7) % 53).cast("double"),
                             "r": F.when(F.col("entity") % 7 > 0, ((F.col("entity") * 29 + F.col("qidx") * 17) % 47).cast("double")), "industry": F.lit(1), "restricted": F.col("entity") % 11 == 0})


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_tables_of_a_batch_go_with_it(spark):
    panel = written(_panel(spark))
    before = _bytes(shared_dir(spark))
    got = batch.ic_series(panel, [parse(t) for t in ("cs_rank(x)",)], "r")
    assert all(len(v) > 5 for v in got.values()) and _bytes(shared_dir(spark)) == before


def test_passing_keeps_what_was_there(spark):
    kept = written(spark.range(5))
    with passing(spark):
        outer = written(spark.range(7))
        with passing(spark):
            written(spark.range(9))
        assert outer.count() == 7
    assert kept.count() == 5


def test_figures_of_all_programs_in_one_table(spark, monkeypatch):
    """The same figures as one program at a time, from one evaluation of the panel; a factor without values too."""
    panel, programs = written(_panel(spark)), [parse(t) for t in ("x", "cs_neg(y)")]
    calls = []
    monkeypatch.setattr(batch, "evaluate", lambda *a, of=batch.evaluate: calls.append(a) or of(*a))
    for name in ("alert_icir", "long_only_neutral_ic"):
        calls.clear()
        got = batch.whole_figures(panel, programs, "r", batch.Rule(name, 0.6, 2, 0.0, ("y",)))
        assert len(calls) == 1
        for t in programs:
            one = fitness.metric(name, batch.evaluate(panel, {"f": t})[0], "f", "r", styles=["y"], least=0.6).first().value
            assert abs(got[str(batch.canonical(t))][None] - one) < 1e-9
    none = batch.whole_figures(panel.withColumn("x", F.lit(None).cast("double")), [parse("x")], "r", batch.Rule("long_only_neutral_ic", 0.6, 2, 0.0, ("y",)))
    assert list(none.values()) == [{None: 0.0}]


def test_excess_return_half_way(spark, tmp_path):
    """Exactly 4.48875, of which the sum of doubles falls short."""
    day = dt.datetime(1995, 6, 1)
    spark.createDataFrame([(1, 825284.97, day), (2, 796257.72, day)], "o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.entity: r.ret for r in excess_period_return(spark, str(tmp_path)).collect()}
    assert got == {1: 4.4888, 2: -4.4888}
