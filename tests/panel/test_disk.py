"""What a search takes of the disk at once does not grow with the width of its batches."""

import pytest
from test_tables import _bytes, _panel

from tessera.operators import batch, evolve
from tessera.plans import expression, flow, stage
from tessera.plans.expression import evaluate, parse
from tessera.plans.stage import passing, shared_dir, written

TREES = ["x", "cs_rank(x)", "cs_rank(y)", "ts_mean_2(x)", "cs_sub(cs_rank(x), cs_rank(ts_delta_1(y)))", "ts_mean_2(cs_rank(cs_add(x, y)))", "cs_abs(cs_demean(cs_zscore(y)))", "cs_mul(cs_zscore(x), y)", "cs_add(x, y)"]


@pytest.fixture
def tables(monkeypatch):
    """For each table that a flow writes, its columns and the tables of the folder before it."""
    seen = []
    for module in (flow, batch):
        monkeypatch.setattr(module, "written", lambda df, *a, of=module.written: seen.append(set(df.columns)) or of(df, *a))
    return seen


def test_tables_of_few_columns_in_wide_batches(spark, tables, monkeypatch):
    trees = [parse(t) for t in TREES]
    with passing(spark):
        panel = written(_panel(spark).selectExpr("*", "x AS unread"))
        wide = batch.ic_series(panel, trees, "r")
        tables.clear()
        monkeypatch.setattr(flow, "HELD", 480 * 4, raising=False)
        got = batch.ic_series(panel, trees, "r")
    own = set(panel.columns)
    assert tables and max(len(t - own) for t in tables) <= 4 and not any("unread" in t for t in tables)
    assert wide.keys() == got.keys() and all(wide[t].keys() == got[t].keys() and all(abs(wide[t][p] - got[t][p]) < 1e-9 for p in got[t]) for t in got)


def test_expressions_without_tables_stay_together(spark, monkeypatch):
    monkeypatch.setattr(flow, "HELD", 480 * 4)
    with passing(spark):
        panel = written(_panel(spark))
        got = expression.batches(panel, {t: parse(t) for t in TREES}, 50)
    assert sorted(t for some in got for t in some) == sorted(TREES)
    assert set(got[0]) == {"x", "ts_mean_2(x)", "cs_mul(cs_zscore(x), y)", "cs_add(x, y)"} and len(got) > 3


def test_ranks_of_values_of_some_programs_at_once(spark, tables, monkeypatch):
    trees, rule = [parse(t) for t in ("x", "y", "cs_add(x, y)")], batch.Rule("spearman", 0.0, 5, 0.0)
    wide = batch.ic_series(_panel(spark), trees, "r", rule=rule)
    before = len(tables)
    monkeypatch.setattr(flow, "HELD", 480 * 5, raising=False)
    got = batch.ic_series(_panel(spark), trees, "r", rule=rule)
    assert len(tables) - before > before and all(abs(wide[t][p] - got[t][p]) < 1e-9 for t in got for p in got[t]) and wide.keys() == got.keys()


def test_windows_along_time_of_a_dealt_table_need_no_exchange(spark):
    with passing(spark):
        panel = stage.dealt(written(_panel(spark)))
        (df,) = evaluate(panel, {"f": parse("ts_delta_1(ts_mean_2(x))")})
        assert "Exchange" not in df._jdf.queryExecution().sparkPlan().toString() and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        (own,) = evaluate(_panel(spark), {"f": parse("ts_delta_1(ts_mean_2(x))")})
        assert {(r.entity, r.qidx, r.f) for r in df.collect()} == {(r.entity, r.qidx, r.f) for r in own.collect()}


def test_files_of_shuffles_go_with_their_job(spark):
    there = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    setting = spark.conf.get(stage._TIDY, None)
    with passing(spark):
        before = there()
        kept = written(spark.range(1000).repartition(3, "id"))
        assert kept.repartition(2, "id").groupBy().count().first()[0] == 1000
        assert there() <= before
    assert spark.conf.get(stage._TIDY, None) == setting


def test_a_search_leaves_nothing(spark):
    before, names = _bytes(shared_dir(spark)), {t.name for t in spark.catalog.listTables()}
    records = evolve.evolve(_panel(spark), ["cs_rank", "cs_add", "ts_mean_2"], ["x", "y"], "r", evolve.Settings(population=4, generations=1, warm_start=1))
    assert len(records) == 8 and _bytes(shared_dir(spark)) == before and {t.name for t in spark.catalog.listTables()} == names


def test_what_the_order_of_a_sum_leaves_decides_no_tie(spark, monkeypatch):
    """Scores that differ by rounding alone, one way or the other, give the same search."""
    def run(sign: float) -> list:
        noise = lambda *a, of=batch.ic_series, **k: {t: {p: v + sign * 1e-16 * (len(t) % 3 - 1) for p, v in s.items()} for t, s in of(*a, **k).items()}
        monkeypatch.setattr(evolve, "ic_series", noise)
        return evolve.evolve(_panel(spark), ["cs_neg", "cs_abs", "cs_zscore"], ["x", "y"], "r", evolve.Settings(population=6, generations=2, warm_start=1))

    assert run(1.0) == run(-1.0)
