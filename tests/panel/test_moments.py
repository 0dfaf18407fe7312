import datetime
import random

import duckdb
import pytest

from tessera.operators import selection
from tessera.operators.moments import Moments
from tessera.plans import catalog


def day(q):
    return datetime.date(2021, 1, 1) + datetime.timedelta(days=q)


def _panel(spark, seed=1):
    """Dates with a warm-up, restricted entities and factors that follow from others."""
    rng = random.Random(seed)
    rows = []
    for q in range(6):
        for e in range(80):
            a, b, s, t = (rng.gauss(0, 1) for _ in range(4))
            x = [s, a, b if q else None, 100 + a + 0.01 * t if e % 10 else None, t, a - b if q else None, 7.0]
            rows.append((e, day(q), *x, a + 0.5 * b + 0.3 * s + 0.2 * t + rng.gauss(0, 0.3) if q < 5 else None))
    rows.append((999, None, *[1.0] * 8))
    return spark.createDataFrame(rows, "entity long, period date, s double, a double, b double, near double, t double, both double, flat double, r double")


FACTORS = ["a", "b", "near", "t", "both", "flat"]


@pytest.mark.parametrize("styles", [[], ["s"], ["s", "flat"]])
@pytest.mark.parametrize("alike", ["values", "ics"])
def test_products_choose_as_rows_do(spark, monkeypatch, styles, alike):
    df = _panel(spark)
    go = lambda: selection.forward_selection(df, FACTORS, "r", styles, 0.01, 0.9, 4, alike=alike)
    got = go()
    monkeypatch.setattr(Moments, "of", lambda *a: None)
    want = go()
    assert [n for n, _ in got] == [n for n, _ in want] and len(got) > 1 and "flat" not in dict(got)
    assert [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-9)


def test_rows_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = _panel(spark)
    counted = df.mapInPandas(count, df.schema)
    selection.forward_selection(counted, FACTORS, "r", ["s"], 0.0, 0.99, 1)
    once = seen.value
    assert len(selection.forward_selection(counted, FACTORS, "r", ["s"], 0.0, 0.99, 4)) == 4
    assert seen.value == 2 * once


def test_nulls_in_many_combinations_are_left_to_rows(spark):
    rng = random.Random(2)
    rows = [(e, day(0), *[rng.random() if rng.random() < 0.5 else None for _ in range(6)]) for e in range(60)]
    df = spark.createDataFrame(rows, "entity long, period date, a double, b double, c double, d double, e double, r double")
    assert Moments.of(df, ["a", "b", "c", "d", "e", "r"]) is None
    assert selection.forward_selection(df, ["a", "b", "c", "d", "e"], "r", [], 0.0, 0.9, 2)
    assert selection.forward_selection(df.limit(0), ["a", "b"], "r", [], 0.0, 0.9, 2) == []


def test_selection_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in catalog.queries()["forward_selection"](spark, sf).collect())
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "supplier", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["forward_selection"]).fetchall())
    assert [n for n, _ in got] == [n for n, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=2e-6)
