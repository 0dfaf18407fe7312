"""Levels of sums read their panel a bounded number of times; ranks of a date come of ranges of values."""

from tessera.plans.expression import build, parse
from tessera.plans.flow import Flow


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_levels_read_linearly(spark, tmp_path):
    rows = [(e, q, q, e % 3, float((e * 7 + q * 3) % 11), float(e * q % 5)) for e in range(20) for q in range(4)]
    spark.createDataFrame(rows, "entity long, qidx int, period int, industry int, x double, y double").write.parquet(f"{tmp_path}/p")
    panel = spark.read.parquet(f"{tmp_path}/p")
    text = "x"
    for depth in range(1, 6):
        text = f"cs_zscore(cs_add({text}, y))"
        f = Flow(panel)
        out = f.run({"v": build(f, parse(text))})
        assert scans(out) <= 2, depth
    assert out.where("v is not null").count() == 80


def test_ranks_need_no_window_of_a_date(spark):
    rows = [(e, q, q, 1, None if e % 9 == 0 else float((e * 7) % 13)) for e in range(60) for q in range(2)]
    panel = spark.createDataFrame(rows, "entity long, qidx int, period int, industry int, x double")
    f = Flow(panel)
    out = f.run({"v": build(f, parse("cs_rank(x)"))})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_s" in line.split("windowspecdefinition(")[1] for line in windows)
    one = Flow(panel, parts=1)
    same = one.run({"v": build(one, parse("cs_rank(x)"))})
    key = ["entity", "qidx", "v"]
    assert sorted(map(tuple, out.select(key).collect()), key=str) == sorted(map(tuple, same.select(key).collect()), key=str)
