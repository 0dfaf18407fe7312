"""The pipeline over a small corpus, each stage held to what it must keep and drop."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == first.columns and docs.count() > 0
        if i < 3:
            assert docs.count() <= before.count() and docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if name == "ngram_join":
            assert docs.count() == docs.select("text").distinct().count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_empty_and_repeated(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_a_kind(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert corpus_pipeline.one_of_a_kind(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.mixed(spark, docs, "").where("doc_id = 2").count() == 1


def test_stages_on_odd_rows(spark, tmp_path):
    """Rows without an id, rows of one id, null, empty and very long texts, columns that clash; and the whole run on an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    poison = "Zork the grumble of zorks"
    rows = [(i, f"plain words number {i} and {i * 7} and some more {i * i}", "en", "s", 40) for i in range(60)]
    rows += [(100 + i, f"{poison} {i} {i * 5}", "en", "s", 40) for i in range(60)]
    odd = [(None, "no id but words to keep", None, None, None), (None, "no id but words to keep", None, None, None), (7, None, "en", "s", None), (7, "", "en", "s", 0), (500, "long " * 300_000, "en", "t", 1_500_000), (None, poison, "en", "s", 9)]
    spark.createDataFrame([(i, 1, int(i >= 100)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words to keep"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows + odd, schema)
    wide = docs.withColumns({"score": F.lit(1.0), "hits": F.lit("x"), "size": F.lit(3)})
    kept = corpus_pipeline.without_toxic(spark, wide, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and sum(r.doc_id == 7 for r in kept) == 3 and not any(r.text and r.text.startswith(poison) for r in kept)
    clean = corpus_pipeline.without_benchmark(spark, wide, str(tmp_path))
    assert clean.count() == docs.count() and sorted(r.text for r in clean.where("doc_id is null").collect()) == [poison, "no id but ", "no id but "]
    assert corpus_pipeline.sharded(spark, wide, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.mixed(spark, wide, str(tmp_path)).where("doc_id is null").count() == 3
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
