"""The corpus pipeline on nulls, empty and very long texts, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

BASE = "the quick brown fox jumps over the lazy dog while seven wise owls read long books about rivers and old stone bridges near town"
ITEM = "A train leaves the station at 9 and travels 120 km before Anna meets it near the river bank with her brother"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, place, rows, labels=(), items=()):
    spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOCUMENT).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_edges_go_through_all_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "word " * 30_000), (5, BASE), (5, BASE), (6, BASE), (7, "Before. " + ITEM + " after."), (8, "an own line of this document"), (9, "an own line of this document\nand one more that no other text has in it")]
    place = folder(spark, tmp_path / "some", rows, items=[(1, ITEM), (2, None)])
    docs = spark.read.parquet(f"{place}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
    # without labels every score is the same, above the threshold
    assert kept["quality_classifier"] == [0, 1, 2, 3, 5, 5, 6, 7, 8, 9]
    # the first document keeps a recurring line; one left without text goes
    assert kept["line_dedup"] == [0, 1, 2, 3, 5, 5, 7, 8, 9] and docs.where("doc_id = 9").first().text == "and one more that no other text has in it"
    assert kept["near_dedup"] == kept["line_dedup"] and kept["benchmark_decontamination"] == [0, 1, 2, 3, 5, 5, 8, 9]
    packed = pipeline.run(spark, place)
    assert sorted(r.doc_id for r in packed.select("doc_id").distinct().collect()) == [0, 1, 2, 3, 5, 8, 9]
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id < 2").select("n").distinct().first().n == 1


def test_empty_tables_give_no_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    assert pipeline.run(spark, folder(spark, tmp_path / "none", [])).count() == 0
