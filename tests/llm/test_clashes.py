"""Pipeline stages keep extra columns that are named like their results."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_extra_columns(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i}", "en", f"src{i % 3}", len(f"some words of text number {i}")) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("slot", "weight", "block", "kept", "component_id", "spans", "live", "node"):
        docs = docs.withColumn(c, F.col("doc_id") * 7)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.redact_secrets, corpus_pipeline.mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty() and out.count() == 30
