"""Each stage on its own input, and the whole."""

from pyspark.sql import functions as F

import corpus_pipeline
from fieldlake.llm import decontaminate, line_dedup, near_dedup
from fieldlake.llm.common import written


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        kept, before = out.count(), docs.count()
        assert 0 < kept < before
    one = corpus_pipeline.one_of_each(spark, docs, sf)
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in near_dedup.near_groups(docs).filter("kept").collect()}
    clean = corpus_pipeline.no_leaks(spark, docs, sf)
    assert decontaminate.find_leaks(clean, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0


def test_line_dedup_drops_what_it_empties_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cut = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.first_lines(spark, docs, sf).collect()}
    assert left == {i: t for i, t in cut.items() if t and t.split()}


def test_near_copies_go(spark, sf):
    """Copies with a word changed here and there, under new ids, of documents that stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    chosen = docs.filter(F.col("doc_id").isin(sorted(kept)[:20])).filter("n_chars > 800")
    near = chosen.withColumn("doc_id", F.col("doc_id") + 10_000_000).withColumn("text", F.concat(F.lit("zzyzx "), "text", F.lit(" yzzyx")))
    both = docs.unionByName(near)
    for _, stage in corpus_pipeline.STAGES[1:3]:
        both = written(stage(spark, both, sf), "test-stage")
    left = {r["doc_id"]: r["text"] for r in both.collect()}
    full = {r["doc_id"]: r["text"] for r in near.collect()}
    assert full and all(len(left.get(i, "")) < len(t) / 2 for i, t in full.items())


def test_whole(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r["round_trip"] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["n_tokens"] > 0 for r in rows)
