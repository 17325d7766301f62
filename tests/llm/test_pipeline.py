"""The pipeline's stages on odd tables, and the operators on empty ones."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from loomcite.llm import decontam, licences, lm, neardup, order, packing, quality, rules, tokencount, toxicity

import corpus_pipeline

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tables(spark, docs, odd_texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 9 != 0), int(k % 8 == 1)) for k in range(60)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, odd_texts[10][1])], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_columns_and_rows_as_they_are(spark, docs, tables):
    columns, rows = docs.columns, {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables)
        assert after.columns == columns, name
        assert {tuple(r) for r in after.collect()} <= rows


def test_stages_keep_columns_that_are_named_like_their_own(spark, docs, tables):
    named = docs.withColumnsRenamed({"key": "_loom_key", "uid": "KEY_"}).withColumn("key", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[2:4]:
        after = stage(spark, named, tables)
        assert after.columns == named.columns and after.select("key").distinct().collect() == [("mine",)], name


def test_stage_decisions(spark, docs, odd_texts, tables):
    unique = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, tables).collect()]
    assert len(unique) == sum(r.kept for r in neardup.near_duplicates(docs).collect())
    clean = corpus_pipeline.decontamination_stage(spark, docs, tables).collect()
    assert len(clean) == len(odd_texts) - 1 and 10 not in {r.doc_id for r in clean}


def test_run_is_the_stages_one_after_the_other(spark, docs, tables):
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, tables)
        step = spark.createDataFrame(out.collect(), out.schema)
    pack = lambda rows: sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in rows)
    assert pack(corpus_pipeline.run(spark, tables).collect()) == pack(step.collect())


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    results = [
        packing.packed(no_docs, VOCABULARY), order.materialised(no_docs, VOCABULARY), rules.judged(no_docs), quality.scored(no_docs, labels), licences.scanned(no_docs),
        tokencount.counted(no_docs, public_tokenizers.path("piece_bpe_32k.model")), lm.scored(no_docs), toxicity.scored(no_docs, labels),
        neardup.near_duplicates(no_docs), decontam.contamination(no_docs, benchmark),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_tables_without_labels_or_items(spark, docs, odd_texts):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert quality.accepted(docs, labels).count() == toxicity.accepted(docs, labels).count() == len(odd_texts)
    assert decontam.decontaminated(docs, benchmark).count() == len(odd_texts)
