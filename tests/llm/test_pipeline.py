"""The stages act on what their predecessors kept, and the chat query equals its SQL."""

import sys
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline
from ventrica.llm import language, queries
from ventrica.llm.near_dup import near_duplicates

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns, name
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in kept.collect()}
        assert after <= before and after
        if name == "near_dedup":
            assert after == {r.doc_id for r in near_duplicates(docs).where("kept").collect()}
        docs = kept.sparkSession.createDataFrame(kept.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.collect()} == after


def test_chat_equals_sql(spark):
    found = queries.QUERIES["op9_chat_format"](spark, DATA)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS FROM '{DATA}/conversations.parquet'")
    want = duck.sql(queries.ORACLES["op9_chat_format"])
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())


def test_languages_cover_documents_and_pages(spark):
    found = queries.QUERIES["op8_language_id"](spark, DATA).collect()
    for name, key in (("documents", "doc_id"), ("pages", "page_id")):
        ids = sorted(r[0] for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(key).collect())
        assert ids and sorted(r[key] for r in found if r[key] is not None) == ids
    assert all((r.doc_id is None) != (r.page_id is None) for r in found)


def test_text_languages_without_the_own_label(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    said = {r.doc_id: r.lang for r in docs.collect()}
    right = 0
    for k in (0, 1):
        table = language.document_models(docs.where(fold != k))
        out = language.identify_languages(docs.where(fold == k), "doc_id", F.col("text"), table)
        right += sum(r.text_language == said[r.doc_id] for r in out.collect())
    assert right / len(said) > 0.9


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    rows, size = corpus_pipeline.BATCHES
    before = {name: spark.conf.get(name, None) for name in (rows, size)}
    try:
        spark.conf.unset(rows)
        spark.conf.set(size, "123456")
        stage = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: (spark.conf.get(rows), spark.conf.get(size), docs, sf_dir))
        assert stage(spark, None, "x") == (corpus_pipeline.BATCHES[rows], "123456", None, "x")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
