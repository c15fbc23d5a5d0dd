"""Ids of 64 bits beside nulls come back as they went in, from every operator."""

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import classifier, embeddings, mixing, near_dedup, packing, pii, quality_rules, resampling, sharding, substrings, url_filter, warc

from .test_llm import labelled, prose

BIG = [(1 << 60) + 1, (1 << 60) + 3, None, (1 << 53) + 1, -(1 << 60) - 1]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(40, k % 3), "en", "s", 1) for k, i in enumerate(BIG)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df, name="doc_id"):
    return sorted(map(str, {r[0] for r in df.select(name).collect()}))


WANT = sorted(map(str, BIG))


@pytest.mark.parametrize("run", [sharding.op1_sharding, substrings.op2_substring_dedup, mixing.op4_mixing, packing.op5_packing, packing.pack_documents, quality_rules.op6_quality_rules, pii.op8_pii, near_dedup.op9_near_dedup])
def test_ids_of_documents(docs, run):
    assert ids(run(docs)) == WANT


def test_component_ids_are_whole(docs):
    got = {r.doc_id: r.component_id for r in near_dedup.op9_near_dedup(docs).collect()}
    assert got == {BIG[0]: BIG[3], BIG[3]: BIG[3], BIG[1]: BIG[4], BIG[4]: BIG[4], None: None}


def test_ids_of_learned_and_drawn_documents(spark, docs):
    more = spark.createDataFrame(labelled(40), docs.schema)
    lab = more.select("doc_id", F.col("doc_id").cast("int").alias("quality")).select("doc_id", (F.col("quality") < 40).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    every = docs.unionByName(more)
    assert set(WANT) <= set(ids(classifier.op3_quality_classifier(every, lab)))
    bench = docs.select(F.lit(1).cast("long").alias("item_id"), "text")
    drawn = resampling.op12_importance_resampling(docs, bench)
    assert ids(drawn) == WANT and drawn.where("rank is not null").count() == 1


def test_ids_of_vectors(spark):
    df = spark.createDataFrame([(i, "a", [1.0, 0.0]) for i in BIG], "vec_id long, label string, embedding array<float>").coalesce(1)
    assert ids(embeddings.op10_embedding_dedup(df), "vec_id") == WANT


def test_ids_of_pages(spark):
    df = spark.createDataFrame([(i, "http://a.b/", "same" if k < 3 else f"own {k}") for k, i in enumerate(BIG)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.op7_warc(df).collect()}
    assert got == {BIG[0]: ("revisit", BIG[1]), BIG[1]: ("response", None), None: ("revisit", BIG[1]), BIG[3]: ("response", None), BIG[4]: ("response", None)}
    assert ids(url_filter.op11_url_filter(df), "page_id") == WANT
