"""Corpus pipeline: quality classifier, near-duplicate removal, personal data, mixing, packing.

Every stage takes null in any column, empty and very long texts, repeated rows and ids, an empty table, and further
columns of any name, which all but the last pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.classifier import classify
from tidepanel.llm.common import materialize, table
from tidepanel.llm.mixing import mix_documents
from tidepanel.llm.near_dedup import deduplicate
from tidepanel.llm.packing import pack_documents
from tidepanel.llm.pii import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; all of them if there are too few labels to train on.

    Null text, language, source and length are features like any other.
    """
    scored = classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("kept").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    The one of the smallest doc_id stays, nulls last, ties by row hash.  Texts without words are near nothing; of rows equal in
    id and text one stays.
    """
    return deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; a null text stays null."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target asks, cut at its exact budget.

    A null source is one of its own.  Texts without words count nothing and go along with their source's whole epochs.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins: doc_id, piece, n_words, bin_id, slot, offset, text.

    Texts without words have no bin.  Ties are broken by id, text hash and piece, so reruns agree.
    """
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: A trained classifier and 64-bit sketches can't be said in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
