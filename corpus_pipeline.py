"""A pipeline over documents: toxicity, exact dedup, near-dedup, secrets, packing.

Each stage takes what its predecessor kept, as a table, and all but the last return the columns of
documents. Every stage is an operator of tallyloom.llm and carries whole texts.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import cut, read, share_path
from tallyloom.llm.exact_dedup import drop_exact_duplicates
from tallyloom.llm.near_dedup import drop_near_duplicates
from tallyloom.llm.packing import pack_binary
from tallyloom.llm.secrets import redact_secrets
from tallyloom.llm.toxicity import drop_toxic, fit_toxicity, learnable


def _anywhere(stage):
    """The stage, for sessions whose workers don't have this folder on their path yet."""
    return wraps(stage)(lambda spark, docs, sf_dir: stage(share_path(spark), docs, sf_dir))


# What holds for every stage: a table without rows gives one without rows; columns beside doc_id and text are
# carried whatever their names and values, those that a stage makes and needs live in a struct of their own; texts
# are taken whole, however long; a null doc_id is an id like any other, smaller than all others.


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, learnt from the labels that are not held out.

    Null and empty texts have no words and get the rate of such rows; equal texts are judged alike, so
    all of them stay or go; ties among neighbours go to smaller ids. Labels of other ids, or null, don't count;
    with none at all, nothing is toxic."""
    model = fit_toxicity(docs.select("doc_id", "text"), learnable(read(spark, sf_dir, "labels", "doc_id", "toxic")))
    return drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id.

    Null and empty texts are equal, so one row of them all stays. Of rows that repeat both, one stays."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id that isn't null.

    Texts without words are near their equals alone; null counts as empty. Of rows that repeat, one stays."""
    return drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars to match.

    Every row is judged by itself, repeated ones alike; null and empty texts have no secrets and stay as they are."""
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length.

    Null and empty texts are the one final id. Rows that repeat are packed each by itself, and so is a document
    of any length: it becomes as many pieces as it needs."""
    return pack_binary(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(name, _anywhere(stage)) for name, stage in (("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secrets", mask_secrets), ("packing", pack))]

#: Models, signatures and automata are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the table that the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
