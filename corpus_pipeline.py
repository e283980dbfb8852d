"""A training corpus from documents: toxic and poor documents go, one of each near-duplicate group stays, the rest is
packed into sequences. Each stage works on all its predecessor kept; what it returns is written and read again.

Texts are taken whole, of any length. Extra columns are kept as they are, whatever their names, by all stages but the
last. Null texts are empty documents in every stage. Rows are dropped, not ids: another text of an id that goes stays where
nothing is near to it, and of equal rows one stays. Rows with a null id are scored like others, and give way to rows
with an id that they are near to; an empty table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from dwell.llm import packing, quality_classifier, simhash, toxicity
from dwell.llm.shared import fresh_path, remove, scratch, table, text_batches


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model is learned from labelled ones among ``docs``."""
    text_batches(spark)
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the quality threshold; the model is learned from labelled ones among ``docs``."""
    text_batches(spark)
    return quality_classifier.keep(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each component of near fingerprints."""
    text_batches(spark)
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    text_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("packing", pack)]

#: Neither trained models nor tokenizers can be put in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. When a stage's result is written, what it and the stage before it left in the shared folder is
    removed; the last written result goes with the application."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        target = fresh_path(spark, name)
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(target)
        if written is not None:
            remove(spark, written)
        docs, written = spark.read.schema(result.schema).parquet(target), target
    return STAGES[-1][1](spark, docs, sf_dir)
