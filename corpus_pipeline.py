"""Corpus pipeline: documents in, packed training sequences out.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns what the next one reads. All but the
last return the columns of documents; where a stage changes a text, n_chars follows. A stage begins when its predecessor's
result has been written, and first removes the tables that were left between the predecessor's steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import langid, near_dup, packing, repeats, secrets
from evigraph.llm.bpe import default_vocabulary
from evigraph.llm.common import clear_steps, written


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are too far from every language learned from the labelled ones, or have no letters."""
    clear_steps()
    return langid.keep_known(docs, langid.fit(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group (shingles of five words, similarity of 0.8 or more)."""
    clear_steps()
    return near_dup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of over 50 words that occur elsewhere out of the texts."""
    clear_steps()
    return repeats.without_passages(docs, words=51)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark."""
    clear_steps()
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, packed into sequences."""
    clear_steps()
    return packing.pack(docs, default_vocabulary())


STAGES = [
    ("language", known_languages),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secret_scan),
    ("packing", packed),
]

#: Sketches, suffix order and greedy packing have no SQL form; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", steps=False)
    return docs
