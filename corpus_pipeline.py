"""A training-data pipeline over ``documents``: five stages, each one operator of tallywatch.llm.

Every stage works on all documents its predecessor kept. The stages but the last return documents
with their own columns; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywatch.llm import fertility, linededup, mixing, packing, simhash
from tallywatch.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside the bands of their language or script.

    A null or empty text fails and goes; equal rows stay or go together; a null language is judged by its
    script; columns pass through, whatever their names; no rows give no rows."""
    return fertility.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id has are gone from the texts.

    A text without such a line stays as it is, also a null; rows with one id are one document; a null id counts as
    the largest; n_chars follows a changed text; no rows give no rows."""
    return linededup.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies.

    Texts without a word form one group; of several rows with the smallest id, and of null ids, the operator's
    own order decides which stays; no rows give no rows."""
    return simhash.one_per_group(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a repeated document is a repeated row.

    Documents without words (null texts among them) are not taken; a null source is one of its own; equal rows are
    separate documents; no rows give no rows."""
    return mixing.mixed_documents(docs)


def packing_to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of tokens.

    A null text is empty and has the end token alone; repeated rows are separate documents; no rows give no pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_to_targets),
    ("packing", packing_to_sequences),
]

# The verdict of a vocabulary, SimHash and token ids have no SQL form; tests/llm/test_pipeline.py
# compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
