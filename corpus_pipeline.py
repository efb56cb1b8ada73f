"""A training-data pipeline in five stages; each reads what the one before has written.

Toxic documents go, one document of each group of near copies stays, benchmark passages go from the texts (and documents
made of them altogether), personal data is replaced by its kind, and what is left is packed into sequences.

For all stages: columns other than ``doc_id`` and ``text`` pass through whatever their names, but the last stage returns pieces; an
empty table stays empty; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontamination, jaccard_join, packing, pii, toxicity
from lexloom.llm.tables import table
from lexloom.session import Scratch, stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the scorer learns from ``labels`` for the documents at hand.

    Null texts stay, and empty ones unless no words at all score as toxic; repeated rows are judged alike, null ids like others.
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the document with the smallest id stays.

    Rows with a null id and rows without words (null and empty texts among them) stay; of repeated rows one stays.
    """
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut from the texts; a document most of whose words are hit goes.

    Exactly half of the words hit is not most. Null texts stay null, repeated rows are cut alike.
    """
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; of overlapping ones the first names the whole. Null texts stay null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids; null and empty texts are the end id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", replace_pii),
    ("packing", pack_sequences),
]

#: A trained scorer and a tokenizer can't be said in SQL; the tests hold the stages against a plain-Python pipeline.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again, and deleted once the next is written."""
    return run_stages(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages over any table with the columns of ``documents``; the result is written to the shared folder too."""
    scratch = Scratch(spark, "pipeline")
    try:
        for name, stage in STAGES[:-1]:
            before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
            scratch.drop(before)
        return stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline-result")
    finally:
        scratch.close()
