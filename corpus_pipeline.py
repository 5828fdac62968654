"""A corpus pipeline: language, exact copies, near copies, benchmark passages, token ids.

Each stage takes the session, its predecessor's documents and the tables' folder, and returns the
documents that it keeps, with all their columns; the last returns token counts and digests. A stage's
result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, decontaminate, exact_dedup, language_id, simhash
from tracewell.llm.common import table, written
from tracewell.llm.queries import tokenizer_path

#: No SQL states the model of the first stage; the tests hold the stages against plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("benchmark", decontaminate_documents),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
