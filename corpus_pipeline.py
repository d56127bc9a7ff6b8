"""The corpus pipeline: stages that each call one operator, in order.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All stages but the last return the columns of ``documents``, and others that ``docs``
has. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relayspark.llm import decontaminate, language_id, minhash, packing, secret_scan
from relayspark.llm.common import written
from relayspark.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned from the labelled ones; the rest go: null and empty texts, those without
    a letter, and all if no row is labelled. Repeated rows share one verdict."""
    model = language_id.train(docs)
    return language_id.accepted(language_id.classify(docs, model)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id (null comes last). Repeated rows leave
    one; null and wordless texts stay."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts, and documents that are mostly such passages as a whole. Null and empty
    texts stay as they are."""
    return decontaminate.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; other rows, null and empty texts too, stay as they are."""
    return secret_scan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences for training, with their token ids; a null or empty text is the end id
    alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secrets),
    ("packing", sequences),
]

#: SQL cannot express the language and packing stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
