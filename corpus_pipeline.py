"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the
stage before it kept; run() writes each result as Parquet into the shared
folder and reads it again, so a lost executor costs a stage's tasks and not
the stages before it.

1. language      rejects documents in no language; lang becomes the language found
2. near_dedup    keeps one document (the smallest doc_id) of each group of near duplicates
3. decontaminate drops documents in which a benchmark window occurs
4. pii           replaces personal data by the name of its kind
5. pack          cuts the documents' tokens into full windows, one row for each piece

Stages 1 to 4 return the columns of documents, in their order, whatever others
there are.  An empty table gives an empty table at each stage; rows that repeat
are kept or dropped together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, langid, near_dedup, packing, pii
from ledgerloom.llm.cluster import table, written

SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, each with the language found as lang; documents in no language (null, empty or without letters) go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (5-word shingles, 0.8): the one of the smallest doc_id, once for each of its rows; documents without words or doc_id stay."""
    return near_dedup.keep_one(docs, SHINGLE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; with an empty benchmark, all."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in angle brackets; n_chars follows the text, a null text stays null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the documents' tokens in sequences of at most 4096; a null text is its end token alone."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark),
    ("pii", personal_data),
    ("pack", pack),
]

#: No SQL expresses the stages: tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
