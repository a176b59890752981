"""A training corpus from raw documents, in five stages.

language ID -> exact dedup -> n-gram Jaccard join -> benchmark decontamination -> mixing.

Each stage takes all that the one before kept and returns the columns of documents; the
last adds each document's copies in the mix. Between stages the documents are a
Parquet table in the shared folder.

Defined results: an empty table passes through. A null text has no letter, so language ID
rejects it. Nulls in other columns, repeated rows and extra columns are carried through, but
of equal texts one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagline.llm import decontaminate, exact_dedup, language_id, mixing, ngram_join
from lagline.llm._store import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, judged among the languages that the corpus's own labels teach; one in another language is nearly always kept."""
    return language_id.drop_unidentified(docs, language_id.train(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their five-word shingles, the one with the smallest id."""
    return ngram_join.drop_near_duplicates(docs, n=5, num=80, den=100)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.remove(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, whole=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their copies (1 to 3)."""
    return mixing.apply(docs)


STAGES = [
    ("language ID", identify),
    ("exact dedup", dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", clean),
    ("mixing sources to target weights", mix),
]

#: The last stage draws at random, which SQL can't repeat; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
