"""From raw documents to a weighted mix: language, near copies, benchmark leaks, personal data, source weights.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritab.llm import decontam, language, mixing, neardup, pii
from veritab.llm.common import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that no learned language explains."""
    return language.keep_known(docs, learn_from=language.remainder(3) != 1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return neardup.dedupe(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that quote benchmark items."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of identifier in the place of each identifier; n_chars follows the text."""
    return pii.redact(docs)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of words it takes from each, repeats counted."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("personal data", without_personal_data),
    ("mix", weighted_mix),
]

# Cross-parsing, minhashes and transducers are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i + 1}")
    return docs
