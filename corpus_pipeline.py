"""A corpus from documents to packed sequences, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again: documents that fail the quality rules go, then those
without a language, then all but one document of each group of near duplicates; personal data is masked, and the rest is packed.
All but the last stage return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumist.llm import language, private, quality, similar, tokens
from vellumist.llm.shared import fresh


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """2. Documents that the base rules or their language's perplexity bands reject go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """8. Documents without a letter, or whose best language stays below language.MIN_SCORE, go."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """3. One document, that of the smallest id, of each group of near duplicates stays."""
    return similar.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """4. Personal data in texts is replaced by its kind; n_chars follows the text."""
    from pyspark.sql import functions as F

    return private.mask_personal(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """9. Where each piece of each document lies in sequences of 4096 tokens."""
    return tokens.pack_documents(docs, tokens.vocabulary(tokens.WORD_VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packing),
]

#: Perplexity, language and tokens have no SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
