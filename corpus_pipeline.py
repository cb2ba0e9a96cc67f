"""A training-data pipeline: five of the corpus operators in a row, over the table of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starwake.llm import decontaminate, jaccard, mixing, token_files, toxicity
from starwake.llm.tables import table, vocabulary
from starwake.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on the labels of these documents takes for toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingle sets, the smallest id stays."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder, and what they hold of each document."""
    digest = token_files.token_digest(docs, vocabulary("word_bpe_49k.json"))
    return digest.select("doc_id", "nth", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("similar documents", drop_similar),
    ("benchmark leaks", drop_leaks),
    ("source mix", mix),
    ("token files", write_tokens),
]

#: A classifier and a tokenizer are not to be had in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
