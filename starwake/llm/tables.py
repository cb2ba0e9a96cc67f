"""Where the queries find their tables and vocabularies."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the same path holds on every executor."""
    return public_tokenizers.path(name)
