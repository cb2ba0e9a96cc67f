"""Cutting lineage in loops."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

from starwake.session import fresh_path
from starwake.sources.files import delete_directory

#: Bits of a Bloom filter for each key; about 1 of 50 other rows gets through.
BLOOM_BITS = 8


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written below the shared folder and read again.

    In a loop this is better than a checkpoint: a checkpoint keeps the estimated size of the plan
    behind it, and estimates of joins of joins grow with every round, while a file's size is known.
    """
    path = fresh_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

class Scratch:
    """Tables stored for the length of a block. At its end all go but those that are kept."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *raised: object) -> None:
        for path in self.paths:
            delete_directory(self.spark, path)

    def kept(self, df: DataFrame) -> DataFrame:
        """The same rows, stored for good: they are part of a result that is read later."""
        return stored(df)

    def stored(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, "stored")
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for jobs that run inside the block; the session's own come back after it."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "8m") -> AbstractContextManager[None]:
    """Within the block, Python tasks get fewer rows and bytes at once, for rows that hold whole texts
    or sets."""
    arrow = "spark.sql.execution.arrow"
    return settings(spark, {f"{arrow}.maxRecordsPerBatch": str(rows), f"{arrow}.maxBytesPerBatch": size})


def filtered_joins(spark: SparkSession, keys: int) -> AbstractContextManager[None]:
    """Within the block, Spark filters the large side of a shuffled join by a Bloom filter of the keys of
    the small side, before it shuffles it, whatever the sizes of both. The small side needs a condition
    for this. The filter has at most 8 MB: more keys than it holds well only let more rows through.
    """
    bloom = "spark.sql.optimizer.runtime.bloomFilter"
    items = max(1_000, keys)
    values = {
        "enabled": "true",
        "applicationSideScanSizeThreshold": "0",
        "creationSideThreshold": "100g",
        "expectedNumItems": str(items),
        "maxNumItems": str(items),
        "numBits": str(BLOOM_BITS * items),
        "maxNumBits": str(8 << 23),
    }
    return settings(spark, {f"{bloom}.{name}": value for name, value in values.items()})
