"""Small helpers around the Hadoop file system: existence, listing, deleting, small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    location = jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    fs, location = _fs(spark, path)
    return fs.exists(location)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a directory, sorted; empty when it does not exist."""
    fs, location = _fs(spark, path)
    if not fs.exists(location):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(location))


def delete_directory(spark: SparkSession, path: str) -> bool:
    fs, location = _fs(spark, path)
    return fs.delete(location, True)


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small file, written whole; one that is there is replaced, or an error."""
    fs, location = _fs(spark, path)
    stream = fs.create(location, replace)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, location = _fs(spark, path)
    stream = fs.open(location)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def content_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and bytes of all files below a directory."""
    fs, location = _fs(spark, path)
    summary = fs.getContentSummary(location)
    return summary.getFileCount(), summary.getLength()


def file_listing(spark: SparkSession, base: str, pattern: str = "*.parquet") -> DataFrame:
    """Path and size of all files below ``base``. Contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(base)
        .select(F.col("path"), F.col("length").alias("bytes"))
    )
