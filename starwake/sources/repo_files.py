"""Landed repository files: JSON objects, one or several per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwake.functions.text import strip, text_or_empty
from starwake.functions.times import parse_iso
from starwake.schemas import REPO_FILE

#: Between two objects of a file: inside one, no brace is closed at the end of a line and the next
#: thing an opened one.
_NEXT_OBJECT = r"(?<=\})[ \t\r]*\n\s*(?=\{)"
TIMES = ["created_at", "updated_at", "pushed_at", "fetched_at", "refreshed_at"]


def read_repo_json(spark: SparkSession, path: str) -> DataFrame:
    """Every object once, with ``parse_error`` telling why it is unusable (NULL when it is fine).

    A file holds one object, over any number of lines, or several that start on lines of their own; it
    is read whole, so a crawler with many repositories lands some thousands in each file, not all in
    one. A file that is no object is one unusable row. Summary files lie in the same folder and are
    left out.
    """
    files = (
        spark.read.option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .withColumn("file_name", F.col("_metadata.file_name"))
        .where(~F.contains("file_name", F.lit("summary")))
        .select("file_name", F.explode(F.split("value", _NEXT_OBJECT)).alias("value"))
    )
    return parse_repo_files(files)


def parse_repo_files(files: DataFrame) -> DataFrame:
    """(``file_name``, ``value``) texts to repository fields and ``parse_error``."""
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    parsed = files.select(
        "file_name",
        F.startswith(strip(F.col("value")), F.lit("{")).alias("_object"),
        F.from_json("value", REPO_FILE, options).alias("repo"),
    ).select("file_name", "_object", "repo.*")
    bad_time = F.lit(False)
    for name in TIMES:
        given = text_or_empty(F.col(name)) != ""
        bad_time = bad_time | (given & parse_iso(F.col(name)).isNull())
    error = (
        F.when(~F.col("_object"), "not an object")
        .when(F.col("_corrupt").isNotNull(), "not JSON")
        .when(bad_time, "bad field")
    )
    return parsed.withColumn("parse_error", error).drop("_object", "_corrupt")


def good_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("parse_error").isNull())


def parse_report(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count_if(F.col("parse_error").isNull()).alias("parsed"),
        F.count_if(F.col("parse_error").isNotNull()).alias("skipped"),
    )
