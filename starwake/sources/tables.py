"""Writing tables: events, metadata, history, daily counts, and outside systems."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from starwake.operators.clean import metadata_to_history, normalise_event_defaults, with_repo_key
from starwake.operators.rollups import compact_history, newest_per_key
from starwake.functions.text import repo_key
from starwake.sources.files import child_names, delete_directory, read_text, write_text

SNAPSHOT_KEY = ["repo_full_name", "snapshot_source", "snapshot_at", "snapshot_key"]


# --------------------------------------------------------------------------- the metadata table

#: Buckets of a metadata table, by the hash of the repository's key.
BUCKETS = 64
#: Versions whose files are kept for readers that have begun; older ones are deleted.
KEPT_VERSIONS = 2
_MANIFESTS = "_manifest"


def _bucket() -> Column:
    return F.pmod(F.xxhash64(repo_key(F.col("repo_full_name"))), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, base: str) -> list[str]:
    """Names of the manifests, oldest first."""
    return sorted(name for name in child_names(spark, f"{base}/{_MANIFESTS}") if name.isdigit())


def _folders(spark: SparkSession, base: str, version: str) -> dict[int, str]:
    """Of each bucket, the folder that a version reads."""
    lines = read_text(spark, f"{base}/{_MANIFESTS}/{version}").splitlines()
    return {int(bucket): folder for bucket, folder in (line.split(" ", 1) for line in lines)}


def read_current(spark: SparkSession, base: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The current version, or some buckets of it; None if there is nothing."""
    versions = _versions(spark, base)
    if not versions:
        return None
    folders = _folders(spark, base, versions[-1])
    paths = [f"{base}/{folder}" for bucket, folder in folders.items() if buckets is None or bucket in buckets]
    return spark.read.parquet(*paths) if paths else None


def _replace_buckets(rows: DataFrame, base: str, whole: bool) -> str:
    """Write buckets beside the current ones and swap the manifest; returns the new version's name.

    Buckets that ``rows`` does not touch keep their files, or go if ``rows`` is the ``whole`` table. The
    manifest is created last and only if it is not there yet, so a reader sees a version or the one
    before it, and two writers cannot both win. Folders that no kept version reads are deleted.
    """
    spark = rows.sparkSession
    versions = _versions(spark, base)
    folders = _folders(spark, base, versions[-1]) if versions else {}
    data = f"data/{uuid.uuid4().hex}"
    bucketed = rows.withColumn("_bucket", _bucket()).repartition("_bucket")
    bucketed.write.partitionBy("_bucket").parquet(f"{base}/{data}")
    written = {
        int(name.removeprefix("_bucket=")): f"{data}/{name}"
        for name in child_names(spark, f"{base}/{data}")
        if name.startswith("_bucket=")
    }
    merged = written if whole else folders | written
    version = f"{int(versions[-1]) + 1 if versions else 1:010d}"
    lines = "\n".join(f"{bucket} {folder}" for bucket, folder in sorted(merged.items()))
    write_text(spark, f"{base}/{_MANIFESTS}/{version}", lines, replace=False)
    _drop_old(spark, base, [*versions, version])
    return version


def _drop_old(spark: SparkSession, base: str, versions: list[str]) -> None:
    kept = versions[-KEPT_VERSIONS:]
    needed = {folder for version in kept for folder in _folders(spark, base, version).values()}
    for version in versions[:-KEPT_VERSIONS]:
        for folder in set(_folders(spark, base, version).values()) - needed:
            delete_directory(spark, f"{base}/{folder}")
        delete_directory(spark, f"{base}/{_MANIFESTS}/{version}")


def write_next(df: DataFrame, base: str) -> str:
    """Replace the whole table by a new version; readers switch when it is complete."""
    return _replace_buckets(df, base, whole=True)


# --------------------------------------------------------------------------- events


def save_event_batch(events: DataFrame, path: str) -> None:
    """Append to the events table. A failed task is tried again by Spark, not by this code."""
    rows = with_repo_key(normalise_event_defaults(events))
    rows = rows.withColumn("event_month", F.date_format("created_at", "yyyyMM"))
    arranged = rows.repartitionByRange("event_month", "repo_id", "created_at")
    arranged.write.mode("append").partitionBy("event_month").parquet(path)


def write_star_counts(counts: DataFrame, path: str) -> int:
    """Replace the dates that are in ``counts``: running a day again does not count it twice.

    Returns the rows written, counted behind the shuffle: finding the ranges reads them once more.
    """
    seen = Observation()
    (
        counts.repartitionByRange("event_date", "repo_name")
        .observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )
    return seen.get["rows"]


def write_daily(rows: DataFrame, path: str) -> None:
    """Replace the dates that are in ``rows``, which has a row or few per ``event_date``."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


# --------------------------------------------------------------------------- metadata


def merge_metadata(current: DataFrame | None, fresh: DataFrame) -> DataFrame:
    rows = fresh if current is None else current.unionByName(fresh)
    order = ["refreshed_at", "fetched_at", "stargazers_count", "repo_full_name"]
    return newest_per_key(rows, [repo_key(F.col("repo_full_name"))], order)


def upsert_repo_metadata(fresh: DataFrame, base: str) -> DataFrame:
    """Add or replace repositories by name; the newest refresh wins.

    Only the buckets that ``fresh`` touches are read, merged and written. The driver gets their
    numbers.
    """
    spark = fresh.sparkSession
    touched = [row["_bucket"] for row in fresh.select(_bucket().alias("_bucket")).distinct().collect()]
    if touched:
        _replace_buckets(merge_metadata(read_current(spark, base, touched), fresh), base, whole=False)
    current = read_current(spark, base)
    return fresh.limit(0) if current is None else current


def append_repo_history(metadata: DataFrame, path: str, source: str) -> DataFrame:
    """Append snapshots; a replay of the same snapshot is seen once on reading."""
    metadata_to_history(metadata, source).write.mode("append").parquet(path)
    return read_history(metadata.sparkSession, path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return compact_history(spark.read.parquet(path))


# --------------------------------------------------------------------------- outside systems


def jdbc_append(
    df: DataFrame, url: str, table: str, writers: int = 4, batch_size: int = 10_000, **options: str
) -> None:
    """Append over JDBC with a bounded number of connections. The driver jar comes from outside.

    Rows are dealt to the writers by a shuffle, so that the work before it keeps all its tasks.
    """
    (
        df.repartition(writers)
        .write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_size), **options)
        .mode("append")
        .save()
    )


def kafka_options(servers: str, topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.compression.type": "gzip",
    }


def kafka_append(records: DataFrame, servers: str, topic: str) -> None:
    """Publish (key, value) records. Needs the Kafka connector on the class path."""
    records.write.format("kafka").options(**kafka_options(servers, topic)).save()


# --------------------------------------------------------------------------- catalogue


def write_catalog_snapshot(
    repos: DataFrame, shards: DataFrame, base: str, taken_at: str
) -> str:
    """One snapshot folder with the ranked repositories and the shards, as JSON lines."""
    target = f"{base}/snapshot_at={taken_at}"
    repos.write.mode("overwrite").json(f"{target}/repos")
    shards.write.mode("overwrite").json(f"{target}/shards")
    return target


def latest_snapshot(spark: SparkSession, base: str) -> str | None:
    names = [name for name in child_names(spark, base) if name.startswith("snapshot_at=")]
    return f"{base}/{names[-1]}" if names else None
