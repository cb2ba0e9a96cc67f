"""Tables that streams write: segments below date folders, merged in tiers.

``<table>/event_date=<day>/batch=<segment>/…`` holds what one micro-batch has of a day. When a day has
``FAN`` segments of one tier, they are merged into one of the next, so a day of n batches has few more
than ``FAN`` times the logarithm of n, and each row is rewritten as many times as there are tiers.

A merged segment counts once its marker ``_<segment>`` lies beside it; the marker names the segments
that it covers. Covered ones are skipped from then on and deleted by the next merge of the day, so a
reader that has listed them can finish. Tables without dates have their segments in one folder.
Everything goes through the Hadoop file system.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwake.sources.files import child_names, delete_directory, exists, read_text, write_text

FAN = 32
#: A file of this name marks a table whose rows lie in segments.
SEGMENTED = "_segments"
_DAY, _SEGMENT = "event_date=", "batch="


def write_segment(rows: DataFrame, table: str, own: str, dated: bool = True, inner: Iterable[str] = ()) -> None:
    """Write the segment ``own``. Writing it again replaces it.

    ``rows`` of a dated table have ``event_date``; ``inner`` are further directories.
    """
    spark = rows.sparkSession
    if not exists(spark, f"{table}/{SEGMENTED}"):
        write_text(spark, f"{table}/{SEGMENTED}", "")
    directories = [*(["event_date"] if dated else []), "batch", *inner]
    (
        rows.withColumn("batch", F.lit(own))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*directories)
        .parquet(table)
    )


def day_folders(spark: SparkSession, table: str) -> list[str]:
    """Names of the date folders; one listing."""
    return [name for name in child_names(spark, table) if name.startswith(_DAY)]


def _covered(spark: SparkSession, folder: str, names: list[str]) -> dict[str, list[str]]:
    """Of each merged segment with a marker, the segments it covers."""
    return {
        name[1:]: read_text(spark, f"{folder}/{name}").split()
        for name in names
        if name.startswith("_c") and "-" in name
    }


def _tier(segment: str) -> int:
    """0 for a micro-batch; merged segments are named ``c<tier>-<unique>``."""
    head = segment.split("-", 1)[0]
    return int(head[1:]) if head[:1] == "c" and head[1:].isdigit() else 0


def live_segments(spark: SparkSession, folder: str) -> list[str]:
    """Segments of one folder that are complete and not covered; one listing and the markers."""
    names = child_names(spark, folder)
    covers = _covered(spark, folder, names)
    gone = {one for names_of in covers.values() for one in names_of}
    every = [name.removeprefix(_SEGMENT) for name in names if name.startswith(_SEGMENT)]
    return [one for one in every if one not in gone and (_tier(one) == 0 or one in covers)]


def segment_paths(spark: SparkSession, table: str, days: Iterable[str] | None = None) -> list[str]:
    """Paths of the live segments of the given days, or of all; other days are not listed."""
    if days is None:
        names = child_names(spark, table)
        folders = [f"{table}/{name}" for name in names if name.startswith(_DAY)]
        if any(name.startswith(_SEGMENT) for name in names):
            folders.append(table)
    else:
        folders = [f"{table}/{_DAY}{day}" for day in days]
    return [
        f"{folder}/{_SEGMENT}{segment}" for folder in folders for segment in live_segments(spark, folder)
    ]


def read_segments(
    spark: SparkSession, table: str, days: Iterable[str] | None = None, schema: T.StructType | None = None
) -> DataFrame | None:
    """Rows of the live segments, with their directories as columns; None if there are none."""
    paths = segment_paths(spark, table, days)
    if not paths:
        return None
    reader = spark.read.option("basePath", table)
    return (reader if schema is None else reader.schema(schema)).parquet(*paths)


def _merge(
    spark: SparkSession,
    folder: str,
    segments: list[str],
    inner: Iterable[str],
    sorting: Iterable[str],
) -> str:
    """One segment in place of some; its marker comes last."""
    merged = f"c{1 + max(map(_tier, segments))}-{uuid.uuid4().hex}"
    old = spark.read.option("basePath", folder).parquet(*[f"{folder}/{_SEGMENT}{one}" for one in segments])
    rows, keys = old.drop("batch"), [*inner, *sorting]
    if keys:
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows.write.mode("overwrite").partitionBy(*inner).parquet(f"{folder}/{_SEGMENT}{merged}")
    write_text(spark, f"{folder}/_{merged}", "\n".join(segments))
    return merged


def drop_covered(spark: SparkSession, folder: str) -> None:
    """Delete the segments that earlier merges have covered, and markers of covered merges."""
    names = child_names(spark, folder)
    covers = _covered(spark, folder, names)
    for one in (one for members in covers.values() for one in members):
        if f"{_SEGMENT}{one}" in names:
            delete_directory(spark, f"{folder}/{_SEGMENT}{one}")
        if one in covers:
            delete_directory(spark, f"{folder}/_{one}")


def merge_segments(
    spark: SparkSession,
    folder: str,
    fan: int = FAN,
    inner: Iterable[str] = (),
    sorting: Iterable[str] = (),
    but: Iterable[str] = (),
) -> list[str]:
    """Merge the segments of each tier of which a folder has ``fan``; returns the new names.

    ``but`` are segments whose batch is not committed yet: it may be written again.
    """
    tiers: dict[int, list[str]] = defaultdict(list)
    for segment in live_segments(spark, folder):
        if segment not in set(but):
            tiers[_tier(segment)].append(segment)
    full = [members for _, members in sorted(tiers.items()) if len(members) >= fan]
    if full:
        drop_covered(spark, folder)
    return [_merge(spark, folder, members, inner, sorting) for members in full]


def close_days(
    spark: SparkSession, table: str, before: str, inner: Iterable[str] = (), sorting: Iterable[str] = ()
) -> list[str]:
    """Merge each day before ``before`` (ISO date) that still has several segments into one; returns
    the names of their folders.

    For a job beside the stream, over days that batches hardly touch any more; a late row that comes
    after all is one more segment, merged the next time.
    """
    done = []
    for name in day_folders(spark, table):
        folder = f"{table}/{name}"
        if name.removeprefix(_DAY) < before:
            drop_covered(spark, folder)
            live = live_segments(spark, folder)
            if len(live) > 1:
                _merge(spark, folder, live, inner, sorting)
                done.append(name)
    return done
