"""The event archive: Parquet below ``event_date=…/event_type=…``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwake.functions import text as tx
from starwake.functions.times import day, parse_iso
from starwake.schemas import ARCHIVE_EVENT, ARCHIVE_LAYOUT
from starwake.sources.files import (
    child_names,
    content_size,
    delete_directory,
    exists,
    read_text,
    write_text,
)
from starwake.sources.segments import SEGMENTED, segment_paths

ARCHIVE = T.StructType(ARCHIVE_EVENT.fields + ARCHIVE_LAYOUT.fields)
SORTING = ["event_date", "event_type", "repo_id", "created_at"]
#: Days whose entries in the manifest are read, or made, at once.
NOTES_AT_ONCE = 8
_DAY = "event_date="


def has_partitions(spark: SparkSession, base: str) -> bool:
    return any(name.startswith(_DAY) for name in child_names(spark, base))


def days_between(spark: SparkSession, base: str, first: str | None, last: str | None) -> list[str]:
    """Days (ISO) that the archive has a folder for, within bounds that may be open; one listing."""
    days = [name.removeprefix(_DAY) for name in child_names(spark, base) if name.startswith(_DAY)]
    return [
        one for one in days if (first is None or first <= one) and (last is None or one <= last)
    ]


def _folders(spark: SparkSession, base: str, days: list[str]) -> tuple[list[str], list[str]]:
    """Paths of the given days: plain folders, and the live segments of a stream's archive."""
    if not exists(spark, f"{base}/{SEGMENTED}"):
        return [f"{base}/{_DAY}{one}" for one in days], []
    plain = [
        f"{base}/{_DAY}{one}/{name}"
        for one in days
        for name in child_names(spark, f"{base}/{_DAY}{one}")
        if name.startswith("event_type=")
    ]
    return plain, segment_paths(spark, base, days)


def _scans(spark: SparkSession, base: str, scans: list[tuple[T.StructType, list[str]]]) -> DataFrame:
    """One scan for each schema that has paths, united; ``created_at`` of all as timestamps."""
    whole = None
    for schema, paths in scans:
        if not paths:
            continue
        rows = spark.read.schema(schema).option("basePath", base).parquet(*paths)
        if schema["created_at"].dataType == T.StringType():
            rows = rows.withColumn("created_at", parse_iso(F.col("created_at")))
        rows = rows.select(*ARCHIVE.names)
        whole = rows if whole is None else whole.unionByName(rows)
    return spark.createDataFrame([], ARCHIVE) if whole is None else whole


def read_archive(
    spark: SparkSession, base: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """The days within bounds (ISO dates) that may be open; only their folders are listed. Filters on
    the two directory columns prune directories."""
    plain, segments = _folders(spark, base, days_between(spark, base, first, last))
    return _scans(spark, base, [(ARCHIVE, plain), (ARCHIVE, segments)])


def _iso(moment: date | str) -> str:
    return date.fromisoformat(str(moment)[:10]).isoformat()


def read_archive_range(
    spark: SparkSession, base: str, end: date | str, lookback_days: int
) -> DataFrame:
    """The ``lookback_days + 1`` dates up to ``end``; dates without files are simply absent."""
    last = date.fromisoformat(_iso(end))
    first = last - timedelta(days=lookback_days)
    rows = read_archive(spark, base, _iso(first), _iso(last))
    return rows.where(F.col("event_date").between(day(first), day(last)))


def read_archive_partition(
    spark: SparkSession, base: str, on: date | str, event_type: str | None = None
) -> DataFrame:
    rows = read_archive(spark, base, _iso(on), _iso(on)).where(F.col("event_date") == day(on))
    return rows if event_type is None else rows.where(F.col("event_type") == event_type)


def arranged(events: DataFrame) -> DataFrame:
    """Rows in archive order.

    Ranges are cut on the whole sort key, so a busy date, type or repository is spread over many
    files, and every file covers a narrow range of repositories and times for later skipping.
    """
    return events.repartitionByRange(*SORTING).sortWithinPartitions(*SORTING)


def in_archive_form(events: DataFrame) -> DataFrame:
    """The columns of the archive, null where an event lacks one."""
    have = set(events.columns)
    if "event_date" not in have:
        events = events.withColumn("event_date", F.to_date("created_at"))
    columns = [
        (F.col(field.name) if field.name in have else F.lit(None)).cast(field.dataType).alias(
            field.name
        )
        for field in ARCHIVE_EVENT
    ]
    return events.select(*columns, F.col("event_date").cast("date"), "event_type")


def append_archive(events: DataFrame, base: str) -> int:
    """Append events to their partitions; returns the number of rows written.

    A day that was not there before is noted in the schema manifest; the note on any other is taken
    back, so that its footers are looked at again.
    """
    spark, seen = events.sparkSession, Observation()
    before = set(child_names(spark, base))
    # Counted behind the shuffle: finding the ranges reads the rows once more before it.
    rows = arranged(in_archive_form(events)).observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.collect_set(F.col("event_date").cast("string")).alias("days"),
    )
    rows.write.mode("append").partitionBy("event_date", "event_type").parquet(base)
    for one in seen.get["days"] or []:
        if f"{_DAY}{one}" in before:
            delete_directory(spark, _note(base, one))
        else:
            _write_note(spark, base, one, [("time", ".")])
    return seen.get["rows"]


def append_archive_partition(
    events: DataFrame, base: str, on: date | str, event_type: str
) -> int:
    """Append records to one given partition. Nothing is written for no records."""
    if events.isEmpty():
        return 0
    placed = events.withColumns({"event_date": day(on), "event_type": F.lit(event_type)})
    return append_archive(placed, base)


# --------------------------------------------------------------------------- mixed schemas


def _note(base: str, on: str) -> str:
    """The manifest's entry for a day: number and bytes of its files, then kinds and paths."""
    return f"{base}/_kinds/{_DAY}{on}"


def _write_note(spark: SparkSession, base: str, on: str, kinds: list[tuple[str, str]]) -> None:
    size = " ".join(map(str, content_size(spark, f"{base}/{_DAY}{on}")))
    lines = [f"{kind} {path}" for kind, path in kinds]
    write_text(spark, _note(base, on), "\n".join([size, *lines]))


def _noted(spark: SparkSession, base: str, on: str) -> list[tuple[str, str]] | None:
    """What the manifest says of a day, unless files have come or gone since."""
    if not exists(spark, _note(base, on)):
        return None
    size, *lines = read_text(spark, _note(base, on)).split("\n")
    if size != " ".join(map(str, content_size(spark, f"{base}/{_DAY}{on}"))):
        return None
    return [(kind, path) for kind, path in (line.split(" ", 1) for line in lines)]


def _kind_below(spark: SparkSession, path: str) -> str:
    """Type of ``created_at`` in the files below a path; ``mixed`` if they differ."""
    try:
        schema = spark.read.option("mergeSchema", "true").parquet(path).schema
    except (PySparkException, Py4JJavaError) as error:
        if "MERGE_SCHEMA" not in str(error):
            raise
        return "mixed"
    if "created_at" not in schema.names:
        return "time"
    return "string" if schema["created_at"].dataType == T.StringType() else "time"


def _kinds_below(spark: SparkSession, folder: str, path: str = ".") -> list[tuple[str, str]]:
    """Kinds of a folder, or of its parts if they differ, down to single files."""
    here = folder if path == "." else f"{folder}/{path}"
    kind = _kind_below(spark, here)
    if kind != "mixed":
        return [(kind, path)]
    parts = [name for name in child_names(spark, here) if not name.startswith(("_", "."))]
    return [
        one
        for name in parts
        for one in _kinds_below(spark, folder, name if path == "." else f"{path}/{name}")
    ]


def time_kinds(spark: SparkSession, base: str, on: str) -> list[tuple[str, str]]:
    """Kind and path of a day's parts, from the manifest, which is completed where it lacks the day."""
    kinds = _noted(spark, base, on)
    if kinds is None:
        kinds = _kinds_below(spark, f"{base}/{_DAY}{on}")
        _write_note(spark, base, on, kinds)
    return kinds


def read_archive_evolved(
    spark: SparkSession, base: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """An archive whose files were written by different writers; bounds are ISO dates.

    Older files lack the ``repo_`` columns (they come out as NULL), and ``created_at`` may be text
    or a timestamp. Spark cannot merge the two types, so days are split by the type that the schema
    manifest has for them, read with a matching schema each, and united by name. Footers are opened
    only of days within the bounds that the manifest does not know. The driver holds one entry a day
    (more only for a day whose own files differ). Segments of a stream have timestamps.
    """
    days = days_between(spark, base, first, last)
    paths: dict[str, list[str]] = {"string": [], "time": []}
    segments: list[str] = []
    if exists(spark, f"{base}/{SEGMENTED}"):
        plain, segments = _folders(spark, base, days)
        found = [(folder, _kinds_below(spark, folder)) for folder in plain]
    else:
        with ThreadPoolExecutor(NOTES_AT_ONCE) as pool:
            kinds = list(pool.map(lambda one: time_kinds(spark, base, one), days))
        found = [(f"{base}/{_DAY}{one}", of) for one, of in zip(days, kinds, strict=True)]
    for folder, of in found:
        for kind, path in of:
            paths[kind].append(folder if path == "." else f"{folder}/{path}")
    texts = T.StructType(
        [
            T.StructField("created_at", T.StringType()) if field.name == "created_at" else field
            for field in ARCHIVE
        ]
    )
    return _scans(spark, base, [(texts, paths["string"]), (ARCHIVE, paths["time"]), (ARCHIVE, segments)])


def with_empty_defaults(archive: DataFrame) -> DataFrame:
    """NULL texts and lists of old files as empty ones."""
    texts = [
        "repo_primary_language",
        "repo_description",
        "repo_full_metadata_json",
        "repo_readme_text",
        "repo_issues_json",
    ]
    return archive.withColumns(
        {
            **{name: tx.text_or_empty(F.col(name)) for name in texts},
            "repo_topics": tx.list_or_empty(F.col("repo_topics")),
            "repo_stargazers_count": F.coalesce("repo_stargazers_count", F.lit(0)),
        }
    )
