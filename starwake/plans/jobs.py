"""Scheduled jobs: nightly tables, backfill, bootstrap, retention, compaction, refresh."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from starwake.functions import text as tx
from starwake.functions.times import Moment, day
from starwake.operators import panels
from starwake.operators import rollups as ru
from starwake.operators.catalog import repo_summary_report
from starwake.operators.clean import (
    event_to_history,
    map_repo_metadata,
    normalise_event_defaults,
    with_repo_key,
)
from starwake.schemas import METADATA_COLUMNS
from starwake.session import fresh_path
from starwake.sources import archive as ar
from starwake.sources import tables
from starwake.sources.files import delete_directory, exists, file_listing
from starwake.sources.repo_files import good_files, read_repo_json

RETENTION_DAYS = 90
SAFETY_DAYS = 2


class JobError(ValueError):
    """A job was asked for something it must not or cannot do."""


# --------------------------------------------------------------------------- nightly


def nightly_batch(
    spark: SparkSession,
    archive_path: str,
    out: str,
    as_of: Moment,
    on: date | str,
    lookback_days: int = 7,
) -> dict[str, int] | None:
    """Daily star counts, sketches of the repositories, and the activity summary from the last days
    of the archive.

    Skipped when the day before ``on`` has no partition yet. Row counts are observed while
    writing, so nothing is computed twice; running it again replaces what it wrote.
    """
    yesterday = F.date_sub(day(on), 1)
    recent = ar.read_archive_range(spark, archive_path, on, lookback_days)
    if recent.where(F.col("event_date") == yesterday).isEmpty():
        return None
    stars = tables.write_star_counts(ru.daily_star_counts(recent), f"{out}/repo_star_counts")
    seen = Observation()
    summary = ru.activity_summary(recent, as_of).observe(seen, F.count(F.lit(1)).alias("rows"))
    summary.write.mode("overwrite").parquet(f"{out}/repo_activity_summary")
    tables.write_daily(panels.repo_sketches(recent), f"{out}/repo_sketches")
    return {"star_counts": stars, "activity": seen.get["rows"]}


# --------------------------------------------------------------------------- backfill


@dataclass(frozen=True)
class Backfill:
    inserted_rows: int
    start_date: str | None
    end_date: str | None


def backfill_events(
    spark: SparkSession,
    archive_path: str,
    table: str,
    start: str | None = None,
    end: str | None = None,
    force: bool = False,
) -> Backfill:
    """Load the events table from the archive. A filled table is only replaced by ``force``.

    The range of dates goes to the listing: other days are neither listed nor opened, and the rows
    are read once.
    """
    if start is not None and end is not None and start > end:
        raise JobError("the start date must not be after the end date")
    if not ar.has_partitions(spark, archive_path):
        raise JobError(f"no partitions below {archive_path}")
    if exists(spark, table) and not force and not spark.read.parquet(table).isEmpty():
        raise JobError("the events table already has rows; force replaces them")
    if not ar.days_between(spark, archive_path, start, end):
        raise JobError("no partition lies in the given range of dates")
    rows = ar.read_archive_evolved(spark, archive_path, start, end)
    seen = Observation()
    month = F.date_format("created_at", "yyyyMM")
    sorting = ["event_month", "repo_id", "created_at"]
    normal = with_repo_key(normalise_event_defaults(rows)).withColumn("event_month", month)
    arranged = normal.repartitionByRange(*sorting).sortWithinPartitions(*sorting)
    (
        arranged.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .partitionBy("event_month")
        .parquet(table)
    )
    return Backfill(seen.get["rows"], start, end)


# --------------------------------------------------------------------------- bootstrap


def bootstrap_observations(
    events: DataFrame, metadata_base: str, history_path: str
) -> dict[str, bool]:
    """First metadata and history from events, each only where there is none yet."""
    spark = events.sparkSession
    done = {"metadata": False, "history": False}
    if events.isEmpty():
        return done
    current = tables.read_current(spark, metadata_base)
    if current is None or current.isEmpty():
        tables.write_next(ru.metadata_from_events(events), metadata_base)
        done["metadata"] = True
    if not exists(spark, history_path) or spark.read.parquet(history_path).isEmpty():
        event_to_history(events).write.mode("overwrite").parquet(history_path)
        done["history"] = True
    return done


# --------------------------------------------------------------------------- retention


def retention_plan(
    spark: SparkSession,
    archive_path: str,
    as_of: Moment,
    keep_days: int = RETENTION_DAYS,
    pattern: str = "*.parquet",
) -> DataFrame:
    """What to do with every date directory: keep, drop, or skip for an unreadable name.

    The listing is a distributed scan of paths and sizes only, added up per directory; the last two
    days are never dropped.
    """
    text = F.regexp_extract("path", "/event_date=([^/]*)/", 1)
    valid = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    event_date = F.when(valid, text.try_cast("date"))
    cutoff, safe = F.date_sub(day(as_of), keep_days), F.date_sub(day(as_of), SAFETY_DAYS)
    action = (
        F.when(F.col("date").isNull(), "skip")
        .when((F.col("date") < cutoff) & (F.col("date") < safe), "drop")
        .otherwise("keep")
    )
    return (
        file_listing(spark, archive_path, pattern)
        .withColumns({"partition": text, "date": event_date})
        .where(F.col("partition") != "")
        .groupBy("partition", "date")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
        .withColumn("action", action)
        .select("partition", "files", "bytes", "action")
    )


def apply_retention(spark: SparkSession, archive_path: str, plan: DataFrame) -> int:
    """Delete the directories marked to drop; their number is that of the archive's days."""
    names = [row["partition"] for row in plan.where("action = 'drop'").collect()]
    for name in names:
        delete_directory(spark, f"{archive_path}/event_date={name}")
    return len(names)


# --------------------------------------------------------------------------- compaction


def compact_latest(
    metadata: DataFrame, history: DataFrame, star_counts: DataFrame, summary: DataFrame
) -> dict[str, DataFrame]:
    """The four tables as readers see them, ready to be written back."""
    return {
        "repo_metadata": ru.latest_full_metadata(metadata),
        "repo_metadata_history": ru.compact_history(history),
        "repo_star_counts": ru.compact_star_counts(star_counts),
        "repo_activity_summary": ru.compact_activity(summary),
    }


def compaction_report(tables_by_name: dict[str, DataFrame]) -> DataFrame:
    report = None
    for name, table in tables_by_name.items():
        row = table.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        report = row if report is None else report.unionByName(row)
    return report


# --------------------------------------------------------------------------- metadata refresh


def metadata_refresh(
    spark: SparkSession, repo_files: str, metadata_base: str, history_path: str, as_of: Moment
) -> DataFrame:
    """Landed files to metadata, history and the ranked summary; bad files are left out.

    Files are parsed once and stored. Of several files for one repository the newest counts. One
    that was fetched before keeps its first ``fetched_at`` when its file has none.
    """
    files = good_files(read_repo_json(spark, repo_files))
    landed = map_repo_metadata(files, as_of, fetched_flag="_fetched")
    order = ["refreshed_at", "fetched_at", "stargazers_count", "repo_full_name"]
    fresh = ru.newest_per_key(landed, [tx.repo_key(F.col("repo_full_name"))], order)
    previous = tables.read_current(spark, metadata_base)
    if previous is not None:
        first = previous.select(
            tx.repo_key(F.col("repo_full_name")).alias("_key"), F.col("fetched_at").alias("_first")
        )
        fresh = fresh.join(first, tx.repo_key(F.col("repo_full_name")) == F.col("_key"), "left").withColumn(
            "fetched_at",
            F.when(F.col("_fetched"), F.col("fetched_at")).otherwise(F.coalesce("_first", "fetched_at")),
        )
    staged = fresh_path(spark, "refresh")
    fresh.select(*METADATA_COLUMNS).write.parquet(staged)
    stored = spark.read.parquet(staged)
    current = tables.upsert_repo_metadata(stored, metadata_base)
    tables.append_repo_history(stored, history_path, "sync_repo_metadata")
    delete_directory(spark, staged)
    return repo_summary_report(current)
