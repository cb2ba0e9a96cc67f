"""Operational panels: totals, volumes, freshness, table health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.functions.times import Moment, day, hours_before, in_date_window, in_window, moment
from starwake.operators import rollups as ru
from starwake.operators.ranking import top_k

#: Sketches of distinct repositories have 2^bits slots: a standard error of 1.6 %.
SKETCH_BITS = 12


def top_repo_days(archive: DataFrame, as_of: Moment, days: int = 7, limit: int = 20) -> DataFrame:
    """Days with the most stars, per repository and date; only the star partitions are read."""
    counts = (
        archive.where(ru.is_star() & in_date_window(F.col("event_date"), as_of, days))
        .groupBy("repo_name", "event_date")
        .agg(ru.count_rows().alias("star_count"))
    )
    return top_k(counts, [F.desc("star_count"), F.asc("repo_name"), F.asc("event_date")], limit)


def event_volume_by_type(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("event_type")
        .agg(ru.count_rows().alias("event_count"))
        .orderBy(F.desc("event_count"), "event_type")
    )


def event_volume_on(archive: DataFrame, on: str) -> DataFrame:
    return event_volume_by_type(archive.where(F.col("event_date") == day(on)))


def event_volume_recent(
    events: DataFrame, as_of: Moment, days: int = 7, limit: int = 8
) -> DataFrame:
    seen = events.where(in_window(F.col("created_at"), as_of, days))
    return event_volume_by_type(seen).limit(limit)


def hourly_activity(archive: DataFrame, repo_name: str | Column, on: str) -> DataFrame:
    """Events per hour of one day; hours without events have no row."""
    name = F.lit(repo_name) if isinstance(repo_name, str) else repo_name
    return (
        archive.where((F.col("event_date") == day(on)) & (F.col("repo_name") == name))
        .groupBy(F.hour("created_at").alias("hour"))
        .agg(ru.count_rows().alias("event_count"))
        .orderBy("hour")
    )


def unique_repos(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("repo_name").alias("unique_repos"))


def repo_sketches(events: DataFrame) -> DataFrame:
    """Per day, a mergeable sketch of the repositories with events: ``event_date``, ``repos``."""
    return events.groupBy(F.to_date("created_at").alias("event_date")).agg(
        F.hll_sketch_agg("repo_name", F.lit(SKETCH_BITS)).alias("repos")
    )


def unique_repos_approx(sketches: DataFrame, as_of: Moment | None = None, days: int | None = None) -> DataFrame:
    """Distinct repositories of any window of days, from the stored sketches alone.

    Without ``days`` all sketches are united. The standard error is about 1.04 / sqrt(2^bits).
    """
    rows = sketches if days is None else sketches.where(in_date_window(F.col("event_date"), as_of, days))
    united = F.hll_union_agg("repos")
    return rows.agg(F.coalesce(F.hll_sketch_estimate(united), F.lit(0)).alias("unique_repos"))


def top_starred_snapshot(events: DataFrame, limit: int = 20) -> DataFrame:
    """Greatest star number and most frequent texts per repository, in one pass over the events.

    Counts per (repository, language, description) combine on the map side. Their few rows are
    stacked as (repository, column, value), counted once more, and reduced to the most frequent value
    of each column, the smallest among equals.
    """
    columns = {"language": "repo_primary_language", "description": "repo_description"}
    versions = events.groupBy("repo_name", *columns.values()).agg(
        ru.count_rows().alias("_n"), F.max("repo_stargazers_count").alias("_stars")
    )
    stack = F.array(
        *[
            F.struct(F.lit(name).alias("_column"), F.col(column).alias("_value"))
            for name, column in columns.items()
        ]
    )
    counted = (
        versions.select("repo_name", "_n", "_stars", F.inline(stack))
        .groupBy("repo_name", "_column", "_value")
        .agg(F.sum("_n").alias("_n"), F.max("_stars").alias("_stars"))
    )
    known = F.col("_value").isNotNull()
    order = F.struct(-F.col("_n"), F.col("_value"))
    best = [
        F.min_by("_value", F.when(known & (F.col("_column") == name), order)).alias(name) for name in columns
    ]
    zero = F.lit(0).cast("bigint")
    rows = counted.groupBy("repo_name").agg(F.max("_stars").alias("stars"), *best)
    return top_k(rows, [F.desc("stars"), F.asc("repo_name")], limit).select(
        "repo_name",
        "stars",
        zero.alias("forks"),
        "language",
        F.lit("Other").alias("category"),
        "description",
    )


def data_freshness(
    events: DataFrame, as_of: Moment, api_limit: int = 300, alert_limit: int = 600
) -> DataFrame:
    """Age of the newest event and whether that is still acceptable."""
    newest = F.max("created_at")
    age = F.unix_timestamp(moment(as_of)) - F.col("latest_epoch")
    return (
        events.agg(newest.alias("latest_event_at"))
        .withColumn("latest_epoch", F.unix_timestamp("latest_event_at"))
        .withColumn("age_seconds", age)
        .select(
            "latest_event_at",
            "latest_epoch",
            "age_seconds",
            F.coalesce(F.col("age_seconds") > api_limit, F.lit(True)).alias("is_stale"),
            F.coalesce(F.col("age_seconds") > alert_limit, F.lit(True)).alias("alert"),
            F.when(F.col("age_seconds") <= api_limit, "healthy")
            .otherwise("degraded")
            .alias("status"),
        )
    )


def event_totals(events: DataFrame, as_of: Moment) -> DataFrame:
    last_day = (F.col("created_at") >= hours_before(as_of, 24)) & (
        F.col("created_at") < moment(as_of)
    )
    return events.agg(
        ru.count_rows().alias("total_events"), F.count_if(last_day).alias("events_last_24h")
    )


def events_per_hour(events: DataFrame, by_type: bool = True) -> DataFrame:
    keys = ["event_type"] if by_type else []
    return (
        events.groupBy(F.date_trunc("hour", "created_at").alias("hour_start"), *keys)
        .agg(ru.count_rows().alias("event_count"))
        .orderBy("hour_start", *keys)
    )


def daily_stars_all_repos(events: DataFrame) -> DataFrame:
    return (
        events.groupBy(F.to_date("created_at").alias("event_date"), "repo_name")
        .agg(ru.star_count().alias("stars"))
    )


def top_repos_by_activity(
    events: DataFrame, limit: int = 15, as_of: Moment | None = None, days: int | None = None
) -> DataFrame:
    seen = events
    if as_of is not None and days is not None:
        seen = events.where(in_window(F.col("created_at"), as_of, days))
    counts = seen.groupBy("repo_name").agg(ru.count_rows().alias("event_count"))
    return top_k(counts, [F.desc("event_count"), F.asc("repo_name")], limit)


def language_repo_counts(events: DataFrame, limit: int = 15) -> DataFrame:
    counts = (
        events.where("repo_primary_language <> ''")
        .groupBy(F.col("repo_primary_language").alias("language"))
        .agg(F.count_distinct("repo_name").alias("repo_count"))
    )
    return top_k(counts, [F.desc("repo_count"), F.asc("language")], limit)


def category_repo_counts(events: DataFrame) -> DataFrame:
    return events.agg(
        F.lit("Other").alias("category"), F.count_distinct("repo_name").alias("repo_count")
    )


def table_health(tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row per table with its row count; a missing table is degraded."""
    session = next(table.sparkSession for table in tables.values() if table is not None)
    report = None
    for name, table in tables.items():
        if table is None:
            row = session.range(1).select(
                F.lit(name).alias("check"),
                F.lit(None).cast("bigint").alias("row_count"),
                F.lit("degraded").alias("status"),
            )
        else:
            row = table.agg(
                F.lit(name).alias("check"),
                ru.count_rows().alias("row_count"),
                F.lit("ok").alias("status"),
            )
        report = row if report is None else report.unionByName(row)
    return report


def partition_health(archive: DataFrame, as_of: Moment) -> DataFrame:
    """The newest date of the archive has to be today or yesterday."""
    latest = F.max("event_date")
    recent = (latest == day(as_of)) | (latest == F.date_sub(day(as_of), 1))
    return archive.agg(
        latest.alias("latest_date"),
        F.when(recent, "ok").otherwise("degraded").alias("status"),
    )
