"""Aggregations per repository.

All of them combine on the map side before the shuffle, so one very busy repository costs one
small row per map task. Distinct counts are grouped on (repository, value) first, which spreads a
busy repository over all reducers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.functions import text as tx
from starwake.functions.times import (
    Moment,
    in_date_window,
    in_previous_window,
    in_window,
    moment,
    twice,
)
from starwake.operators.clean import snapshot_columns
from starwake.schemas import METADATA_COLUMNS, REPO_ROW
from starwake.vocab import STAR_EVENT



def is_star() -> Column:
    return F.col("event_type") == STAR_EVENT


def keyed(events: DataFrame) -> DataFrame:
    """Make sure the case-insensitive join key is there."""
    if "repo_key" in events.columns:
        return events
    return events.withColumn("repo_key", tx.repo_key(F.col("repo_name")))


def star_count() -> Column:
    return F.count_if(is_star())


def count_rows() -> Column:
    return F.count(F.lit(1))


# --------------------------------------------------------------------------- windows


def window_star_metrics(events: DataFrame, as_of: Moment, days: int) -> DataFrame:
    return (
        keyed(events)
        .where(in_window(F.col("created_at"), as_of, days))
        .groupBy("repo_key")
        .agg(
            star_count().alias("star_count_in_window"),
            F.max("created_at").alias("latest_event_at"),
        )
    )


def market_repo_metrics(events: DataFrame, as_of: Moment, days: int) -> DataFrame:
    """Stars, events and distinct actors of the window."""
    return (
        keyed(events)
        .where(in_window(F.col("created_at"), as_of, days))
        .groupBy("repo_key")
        .agg(
            star_count().alias("star_count_in_window"),
            count_rows().alias("total_events_in_window"),
            F.count_distinct("actor_login").alias("unique_actors_in_window"),
            F.max("created_at").alias("latest_event_at"),
        )
    )


def mover_metrics(events: DataFrame, as_of: Moment, days: int) -> DataFrame:
    """This window against the one before it, for repositories with stars in this one."""
    seen = F.col("created_at")
    current, previous = in_window(seen, as_of, days), in_previous_window(seen, as_of, days)
    return (
        keyed(events)
        .where(in_window(seen, as_of, twice(days)))
        .groupBy("repo_key")
        .agg(
            F.count_if(is_star() & current).alias("current_star_count"),
            F.count_if(is_star() & previous).alias("previous_star_count"),
            F.count_distinct(F.when(current, F.col("actor_login"))).alias(
                "unique_actors_in_window"
            ),
            F.max(seen).alias("latest_event_at"),
        )
        .where("current_star_count > 0")
    )


# --------------------------------------------------------------------------- nightly tables


def daily_star_counts(events: DataFrame) -> DataFrame:
    """Stars per repository and day."""
    return (
        events.where(is_star())
        .groupBy(F.to_date("created_at").alias("event_date"), "repo_name")
        .agg(count_rows().alias("star_count"))
    )


def star_counts_backfill(events: DataFrame) -> DataFrame:
    """The same over all history, written as a conditional count with a threshold."""
    return (
        events.groupBy(F.to_date("created_at").alias("event_date"), "repo_name")
        .agg(star_count().alias("star_count"))
        .where("star_count > 0")
    )


def activity_summary(events: DataFrame, as_of: Moment) -> DataFrame:
    return (
        events.groupBy("repo_name", "event_type")
        .agg(
            count_rows().alias("event_count"),
            F.count_distinct("actor_id").alias("unique_actors"),
            F.min("created_at").alias("first_seen_at"),
            F.max("created_at").alias("last_seen_at"),
        )
        .withColumn("computed_at", moment(as_of))
    )


def sum_star_counts(star_counts: DataFrame, as_of: Moment, days: int) -> DataFrame:
    """Stars per repository over the stored daily counts."""
    return (
        star_counts.where(in_date_window(F.col("event_date"), as_of, days))
        .groupBy(tx.repo_key(F.col("repo_name")).alias("repo_key"))
        .agg(F.sum("star_count").alias("star_count_in_window"))
    )


def compact_star_counts(star_counts: DataFrame) -> DataFrame:
    """Rows with the same day and repository are added up."""
    return star_counts.groupBy("event_date", "repo_name").agg(
        F.sum("star_count").alias("star_count")
    )


# --------------------------------------------------------------------------- newest rows


def newest_per_key(rows: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate: no sort of a whole group."""
    columns = rows.columns
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    names = [f"_key{i}" for i in range(len(keys))]
    return (
        rows.groupBy(*[key.alias(name) for key, name in zip(keys, names, strict=True)])
        .agg(newest.alias("_row"))
        .select("_row.*")
    )


def latest_metadata(metadata: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Newest version of every repository, with its join key.

    ``columns`` keeps the aggregate (and the scan) to what the caller needs.
    """
    names = columns or REPO_ROW
    row = F.struct(*names)
    order = F.struct("refreshed_at", "fetched_at", "stargazers_count", "repo_full_name")
    return (
        metadata.groupBy(tx.repo_key(F.col("repo_full_name")).alias("repo_key"))
        .agg(F.max_by(row, order).alias("_row"))
        .select("repo_key", "_row.*")
    )


def latest_full_metadata(metadata: DataFrame) -> DataFrame:
    return latest_metadata(metadata, METADATA_COLUMNS).drop("repo_key")


def compact_history(history: DataFrame) -> DataFrame:
    """One row per repository, source, time and key."""
    keys = ["repo_full_name", "snapshot_source", "snapshot_at", "snapshot_key"]
    return history.dropDuplicates(keys)


def compact_activity(summary: DataFrame) -> DataFrame:
    return newest_per_key(
        summary, [F.col("repo_name"), F.col("event_type")], ["computed_at", "event_count"]
    )


def has_categorised_metadata(metadata: DataFrame) -> DataFrame:
    """One row that tells whether any repository has a real category."""
    latest = latest_metadata(metadata, ["category"])
    return latest.agg((F.count_if(F.col("category") != "Other") > 0).alias("has_categorised"))


# --------------------------------------------------------------------------- repositories from events


def repo_rollup_raw(
    events: DataFrame,
    as_of: Moment,
    window: Column | None = None,
    highest_stars: bool = True,
    first_seen: bool = True,
) -> DataFrame:
    """Repository rows made from events alone.

    ``window`` says which events count for the stars of the window (default: all given). The
    newest event supplies texts and topics; ``highest_stars`` takes the greatest star number ever
    seen instead of the newest one.
    """
    newest = F.struct("created_at", "event_id")
    attributes = F.struct(
        "repo_id",
        tx.text_or_empty(F.col("repo_description")).alias("description"),
        tx.text_or_empty(F.col("repo_primary_language")).alias("primary_language"),
        tx.list_or_empty(F.col("repo_topics")).alias("topics"),
        F.coalesce("repo_stargazers_count", F.lit(0)).alias("stars"),
    )
    starred = is_star() if window is None else is_star() & window
    zero = F.lit(0).cast("bigint")
    stars = F.col("_max_stars") if highest_stars else F.col("_newest.stars")
    return (
        keyed(events)
        .groupBy("repo_key")
        .agg(
            F.max_by(attributes, newest).alias("_newest"),
            F.max("repo_stargazers_count").alias("_max_stars"),
            F.min("created_at").alias("_first"),
            F.max("created_at").alias("github_pushed_at"),
            F.count_if(starred).alias("star_count_in_window"),
        )
        .select(
            F.col("_newest.repo_id").alias("repo_id"),
            F.col("repo_key").alias("repo_full_name"),
            tx.short_name_of(F.col("repo_key")).alias("repo_name"),
            tx.page_url(F.col("repo_key")).alias("html_url"),
            F.col("_newest.description").alias("description"),
            F.col("_newest.primary_language").alias("primary_language"),
            F.col("_newest.topics").alias("topics"),
            F.lit("Other").alias("category"),
            stars.alias("stargazers_count"),
            stars.alias("watchers_count"),
            zero.alias("forks_count"),
            zero.alias("open_issues_count"),
            zero.alias("subscribers_count"),
            tx.owner_of(F.col("repo_key")).alias("owner_login"),
            F.lit("").alias("owner_avatar_url"),
            F.lit("").alias("license_name"),
            (F.col("_first") if first_seen else moment(as_of)).alias("github_created_at"),
            "github_pushed_at",
            F.lit(0).alias("rank"),
            "star_count_in_window",
        )
    )


def repo_rollup_archive(events: DataFrame, count_stars: bool = True) -> DataFrame:
    """Repository rows of the archive: greatest texts and the union of all topics.

    Counts and texts combine on the map side by (repository, texts), whose numbers have a fixed
    width, so events are hashed and not sorted; the few versions of a repository's texts follow.
    Topics are a union of two levels beside them: distinct (repository, topic) pairs, then the set of
    each repository. Only keys and topics are exploded, and no set holds more than the distinct topics.
    """
    key = ["repo_id", "repo_name"]
    starred = is_star() if count_stars else F.lit(False)
    versions = events.groupBy(*key, "repo_description", "repo_primary_language").agg(
        F.max("repo_stargazers_count").alias("_stars"),
        F.min("created_at").alias("_first"),
        F.max("created_at").alias("_last"),
        F.count_if(starred).alias("_starred"),
    )
    numbers = versions.groupBy(*key).agg(
        F.max("repo_description").alias("description"),
        F.max("repo_primary_language").alias("primary_language"),
        F.max("_stars").alias("stargazers_count"),
        F.min("_first").alias("github_created_at"),
        F.max("_last").alias("github_pushed_at"),
        F.sum("_starred").alias("star_count_in_window"),
    )
    pairs = events.select(*key, F.explode(tx.list_or_empty(F.col("repo_topics"))).alias("_topic"))
    topics = (
        pairs.where(F.col("_topic") != "")
        .distinct()
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("_topic")).alias("topics"))
        .select(F.col("repo_id").alias("_id"), F.col("repo_name").alias("_name"), "topics")
    )
    same = F.col("repo_id").eqNullSafe(F.col("_id")) & F.col("repo_name").eqNullSafe(F.col("_name"))
    zero = F.lit(0).cast("bigint")
    return (
        numbers.join(topics, same, "left")
        .select(
            "repo_id",
            F.col("repo_name").alias("repo_full_name"),
            tx.short_name_of(F.col("repo_name")).alias("repo_name"),
            tx.page_url(F.col("repo_name")).alias("html_url"),
            "description",
            "primary_language",
            tx.list_or_empty(F.col("topics")).alias("topics"),
            F.lit("Other").alias("category"),
            "stargazers_count",
            F.col("stargazers_count").alias("watchers_count"),
            zero.alias("forks_count"),
            zero.alias("open_issues_count"),
            zero.alias("subscribers_count"),
            tx.owner_of(F.col("repo_name")).alias("owner_login"),
            F.lit("").alias("owner_avatar_url"),
            F.lit("").alias("license_name"),
            "github_created_at",
            "github_pushed_at",
            F.lit(0).alias("rank"),
            "star_count_in_window",
        )
    )


def metadata_from_events(events: DataFrame) -> DataFrame:
    """First metadata of repositories known through events only."""
    newest = F.max_by(
        F.struct(
            "repo_stargazers_count", "repo_primary_language", "repo_topics", "repo_description"
        ),
        F.struct("created_at", "event_id"),
    )
    known = {
        "stargazers_count": F.col("_newest.repo_stargazers_count"),
        "watchers_count": F.col("_newest.repo_stargazers_count"),
        "primary_language": F.col("_newest.repo_primary_language"),
        "topics": F.col("_newest.repo_topics"),
        "description": F.col("_newest.repo_description"),
        "github_created_at": F.col("_first"),
        "github_updated_at": F.col("_last"),
        "github_pushed_at": F.col("_last"),
        "fetched_at": F.col("_last"),
        "refreshed_at": F.col("_last"),
    }
    return (
        events.groupBy("repo_id", "repo_name")
        .agg(
            newest.alias("_newest"),
            F.min("created_at").alias("_first"),
            F.max("created_at").alias("_last"),
        )
        .select(*snapshot_columns(known, METADATA_COLUMNS))
    )


def snapshot_as_of(history: DataFrame, as_of: Moment, start: Moment | Column) -> DataFrame:
    """State of every repository at ``as_of``, with its stars before and first within the week.

    One conditional aggregation over the history replaces three scans and two joins.
    """
    begin = start if isinstance(start, Column) else moment(start)
    at = F.struct("snapshot_at", "snapshot_key")
    before = F.col("snapshot_at") < begin
    stars = F.col("stargazers_count")
    return (
        history.where(F.col("snapshot_at") < moment(as_of))
        .groupBy(tx.repo_key(F.col("repo_full_name")).alias("repo_key"))
        .agg(
            F.max_by(F.struct(*REPO_ROW), at).alias("_row"),
            F.max_by(F.when(before, stars), F.when(before, at)).alias("baseline_stars"),
            F.min_by(F.when(~before, stars), F.when(~before, at)).alias("first_week_stars"),
        )
        .select("repo_key", "_row.*", "baseline_stars", "first_week_stars")
    )
