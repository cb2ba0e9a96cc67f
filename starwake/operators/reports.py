"""Dashboard reports: repository lists, breakdowns, categories, movers and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwake.functions import classify as cat
from starwake.functions import scores
from starwake.functions import text as tx
from starwake.functions.times import (
    Moment,
    day,
    in_date_window,
    in_previous_window,
    in_window,
    moment,
    twice,
    week_start,
)
from starwake.operators import rollups as ru
from starwake.operators.clean import with_effective_category
from starwake.operators.joins import spread_left_join
from starwake.operators.ranking import top_k, top_k_ranked
from starwake.schemas import METADATA_COLUMNS, REPO_ROW
from starwake.vocab import OTHER

def recent_stars() -> list[Column]:
    return [F.desc("star_count_in_window"), F.desc("stargazers_count"), F.asc("repo_full_name")]


def all_stars() -> list[Column]:
    return [F.desc("stargazers_count"), F.asc("repo_full_name")]


def _in_category(repos: DataFrame, category: str | None) -> DataFrame:
    return repos if category is None else repos.where(F.col("category") == category)


def may_be_in_category(repos: DataFrame, category: str | None) -> DataFrame:
    """Rows that can have the category once a stored Other has been looked at again."""
    return repos if category is None else repos.where(F.col("category").isin(category, OTHER))


def _fresh_push(repos: DataFrame) -> DataFrame:
    """A push is at least as recent as the latest event seen."""
    return repos.withColumn(
        "github_pushed_at", F.greatest("github_pushed_at", "latest_event_at")
    ).drop("latest_event_at")


# --------------------------------------------------------------------------- repository lists


def top_repos(
    metadata: DataFrame,
    events: DataFrame,
    as_of: Moment,
    days: int = 7,
    limit: int = 20,
    category: str | None = None,
) -> DataFrame:
    """Repositories with metadata, by stars gained in the window."""
    repos = may_be_in_category(ru.latest_metadata(metadata), category)
    metrics = ru.window_star_metrics(events, as_of, days)
    joined = _fresh_push(repos.join(metrics, "repo_key")).select(*REPO_ROW, "star_count_in_window")
    classified = _in_category(with_effective_category(joined), category)
    return top_k(classified, recent_stars(), limit)


def top_repos_from_events(
    events: DataFrame,
    as_of: Moment,
    days: int = 7,
    limit: int = 20,
    category: str | None = None,
    hide_other: bool = True,
) -> DataFrame:
    """The same list when there is no metadata."""
    seen = events.where(in_window(F.col("created_at"), as_of, days))
    rows = ru.repo_rollup_raw(seen, as_of, highest_stars=False, first_seen=False)
    return _category_cut(rows, category, hide_other, recent_stars(), limit)


def top_repos_from_archive(
    archive: DataFrame,
    as_of: Moment,
    days: int = 7,
    limit: int = 20,
    category: str | None = None,
) -> DataFrame:
    """The same list from archive partitions (whole dates)."""
    rows = ru.repo_rollup_archive(archive.where(in_date_window(F.col("event_date"), as_of, days)))
    return _category_cut(rows, category, False, recent_stars(), limit)


def _category_cut(
    rows: DataFrame,
    category: str | None,
    hide_other: bool,
    order: list[Column],
    limit: int,
) -> DataFrame:
    """Classify before the limit, so that nothing has to be fetched in excess.

    Hiding Other unless it is alone needs no second pass: real categories sort first, so if there
    is one at all it is among the rows that are left.
    """
    classified = _in_category(with_effective_category(rows), category)
    if category is not None or not hide_other:
        return top_k(classified, order, limit)
    known = F.col("category") != OTHER
    first = top_k(classified, [F.desc(known), *order], limit)
    return (
        first.withColumn("_any", F.max(known).over(Window.partitionBy()))
        .where(known | ~F.col("_any"))
        .drop("_any")
    )


def top_repos_left(
    metadata: DataFrame,
    star_counts: DataFrame,
    as_of: Moment,
    days: int = 7,
    limit: int = 20,
    category: str | None = None,
) -> DataFrame:
    """All metadata columns by stored daily star counts; repositories without stars included."""
    repos = _in_category(ru.latest_metadata(metadata, METADATA_COLUMNS), category)
    stars = ru.sum_star_counts(star_counts, as_of, days)
    joined = repos.join(stars, "repo_key", "left").withColumn(
        "star_count_in_window", F.coalesce("star_count_in_window", F.lit(0))
    )
    order = [F.desc("star_count_in_window"), F.asc("repo_full_name")]
    return top_k(joined.drop("repo_key"), order, limit)


def top_starred_repos(
    metadata: DataFrame, limit: int = 20, category: str | None = None
) -> DataFrame:
    """Metadata alone, by all stars."""
    repos = with_effective_category(_in_category(ru.latest_metadata(metadata), None))
    listed = _in_category(repos, category).drop("repo_key")
    return top_k(listed, all_stars(), limit).withColumn(
        "star_count_in_window", F.lit(0).cast("bigint")
    )


def top_starred_from_events(
    events: DataFrame, as_of: Moment, limit: int = 20, category: str | None = None
) -> DataFrame:
    rows = ru.repo_rollup_raw(events, as_of).withColumn(
        "star_count_in_window", F.lit(0).cast("bigint")
    )
    return _category_cut(rows, category, False, all_stars(), limit)


def top_starred_from_archive(
    archive: DataFrame, limit: int = 20, category: str | None = None
) -> DataFrame:
    rows = ru.repo_rollup_archive(archive, count_stars=False)
    return _category_cut(rows, category, False, all_stars(), limit)


def weekly_growth(history: DataFrame, as_of: Moment) -> DataFrame:
    """Stars gained since Monday: against the last state before, else the first of the week."""
    state = ru.snapshot_as_of(history, as_of, week_start(as_of))
    base = F.coalesce("baseline_stars", "first_week_stars", "stargazers_count")
    growth = F.greatest(F.col("stargazers_count") - base, F.lit(0))
    return state.withColumn("star_count_in_window", growth).drop(
        "repo_key", "baseline_stars", "first_week_stars"
    )


def trending_week(history: DataFrame, as_of: Moment, limit: int = 20) -> DataFrame:
    grown = weekly_growth(history, as_of).where("star_count_in_window > 0")
    return top_k_ranked(with_effective_category(grown), recent_stars(), limit, "growth_rank")


def trending_from_events(events: DataFrame, as_of: Moment, limit: int = 20) -> DataFrame:
    seen = F.col("created_at")
    week = events.where((seen >= week_start(as_of)) & (seen < moment(as_of)))
    rows = ru.repo_rollup_raw(week, as_of, highest_stars=False, first_seen=False)
    return top_k_ranked(with_effective_category(rows), recent_stars(), limit, "growth_rank")


def trending_from_archive(archive: DataFrame, as_of: Moment, limit: int = 20) -> DataFrame:
    seen, start = F.col("created_at"), week_start(as_of)
    week = archive.where(
        (F.col("event_date") >= F.to_date(start)) & (seen >= start) & (seen < moment(as_of))
    )
    rows = ru.repo_rollup_archive(week).where("star_count_in_window > 0")
    return top_k_ranked(with_effective_category(rows), recent_stars(), limit, "growth_rank")


def repo_lookup(metadata: DataFrame, repo_name: str) -> DataFrame:
    found = metadata.where(tx.repo_key(F.col("repo_full_name")) == repo_name.lower())
    return with_effective_category(ru.latest_metadata(found).drop("repo_key"))


def repo_lookup_from_events(events: DataFrame, repo_name: str, as_of: Moment) -> DataFrame:
    found = ru.keyed(events).where(F.col("repo_key") == repo_name.lower())
    rows = ru.repo_rollup_raw(found, as_of).drop("star_count_in_window")
    return with_effective_category(rows)


# --------------------------------------------------------------------------- movers


def _with_mover_ratios(rows: DataFrame) -> DataFrame:
    current = F.col("star_count_in_window")
    return rows.withColumns(
        {
            "weekly_percent_gain": scores.percent_gain(current, F.col("stargazers_count")),
            "window_over_window_ratio": scores.window_ratio(
                current, F.col("previous_star_count_in_window")
            ),
        }
    )


def movers(metadata: DataFrame, events: DataFrame, as_of: Moment, days: int = 7) -> DataFrame:
    """Every repository with stars in the window, with its ratios; not yet ranked."""
    metrics = ru.mover_metrics(events, as_of, days).select(
        "repo_key",
        F.col("current_star_count").alias("star_count_in_window"),
        F.col("previous_star_count").alias("previous_star_count_in_window"),
        "unique_actors_in_window",
        "latest_event_at",
    )
    joined = _fresh_push(ru.latest_metadata(metadata).join(metrics, "repo_key")).drop("repo_key")
    return with_effective_category(_with_mover_ratios(joined))


def movers_from_events(events: DataFrame, as_of: Moment, days: int = 7) -> DataFrame:
    seen = F.col("created_at")
    recent = events.where(in_window(seen, as_of, twice(days)))
    rows = ru.repo_rollup_raw(recent, as_of, window=in_window(seen, as_of, days))
    metrics = ru.mover_metrics(events, as_of, days).select(
        F.col("repo_key").alias("repo_full_name"),
        F.col("previous_star_count").alias("previous_star_count_in_window"),
        "unique_actors_in_window",
    )
    joined = rows.join(metrics, "repo_full_name")
    return with_effective_category(_with_mover_ratios(joined))


def absolute_movers(all_movers: DataFrame, limit: int = 6) -> DataFrame:
    order = [
        F.desc("star_count_in_window"),
        F.desc("unique_actors_in_window"),
        F.desc("stargazers_count"),
        F.asc("repo_full_name"),
    ]
    return top_k_ranked(all_movers.drop("rank"), order, limit)


def percentage_movers(
    all_movers: DataFrame, limit: int = 6, min_baseline_stars: int = 1000
) -> DataFrame:
    """Relative growth, for repositories that had enough stars before."""
    before = F.greatest(F.col("stargazers_count") - F.col("star_count_in_window"), F.lit(0))
    order = [
        F.desc("weekly_percent_gain"),
        F.desc("star_count_in_window"),
        F.desc("unique_actors_in_window"),
        F.asc("repo_full_name"),
    ]
    return top_k_ranked(all_movers.where(before >= min_baseline_stars).drop("rank"), order, limit)


def shock_movers(
    metadata: DataFrame,
    events: DataFrame,
    as_of: Moment,
    days: int = 7,
    absolute_limit: int = 6,
    percentage_limit: int = 6,
    min_baseline_stars: int = 1000,
) -> DataFrame:
    """Both mover lists in one result, told apart by ``list``."""
    found = movers(metadata, events, as_of, days)
    return (
        absolute_movers(found, absolute_limit)
        .withColumn("list", F.lit("absolute"))
        .unionByName(
            percentage_movers(found, percentage_limit, min_baseline_stars).withColumn(
                "list", F.lit("percentage")
            )
        )
    )


# --------------------------------------------------------------------------- topics and languages


def _by_topic(events: DataFrame, *columns: str) -> DataFrame:
    """One row per event and non-empty topic, narrowed before the explode."""
    return (
        events.select(*columns, F.explode("repo_topics").alias("topic")).where("topic <> ''")
    )


def _breakdown(rows: DataFrame, name: str, limit: int) -> DataFrame:
    counts = (
        rows.groupBy(name)
        .agg(
            ru.star_count().alias("event_count"),
            F.count_distinct("repo_name").alias("repo_count"),
        )
        .where("event_count > 0")
    )
    return top_k(counts, [F.desc("event_count"), F.asc(name)], limit)


def _window_mode(events: DataFrame, as_of: Moment, days: int, mode: str) -> DataFrame:
    """``ts``: exact window on the time; ``date``: whole archive dates."""
    if mode == "date":
        return events.where(in_date_window(F.col("event_date"), as_of, days))
    return events.where(in_window(F.col("created_at"), as_of, days))


def topic_breakdown(
    events: DataFrame, as_of: Moment, days: int = 7, limit: int = 30, mode: str = "ts"
) -> DataFrame:
    seen = _window_mode(events, as_of, days, mode)
    return _breakdown(_by_topic(seen, "repo_name", "event_type"), "topic", limit)


def language_breakdown(
    events: DataFrame, as_of: Moment, days: int = 7, limit: int = 20, mode: str = "ts"
) -> DataFrame:
    seen = _window_mode(events, as_of, days, mode).where("repo_primary_language <> ''")
    rows = seen.select("repo_name", "event_type", F.col("repo_primary_language").alias("language"))
    return _breakdown(rows, "language", limit)


def topic_rotation(
    events: DataFrame, as_of: Moment, days: int = 7, limit: int = 10
) -> DataFrame:
    seen = F.col("created_at")
    recent = events.where(in_window(seen, as_of, twice(days)))
    current, previous = in_window(seen, as_of, days), in_previous_window(seen, as_of, days)
    counts = (
        _by_topic(recent, "created_at", "event_type", "repo_name")
        .groupBy("topic")
        .agg(
            F.count_if(ru.is_star() & current).alias("current_star_count"),
            F.count_if(ru.is_star() & previous).alias("previous_star_count"),
            F.count_distinct(F.when(current, F.col("repo_name"))).alias("repo_count"),
        )
        .where("current_star_count > 0")
        .withColumn("star_delta", F.col("current_star_count") - F.col("previous_star_count"))
    )
    order = [
        F.desc("star_delta"),
        F.desc("current_star_count"),
        F.desc("repo_count"),
        F.asc("topic"),
    ]
    return top_k_ranked(counts, order, limit)


def language_share(breakdown: DataFrame, keep: int = 8) -> DataFrame:
    """The biggest languages and one slice for the rest, in whole percent.

    Works on the breakdown report, which has at most its own limit of rows.
    """
    place = F.row_number().over(Window.orderBy(F.desc("event_count"), F.asc("language")))
    sliced = breakdown.withColumn(
        "name", F.when(place <= keep, F.col("language")).otherwise(F.lit("Other"))
    ).withColumn("rest", place > keep)
    slices = (
        sliced.groupBy("name", "rest")
        .agg(
            F.sum("event_count").alias("value"),
            F.sum(F.when(~F.col("rest"), F.col("repo_count")).otherwise(0)).alias("repos"),
        )
        .where("value > 0")
    )
    total = F.sum("value").over(Window.partitionBy())
    return slices.select(
        "name", "value", "repos", scores.half_up(F.col("value") / total * 100).alias("percent")
    )


def bar_scaling(rows: DataFrame, value: str, name: str = "percent_of_max") -> DataFrame:
    """Length of a bar relative to the longest, over the rows of one (top-k) chart."""
    longest = F.greatest(F.max(value).over(Window.partitionBy()), F.lit(1))
    return rows.withColumn(name, scores.half_up(F.col(value) / longest * 100))


def rotation_bar(rotation: DataFrame) -> DataFrame:
    current = F.col("current_star_count")
    ratio = scores.half_up(F.col("star_delta") / F.greatest(current, F.lit(1)) * 100)
    width = F.when(current == 0, F.lit(12)).otherwise(
        F.greatest(F.lit(12), F.least(F.lit(100), ratio))
    )
    return rotation.withColumn("bar_width", width.cast("bigint"))


# --------------------------------------------------------------------------- time series


def repo_timeseries(
    events: DataFrame, repo_name: str, as_of: Moment, days: int = 30, mode: str = "ts"
) -> DataFrame:
    """Stars and events per day of one repository; days without events have no row."""
    one = ru.keyed(_window_mode(events, as_of, days, mode)).where(
        F.col("repo_key") == repo_name.lower()
    )
    return daily_activity(one).drop("repo_key").orderBy("event_date")


def daily_activity(events: DataFrame) -> DataFrame:
    """Stars and events per repository and day."""
    return (
        ru.keyed(events)
        .groupBy("repo_key", F.to_date("created_at").alias("event_date"))
        .agg(ru.star_count().alias("star_count"), ru.count_rows().alias("total_events"))
    )


# --------------------------------------------------------------------------- categories


def _leader(name: str, value: str) -> Column:
    """Name of the row with the greatest value, first by name among equals."""
    return F.min_by(name, F.struct(-F.col(value), F.col(name)))


def _summary_per_category(repos: DataFrame) -> DataFrame:
    return repos.groupBy("category").agg(
        ru.count_rows().alias("repo_count"),
        F.sum("stargazers_count").alias("total_stars"),
        _leader("repo_full_name", "stargazers_count").alias("top_repo_name"),
        F.max("stargazers_count").alias("top_repo_stars"),
        F.coalesce(F.sum("star_count_in_window"), F.lit(0)).alias("weekly_star_delta"),
    )


def category_summary(metadata: DataFrame, events: DataFrame, as_of: Moment) -> DataFrame:
    """Catalogue per category with the stars of the last seven days."""
    repos = ru.latest_metadata(metadata, ["repo_full_name", "category", "stargazers_count"])
    stars = ru.window_star_metrics(events, as_of, 7).drop("latest_event_at")
    summary = _summary_per_category(repos.join(stars, "repo_key", "left"))
    return summary.orderBy(F.desc("total_stars"), "category")


def category_summary_from_counts(
    metadata: DataFrame, star_counts: DataFrame, as_of: Moment
) -> DataFrame:
    repos = ru.latest_metadata(metadata, ["repo_full_name", "category", "stargazers_count"])
    stars = ru.sum_star_counts(star_counts, as_of, 7)
    summary = _summary_per_category(repos.join(stars, "repo_key", "left"))
    return summary.orderBy(F.desc("total_stars"), "category")


def category_summary_from_events(events: DataFrame, as_of: Moment) -> DataFrame:
    """Re-classified repositories with stars this week; Other is left out."""
    week = in_window(F.col("created_at"), as_of, 7)
    rows = ru.repo_rollup_raw(events, as_of, window=week).where("star_count_in_window > 0")
    classified = rows.withColumn(
        "category", cat.classify(F.col("topics"), F.col("description"))
    ).where(F.col("category") != OTHER)
    return _summary_per_category(classified).orderBy(
        F.desc("total_stars"), F.desc("weekly_star_delta"), F.desc("repo_count"), "category"
    )


def category_summary_per_event(events: DataFrame, as_of: Moment) -> DataFrame:
    """One row for everything, stars added up per event."""
    seen = events.where(in_window(F.col("created_at"), as_of, 7))
    return seen.agg(
        F.lit(OTHER).alias("category"),
        F.count_distinct("repo_name").alias("repo_count"),
        F.sum("repo_stargazers_count").alias("total_stars"),
        _leader("repo_name", "repo_stargazers_count").alias("top_repo_name"),
        F.max("repo_stargazers_count").alias("top_repo_stars"),
        ru.star_count().alias("weekly_star_delta"),
    )


def category_summary_from_archive(archive: DataFrame, as_of: Moment) -> DataFrame:
    week = F.col("event_date") >= F.date_sub(day(as_of), 7)
    per_repo = archive.groupBy("repo_name").agg(
        F.max("repo_stargazers_count").alias("stars"),
        F.count_if(week & ru.is_star()).alias("weekly"),
    )
    return per_repo.agg(
        F.lit(OTHER).alias("category"),
        ru.count_rows().alias("repo_count"),
        F.coalesce(F.sum("stars"), F.lit(0)).alias("total_stars"),
        _leader("repo_name", "stars").alias("top_repo_name"),
        F.coalesce(F.max("stars"), F.lit(0)).alias("top_repo_stars"),
        F.coalesce(F.sum("weekly"), F.lit(0)).alias("weekly_star_delta"),
    )


def headline_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.sum("repo_count").alias("repo_count"),
        F.sum("total_stars").alias("total_stars"),
        F.sum("weekly_star_delta").alias("weekly_star_delta"),
    )


# --------------------------------------------------------------------------- lookups between tables


def repos_to_enrich(
    events: DataFrame, metadata: DataFrame, as_of: Moment, days: int = 30, limit: int = 100
) -> DataFrame:
    """The ``limit`` most active of the repositories that have no metadata yet."""
    active = (
        ru.keyed(events)
        .where(in_window(F.col("created_at"), as_of, days))
        .groupBy("repo_key")
        .agg(ru.count_rows().alias("event_count"))
    )
    known = metadata.select(tx.repo_key(F.col("repo_full_name")).alias("repo_key"))
    unknown = active.join(known, "repo_key", "left_anti")
    return top_k(unknown, [F.desc("event_count"), F.asc("repo_key")], limit)


def lookup_key() -> Column:
    """The key under which an event's repository is looked up; names without a slash have none."""
    return F.when(F.contains("repo_name", F.lit("/")), tx.repo_key(F.col("repo_name")))


def enrich_events(events: DataFrame, metadata: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Give every event the current metadata of its repository.

    ``metadata_missing`` marks events whose repository is unknown; they are kept. Names without a
    slash are not looked up. Busy repositories are shared out over several tasks: those that ``hot``
    names (``repo_key``, ``_copies``), or else those that a count of the events finds.
    """
    fields = ["stargazers_count", "primary_language", "topics", "description"]
    known = ru.latest_metadata(metadata, fields).withColumn("_known", F.lit(True))
    looked_up = events.drop("repo_key").withColumn("repo_key", lookup_key())
    joined = spread_left_join(looked_up, known, "repo_key", "event_id", hot=hot)
    return joined.select(
        *[
            name
            for name in events.columns
            if name not in ("repo_key",) and not name.startswith("repo_")
        ],
        "repo_id",
        "repo_name",
        F.coalesce("stargazers_count", F.lit(0)).alias("repo_stargazers_count"),
        tx.text_or_empty(F.col("primary_language")).alias("repo_primary_language"),
        tx.list_or_empty(F.col("topics")).alias("repo_topics"),
        tx.text_or_empty(F.col("description")).alias("repo_description"),
        F.lit("").alias("repo_readme_text"),
        F.lit("[]").alias("repo_issues_json"),
        F.col("_known").isNull().alias("metadata_missing"),
    )


def news_radar(
    movers_list: DataFrame, headlines: DataFrame, per_repo: int = 3
) -> DataFrame:
    """Landed headlines for the repositories of a mover list, in the order they were found.

    The mover list is a top-k report, so it filters the headlines before they are ranked.
    """
    usable = headlines.where(~tx.is_blank(F.col("title")) & ~tx.is_blank(F.col("url"))).select(
        tx.repo_key(F.col("repo_full_name")).alias("repo_key"),
        "position",
        F.struct(
            tx.strip(F.col("title")).alias("title"),
            tx.strip(F.col("url")).alias("url"),
            F.coalesce(
                *[
                    F.nullif(tx.strip(F.col(name)), F.lit(""))
                    for name in ("source", "parsed_url", "engine")
                ],
                F.lit("web"),
            ).alias("source"),
            tx.strip(
                F.coalesce(
                    F.nullif(F.col("content"), F.lit("")),
                    F.nullif(F.col("snippet"), F.lit("")),
                    F.lit(""),
                )
            ).alias("snippet"),
            F.nullif(tx.strip(F.col("engine")), F.lit("")).alias("engine"),
        ).alias("headline"),
    )
    listed = movers_list.select(
        tx.repo_key(F.col("repo_full_name")).alias("repo_key"),
        "repo_full_name",
        "category",
        "star_count_in_window",
        "weekly_percent_gain",
        "rank",
    )
    # The rank filter lets Spark drop all but the first few rows per repository before the shuffle.
    order = Window.partitionBy("repo_key").orderBy("position", "headline")
    first = (
        usable.join(listed.select("repo_key"), "repo_key", "left_semi")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_repo)
        .groupBy("repo_key")
        .agg(F.array_sort(F.collect_list(F.struct("place", "headline"))).alias("_found"))
    )
    found = F.transform("_found", lambda item: item.getField("headline"))
    none = F.array().cast(
        "array<struct<title:string,url:string,source:string,snippet:string,engine:string>>"
    )
    return (
        listed.join(first, "repo_key", "left")
        .withColumn("headlines", F.coalesce(found, none))
        .drop("_found", "repo_key")
    )
