"""The market report: breakouts, category movers, topic shifts and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwake.functions import scores
from starwake.functions import text as tx
from starwake.functions.times import Moment, in_window
from starwake.operators import rollups as ru
from starwake.operators.clean import with_effective_category
from starwake.operators.ranking import top_k
from starwake.schemas import REPO_ROW
from starwake.vocab import MARKET_BRIEF_TEXTS as TEXT
from starwake.vocab import OTHER


def _breakout_order() -> list[Column]:
    return [
        F.desc("star_count_in_window"),
        F.desc("total_events_in_window"),
        F.desc("stargazers_count"),
        F.asc("repo_full_name"),
    ]


def _with_momentum(rows: DataFrame) -> DataFrame:
    score = scores.momentum(F.col("star_count_in_window"), F.col("stargazers_count"))
    return with_effective_category(rows).withColumn("momentum_score", score)


def market_breakouts(
    metadata: DataFrame, events: DataFrame, as_of: Moment, days: int = 30, limit: int = 5
) -> DataFrame:
    metrics = ru.market_repo_metrics(events, as_of, days).drop("latest_event_at")
    joined = ru.latest_metadata(metadata).join(metrics, "repo_key").drop("repo_key")
    return top_k(_with_momentum(joined), _breakout_order(), limit)


def market_breakouts_from_events(
    events: DataFrame, as_of: Moment, days: int = 30, limit: int = 5
) -> DataFrame:
    """The same list when no repository has metadata."""
    seen = events.where(in_window(F.col("created_at"), as_of, days))
    metrics = ru.market_repo_metrics(events, as_of, days).select(
        F.col("repo_key").alias("repo_full_name"),
        "total_events_in_window",
        "unique_actors_in_window",
    )
    rows = ru.repo_rollup_raw(seen, as_of).join(metrics, "repo_full_name")
    columns = [*REPO_ROW, "star_count_in_window", "total_events_in_window"]
    return top_k(
        _with_momentum(rows.select(*columns, "unique_actors_in_window")), _breakout_order(), limit
    )


def _category_movers(rows: DataFrame, limit: int) -> DataFrame:
    leader = F.min_by(
        "repo_full_name", F.struct(-F.col("star_count_in_window"), F.col("repo_full_name"))
    )
    per_category = rows.groupBy("category").agg(
        ru.count_rows().alias("active_repo_count"),
        F.sum("star_count_in_window").alias("total_stars_in_window"),
        F.sum("total_events_in_window").alias("total_events_in_window"),
        leader.alias("leader_repo_name"),
        F.max("star_count_in_window").alias("leader_stars_in_window"),
    )
    # One row per category: the window over all of them is as small as the list of categories.
    total = F.sum("total_stars_in_window").over(Window.partitionBy())
    shared = per_category.withColumn(
        "share_of_window_stars", scores.share(F.col("total_stars_in_window"), total)
    )
    order = [
        F.desc("total_stars_in_window"),
        F.desc("total_events_in_window"),
        F.desc("active_repo_count"),
        F.asc("category"),
    ]
    return top_k(shared, order, limit)


def market_category_movers(
    metadata: DataFrame, events: DataFrame, as_of: Moment, days: int = 30, limit: int = 5
) -> DataFrame:
    """Stars per category; shares are of all categories, also those beyond the limit."""
    metrics = ru.market_repo_metrics(events, as_of, days)
    repos = ru.latest_metadata(metadata, ["repo_full_name", "category"])
    return _category_movers(repos.join(metrics, "repo_key"), limit)


def market_category_movers_from_events(
    events: DataFrame, as_of: Moment, days: int = 30, limit: int = 5
) -> DataFrame:
    metrics = ru.market_repo_metrics(events, as_of, days)
    rows = metrics.withColumns({"category": F.lit(OTHER), "repo_full_name": F.col("repo_key")})
    return _category_movers(rows, limit)


def market_topic_shifts(
    events: DataFrame, as_of: Moment, days: int = 30, limit: int = 8
) -> DataFrame:
    seen = events.where(in_window(F.col("created_at"), as_of, days))
    counts = (
        seen.select("repo_name", "event_type", F.explode("repo_topics").alias("topic"))
        .where("topic <> ''")
        .groupBy("topic")
        .agg(
            F.count_distinct("repo_name").alias("repo_count"),
            ru.star_count().alias("star_count_in_window"),
        )
    )
    order = [F.desc("star_count_in_window"), F.desc("repo_count"), F.asc("topic")]
    return top_k(counts, order, limit)


def breakout_concentration(breakouts: DataFrame) -> DataFrame:
    """How much of the surfaced stars the first breakout holds (over the top-k report)."""
    stars = F.col("star_count_in_window")
    total = F.sum(stars)
    top = F.max(stars)
    return breakouts.agg(
        F.coalesce(total, F.lit(0)).alias("total_breakout_stars"),
        F.when(total > 0, scores.rounded(top / total, 4)).alias("top_share"),
        F.coalesce((total > 0) & (top / total >= 0.5), F.lit(False)).alias("is_concentrated"),
    )


def listed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A top-k report as one row with an ordered list. Its length is the report's limit."""
    columns = rows.columns
    ranked = rows.withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    items = F.array_sort(F.collect_list(F.struct("_place", *columns)))
    return ranked.agg(items.alias(name))


def market_brief_context(
    metadata: DataFrame,
    events: DataFrame,
    as_of: Moment,
    days: int = 30,
    breakout_limit: int = 5,
    category_limit: int = 5,
    topic_limit: int = 8,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        market_breakouts(metadata, events, as_of, days, breakout_limit),
        market_category_movers(metadata, events, as_of, days, category_limit),
        market_topic_shifts(events, as_of, days, topic_limit),
    )


def market_brief(
    breakouts: DataFrame, categories: DataFrame, topics: DataFrame, days: int
) -> DataFrame:
    """Headline, summary, takeaways and watch-outs as one row, from the three top-k reports."""
    category_order = [
        F.desc("total_stars_in_window"),
        F.desc("total_events_in_window"),
        F.desc("active_repo_count"),
        F.asc("category"),
    ]
    topic_order = [F.desc("star_count_in_window"), F.desc("repo_count"), F.asc("topic")]
    lists = breakouts.select(
        "repo_full_name",
        "star_count_in_window",
        "total_events_in_window",
        "unique_actors_in_window",
        "stargazers_count",
    )
    # Scalar subqueries of one-row lists; there is nothing to join.
    b = listed(lists, _breakout_order(), "items").scalar()
    c = listed(categories, category_order, "items").scalar()
    t = listed(topics, topic_order, "items").scalar()
    session = breakouts.sparkSession
    one = session.range(1).select(b.alias("b"), c.alias("c"), t.alias("t"))

    def say(name: str, *values: Column) -> Column:
        """Text, or NULL (left out) when a part is missing."""
        line = F.format_string(TEXT[name], *values)
        present = F.lit(True)
        for value in values:
            present = present & value.isNotNull()
        return F.when(present, line)

    first = F.get("b", F.lit(0))
    second = F.get("b", F.lit(1))
    category = F.get("c", F.lit(0))
    topic = F.get("t", F.lit(0))
    name = first.getField("repo_full_name")
    stars = first.getField("star_count_in_window")
    actors = first.getField("unique_actors_in_window")
    shown = F.size("b")
    total = F.aggregate(
        "b", F.lit(0).cast("bigint"), lambda acc, item: acc + item.getField("star_count_in_window")
    )
    many = F.when(shown > 1, F.format_string(TEXT["summary_many"], shown))
    summary = F.concat_ws(
        " ",
        say(
            "summary_breakout",
            name,
            tx.grouped(first.getField("total_events_in_window")),
            tx.grouped(actors),
        ),
        say(
            "summary_category",
            category.getField("category"),
            category.getField("leader_repo_name"),
        ),
        say("summary_topic", topic.getField("topic"), topic.getField("repo_count")),
        many,
    )
    takeaways = tx.non_null(
        say("take_breakout", name, tx.grouped(stars), tx.grouped(actors)),
        say("take_runner_up", second.getField("repo_full_name")),
        say(
            "take_category",
            category.getField("category"),
            tx.grouped(category.getField("total_stars_in_window")),
        ),
        say("take_topic", topic.getField("topic"), topic.getField("repo_count")),
    )
    found = tx.non_null(
        F.when((total > 0) & (stars / F.greatest(total, F.lit(1)) >= 0.5), TEXT["watch_single"]),
        F.when(
            category.getField("share_of_window_stars") >= 0.5,
            F.format_string(TEXT["watch_category"], category.getField("category")),
        ),
        F.when(F.size("t") <= 1, TEXT["watch_topics"]),
    )
    watchouts = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(TEXT["watch_none"])))
    quiet = shown == 0
    return one.select(
        F.lit(days).alias("window_days"),
        F.lit("template").alias("retrieval_mode"),
        F.when(quiet, F.format_string(TEXT["quiet_headline"], F.lit(days)))
        .otherwise(say("headline", name, F.lit(days), tx.grouped(stars)))
        .alias("headline"),
        F.when(quiet, TEXT["quiet_summary"]).otherwise(summary).alias("summary"),
        F.when(quiet, F.array(*[F.lit(text) for text in TEXT["quiet_takeaways"]]))
        .otherwise(F.slice(takeaways, 1, 5))
        .alias("key_takeaways"),
        F.when(quiet, F.array(F.lit(TEXT["quiet_watchout"])))
        .otherwise(F.slice(watchouts, 1, 3))
        .alias("watchouts"),
    )

