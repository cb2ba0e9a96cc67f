"""Repository reports and comparisons, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwake.functions import scores
from starwake.functions import text as tx
from starwake.functions.times import Moment, in_window, moment
from starwake.operators import rollups as ru
from starwake.operators.clean import with_effective_category
from starwake.vocab import COMPARE_TEXTS, REPO_BRIEF_TEXTS


def _of_repo(events: DataFrame, repo_name: str) -> DataFrame:
    return ru.keyed(events).where(F.col("repo_key") == repo_name.lower())


def repo_window_metrics(
    events: DataFrame, repo_name: str, as_of: Moment, days: int = 30
) -> DataFrame:
    """Always one row, also for a repository without events."""
    seen = _of_repo(events, repo_name).where(in_window(F.col("created_at"), as_of, days))
    return seen.agg(
        ru.count_rows().alias("total_events"),
        F.count_distinct("actor_login").alias("unique_actors"),
        F.max("created_at").alias("latest_event_at"),
    )


def activity_by_type(events: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Events per repository and type in the window."""
    return (
        ru.keyed(events)
        .where(in_window(F.col("created_at"), as_of, days))
        .groupBy("repo_key", "event_type")
        .agg(ru.count_rows().alias("event_count"))
    )


def repo_activity_top5(
    events: DataFrame, repo_name: str, as_of: Moment, days: int = 30, limit: int = 5
) -> DataFrame:
    one = activity_by_type(_of_repo(events, repo_name), as_of, days)
    return (
        one.select("event_type", "event_count")
        .orderBy(F.desc("event_count"), "event_type")
        .limit(limit)
    )


def half_window_star_rates(daily: DataFrame) -> DataFrame:
    """Average daily stars of the first and the second half of the days with events.

    Works on one row per repository and day, so a window group is as long as the report window.
    """
    per_repo = Window.partitionBy("repo_key")
    place = F.row_number().over(per_repo.orderBy("event_date"))
    days = F.count(F.lit(1)).over(per_repo)
    first = F.col("place") <= F.greatest(F.expr("days div 2"), F.lit(1))
    stars = F.col("star_count")
    rates = (
        daily.select("repo_key", "star_count", place.alias("place"), days.alias("days"))
        .groupBy("repo_key")
        .agg(
            F.avg(F.when(first, stars)).alias("prior_star_rate"),
            F.avg(F.when(~first, stars)).alias("_recent"),
            F.sum(F.when(first, stars)).cast("double").alias("_prior_sum"),
        )
    )
    return rates.select(
        "repo_key",
        F.coalesce("_recent", "_prior_sum").alias("recent_star_rate"),
        "prior_star_rate",
    )


def repo_brief_context(
    metadata: DataFrame, events: DataFrame, as_of: Moment, days: int = 30
) -> DataFrame:
    """Metadata, window numbers, dominant activity and star rates of every repository.

    Types and days come from one small count per (repository, type, day). All aggregates end up
    hashed on the key of the metadata, so the joins reuse that partitioning.
    """
    recent = ru.keyed(events).where(in_window(F.col("created_at"), as_of, days))
    metrics = ru.market_repo_metrics(events, as_of, days)
    cells = recent.groupBy(
        "repo_key", "event_type", F.to_date("created_at").alias("event_date")
    ).agg(ru.count_rows().alias("event_count"))
    types = (
        cells.groupBy("repo_key", "event_type")
        .agg(F.sum("event_count").alias("event_count"))
        .groupBy("repo_key")
        .agg(
            F.min_by(
                F.struct("event_type", "event_count"),
                F.struct(-F.col("event_count"), F.col("event_type")),
            ).alias("dominant")
        )
    )
    stars = F.sum(F.when(ru.is_star(), F.col("event_count")).otherwise(0))
    daily = cells.groupBy("repo_key", "event_date").agg(stars.alias("star_count"))
    rates = half_window_star_rates(daily)
    zero = F.lit(0)
    return (
        with_effective_category(ru.latest_metadata(metadata))
        .join(metrics, "repo_key", "left")
        .join(types, "repo_key", "left")
        .join(rates, "repo_key", "left")
        .withColumns(
            {
                "star_count_in_window": F.coalesce("star_count_in_window", zero),
                "total_events_in_window": F.coalesce("total_events_in_window", zero),
                "unique_actors_in_window": F.coalesce("unique_actors_in_window", zero),
                "recent_star_rate": F.coalesce("recent_star_rate", F.lit(0.0)),
                "prior_star_rate": F.coalesce("prior_star_rate", F.lit(0.0)),
                "dominant_event": F.col("dominant.event_type"),
                "dominant_count": F.col("dominant.event_count"),
                "window_days": F.lit(days),
            }
        )
        .drop("dominant")
    )


def of_repo(context: DataFrame, repo_name: str) -> DataFrame:
    """One repository; the filter on the key reaches the scans below the joins."""
    return context.where(F.col("repo_key") == repo_name.lower())


def trend_verdict(
    stars: Column, total_events: Column, recent_rate: Column, prior_rate: Column
) -> Column:
    rising = recent_rate >= F.greatest(prior_rate * 1.2, F.lit(5.0))
    return (
        F.when((stars >= 250) & rising, "accelerating")
        .when((stars >= 100) | (total_events >= 250), "steady")
        .when((stars > 0) | (total_events >= 40), "emerging")
        .otherwise("quiet")
    )


def with_trend_verdict(context: DataFrame) -> DataFrame:
    return context.withColumn(
        "trend_verdict",
        trend_verdict(
            F.col("star_count_in_window"),
            F.col("total_events_in_window"),
            F.col("recent_star_rate"),
            F.col("prior_star_rate"),
        ),
    )


def one_decimal(value: Column) -> Column:
    """Half-even to one decimal, always shown."""
    return F.format_string("%.1f", F.bround(value, 1))


def repo_brief(context: DataFrame, as_of: Moment) -> DataFrame:
    """The written report of every repository in the context."""
    text = REPO_BRIEF_TEXTS
    name, days = F.col("repo_full_name"), F.col("window_days")
    stars = tx.grouped(F.col("star_count_in_window"))
    total = tx.grouped(F.col("stargazers_count"))
    events = tx.grouped(F.col("total_events_in_window"))
    actors = tx.grouped(F.col("unique_actors_in_window"))
    language = F.nullif(F.col("primary_language"), F.lit(""))
    category = F.lower(F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("Other")))
    verdict = F.col("trend_verdict")
    dominant, dominant_count = F.col("dominant_event"), tx.grouped(F.col("dominant_count"))
    push_age = F.greatest(
        F.floor((F.unix_timestamp(moment(as_of)) - F.unix_timestamp("github_pushed_at")) / 86400),
        F.lit(0),
    )
    leading = F.when(
        dominant.isNotNull(), F.format_string(text["dominant"], dominant, dominant_count)
    ).otherwise(text["no_dominant"])
    why = (
        F.when(
            verdict == "accelerating",
            F.format_string(
                text["why_accelerating"],
                stars,
                days,
                one_decimal(F.col("recent_star_rate")),
                one_decimal(F.col("prior_star_rate")),
                leading,
            ),
        )
        .when(verdict == "steady", F.format_string(text["why_steady"], events, actors, leading))
        .when(
            verdict == "emerging",
            F.format_string(text["why_emerging"], stars, events, days, leading),
        )
        .otherwise(F.format_string(text["why_quiet"], total, events))
    )
    signals = tx.non_null(
        F.format_string(text["signal_stars"], total, stars, days),
        F.format_string(text["signal_events"], events, actors),
        F.when(
            dominant.isNotNull(), F.format_string(text["signal_dominant"], dominant, dominant_count)
        ),
        F.when(language.isNotNull(), F.format_string(text["signal_language"], language)),
    )
    found = tx.non_null(
        F.when(
            (F.col("unique_actors_in_window") < 20) & (F.col("star_count_in_window") > 0),
            text["watch_breadth"],
        ),
        F.when(push_age > 90, F.format_string(text["watch_push"], push_age)),
        F.when(tx.text_or_empty(F.col("description")) == "", text["watch_sparse"]),
        F.when(F.col("total_events_in_window") == 0, text["watch_no_events"]),
    )
    written = with_trend_verdict(context) if "trend_verdict" not in context.columns else context
    return written.select(
        "repo_full_name",
        "window_days",
        F.lit("template").alias("retrieval_mode"),
        "trend_verdict",
        F.format_string(text["headline"], name, verdict, category, stars, days).alias("headline"),
        F.format_string(
            text["summary"],
            name,
            category,
            F.coalesce(language, F.lit(text["unknown_language"])),
            total,
            events,
            actors,
            days,
        ).alias("summary"),
        why.alias("why_trending"),
        "star_count_in_window",
        "total_events_in_window",
        "unique_actors_in_window",
        "latest_event_at",
        F.slice(signals, 1, 4).alias("key_signals"),
        F.when(F.size(found) > 0, F.slice(found, 1, 3))
        .otherwise(F.array(F.lit(text["watch_none"])))
        .alias("watchouts"),
    )


# --------------------------------------------------------------------------- comparison

# key, shown label, column
METRICS = [
    ("total_stars", "Total Stars", "stargazers_count"),
    ("window_stars", "Stars ({days}d)", "star_count_in_window"),
    ("events", "Events ({days}d)", "total_events_in_window"),
    ("actors", "Unique Actors ({days}d)", "unique_actors_in_window"),
    ("forks", "Forks", "forks_count"),
]


def compare_pair(context: DataFrame, base: str, compare: str) -> DataFrame:
    """Both repositories' contexts side by side in one row, found in one pass."""
    if base.lower() == compare.lower():
        raise ValueError("a comparison needs two different repositories")
    fields = [
        "repo_full_name",
        "category",
        "primary_language",
        "window_days",
        *[column for _, _, column in METRICS],
    ]
    row = F.struct(*fields)
    is_base = F.col("repo_key") == base.lower()
    return (
        context.where(F.col("repo_key").isin(base.lower(), compare.lower()))
        .agg(
            F.max_by(row, F.when(is_base, 1)).alias("base"),
            F.max_by(row, F.when(~is_base, 1)).alias("compare"),
        )
        .where("base IS NOT NULL AND compare IS NOT NULL")
    )


def _winner(base: Column, compare: Column) -> Column:
    return F.when(base == compare, "tie").when(base > compare, "base").otherwise("compare")


def _metric_rows(days: Column) -> Column:
    """The compared numbers as a list of (position, key, label, base, compare, winner)."""
    items = []
    for position, (key, label, column) in enumerate(METRICS, start=1):
        before, _, after = label.partition("{days}")
        shown = F.concat(F.lit(before), days.cast("string"), F.lit(after)) if after else F.lit(label)
        base, compare = F.col(f"base.{column}"), F.col(f"compare.{column}")
        items.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(key).alias("key"),
                shown.alias("label"),
                base.cast("bigint").alias("base_value"),
                compare.cast("bigint").alias("compare_value"),
                _winner(base, compare).alias("winner"),
            )
        )
    return F.array(*items)


def compare_metrics(pair: DataFrame) -> DataFrame:
    return pair.select(F.inline(_metric_rows(F.col("base.window_days"))))


def compare_verdict(pair: DataFrame) -> DataFrame:
    """Overall winner and the written comparison, one row."""
    text = COMPARE_TEXTS
    rows = pair.withColumn("metrics", _metric_rows(F.col("base.window_days")))

    def wins(side: str) -> Column:
        return F.size(F.filter("metrics", lambda m: m.getField("winner") == side))

    base_wins, compare_wins = wins("base"), wins("compare")
    overall = (
        F.when(F.abs(base_wins - compare_wins) <= 1, "tie")
        .when(base_wins > compare_wins, "base")
        .otherwise("compare")
    )
    rows = rows.withColumns(
        {
            "base_wins": base_wins.cast("bigint"),
            "compare_wins": compare_wins.cast("bigint"),
            "overall_winner": overall,
        }
    )
    base, other = F.col("base.repo_full_name"), F.col("compare.repo_full_name")
    tie = F.col("overall_winner") == "tie"
    base_won = F.col("overall_winner") == "base"
    winner = F.when(base_won, F.col("base")).otherwise(F.col("compare"))
    loser = F.when(base_won, F.col("compare")).otherwise(F.col("base"))
    differences = F.transform(
        F.filter(F.slice("metrics", 1, 4), lambda m: m.getField("winner") != "tie"),
        lambda m: F.format_string(
            text["difference"],
            F.when(m.getField("winner") == "base", base).otherwise(other),
            F.lower(m.getField("label")),
            tx.grouped(m.getField("base_value")),
            tx.grouped(m.getField("compare_value")),
        ),
    )
    categories = F.when(
        F.col("base.category") != F.col("compare.category"),
        F.array(
            F.format_string(
                text["difference_category"], F.col("base.category"), F.col("compare.category")
            )
        ),
    ).otherwise(tx.empty_list())

    def choose(side: str, against: str) -> Column:
        language = F.nullif(F.col(f"{side}.primary_language"), F.lit(""))
        lines = tx.non_null(
            F.format_string(
                text["choose"],
                F.col(f"{side}.repo_full_name"),
                F.lower(f"{side}.category"),
                F.coalesce(language, F.lit(text["choose_stack"])),
            ),
            F.when(
                F.col(f"{side}.star_count_in_window") >= F.col(f"{against}.star_count_in_window"),
                F.format_string(text["choose_momentum"], F.col(f"{side}.window_days")),
            ),
            F.when(
                F.col(f"{side}.unique_actors_in_window")
                >= F.col(f"{against}.unique_actors_in_window"),
                text["choose_actors"],
            ),
            F.when(
                F.col(f"{side}.forks_count") >= F.col(f"{against}.forks_count"),
                text["choose_forks"],
            ),
        )
        return F.slice(lines, 1, 3)

    return rows.select(
        base.alias("base_repo"),
        other.alias("compare_repo"),
        F.col("base.window_days").alias("window_days"),
        F.lit("template").alias("retrieval_mode"),
        "base_wins",
        "compare_wins",
        "overall_winner",
        F.when(tie, F.format_string(text["headline_tie"], base, other))
        .otherwise(F.format_string(text["headline"], winner.getField("repo_full_name")))
        .alias("headline"),
        F.when(tie, F.format_string(text["summary_tie"], base, other))
        .otherwise(
            F.format_string(
                text["summary"],
                winner.getField("repo_full_name"),
                tx.grouped(winner.getField("star_count_in_window")),
                tx.grouped(winner.getField("unique_actors_in_window")),
                winner.getField("window_days"),
                loser.getField("repo_full_name"),
            )
        )
        .alias("summary"),
        F.slice(F.concat(differences, categories), 1, 4).alias("key_differences"),
        choose("base", "compare").alias("when_to_choose_base"),
        choose("compare", "base").alias("when_to_choose_compare"),
    )


def momentum_scores(context: DataFrame) -> DataFrame:
    return context.select(
        "repo_full_name",
        "star_count_in_window",
        "stargazers_count",
        scores.momentum(F.col("star_count_in_window"), F.col("stargazers_count")).alias(
            "momentum_score"
        ),
    )
