"""Checks of the aggregations per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwake.checks import check
from starwake.checks.sql import (
    NEWEST_STARS,
    NOW,
    STAR,
    WEEK_START,
    archive_rollup,
    dates,
    previous,
    reclassified,
    rollup,
    window,
)
from starwake.functions.times import in_window, week_start
from starwake.operators import clean as cl
from starwake.operators import rollups as ru
from starwake.testbed import AS_OF, Testbed


@check(
    "daily_star_counts",
    f"SELECT event_date, repo_name, count(*) AS star_count FROM gh WHERE {STAR} GROUP BY ALL",
)
def daily_star_counts(t: Testbed) -> DataFrame:
    return ru.daily_star_counts(t.events())


@check(
    "star_counts_backfill",
    f"""SELECT event_date, repo_name, count(*) FILTER (WHERE {STAR}) AS star_count FROM gh
        GROUP BY ALL HAVING count(*) FILTER (WHERE {STAR}) > 0""",
)
def star_counts_backfill(t: Testbed) -> DataFrame:
    return ru.star_counts_backfill(t.events())


@check(
    "activity_summary",
    f"""SELECT repo_name, event_type, count(*) AS event_count, count(DISTINCT actor_id)
          AS unique_actors, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at,
          {NOW} AS computed_at FROM gh GROUP BY repo_name, event_type""",
)
def activity_summary(t: Testbed) -> DataFrame:
    return ru.activity_summary(t.events(), AS_OF)


@check(
    "window_star_metrics",
    f"""SELECT repo_key, count(*) FILTER (WHERE {STAR}) AS star_count_in_window,
          max(created_at) AS latest_event_at FROM gh WHERE {window(7)} GROUP BY repo_key""",
)
def window_star_metrics(t: Testbed) -> DataFrame:
    return ru.window_star_metrics(t.events(), AS_OF, 7)


MOVERS = f"""
  SELECT repo_key, count(*) FILTER (WHERE {STAR} AND {window(7)}) AS current_star_count,
         count(*) FILTER (WHERE {STAR} AND {previous(7)}) AS previous_star_count,
         count(DISTINCT CASE WHEN {window(7)} THEN actor_login END) AS unique_actors_in_window,
         max(created_at) AS latest_event_at
  FROM gh WHERE {window(14)} GROUP BY repo_key
  HAVING count(*) FILTER (WHERE {STAR} AND {window(7)}) > 0
"""


@check("mover_metrics", MOVERS)
def mover_metrics(t: Testbed) -> DataFrame:
    return ru.mover_metrics(t.events(), AS_OF, 7)


MARKET = f"""
  SELECT repo_key, count(*) FILTER (WHERE {STAR}) AS star_count_in_window,
         count(*) AS total_events_in_window, count(DISTINCT actor_login) AS unique_actors_in_window,
         max(created_at) AS latest_event_at
  FROM gh WHERE {window(30)} GROUP BY repo_key
"""


@check("market_repo_metrics", MARKET)
def market_repo_metrics(t: Testbed) -> DataFrame:
    return ru.market_repo_metrics(t.events(), AS_OF, 30)


RAW_LIST = "SELECT * REPLACE (array_to_string(topics, ',') AS topics) FROM r"


@check("repo_rollup_raw", rollup("r") + RAW_LIST)
def repo_rollup_raw(t: Testbed) -> DataFrame:
    return cl.with_effective_category(ru.repo_rollup_raw(t.events(), AS_OF))


@check(
    "repo_rollup_raw_window",
    rollup("r", window(7), stars=NEWEST_STARS, created=NOW) + RAW_LIST,
)
def repo_rollup_raw_window(t: Testbed) -> DataFrame:
    seen = t.events().where(in_window(F.col("created_at"), AS_OF, 7))
    rows = ru.repo_rollup_raw(seen, AS_OF, highest_stars=False, first_seen=False)
    return cl.with_effective_category(rows)


@check(
    "repo_rollup_raw_conditional",
    rollup("r", star=f"{STAR} AND {window(7)}") + RAW_LIST,
)
def repo_rollup_raw_conditional(t: Testbed) -> DataFrame:
    week = in_window(F.col("created_at"), AS_OF, 7)
    return cl.with_effective_category(ru.repo_rollup_raw(t.events(), AS_OF, window=week))


@check("repo_rollup_archive", archive_rollup("r", dates(7)) + reclassified("r"))
def repo_rollup_archive(t: Testbed) -> DataFrame:
    from starwake.functions.times import in_date_window

    recent = t.events().where(in_date_window(F.col("event_date"), AS_OF, 7))
    return cl.with_effective_category(ru.repo_rollup_archive(recent))


@check(
    "metadata_from_events",
    """, n AS (SELECT * FROM gh QUALIFY row_number() OVER (
                 PARTITION BY repo_id, repo_name ORDER BY created_at DESC, event_id DESC) = 1),
    g AS (SELECT repo_id, repo_name, min(created_at) AS first_at, max(created_at) AS last_at
          FROM gh GROUP BY repo_id, repo_name)
    SELECT repo_id, repo_name AS repo_full_name, split_part(repo_name, '/', 2) AS repo_name,
           repo_stargazers_count AS stargazers_count, repo_primary_language AS primary_language,
           array_to_string(repo_topics, ',') AS topics, repo_description AS description,
           first_at AS github_created_at, last_at AS github_pushed_at, last_at AS refreshed_at,
           'Other' AS category, split_part(repo_name, '/', 1) AS owner_login
    FROM g JOIN n USING (repo_id, repo_name)""",
)
def metadata_from_events(t: Testbed) -> DataFrame:
    return ru.metadata_from_events(t.events()).select(
        "repo_id",
        "repo_full_name",
        "repo_name",
        "stargazers_count",
        "primary_language",
        "topics",
        "description",
        "github_created_at",
        "github_pushed_at",
        "refreshed_at",
        "category",
        "owner_login",
    )


# History: every event and every metadata version is one observation of the star number.
HISTORY = """
, hist AS (
  SELECT repo_key, repo_name AS repo_full_name, created_at AS snapshot_at,
         event_id AS snapshot_key, repo_stargazers_count AS stargazers_count FROM gh
  UNION ALL
  SELECT repo_key, repo_full_name, refreshed_at, 'sync_repo_metadata:' || repo_full_name || ':'
         || strftime(refreshed_at, '%Y-%m-%dT%H:%M:%SZ') || ':'
         || strftime(refreshed_at, '%Y-%m-%dT%H:%M:%SZ'), stargazers_count FROM meta_versions
)
"""


@check(
    "snapshot_as_of",
    HISTORY
    + f""", latest AS (
      SELECT repo_key, stargazers_count FROM hist WHERE snapshot_at < {NOW}
      QUALIFY row_number() OVER (PARTITION BY repo_key
                                 ORDER BY snapshot_at DESC, snapshot_key DESC) = 1),
    before AS (
      SELECT repo_key, stargazers_count FROM hist WHERE snapshot_at < {WEEK_START}
      QUALIFY row_number() OVER (PARTITION BY repo_key
                                 ORDER BY snapshot_at DESC, snapshot_key DESC) = 1),
    first AS (
      SELECT repo_key, stargazers_count FROM hist
      WHERE snapshot_at >= {WEEK_START} AND snapshot_at < {NOW}
      QUALIFY row_number() OVER (PARTITION BY repo_key ORDER BY snapshot_at, snapshot_key) = 1)
    SELECT repo_key, latest.stargazers_count, before.stargazers_count AS baseline_stars,
           first.stargazers_count AS first_week_stars
    FROM latest LEFT JOIN before USING (repo_key) LEFT JOIN first USING (repo_key)""",
)
def snapshot_as_of(t: Testbed) -> DataFrame:
    state = ru.snapshot_as_of(t.history(), AS_OF, week_start(AS_OF))
    return state.select("repo_key", "stargazers_count", "baseline_stars", "first_week_stars")


@check(
    "latest_metadata",
    """SELECT repo_key, repo_id, repo_full_name, stargazers_count, forks_count, category
       FROM meta_versions
       QUALIFY row_number() OVER (PARTITION BY repo_key ORDER BY refreshed_at DESC) = 1""",
)
def latest_metadata(t: Testbed) -> DataFrame:
    columns = ["repo_id", "repo_full_name", "stargazers_count", "forks_count", "category"]
    return ru.latest_metadata(t.metadata(), columns)


@check(
    "sum_star_counts",
    f"""SELECT lower(repo_name) AS repo_key, CAST(sum(star_count) AS BIGINT)
          AS star_count_in_window FROM star_counts WHERE {dates(7)} GROUP BY 1""",
)
def sum_star_counts(t: Testbed) -> DataFrame:
    return ru.sum_star_counts(t.star_counts(), AS_OF, 7)


@check(
    "has_categorised_metadata",
    "SELECT count(*) FILTER (WHERE category <> 'Other') > 0 AS has_categorised FROM meta",
)
def has_categorised_metadata(t: Testbed) -> DataFrame:
    return ru.has_categorised_metadata(t.metadata())
