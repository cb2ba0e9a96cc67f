"""Checks of panels, catalogue planning and maintenance."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwake.checks import check
from starwake.checks.rolling import HISTORY
from starwake.checks.sql import NOW, STAR, dates, window
from starwake.functions.times import in_date_window
from starwake.operators import catalog as ca
from starwake.operators import panels as pa
from starwake.operators import rollups as ru
from starwake.plans import jobs
from starwake.session import fresh_path
from starwake.sources import archive as ar
from starwake.testbed import AS_OF, Testbed


@check(
    "top_repo_days",
    f"""SELECT repo_name, event_date, count(*) AS star_count FROM gh WHERE {STAR} AND {dates(7)}
        GROUP BY ALL ORDER BY star_count DESC, repo_name, event_date LIMIT 20""",
)
def top_repo_days(t: Testbed) -> DataFrame:
    return pa.top_repo_days(t.events(), AS_OF)


@check(
    "event_volume_by_type",
    """SELECT event_type, count(*) AS event_count FROM gh WHERE event_date = DATE '2024-01-15'
       GROUP BY event_type""",
)
def event_volume_by_type(t: Testbed) -> DataFrame:
    return pa.event_volume_on(t.events(), "2024-01-15")


@check(
    "event_volume_recent",
    f"""SELECT event_type, count(*) AS event_count FROM gh WHERE {window(7)} GROUP BY event_type
        ORDER BY event_count DESC, event_type LIMIT 8""",
)
def event_volume_recent(t: Testbed) -> DataFrame:
    return pa.event_volume_recent(t.events(), AS_OF)


@check(
    "event_volume_all_time",
    "SELECT event_type, count(*) AS event_count FROM gh GROUP BY event_type",
)
def event_volume_all_time(t: Testbed) -> DataFrame:
    return pa.event_volume_by_type(t.events())


@check(
    "hourly_activity",
    """SELECT hour(created_at) AS hour, count(*) AS event_count FROM gh
       WHERE event_date = DATE '2024-01-15' AND repo_name = (SELECT key_name FROM repos
                                                             WHERE repo_id = 43) GROUP BY 1""",
)
def hourly_activity(t: Testbed) -> DataFrame:
    return pa.hourly_activity(t.events(), t.lookup_name(43), "2024-01-15")


@check("unique_repos", "SELECT count(DISTINCT repo_name) AS unique_repos FROM gh")
def unique_repos(t: Testbed) -> DataFrame:
    return pa.unique_repos(t.events())


@check(
    "unique_repos_approx",
    """SELECT days, count(DISTINCT repo_name) AS unique_repos, true AS within_bound
       FROM gh, (VALUES (1::BIGINT), (7), (60)) AS windows(days)
       WHERE event_date BETWEEN DATE '2024-01-31' - CAST(days AS INTEGER) AND DATE '2024-01-31' GROUP BY days""",
)
def unique_repos_approx(t: Testbed) -> DataFrame:
    """Windows of days from the sketches that the nightly job stores, each beside the exact number."""
    archive, out = fresh_path(t.spark, "archive"), fresh_path(t.spark, "nightly")
    ar.append_archive(t.events(), archive)
    for on in ("2024-01-08", "2024-01-16", "2024-01-24", "2024-01-31"):
        jobs.nightly_batch(t.spark, archive, out, AS_OF, on)
    sketches = t.spark.read.parquet(f"{out}/repo_sketches")
    whole = None
    for days in (1, 7, 60):
        recent = t.events().where(in_date_window(F.col("event_date"), AS_OF, days))
        exact = pa.unique_repos(recent).select(F.lit(days).cast("bigint").alias("days"), "unique_repos")
        guess = pa.unique_repos_approx(sketches, AS_OF, days).scalar()
        near = F.abs(guess - F.col("unique_repos")) <= F.greatest(0.05 * F.col("unique_repos"), F.lit(1.0))
        row = exact.withColumn("within_bound", near)
        whole = row if whole is None else whole.unionByName(row)
    return whole


@check(
    "top_starred_snapshot",
    """, l AS (SELECT repo_name, repo_primary_language AS language, count(*) AS n FROM gh
               WHERE repo_primary_language IS NOT NULL GROUP BY 1, 2
               QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, language) = 1),
    d AS (SELECT repo_name, repo_description AS description, count(*) AS n FROM gh
          WHERE repo_description IS NOT NULL GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY n DESC, description) = 1),
    s AS (SELECT repo_name, max(repo_stargazers_count) AS stars FROM gh GROUP BY repo_name)
    SELECT repo_name, stars, 0::BIGINT AS forks, language, 'Other' AS category, description
    FROM s JOIN l USING (repo_name) JOIN d USING (repo_name) ORDER BY stars DESC, repo_name LIMIT 20
    """,
)
def top_starred_snapshot(t: Testbed) -> DataFrame:
    return pa.top_starred_snapshot(t.events())


@check(
    "data_freshness",
    f"""SELECT max(created_at) AS latest_event_at,
          CAST(floor(epoch(max(created_at))) AS BIGINT) AS latest_epoch,
          CAST(epoch({NOW}) - floor(epoch(max(created_at))) AS BIGINT) AS age_seconds,
          epoch({NOW}) - floor(epoch(max(created_at))) > 300 AS is_stale,
          epoch({NOW}) - floor(epoch(max(created_at))) > 600 AS alert,
          CASE WHEN epoch({NOW}) - floor(epoch(max(created_at))) <= 300 THEN 'healthy'
               ELSE 'degraded' END AS status FROM gh""",
)
def data_freshness(t: Testbed) -> DataFrame:
    return pa.data_freshness(t.events(), AS_OF)


@check(
    "event_totals",
    f"""SELECT count(*) AS total_events, count(*) FILTER (WHERE created_at >= {NOW}
          - INTERVAL 24 HOUR AND created_at < {NOW}) AS events_last_24h FROM gh""",
)
def event_totals(t: Testbed) -> DataFrame:
    return pa.event_totals(t.events(), AS_OF)


@check(
    "events_per_hour",
    """SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_start, event_type,
              count(*) AS event_count FROM gh GROUP BY ALL""",
)
def events_per_hour(t: Testbed) -> DataFrame:
    return pa.events_per_hour(t.events())


@check(
    "events_per_hour_total",
    """SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS hour_start,
              count(*) AS event_count FROM gh GROUP BY ALL""",
)
def events_per_hour_total(t: Testbed) -> DataFrame:
    return pa.events_per_hour(t.events(), by_type=False)


@check(
    "daily_stars_all_repos",
    f"""SELECT event_date, repo_name, count(*) FILTER (WHERE {STAR}) AS stars FROM gh
        GROUP BY event_date, repo_name""",
)
def daily_stars_all_repos(t: Testbed) -> DataFrame:
    return pa.daily_stars_all_repos(t.events())


@check(
    "top_repos_by_activity",
    """SELECT repo_name, count(*) AS event_count FROM gh GROUP BY repo_name
       ORDER BY event_count DESC, repo_name LIMIT 15""",
)
def top_repos_by_activity(t: Testbed) -> DataFrame:
    return pa.top_repos_by_activity(t.events())


@check(
    "top_repos_by_activity_recent",
    f"""SELECT repo_name, count(*) AS event_count FROM gh WHERE {window(30)} GROUP BY repo_name
        ORDER BY event_count DESC, repo_name LIMIT 100""",
)
def top_repos_by_activity_recent(t: Testbed) -> DataFrame:
    return pa.top_repos_by_activity(t.events(), 100, AS_OF, 30)


@check(
    "language_repo_counts",
    """SELECT repo_primary_language AS language, count(DISTINCT repo_name) AS repo_count FROM gh
       WHERE repo_primary_language <> '' GROUP BY 1 ORDER BY repo_count DESC, language LIMIT 15""",
)
def language_repo_counts(t: Testbed) -> DataFrame:
    return pa.language_repo_counts(t.events())


@check(
    "category_repo_counts",
    "SELECT 'Other' AS category, count(DISTINCT repo_name) AS repo_count FROM gh",
)
def category_repo_counts(t: Testbed) -> DataFrame:
    return pa.category_repo_counts(t.events())


@check(
    "table_health",
    """SELECT 'events' AS "check", count(*) AS row_count, 'ok' AS status FROM gh
       UNION ALL SELECT 'repo_metadata', count(*), 'ok' FROM meta_versions
       UNION ALL SELECT 'repo_metadata_history', (SELECT count(*) FROM gh)
                        + (SELECT count(*) FROM meta_versions), 'ok'
       UNION ALL SELECT 'repo_star_counts', count(*), 'ok' FROM star_counts
       UNION ALL SELECT 'repo_activity_summary', NULL, 'degraded'""",
)
def table_health(t: Testbed) -> DataFrame:
    return pa.table_health(
        {
            "events": t.events(),
            "repo_metadata": t.metadata(),
            "repo_metadata_history": t.history(),
            "repo_star_counts": t.star_counts(),
            "repo_activity_summary": None,
        }
    )


@check(
    "partition_health",
    f"""SELECT max(event_date) AS latest_date, CASE WHEN max(event_date) >= CAST({NOW} AS DATE) - 1
          THEN 'ok' ELSE 'degraded' END AS status FROM gh""",
)
def partition_health(t: Testbed) -> DataFrame:
    return pa.partition_health(t.events(), AS_OF)


# --------------------------------------------------------------------------- catalogue

MIN_STARS, START, TODAY = 100, date(2008, 1, 1), date(2022, 1, 1)


def _shard_size(t: Testbed) -> int:
    return 20


# The shards by following the rule step by step: halve the stars, then the days, while too full.
SHARDS = f"""
, catalogue AS (SELECT repo_full_name, stargazers_count AS s,
                       CAST(github_created_at AS DATE) - DATE '1970-01-01' AS d FROM meta),
walk AS (
  WITH RECURSIVE steps(lo, hi, dlo, dhi, n) AS (
    SELECT {MIN_STARS}::BIGINT, (SELECT max(s) FROM catalogue),
           (DATE '{START}' - DATE '1970-01-01')::BIGINT, (DATE '{TODAY}' - DATE '1970-01-01')::BIGINT,
           (SELECT count(*) FROM catalogue WHERE s >= {MIN_STARS})
    UNION ALL
    SELECT c.lo, c.hi, c.dlo, c.dhi,
           (SELECT count(*) FROM catalogue WHERE s BETWEEN c.lo AND c.hi
              AND d BETWEEN c.dlo AND c.dhi)
    FROM (
      SELECT lo, (lo + hi) // 2 AS hi, dlo, dhi FROM steps WHERE n > 20 AND lo < hi
      UNION ALL SELECT (lo + hi) // 2 + 1, hi, dlo, dhi FROM steps WHERE n > 20 AND lo < hi
      UNION ALL SELECT lo, hi, dlo, dlo + (dhi - dlo) // 2 FROM steps
                WHERE n > 20 AND lo = hi AND dlo < dhi
      UNION ALL SELECT lo, hi, dlo + (dhi - dlo) // 2 + 1, dhi FROM steps
                WHERE n > 20 AND lo = hi AND dlo < dhi) c)
  SELECT * FROM steps WHERE n > 0 AND (n <= 20 OR (lo = hi AND dlo = dhi))),
shards AS (
  SELECT lo AS min_stars, hi AS max_stars, DATE '1970-01-01' + CAST(dlo AS INTEGER)
           AS created_after, DATE '1970-01-01' + CAST(dhi AS INTEGER) AS created_before,
         n AS matched_count, n > 20 AS too_large FROM walk)
"""


def _assigned(t: Testbed) -> DataFrame:
    latest = ru.latest_metadata(
        t.metadata(), ["repo_full_name", "stargazers_count", "github_created_at"]
    )
    return ca.assign_catalog_shards(latest, MIN_STARS, _shard_size(t), START, TODAY)


@check("plan_catalog_shards", SHARDS + "SELECT * FROM shards")
def plan_catalog_shards(t: Testbed) -> DataFrame:
    latest = ru.latest_metadata(t.metadata(), ["stargazers_count", "github_created_at"])
    return ca.plan_catalog_shards(latest, MIN_STARS, _shard_size(t), START, TODAY)


@check(
    "catalog_candidates",
    SHARDS
    + """, hits AS (
      SELECT repo_full_name AS full_name, s AS stargazers_count,
             'stars:' || min_stars || '..' || max_stars || ' created:' || created_after || '..'
               || created_before AS source_shards
      FROM catalogue JOIN shards ON s BETWEEN min_stars AND max_stars
        AND DATE '1970-01-01' + CAST(d AS INTEGER) BETWEEN created_after AND created_before)
    SELECT full_name, 'https://github.com/' || full_name AS html_url, stargazers_count,
           source_shards,
           row_number() OVER (ORDER BY stargazers_count DESC, full_name) AS rank FROM hits""",
)
def catalog_candidates(t: Testbed) -> DataFrame:
    latest = ru.latest_metadata(
        t.metadata(), ["repo_full_name", "html_url", "stargazers_count", "github_created_at"]
    )
    items = ca.shard_items(latest, _assigned(t)).select(
        "repo_full_name",
        "html_url",
        F.col("stars").alias("stargazers_count"),
        F.struct("min_stars", "created_after", "repo_full_name").alias("position"),
        "shard",
    )
    return ca.rank_candidates(ca.catalog_candidates(items))


@check(
    "repo_summary_report",
    """SELECT repo_full_name, description, primary_language, array_to_string(topics, ',') AS topics,
         stargazers_count, forks_count, subscribers_count, network_count, open_issues_count,
         'MIT' AS license_spdx_id, false AS is_archived, github_pushed_at, refreshed_at,
         'https://github.com/' || repo_full_name AS html_url,
         row_number() OVER (ORDER BY stargazers_count DESC, repo_full_name) AS rank FROM meta""",
)
def repo_summary_report(t: Testbed) -> DataFrame:
    return ca.repo_summary_report(t.metadata())


# --------------------------------------------------------------------------- maintenance


@check(
    "compact_latest",
    HISTORY
    + """, distinct_history AS (SELECT DISTINCT repo_full_name, snapshot_at, snapshot_key FROM hist)
    SELECT 'repo_metadata' AS table_name, count(*) AS row_count FROM meta
    UNION ALL SELECT 'repo_metadata_history', count(*) FROM distinct_history
    UNION ALL SELECT 'repo_star_counts', count(*) FROM star_counts
    UNION ALL SELECT 'repo_activity_summary', count(*)
              FROM (SELECT DISTINCT repo_name, event_type FROM gh)""",
)
def compact_latest(t: Testbed) -> DataFrame:
    """Every table is given twice, as after a repeated load."""
    summary = ru.activity_summary(t.events(), AS_OF)
    compacted = jobs.compact_latest(
        t.metadata(),
        t.history().unionByName(t.history()),
        t.star_counts().unionByName(t.star_counts()),
        summary.unionByName(summary),
    )
    return jobs.compaction_report(compacted)
