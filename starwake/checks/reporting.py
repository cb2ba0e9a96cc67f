"""Checks of dashboard reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwake.checks import check
from starwake.checks.rolling import HISTORY, MOVERS
from starwake.checks.sql import (
    EFFECTIVE,
    NEWEST_STARS,
    NOW,
    STAR,
    WEEK_START,
    archive_rollup,
    dates,
    meta_row,
    previous,
    reclassified,
    rollup,
    window,
)
from starwake.operators import reports as rp
from starwake.operators.ranking import rank_all
from starwake.plans.dashboard import Dashboard
from starwake.schemas import HEADLINES
from starwake.testbed import AS_OF, Testbed

RECENT = "star_count_in_window DESC, stargazers_count DESC, repo_full_name"
METRICS = f"""
, metrics AS (SELECT repo_key, count(*) FILTER (WHERE {STAR}) AS star_count_in_window,
                     max(created_at) AS latest_event_at
              FROM gh WHERE {window(7)} GROUP BY repo_key)
"""
PUSHED = "greatest(github_pushed_at, coalesce(latest_event_at, github_pushed_at))"


@check(
    "top_repos",
    METRICS
    + f"""SELECT {meta_row(PUSHED)}, star_count_in_window FROM meta JOIN metrics USING (repo_key)
          ORDER BY {RECENT} LIMIT 20""",
)
def top_repos(t: Testbed) -> DataFrame:
    return rp.top_repos(t.metadata(), t.events(), AS_OF)


@check(
    "top_repos_category",
    METRICS
    + f"""SELECT {meta_row(PUSHED)}, star_count_in_window FROM meta JOIN metrics USING (repo_key)
          WHERE {EFFECTIVE} = 'Agent' ORDER BY {RECENT} LIMIT 20""",
)
def top_repos_category(t: Testbed) -> DataFrame:
    return rp.top_repos(t.metadata(), t.events(), AS_OF, category="Agent")


@check(
    "top_repos_raw",
    rollup("r", window(7), stars=NEWEST_STARS, created=NOW)
    + f"""SELECT * REPLACE (array_to_string(topics, ',') AS topics) FROM r
          WHERE category <> 'Other' OR NOT EXISTS (SELECT 1 FROM r WHERE category <> 'Other')
          ORDER BY {RECENT} LIMIT 20""",
)
def top_repos_raw(t: Testbed) -> DataFrame:
    return rp.top_repos_from_events(t.events(), AS_OF)


@check(
    "top_repos_archive",
    archive_rollup("r", dates(7)) + f"{reclassified('r')} ORDER BY {RECENT} LIMIT 20",
)
def top_repos_archive(t: Testbed) -> DataFrame:
    return rp.top_repos_from_archive(t.events(), AS_OF)


@check(
    "top_repos_left",
    f""", sums AS (SELECT lower(repo_name) AS repo_key, CAST(sum(star_count) AS BIGINT) AS n
                   FROM star_counts WHERE {dates(7)} GROUP BY 1)
    SELECT repo_id, repo_full_name, category, stargazers_count, network_count, refreshed_at,
           coalesce(n, 0) AS star_count_in_window
    FROM meta LEFT JOIN sums USING (repo_key) WHERE category = 'Agent'
    ORDER BY star_count_in_window DESC, repo_full_name LIMIT 20""",
)
def top_repos_left(t: Testbed) -> DataFrame:
    rows = rp.top_repos_left(t.metadata(), t.star_counts(), AS_OF, category="Agent")
    return rows.select(
        "repo_id",
        "repo_full_name",
        "category",
        "stargazers_count",
        "network_count",
        "refreshed_at",
        "star_count_in_window",
    )


@check(
    "top_starred_repos",
    f"""SELECT {meta_row()}, 0::BIGINT AS star_count_in_window FROM meta
        ORDER BY stargazers_count DESC, repo_full_name LIMIT 20""",
)
def top_starred_repos(t: Testbed) -> DataFrame:
    return rp.top_starred_repos(t.metadata())


@check(
    "top_starred_raw",
    rollup("r")
    + """SELECT * REPLACE (array_to_string(topics, ',') AS topics, 0::BIGINT AS star_count_in_window)
         FROM r ORDER BY stargazers_count DESC, repo_full_name LIMIT 20""",
)
def top_starred_raw(t: Testbed) -> DataFrame:
    return rp.top_starred_from_events(t.events(), AS_OF)


@check(
    "top_starred_archive",
    archive_rollup("r", star="FALSE")
    + f"{reclassified('r')} ORDER BY stargazers_count DESC, repo_full_name LIMIT 20",
)
def top_starred_archive(t: Testbed) -> DataFrame:
    return rp.top_starred_from_archive(t.events())


GROWTH = (
    HISTORY
    + f""", latest AS (
      SELECT repo_key, arg_max(stargazers_count, (snapshot_at, snapshot_key)) AS stars,
             arg_max(repo_full_name, (snapshot_at, snapshot_key)) AS name
      FROM hist WHERE snapshot_at < {NOW} GROUP BY 1),
    before AS (
      SELECT repo_key, arg_max(stargazers_count, (snapshot_at, snapshot_key)) AS stars
      FROM hist WHERE snapshot_at < {WEEK_START} GROUP BY 1),
    first AS (
      SELECT repo_key, arg_min(stargazers_count, (snapshot_at, snapshot_key)) AS stars
      FROM hist WHERE snapshot_at >= {WEEK_START} AND snapshot_at < {NOW} GROUP BY 1),
    growth AS (
      SELECT name AS repo_full_name, latest.stars AS stargazers_count,
             greatest(latest.stars - coalesce(before.stars, first.stars, latest.stars), 0)
               AS star_count_in_window
      FROM latest LEFT JOIN before USING (repo_key) LEFT JOIN first USING (repo_key))
    """
)


@check(
    "trending_week",
    GROWTH
    + f"""SELECT *, row_number() OVER (ORDER BY {RECENT}) AS growth_rank FROM growth
          WHERE star_count_in_window > 0 ORDER BY {RECENT} LIMIT 20""",
)
def trending_week(t: Testbed) -> DataFrame:
    return rp.trending_week(t.history(), AS_OF).select(
        "repo_full_name", "stargazers_count", "star_count_in_window", "growth_rank"
    )


@check("weekly_growth", GROWTH + "SELECT * FROM growth")
def weekly_growth(t: Testbed) -> DataFrame:
    return rp.weekly_growth(t.history(), AS_OF).select(
        "repo_full_name", "stargazers_count", "star_count_in_window"
    )


@check(
    "trending_raw",
    rollup(
        "r",
        f"created_at >= {WEEK_START} AND created_at < {NOW}",
        stars=NEWEST_STARS,
        created=NOW,
    )
    + f"""SELECT * REPLACE (array_to_string(topics, ',') AS topics),
                 row_number() OVER (ORDER BY {RECENT}) AS growth_rank
          FROM r ORDER BY {RECENT} LIMIT 20""",
)
def trending_raw(t: Testbed) -> DataFrame:
    return rp.trending_from_events(t.events(), AS_OF)


@check(
    "trending_archive",
    archive_rollup("r", f"created_at >= {WEEK_START} AND created_at < {NOW}")
    + f""", c AS ({reclassified("r")})
    SELECT *, row_number() OVER (ORDER BY {RECENT}) AS growth_rank FROM c
    WHERE star_count_in_window > 0 ORDER BY {RECENT} LIMIT 20""",
)
def trending_archive(t: Testbed) -> DataFrame:
    return rp.trending_from_archive(t.events(), AS_OF)


RATIOS = """
  CAST(round_even(CAST(CAST(star_count_in_window AS DOUBLE)
             / greatest(stargazers_count - star_count_in_window, 1) * 100 AS DECIMAL(38, 18)), 2) AS DOUBLE)
    AS weekly_percent_gain,
  CAST(round_even(CAST(CAST(star_count_in_window AS DOUBLE) / greatest(previous_star_count_in_window, 1) AS DECIMAL(38, 18)), 4) AS DOUBLE)
    AS window_over_window_ratio
"""
MOVER_ROWS = f"""
, m AS ({MOVERS}),
joined AS (
  SELECT {meta_row(PUSHED, rank="")}, current_star_count AS star_count_in_window,
         previous_star_count AS previous_star_count_in_window, unique_actors_in_window
  FROM meta JOIN m USING (repo_key)),
movers AS (SELECT *, {RATIOS} FROM joined)
"""
ABSOLUTE = "star_count_in_window DESC, unique_actors_in_window DESC, stargazers_count DESC, repo_full_name"
RELATIVE = (
    "weekly_percent_gain DESC, star_count_in_window DESC, unique_actors_in_window DESC, "
    "repo_full_name"
)
BASELINE = "greatest(stargazers_count - star_count_in_window, 0) >= 1000"


@check("mover_ratios", MOVER_ROWS + "SELECT * FROM movers")
def mover_ratios(t: Testbed) -> DataFrame:
    return rp.movers(t.metadata(), t.events(), AS_OF).drop("rank")


@check(
    "shock_movers",
    MOVER_ROWS
    + f"""(SELECT *, row_number() OVER (ORDER BY {ABSOLUTE}) AS rank, 'absolute' AS list
           FROM movers ORDER BY {ABSOLUTE} LIMIT 6)
          UNION ALL BY NAME
          (SELECT *, row_number() OVER (ORDER BY {RELATIVE}) AS rank, 'percentage' AS list
           FROM movers WHERE {BASELINE} ORDER BY {RELATIVE} LIMIT 6)""",
)
def shock_movers(t: Testbed) -> DataFrame:
    return rp.shock_movers(t.metadata(), t.events(), AS_OF)


@check(
    "shock_movers_raw",
    rollup("r", window(14), star=f"{STAR} AND {window(7)}")
    + f""", m AS ({MOVERS}),
    joined AS (
      SELECT r.* EXCLUDE (rank) REPLACE (array_to_string(topics, ',') AS topics),
             previous_star_count AS previous_star_count_in_window, unique_actors_in_window
      FROM r JOIN m ON m.repo_key = r.repo_full_name),
    movers AS (SELECT *, {RATIOS} FROM joined)
    SELECT *, row_number() OVER (ORDER BY {RELATIVE}) AS rank FROM movers WHERE {BASELINE}
    ORDER BY {RELATIVE} LIMIT 12""",
)
def shock_movers_raw(t: Testbed) -> DataFrame:
    return rp.percentage_movers(rp.movers_from_events(t.events(), AS_OF), 12)


def _exploded(where: str) -> str:
    return f"(SELECT * EXCLUDE (repo_topics), unnest(repo_topics) AS topic FROM gh WHERE {where})"


@check(
    "topic_breakdown",
    f"""SELECT topic, count(*) FILTER (WHERE {STAR}) AS event_count, count(DISTINCT repo_name)
          AS repo_count FROM {_exploded(window(7))} WHERE topic <> '' GROUP BY topic
        HAVING event_count > 0 ORDER BY event_count DESC, topic LIMIT 30""",
)
def topic_breakdown(t: Testbed) -> DataFrame:
    return rp.topic_breakdown(t.events(), AS_OF)


@check(
    "topic_breakdown_archive",
    f"""SELECT topic, count(*) FILTER (WHERE {STAR}) AS event_count, count(DISTINCT repo_name)
          AS repo_count FROM {_exploded(dates(7))} WHERE topic <> '' GROUP BY topic
        HAVING event_count > 0 ORDER BY event_count DESC, topic LIMIT 30""",
)
def topic_breakdown_archive(t: Testbed) -> DataFrame:
    return rp.topic_breakdown(t.events(), AS_OF, mode="date")


LANGUAGES = f"""
  SELECT repo_primary_language AS language, count(*) FILTER (WHERE {STAR}) AS event_count,
         count(DISTINCT repo_name) AS repo_count FROM gh
  WHERE {window(7)} AND repo_primary_language <> '' GROUP BY 1 HAVING event_count > 0
  ORDER BY event_count DESC, language LIMIT 20
"""


@check("language_breakdown", LANGUAGES)
def language_breakdown(t: Testbed) -> DataFrame:
    return rp.language_breakdown(t.events(), AS_OF)


@check(
    "language_breakdown_archive",
    LANGUAGES.replace(window(7), dates(7)),
)
def language_breakdown_archive(t: Testbed) -> DataFrame:
    return rp.language_breakdown(t.events(), AS_OF, mode="date")


ROTATION = f"""
, counts AS (
  SELECT topic, count(*) FILTER (WHERE {STAR} AND {window(7)}) AS current_star_count,
         count(*) FILTER (WHERE {STAR} AND {previous(7)}) AS previous_star_count,
         count(DISTINCT CASE WHEN {window(7)} THEN repo_name END) AS repo_count
  FROM {_exploded(window(14))} WHERE topic <> '' GROUP BY topic),
rotation AS (
  SELECT *, current_star_count - previous_star_count AS star_delta,
         row_number() OVER (ORDER BY current_star_count - previous_star_count DESC,
                            current_star_count DESC, repo_count DESC, topic) AS rank
  FROM counts WHERE current_star_count > 0
  ORDER BY rank LIMIT 10)
"""


@check("topic_rotation", ROTATION + "SELECT * FROM rotation")
def topic_rotation(t: Testbed) -> DataFrame:
    return rp.topic_rotation(t.events(), AS_OF)


@check(
    "rotation_bar",
    ROTATION
    + """SELECT topic, star_delta, CAST(greatest(12, least(100,
           floor(CAST(star_delta AS DOUBLE) / current_star_count * 100 + 0.5))) AS BIGINT)
             AS bar_width FROM rotation""",
)
def rotation_bar(t: Testbed) -> DataFrame:
    rows = rp.rotation_bar(rp.topic_rotation(t.events(), AS_OF))
    return rows.select("topic", "star_delta", "bar_width")


@check(
    "bar_scaling",
    f""", l AS ({LANGUAGES})
    SELECT *, CAST(floor(CAST(event_count AS DOUBLE) / greatest((SELECT max(event_count) FROM l), 1)
                         * 100 + 0.5) AS BIGINT) AS percent_of_max FROM l""",
)
def bar_scaling(t: Testbed) -> DataFrame:
    return rp.bar_scaling(rp.language_breakdown(t.events(), AS_OF), "event_count")


@check(
    "language_share_top8",
    f""", l AS ({LANGUAGES}),
    p AS (SELECT *, row_number() OVER (ORDER BY event_count DESC, language) <= 3 AS shown FROM l),
    s AS (SELECT CASE WHEN shown THEN language ELSE 'Other' END AS name, shown,
                 CAST(sum(event_count) AS BIGINT) AS value,
                 CAST(sum(CASE WHEN shown THEN repo_count ELSE 0 END) AS BIGINT) AS repos
          FROM p GROUP BY 1, 2)
    SELECT name, value, repos, CAST(floor(CAST(value AS DOUBLE) / (SELECT sum(value) FROM s) * 100
             + 0.5) AS BIGINT) AS percent FROM s WHERE value > 0""",
)
def language_share_top8(t: Testbed) -> DataFrame:
    """The test data has few languages, so three are kept to see the slice for the rest."""
    return rp.language_share(rp.language_breakdown(t.events(), AS_OF), keep=3)


SERIES = f"""
  SELECT event_date, count(*) FILTER (WHERE {STAR}) AS star_count, count(*) AS total_events
  FROM gh WHERE repo_id = 43 AND {window(30)} GROUP BY event_date
"""


@check("repo_timeseries", SERIES)
def repo_timeseries(t: Testbed) -> DataFrame:
    return rp.repo_timeseries(t.events(), t.lookup_name(43).upper(), AS_OF)


@check("repo_timeseries_archive", SERIES.replace(window(30), dates(20)))
def repo_timeseries_archive(t: Testbed) -> DataFrame:
    return rp.repo_timeseries(t.events(), t.lookup_name(43), AS_OF, 20, mode="date")


def _summary(source: str, extra: str = "") -> str:
    return f"""
    SELECT category, count(*) AS repo_count, CAST(sum(stargazers_count) AS BIGINT) AS total_stars,
           first(repo_full_name ORDER BY stargazers_count DESC, repo_full_name) AS top_repo_name,
           max(stargazers_count) AS top_repo_stars,
           CAST(coalesce(sum(star_count_in_window), 0) AS BIGINT) AS weekly_star_delta
    FROM {source} {extra} GROUP BY category
    """


@check("category_summary", METRICS + _summary("meta LEFT JOIN metrics USING (repo_key)"))
def category_summary(t: Testbed) -> DataFrame:
    return rp.category_summary(t.metadata(), t.events(), AS_OF)


@check(
    "category_summary_counts",
    f""", metrics AS (SELECT lower(repo_name) AS repo_key, sum(star_count) AS star_count_in_window
                      FROM star_counts WHERE {dates(7)} GROUP BY 1)"""
    + _summary("meta LEFT JOIN metrics USING (repo_key)"),
)
def category_summary_counts(t: Testbed) -> DataFrame:
    return rp.category_summary_from_counts(t.metadata(), t.star_counts(), AS_OF)


@check(
    "category_summary_raw",
    rollup("r", star=f"{STAR} AND {window(7)}")
    + _summary("r", "WHERE star_count_in_window > 0 AND category <> 'Other'"),
)
def category_summary_raw(t: Testbed) -> DataFrame:
    return rp.category_summary_from_events(t.events(), AS_OF)


@check(
    "category_summary_per_event",
    f"""SELECT 'Other' AS category, count(DISTINCT repo_name) AS repo_count,
          CAST(sum(repo_stargazers_count) AS BIGINT) AS total_stars,
          first(repo_name ORDER BY repo_stargazers_count DESC, repo_name) AS top_repo_name,
          max(repo_stargazers_count) AS top_repo_stars,
          count(*) FILTER (WHERE {STAR}) AS weekly_star_delta FROM gh WHERE {window(7)}""",
)
def category_summary_per_event(t: Testbed) -> DataFrame:
    return rp.category_summary_per_event(t.events(), AS_OF)


@check(
    "category_summary_archive",
    f""", per_repo AS (
      SELECT repo_name, max(repo_stargazers_count) AS stars,
             count(*) FILTER (WHERE {STAR} AND event_date >= CAST({NOW} AS DATE) - 7) AS weekly
      FROM gh GROUP BY repo_name)
    SELECT 'Other' AS category, count(*) AS repo_count, CAST(sum(stars) AS BIGINT) AS total_stars,
           first(repo_name ORDER BY stars DESC, repo_name) AS top_repo_name,
           max(stars) AS top_repo_stars, CAST(sum(weekly) AS BIGINT) AS weekly_star_delta
    FROM per_repo""",
)
def category_summary_archive(t: Testbed) -> DataFrame:
    return rp.category_summary_from_archive(t.events(), AS_OF)


@check(
    "headline_totals",
    METRICS
    + f""", s AS ({_summary("meta LEFT JOIN metrics USING (repo_key)")})
    SELECT CAST(sum(repo_count) AS BIGINT) AS repo_count,
           CAST(sum(total_stars) AS BIGINT) AS total_stars,
           CAST(sum(weekly_star_delta) AS BIGINT) AS weekly_star_delta FROM s""",
)
def headline_totals(t: Testbed) -> DataFrame:
    return rp.headline_totals(rp.category_summary(t.metadata(), t.events(), AS_OF))


@check(
    "repos_to_enrich",
    f""", active AS (SELECT repo_key, count(*) AS event_count FROM gh WHERE {window(30)} GROUP BY 1)
    SELECT * FROM active WHERE repo_key NOT IN (SELECT repo_key FROM meta)
    ORDER BY event_count DESC, repo_key LIMIT 100""",
)
def repos_to_enrich(t: Testbed) -> DataFrame:
    return rp.repos_to_enrich(t.events(), t.metadata(), AS_OF)


@check(
    "enrich_events",
    """SELECT event_id, gh.repo_name, coalesce(stargazers_count, 0) AS repo_stargazers_count,
              coalesce(primary_language, '') AS repo_primary_language,
              array_to_string(coalesce(topics, []::VARCHAR[]), ',') AS repo_topics,
              coalesce(description, '') AS repo_description,
              meta.repo_key IS NULL AS metadata_missing
       FROM gh LEFT JOIN meta ON gh.repo_key = meta.repo_key""",
)
def enrich_events(t: Testbed) -> DataFrame:
    return rp.enrich_events(t.events(), t.metadata()).select(
        "event_id",
        "repo_name",
        "repo_stargazers_count",
        "repo_primary_language",
        "repo_topics",
        "repo_description",
        "metadata_missing",
    )


def _headlines(t: Testbed) -> DataFrame:
    """Web pages as headlines: the page number picks the repository, the title may be blank."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = t.table("pages").select(
        (F.col("page_id") % 100).alias("p_partkey"),
        F.col("page_id").cast("int").alias("position"),
        title.alias("title"),
        "url",
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("parsed_url"),
    )
    named = pages.join(t.repos().select("p_partkey", "key_name"), "p_partkey")
    known = {
        "repo_full_name": F.col("key_name"),
        "position": F.col("position"),
        "title": F.col("title"),
        "url": F.col("url"),
        "parsed_url": F.col("parsed_url"),
    }
    return named.select(
        *[
            known.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in HEADLINES
        ]
    )


@check(
    "news_radar",
    MOVER_ROWS
    + f""", picked AS (SELECT *, row_number() OVER (ORDER BY {RELATIVE}) AS rank FROM movers
                       WHERE {BASELINE} ORDER BY rank LIMIT 8),
    heads AS (
      SELECT key_name AS repo_key, page_id, trim(url) AS url,
             row_number() OVER (PARTITION BY key_name ORDER BY page_id) AS place
      FROM (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title
            FROM pages) JOIN repos ON p_partkey = page_id % 100
      WHERE title <> '' AND trim(url) <> '')
    SELECT repo_full_name, category, star_count_in_window, weekly_percent_gain, rank,
           (SELECT count(*) FROM heads WHERE repo_key = lower(repo_full_name) AND place <= 3)
             AS headline_count,
           coalesce((SELECT string_agg(url, ' ' ORDER BY place) FROM heads
                     WHERE repo_key = lower(repo_full_name) AND place <= 3), '') AS urls
    FROM picked""",
)
def news_radar(t: Testbed) -> DataFrame:
    movers = rp.percentage_movers(rp.movers(t.metadata(), t.events(), AS_OF), 8)
    radar = rp.news_radar(movers, _headlines(t))
    return radar.select(
        "repo_full_name",
        "category",
        "star_count_in_window",
        "weekly_percent_gain",
        "rank",
        F.size("headlines").alias("headline_count"),
        F.array_join(F.transform("headlines", lambda h: h.getField("url")), " ").alias("urls"),
    )


@check(
    "rank_results",
    """SELECT repo_full_name, stargazers_count,
              row_number() OVER (ORDER BY stargazers_count DESC, repo_full_name) AS rank
       FROM meta""",
)
def rank_results(t: Testbed) -> DataFrame:
    from starwake.operators.rollups import latest_metadata

    rows = latest_metadata(t.metadata(), ["repo_full_name", "stargazers_count"]).drop("repo_key")
    return rank_all(rows, [F.desc("stargazers_count"), F.asc("repo_full_name")])


@check(
    "first_non_empty",
    rollup("r", window(7), stars=NEWEST_STARS, created=NOW)
    + f"""SELECT repo_full_name, category, star_count_in_window FROM r WHERE category = 'DataEng'
          ORDER BY {RECENT} LIMIT 20""",
)
def first_non_empty(t: Testbed) -> DataFrame:
    """No metadata row survives the filter, so the report falls back to the events."""
    nothing = t.metadata().where(F.col("stargazers_count") < 0)
    board = Dashboard(events=t.events(), metadata=nothing, archive=t.events())
    found = board.top_repos(AS_OF, category="DataEng")
    return found.select("repo_full_name", "category", "star_count_in_window")


