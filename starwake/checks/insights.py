"""Checks of the market and repository reports and of comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwake.checks import check
from starwake.checks.rolling import MARKET
from starwake.checks.sql import EFFECTIVE, STAR, meta_row, rollup, window
from starwake.functions.times import in_window
from starwake.operators import insight as ins
from starwake.operators import market as mk
from starwake.operators import reports as rp
from starwake.operators import rollups as ru
from starwake.testbed import AS_OF, Testbed

ORDER = "star_count_in_window DESC, total_events_in_window DESC, stargazers_count DESC, repo_full_name"
MOMENTUM = (
    "CAST(round_even(CAST(CAST(star_count_in_window AS DOUBLE) / greatest(stargazers_count, 1) AS DECIMAL(38, 18)), 4) AS DOUBLE) "
    "AS momentum_score"
)
BREAKOUTS = f"""
, m AS ({MARKET}),
breakouts AS (
  SELECT {meta_row()}, star_count_in_window, total_events_in_window, unique_actors_in_window,
         {MOMENTUM}
  FROM meta JOIN m USING (repo_key) ORDER BY {ORDER} LIMIT 5)
"""


@check("market_breakouts", BREAKOUTS + "SELECT * FROM breakouts")
def market_breakouts(t: Testbed) -> DataFrame:
    return mk.market_breakouts(t.metadata(), t.events(), AS_OF)


@check(
    "market_breakouts_raw",
    rollup("r", window(30))
    + f""", m AS ({MARKET})
    SELECT r.* REPLACE (array_to_string(topics, ',') AS topics), total_events_in_window,
           unique_actors_in_window,
           CAST(round_even(CAST(CAST(r.star_count_in_window AS DOUBLE) / greatest(stargazers_count, 1) AS DECIMAL(38, 18)), 4) AS DOUBLE)
             AS momentum_score
    FROM r JOIN m ON m.repo_key = r.repo_full_name
    ORDER BY r.star_count_in_window DESC, total_events_in_window DESC, stargazers_count DESC,
             repo_full_name LIMIT 5""",
)
def market_breakouts_raw(t: Testbed) -> DataFrame:
    return mk.market_breakouts_from_events(t.events(), AS_OF)


CATEGORIES = f"""
, m2 AS ({MARKET}),
per_category AS (
  SELECT category, count(*) AS active_repo_count,
         CAST(sum(star_count_in_window) AS BIGINT) AS total_stars_in_window,
         CAST(sum(total_events_in_window) AS BIGINT) AS total_events_in_window,
         first(repo_full_name ORDER BY star_count_in_window DESC, repo_full_name)
           AS leader_repo_name,
         max(star_count_in_window) AS leader_stars_in_window
  FROM meta JOIN m2 USING (repo_key) GROUP BY category),
categories AS (
  SELECT *, CAST(round_even(CAST(CAST(total_stars_in_window AS DOUBLE)
                       / greatest((SELECT sum(total_stars_in_window) FROM per_category), 1) AS DECIMAL(38, 18)), 4) AS DOUBLE)
              AS share_of_window_stars
  FROM per_category
  ORDER BY total_stars_in_window DESC, total_events_in_window DESC, active_repo_count DESC, category
  LIMIT 5)
"""


@check("market_category_movers", CATEGORIES + "SELECT * FROM categories")
def market_category_movers(t: Testbed) -> DataFrame:
    return mk.market_category_movers(t.metadata(), t.events(), AS_OF)


@check(
    "share_of_window_stars",
    CATEGORIES + "SELECT category, share_of_window_stars FROM categories",
)
def share_of_window_stars(t: Testbed) -> DataFrame:
    movers = mk.market_category_movers(t.metadata(), t.events(), AS_OF)
    return movers.select("category", "share_of_window_stars")


@check(
    "market_category_movers_raw",
    f""", m AS ({MARKET})
    SELECT 'Other' AS category, count(*) AS active_repo_count,
           CAST(sum(star_count_in_window) AS BIGINT) AS total_stars_in_window,
           CAST(sum(total_events_in_window) AS BIGINT) AS total_events_in_window,
           first(repo_key ORDER BY star_count_in_window DESC, repo_key) AS leader_repo_name,
           max(star_count_in_window) AS leader_stars_in_window,
           CAST(1 AS DOUBLE) AS share_of_window_stars FROM m""",
)
def market_category_movers_raw(t: Testbed) -> DataFrame:
    return mk.market_category_movers_from_events(t.events(), AS_OF)


TOPICS = f"""
, topics AS (
  SELECT topic, count(DISTINCT repo_name) AS repo_count,
         count(*) FILTER (WHERE {STAR}) AS star_count_in_window
  FROM (SELECT * EXCLUDE (repo_topics), unnest(repo_topics) AS topic FROM gh WHERE {window(30)})
  WHERE topic <> '' GROUP BY topic
  ORDER BY star_count_in_window DESC, repo_count DESC, topic LIMIT 8)
"""


@check("market_topic_shifts", TOPICS + "SELECT * FROM topics")
def market_topic_shifts(t: Testbed) -> DataFrame:
    return mk.market_topic_shifts(t.events(), AS_OF)


@check(
    "breakout_concentration",
    BREAKOUTS
    + """SELECT CAST(sum(star_count_in_window) AS BIGINT) AS total_breakout_stars,
                CAST(round_even(CAST(CAST(max(star_count_in_window) AS DOUBLE) / sum(star_count_in_window) AS DECIMAL(38, 18)), 4) AS DOUBLE)
                  AS top_share,
                max(star_count_in_window) >= 0.5 * sum(star_count_in_window) AS is_concentrated
         FROM breakouts""",
)
def breakout_concentration(t: Testbed) -> DataFrame:
    return mk.breakout_concentration(mk.market_breakouts(t.metadata(), t.events(), AS_OF))


@check(
    "market_brief_context",
    BREAKOUTS
    + CATEGORIES
    + TOPICS
    + """SELECT 'breakout' AS part, repo_full_name AS name, star_count_in_window AS stars
           FROM breakouts
         UNION ALL SELECT 'category', category, total_stars_in_window FROM categories
         UNION ALL SELECT 'topic', topic, star_count_in_window FROM topics""",
)
def market_brief_context(t: Testbed) -> DataFrame:
    breakouts, categories, topics = mk.market_brief_context(t.metadata(), t.events(), AS_OF)

    def part(rows: DataFrame, name: str, label: str, stars: str) -> DataFrame:
        return rows.select(
            F.lit(name).alias("part"), F.col(label).alias("name"), F.col(stars).alias("stars")
        )

    return (
        part(breakouts, "breakout", "repo_full_name", "star_count_in_window")
        .unionByName(part(categories, "category", "category", "total_stars_in_window"))
        .unionByName(part(topics, "topic", "topic", "star_count_in_window"))
    )


@check(
    "market_brief",
    BREAKOUTS
    + CATEGORIES
    + TOPICS
    + f""", b1 AS (SELECT * FROM breakouts ORDER BY {ORDER} LIMIT 1),
    b2 AS (SELECT * FROM breakouts ORDER BY {ORDER} LIMIT 1 OFFSET 1),
    c1 AS (SELECT * FROM categories ORDER BY total_stars_in_window DESC, total_events_in_window DESC,
           active_repo_count DESC, category LIMIT 1),
    t1 AS (SELECT * FROM topics ORDER BY star_count_in_window DESC, repo_count DESC, topic LIMIT 1)
    SELECT 30::BIGINT AS window_days, 'template' AS retrieval_mode,
      b1.repo_full_name || ' leads the 30d cycle with +' || format('{{:,}}', b1.star_count_in_window)
        || ' stars.' AS headline,
      b1.repo_full_name || ' is the strongest breakout with '
        || format('{{:,}}', b1.total_events_in_window) || ' total events and '
        || format('{{:,}}', b1.unique_actors_in_window) || ' distinct actors. '
        || c1.category || ' is absorbing the most star flow, led by ' || c1.leader_repo_name || '. '
        || 'The hottest topic signal is ' || t1.topic || ', appearing across ' || t1.repo_count
        || ' active repositories. '
        || (SELECT count(*) FROM breakouts) || ' breakout repos are strong enough to surface in '
        || 'this window, which suggests concentrated rather than broad-based momentum.' AS summary,
      b1.repo_full_name || ' leads on near-term attention with +'
        || format('{{:,}}', b1.star_count_in_window) || ' stars and '
        || format('{{:,}}', b1.unique_actors_in_window) || ' active actors.,'
        || b2.repo_full_name || ' is the next breakout, indicating the field is not a single-repo '
        || 'story.,' || c1.category || ' is the strongest category mover with '
        || format('{{:,}}', c1.total_stars_in_window) || ' stars in the window.,'
        || t1.topic || ' is the clearest topic shift, spanning ' || t1.repo_count
        || ' repositories.' AS key_takeaways,
      CASE WHEN c1.share_of_window_stars >= 0.5 THEN c1.category || ' dominates the current window, '
        || 'so cross-category breadth is limited.' ELSE 'Momentum is distributed enough that '
        || 'rankings may reshuffle quickly in the next run.' END AS watchouts
    FROM b1, b2, c1, t1""",
)
def market_brief(t: Testbed) -> DataFrame:
    parts = mk.market_brief_context(t.metadata(), t.events(), AS_OF)
    return mk.market_brief(*parts, 30)


@check(
    "momentum_score",
    f""", m AS ({MARKET})
    SELECT repo_full_name, star_count_in_window, stargazers_count, {MOMENTUM}
    FROM meta JOIN m USING (repo_key)""",
)
def momentum_score(t: Testbed) -> DataFrame:
    metrics = ru.market_repo_metrics(t.events(), AS_OF, 30)
    return ins.momentum_scores(ru.latest_metadata(t.metadata()).join(metrics, "repo_key"))


@check(
    "repo_window_metrics",
    f"""SELECT count(*) AS total_events, count(DISTINCT actor_login) AS unique_actors,
          max(created_at) AS latest_event_at FROM gh WHERE repo_id = 43 AND {window(30)}""",
)
def repo_window_metrics(t: Testbed) -> DataFrame:
    return ins.repo_window_metrics(t.events(), t.lookup_name(43).upper(), AS_OF)


@check(
    "repo_activity_top5",
    f"""SELECT event_type, count(*) AS event_count FROM gh WHERE repo_id = 43 AND {window(30)}
        GROUP BY 1 ORDER BY event_count DESC, event_type LIMIT 5""",
)
def repo_activity_top5(t: Testbed) -> DataFrame:
    return ins.repo_activity_top5(t.events(), t.lookup_name(43), AS_OF)


RATES = f"""
, series AS (
  SELECT repo_key, event_date, count(*) FILTER (WHERE {STAR}) AS stars
  FROM gh WHERE {window(30)} GROUP BY repo_key, event_date),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY event_date) AS place,
         count(*) OVER (PARTITION BY repo_key) AS days FROM series),
rates AS (
  SELECT repo_key,
         coalesce(avg(stars) FILTER (WHERE place > greatest(days // 2, 1)),
                  CAST(sum(stars) FILTER (WHERE place <= greatest(days // 2, 1)) AS DOUBLE))
           AS recent_star_rate,
         avg(stars) FILTER (WHERE place <= greatest(days // 2, 1)) AS prior_star_rate
  FROM placed GROUP BY repo_key)
"""


@check(
    "half_window_star_rates",
    RATES
    + """SELECT repo_key, CAST(round_even(CAST(recent_star_rate AS DECIMAL(38, 18)), 6) AS DOUBLE) AS recent_star_rate,
                CAST(round_even(CAST(prior_star_rate AS DECIMAL(38, 18)), 6) AS DOUBLE) AS prior_star_rate FROM rates""",
)
def half_window_star_rates(t: Testbed) -> DataFrame:
    recent = t.events().where(in_window(F.col("created_at"), AS_OF, 30))
    rates = ins.half_window_star_rates(rp.daily_activity(recent))
    return rates.select(
        "repo_key",
        F.bround("recent_star_rate", 6).alias("recent_star_rate"),
        F.bround("prior_star_rate", 6).alias("prior_star_rate"),
    )


CONTEXT = (
    RATES
    + f""", m AS ({MARKET}),
kinds AS (
  SELECT repo_key, event_type AS dominant_event, event_count AS dominant_count
  FROM (SELECT repo_key, event_type, count(*) AS event_count FROM gh WHERE {window(30)}
        GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY repo_key ORDER BY event_count DESC, event_type) = 1),
context AS (
  SELECT meta.* REPLACE ({EFFECTIVE} AS category),
         coalesce(star_count_in_window, 0) AS star_count_in_window,
         coalesce(total_events_in_window, 0) AS total_events_in_window,
         coalesce(unique_actors_in_window, 0) AS unique_actors_in_window, latest_event_at,
         coalesce(recent_star_rate, 0) AS recent_star_rate,
         coalesce(prior_star_rate, 0) AS prior_star_rate, dominant_event, dominant_count
  FROM meta LEFT JOIN m USING (repo_key) LEFT JOIN rates USING (repo_key)
       LEFT JOIN kinds USING (repo_key)),
judged AS (
  SELECT *, CASE
    WHEN star_count_in_window >= 250 AND recent_star_rate >= greatest(prior_star_rate * 1.2, 5)
      THEN 'accelerating'
    WHEN star_count_in_window >= 100 OR total_events_in_window >= 250 THEN 'steady'
    WHEN star_count_in_window > 0 OR total_events_in_window >= 40 THEN 'emerging'
    ELSE 'quiet' END AS trend_verdict FROM context)
"""
)


@check(
    "repo_brief_context",
    CONTEXT
    + """SELECT repo_full_name, category, stargazers_count, star_count_in_window,
                total_events_in_window, unique_actors_in_window, latest_event_at, dominant_event,
                dominant_count FROM context""",
)
def repo_brief_context(t: Testbed) -> DataFrame:
    return ins.repo_brief_context(t.metadata(), t.events(), AS_OF).select(
        "repo_full_name",
        "category",
        "stargazers_count",
        "star_count_in_window",
        "total_events_in_window",
        "unique_actors_in_window",
        "latest_event_at",
        "dominant_event",
        "dominant_count",
    )


@check("trend_verdict", CONTEXT + "SELECT repo_full_name, trend_verdict FROM judged")
def trend_verdict(t: Testbed) -> DataFrame:
    context = ins.repo_brief_context(t.metadata(), t.events(), AS_OF)
    return ins.with_trend_verdict(context).select("repo_full_name", "trend_verdict")


REPO_BRIEF = """SELECT repo_full_name, 30::BIGINT AS window_days, 'template' AS retrieval_mode,
      trend_verdict,
      repo_full_name || ' is ' || trend_verdict || ' in ' || lower(category) || ' with +'
        || format('{:,}', star_count_in_window) || ' stars over 30d.' AS headline,
      repo_full_name || ' is a ' || lower(category) || ' repository in '
        || CASE WHEN primary_language = '' THEN 'unknown stack' ELSE primary_language END
        || ' with ' || format('{:,}', stargazers_count) || ' total stars, '
        || format('{:,}', total_events_in_window) || ' events, and '
        || format('{:,}', unique_actors_in_window) || ' active actors in the last 30 days.'
        AS summary,
      CASE trend_verdict
        WHEN 'accelerating' THEN 'n/a'
        WHEN 'steady' THEN 'The repo is sustaining attention with '
          || format('{:,}', total_events_in_window) || ' recent events from '
          || format('{:,}', unique_actors_in_window) || ' actors; '
          || dominant_event || ' led activity with ' || format('{:,}', dominant_count)
          || ' events.'
        WHEN 'emerging' THEN 'The signal is early but real: '
          || format('{:,}', star_count_in_window) || ' stars and '
          || format('{:,}', total_events_in_window) || ' events appeared in the last 30d; '
          || dominant_event || ' led activity with ' || format('{:,}', dominant_count)
          || ' events.'
        ELSE 'Current activity is muted. The repo still has '
          || format('{:,}', stargazers_count) || ' total stars, but only '
          || format('{:,}', total_events_in_window) || ' recent events were observed.' END
        AS why_trending,
      star_count_in_window, total_events_in_window, unique_actors_in_window, latest_event_at,
      format('{:,}', stargazers_count) || ' total GitHub stars with +'
        || format('{:,}', star_count_in_window) || ' in the last 30d.,'
        || format('{:,}', total_events_in_window) || ' tracked events from '
        || format('{:,}', unique_actors_in_window) || ' unique actors in the current window.'
        || CASE WHEN dominant_event IS NULL THEN '' ELSE ',' || dominant_event
             || ' is the dominant activity type at ' || format('{:,}', dominant_count)
             || ' events.' END
        || CASE WHEN primary_language = '' THEN '' ELSE ',Primary implementation language is '
             || primary_language || '.' END AS key_signals,
      CASE WHEN unique_actors_in_window < 20 AND star_count_in_window > 0 THEN
             'Attention is rising faster than contributor breadth, so momentum may be audience-led.'
           WHEN total_events_in_window = 0 THEN
             'No recent tracked events were observed in the selected window.'
           ELSE 'Current signal is mostly event-driven; deeper README and issue analysis is still '
             || 'pending.' END AS watchouts
    FROM judged"""


@check("repo_brief", CONTEXT + REPO_BRIEF)
def repo_brief(t: Testbed) -> DataFrame:
    return ins.repo_brief(ins.repo_brief_context(t.metadata(), t.events(), AS_OF), AS_OF)


PAIR = (
    CONTEXT
    + """, b AS (SELECT * FROM context WHERE repo_id = 43),
c AS (SELECT * FROM context WHERE repo_id = 51),
metrics(position, key, label, base_value, compare_value) AS (
  SELECT 1::BIGINT, 'total_stars', 'Total Stars', b.stargazers_count, c.stargazers_count FROM b, c
  UNION ALL SELECT 2, 'window_stars', 'Stars (30d)', b.star_count_in_window, c.star_count_in_window
    FROM b, c
  UNION ALL SELECT 3, 'events', 'Events (30d)', b.total_events_in_window, c.total_events_in_window
    FROM b, c
  UNION ALL SELECT 4, 'actors', 'Unique Actors (30d)', b.unique_actors_in_window,
    c.unique_actors_in_window FROM b, c
  UNION ALL SELECT 5, 'forks', 'Forks', b.forks_count, c.forks_count FROM b, c),
won AS (SELECT *, CASE WHEN base_value = compare_value THEN 'tie' WHEN base_value > compare_value
                  THEN 'base' ELSE 'compare' END AS winner FROM metrics)
"""
)


def _pair(t: Testbed) -> DataFrame:
    context = ins.repo_brief_context(t.metadata(), t.events(), AS_OF)
    return ins.compare_pair(context, t.lookup_name(43), t.lookup_name(51))


@check(
    "compare_repos",
    PAIR
    + """SELECT b.repo_full_name AS base_repo, c.repo_full_name AS compare_repo,
                b.category AS base_category, c.category AS compare_category,
                b.star_count_in_window AS base_stars, c.star_count_in_window AS compare_stars
         FROM b, c""",
)
def compare_repos(t: Testbed) -> DataFrame:
    return _pair(t).select(
        F.col("base.repo_full_name").alias("base_repo"),
        F.col("compare.repo_full_name").alias("compare_repo"),
        F.col("base.category").alias("base_category"),
        F.col("compare.category").alias("compare_category"),
        F.col("base.star_count_in_window").alias("base_stars"),
        F.col("compare.star_count_in_window").alias("compare_stars"),
    )


@check("compare_metrics", PAIR + "SELECT * FROM won")
def compare_metrics(t: Testbed) -> DataFrame:
    return ins.compare_metrics(_pair(t))


@check(
    "compare_verdict",
    PAIR
    + """, n AS (SELECT count(*) FILTER (WHERE winner = 'base') AS base_wins,
                        count(*) FILTER (WHERE winner = 'compare') AS compare_wins FROM won)
    SELECT base_wins, compare_wins, CASE WHEN abs(base_wins - compare_wins) <= 1 THEN 'tie'
             WHEN base_wins > compare_wins THEN 'base' ELSE 'compare' END AS overall_winner,
           (SELECT string_agg(CASE WHEN winner = 'base' THEN b.repo_full_name
                                   ELSE c.repo_full_name END
                     || ' leads on ' || lower(label) || ' (' || format('{:,}', base_value)
                     || ' vs ' || format('{:,}', compare_value) || ').', ',' ORDER BY position)
            FROM won WHERE winner <> 'tie' AND position <= 4) AS metric_differences
    FROM n, b, c""",
)
def compare_verdict(t: Testbed) -> DataFrame:
    """Only the lines about numbers are compared; the text about categories follows them."""
    verdict = ins.compare_verdict(_pair(t))
    lines = F.filter("key_differences", lambda line: F.contains(line, F.lit(" leads on ")))
    return verdict.select(
        "base_wins",
        "compare_wins",
        "overall_winner",
        F.array_join(lines, ",").alias("metric_differences"),
    )


@check("compare_text")
def compare_text(t: Testbed) -> DataFrame:
    return ins.compare_verdict(_pair(t))
