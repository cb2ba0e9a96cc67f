"""Pieces of SQL that several checks share.

Rounding is done on decimals: rounding a DOUBLE multiplies it first, which can turn a value just
below or above a tie into one.
"""

from starwake.testbed import AS_OF, sql_classify

NOW = f"TIMESTAMP '{AS_OF}'"
EFFECTIVE = f"CASE WHEN category = 'Other' THEN {sql_classify('topics', 'description')} ELSE category END"


def window(days: int) -> str:
    return f"(created_at >= {NOW} - INTERVAL {days} DAY AND created_at < {NOW})"


def previous(days: int) -> str:
    return (
        f"(created_at >= {NOW} - INTERVAL {2 * days} DAY "
        f"AND created_at < {NOW} - INTERVAL {days} DAY)"
    )


def dates(days: int) -> str:
    return f"(event_date BETWEEN CAST({NOW} AS DATE) - {days} AND CAST({NOW} AS DATE))"


STAR = "event_type = 'WatchEvent'"
WEEK_START = "TIMESTAMP '2024-01-28 17:00:00'"


def meta_row(pushed: str = "github_pushed_at", rank: str = "0::BIGINT", category: str = EFFECTIVE) -> str:
    """The repository columns from the latest metadata."""
    rank_column = f"{rank} AS rank," if rank else ""
    return f"""
    repo_id, repo_full_name, repo_name, 'https://github.com/' || repo_full_name AS html_url,
    description, primary_language, array_to_string(topics, ',') AS topics, {category} AS category,
    stargazers_count, stargazers_count AS watchers_count, forks_count, open_issues_count,
    subscribers_count, owner_login, '' AS owner_avatar_url, 'MIT License' AS license_name,
    {rank_column} github_created_at, {pushed} AS github_pushed_at
    """


def rollup(
    name: str,
    where: str = "TRUE",
    star: str = STAR,
    stars: str = "g.max_stars",
    created: str = "g.first_at",
) -> str:
    """A CTE with repository rows made from events: newest event joined to the group's numbers."""
    return f"""
    , {name}_n AS (
      SELECT * FROM gh WHERE {where}
      QUALIFY row_number() OVER (PARTITION BY repo_key ORDER BY created_at DESC, event_id DESC) = 1
    ), {name} AS (
      SELECT n.repo_id, g.repo_key AS repo_full_name, split_part(g.repo_key, '/', 2) AS repo_name,
             'https://github.com/' || g.repo_key AS html_url,
             n.repo_description AS description, n.repo_primary_language AS primary_language,
             coalesce(n.repo_topics, []::VARCHAR[]) AS topics,
             {sql_classify('n.repo_topics', 'n.repo_description')} AS category,
             {stars} AS stargazers_count, {stars} AS watchers_count,
             0::BIGINT AS forks_count, 0::BIGINT AS open_issues_count,
             0::BIGINT AS subscribers_count, split_part(g.repo_key, '/', 1) AS owner_login,
             '' AS owner_avatar_url, '' AS license_name, {created} AS github_created_at,
             g.last_at AS github_pushed_at, 0::BIGINT AS rank, g.stars_in_window
               AS star_count_in_window
      FROM (SELECT repo_key, max(repo_stargazers_count) AS max_stars, min(created_at) AS first_at,
                   max(created_at) AS last_at, count(*) FILTER (WHERE {star}) AS stars_in_window
            FROM gh WHERE {where} GROUP BY repo_key) g
      JOIN {name}_n n USING (repo_key)
    )
    """


NEWEST_STARS = "n.repo_stargazers_count"


def archive_rollup(name: str, where: str = "TRUE", star: str = STAR) -> str:
    return f"""
    , {name} AS (
      SELECT repo_id, repo_name AS repo_full_name, split_part(repo_name, '/', 2) AS repo_name,
             'https://github.com/' || repo_name AS html_url, max(repo_description) AS description,
             max(repo_primary_language) AS primary_language,
             list_sort(list_distinct(list_filter(
               flatten(list(coalesce(repo_topics, []::VARCHAR[]))), lambda t: t <> ''))) AS topics, 'Other' AS category,
             max(repo_stargazers_count) AS stargazers_count,
             max(repo_stargazers_count) AS watchers_count, 0::BIGINT AS forks_count,
             0::BIGINT AS open_issues_count, 0::BIGINT AS subscribers_count,
             split_part(repo_name, '/', 1) AS owner_login, '' AS owner_avatar_url,
             '' AS license_name, min(created_at) AS github_created_at,
             max(created_at) AS github_pushed_at, 0::BIGINT AS rank,
             count(*) FILTER (WHERE {star}) AS star_count_in_window
      FROM gh WHERE {where} GROUP BY repo_id, gh.repo_name
    )
    """


def reclassified(name: str) -> str:
    """Rows of a rollup with the category its topics and description give."""
    category = sql_classify("topics", "description")
    return (
        f"SELECT * REPLACE (array_to_string(topics, ',') AS topics) "
        f"FROM (SELECT * EXCLUDE (category), {category} AS category FROM {name})"
    )
