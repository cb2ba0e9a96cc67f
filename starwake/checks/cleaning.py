"""Checks of mapping, validation and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwake.checks import check
from starwake.checks.sql import EFFECTIVE, NOW, meta_row, rollup, window
from starwake.functions import classify as cat
from starwake.functions import text as tx
from starwake.functions import times as tm
from starwake.operators import clean as cl
from starwake.operators import reports as rp
from starwake.operators import rollups as ru
from starwake.schemas import EVENT_COLUMNS, RAW_EVENT, WIRE_EVENT
from starwake.streaming.ingest import decode_events, undecodable
from starwake.testbed import AS_OF, Testbed, sql_classify
from starwake.vocab import AI_SIGNAL_WORDS, LOOSE_CATEGORY_WORDS

SOME_EVENT_COLUMNS = """
  event_id, event_type, actor_id, actor_login, repo_id, repo_name, created_at, payload_json,
  repo_stargazers_count, repo_primary_language,
  array_to_string(coalesce(repo_topics, []::VARCHAR[]), ',') AS repo_topics, repo_description
"""


@check(
    "admit_events",
    """SELECT event_id, actor_login, repo_id, repo_name FROM raw_gh
       WHERE trim(actor_login) <> '' AND trim(repo_name) <> '' AND repo_id > 0""",
)
def admit_events(t: Testbed) -> DataFrame:
    return cl.admit_events(t.raw_events()).select("event_id", "actor_login", "repo_id", "repo_name")


@check(
    "map_raw_event",
    """SELECT event_id, event_type, actor_id, actor_login, repo_id, repo_name, payload_json,
              repo_stargazers_count, repo_primary_language,
              array_to_string(coalesce(repo_topics, []::VARCHAR[]), ',') AS repo_topics,
              repo_description, true AS public FROM gh""",
)
def map_raw_event(t: Testbed) -> DataFrame:
    nested = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        F.struct(F.col("actor_id").alias("id"), F.col("actor_login").alias("login")).alias("actor"),
        F.struct(F.col("repo_id").alias("id"), F.col("repo_name").alias("name")).alias("repo"),
        F.from_json("payload_json", "k bigint").alias("payload"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.struct(
            F.col("repo_stargazers_count").alias("stargazers_count"),
            F.col("repo_primary_language").alias("language"),
            F.col("repo_topics").alias("topics"),
            F.col("repo_description").alias("description"),
        ).alias("_full_repo"),
    )
    raw = t.events().select(F.from_json(F.to_json(nested), RAW_EVENT).alias("raw")).select("raw.*")
    mapped = cl.map_raw_event(raw)
    return mapped.withColumn(
        "payload_json",
        F.format_string('{"k": %s}', F.get_json_object("payload_json", "$.k")),
    ).select(*EVENT_COLUMNS[:6], "payload_json", *EVENT_COLUMNS[8:12], "public")


@check(
    "keep_known_types",
    """SELECT event_id, event_type FROM raw_gh WHERE event_type IN
       ('WatchEvent', 'ForkEvent', 'PushEvent', 'CreateEvent', 'IssuesEvent')""",
)
def keep_known_types(t: Testbed) -> DataFrame:
    return cl.keep_known_types(t.raw_events()).select("event_id", "event_type")


REASONS = """
  CASE WHEN trim(event_id) = '' THEN 'event_id'
       WHEN event_type NOT LIKE '%Event' THEN 'event_type'
       WHEN actor_id <= 0 THEN 'actor_id'
       WHEN trim(actor_login) = '' THEN 'actor_login'
       WHEN repo_id <= 0 OR repo_id > 1000000000000 THEN 'repo_id'
       WHEN NOT regexp_full_match(repo_name, '[^/]+/[^/]+') THEN 'repo_name'
       WHEN repo_stargazers_count < 0 THEN 'stargazers_count'
       WHEN created_at IS NULL THEN 'created_at' END
"""


@check(
    "validate_events",
    f", checked AS (SELECT *, {REASONS} AS reject_reason FROM raw_gh) "
    "SELECT coalesce(reject_reason, 'valid') AS outcome, count(*) AS events, "
    "min(event_id) AS first_id, max(created_at) AS last_at FROM checked GROUP BY 1",
)
def validate_events(t: Testbed) -> DataFrame:
    checked = cl.check_events(t.raw_events())
    return checked.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_id").alias("first_id"),
        F.max("created_at").alias("last_at"),
    )


@check(
    "valid_events",
    f"SELECT event_id, event_type, actor_login, repo_name, created_at FROM raw_gh "
    f"WHERE {REASONS} IS NULL",
)
def valid_events(t: Testbed) -> DataFrame:
    return cl.valid_events(t.raw_events()).select(
        "event_id", "event_type", "actor_login", "repo_name", "created_at"
    )


@check(
    "ingest_quality_counts",
    f""", checked AS (
      SELECT {REASONS} AS reason,
             trim(actor_login) <> '' AND trim(repo_name) <> '' AND repo_id > 0 AS admitted
      FROM raw_gh)
    SELECT count(*) AS raw_count,
           count(*) FILTER (WHERE admitted AND reason IS NULL) AS published_count,
           count(*) FILTER (WHERE NOT admitted) AS filtered_count,
           count(*) FILTER (WHERE admitted AND reason IS NOT NULL) AS validation_error_count
    FROM checked""",
)
def ingest_quality_counts(t: Testbed) -> DataFrame:
    return cl.ingest_quality_counts(t.raw_events())


@check("flag_bots", "SELECT event_id, actor_login, actor_login LIKE '%[bot]' AS is_bot FROM gh")
def flag_bots(t: Testbed) -> DataFrame:
    return cl.flag_bots(t.events()).select("event_id", "actor_login", "is_bot")


@check("derive_event_date", "SELECT event_id, CAST(created_at AS DATE) AS event_date FROM gh")
def derive_event_date(t: Testbed) -> DataFrame:
    return cl.derive_event_date(t.events().drop("event_date")).select("event_id", "event_date")


def _wire(t: Testbed) -> DataFrame:
    """Raw events as messages; two faults break the message itself."""
    raw = t.raw_events()
    fields = [name for name in WIRE_EVENT.fieldNames() if name in raw.columns]
    message = F.to_json(F.struct(*fields))
    broken = (
        F.when(F.col("fault") == 8, F.expr("substring(m, 1, length(m) - 5)"))
        .when(F.col("fault") == 9, None)
        .otherwise(F.col("m"))
    )
    return raw.withColumn("m", message).select(
        F.col("repo_id").cast("string").alias("key"), broken.alias("value")
    )


@check(
    "decode_events",
    """SELECT event_id, event_type, actor_id, actor_login, repo_id, repo_name, created_at,
              repo_stargazers_count FROM raw_gh WHERE fault NOT IN (8, 9)""",
)
def decode_checked(t: Testbed) -> DataFrame:
    return decode_events(_wire(t)).select(
        "event_id",
        "event_type",
        "actor_id",
        "actor_login",
        "repo_id",
        "repo_name",
        "created_at",
        "repo_stargazers_count",
    )


@check(
    "decode_skip_bad",
    """SELECT CAST(repo_id AS VARCHAR) AS key, fault = 9 AS is_null FROM raw_gh
       WHERE fault IN (8, 9)""",
)
def decode_skip_bad(t: Testbed) -> DataFrame:
    return undecodable(_wire(t)).select("key", F.col("value").isNull().alias("is_null"))


@check(
    "to_wire_event",
    """SELECT CAST(repo_id AS VARCHAR) AS key, event_id, actor_login, repo_name,
              strftime(created_at, '%Y-%m-%d') AS event_date,
              strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS created_at,
              repo_stargazers_count FROM gh""",
)
def to_wire_event(t: Testbed) -> DataFrame:
    records = cl.to_wire_event(t.events())
    value = F.from_json("value", WIRE_EVENT)
    return records.select("key", value.alias("v")).select(
        "key",
        "v.event_id",
        "v.actor_login",
        "v.repo_name",
        "v.event_date",
        "v.created_at",
        "v.repo_stargazers_count",
    )


@check("normalise_event_defaults", f"SELECT {SOME_EVENT_COLUMNS} FROM gh")
def normalise_event_defaults(t: Testbed) -> DataFrame:
    return cl.normalise_event_defaults(t.events()).select(*EVENT_COLUMNS[:12])


@check("parse_created_at", "SELECT event_id, created_at FROM raw_gh")
def parse_created_at(t: Testbed) -> DataFrame:
    return t.raw_events().select("event_id", tm.parse_iso(F.col("created_at")).alias("created_at"))


@check(
    "split_repo_name",
    """SELECT DISTINCT repo_name,
       CASE WHEN strpos(repo_name, '/') > 0 THEN split_part(repo_name, '/', 1) ELSE '' END AS owner,
       CASE WHEN strpos(repo_name, '/') > 0 THEN split_part(repo_name, '/', 2) ELSE repo_name END
         AS short_name,
       split_part(repo_name, '/', 2) AS second_part,
       'https://github.com/' || repo_name AS html_url,
       'https://github.com/' || repo_name || '.git' AS clone_url FROM raw_gh""",
)
def split_repo_name(t: Testbed) -> DataFrame:
    name = F.col("repo_name")
    return t.raw_events().select("repo_name").distinct().select(
        "repo_name",
        tx.snapshot_owner_of(name).alias("owner"),
        tx.snapshot_short_name_of(name).alias("short_name"),
        tx.short_name_of(name).alias("second_part"),
        tx.page_url(name).alias("html_url"),
        tx.clone_url(name).alias("clone_url"),
    )


@check("normalise_repo_key", "SELECT repo_key, count(*) AS events FROM gh GROUP BY repo_key")
def normalise_repo_key(t: Testbed) -> DataFrame:
    keyed = cl.with_repo_key(t.events())
    return keyed.groupBy("repo_key").agg(F.count(F.lit(1)).alias("events"))


@check(
    "classify_category",
    f"SELECT repo_id, {sql_classify('topics', 'description')} AS category FROM repos",
)
def classify_category(t: Testbed) -> DataFrame:
    return t.repos().select(
        "repo_id", cat.classify(F.col("topics"), F.col("description")).alias("category")
    )


def _loose_sql() -> str:
    parts = []
    for name, words in LOOSE_CATEGORY_WORDS.items():
        parts.append(f"WHEN regexp_matches(haystack, '{'|'.join(words)}') THEN '{name}'")
    return f"CASE {' '.join(parts)} ELSE 'Other' END"


@check(
    "classify_category_loose",
    f""", h AS (SELECT repo_id, lower(array_to_string(coalesce(topics, []::VARCHAR[]), ' ') || ' '
                     || description || ' ' || key_name) AS haystack FROM repos)
    SELECT repo_id, {_loose_sql()} AS category FROM h""",
)
def classify_category_loose(t: Testbed) -> DataFrame:
    loose = cat.classify_loose(F.col("topics"), F.col("description"), F.col("key_name"))
    return t.repos().select("repo_id", loose.alias("category"))


SIGNAL_WORDS = "|".join(AI_SIGNAL_WORDS)


@check(
    "ai_signal",
    f"""SELECT doc_id, {sql_classify('[lang]', 'text')} AS signal_category,
               {sql_classify('[lang]', 'text')} <> 'Other'
                 OR regexp_matches(lower(text), '{SIGNAL_WORDS}') AS ai_signal
        FROM documents""",
)
def ai_signal(t: Testbed) -> DataFrame:
    """README texts of any length, looked at as a whole."""
    docs = t.table("documents").select(
        "doc_id",
        F.array("lang").alias("repo_topics"),
        F.lit("").alias("repo_description"),
        F.col("text").alias("repo_readme_text"),
        F.lit("[]").alias("repo_issues_json"),
    )
    return cl.ai_signal(docs).select("doc_id", "signal_category", "ai_signal")


HISTORY_SQL = """
  repo_id, repo_name AS repo_full_name, split_part(repo_name, '/', 2) AS repo_name,
  'https://github.com/' || repo_name AS html_url,
  'https://github.com/' || repo_name || '.git' AS clone_url, repo_stargazers_count
    AS stargazers_count, repo_stargazers_count AS watchers_count, 0::BIGINT AS forks_count,
  'public' AS visibility, 'main' AS default_branch, 'Other' AS category, true AS has_issues,
  true AS allow_forking, false AS is_fork, split_part(repo_name, '/', 1) AS owner_login,
  created_at AS github_pushed_at, created_at AS snapshot_at, 'github_event' AS snapshot_source,
  event_id AS snapshot_key
"""


HISTORY_NAMES = (
    "repo_id repo_full_name repo_name html_url clone_url stargazers_count watchers_count "
    "forks_count visibility default_branch category has_issues allow_forking is_fork owner_login "
    "github_pushed_at snapshot_at snapshot_source snapshot_key"
).split()


@check("event_to_history", f"SELECT {HISTORY_SQL} FROM gh")
def event_to_history(t: Testbed) -> DataFrame:
    return cl.event_to_history(t.events()).select(*HISTORY_NAMES)


@check(
    "build_search_document",
    f"""SELECT repo_id, array_to_string(list_filter([repo_full_name, repo_name, owner_login,
          primary_language, {EFFECTIVE}, array_to_string(topics, ' '), description],
          lambda p: p <> ''), ' ') AS search_document FROM meta""",
)
def build_search_document(t: Testbed) -> DataFrame:
    repos = cl.with_effective_category(ru.latest_metadata(t.metadata()))
    return cl.with_search_document(repos).select("repo_id", "search_document")


@check(
    "safe_int",
    """SELECT page_id, coalesce(TRY_CAST(CASE WHEN regexp_full_match(part, '[+-]?[0-9]+')
              THEN part END AS BIGINT), 0) AS number
       FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS part FROM pages)""",
)
def safe_int(t: Testbed) -> DataFrame:
    last = F.regexp_extract("url", "[^/]*$", 0)
    return t.table("pages").select("page_id", tx.whole_number(last).alias("number"))


@check(
    "filter_window",
    f"""SELECT event_id, created_at >= {NOW} - INTERVAL 7 DAY AS is_current FROM gh
        WHERE created_at >= {NOW} - INTERVAL 14 DAY AND created_at < {NOW}""",
)
def filter_window(t: Testbed) -> DataFrame:
    seen = F.col("created_at")
    current, before = tm.in_window(seen, AS_OF, 7), tm.in_previous_window(seen, AS_OF, 7)
    return t.events().where(current | before).select("event_id", current.alias("is_current"))


@check(
    "gmt7_week_bounds",
    """SELECT CAST(date_trunc('week', ts + INTERVAL 7 HOUR) AS TIMESTAMP) - INTERVAL 7 HOUR
                AS week_start,
              count(*) AS events FROM events GROUP BY 1""",
)
def gmt7_week_bounds(t: Testbed) -> DataFrame:
    """The week of every event, by the rule that gives the current week for ``as_of``."""
    week = tm.week_start(F.col("created_at"))
    return t.events().groupBy(week.alias("week_start")).agg(F.count(F.lit(1)).alias("events"))


@check(
    "filter_catalog",
    """SELECT repo_id, repo_full_name FROM meta
       WHERE stargazers_count >= 1000 AND category = 'LLM' AND lower(primary_language) = 'economy'
    """,
)
def filter_catalog(t: Testbed) -> DataFrame:
    latest = ru.latest_metadata(t.metadata())
    return cl.filter_catalog(latest, 1000, "LLM", "Economy").select("repo_id", "repo_full_name")


@check("effective_category", f"SELECT repo_id, {EFFECTIVE} AS category FROM meta")
def effective_category(t: Testbed) -> DataFrame:
    latest = ru.latest_metadata(t.metadata())
    return cl.with_effective_category(latest).select("repo_id", "category")


@check(
    "category_filter_overfetch",
    rollup("r", window(7), stars="n.repo_stargazers_count")
    + """, known AS (SELECT count(*) AS n FROM r WHERE category <> 'Other')
    SELECT repo_full_name, category, star_count_in_window FROM r, known
    WHERE category <> 'Other' OR known.n = 0""",
)
def category_filter_overfetch(t: Testbed) -> DataFrame:
    seen = t.events().where(tm.in_window(F.col("created_at"), AS_OF, 7))
    rows = cl.with_effective_category(ru.repo_rollup_raw(seen, AS_OF, highest_stars=False))
    return cl.prefer_categorised(rows).select("repo_full_name", "category", "star_count_in_window")


@check(
    "events_by_repo",
    """SELECT event_id, event_type, created_at FROM gh WHERE repo_id = 43
       ORDER BY created_at DESC, event_id LIMIT 100""",
)
def events_by_repo(t: Testbed) -> DataFrame:
    return cl.events_by_repo(t.events(), 43).select("event_id", "event_type", "created_at")


@check(
    "events_by_date_range",
    """SELECT event_id, repo_name, created_at FROM gh
       WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'
       ORDER BY created_at DESC, event_id LIMIT 1000""",
)
def events_by_date_range(t: Testbed) -> DataFrame:
    found = cl.events_by_date_range(t.events(), "2024-01-10", "2024-01-12")
    return found.select("event_id", "repo_name", "created_at")


@check(
    "latest_events",
    """SELECT event_id, event_type, created_at FROM gh
       WHERE CAST(created_at AS DATE) = DATE '2024-01-30' AND event_type = 'PushEvent'
       ORDER BY created_at DESC, event_id LIMIT 50""",
)
def latest_events(t: Testbed) -> DataFrame:
    found = cl.latest_events(t.events(), "2024-01-30 23:59:59.999999", 50, "PushEvent")
    return found.select("event_id", "event_type", "created_at")


@check(
    "recent_events",
    """SELECT created_at, event_type, actor_login, repo_name, event_id FROM gh
       ORDER BY created_at DESC, event_id LIMIT 100""",
)
def recent_events(t: Testbed) -> DataFrame:
    return cl.recent_events(t.events())


@check("repo_lookup", f"SELECT {meta_row()} FROM meta WHERE repo_id = 43")
def repo_lookup(t: Testbed) -> DataFrame:
    return rp.repo_lookup(t.metadata(), t.lookup_name(43).upper())


@check(
    "repo_lookup_raw",
    rollup("r", "repo_id = 43")
    + """SELECT * EXCLUDE (star_count_in_window)
         REPLACE (array_to_string(topics, ',') AS topics) FROM r""",
)
def repo_lookup_raw(t: Testbed) -> DataFrame:
    return rp.repo_lookup_from_events(t.events(), t.lookup_name(43).upper(), AS_OF)


@check(
    "time_range_bucket",
    """SELECT p_partkey, CASE WHEN p_size <= 7 THEN 'day' WHEN p_size <= 31 THEN 'month'
       ELSE 'year' END AS time_range FROM part""",
)
def time_range_bucket(t: Testbed) -> DataFrame:
    return t.repos().select("p_partkey", tm.search_range(F.col("p_size")).alias("time_range"))
