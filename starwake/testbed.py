"""The given test tables seen as code-hosting activity, in Spark and, word for word, in SQL.

Queries read the whole tables: ``events`` is the event stream, ``part`` the repositories,
``conversations`` the questions and ``embeddings`` the vectors. Repositories of one vendor are not
in the metadata, so that joins have rows without a partner on both sides.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starwake.functions.classify import classify
from starwake.functions.text import clone_url, owner_of, page_url
from starwake.operators import rollups as ru
from starwake.operators.clean import event_to_history, metadata_to_history
from starwake.schemas import METADATA_COLUMNS
from starwake.session import use_utc

AS_OF = "2024-01-31 00:00:00"
EPOCH = "2024-01-01 00:00:00"
UNSYNCED_BRAND = "Brand#9"
#: Repositories that a task widens to metadata, about.
ROWS_A_TASK = 10_000

# Event types and topic nouns of the test tables in terms of code hosting.
EVENT_TYPES = {
    "purchase": "WatchEvent",
    "signup": "ForkEvent",
    "click": "PushEvent",
    "view": "CreateEvent",
    "error": "IssuesEvent",
}
TOPIC_NOUNS = {
    "widget": "llm",
    "gizmo": "agent",
    "ring": "diffusion",
    "bolt": "multimodal",
    "gear": "embedding",
}

EVENTS_SCHEMA = (
    "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
)
PART_SCHEMA = (
    "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double"
)


def _mapped(column, table):
    branches = None
    for old, new in table.items():
        branch = (column == old, F.lit(new))
        branches = F.when(*branch) if branches is None else branches.when(*branch)
    return branches


class Testbed:
    """Lazily built tables below one test folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        use_utc(spark)
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.dir}/{name}.parquet")

    # ----------------------------------------------------------------- repositories

    @lru_cache
    def repos(self) -> DataFrame:
        return self._repos_of(self.table("part", PART_SCHEMA))

    def _repos_of(self, part: DataFrame) -> DataFrame:
        kind = F.col("p_type")
        adjective = F.split_part("p_name", F.lit(" "), F.lit(1))
        noun = F.split_part("p_name", F.lit(" "), F.lit(2))
        topic = F.coalesce(_mapped(noun, TOPIC_NOUNS), noun)
        topics = (
            F.when(kind == "PROMO", F.lit(None).cast("array<string>"))
            .when(kind == "LARGE", F.array().cast("array<string>"))
            .when(kind == "STANDARD", F.array(F.upper(topic), adjective, F.lower(kind)))
            .otherwise(F.array(topic, adjective, F.lower(kind)))
        )
        owner = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
        name = F.concat(
            F.replace("p_name", F.lit(" "), F.lit("-")),
            F.lit("-"),
            F.col("p_partkey").cast("string"),
        )
        return part.select(
            "p_partkey",
            "p_brand",
            "p_size",
            (F.col("p_partkey") + 1).alias("repo_id"),
            F.concat(owner, F.lit("/"), name).alias("key_name"),
            owner.alias("owner"),
            name.alias("short"),
            F.when(kind == "SMALL", "").otherwise(kind).alias("language"),
            topics.alias("topics"),
            F.when(kind == "LARGE", F.concat("p_name", F.lit(" knowledge graph toolkit")))
            .otherwise(F.col("p_name"))
            .alias("description"),
        )

    @lru_cache
    def events(self) -> DataFrame:
        """Archive-shaped events, with the directory columns."""
        raw = self.table("events", EVENTS_SCHEMA)
        repos = self.repos()
        hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(EPOCH))) / 3600)
        joined = raw.withColumn(
            "k", F.get_json_object("props", "$.k").cast("bigint")
        ).join(repos, F.col("k") == F.col("p_partkey"))
        upper = F.col("event_id") % 2 == 1
        stars = F.greatest(
            F.lit(0), F.col("p_size") * 100 + hours * (F.col("p_partkey") % 7 - 1)
        )
        bot = F.when(F.col("user_id") % 50 == 0, "[bot]").otherwise("")
        return joined.select(
            F.col("event_id").cast("string").alias("event_id"),
            _mapped(F.col("event_type"), EVENT_TYPES).alias("event_type"),
            (F.col("user_id") + 1).alias("actor_id"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string"), bot).alias("actor_login"),
            "repo_id",
            F.concat(
                F.when(upper, F.upper("owner")).otherwise(F.col("owner")), F.lit("/"), "short"
            ).alias("repo_name"),
            F.col("ts").alias("created_at"),
            F.col("props").alias("payload_json"),
            stars.cast("bigint").alias("repo_stargazers_count"),
            F.col("language").alias("repo_primary_language"),
            F.col("topics").alias("repo_topics"),
            F.col("description").alias("repo_description"),
            F.lit("").alias("repo_full_metadata_json"),
            F.lit("").alias("repo_readme_text"),
            F.lit("[]").alias("repo_issues_json"),
            F.lit(True).alias("public"),
            F.to_date("ts").alias("event_date"),
        )

    @lru_cache
    def raw_events(self) -> DataFrame:
        """Events as they arrive: text times, and faults in rows with a small ``value``."""
        faulty = self.table("events", EVENTS_SCHEMA).select(
            F.col("event_id").cast("string").alias("event_id"), F.col("value").alias("_value")
        )
        value = F.floor("_value")
        zone = F.when(F.col("event_id").cast("bigint") % 2 == 1, "+00:00").otherwise("Z")
        text = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)

        def spoiled(fault: int, name: str, bad: Column, good: Column | None = None) -> Column:
            kept = F.col(name) if good is None else good
            return F.when(value == fault, bad).otherwise(kept)

        return (
            self.events()
            .join(faulty, "event_id")
            .select(
                spoiled(7, "event_id", F.lit("")).alias("event_id"),
                spoiled(3, "event_type", F.lower("event_type")).alias("event_type"),
                spoiled(2, "actor_id", F.lit(0)).cast("bigint").alias("actor_id"),
                spoiled(0, "actor_login", F.lit("  ")).alias("actor_login"),
                spoiled(1, "repo_id", F.lit(0)).cast("bigint").alias("repo_id"),
                spoiled(5, "repo_name", F.split_part("repo_name", F.lit("/"), F.lit(2))).alias(
                    "repo_name"
                ),
                spoiled(4, "created_at", F.lit("not a time"), text).alias("created_at"),
                spoiled(6, "repo_stargazers_count", F.lit(-1))
                .cast("bigint")
                .alias("repo_stargazers_count"),
                "repo_topics",
                "repo_description",
                "repo_primary_language",
                "payload_json",
                "repo_readme_text",
                "repo_issues_json",
                value.alias("fault"),
            )
        )

    @lru_cache
    def metadata(self) -> DataFrame:
        """Two versions of every synced repository.

        A row of ``part`` is a few bytes in its file and becomes wide here, so the rows are dealt out
        before, a number of rows to each task: the splits of the file would put a whole table of
        repositories into one, and so would partitions that are joined by the bytes of narrow rows. The
        stored columns are dealt, as a task that reads a large file holds all its rows while it does.
        """
        part = self.table("part", PART_SCHEMA)
        tasks = part.count() // ROWS_A_TASK + 1
        synced = self._repos_of(part.where(F.col("p_brand") != UNSYNCED_BRAND).repartitionByRange(tasks, "p_partkey"))
        versions = synced.withColumn("version", F.explode(F.sequence(F.lit(0), F.lit(1))))
        big = F.col("p_size") % 2 == 1
        full_name = F.concat(
            F.when(big, F.initcap("owner")).otherwise(F.col("owner")), F.lit("/"), "short"
        )
        stars = (
            F.col("p_size") * 100 + F.col("version") * (F.col("p_partkey") % 40 + 1)
        ).cast("bigint")
        created = F.date_add(F.lit("2008-01-01").cast("date"), (F.col("p_partkey") % 5000).cast("int"))
        pushed = F.date_add(F.lit("2023-12-15").cast("date"), F.col("p_size"))
        refreshed = F.date_add(
            F.lit("2024-01-10").cast("date"), (F.col("version") * 15).cast("int")
        ).cast("timestamp")
        category = F.when(F.col("p_size") < 5, "Other").otherwise(
            classify(F.col("topics"), F.col("description"))
        )
        zero = F.lit(0).cast("bigint")
        small = F.col("p_size").cast("bigint")
        values = {
            "repo_id": F.col("repo_id"),
            "repo_full_name": full_name,
            "repo_name": F.col("short"),
            "node_id": F.lit(""),
            "private": F.lit(False),
            "html_url": page_url(full_name),
            "clone_url": clone_url(full_name),
            "homepage": F.lit(""),
            "stargazers_count": stars,
            "watchers_count": stars,
            "forks_count": small * 7,
            "open_issues_count": small,
            "network_count": small * 8,
            "subscribers_count": small * 2,
            "size_kb": zero,
            "github_created_at": created.cast("timestamp"),
            "github_updated_at": refreshed,
            "github_pushed_at": pushed.cast("timestamp"),
            "primary_language": F.col("language"),
            "topics": F.coalesce("topics", F.array().cast("array<string>")),
            "visibility": F.lit("public"),
            "default_branch": F.lit("main"),
            "description": F.col("description"),
            "category": category,
            "is_fork": F.lit(False),
            "is_archived": F.lit(False),
            "is_disabled": F.lit(False),
            "has_issues": F.lit(True),
            "has_wiki": F.lit(False),
            "has_discussions": F.lit(False),
            "has_pages": F.lit(False),
            "allow_forking": F.lit(True),
            "is_template": F.lit(False),
            "owner_login": owner_of(full_name),
            "owner_id": zero,
            "owner_type": F.lit("Organization"),
            "owner_avatar_url": F.lit(""),
            "license_key": F.lit("mit"),
            "license_name": F.lit("MIT License"),
            "license_spdx_id": F.lit("MIT"),
            "rank": F.lit(0),
            "fetched_at": refreshed,
            "refreshed_at": refreshed,
        }
        return versions.select(*[values[name].alias(name) for name in METADATA_COLUMNS])

    @lru_cache
    def history(self) -> DataFrame:
        return event_to_history(self.events()).unionByName(
            metadata_to_history(self.metadata(), "sync_repo_metadata")
        )

    @lru_cache
    def star_counts(self) -> DataFrame:
        return ru.daily_star_counts(self.events())

    @lru_cache
    def lookup_name(self, repo_id: int) -> str:
        """Join key of a repository: a request parameter, so one name is fetched."""
        return self.repos().where(F.col("repo_id") == repo_id).first()["key_name"]



@lru_cache(maxsize=8)
def testbed(spark: SparkSession, sf_dir: str) -> Testbed:
    """Plans of the test tables are built once per session; no data is kept."""
    return Testbed(spark, sf_dir)


# --------------------------------------------------------------------------- the same in SQL


def _sql_case(column: str, table: dict[str, str], default: str | None = None) -> str:
    branches = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in table.items())
    return f"CASE {column} {branches} {'ELSE ' + default if default else ''} END"


def sql_classify(topics: str, description: str) -> str:
    """Exact classifier for the oracle: list membership, then substring search."""
    from starwake.vocab import CATEGORY_PHRASES, CATEGORY_TOPICS

    parts = []
    for name, words in CATEGORY_TOPICS.items():
        listed = ", ".join(f"'{word}'" for word in words)
        clean = f"list_transform(coalesce({topics}, []::VARCHAR[]), lambda t: trim(lower(t)))"
        parts.append(f"WHEN list_has_any({clean}, [{listed}]) THEN '{name}'")
    for name, words in CATEGORY_PHRASES.items():
        tests = " OR ".join(
            f"strpos(lower(coalesce({description}, '')), '{word}') > 0" for word in words
        )
        parts.append(f"WHEN {tests} THEN '{name}'")
    return f"(CASE {' '.join(parts)} ELSE 'Other' END)"


SQL_TABLES = f"""
repos AS (
  SELECT p_partkey, p_brand, p_size, p_partkey + 1 AS repo_id,
         lower(replace(p_brand, '#', '-')) AS owner,
         replace(p_name, ' ', '-') || '-' || p_partkey AS short,
         lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') || '-' || p_partkey
           AS key_name,
         CASE WHEN p_type = 'SMALL' THEN '' ELSE p_type END AS language,
         CASE WHEN p_type = 'PROMO' THEN NULL
              WHEN p_type = 'LARGE' THEN []::VARCHAR[]
              WHEN p_type = 'STANDARD' THEN [upper(topic), adjective, lower(p_type)]
              ELSE [topic, adjective, lower(p_type)] END AS topics,
         CASE WHEN p_type = 'LARGE' THEN p_name || ' knowledge graph toolkit' ELSE p_name END
           AS description
  FROM (SELECT *, split_part(p_name, ' ', 1) AS adjective,
               {_sql_case("split_part(p_name, ' ', 2)", TOPIC_NOUNS, "split_part(p_name, ' ', 2)")}
                 AS topic
        FROM part)
),
gh AS (
  SELECT CAST(e.event_id AS VARCHAR) AS event_id,
         {_sql_case("e.event_type", EVENT_TYPES)} AS event_type,
         e.user_id + 1 AS actor_id,
         'user-' || e.user_id || CASE WHEN e.user_id % 50 = 0 THEN '[bot]' ELSE '' END
           AS actor_login,
         r.repo_id,
         CASE WHEN e.event_id % 2 = 1 THEN upper(r.owner) ELSE r.owner END || '/' || r.short
           AS repo_name,
         r.key_name AS repo_key,
         e.ts AS created_at,
         e.props AS payload_json,
         CAST(greatest(0, r.p_size * 100
           + date_diff('hour', TIMESTAMP '{EPOCH}', e.ts) * (r.p_partkey % 7 - 1)) AS BIGINT)
           AS repo_stargazers_count,
         r.language AS repo_primary_language,
         r.topics AS repo_topics,
         r.description AS repo_description,
         CAST(e.ts AS DATE) AS event_date
  FROM events e JOIN repos r ON r.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
),
meta_versions AS (
  SELECT repo_id, key_name AS repo_key,
         CASE WHEN p_size % 2 = 1 THEN upper(owner[1]) || owner[2:] ELSE owner END || '/' || short
           AS repo_full_name,
         short AS repo_name,
         description, language AS primary_language,
         coalesce(topics, []::VARCHAR[]) AS topics,
         CASE WHEN p_size < 5 THEN 'Other' ELSE {sql_classify("topics", "description")} END
           AS category,
         CAST(p_size * 100 + version * (p_partkey % 40 + 1) AS BIGINT) AS stargazers_count,
         CAST(p_size * 7 AS BIGINT) AS forks_count,
         CAST(p_size AS BIGINT) AS open_issues_count,
         CAST(p_size * 2 AS BIGINT) AS subscribers_count,
         CAST(p_size * 8 AS BIGINT) AS network_count,
         CASE WHEN p_size % 2 = 1 THEN upper(owner[1]) || owner[2:] ELSE owner END AS owner_login,
         CAST(DATE '2008-01-01' + CAST(p_partkey % 5000 AS INTEGER) AS TIMESTAMP)
           AS github_created_at,
         CAST(DATE '2023-12-15' + p_size AS TIMESTAMP) AS github_pushed_at,
         CAST(DATE '2024-01-10' + CAST(version * 15 AS INTEGER) AS TIMESTAMP) AS refreshed_at
  FROM repos, (SELECT unnest([0, 1]) AS version)
  WHERE p_brand <> '{UNSYNCED_BRAND}'
),
meta AS (
  SELECT * FROM meta_versions WHERE refreshed_at = TIMESTAMP '2024-01-25 00:00:00'
),
star_counts AS (
  SELECT event_date, repo_name, CAST(count(*) AS BIGINT) AS star_count
  FROM gh WHERE event_type = 'WatchEvent' GROUP BY ALL
),
raw_gh AS (
  SELECT CASE WHEN fault = 7 THEN '' ELSE event_id END AS event_id,
         CASE WHEN fault = 3 THEN lower(event_type) ELSE event_type END AS event_type,
         CASE WHEN fault = 2 THEN 0 ELSE actor_id END AS actor_id,
         CASE WHEN fault = 0 THEN '  ' ELSE actor_login END AS actor_login,
         CASE WHEN fault = 1 THEN 0 ELSE repo_id END AS repo_id,
         CASE WHEN fault = 5 THEN split_part(repo_name, '/', 2) ELSE repo_name END AS repo_name,
         CASE WHEN fault = 4 THEN NULL ELSE created_at END AS created_at,
         CASE WHEN fault = 6 THEN -1 ELSE repo_stargazers_count END AS repo_stargazers_count,
         fault
  FROM (SELECT gh.*, CAST(floor(e.value) AS BIGINT) AS fault
        FROM gh JOIN events e ON gh.event_id = CAST(e.event_id AS VARCHAR))
)
"""
