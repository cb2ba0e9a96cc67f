"""Explicit schemas; nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(fields: str, **nested: T.DataType) -> T.StructType:
    """``name type`` pairs; the named ``nested`` types may be used besides the plain ones."""
    known = {**_TYPES, **nested}
    pairs = [field.split() for field in fields.split(",")]
    return T.StructType([T.StructField(name, known[kind]) for name, kind in pairs])


# One JSON object per message; created_at is still ISO text here.
WIRE_EVENT = _struct(
    """
    event_id string, event_type string, actor_id bigint, actor_login string,
    repo_id bigint, repo_name string, event_date string, created_at string,
    payload_json string, repo_stargazers_count bigint, repo_primary_language string,
    repo_topics array<string>, repo_description string, repo_full_metadata_json string,
    repo_readme_text string, repo_issues_json string, public boolean
    """
)

# Columns of the archive, without the two directory columns event_date and event_type.
ARCHIVE_EVENT = _struct(
    """
    event_id string, actor_id bigint, actor_login string, repo_id bigint, repo_name string,
    created_at timestamp, payload_json string, repo_stargazers_count bigint,
    repo_primary_language string, repo_topics array<string>, repo_description string,
    repo_full_metadata_json string, repo_readme_text string, repo_issues_json string,
    public boolean
    """
)

ARCHIVE_LAYOUT = _struct("event_date date, event_type string")

# Columns of the events table, in table order.
EVENT_COLUMNS = [
    "event_id",
    "event_type",
    "actor_id",
    "actor_login",
    "repo_id",
    "repo_name",
    "created_at",
    "payload_json",
    "repo_stargazers_count",
    "repo_primary_language",
    "repo_topics",
    "repo_description",
    "repo_full_metadata_json",
    "repo_readme_text",
    "repo_issues_json",
]

EVENT_TABLE = _struct(
    """
    event_id string, event_type string, actor_id bigint, actor_login string, repo_id bigint,
    repo_name string, created_at timestamp, payload_json string, repo_stargazers_count bigint,
    repo_primary_language string, repo_topics array<string>, repo_description string,
    repo_full_metadata_json string, repo_readme_text string, repo_issues_json string
    """
)

# Raw event as it comes from the hosting API, plus the three enrichment fields.
RAW_EVENT = _struct(
    """
    id string, type string, actor actor, repo repo, payload string, created_at string,
    public boolean, _full_repo full_repo, _repo_readme_text string, _repo_issues issues
    """,
    actor=_struct("id string, login string"),
    repo=_struct("id string, name string"),
    full_repo=_struct(
        "stargazers_count string, language string, topics array<string>, description string"
    ),
    issues=T.ArrayType(_struct("title string")),
)

REPO_METADATA = _struct(
    """
    repo_id bigint, repo_full_name string, repo_name string, node_id string, private boolean,
    html_url string, clone_url string, homepage string,
    stargazers_count bigint, watchers_count bigint, forks_count bigint, open_issues_count bigint,
    network_count bigint, subscribers_count bigint, size_kb bigint,
    github_created_at timestamp, github_updated_at timestamp, github_pushed_at timestamp,
    primary_language string, topics array<string>, visibility string, default_branch string,
    description string, category string,
    is_fork boolean, is_archived boolean, is_disabled boolean, has_issues boolean,
    has_wiki boolean, has_discussions boolean, has_pages boolean, allow_forking boolean,
    is_template boolean,
    owner_login string, owner_id bigint, owner_type string, owner_avatar_url string,
    license_key string, license_name string, license_spdx_id string,
    rank int, fetched_at timestamp, refreshed_at timestamp
    """
)

METADATA_COLUMNS = REPO_METADATA.fieldNames()
HISTORY_COLUMNS = METADATA_COLUMNS + ["snapshot_at", "snapshot_source", "snapshot_key"]

# The repository columns most reports show.
REPO_ROW = [
    "repo_id",
    "repo_full_name",
    "repo_name",
    "html_url",
    "description",
    "primary_language",
    "topics",
    "category",
    "stargazers_count",
    "watchers_count",
    "forks_count",
    "open_issues_count",
    "subscribers_count",
    "owner_login",
    "owner_avatar_url",
    "license_name",
    "github_created_at",
    "github_pushed_at",
    "rank",
]

# A landed repository file; numbers and flags are read as text so that one bad value does not
# turn the whole file into a corrupt record.
REPO_FILE = _struct(
    """
    id string, full_name string, name string, node_id string, private string, html_url string,
    clone_url string, homepage string, stargazers_count string, watchers_count string,
    forks_count string, open_issues_count string, network_count string, subscribers_count string,
    size string, created_at string, updated_at string, pushed_at string, language string,
    topics array<string>, visibility string, default_branch string, description string,
    fork string, archived string, disabled string, has_issues string, has_wiki string,
    has_discussions string, has_pages string, allow_forking string, is_template string,
    owner owner, license license,
    rank string, fetched_at string, refreshed_at string, _corrupt string
    """,
    owner=_struct("login string, id string, type string, avatar_url string"),
    license=_struct("key string, name string, spdx_id string"),
)

STAR_COUNTS = _struct("event_date date, repo_name string, star_count bigint")

HEADLINES = _struct(
    "repo_full_name string, position int, title string, url string, source string, "
    "parsed_url string, snippet string, content string, engine string"
)
