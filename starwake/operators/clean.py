"""Mapping, validation, cleaning and simple selections of events and repository records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.functions import classify as cat
from starwake.functions import text as tx
from starwake.functions.times import Moment, day, moment, parse_iso
from starwake.schemas import EVENT_COLUMNS, EVENT_TABLE, HISTORY_COLUMNS, METADATA_COLUMNS
from starwake.vocab import KNOWN_EVENT_TYPES, MAX_REPO_ID

# --------------------------------------------------------------------------- raw events


def admit_events(raw: DataFrame) -> DataFrame:
    """Drop only events without actor, repository name or a positive repository id.

    Bots and unrelated repositories stay.
    """
    return raw.where(
        ~tx.is_blank(F.col("actor_login"))
        & ~tx.is_blank(F.col("repo_name"))
        & (F.coalesce(F.col("repo_id"), F.lit(0)) > 0)
    )


def map_raw_event(raw: DataFrame) -> DataFrame:
    """Nested API events (``RAW_EVENT``) to flat events. ``created_at`` stays text."""
    repo = F.col("_full_repo")
    titles = F.transform(
        F.coalesce(F.col("_repo_issues"), F.array().cast("array<struct<title:string>>")),
        lambda issue: issue.getField("title"),
    )
    return raw.select(
        F.col("id").alias("event_id"),
        F.col("type").alias("event_type"),
        F.col("actor.id").try_cast("bigint").alias("actor_id"),
        F.col("actor.login").alias("actor_login"),
        F.col("repo.id").try_cast("bigint").alias("repo_id"),
        F.col("repo.name").alias("repo_name"),
        F.col("created_at"),
        F.coalesce(F.col("payload"), F.lit("{}")).alias("payload_json"),
        tx.whole_number(repo.getField("stargazers_count")).alias("repo_stargazers_count"),
        tx.text_or_empty(repo.getField("language")).alias("repo_primary_language"),
        tx.list_or_empty(repo.getField("topics")).alias("repo_topics"),
        tx.text_or_empty(repo.getField("description")).alias("repo_description"),
        F.coalesce(F.to_json(repo), F.lit("{}")).alias("repo_full_metadata_json"),
        tx.text_or_empty(F.col("_repo_readme_text")).alias("repo_readme_text"),
        F.coalesce(F.to_json(F.col("_repo_issues")), F.lit("[]")).alias("repo_issues_json"),
        titles.alias("issue_titles"),
        F.coalesce(F.col("public"), F.lit(True)).alias("public"),
    )


def reject_reason(created_at: Column) -> Column:
    """First broken rule of an event, NULL for a valid one."""
    name = F.coalesce(F.col("repo_name"), F.lit(""))
    repo_id = F.coalesce(F.col("repo_id"), F.lit(0))
    return (
        F.when(tx.is_blank(F.col("event_id")), "event_id")
        .when(~F.coalesce(F.col("event_type").isin(KNOWN_EVENT_TYPES), F.lit(False)), "event_type")
        .when(F.coalesce(F.col("actor_id"), F.lit(0)) <= 0, "actor_id")
        .when(tx.is_blank(F.col("actor_login")), "actor_login")
        .when((repo_id <= 0) | (repo_id > MAX_REPO_ID), "repo_id")
        .when(~F.rlike(name, F.lit("^[^/]+/[^/]+$")), "repo_name")
        .when(F.coalesce(F.col("repo_stargazers_count"), F.lit(0)) < 0, "stargazers_count")
        .when(created_at.isNull(), "created_at")
    )


def check_events(events: DataFrame) -> DataFrame:
    """Typed ``created_at`` and a ``reject_reason`` per event; nothing is dropped here."""
    kind = events.schema["created_at"].dataType.typeName()
    stamp = parse_iso(F.col("created_at")) if kind == "string" else F.col("created_at")
    return events.withColumn("reject_reason", reject_reason(stamp)).withColumn("created_at", stamp)


def valid_events(events: DataFrame) -> DataFrame:
    return check_events(events).where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_events(events: DataFrame) -> DataFrame:
    return check_events(events).where(F.col("reject_reason").isNotNull())


def keep_known_types(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin(KNOWN_EVENT_TYPES))


def ingest_quality_counts(events: DataFrame) -> DataFrame:
    """How a batch fared: raw, published, filtered at admission, failed validation."""
    admitted = (
        ~tx.is_blank(F.col("actor_login"))
        & ~tx.is_blank(F.col("repo_name"))
        & (F.coalesce(F.col("repo_id"), F.lit(0)) > 0)
    )
    checked = check_events(events).select(
        admitted.alias("admitted"), F.col("reject_reason").isNull().alias("valid")
    )
    return checked.agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(F.col("admitted") & F.col("valid")).alias("published_count"),
        F.count_if(~F.col("admitted")).alias("filtered_count"),
        F.count_if(F.col("admitted") & ~F.col("valid")).alias("validation_error_count"),
    )


def flag_bots(events: DataFrame) -> DataFrame:
    return events.withColumn("is_bot", F.endswith(F.col("actor_login"), F.lit("[bot]")))


def derive_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("created_at"))


def ai_signal(
    events: DataFrame, readme_chars: int | None = None, max_titles: int | None = None
) -> DataFrame:
    """Category and AI signal of the text around a repository. A label, never a filter.

    The whole README and all issue titles are looked at unless a limit is given.
    """
    titles = (
        F.col("issue_titles")
        if "issue_titles" in events.columns
        else F.from_json("repo_issues_json", "array<struct<title:string>>").getField("title")
    )
    text = cat.signal_text(
        F.col("repo_description"), F.col("repo_readme_text"), titles, readme_chars, max_titles
    )
    labelled = events.withColumn("_text", F.lower(text)).withColumn(
        "signal_category", cat.classify_lowered(F.col("repo_topics"), F.col("_text"))
    )
    signal = cat.ai_signal(F.col("signal_category"), F.col("_text"))
    return labelled.withColumn("ai_signal", signal).drop("_text")


def to_wire_event(events: DataFrame) -> DataFrame:
    """Events as Kafka records: key = repository id, value = JSON object."""
    fields = [
        F.date_format("created_at", "yyyy-MM-dd").alias("event_date")
        if name == "event_date"
        else F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at")
        if name == "created_at"
        else F.col(name)
        for name in [*EVENT_COLUMNS[:6], "event_date", *EVENT_COLUMNS[6:]]
    ]
    return events.select(
        F.col("repo_id").cast("string").alias("key"), F.to_json(F.struct(*fields)).alias("value")
    )


def normalise_event_defaults(events: DataFrame) -> DataFrame:
    """Table columns are never NULL: '' for text, 0 for numbers, [] for lists."""
    present = set(events.columns)
    defaults = {
        "string": F.lit(""),
        "long": F.lit(0).cast("bigint"),
        "array": tx.empty_list(),
    }

    def column(name: str) -> Column:
        kind = EVENT_TABLE[name].dataType
        if name not in present:
            return defaults[kind.typeName()].alias(name)
        value = F.col(name).cast(kind)
        if name == "created_at":
            return value
        return F.coalesce(value, defaults[kind.typeName()]).alias(name)

    return events.select(*[column(name) for name in EVENT_COLUMNS])


def with_repo_key(events: DataFrame) -> DataFrame:
    """Materialise the join key, so that lookups by name reach the file scan."""
    return events.withColumn("repo_key", tx.repo_key(F.col("repo_name")))


# --------------------------------------------------------------------------- repository records


def _instant(text: Column, fallback: Column) -> Column:
    return F.coalesce(parse_iso(F.nullif(text, F.lit(""))), fallback)


def map_repo_metadata(
    files: DataFrame,
    as_of: Moment,
    missing_time: Moment | None = None,
    loose: bool = False,
    fetched_flag: str | None = None,
) -> DataFrame:
    """Landed repository files (``REPO_FILE``) to metadata rows.

    Missing times become ``missing_time`` (default ``as_of``). ``loose`` uses the substring
    classifier and epoch times, as the enrichment of event-discovered repositories does.
    ``fetched_flag`` names a further column that tells whether a file has a ``fetched_at``.
    """
    late = moment(as_of)
    absent = moment(missing_time) if missing_time is not None else late
    if loose:
        absent = moment("1970-01-01 00:00:00")
    category = (
        cat.classify_loose(F.col("topics"), F.col("description"), F.col("full_name"))
        if loose
        else cat.classify(F.col("topics"), F.col("description"))
    )

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    values = {
        "repo_id": tx.whole_number(F.col("id")),
        "repo_full_name": text("full_name"),
        "repo_name": text("name"),
        "node_id": text("node_id"),
        "private": tx.flag_of(F.col("private"), False),
        "html_url": text("html_url"),
        "clone_url": text("clone_url"),
        "homepage": text("homepage"),
        "size_kb": tx.whole_number(F.col("size")),
        "github_created_at": _instant(F.col("created_at"), absent),
        "github_updated_at": _instant(F.col("updated_at"), absent),
        "github_pushed_at": _instant(F.col("pushed_at"), absent),
        "primary_language": text("language"),
        "topics": tx.list_or_empty(F.col("topics")),
        "visibility": text("visibility", "public"),
        "default_branch": text("default_branch", "main"),
        "description": text("description"),
        "category": category,
        "is_fork": tx.flag_of(F.col("fork"), False),
        "is_archived": tx.flag_of(F.col("archived"), False),
        "is_disabled": tx.flag_of(F.col("disabled"), False),
        "has_issues": tx.flag_of(F.col("has_issues"), not loose),
        "has_wiki": tx.flag_of(F.col("has_wiki"), False),
        "has_discussions": tx.flag_of(F.col("has_discussions"), False),
        "has_pages": tx.flag_of(F.col("has_pages"), False),
        "allow_forking": tx.flag_of(F.col("allow_forking"), not loose),
        "is_template": tx.flag_of(F.col("is_template"), False),
        "owner_login": text("owner.login"),
        "owner_id": tx.whole_number(F.col("owner.id")),
        "owner_type": text("owner.type"),
        "owner_avatar_url": text("owner.avatar_url"),
        "license_key": text("license.key"),
        "license_name": text("license.name"),
        "license_spdx_id": text("license.spdx_id"),
        "rank": F.lit(0) if loose else tx.whole_number(F.col("rank")).cast("int"),
        "fetched_at": late if loose else _instant(F.col("fetched_at"), late),
        "refreshed_at": late if loose else _instant(F.col("refreshed_at"), late),
    }
    for count in (
        "stargazers_count",
        "watchers_count",
        "forks_count",
        "open_issues_count",
        "network_count",
        "subscribers_count",
    ):
        values[count] = tx.whole_number(F.col(count))
    flags = [] if fetched_flag is None else [(tx.text_or_empty(F.col("fetched_at")) != "").alias(fetched_flag)]
    return files.select(*[values[name].alias(name) for name in METADATA_COLUMNS], *flags)


def _snapshot_constants() -> dict[str, Column]:
    """What an event does not know about its repository."""
    zero = F.lit(0).cast("bigint")
    empty = F.lit("")
    return {
        "node_id": empty,
        "private": F.lit(False),
        "homepage": empty,
        "forks_count": zero,
        "open_issues_count": zero,
        "network_count": zero,
        "subscribers_count": zero,
        "size_kb": zero,
        "visibility": F.lit("public"),
        "default_branch": F.lit("main"),
        "category": F.lit("Other"),
        "is_fork": F.lit(False),
        "is_archived": F.lit(False),
        "is_disabled": F.lit(False),
        "has_issues": F.lit(True),
        "has_wiki": F.lit(False),
        "has_discussions": F.lit(False),
        "has_pages": F.lit(False),
        "allow_forking": F.lit(True),
        "is_template": F.lit(False),
        "owner_id": zero,
        "owner_type": empty,
        "owner_avatar_url": empty,
        "license_key": empty,
        "license_name": empty,
        "license_spdx_id": empty,
        "rank": F.lit(0),
    }


def snapshot_columns(known: dict[str, Column], names: list[str]) -> list[Column]:
    """Metadata columns derived from an event-side name plus the values known from events."""
    name = F.col("repo_name")
    values = {
        **_snapshot_constants(),
        "repo_id": F.col("repo_id"),
        "repo_full_name": name,
        "repo_name": tx.snapshot_short_name_of(name),
        "owner_login": tx.snapshot_owner_of(name),
        "html_url": tx.page_url(name),
        "clone_url": tx.clone_url(name),
        **known,
    }
    return [values[column].alias(column) for column in names]


def event_to_history(events: DataFrame) -> DataFrame:
    """One observation of the repository per event."""


    stars, seen = F.col("repo_stargazers_count"), F.col("created_at")
    known = {
        "stargazers_count": stars,
        "watchers_count": stars,
        "primary_language": F.col("repo_primary_language"),
        "topics": F.col("repo_topics"),
        "description": F.col("repo_description"),
        "github_created_at": seen,
        "github_updated_at": seen,
        "github_pushed_at": seen,
        "fetched_at": seen,
        "refreshed_at": seen,
        "snapshot_at": seen,
        "snapshot_source": F.lit("github_event"),
        "snapshot_key": F.col("event_id"),
    }
    return events.select(*snapshot_columns(known, HISTORY_COLUMNS))


def metadata_to_history(metadata: DataFrame, source: str) -> DataFrame:
    """One snapshot row per metadata record; the key makes a replay recognisable."""
    iso = "yyyy-MM-dd'T'HH:mm:ssXXX"
    key = F.concat_ws(
        ":",
        F.lit(source),
        F.col("repo_full_name"),
        F.date_format("refreshed_at", iso),
        F.date_format("fetched_at", iso),
    )
    return metadata.select(
        *METADATA_COLUMNS,
        F.col("refreshed_at").alias("snapshot_at"),
        F.lit(source).alias("snapshot_source"),
        key.alias("snapshot_key"),
    )


def with_search_document(repos: DataFrame, max_chars: int | None = None) -> DataFrame:
    names = (
        "repo_full_name repo_name owner_login primary_language category topics description"
    ).split()
    document = tx.search_document(*[F.col(name) for name in names], max_chars=max_chars)
    return repos.withColumn("search_document", document)


def with_effective_category(repos: DataFrame) -> DataFrame:
    return repos.withColumn(
        "category",
        cat.effective_category(F.col("category"), F.col("topics"), F.col("description")),
    )


# --------------------------------------------------------------------------- selections


def filter_catalog(
    repos: DataFrame,
    min_stars: int = 0,
    category: str | None = None,
    language: str | None = None,
) -> DataFrame:
    chosen = repos.where(F.col("stargazers_count") >= min_stars)
    if category:
        chosen = chosen.where(F.col("category") == category)
    if language:
        chosen = chosen.where(F.lower("primary_language") == language.lower())
    return chosen


def prefer_categorised(repos: DataFrame) -> DataFrame:
    """Leave out Other, unless Other is all there is."""
    any_known = repos.select(
        F.coalesce(F.max(F.col("category") != "Other"), F.lit(False)).alias("known")
    ).scalar()
    return repos.where((F.col("category") != "Other") | ~any_known)


def events_by_repo(events: DataFrame, repo_id: int, limit: int = 100) -> DataFrame:
    return (
        events.where(F.col("repo_id") == repo_id)
        .orderBy(F.desc("created_at"), "event_id")
        .limit(limit)
    )


def events_by_date_range(
    events: DataFrame, start: Moment, end: Moment, limit: int = 1000
) -> DataFrame:
    """Whole UTC days, both ends included, newest first."""
    after = F.date_add(day(end), 1).cast("timestamp")
    return (
        events.where(
            (F.col("created_at") >= day(start).cast("timestamp")) & (F.col("created_at") < after)
        )
        .orderBy(F.desc("created_at"), "event_id")
        .limit(limit)
    )


def latest_events(
    events: DataFrame, as_of: Moment, limit: int = 100, event_type: str | None = None
) -> DataFrame:
    """Newest events of the day of ``as_of``. The type is filtered before the limit."""
    start = day(as_of).cast("timestamp")
    chosen = events.where((F.col("created_at") >= start) & (F.col("created_at") <= moment(as_of)))
    if event_type:
        chosen = chosen.where(F.col("event_type") == event_type)
    return chosen.orderBy(F.desc("created_at"), "event_id").limit(limit)


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    return (
        events.select("created_at", "event_type", "actor_login", "repo_name", "event_id")
        .orderBy(F.desc("created_at"), "event_id")
        .limit(limit)
    )


