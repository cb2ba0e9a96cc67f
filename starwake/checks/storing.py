"""Checks of sources, sinks, jobs and streams. All of them write and read real files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.checks import check
from starwake.checks.cleaning import HISTORY_NAMES, HISTORY_SQL, SOME_EVENT_COLUMNS
from starwake.checks.sql import STAR
from starwake.operators import clean as cl
from starwake.operators import rollups as ru
from starwake.operators.catalog import repo_summary_report, summary_header
from starwake.plans import jobs
from starwake.schemas import EVENT_COLUMNS, METADATA_COLUMNS, REPO_FILE
from starwake.session import fresh_path
from starwake.sources import archive as ar
from starwake.sources import tables
from starwake.sources.files import write_text
from starwake.sources.repo_files import good_files, parse_repo_files, parse_report
from starwake.sources.repo_files import read_repo_json as read_files
from starwake.sources.segments import read_segments
from starwake.streaming import ingest, supervise
from starwake.testbed import AS_OF, Testbed, sql_classify

ARCHIVE_COLUMNS = [*EVENT_COLUMNS[:12], "event_date"]


def _archive(t: Testbed) -> str:
    path = fresh_path(t.spark, "archive")
    ar.append_archive(t.events(), path)
    return path


@check(
    "append_archive_partition",
    "SELECT event_date, event_type, count(*) AS rows FROM gh GROUP BY ALL",
)
def append_archive_partition(t: Testbed) -> DataFrame:
    """Every partition, each given its records and, again, none.

    Events are landed by partition first, so that an append reads no rows but its own. Those without
    a date or a type belong to no given partition and are appended as they are.
    """
    path, landed = fresh_path(t.spark, "archive"), fresh_path(t.spark, "landed")
    arranged = t.events().repartitionByRange("event_date", "event_type", "event_id")
    arranged.write.partitionBy("event_date", "event_type").parquet(landed)
    events = t.spark.read.schema(t.events().schema).parquet(landed)
    placed = events.select("event_date", "event_type").distinct()
    for on, kind in placed.dropna().orderBy("event_date", "event_type").collect():
        mine = events.where((F.col("event_date") == F.lit(on)) & (F.col("event_type") == kind))
        ar.append_archive_partition(mine.drop("event_date", "event_type"), path, on, kind)
        ar.append_archive_partition(mine.limit(0), path, on, kind)
    unplaced = events.where(F.col("event_date").isNull() | F.col("event_type").isNull())
    if not unplaced.isEmpty():
        ar.append_archive(unplaced, path)
    rows = ar.read_archive(t.spark, path)
    return rows.groupBy("event_date", "event_type").agg(F.count(F.lit(1)).alias("rows"))


@check(
    "read_archive_range",
    f"""SELECT {SOME_EVENT_COLUMNS.replace('coalesce(repo_topics, []::VARCHAR[])', 'repo_topics')},
               event_date FROM gh
        WHERE event_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-15'""",
)
def read_archive_range(t: Testbed) -> DataFrame:
    return ar.read_archive_range(t.spark, _archive(t), "2024-01-15", 7).select(*ARCHIVE_COLUMNS)


@check(
    "read_archive_partition",
    """SELECT event_id, event_type, created_at, event_date FROM gh
       WHERE event_date = DATE '2024-01-15' AND event_type = 'ForkEvent'""",
)
def read_archive_partition(t: Testbed) -> DataFrame:
    rows = ar.read_archive_partition(t.spark, _archive(t), "2024-01-15", "ForkEvent")
    return rows.select("event_id", "event_type", "created_at", "event_date")


@check(
    "read_archive_evolved",
    """SELECT event_id, event_type, created_at,
              CASE WHEN event_type = 'ForkEvent' THEN NULL ELSE repo_description END
                AS repo_description FROM gh""",
)
def read_archive_evolved(t: Testbed) -> DataFrame:
    """Fork events come from an older writer: text times and no repository columns."""
    path = fresh_path(t.spark, "mixed")
    events = t.events()
    old = events.where("event_type = 'ForkEvent'").select(
        "event_id",
        "actor_id",
        "actor_login",
        "repo_id",
        "repo_name",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
        "payload_json",
        "public",
        "event_date",
        "event_type",
    )
    ar.append_archive(events.where("event_type <> 'ForkEvent'"), path)
    old.write.mode("append").partitionBy("event_date", "event_type").parquet(path)
    rows = ar.read_archive_evolved(t.spark, path)
    return rows.select("event_id", "event_type", "created_at", "repo_description")


@check("save_event_batch", f"SELECT {SOME_EVENT_COLUMNS}, repo_key FROM gh")
def save_event_batch(t: Testbed) -> DataFrame:
    path = fresh_path(t.spark, "events")
    tables.save_event_batch(t.events(), path)
    return t.spark.read.parquet(path).select(*EVENT_COLUMNS[:12], "repo_key")


@check("backfill_events", f"""SELECT {SOME_EVENT_COLUMNS} FROM gh
       WHERE event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""")
def backfill_events(t: Testbed) -> DataFrame:
    table = fresh_path(t.spark, "events")
    jobs.backfill_events(t.spark, _archive(t), table, "2024-01-05", "2024-01-25")
    return t.spark.read.parquet(table).select(*EVENT_COLUMNS[:12])


_WEEK = "event_date BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'"


@check(
    "nightly_batch",
    f"""SELECT *, count(*) OVER (PARTITION BY part) AS reported FROM (
          SELECT 'star_counts' AS part, repo_name, CAST(event_date AS VARCHAR) AS of, count(*) AS amount
          FROM gh WHERE {STAR} AND {_WEEK} GROUP BY ALL
          UNION ALL
          SELECT 'activity', repo_name, event_type, count(*) FROM gh WHERE {_WEEK} GROUP BY ALL)""",
)
def nightly_batch(t: Testbed) -> DataFrame:
    """Run twice: the second run replaces the first. Both tables, with the reported numbers of rows."""
    archive, out = _archive(t), fresh_path(t.spark, "nightly")
    for _ in range(2):
        counts = jobs.nightly_batch(t.spark, archive, out, AS_OF, "2024-01-30")
    stars = t.spark.read.parquet(f"{out}/repo_star_counts").select(
        F.lit("star_counts").alias("part"),
        "repo_name",
        F.col("event_date").cast("string").alias("of"),
        F.col("star_count").alias("amount"),
        F.lit(counts["star_counts"]).cast("bigint").alias("reported"),
    )
    activity = t.spark.read.parquet(f"{out}/repo_activity_summary").select(
        F.lit("activity"), "repo_name", "event_type", "event_count", F.lit(counts["activity"]).cast("bigint")
    )
    return stars.union(activity)


@check(
    "upsert_repo_metadata",
    """SELECT repo_id, repo_full_name, stargazers_count, refreshed_at FROM meta""",
)
def upsert_repo_metadata(t: Testbed) -> DataFrame:
    """The newer versions first, then the older ones, which must not win."""
    base = fresh_path(t.spark, "metadata")
    newest = F.lit("2024-01-25").cast("timestamp")
    tables.upsert_repo_metadata(t.metadata().where(F.col("refreshed_at") == newest), base)
    current = tables.upsert_repo_metadata(
        t.metadata().where(F.col("refreshed_at") < newest), base
    )
    return current.select("repo_id", "repo_full_name", "stargazers_count", "refreshed_at")


@check(
    "append_repo_history",
    """SELECT repo_id, repo_full_name, stargazers_count, refreshed_at AS snapshot_at,
         'sync_repo_metadata' AS snapshot_source,
         'sync_repo_metadata:' || repo_full_name || ':' || strftime(refreshed_at,
           '%Y-%m-%dT%H:%M:%SZ') || ':' || strftime(refreshed_at, '%Y-%m-%dT%H:%M:%SZ')
           AS snapshot_key FROM meta_versions""",
)
def append_repo_history(t: Testbed) -> DataFrame:
    """Appended twice, read once."""
    path = fresh_path(t.spark, "history")
    tables.append_repo_history(t.metadata(), path, "sync_repo_metadata")
    history = tables.append_repo_history(t.metadata(), path, "sync_repo_metadata")
    return history.select(
        "repo_id",
        "repo_full_name",
        "stargazers_count",
        "snapshot_at",
        "snapshot_source",
        "snapshot_key",
    )


@check(
    "bootstrap_observations",
    f"""SELECT {HISTORY_SQL} FROM gh""",
)
def bootstrap_observations(t: Testbed) -> DataFrame:
    base, path = fresh_path(t.spark, "metadata"), fresh_path(t.spark, "history")
    for _ in range(2):
        jobs.bootstrap_observations(t.events(), base, path)
    return t.spark.read.parquet(path).select(*HISTORY_NAMES)


@check(
    "retention_plan",
    """SELECT CAST(event_date AS VARCHAR) AS partition,
              CASE WHEN event_date < DATE '2024-01-11' THEN 'drop' ELSE 'keep' END AS action,
              count(DISTINCT event_type) AS files, 8 * count(*) AS bytes
       FROM gh GROUP BY event_date""",
)
def retention_plan(t: Testbed) -> DataFrame:
    """Over an archive of text files, one a partition, whose sizes are eight bytes an event."""
    path = fresh_path(t.spark, "archive")
    rows = t.events().select(F.lit("1234567").alias("value"), "event_date", "event_type")
    rows.repartition("event_date", "event_type").write.partitionBy("event_date", "event_type").text(path)
    return jobs.retention_plan(t.spark, path, AS_OF, keep_days=20, pattern="*.txt")


@check(
    "write_catalog_snapshot",
    """SELECT repo_full_name, stargazers_count,
              row_number() OVER (ORDER BY stargazers_count DESC, repo_full_name) AS rank FROM meta""",
)
def write_catalog_snapshot(t: Testbed) -> DataFrame:
    base = fresh_path(t.spark, "catalogue")
    report = repo_summary_report(t.metadata())
    shards = report.select(F.lit("all").alias("shard")).distinct()
    tables.write_catalog_snapshot(report, shards, base, "20240130T000000Z")
    tables.write_catalog_snapshot(report, shards, base, "20240131T000000Z")
    latest = tables.latest_snapshot(t.spark, base)
    schema = "repo_full_name string, stargazers_count bigint, rank bigint"
    return t.spark.read.schema(schema).json(f"{latest}/repos")


def _repo_fields(columns: list[str]) -> list[Column]:
    """The fields of a landed file from a metadata row."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    names = {
        "id": F.col("repo_id"),
        "full_name": F.col("repo_full_name"),
        "name": F.col("repo_name"),
        "size": F.col("size_kb"),
        "created_at": F.date_format("github_created_at", iso),
        "updated_at": F.date_format("github_updated_at", iso),
        "pushed_at": F.date_format("github_pushed_at", iso),
        "language": F.col("primary_language"),
        "fetched_at": F.date_format("fetched_at", iso),
        "refreshed_at": F.date_format("refreshed_at", iso),
        "owner": F.struct(F.col("owner_login").alias("login"), F.col("owner_id").alias("id")),
        "license": F.struct(
            F.col("license_key").alias("key"), F.col("license_name").alias("name"), F.col("license_spdx_id").alias("spdx_id")
        ),
    }
    plain = [name for name in REPO_FILE.fieldNames() if name in columns]
    return [
        *[value.alias(name) for name, value in names.items()],
        *[F.col(name) for name in plain if name not in names],
    ]


def _landed_repos(t: Testbed) -> DataFrame:
    """The newest metadata as landed JSON texts; the rows of one small size are cut short."""
    text = F.to_json(F.struct(*_repo_fields(METADATA_COLUMNS)))
    latest = ru.latest_full_metadata(t.metadata())
    # Open issues carry the part's size in the test tables.
    broken = F.when(F.col("open_issues_count") == 7, F.substring_index(text, ",", 3)).otherwise(text)
    return parse_repo_files(
        latest.select(F.col("repo_id").cast("string").alias("file_name"), broken.alias("value"))
    )


#: Objects in a landed file, one a line; every so many repositories, one has a file of its own.
FILE_OBJECTS = 1000


def _landed_files(t: Testbed, rows: DataFrame, again: bool = False) -> str:
    """A folder with JSON files of one and of many repositories, one that is cut short, and a summary
    of all."""
    folder = fresh_path(t.spark, "repos")

    def land(records: DataFrame, name: str) -> None:
        alone = F.coalesce(F.pmod("id", F.lit(FILE_OBJECTS)) == 0, F.lit(False))
        records.where(~alone).write.option("maxRecordsPerFile", FILE_OBJECTS).json(f"{folder}/{name}")
        records.where(alone).write.mode("append").option("maxRecordsPerFile", 1).json(f"{folder}/{name}")

    records = rows.select(*_repo_fields(rows.columns))
    land(records, "first")
    if again:
        # A second object for some repositories, with an older refresh.
        older = records.where(F.col("id") % 5 == 0).withColumn("refreshed_at", F.lit("2024-01-02T00:00:00Z"))
        land(older, "second")
    write_text(t.spark, f"{folder}/first/broken.json", '{"id": 1, "full_name": "a/')
    write_text(t.spark, f"{folder}/first/repo_summary.json", '{"total_repos": 7}')
    return f"{folder}/*"


@check(
    "read_repo_json",
    """SELECT repo_full_name AS full_name, stargazers_count, NULL AS parse_error FROM meta
       UNION ALL SELECT NULL, NULL, 'not JSON'""",
)
def read_repo_json(t: Testbed) -> DataFrame:
    files = read_files(t.spark, _landed_files(t, ru.latest_full_metadata(t.metadata())))
    return files.select(
        F.when(F.col("parse_error").isNull(), F.col("full_name")).alias("full_name"),
        F.when(F.col("parse_error").isNull(), F.col("stargazers_count").cast("bigint")).alias("stargazers_count"),
        "parse_error",
    )


@check(
    "repo_files_report",
    """SELECT count(*) AS parsed, 1::BIGINT AS skipped, count(*) AS total_repos, max(refreshed_at) AS updated_at
       FROM meta""",
)
def repo_files_report(t: Testbed) -> DataFrame:
    """How many objects were read and skipped, and the header of the summary made of them."""
    files = read_files(t.spark, _landed_files(t, ru.latest_full_metadata(t.metadata())))
    header = summary_header(repo_summary_report(cl.map_repo_metadata(good_files(files), AS_OF)))
    one = header.select(F.lit(1).alias("_one"), "*")
    return parse_report(files).withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


@check(
    "metadata_refresh",
    """SELECT repo_full_name, stargazers_count, row_number() OVER (ORDER BY stargazers_count DESC, repo_full_name) AS rank,
         CASE WHEN repo_id % 2 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-01-25 00:00:00' END
           AS fetched_at, refreshed_at, 2::BIGINT AS snapshots FROM meta""",
)
def metadata_refresh(t: Testbed) -> DataFrame:
    """A table of older versions is refreshed from files, twice; half of the files lack the time of
    their fetch, and some repositories have two files."""
    base, history = fresh_path(t.spark, "metadata"), fresh_path(t.spark, "history")
    old = t.metadata().where(F.col("refreshed_at") < "2024-01-25")
    tables.upsert_repo_metadata(old, base)
    tables.append_repo_history(old, history, "sync_repo_metadata")
    latest = ru.latest_full_metadata(t.metadata())
    fetched = F.when(F.col("repo_id") % 2 == 1, F.col("fetched_at"))
    folder = _landed_files(t, latest.withColumn("fetched_at", fetched), again=True)
    for _ in range(2):
        report = jobs.metadata_refresh(t.spark, folder, base, history, AS_OF)
    current = tables.read_current(t.spark, base).select("repo_full_name", "fetched_at")
    snapshots = tables.read_history(t.spark, history).groupBy("repo_full_name").agg(
        F.count(F.lit(1)).alias("snapshots")
    )
    return (
        report.select("repo_full_name", "stargazers_count", "rank", "refreshed_at")
        .join(current, "repo_full_name")
        .join(snapshots, "repo_full_name")
    )


@check(
    "map_repo_metadata",
    f"""SELECT repo_id, repo_full_name, repo_name, stargazers_count, forks_count, open_issues_count,
          network_count, primary_language, array_to_string(topics, ',') AS topics, description,
          {sql_classify("topics", "description")} AS category, owner_login,
          'MIT License' AS license_name, 'public' AS visibility, 'main' AS default_branch,
          true AS has_issues, true AS allow_forking, github_created_at, github_pushed_at,
          refreshed_at FROM meta WHERE open_issues_count <> 7""",
)
def map_repo_metadata(t: Testbed) -> DataFrame:
    return cl.map_repo_metadata(good_files(_landed_repos(t)), AS_OF).select(
        "repo_id",
        "repo_full_name",
        "repo_name",
        "stargazers_count",
        "forks_count",
        "open_issues_count",
        "network_count",
        "primary_language",
        "topics",
        "description",
        "category",
        "owner_login",
        "license_name",
        "visibility",
        "default_branch",
        "has_issues",
        "allow_forking",
        "github_created_at",
        "github_pushed_at",
        "refreshed_at",
    )


@check(
    "stream_progress",
    """SELECT 'ingest' AS query, 2 * count(*) AS rows, 2::BIGINT AS batches, false AS lag_warning,
              false AS is_stale FROM gh""",
)
def stream_progress(t: Testbed) -> DataFrame:
    """Reports of an ingest that is stopped and started again with more input, from their table."""
    import time

    base, reports, landed = fresh_path(t.spark, "stream"), fresh_path(t.spark, "progress"), fresh_path(t.spark, "landed")
    records = cl.to_wire_event(t.events()).select("value")
    for batches in (1, 2):
        records.write.mode("append").text(landed)
        log = supervise.ProgressLog(t.spark, reports)
        t.spark.streams.addListener(log)
        try:
            supervise.finish(ingest.start_ingest(ingest.text_source(t.spark, landed), base, once=True))
            for _ in range(100):  # reports come a little after their batch
                if supervise.read_progress(t.spark, reports).where("rows > 0").count() >= batches:
                    break
                time.sleep(0.1)
        finally:
            t.spark.streams.removeListener(log)
    progress = supervise.read_progress(t.spark, reports).where("rows > 0")
    totals = progress.groupBy("query").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("batches"), F.max("lag_warning").alias("lag_warning")
    )
    fresh = supervise.stream_freshness(progress, AS_OF)
    return totals.join(fresh.select("query", "is_stale"), "query")


# --------------------------------------------------------------------------- streams


def _landed(t: Testbed) -> str:
    """All events as JSON lines, and once more in a second load, as after a producer's retry."""
    path = fresh_path(t.spark, "landed")
    records = cl.to_wire_event(t.events()).select("value")
    records.write.mode("append").text(path)
    records.write.mode("append").text(path)
    return path


def _ingest(t: Testbed) -> str:
    base = fresh_path(t.spark, "stream")
    records = ingest.text_source(t.spark, _landed(t))
    supervise.finish(ingest.start_ingest(records, base, once=True))
    return base


@check(
    "sink_archive_stream",
    "SELECT event_date, event_type, count(*) AS rows, count(DISTINCT event_id) AS events "
    "FROM gh GROUP BY ALL",
)
def sink_archive_stream(t: Testbed) -> DataFrame:
    rows = ar.read_archive(t.spark, f"{_ingest(t)}/archive")
    return rows.groupBy("event_date", "event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("events")
    )


@check("sink_events_foreach_batch", f"SELECT {SOME_EVENT_COLUMNS} FROM gh")
def sink_events_foreach_batch(t: Testbed) -> DataFrame:
    return ingest.read_table(t.spark, _ingest(t), "events").select(*EVENT_COLUMNS[:12])


@check(
    "stream_history_view",
    "SELECT event_id AS snapshot_key, repo_name AS repo_full_name, repo_stargazers_count "
    "AS stargazers_count, created_at AS snapshot_at FROM gh",
)
def stream_history_view(t: Testbed) -> DataFrame:
    history = ingest.read_table(t.spark, _ingest(t), "history")
    return history.select("snapshot_key", "repo_full_name", "stargazers_count", "snapshot_at")


@check(
    "stream_dual_sink",
    """SELECT 'archive' AS sink, count(*) AS rows FROM gh
       UNION ALL SELECT 'events', count(*) FROM gh UNION ALL SELECT 'history', count(*) FROM gh""",
)
def stream_dual_sink(t: Testbed) -> DataFrame:
    """Both sinks of one stream end with the same rows."""
    base = _ingest(t)
    report = None
    for sink in ("archive", "events", "history"):
        row = ingest.read_table(t.spark, base, sink).agg(
            F.lit(sink).alias("sink"), F.count(F.lit(1)).alias("rows")
        )
        report = row if report is None else report.unionByName(row)
    return report


@check(
    "stream_dedup_events",
    "SELECT event_id, 1::BIGINT AS copies FROM gh",
)
def stream_dedup_events(t: Testbed) -> DataFrame:
    rows = ingest.read_table(t.spark, _ingest(t), "events")
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))


#: A value for each field with which an event is rejected for that field.
SPOILED = {
    "event_id": " ",
    "event_type": "UnknownEvent",
    "actor_id": 0,
    "actor_login": "",
    "repo_id": 0,
    "repo_name": "noslash",
    "repo_stargazers_count": -1,
    "created_at": None,
}


def _out_of_order(t: Testbed) -> str:
    """An ingest that runs after each of four loads, a micro-batch each: the latest third of the days
    first, each load with copies of rows from another one, and lines that are no events."""
    base, landed = fresh_path(t.spark, "late"), fresh_path(t.spark, "landed")

    def load(lines: DataFrame) -> None:
        lines.write.mode("append").text(landed)
        supervise.finish(ingest.start_ingest(ingest.text_source(t.spark, landed), base, once=True))

    events = t.events()
    third = F.pmod(F.dayofyear("created_at"), F.lit(3))
    for part in (2, 0, 1):
        mine = events.where(third == part)
        again = events.where((third == (part + 1) % 3) & (F.hour("created_at") == 3))
        load(cl.to_wire_event(mine.unionByName(again)).select("value"))
    broken = t.spark.createDataFrame([("{broken",), ("",)], "value string")
    one = events.orderBy("event_id").limit(1)
    for name, value in SPOILED.items():
        spoiled = one.withColumn(name, F.lit(value).cast(one.schema[name].dataType))
        broken = broken.unionByName(cl.to_wire_event(spoiled).select("value"))
    load(broken)
    ingest.close_ingest_days(t.spark, base, "2024-01-21")
    return base


@check(
    "stream_late_events",
    """SELECT sink, event_id FROM gh, (VALUES ('archive'), ('events'), ('history')) AS sinks(sink)""",
)
def stream_late_events(t: Testbed) -> DataFrame:
    """Every event once in every table, though most days come after later ones and the earlier ones
    have been merged."""
    base = _out_of_order(t)
    report = None
    for sink, key in (("archive", "event_id"), ("events", "event_id"), ("history", "snapshot_key")):
        rows = ingest.read_table(t.spark, base, sink).select(
            F.lit(sink).alias("sink"), F.col(key).alias("event_id")
        )
        report = rows if report is None else report.unionByName(rows)
    return report


@check(
    "stream_quarantine",
    f"""SELECT 'undecodable' AS reason, 2::BIGINT AS rows
        UNION ALL SELECT * FROM (VALUES {", ".join(f"('{'stargazers_count' if name == 'repo_stargazers_count' else name}', 1)" for name in SPOILED)})""",
)
def stream_quarantine(t: Testbed) -> DataFrame:
    rows = ingest.read_table(t.spark, _out_of_order(t), "quarantine")
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@check(
    "stream_hourly_counts",
    """SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS window_start,
              CAST(date_trunc('hour', created_at) AS TIMESTAMP) + INTERVAL 1 HOUR AS window_end,
              repo_name, event_type, count(*) AS event_count
       FROM gh GROUP BY ALL""",
)
def stream_hourly_counts(t: Testbed) -> DataFrame:
    return ingest.read_hourly_counts(t.spark, _out_of_order(t))


@check(
    "stream_enrich",
    """SELECT event_id, gh.repo_name, coalesce(stargazers_count, 0) AS repo_stargazers_count,
              meta.repo_key IS NULL AS metadata_missing
       FROM gh LEFT JOIN meta ON gh.repo_key = meta.repo_key""",
)
def stream_enrich(t: Testbed) -> DataFrame:
    """In two loads, a micro-batch each: the second one starts from the summary of the first."""
    base, once, landed = fresh_path(t.spark, "enrich"), fresh_path(t.spark, "metadata"), fresh_path(t.spark, "landed")
    tables.upsert_repo_metadata(t.metadata(), once)
    for half in (0, 1):
        part = t.events().where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half)
        cl.to_wire_event(part).select("value").write.mode("append").text(landed)
        events = ingest.clean_stream(ingest.text_source(t.spark, landed))
        query = ingest.start_enrichment(events, base, lambda: tables.read_current(t.spark, once), once=True)
        supervise.finish([query])
    return read_segments(t.spark, f"{base}/enriched").select(
        "event_id", "repo_name", "repo_stargazers_count", "metadata_missing"
    )
