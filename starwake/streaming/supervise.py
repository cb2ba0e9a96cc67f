"""Watching and ending streaming queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from starwake.functions.times import Moment, moment, parse_iso
from starwake.sources.files import child_names, delete_directory, exists, write_text

LAG_LIMIT = 50_000

#: Seconds without new rows from which a stream is stale.
FRESH_SECONDS = 300

REPORT = (
    "query string, id string, batch_id bigint, rows bigint, batch_seconds double, started_at string, lag bigint"
)


class StreamFailed(RuntimeError):
    """One of the supervised queries ended with an error."""


def source_lag(sources) -> int:
    """Rows waiting in the sources, summed, where a source reports its latest offset."""
    waiting = 0
    for source in sources:
        try:
            latest, end = json.loads(source.latestOffset), json.loads(source.endOffset)
        except (TypeError, ValueError):
            continue
        if not isinstance(latest, dict) or not isinstance(end, dict):
            continue
        for topic, parts in latest.items():
            reached = end.get(topic, {})
            if isinstance(parts, dict) and isinstance(reached, dict):
                waiting += sum(int(last) - int(reached.get(p, 0)) for p, last in parts.items())
    return waiting


class ProgressLog(StreamingQueryListener):
    """Writes every progress report below ``base``: one small file per (query, batch).

    The name is the id that the query's checkpoint keeps and the batch's number, so a batch that is
    repeated after a restart replaces its report, and nothing is held in the driver's memory. Reports
    lie in folders of days; :func:`roll_up_progress` makes one file of a closed day.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self._spark, self._base = spark, base

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        report = {
            "query": progress.name or str(progress.id),
            "id": str(progress.id),
            "batch_id": progress.batchId,
            "rows": progress.numInputRows,
            "batch_seconds": progress.batchDuration / 1000.0,
            "started_at": progress.timestamp,
            "lag": source_lag(progress.sources),
        }
        self.write(report)

    def write(self, report: dict) -> None:
        day = report["started_at"][:10]
        path = f"{self._base}/live/event_date={day}/{report['id']}-{report['batch_id']:010d}.json"
        write_text(self._spark, path, json.dumps(report))


def read_progress(spark: SparkSession, base: str, lag_limit: int = LAG_LIMIT) -> DataFrame:
    """All reports, one row per (query, batch); the latest of a batch that was repeated.

    ``lag`` counts rows that wait in the sources; above ``lag_limit`` it is a warning.
    """
    names = ["query", "id", "batch_id", "rows", "batch_seconds", "started_at", "lag"]
    reports = spark.createDataFrame([], REPORT).select(*names)
    if exists(spark, f"{base}/live"):
        live = spark.read.schema(REPORT).option("recursiveFileLookup", "true").json(f"{base}/live")
        reports = reports.union(live.select(*names))
    if exists(spark, f"{base}/days"):
        reports = reports.union(spark.read.parquet(f"{base}/days").select(*names))
    latest = F.max_by(F.struct(*[name for name in names if name not in ("id", "batch_id")]), "started_at")
    return (
        reports.groupBy("id", "batch_id")
        .agg(latest.alias("_row"))
        .select(
            "_row.query",
            "id",
            "batch_id",
            "_row.rows",
            "_row.batch_seconds",
            parse_iso(F.col("_row.started_at")).alias("started_at"),
            "_row.lag",
            (F.col("_row.lag") > lag_limit).alias("lag_warning"),
        )
    )


def stream_freshness(progress: DataFrame, as_of: Moment, limit: int = FRESH_SECONDS) -> DataFrame:
    """Per query, seconds since its last batch that stored rows, and whether that is too long."""
    ended = F.unix_timestamp("started_at") + F.ceil("batch_seconds")
    last = F.max(F.when(F.col("rows") > 0, ended))
    return (
        progress.groupBy("query")
        .agg(last.alias("_last"), F.sum("rows").alias("rows"), F.max("batch_id").alias("last_batch"))
        .select(
            "query",
            "rows",
            "last_batch",
            (F.unix_timestamp(moment(as_of)) - F.col("_last")).alias("freshness_seconds"),
        )
        .withColumn("is_stale", F.coalesce(F.col("freshness_seconds") > limit, F.lit(True)))
    )


def roll_up_progress(spark: SparkSession, base: str, before: str) -> list[str]:
    """One file for each day of reports before ``before`` (ISO date); returns these days.

    The small files go last, so an interruption leaves reports twice, which reading takes for one.
    """
    days = [
        name
        for name in child_names(spark, f"{base}/live")
        if name.startswith("event_date=") and name.removeprefix("event_date=") < before
    ]
    for name in days:
        rows = spark.read.schema(REPORT).json(f"{base}/live/{name}")
        rows.coalesce(1).write.mode("append").parquet(f"{base}/days")
        delete_directory(spark, f"{base}/live/{name}")
    return [name.removeprefix("event_date=") for name in days]


def supervise(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Wait until one query ends, then stop all of them; a failure is passed on."""
    try:
        spark.streams.awaitAnyTermination()
        for query in queries:
            error = query.exception()
            if error is not None:
                raise StreamFailed(str(error)) from error
    finally:
        stop_all(queries)


def finish(queries: list[StreamingQuery]) -> None:
    """Wait for queries that end by themselves (``availableNow``)."""
    try:
        for query in queries:
            query.awaitTermination()
    except Exception as error:
        raise StreamFailed(str(error)) from error
    finally:
        stop_all(queries)


def stop_all(queries: list[StreamingQuery]) -> None:
    for query in queries:
        if query.isActive:
            query.stop()
