"""Structured Streaming ingest: decode, check, de-duplicate, archive, history, hourly counts."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starwake.functions.times import parse_iso
from starwake.operators.clean import (
    check_events,
    event_to_history,
    normalise_event_defaults,
    valid_events,
    with_repo_key,
)
from starwake.operators.joins import SPREAD
from starwake.operators.reports import enrich_events, lookup_key
from starwake.schemas import WIRE_EVENT
from starwake.sources.archive import in_archive_form
from starwake.sources.files import exists, read_text, write_text
from starwake.sources.segments import (
    FAN,
    close_days,
    day_folders,
    merge_segments,
    read_segments,
    write_segment,
)

TRIGGER = "60 seconds"
MAX_OFFSETS = 50_000
FETCH_BYTES = 52_428_800
#: Counters of the summary of busy repositories.
BUSY_REPOS = 256
HOURLY = "window_start timestamp, window_end timestamp, repo_name string, event_type string, event_count bigint"


# --------------------------------------------------------------------------- sources


def kafka_source_options(
    servers: str, topic: str, max_offsets: int = MAX_OFFSETS, fail_on_data_loss: bool = True
) -> dict[str, str]:
    """``max_offsets`` only paces the stream. Offsets that the broker has dropped are an error
    unless ``fail_on_data_loss`` is turned off."""
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": str(max_offsets),
        "failOnDataLoss": str(fail_on_data_loss).lower(),
        "kafka.fetch.max.bytes": str(FETCH_BYTES),
        "kafka.max.partition.fetch.bytes": str(FETCH_BYTES),
    }


def kafka_source(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """(key, value) text records of a topic. Needs the Kafka connector on the class path."""
    chosen = kafka_source_options(servers, topic, **options)
    raw = spark.readStream.format("kafka").options(**chosen).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))


def text_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """JSON lines landed as text files, as (key, value) records."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.lit(None).cast("string").alias("key"), "value")


# --------------------------------------------------------------------------- decoding


def _parsed(records: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*WIRE_EVENT.fields, T.StructField("_corrupt", T.StringType())])
    return records.withColumn(
        "data", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    )


def _is_readable():
    return F.col("data").isNotNull() & F.col("data._corrupt").isNull()


def decode_events(records: DataFrame) -> DataFrame:
    """Readable messages as typed columns; ``created_at`` becomes a timestamp."""
    names = WIRE_EVENT.fieldNames()
    readable = _parsed(records).where(_is_readable())
    return readable.select(*[F.col(f"data.{name}").alias(name) for name in names]).withColumn(
        "created_at", parse_iso(F.col("created_at"))
    )


def undecodable(records: DataFrame) -> DataFrame:
    """Empty or broken messages, kept for inspection."""
    return _parsed(records).where(F.coalesce(~_is_readable(), F.lit(True))).drop("data")


def clean_stream(records: DataFrame) -> DataFrame:
    """Valid events with their date. No watermark: rows that come late stay."""
    return valid_events(decode_events(records)).withColumn("event_date", F.to_date("created_at"))


def quarantine(records: DataFrame) -> DataFrame:
    """Records that are not stored as events, with the reason: ``undecodable`` or the field that
    fails."""
    broken = undecodable(records).select(F.lit("undecodable").alias("reason"), "value")
    judged = check_events(decode_events(records)).where(F.col("reject_reason").isNotNull())
    whole = F.to_json(F.struct(*[name for name in judged.columns if name != "reject_reason"]))
    return broken.unionByName(judged.select(F.col("reject_reason").alias("reason"), whole.alias("value")))


def dedup_events(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per event id and date, without those in ``known(event_id, event_date)``."""
    once = events.dropDuplicates(["event_date", "event_id"])
    return once if known is None else once.join(known, ["event_date", "event_id"], "left_anti")


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per hour, repository and type."""
    return (
        events.groupBy(F.window("created_at", "1 hour").alias("w"), "repo_name", "event_type")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "repo_name",
            "event_type",
            "event_count",
        )
    )


def read_hourly_counts(spark: SparkSession, base: str) -> DataFrame:
    """The counts of an ingest so far: every batch has stored its part, open hours and late rows
    included."""
    parts = read_table(spark, base, "hours")
    if parts is None:
        return spark.createDataFrame([], HOURLY)
    return parts.groupBy("window_start", "window_end", "repo_name", "event_type").agg(
        F.sum("event_count").alias("event_count")
    )


# --------------------------------------------------------------------------- enrichment


@dataclass
class BusyRepos:
    """A Misra-Gries summary of the repositories of a stream, carried from batch to batch.

    At most ``keep`` counters. Adding a batch sums counters and takes the largest count beyond the
    first ``keep`` from all of them, so a repository with more than 1 / (keep + 1) of the rows always
    has one. Earlier batches count half, so the summary follows the stream.
    """

    total: float = 0.0
    counts: dict[str, float] = field(default_factory=dict)
    keep: int = BUSY_REPOS

    def add(self, batch: list[tuple[str, int]], rows: int) -> BusyRepos:
        """``batch``: the ``keep + 1`` largest counts of a batch of so many rows."""
        sums: dict[str, float] = {name: count / 2 for name, count in self.counts.items()}
        for name, count in self._reduced(dict(batch)).items():
            sums[name] = sums.get(name, 0.0) + count
        return BusyRepos(self.total / 2 + rows, self._reduced(sums), self.keep)

    def _reduced(self, counts: dict) -> dict[str, float]:
        largest = sorted(counts.items(), key=lambda one: (-one[1], one[0]))
        over = largest[self.keep][1] if len(largest) > self.keep else 0
        return {name: float(count - over) for name, count in largest[: self.keep] if count > over}

    def hot(self, spark: SparkSession, parts: int) -> DataFrame:
        """``repo_key`` and ``_copies`` of those with more than an even share of the rows."""
        share = self.total / parts
        rows = [
            (name, min(SPREAD * parts, math.ceil(count / share * SPREAD)))
            for name, count in self.counts.items()
            if count > share
        ]
        return spark.createDataFrame(rows, "repo_key string, _copies int")

    def stored(self) -> str:
        return json.dumps({"total": self.total, "counts": self.counts})

    @staticmethod
    def read(text: str, keep: int = BUSY_REPOS) -> BusyRepos:
        return BusyRepos(keep=keep, **json.loads(text))


def busiest(events: DataFrame, keep: int = BUSY_REPOS) -> list[tuple[str, int]]:
    """The ``keep + 1`` largest counts of repositories; combined on the map side."""
    counts = events.select(lookup_key().alias("repo_key")).where("repo_key is not null")
    top = counts.groupBy("repo_key").count().orderBy(F.desc("count"), "repo_key").limit(keep + 1)
    return [(row["repo_key"], row["count"]) for row in top.collect()]


def enrich_batch(
    base: str, metadata: Callable[[], DataFrame], parts: int | None = None
) -> Callable[[DataFrame, int], None]:
    """A micro-batch of events, enriched, as a segment of ``base/enriched``.

    ``metadata`` is read again for every batch. The summary of the batches before tells the salted
    join which repositories to spread, without a pass over the events; the first batch, which has
    none, is counted. The batch's own counts come from what it has written and are stored under its
    number, so a batch that is repeated starts from the same summary.
    """

    def write(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        own, tasks = f"{run}-{batch_id}", parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        before = f"{base}/_busy/{run}-{batch_id - 1}"
        summary = BusyRepos.read(read_text(spark, before)) if exists(spark, before) else None
        first = BusyRepos().add(busiest(events), events.count()) if summary is None else summary
        enriched = enrich_events(events, metadata(), first.hot(spark, tasks))
        write_segment(enriched, f"{base}/enriched", own)
        done = spark.read.parquet(*_own_paths(spark, f"{base}/enriched", own))
        then = (summary or BusyRepos()).add(busiest(done), done.count())
        write_text(spark, f"{base}/_busy/{own}", then.stored())

    return write


def _own_paths(spark: SparkSession, table: str, own: str) -> list[str]:
    paths = [f"{table}/{day}/batch={own}" for day in day_folders(spark, table)]
    return [path for path in paths if exists(spark, path)]


def start_enrichment(
    events: DataFrame, base: str, metadata: Callable[[], DataFrame], once: bool = False
) -> StreamingQuery:
    """Stream-static join: the metadata is read again in every micro-batch."""
    writer = (
        events.writeStream.queryName("enrich")
        .option("checkpointLocation", f"{base}/_checkpoints/enrich")
        .foreachBatch(enrich_batch(base, metadata))
    )
    return _trigger(writer, once).start()


# --------------------------------------------------------------------------- sinks


def _trigger(writer, once: bool):
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=TRIGGER)


def start_parquet_sink(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    name: str,
    partitions: list[str] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Append to Parquet; the sink's commit log makes it exactly-once."""
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .queryName(name)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if partitions:
        writer = writer.partitionBy(*partitions)
    return _trigger(writer, once).start()


#: Of each table of an ingest: whether it has dates, inner directories, and the order of its rows.
TABLES = {
    "archive": (True, ["event_type"], ["repo_id", "created_at"]),
    "history": (True, [], ["repo_full_name", "snapshot_at"]),
    "hours": (True, [], ["window_start", "repo_name"]),
    "quarantine": (False, [], ["reason"]),
    "events": (True, [], ["event_id"]),
}


def read_table(
    spark: SparkSession, base: str, table: str, days: Iterable[str] | None = None
) -> DataFrame | None:
    """One of the ``TABLES`` of an ingest, or the given ISO days of it; None before its first row."""
    return read_segments(spark, f"{base}/{table}", days)


def _known_events(spark: SparkSession, path: str, ranges: dict[str, tuple[str, str]], own: str) -> DataFrame | None:
    """Ids already stored under the given dates, by other batches than the one at hand.

    Only the folders of these dates are listed. Segments are sorted by id, so the range of the ids
    at hand lets the reader skip most of them: new events have larger ids than stored ones.
    """
    stored = read_segments(spark, path, sorted(ranges))
    if stored is None:
        return None
    low, high = min(low for low, _ in ranges.values()), max(high for _, high in ranges.values())
    return stored.where(F.col("event_id").between(low, high) & (F.col("batch") != own)).select(
        "event_id", F.col("event_date").cast("date").alias("event_date")
    )


def write_event_batch(base: str, fan: int = FAN) -> Callable[[DataFrame, int], None]:
    """A micro-batch of records into events, archive, history, hourly counts and quarantine.

    An event is new if its id is neither twice in the batch nor stored under its date, however late
    it comes; only the dates of the batch are listed. What a batch writes of a day is one segment
    named by the query's id, which a checkpoint keeps, and the batch's number: a batch that is
    repeated replaces itself, and a new checkpoint never replaces older rows. Events are written
    last. Days with ``fan`` segments of one tier are then merged, without the batch at hand. The
    dates of one batch and their ranges of ids are the only values that reach the driver.
    """

    def write(records: DataFrame, batch_id: int) -> None:
        spark = records.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        own = f"{run}-{batch_id}"

        def put(rows: DataFrame, table: str) -> None:
            dated, inner, sorting = TABLES[table]
            keys = [*(["event_date"] if dated else []), *inner, *sorting]
            write_segment(rows.sortWithinPartitions(*keys), f"{base}/{table}", own, dated, inner)

        records = records.persist()
        valid = clean_stream(records).persist()
        per_day = valid.groupBy(F.col("event_date").cast("string").alias("day")).agg(
            F.min("event_id").alias("low"), F.max("event_id").alias("high")
        )
        ranges = {row["day"]: (row["low"], row["high"]) for row in per_day.collect()}
        known = _known_events(spark, f"{base}/events", ranges, own) if ranges else None
        fresh = dedup_events(valid, known).persist()
        try:
            put(in_archive_form(fresh), "archive")
            rows = with_repo_key(normalise_event_defaults(fresh)).withColumn("event_date", F.to_date("created_at"))
            put(event_to_history(rows).withColumn("event_date", F.to_date("snapshot_at")), "history")
            put(hourly_counts(fresh).withColumn("event_date", F.to_date("window_start")), "hours")
            put(quarantine(records), "quarantine")
            put(rows, "events")
        finally:
            for one in (fresh, valid, records):
                one.unpersist()
        for table, (dated, inner, sorting) in TABLES.items():
            for folder in [f"{base}/{table}/event_date={day}" for day in ranges] if dated else [f"{base}/{table}"]:
                merge_segments(spark, folder, fan, inner, sorting, but=[own])

    return write


def close_ingest_days(spark: SparkSession, base: str, before: str) -> dict[str, list[str]]:
    """One segment for each day before ``before`` in every dated table; returns the merged days."""
    return {
        table: close_days(spark, f"{base}/{table}", before, inner, sorting)
        for table, (dated, inner, sorting) in TABLES.items()
        if dated
    }


def start_ingest(records: DataFrame, base: str, once: bool = False) -> list[StreamingQuery]:
    """One stream of records into all tables below ``base``."""
    writer = (
        records.writeStream.queryName("ingest")
        .option("checkpointLocation", f"{base}/_checkpoints/ingest")
        .foreachBatch(write_event_batch(base))
    )
    return [_trigger(writer, once).start()]
