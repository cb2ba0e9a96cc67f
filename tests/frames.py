"""Small literal tables for the tests."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from starwake.schemas import EVENT_TABLE, HISTORY_COLUMNS, REPO_METADATA


def ts(text: str) -> datetime:
    """A UTC instant; Spark keeps it whatever the zone of the machine."""
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def events(spark, rows):
    """Events from partial dictionaries."""
    base = {
        "event_id": "e",
        "event_type": "WatchEvent",
        "actor_id": 1,
        "actor_login": "ann",
        "repo_id": 7,
        "repo_name": "acme/tool",
        "created_at": ts("2024-01-30T00:00:00"),
        "payload_json": "{}",
        "repo_stargazers_count": 100,
        "repo_primary_language": "Python",
        "repo_topics": ["llm"],
        "repo_description": "a tool",
        "repo_full_metadata_json": "",
        "repo_readme_text": "",
        "repo_issues_json": "[]",
    }
    full = []
    for number, row in enumerate(rows):
        values = {**base, "event_id": f"e{number}", **row}
        if isinstance(values["created_at"], str):
            values["created_at"] = ts(values["created_at"])
        full.append(tuple(values[name] for name in EVENT_TABLE.fieldNames()))
    return spark.createDataFrame(full, EVENT_TABLE).withColumn(
        "event_date", F.to_date("created_at")
    )


DEFAULTS = {
    "string": "",
    "long": 0,
    "integer": 0,
    "boolean": False,
    "timestamp": datetime(2024, 1, 1, tzinfo=UTC),
    "array": [],
}


def metadata(spark, rows):
    full = []
    for row in rows:
        values = {f.name: DEFAULTS[f.dataType.typeName()] for f in REPO_METADATA}
        values.update({"category": "Other", "repo_full_name": "acme/tool", **row})
        for name, value in values.items():
            if REPO_METADATA[name].dataType.typeName() == "timestamp" and isinstance(value, str):
                values[name] = ts(value)
        full.append(tuple(values[name] for name in REPO_METADATA.fieldNames()))
    return spark.createDataFrame(full, REPO_METADATA)


def history(spark, rows):
    """(name, snapshot time, stars) as history rows."""
    latest = metadata(spark, [{"repo_full_name": n, "stargazers_count": s} for n, _, s in rows])
    times = spark.createDataFrame(
        [(n, ts(at), s) for n, at, s in rows],
        "repo_full_name string, snapshot_at timestamp, stargazers_count bigint",
    )
    joined = latest.join(times, ["repo_full_name", "stargazers_count"]).withColumns(
        {
            "snapshot_source": F.lit("test"),
            "snapshot_key": F.col("snapshot_at").cast("string"),
        }
    )
    return joined.select(*HISTORY_COLUMNS)
