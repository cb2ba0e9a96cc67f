"""Shapes that would not survive a large cluster must not be in any plan."""

import pytest

from starwake.checks import load
from starwake.functions.times import in_window
from starwake.operators import panels, reports, rollups
from starwake.sources import archive
from starwake import testbed as tb
from starwake.testbed import AS_OF

FOLDER = "/root/testdata/sf0.001"
CHECKS = load()
# These write and read files when they are built, so they are left to the parity tests.
WRITES = {"storing"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    sorted(
        name for name, one in CHECKS.items() if one.build.__module__.split(".")[-1] not in WRITES
    ),
)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(CHECKS[name].run(spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert bad not in plan, f"{bad} in {name}"


def test_filters_reach_the_scan(spark):
    bed = tb.testbed(spark, FOLDER)
    plan = plan_of(rollups.window_star_metrics(bed.events(), AS_OF, 7))
    assert "GreaterThanOrEqual(ts,2024-01-24 00:00:00.0)" in plan
    assert "user_id" not in plan.split("ReadSchema: struct<event_id")[0]


def test_counts_are_combined_before_the_shuffle(spark):
    bed = tb.testbed(spark, FOLDER)
    plan = plan_of(rollups.mover_metrics(bed.events(), AS_OF, 7))
    assert "partial_count" in plan
    # Distinct actors are spread by (repository, actor), not gathered per repository.
    assert any("repo_key" in line and "WHEN" in line for line in plan.splitlines() if "hashpartitioning" in line)


def test_metadata_and_metrics_meet_without_another_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bed = tb.testbed(spark, FOLDER)
        metrics = rollups.window_star_metrics(bed.events(), AS_OF, 7)
        latest = rollups.latest_metadata(bed.metadata())
        joined = plan_of(latest.join(metrics, "repo_key"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One shuffle per aggregation, two for the test tables' own join, none for this join.
    assert joined.count("Exchange hashpartitioning") == 4


def test_the_snapshot_reads_the_events_once(spark, tmp_path):
    path = str(tmp_path / "archive")
    archive.append_archive(tb.testbed(spark, FOLDER).events(), path)
    events = archive.read_archive(spark, path)
    plan = plan_of(panels.top_starred_snapshot(events))
    assert plan.count("FileScan parquet") == 1
    lists = plan_of(rollups.repo_rollup_archive(events))
    assert lists.count("FileScan parquet") == 2
    exploded = [line for line in lists.splitlines() if "Generate explode" in line]
    assert exploded and not any("repo_description" in line or "language" in line for line in exploded)
    # Events are hashed; only the few versions of a repository's texts are sorted.
    assert lists.index("SortAggregate") < lists.index("HashAggregate") < lists.index("FileScan parquet")


def test_questions_meet_the_market_without_joins(spark):
    plan = plan_of(CHECKS["question_evidence"].run(spark, FOLDER))
    assert "scalar-subquery" in plan or "Subquery" in plan


def test_archive_filters_prune_directories(spark, tmp_path):
    bed = tb.testbed(spark, FOLDER)
    path = str(tmp_path / "archive")
    written = archive.append_archive(bed.events(), path)
    assert written == bed.events().count()
    one = archive.read_archive_partition(spark, path, "2024-01-10", "WatchEvent")
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "event_type" in plan.split("PartitionFilters")[1][:200]
    window = reports.topic_breakdown(archive.read_archive(spark, path), AS_OF, mode="date")
    assert "PartitionFilters: [isnotnull(event_date" in plan_of(window)


def test_top_n_per_group_is_limited_before_the_shuffle(spark):
    plan = plan_of(CHECKS["news_radar"].run(spark, FOLDER))
    assert "WindowGroupLimit" in plan


def test_window_is_half_open(spark):
    from frames import events

    rows = events(
        spark,
        [
            {"created_at": "2024-01-31T00:00:00"},
            {"created_at": "2024-01-30T23:59:59.999999"},
            {"created_at": "2024-01-24T00:00:00"},
            {"created_at": "2024-01-23T23:59:59.999999"},
        ],
    )
    kept = rows.where(in_window(rows["created_at"], AS_OF, 7)).select("event_id").collect()
    assert sorted(row[0] for row in kept) == ["e1", "e2"]
