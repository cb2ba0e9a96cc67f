"""Landed input, appends and metadata whose work is shared by all tasks."""

import json

import pytest
from pyspark.sql import functions as F

from starwake import testbed as tb
from starwake.checks import load, storing
from starwake.sources.repo_files import parse_report, read_repo_json

FOLDER = "/root/testdata/sf0.001"


def objects(*names):
    return [{"id": number, "full_name": name, "description": "a } {"} for number, name in enumerate(names, 1)]


def test_files_of_several_objects(spark, tmp_path):
    one, two, three, four = objects("a/one", "b/two", "c/three", "d/four")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(row) for row in (one, two)) + "\r\n \r\n{\"id\": 9, \"full")
    (tmp_path / "indented.json").write_text(json.dumps(three, indent=2) + "\n" + json.dumps(four, indent=2) + "\n")
    nested = {**one, "owner": {"login": "x"}, "license": {"key": "mit"}}
    (tmp_path / "nested.json").write_text(json.dumps(nested, indent=0))
    files = read_repo_json(spark, str(tmp_path))
    assert tuple(parse_report(files).first()) == (5, 1)
    good = files.where("parse_error is null").groupBy("file_name").agg(F.array_sort(F.collect_list("full_name")))
    assert dict(map(tuple, good.collect())) == {
        "lines.json": ["a/one", "b/two"],
        "indented.json": ["c/three", "d/four"],
        "nested.json": ["a/one"],
    }


def test_every_partition_is_appended():
    sql = load()["append_archive_partition"].sql
    assert sql.endswith("SELECT event_date, event_type, count(*) AS rows FROM gh GROUP BY ALL")


@pytest.fixture
def no_single_task(spark, monkeypatch):
    """Nothing is landed by one task, and no stream runs."""

    def refuse(*_):
        raise AssertionError("one task would land everything")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refuse)
    monkeypatch.setattr(storing.supervise, "finish", lambda queries: None)
    return monkeypatch


def test_loads_out_of_order_are_landed_by_all_tasks(spark, no_single_task):
    landed = []
    no_single_task.setattr(storing.ingest, "text_source", lambda spark, path: path)
    no_single_task.setattr(storing.ingest, "start_ingest", lambda path, base, once: landed.append(spark.read.text(path).count()))
    no_single_task.setattr(storing.ingest, "close_ingest_days", lambda *_: None)
    bed = tb.testbed(spark, FOLDER)
    storing._out_of_order(bed)
    assert len(landed) == 4 and landed == sorted(set(landed)) and landed[-1] > bed.events().count()


def test_metadata_rows_are_dealt_before_they_become_wide(spark):
    plan = tb.testbed(spark, FOLDER).metadata()._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    dealt = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    wide = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert wide < dealt  # the plan is printed from its last step


def test_metadata_rows_are_dealt_as_they_are_stored(spark):
    plan = tb.testbed(spark, FOLDER).metadata()._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :].partition("\n")[2]
    assert "p_brand" in below and " AS " not in below


def test_no_task_widens_more_metadata_than_another(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tb, "ROWS_A_TASK", 100, raising=False)
    names = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    rows = [(key, "red widget", "Brand#1", "SMALL", 7, 1.0) for key in range(2000)]
    spark.createDataFrame(rows, tb.PART_SCHEMA).select(*names).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    metadata = tb.Testbed(spark, str(tmp_path)).metadata()
    per_task = [row["count"] for row in metadata.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 4000 and max(per_task) <= 2 * 2 * 100
