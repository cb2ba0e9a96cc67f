import json
import os
import random
from collections import Counter

import pytest
from frames import events, metadata
from pyspark.sql import functions as F

from starwake.operators import clean as cl
from starwake.operators import rollups as ru
from starwake.plans import jobs
from starwake.sources import archive as ar
from starwake.sources import segments
from starwake.sources import tables
from starwake.sources.files import write_text
from starwake.sources.repo_files import good_files, parse_report, read_repo_json
from starwake.streaming import ingest, supervise

AS_OF = "2024-01-31 00:00:00"


def test_append_to_one_partition(spark, tmp_path):
    path = str(tmp_path)
    assert ar.append_archive_partition(events(spark, []), path, "2024-01-30", "WatchEvent") == 0
    assert ar.read_archive_partition(spark, path, "2024-01-30").count() == 0
    rows = events(spark, [{}, {}]).drop("event_type", "event_date")
    assert ar.append_archive_partition(rows, path, "2024-01-30", "WatchEvent") == 2
    assert ar.append_archive_partition(rows, path, "2024-01-30", "ForkEvent") == 2
    assert ar.read_archive_partition(spark, path, "2024-01-30").count() == 4
    assert ar.read_archive_partition(spark, path, "2024-01-30", "ForkEvent").count() == 2
    assert ar.read_archive_range(spark, path, "2024-02-05", 7).count() == 4
    assert ar.read_archive_range(spark, path, "2024-02-07", 7).count() == 0


def test_archive_of_two_writers(spark, tmp_path):
    """Old files: text times and no repository columns. Expected: one repository, two stars."""
    path = str(tmp_path)
    both = events(spark, [{"repo_stargazers_count": 123, "repo_topics": ["llm", "agent"]}])
    ar.append_archive(both, path)
    old = both.select(
        F.lit("old").alias("event_id"),
        "actor_id",
        "actor_login",
        "repo_id",
        "repo_name",
        F.lit("2024-01-30T01:00:00+00:00").alias("created_at"),
        "payload_json",
        "event_date",
        "event_type",
    )
    old.write.mode("append").partitionBy("event_date", "event_type").parquet(path)
    merged = ar.read_archive_evolved(spark, path)
    row = ru.repo_rollup_archive(merged).collect()
    assert len(row) == 1
    assert (row[0]["star_count_in_window"], row[0]["stargazers_count"]) == (2, 123)
    assert row[0]["topics"] == ["agent", "llm"]
    filled = ar.with_empty_defaults(merged).where("event_id = 'old'").first()
    assert filled["repo_description"] == "" and filled["repo_topics"] == []


def test_backfill_guards(spark, tmp_path):
    path, table = str(tmp_path / "archive"), str(tmp_path / "events")
    with pytest.raises(jobs.JobError):
        jobs.backfill_events(spark, path, table)
    rows = [{"created_at": "2024-01-28T00:00:00"}, {"created_at": "2024-01-30T00:00:00"}]
    ar.append_archive(events(spark, rows), path)
    with pytest.raises(jobs.JobError):
        jobs.backfill_events(spark, path, table, "2024-02-01", "2024-01-01")
    with pytest.raises(jobs.JobError):
        jobs.backfill_events(spark, path, table, "2025-01-01")
    done = jobs.backfill_events(spark, path, table)
    assert done.inserted_rows == 2
    assert spark.read.parquet(table).where("event_type = 'WatchEvent'").count() == 2
    with pytest.raises(jobs.JobError):
        jobs.backfill_events(spark, path, table)
    again = jobs.backfill_events(spark, path, table, "2024-01-29", force=True)
    assert again.inserted_rows == 1 and spark.read.parquet(table).count() == 1


def test_nightly_tables_are_replaced_not_added(spark, tmp_path):
    path, out = str(tmp_path / "archive"), str(tmp_path / "out")
    ar.append_archive(events(spark, [{"created_at": "2024-01-29T00:00:00"}] * 3), path)
    assert jobs.nightly_batch(spark, path, out, AS_OF, "2024-02-10") is None
    for _ in range(2):
        counts = jobs.nightly_batch(spark, path, out, AS_OF, "2024-01-30")
        assert counts == {"star_counts": 1, "activity": 1}
    stored = spark.read.parquet(f"{out}/repo_star_counts")
    assert stored.agg(F.sum("star_count")).first()[0] == 3


def test_bootstrap_fills_only_what_is_empty(spark, tmp_path):
    base, path = str(tmp_path / "metadata"), str(tmp_path / "history")
    assert jobs.bootstrap_observations(events(spark, []), base, path) == {
        "metadata": False,
        "history": False,
    }
    seen = events(spark, [{}, {"repo_name": "a/b", "repo_id": 8}])
    assert jobs.bootstrap_observations(seen, base, path) == {"metadata": True, "history": True}
    assert jobs.bootstrap_observations(seen, base, path) == {"metadata": False, "history": False}
    assert tables.read_current(spark, base).count() == 2


def test_upsert_and_versions(spark, tmp_path):
    base = str(tmp_path)
    assert tables.read_current(spark, base) is None
    tables.upsert_repo_metadata(metadata(spark, [{"stargazers_count": 1}]), base)
    newer = {"stargazers_count": 2, "refreshed_at": "2024-02-01T00:00:00"}
    now = tables.upsert_repo_metadata(
        metadata(spark, [newer, {"repo_full_name": "x/y"}]), base
    )
    assert {(r["repo_full_name"], r["stargazers_count"]) for r in now.collect()} == {
        ("acme/tool", 2),
        ("x/y", 0),
    }
    (tmp_path / "data" / "unfinished" / "_bucket=0").mkdir(parents=True)
    assert tables.read_current(spark, base).count() == 2, "an unfinished version is not read"


def test_an_upsert_writes_only_the_buckets_it_touches(spark, tmp_path):
    base = str(tmp_path)
    many = [{"repo_full_name": f"a/{at}", "repo_id": at} for at in range(300)]
    tables.upsert_repo_metadata(metadata(spark, many), base)

    def files():
        return {path.relative_to(tmp_path): path.stat().st_mtime_ns for path in tmp_path.glob("data/*/*/*.parquet")}

    before = files()
    versions = [tables._versions(spark, base)[-1]]
    for at in range(5):
        row = {"repo_full_name": "A/7", "repo_id": 7, "stargazers_count": at + 1, "refreshed_at": f"2024-03-0{at + 1}T00:00:00"}
        now = tables.upsert_repo_metadata(metadata(spark, [row]), base)
        versions.append(tables._versions(spark, base)[-1])
    assert now.count() == 300 and now.where("repo_full_name = 'A/7'").first()["stargazers_count"] == 5
    after = files()
    kept = {path: when for path, when in after.items() if path in before}
    assert len(before) - len(kept) == 1, "one bucket was written anew, all others keep their files"
    assert all(before[path] == when for path, when in kept.items())
    assert len(after) == len(kept) + tables.KEPT_VERSIONS, "old versions of the bucket are gone"
    assert tables._versions(spark, base) == versions[-tables.KEPT_VERSIONS :]
    assert tables.upsert_repo_metadata(metadata(spark, []), base).count() == 300
    with pytest.raises(Exception, match="exist"):
        write_text(spark, f"{base}/_manifest/{versions[-1]}", "", replace=False)


def test_history_replay_is_seen_once(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = metadata(spark, [{}])
    tables.append_repo_history(rows, path, "sync")
    assert tables.append_repo_history(rows, path, "sync").count() == 1
    assert tables.append_repo_history(rows, path, "other").count() == 2


def test_retention(spark, tmp_path):
    path = str(tmp_path)
    days = ["2023-10-01", "2023-11-02", "2024-01-30"]
    ar.append_archive(events(spark, [{"created_at": f"{d}T00:00:00"} for d in days]), path)
    (tmp_path / "event_date=soon").mkdir()
    (tmp_path / "event_date=soon" / "x.parquet").write_bytes(b"x")
    plan = jobs.retention_plan(spark, path, AS_OF)
    assert {r["partition"]: r["action"] for r in plan.collect()} == {
        "2023-10-01": "drop",
        "2023-11-02": "keep",
        "2024-01-30": "keep",
        "soon": "skip",
    }
    assert jobs.apply_retention(spark, path, plan) == 1
    assert not (tmp_path / "event_date=2023-10-01").exists()
    # Whatever the retention, the last two days stay.
    assert jobs.retention_plan(spark, path, AS_OF, 0).where(
        "action = 'drop' AND partition = '2024-01-30'"
    ).isEmpty()


def repo_file(**fields):
    return {
        "id": 5,
        "full_name": "acme/tool",
        "name": "tool",
        "stargazers_count": 12,
        "forks_count": "bad",
        "created_at": "2020-01-01T00:00:00Z",
        "topics": ["rag"],
        "owner": {"login": "acme", "id": 3},
        "license": None,
        "fetched_at": "2024-01-01T00:00:00Z",
        "refreshed_at": "2024-01-02T00:00:00Z",
        **fields,
    }


def test_repository_files(spark, tmp_path):
    folder = tmp_path / "repos"
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps(repo_file(), indent=2))
    (folder / "list.json").write_text("[1, 2]")
    (folder / "broken.json").write_text('{"id": 5, ')
    (folder / "time.json").write_text(json.dumps(repo_file(pushed_at="soon")))
    (folder / "top_summary.json").write_text("{}")
    files = read_repo_json(spark, str(folder))
    assert tuple(parse_report(files).first()) == (1, 3)
    row = cl.map_repo_metadata(good_files(files), AS_OF).first()
    assert (row["repo_id"], row["stargazers_count"], row["forks_count"]) == (5, 12, 0)
    assert (row["category"], row["visibility"], row["default_branch"]) == ("Agent", "public", "main")
    assert row["has_issues"] is True and row["allow_forking"] is True and row["is_fork"] is False
    assert (row["owner_login"], row["license_name"]) == ("acme", "")
    loose = cl.map_repo_metadata(good_files(files), AS_OF, loose=True)
    assert loose.select(F.col("github_pushed_at").cast("string")).first()[0] == "1970-01-01 00:00:00"
    assert loose.first()["has_issues"] is False


def test_refresh_keeps_the_first_fetch(spark, tmp_path):
    folder, base, path = tmp_path / "repos", str(tmp_path / "meta"), str(tmp_path / "history")
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(repo_file()))
    jobs.metadata_refresh(spark, str(folder), base, path, AS_OF)
    again = repo_file(fetched_at=None, refreshed_at="2024-01-09T00:00:00Z", stargazers_count=20)
    (folder / "a.json").write_text(json.dumps(again))
    report = jobs.metadata_refresh(spark, str(folder), base, path, AS_OF)
    assert [(r["rank"], r["stargazers_count"]) for r in report.collect()] == [(1, 20)]
    current = tables.read_current(spark, base).select(F.col("fetched_at").cast("string"))
    assert current.first()[0] == "2024-01-01 00:00:00"
    assert tables.read_history(spark, path).count() == 2


def test_compaction_drops_copies(spark):
    summary = ru.activity_summary(events(spark, [{}]), AS_OF)
    later = ru.activity_summary(events(spark, [{}, {}]), "2024-02-01 00:00:00")
    kept = ru.compact_activity(summary.unionByName(later)).collect()
    assert [r["event_count"] for r in kept] == [2]
    counts = ru.daily_star_counts(events(spark, [{}]))
    assert ru.compact_star_counts(counts.unionByName(counts)).first()["star_count"] == 2


def old_writer(rows, path):
    """Files of an older writer: text times and no repository columns."""
    old = rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    old = old.select("event_id", "actor_id", "actor_login", "repo_id", "repo_name", "created_at",
                     "payload_json", "event_date", "event_type")
    old.write.mode("append").partitionBy("event_date", "event_type").parquet(path)


def test_a_backfill_of_one_day_opens_that_day_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "archive")
    days = [f"2024-01-{day:02}" for day in range(1, 9)]
    ar.append_archive(events(spark, [{"created_at": f"{day}T01:00:00"} for day in days[:4]]), path)
    old_writer(events(spark, [{"created_at": f"{day}T02:00:00"} for day in days[3:]]), path)
    opened = []
    real = ar._kind_below
    monkeypatch.setattr(ar, "_kind_below", lambda s, where: opened.append(where) or real(s, where))
    for number, day in enumerate(("2024-01-02", "2024-01-07", "2024-01-07")):
        done = jobs.backfill_events(spark, path, str(tmp_path / f"t{number}"), day, day)
        assert done.inserted_rows == 1
    # The writer's own day is in the manifest, and the other one from its first reading on.
    assert opened == [f"{path}/event_date=2024-01-07"]
    mixed = ar.read_archive_evolved(spark, path, days[3], days[3])
    assert mixed.count() == 2 and mixed.where("created_at is null").count() == 0
    assert ar.time_kinds(spark, path, days[3]) != [("time", ".")]  # files that came since count
    assert ar.read_archive_evolved(spark, path).count() == 9
    files = mixed.inputFiles()
    assert files and all(f"event_date={days[3]}" in name for name in files)


def test_an_archive_of_a_stream_and_of_jobs(spark, tmp_path):
    base = str(tmp_path / "out")
    write = ingest.write_event_batch(base)
    write(records_of(spark, [{"event_id": "s", "created_at": "2024-01-30T01:00:00"}]), 1)
    ar.append_archive(events(spark, [{"event_id": "j"}, {"event_id": "k", "created_at": "2024-01-29T01:00:00"}]),
                      f"{base}/archive")
    old_writer(events(spark, [{"event_id": "o", "event_type": "ForkEvent"}]), f"{base}/archive")
    rows = ar.read_archive_evolved(spark, f"{base}/archive")
    assert sorted(r["event_id"] for r in rows.select("event_id").collect()) == ["j", "k", "o", "s"]
    assert rows.where("created_at is null").count() == 0
    assert ar.read_archive_range(spark, f"{base}/archive", "2024-01-29", 3).count() == 1


# --------------------------------------------------------------------------- streams


def wire(spark, rows, folder, name, *more):
    lines = [r["value"] for r in cl.to_wire_event(events(spark, rows)).collect()] + list(more)
    (folder / name).write_text("\n".join(lines) + "\n")
    # Files are taken in order of their times; names end in their place.
    place = int(name.split(".")[0])
    os.utime(folder / name, (1_700_000_000 + place, 1_700_000_000 + place))


def run_ingest(spark, folder, base):
    records = ingest.text_source(spark, str(folder), max_files=1)
    supervise.finish(ingest.start_ingest(records, base, once=True))


def test_ingest_restarts_and_keeps_each_event_once(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    first = [{"event_id": "a"}, {"event_id": "a"}, {"event_id": "b", "event_type": "ForkEvent"}]
    wire(spark, first, folder, "1.txt", "{broken")
    run_ingest(spark, folder, base)
    wire(spark, [{"event_id": "b"}, {"event_id": "c"}], folder, "2.txt")
    run_ingest(spark, folder, base)
    kept = ingest.read_table(spark, base, "events")
    assert sorted(r["event_id"] for r in kept.select("event_id").collect()) == ["a", "b", "c"]
    assert ar.read_archive(spark, f"{base}/archive").count() == 3
    observed = ingest.read_table(spark, base, "history").select("snapshot_key")
    assert sorted(r[0] for r in observed.collect()) == ["a", "b", "c"]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    wire(spark, [{"event_id": "a"}, {"event_id": "b"}], folder, "1.txt", "{broken")
    records = spark.read.text(str(folder)).selectExpr("CAST(NULL AS STRING) AS key", "value")
    write = ingest.write_event_batch(base)
    for _ in range(2):
        write(records, 7)
    for table, rows in (("events", 2), ("archive", 2), ("history", 2), ("quarantine", 1)):
        assert ingest.read_table(spark, base, table).count() == rows, table


def test_a_new_checkpoint_keeps_old_batches(spark, tmp_path):
    base = str(tmp_path / "out")
    for at in (1, 2):
        folder = tmp_path / f"in{at}"
        folder.mkdir()
        wire(spark, [{"event_id": f"e{at}"}, {"event_id": "both"}], folder, "1.txt")
        query = (
            ingest.text_source(spark, str(folder))
            .writeStream.foreachBatch(ingest.write_event_batch(base))
            .option("checkpointLocation", str(tmp_path / f"c{at}"))
            .trigger(availableNow=True)
            .start()
        )
        supervise.finish([query])
    kept = ingest.read_table(spark, base, "events").select("event_id").collect()
    assert sorted(row[0] for row in kept) == ["both", "e1", "e2"]


def test_late_rows_are_stored_and_counted(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    times = ["2024-01-30T10:30:00", "2024-01-30T13:30:00", "2024-01-30T13:35:00", "2024-01-30T10:40:00"]
    for at, time in enumerate(times):
        wire(spark, [{"event_id": f"e{at}", "created_at": time}], folder, f"{at + 1}.txt")
    wire(spark, [{"event_id": "e0", "created_at": times[0]}, {"event_id": "bad", "actor_id": 0}], folder, "5.txt")
    run_ingest(spark, folder, base)
    got = ingest.read_hourly_counts(spark, base).select(
        F.col("window_start").cast("string"), "event_count"
    )
    assert sorted(map(tuple, got.collect())) == [("2024-01-30 10:00:00", 2), ("2024-01-30 13:00:00", 2)]
    assert ar.read_archive(spark, f"{base}/archive").count() == 4
    reasons = ingest.read_table(spark, base, "quarantine").select("reason").collect()
    assert [row[0] for row in reasons] == ["actor_id"]


def records_of(spark, rows, *more):
    lines = cl.to_wire_event(events(spark, rows)).select("value")
    if more:
        lines = lines.union(spark.createDataFrame([(one,) for one in more], "value string"))
    return lines.selectExpr("CAST(NULL AS STRING) AS key", "value")


def test_many_batches_list_only_their_days_and_few_segments(spark, tmp_path, monkeypatch):
    """24 batches over 2 days beside old ones: no old day is listed, segments stay few, and every
    event is there once, those sent again included."""
    base = str(tmp_path / "out")
    write = ingest.write_event_batch(base, fan=4)
    for day in range(1, 4):
        write(records_of(spark, [{"event_id": f"old{day}", "created_at": f"2023-12-{day:02}T00:00:00"}]), day)
    listed = []
    real = segments.child_names
    monkeypatch.setattr(segments, "child_names", lambda s, path: listed.append(path) or real(s, path))
    days = ("2024-01-29", "2024-01-30")
    for at in range(24):
        rows = [
            {"event_id": f"e{at:04}", "created_at": f"{days[at % 2]}T10:{at % 60:02}:00"},
            {"event_id": f"e{at // 3 * 2 % 24:04}", "created_at": f"{days[0]}T10:{at // 3 * 2 % 24:02}:00"},
        ]
        write(records_of(spark, rows if at % 3 == 0 else rows[:1], *(["{"] if at % 10 == 0 else [])), 100 + at)
    assert listed and not [path for path in listed if "2023-12" in path or path.endswith(("events", "archive"))]
    for table in ("events", "archive", "history"):
        for day in days:
            live = segments.live_segments(spark, f"{base}/{table}/event_date={day}")
            assert 0 < len(live) <= 2 * 4, (table, live)
    got = ingest.read_table(spark, base, "events", days)
    assert sorted(r["event_id"] for r in got.select("event_id").collect()) == [f"e{at:04}" for at in range(24)]
    assert ar.read_archive(spark, f"{base}/archive").count() == 27
    assert ingest.read_hourly_counts(spark, base).agg(F.sum("event_count")).first()[0] == 27
    assert ingest.read_table(spark, base, "quarantine").count() == 3
    # A job merges closed days; an event that comes again after that is still known.
    done = ingest.close_ingest_days(spark, base, "2024-01-30")
    assert "event_date=2024-01-29" in done["events"]
    assert len(segments.live_segments(spark, f"{base}/events/event_date=2024-01-29")) == 1
    write(records_of(spark, [{"event_id": "e0000", "created_at": "2024-01-29T10:00:00"}]), 900)
    assert ingest.read_table(spark, base, "events").count() == 27
    assert ar.read_archive(spark, f"{base}/archive").count() == 27


def test_an_interrupted_merge_counts_nothing_twice(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "out")
    write = ingest.write_event_batch(base)
    for at in range(3):
        write(records_of(spark, [{"event_id": f"e{at}"}]), at)
    folder = f"{base}/events/event_date=2024-01-30"

    def broken(*_):
        raise RuntimeError("lost before the marker was written")

    with monkeypatch.context() as patched:
        patched.setattr(segments, "write_text", broken)
        with pytest.raises(RuntimeError):
            segments.merge_segments(spark, folder, 2)
    assert ingest.read_table(spark, base, "events").count() == 3
    assert len(segments.merge_segments(spark, folder, 2)) == 1
    assert ingest.read_table(spark, base, "events").count() == 3  # covered ones still lie there
    assert len(segments.live_segments(spark, folder)) == 1
    segments.drop_covered(spark, folder)
    names = [name for name in segments.child_names(spark, folder) if name.startswith("batch=batch")]
    assert names == [] and ingest.read_table(spark, base, "events").count() == 3
    # The batch at hand is never merged: it may be written again.
    write(records_of(spark, [{"event_id": "x"}]), 7)
    assert segments.merge_segments(spark, folder, 1, but=["batch-7"]) != []
    assert "batch-7" in segments.live_segments(spark, folder)


def test_a_summary_holds_every_busy_repository():
    rng = random.Random(1)
    summary, exact, total = ingest.BusyRepos(keep=20), Counter(), 0.0
    for _ in range(30):
        batch = Counter(rng.choice([f"r{rng.randrange(5)}", f"x{rng.randrange(3_000)}"]) for _ in range(2_000))
        exact = Counter({name: count / 2 for name, count in exact.items()}) + Counter(batch)
        total = total / 2 + 2_000
        summary = ingest.BusyRepos.read(summary.add(batch.most_common(21), 2_000).stored(), keep=20)
        assert len(summary.counts) <= 20 and summary.total == total
        for name, count in exact.items():
            held = summary.counts.get(name, 0)
            assert held <= count + 1e-6 and count - held <= 2 * total / 21 + 1e-6
    assert all(f"r{at}" in summary.counts for at in range(5))


def test_a_busy_repository_is_spread_by_the_summary_of_earlier_batches(spark, tmp_path):
    """Three fifths of the rows are of one repository: no task gets more than twice the median."""
    base = str(tmp_path)
    rows = spark.range(40_000).select(
        F.concat(F.lit("e"), F.col("id")).alias("event_id"),
        F.when(F.col("id") % 5 < 3, "Big/one").otherwise(F.concat(F.lit("o/"), F.col("id") % 997)).alias("repo_name"),
        F.lit(1).cast("bigint").alias("repo_id"),
        F.lit("2024-01-30").cast("date").alias("event_date"),
    )
    known = metadata(spark, [{"repo_full_name": "big/one", "stargazers_count": 9}, {"repo_full_name": "o/3"}])
    write = ingest.enrich_batch(base, lambda: known)
    write(rows, 0)
    write(rows.withColumn("event_id", F.concat("event_id", F.lit("x"))), 1)
    out = segments.read_segments(spark, f"{base}/enriched")
    assert out.count() == 80_000 and out.where("not metadata_missing").agg(F.sum("repo_stargazers_count")).first()[0] == 9 * 48_000
    summary = ingest.BusyRepos.read((tmp_path / "_busy" / "batch-1").read_text())
    assert summary.total == 60_000 and max(summary.counts, key=summary.counts.get) == "big/one"
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        hot = summary.hot(spark, 8)
        assert [row["repo_key"] for row in hot.collect()] == ["big/one"]
        from starwake.operators.reports import enrich_events

        joined = enrich_events(rows, known, hot)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)
    assert sum(sizes) == 40_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes


def test_a_failing_sink_ends_the_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    wire(spark, [{}], folder, "1.txt")
    records = ingest.text_source(spark, str(folder))

    def fail(batch, batch_id):
        raise RuntimeError("disk full")

    query = (
        ingest.clean_stream(records)
        .writeStream.foreachBatch(fail)
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    with pytest.raises(supervise.StreamFailed):
        supervise.finish([query])


def test_progress_survives_restarts_and_repeats(spark, tmp_path):
    base = str(tmp_path / "progress")
    assert supervise.read_progress(spark, base).count() == 0

    def report(batch, at, rows=5, lag=0):
        return {"query": "ingest", "id": "q1", "batch_id": batch, "rows": rows, "batch_seconds": 2.5,
                "started_at": at, "lag": lag}

    log = supervise.ProgressLog(spark, base)
    log.write(report(0, "2024-01-30T23:59:00.000Z"))
    log.write(report(1, "2024-01-30T23:59:58.000Z", rows=1))
    again = supervise.ProgressLog(spark, base)  # after a restart the last batch is repeated, a day later
    again.write(report(1, "2024-01-31T00:00:10.000Z", rows=7, lag=60_000))
    for at in range(2, 40):
        again.write(report(at, f"2024-01-31T00:{at:02}:00.000Z", rows=0 if at == 39 else 1))
    expected = {(0, 5), (1, 7), (39, 0), *((at, 1) for at in range(2, 39))}

    def reports():
        return supervise.read_progress(spark, base)

    assert {(r["batch_id"], r["rows"]) for r in reports().collect()} == expected and reports().count() == 40
    assert [r["batch_id"] for r in reports().where("lag_warning").collect()] == [1]
    fresh = supervise.stream_freshness(reports(), "2024-01-31 00:40:00").first()
    assert (fresh["rows"], fresh["last_batch"], fresh["freshness_seconds"], fresh["is_stale"]) == (49, 39, 117, False)
    assert supervise.stream_freshness(reports(), "2024-01-31 01:40:00").first()["is_stale"]
    assert supervise.roll_up_progress(spark, base, "2024-01-31") == ["2024-01-30"]
    assert supervise.roll_up_progress(spark, base, "2024-02-01") == ["2024-01-31"]
    assert {(r["batch_id"], r["rows"]) for r in reports().collect()} == expected and reports().count() == 40


def test_lag_is_summed_over_partitions():
    class Source:
        def __init__(self, latest, end):
            self.latestOffset, self.endOffset = json.dumps(latest), json.dumps(end)

    kafka = Source({"events": {"0": 100, "1": 50}}, {"events": {"0": 40, "1": 50}})
    files = Source({"logOffset": 3}, {"logOffset": 3})
    assert supervise.source_lag([kafka, files]) == 60


def test_connector_options():
    options = ingest.kafka_source_options("host:9092", "events")
    assert options["maxOffsetsPerTrigger"] == "50000"
    assert options["startingOffsets"] == "latest" and options["failOnDataLoss"] == "true"
    paced = ingest.kafka_source_options("host:9092", "events", max_offsets=7, fail_on_data_loss=False)
    assert paced["maxOffsetsPerTrigger"] == "7" and paced["failOnDataLoss"] == "false"
    assert tables.kafka_options("host:9092", "events")["kafka.acks"] == "all"
