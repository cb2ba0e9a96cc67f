import pytest
from frames import events, history, metadata
from pyspark.sql import functions as F

from starwake.operators import insight as ins
from starwake.operators import panels
from starwake.operators import ranking
from starwake.operators import reports as rp
from starwake.operators import rollups as ru
from starwake.operators.joins import spread_left_join
from starwake.plans.dashboard import Dashboard
from starwake.schemas import HEADLINES

AS_OF = "2024-01-31 00:00:00"
START = "2024-01-28T17:00:00"


def test_newest_version_wins_and_ties_are_settled(spark):
    rows = metadata(
        spark,
        [
            {"refreshed_at": "2023-12-31T00:00:00", "stargazers_count": 9},
            {"refreshed_at": "2024-01-02T00:00:00", "stargazers_count": 5},
            {"refreshed_at": "2024-01-02T00:00:00", "stargazers_count": 6},
            {"repo_full_name": "ACME/Tool", "refreshed_at": "2024-01-01T00:00:00"},
        ],
    )
    latest = ru.latest_metadata(rows).collect()
    assert [(r["repo_key"], r["stargazers_count"]) for r in latest] == [("acme/tool", 6)]


def test_weekly_growth(spark):
    rows = history(
        spark,
        [
            ("a/base", "2024-01-20T00:00:00", 10),
            ("a/base", "2024-01-30T00:00:00", 25),
            ("a/new", "2024-01-29T00:00:00", 100),
            ("a/new", "2024-01-30T00:00:00", 104),
            ("a/once", "2024-01-29T00:00:00", 50),
            ("a/falls", "2024-01-20T00:00:00", 30),
            ("a/falls", "2024-01-30T00:00:00", 20),
            ("a/edge", START, 7),
            ("a/edge", "2024-01-31T00:00:00", 99),
        ],
    )
    grown = {r["repo_full_name"]: r["star_count_in_window"] for r in rp.weekly_growth(rows, AS_OF).collect()}
    assert grown == {"a/base": 15, "a/new": 4, "a/once": 0, "a/falls": 0, "a/edge": 0}
    ranked = rp.trending_week(rows, AS_OF).collect()
    assert [(r["repo_full_name"], r["growth_rank"]) for r in ranked] == [("a/base", 1), ("a/new", 2)]


def test_names_differ_in_case_only(spark):
    seen = events(spark, [{"repo_name": "ACME/tool"}, {"repo_name": "acme/Tool"}])
    known = metadata(spark, [{"repo_full_name": "Acme/Tool", "stargazers_count": 5}])
    rows = rp.top_repos(known, seen, AS_OF).collect()
    assert [(r["repo_full_name"], r["star_count_in_window"]) for r in rows] == [("Acme/Tool", 2)]


def test_metadata_without_events_and_events_without_metadata(spark):
    seen = events(spark, [{"repo_name": "x/events-only"}, {"repo_name": "x/both"}])
    known = metadata(spark, [{"repo_full_name": "x/both"}, {"repo_full_name": "x/meta-only"}])
    assert [r["repo_full_name"] for r in rp.top_repos(known, seen, AS_OF).collect()] == ["x/both"]
    counts = ru.daily_star_counts(seen)
    left = rp.top_repos_left(known, counts, AS_OF).collect()
    assert [(r["repo_full_name"], r["star_count_in_window"]) for r in left] == [
        ("x/both", 1),
        ("x/meta-only", 0),
    ]
    missing = rp.repos_to_enrich(seen, known, AS_OF).collect()
    assert [r["repo_key"] for r in missing] == ["x/events-only"]
    flags = {r["repo_name"]: r["metadata_missing"] for r in rp.enrich_events(seen, known).collect()}
    assert flags == {"x/events-only": True, "x/both": False}


def test_known_repositories_leave_room_for_unknown_ones(spark):
    seen = events(spark, [{"repo_name": "x/known"}] * 3 + [{"repo_name": "x/new"}])
    known = metadata(spark, [{"repo_full_name": "x/known"}])
    assert [r["repo_key"] for r in rp.repos_to_enrich(seen, known, AS_OF, limit=1).collect()] == ["x/new"]


def test_a_stored_other_can_be_in_a_category(spark):
    seen = events(spark, [{"repo_name": "x/stored"}, {"repo_name": "x/other"}])
    known = metadata(
        spark,
        [
            {"repo_full_name": "x/stored", "category": "Agent"},
            {"repo_full_name": "x/other", "category": "Other", "topics": ["agentic"]},
        ],
    )
    listed = rp.top_repos(known, seen, AS_OF, category="Agent").collect()
    assert sorted(r["repo_full_name"] for r in listed) == ["x/other", "x/stored"]


def test_equal_counts_are_ordered_by_name(spark):
    seen = events(spark, [{"repo_name": "b/b"}, {"repo_name": "a/a"}])
    rows = rp.top_repos_from_events(seen, AS_OF).collect()
    assert [r["repo_full_name"] for r in rows] == ["a/a", "b/b"]


def test_push_is_never_older_than_the_latest_event(spark):
    seen = events(spark, [{"created_at": "2024-01-30T05:00:00"}])
    known = metadata(spark, [{"github_pushed_at": "2024-01-01T00:00:00"}])
    pushed = rp.top_repos(known, seen, AS_OF).select(F.col("github_pushed_at").cast("string"))
    assert pushed.first()[0] == "2024-01-30 05:00:00"


def test_archive_rollup_unites_topics_and_counts_stars_once(spark):
    seen = events(
        spark,
        [
            {"repo_topics": ["llm", "agent"], "repo_stargazers_count": 123},
            {"repo_topics": ["agent", ""], "repo_stargazers_count": 100},
            {"repo_topics": None, "event_type": "ForkEvent"},
        ],
    )
    row = ru.repo_rollup_archive(seen).first()
    assert row["topics"] == ["agent", "llm"]
    assert (row["star_count_in_window"], row["stargazers_count"]) == (2, 123)


def test_topics_null_empty_and_blank_vanish(spark):
    seen = events(spark, [{"repo_topics": t} for t in (None, [], [""], ["llm"], ["llm", "rag"])])
    rows = {r["topic"]: r["event_count"] for r in rp.topic_breakdown(seen, AS_OF).collect()}
    assert rows == {"llm": 2, "rag": 1}


def test_movers_need_a_baseline_for_percentages(spark):
    seen = events(spark, [{"repo_name": "a/small"}, {"repo_name": "a/big"}, {"repo_name": "a/big"}])
    known = metadata(
        spark,
        [
            {"repo_full_name": "a/small", "stargazers_count": 10},
            {"repo_full_name": "a/big", "stargazers_count": 5000},
        ],
    )
    found = rp.movers(known, seen, AS_OF)
    assert [r["repo_full_name"] for r in rp.absolute_movers(found).collect()] == ["a/big", "a/small"]
    assert [r["repo_full_name"] for r in rp.percentage_movers(found).collect()] == ["a/big"]


@pytest.mark.parametrize(
    ("stars", "recent", "prior"),
    [([4], 4.0, 4.0), ([4, 6], 6.0, 4.0), ([3, 4, 8], 6.0, 3.0), ([1, 3, 5, 7], 6.0, 2.0)],
)
def test_half_window_rates(spark, stars, recent, prior):
    daily = spark.createDataFrame(
        [("a", f"2024-01-0{i + 1}", s) for i, s in enumerate(stars)],
        "repo_key string, event_date string, star_count bigint",
    ).withColumn("event_date", F.to_date("event_date"))
    row = ins.half_window_star_rates(daily).first()
    assert (row["recent_star_rate"], row["prior_star_rate"]) == (recent, prior)


def test_repository_without_events_gets_a_quiet_report(spark):
    context = ins.repo_brief_context(
        metadata(spark, [{"description": ""}]), events(spark, []), AS_OF
    )
    brief = ins.repo_brief(context, AS_OF).first()
    assert brief["trend_verdict"] == "quiet"
    assert brief["watchouts"] == [
        "Repository metadata is sparse, which weakens downstream semantic understanding.",
        "No recent tracked events were observed in the selected window.",
    ]


def test_accelerating_report(spark):
    rows = [
        {"created_at": f"2024-01-{d:02d}T00:00:{i % 60:02d}", "actor_login": f"u{i}"}
        for d, n in ((10, 50), (11, 250))
        for i in range(n)
    ]
    context = ins.repo_brief_context(
        metadata(spark, [{"description": "d"}]), events(spark, rows), AS_OF
    )
    brief = ins.repo_brief(context, AS_OF).first()
    assert brief["trend_verdict"] == "accelerating"
    assert "(250.0) is ahead of the prior half-window (50.0)" in brief["why_trending"]


def test_a_comparison_needs_two_repositories(spark):
    with pytest.raises(ValueError):
        ins.compare_pair(None, "a/b", "A/B")


def test_rank_all_is_dense_over_partitions_and_ties(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("v"), F.col("id").alias("name"))
    ranked = ranking.rank_all(rows, [F.desc("v"), F.asc("name")])
    got = ranked.orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(-r["v"], r["name"]) for r in got] == sorted((-r["v"], r["name"]) for r in got)


def test_first_source_with_rows_answers(spark):
    empty, one, two = spark.range(0), spark.range(1), spark.range(2)
    assert ranking.first_non_empty(empty, one, two).count() == 1
    assert ranking.first_non_empty(empty, empty).count() == 0


def test_history_without_growth_does_not_fall_back(spark):
    board = Dashboard(
        events=events(spark, [{}]), history=history(spark, [("a/once", "2024-01-30T00:00:00", 5)])
    )
    assert board.trending(AS_OF).count() == 0
    assert Dashboard(events=events(spark, [{}])).trending(AS_OF).count() == 1


def test_freshness_limits(spark):
    for second, status, alert in ((0, "healthy", False), (301, "degraded", False), (601, "degraded", True)):
        seen = events(spark, [{"created_at": "2024-01-30T00:00:00"}])
        as_of = f"2024-01-30 00:{second // 60:02d}:{second % 60:02d}"
        row = panels.data_freshness(seen, as_of).first()
        assert (row["age_seconds"], row["status"], row["alert"]) == (second, status, alert)
    nothing = panels.data_freshness(events(spark, []), AS_OF).first()
    assert nothing["status"] == "degraded"


def test_headlines_without_title_or_url_are_dropped(spark):
    rows = [("a/b", i, t, u, None, None, None, None, "bing") for i, (t, u) in enumerate(
        [("", "u0"), ("t1", " "), ("t2", "u2"), ("t3", "u3"), ("t4", "u4"), ("t5", "u5")])]
    movers = spark.createDataFrame(
        [("A/B", "LLM", 5, 1.0, 1), ("c/d", "LLM", 4, 1.0, 2)],
        "repo_full_name string, category string, star_count_in_window bigint, "
        "weekly_percent_gain double, rank int",
    )
    radar = rp.news_radar(movers, spark.createDataFrame(rows, HEADLINES)).orderBy("rank").collect()
    assert [h["title"] for h in radar[0]["headlines"]] == ["t2", "t3", "t4"]
    assert radar[0]["headlines"][0]["source"] == "bing"
    assert radar[1]["headlines"] == []


def test_one_repository_with_most_events(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot/repo").otherwise(F.concat(F.lit("r/"), F.col("id") % 50)).alias("n"),
        F.col("id"),
    )
    seen = rows.select(
        F.col("id").cast("string").alias("event_id"),
        F.lit("WatchEvent").alias("event_type"),
        F.concat(F.lit("u"), F.col("id") % 1000).alias("actor_login"),
        F.col("n").alias("repo_name"),
        F.lit("2024-01-30").cast("timestamp").alias("created_at"),
    )
    got = {r["repo_key"]: r for r in ru.market_repo_metrics(seen, AS_OF, 7).collect()}
    assert got["hot/repo"]["star_count_in_window"] == 6667
    assert got["hot/repo"]["unique_actors_in_window"] == 1000


def test_a_hot_key_is_shared_out(spark):
    facts = spark.range(9000).select(
        F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 900 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 300))
        .alias("key"),
    )
    names = facts.select("key").where("key <> 'k1'").distinct()
    dimension = names.withColumn("value", F.concat(F.lit("v-"), "key"))
    plain = facts.join(dimension, "key", "left")
    spread = spread_left_join(facts, dimension, "key", "event_id")
    columns = ["event_id", "key", "value"]
    assert spread.count() == 9000
    assert spread.select(columns).exceptAll(plain.select(columns)).isEmpty()
    # Without these two settings the small test would be broadcast or put into one task again.
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        tasks = (
            spread_left_join(facts, dimension, "key", "event_id")
            .where("key = 'hot'")
            .select(F.spark_partition_id().alias("p"))
            .distinct()
            .count()
        )
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert tasks > 1
