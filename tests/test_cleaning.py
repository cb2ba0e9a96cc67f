from frames import events, metadata, ts
from pyspark.sql import functions as F

from starwake.functions import classify as cat
from starwake.functions import scores
from starwake.functions import text as tx
from starwake.functions import times as tm
from starwake.operators import clean as cl
from starwake.schemas import RAW_EVENT


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_first_broken_rule_is_named(spark):
    rows = events(
        spark,
        [
            {},
            {"event_id": " "},
            {"event_type": "watchevent"},
            {"event_type": "MemberEvent"},
            {"actor_id": 0},
            {"actor_login": " \t"},
            {"repo_id": 0},
            {"repo_id": 10**12},
            {"repo_id": 10**12 + 1},
            {"repo_name": "tool"},
            {"repo_name": "a/b/c"},
            {"repo_stargazers_count": -1},
        ],
    )
    reasons = [row["reject_reason"] for row in cl.check_events(rows).collect()]
    assert reasons == [
        None,
        "event_id",
        "event_type",
        "event_type",
        "actor_id",
        "actor_login",
        "repo_id",
        None,
        "repo_id",
        "repo_name",
        "repo_name",
        "stargazers_count",
    ]
    assert cl.valid_events(rows).count() == 2
    assert cl.rejected_events(rows).count() == 10


def test_admission_keeps_bots_and_drops_only_broken_events(spark):
    rows = events(
        spark,
        [
            {"actor_login": "dependabot[bot]", "event_type": "PushEvent"},
            {"actor_login": "  "},
            {"repo_name": ""},
            {"repo_id": 0},
        ],
    )
    kept = cl.flag_bots(cl.admit_events(rows)).collect()
    assert [(row["actor_login"], row["is_bot"]) for row in kept] == [("dependabot[bot]", True)]


def test_times_with_and_without_fraction_and_zone(spark):
    texts = [
        ("2024-06-15T12:00:00Z",),
        ("2024-06-15T12:00:00.250000+00:00",),
        ("2024-06-15T14:00:00+02:00",),
        ("yesterday",),
        (None,),
    ]
    df = spark.createDataFrame(texts, "t string").select(
        tm.parse_iso(F.col("t")).cast("string").alias("p")
    )
    assert [row["p"] for row in df.collect()] == [
        "2024-06-15 12:00:00",
        "2024-06-15 12:00:00.25",
        "2024-06-15 12:00:00",
        None,
        None,
    ]


def test_week_starts_monday_midnight_at_utc_plus_7(spark):
    for as_of, start in [
        ("2024-01-28 16:59:59", "2024-01-21 17:00:00"),
        ("2024-01-28 17:00:00", "2024-01-28 17:00:00"),
        ("2024-01-29 00:00:00", "2024-01-28 17:00:00"),
    ]:
        assert one(spark, tm.week_start(as_of).cast("string").alias("w"))["w"] == start


def test_as_of_may_be_an_aware_datetime(spark):
    assert one(spark, tm.moment(ts("2024-01-31T00:00:00")).cast("string"))[0] == (
        "2024-01-31 00:00:00"
    )


def test_raw_event_mapping(spark):
    raw = spark.createDataFrame(
        [
            (
                '{"id":"evt_1","type":"WatchEvent","actor":{"id":9999,"login":"ann"},'
                '"repo":{"id":123456,"name":"acme/tool"},"payload":{"action":"started"},'
                '"created_at":"2024-06-15T12:00:00Z","_full_repo":{"stargazers_count":42,'
                '"language":null,"topics":["llm"],"description":"d"},'
                '"_repo_issues":[{"title":"broken"}]}',
            ),
            ('{"id":"evt_2","type":"WatchEvent","actor":{"login":"ann"},"repo":{"id":1}}',),
        ],
        "value string",
    ).select(F.from_json("value", RAW_EVENT).alias("r")).select("r.*")
    good, bad = cl.check_events(cl.map_raw_event(raw)).orderBy("event_id").collect()
    assert good["actor_id"] == 9999 and good["repo_stargazers_count"] == 42
    assert good["payload_json"] == '{"action":"started"}' and good["public"] is True
    assert good["repo_primary_language"] == "" and good["issue_titles"] == ["broken"]
    assert good["reject_reason"] is None
    assert bad["reject_reason"] == "actor_id"


def test_whole_numbers(spark):
    texts = ["12", " 7 ", "-3", "true", "False", "1.9", "x", "", None, "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [row[0] for row in df.select(tx.whole_number(F.col("t"))).collect()]
    assert got == [12, 7, -3, 1, 0, 1, 0, 0, 0, 0]


def test_categories_by_topic_priority_and_phrase(spark):
    cases = [
        (["rag", "gpt"], "", "LLM"),
        ([" LLM "], "", "LLM"),
        (["", "RAG"], "", "Agent"),
        ([None, "vlm"], "", "Multimodal"),
        (None, "a Vector Database", "DataEng"),
        ([], "image generation with an agent", "Agent"),
        (["llms"], "nothing", "Other"),
        (None, None, "Other"),
    ]
    df = spark.createDataFrame(cases, "topics array<string>, description string, want string")
    got = df.select("want", cat.classify(F.col("topics"), F.col("description"))).collect()
    assert [row[1] for row in got] == [row[0] for row in got]


def test_loose_categories_look_inside_words(spark):
    df = spark.createDataFrame(
        [(["storage"], "", "a/b", "Agent"), ([], "", "acme/metadata", "DataEng"), ([], "", "x/y", "Other")],
        "topics array<string>, description string, name string, want string",
    )
    loose = cat.classify_loose(F.col("topics"), F.col("description"), F.col("name"))
    assert all(row[0] == row[1] for row in df.select("want", loose).collect())


def test_signal_text_is_whole_unless_limits_are_given(spark):
    titles = F.array(*[F.lit(f"t{i}") for i in range(12)])
    readme = F.repeat(F.lit("x"), 3000)
    row = one(
        spark,
        cat.signal_text(F.lit(" d "), readme, titles, 2000, 2).alias("short"),
        cat.signal_text(F.lit(None), readme, F.lit(None)).alias("whole"),
        cat.signal_text(F.lit(None), F.lit(None), titles).alias("titles"),
    )
    assert row["short"] == "d " + "x" * 2000 + " t0 t1"
    assert len(row["whole"]) == 3000
    assert row["titles"].endswith("t10 t11")


def test_names_without_a_slash(spark):
    name = F.lit("tool")
    row = one(
        spark,
        tx.snapshot_owner_of(name).alias("a"),
        tx.snapshot_short_name_of(name).alias("b"),
        tx.short_name_of(name).alias("c"),
    )
    assert tuple(row) == ("", "tool", "")


def test_defaults_replace_nulls(spark):
    rows = events(
        spark, [{"repo_topics": None, "repo_stargazers_count": None, "repo_description": None}]
    ).drop("repo_issues_json")
    row = cl.normalise_event_defaults(rows).first()
    assert row["repo_topics"] == [] and row["repo_stargazers_count"] == 0
    assert row["repo_description"] == "" and row["repo_issues_json"] == ""


def test_vectors_that_cannot_be_compared(spark):
    cases = [
        ([1.0, 0.0], [0.0, 0.0], 0.5),
        ([1.0, 0.0], [1.0], 0.5),
        ([], [], 0.5),
        ([1.0, 0.0], [-1.0, 0.0], 0.0),
        ([1.0, 0.0], [2.0, 0.0], 1.0),
        (None, [1.0], None),
    ]
    df = spark.createDataFrame(cases, "a array<double>, b array<double>, want double")
    got = df.select("want", scores.semantic(F.col("a"), F.col("b"))).collect()
    assert [row[1] for row in got] == [row[0] for row in got]


def test_half_even_rounding(spark):
    row = one(spark, scores.rounded(F.lit(0.125), 2), scores.rounded(F.lit(0.375), 2))
    assert tuple(row) == (0.12, 0.38)


def test_ratios_at_the_edges(spark):
    row = one(
        spark,
        scores.window_ratio(F.lit(5), F.lit(0)).alias("no_previous"),
        scores.percent_gain(F.lit(5), F.lit(5)).alias("all_new"),
        scores.percent_gain(F.lit(5), F.lit(3)).alias("fewer_than_new"),
        scores.momentum(F.lit(5), F.lit(0)).alias("no_stars"),
    )
    assert tuple(row) == (5.0, 500.0, 500.0, 5.0)


def test_description_overlap_uses_long_words(spark):
    row = one(
        spark,
        scores.description_overlap(F.lit("Fast vector search"), F.lit("vector store search")),
        scores.description_overlap(F.lit("a b c"), F.lit("vector")),
    )
    assert tuple(row) == (0.5, 0.0)


def test_stored_other_is_classified_again(spark):
    repos = metadata(
        spark,
        [{"category": "Other", "topics": ["llm"]}, {"category": "Agent", "topics": ["llm"]}],
    )
    got = [row["category"] for row in cl.with_effective_category(repos).collect()]
    assert got == ["LLM", "Agent"]


def test_other_is_hidden_unless_alone(spark):
    rows = metadata(spark, [{"category": "Other"}, {"category": "LLM"}])
    assert [r["category"] for r in cl.prefer_categorised(rows).collect()] == ["LLM"]
    only = rows.where("category = 'Other'")
    assert [r["category"] for r in cl.prefer_categorised(only).collect()] == ["Other"]


def test_type_is_filtered_before_the_limit(spark):
    rows = events(
        spark,
        [{"event_type": "PushEvent", "created_at": f"2024-01-30T10:0{i}:00"} for i in range(5)]
        + [{"event_type": "ForkEvent", "created_at": "2024-01-30T09:00:00"}],
    )
    found = cl.latest_events(rows, "2024-01-30 12:00:00", 2, "ForkEvent").collect()
    assert [row["event_type"] for row in found] == ["ForkEvent"]
