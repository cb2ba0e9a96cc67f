import pytest
from pyspark.sql import functions as F

from starwake.operators import catalog as ca
from starwake.operators import questions as qs
from starwake.operators import search as se
from starwake.operators.clean import with_search_document


def pool(spark):
    rows = [
        (1, "browser-use/browser-use", "browser-use", "browser-use", "Browser automation for AI agents",
         "Python", ["browser", "agents", "automation"], "Agent", 52000, 1900),
        (2, "huggingface/transformers", "transformers", "huggingface", "State of the art models",
         "Python", ["llm", "nlp"], "LLM", 145000, 850),
    ]
    df = spark.createDataFrame(
        rows,
        "repo_id bigint, repo_full_name string, repo_name string, owner_login string, "
        "description string, primary_language string, topics array<string>, category string, "
        "stargazers_count bigint, star_count_in_window bigint",
    )
    return with_search_document(df)


def test_words_beat_popularity(spark):
    rows = se.search_repos(pool(spark), "browser automation agents python", days=7).collect()
    assert rows[0]["repo_full_name"] == "browser-use/browser-use"
    assert rows[0]["retrieval_mode"] == "lexical"
    assert rows[0]["matched_terms"] == ["agents", "automation", "browser", "python"]
    assert rows[0]["why_matched"] == [
        "Repo identity matches: browser.",
        "Topic overlap: agents, automation.",
        "Language signal: Python.",
        "Recent momentum: +1,900 stars in 7d.",
    ]
    # name 3 + two topics 2.5 + language 2.25 + every term in the document 3, of 4 + 12 + 3
    assert rows[0]["lexical_score"] == round((3 + 5 + 2.25 + 3) / 19, 4)


def test_vectors_decide_a_hybrid_search(spark):
    vectors = spark.createDataFrame(
        [(1, [0.2, 0.98]), (2, [0.98, 0.2])], "repo_id bigint, embedding array<double>"
    )
    query = F.array(F.lit(1.0), F.lit(0.0))
    rows = se.search_repos(pool(spark), "zzz", vectors=vectors, query_vector=query).collect()
    assert rows[0]["repo_full_name"] == "huggingface/transformers"
    assert rows[0]["retrieval_mode"] == "hybrid"
    assert "Semantic reranker found a strong conceptual match." in rows[0]["why_matched"]


def test_no_match_gives_no_rows(spark):
    assert se.search_repos(pool(spark), "zzz").count() == 0


def test_short_queries_are_refused(spark):
    with pytest.raises(ValueError):
        se.search_repos(pool(spark), " x ")


def test_a_query_of_signs_has_no_terms(spark):
    assert se.search_repos(pool(spark), "!! ??").count() == 0


def test_related_scores(spark):
    source = F.struct(
        F.lit("a/src").alias("repo_full_name"),
        F.array(F.lit("LLM"), F.lit("nlp")).alias("topics"),
        F.lit("LLM").alias("category"),
        F.lit("Python").alias("primary_language"),
        F.lit(100).alias("stargazers_count"),
        # "of", "the" and "art" are too short to count, so the descriptions overlap fully.
        F.lit("state models").alias("description"),
        F.lit(0).alias("star_count_in_window"),
    )
    candidates = pool(spark).withColumn("source", source)
    row = se.rank_related(candidates, 5).first()
    expected = 0.4 + 0.2 + 0.1 + 0.15 * round(100 / 145000, 4) + 0.1 * round(1 / 850, 4) + 0.05
    assert row["repo_full_name"] == "huggingface/transformers"
    assert row["similarity_score"] == pytest.approx(round(expected, 4))
    assert row["shared_topics"] == ["llm", "nlp"]
    assert row["why_related"] == [
        "Shared topics: llm, nlp.",
        "Same category: LLM.",
        "Same language stack: Python.",
    ]


def test_intents(spark):
    cases = [
        ("tell me about openai/gpt", "knowledge"),
        ("Find vector tools", "search"),
        ("goi y cho minh", "search"),
        ("which topic is HOT", "knowledge"),
        ("what is a star-schema", "knowledge"),
        ("hello there", "instant"),
        (" x ", None),
    ]
    df = spark.createDataFrame(cases, "q string, want string")
    got = df.select("want", qs.intent_of(F.col("q"))).collect()
    assert [r[1] for r in got] == [r[0] for r in got]


def test_mentions_are_remembered_for_six_turns(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", "hi") for i in range(10)]
    turns[0] = (1, 0, "assistant", "see acme/old")
    turns[1] = (1, 1, "user", "and acme/new please")
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r["turn"]: r["repo_name"] for r in qs.extract_repo_mentions(df).collect()}
    assert got == {1: "acme/new", 3: "acme/new", 5: "acme/new", 7: "acme/new", 9: None}


def test_all_questions_are_answered_at_once(spark):
    turns = [
        (1, 0, "user", "which topic is hot"), (1, 1, "assistant", "see acme/tool"), (1, 2, "user", "is it trending?"),
        (2, 0, "user", "best category by star"), (2, 1, "user", "find agents"), (2, 2, "user", "find nothing"),
        (3, 0, "user", "x"), (3, 1, "user", "hello there"), (4, 0, "user", "what is trending"),
        (5, 0, "user", "about no/body"), (6, 0, "user", None),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    breakouts = spark.createDataFrame(
        [(f"b/{at}", 100 - at, 200, 30, 5) for at in range(6)],
        "repo_full_name string, star_count_in_window bigint, total_events_in_window bigint, "
        "unique_actors_in_window bigint, stargazers_count bigint",
    )
    categories = spark.createDataFrame(
        [(f"c{at}", 3, 50 - at, 70, f"l/{at}") for at in range(6)],
        "category string, active_repo_count bigint, total_stars_in_window bigint, "
        "total_events_in_window bigint, leader_repo_name string",
    )
    topics = spark.createDataFrame(
        [(f"t{at}", 4, 40 - at) for at in range(8)], "topic string, repo_count bigint, star_count_in_window bigint"
    )
    briefs = spark.createDataFrame(
        [("Acme/Tool", "steady", "A summary.", 30, 9, 8, 7, "Because.")],
        "repo_full_name string, trend_verdict string, summary string, window_days bigint, star_count_in_window bigint, "
        "total_events_in_window bigint, unique_actors_in_window bigint, why_trending string",
    )
    searches = spark.createDataFrame(
        [(2, 1, [("a/b", 0.345, 12, ["one", "two", "three"])]), (2, 2, [])],
        "conv_id bigint, turn bigint, results array<struct<repo_full_name: string, score: double, "
        "star_count_in_window: bigint, why_matched: array<string>>>",
    )
    rows = qs.answer_questions(df, breakouts, categories, topics, briefs, searches).collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert len(got) == len([one for one in turns if one[2] == "user"])
    shown = {key: [(e.section, e.place) for e in r.evidence] for key, r in got.items()}
    assert shown[1, 0] == [(3, at) for at in range(1, 6)]
    assert got[1, 0].answer.split("\n")[1:] == [f"{at + 1}. t{at}: +{40 - at} stars tren 4 repos." for at in range(6)]
    assert (got[1, 2].intent, got[1, 2].repo_name, got[1, 2].tools_used) == ("repo", "acme/tool", ["market-brief", "repo-brief"])
    assert shown[1, 2] == [(1, at) for at in range(1, 6)] + [(2, at) for at in range(1, 5)] + [(3, at) for at in range(1, 4)]
    assert got[1, 2].answer.split("\n") == [
        "Acme/Tool dang duoc xep la steady.", "A summary.", "Trong 30 ngay: +9 stars, 8 events, 7 actors.", "Ly do chinh: Because.",
    ]
    assert got[1, 2].follow_up_questions[1] == "Tim cac repo lien quan den acme/tool"
    assert shown[2, 0] == [(2, at) for at in range(1, 5)] and got[2, 0].answer.count("\n") == 5
    assert got[2, 1].tools_used == ["search"] and got[2, 1].evidence[0].value == "score 0.34, +12 stars, one; two"
    assert got[2, 1].answer.endswith("1. a/b: score 0.34, +12 stars.")
    assert got[2, 2].answer is None and got[2, 2].tools_used == ["search"] and got[2, 2].evidence == []
    assert [got[3, 0].intent, got[3, 0].answer, got[6, 0].intent, got[6, 0].answer] == [None] * 4
    assert got[3, 1].intent == "instant" and got[3, 1].tools_used == [] and len(got[3, 1].follow_up_questions) == 3
    assert got[4, 0].answer.count("\n- ") == 8 and len(got[4, 0].evidence) == 12
    # A mentioned repository without a report: the market answers, follow-ups are about it.
    assert (got[5, 0].intent, got[5, 0].tools_used) == ("repo", ["market-brief"])
    assert "no/body" in got[5, 0].follow_up_questions[0] and got[5, 0].answer.count("\n- ") == 8


def split(cells, lo, hi, dlo, dhi, size, out):
    """The rule, step by step."""
    inside = [c for c in cells if lo <= c[0] <= hi and dlo <= c[1] <= dhi]
    if not inside:
        return
    if len(inside) <= size or (lo == hi and dlo == dhi):
        out.add((lo, hi, dlo, dhi, len(inside)))
    elif lo < hi:
        split(cells, lo, (lo + hi) // 2, dlo, dhi, size, out)
        split(cells, (lo + hi) // 2 + 1, hi, dlo, dhi, size, out)
    else:
        middle = dlo + (dhi - dlo) // 2
        split(cells, lo, hi, dlo, middle, size, out)
        split(cells, lo, hi, middle + 1, dhi, size, out)


def test_shards_match_the_step_by_step_rule(spark):
    """A third of all repositories share one star number."""
    import random
    from datetime import date, timedelta

    rng = random.Random(5)
    start, today = date(2020, 1, 1), date(2020, 12, 31)
    cells = [
        (500 if rng.random() < 0.34 else rng.randint(10, 3000), rng.randint(0, 365))
        for _ in range(600)
    ]
    epoch = (start - date(1970, 1, 1)).days
    expected = set()
    split(cells, 10, max(c[0] for c in cells), 0, 365, 7, expected)
    repos = spark.createDataFrame(
        [(f"a/{i}", s, start + timedelta(days=d)) for i, (s, d) in enumerate(cells)],
        "repo_full_name string, stargazers_count bigint, github_created_at date",
    )
    shards = ca.plan_catalog_shards(repos, 10, 7, start, today)
    got = {
        (
            r["min_stars"],
            r["max_stars"],
            (r["created_after"] - date(1970, 1, 1)).days - epoch,
            (r["created_before"] - date(1970, 1, 1)).days - epoch,
            r["matched_count"],
        )
        for r in shards.collect()
    }
    assert got == expected


def test_a_shard_that_cannot_be_split_is_reported(spark):
    from datetime import date

    one_day = date(2020, 5, 5)
    repos = spark.createDataFrame(
        [(f"a/{i}", 100, one_day) for i in range(5)],
        "repo_full_name string, stargazers_count bigint, github_created_at date",
    )
    shards = ca.plan_catalog_shards(repos, 10, 3, date(2020, 1, 1), date(2021, 1, 1))
    for read in (shards, shards.select("min_stars"), shards.groupBy().count()):
        with pytest.raises(Exception, match="shard cannot be split any further: stars:100..100"):
            read.collect()
    assert ca.plan_catalog_shards(repos, 10, 5, date(2020, 1, 1), date(2021, 1, 1)).count() == 1


def test_candidates_list_each_shard_once_in_order(spark):
    items = spark.createDataFrame(
        [("a/x", "u1", 5, 1, "s2"), ("a/x", "u2", 6, 2, "s1"), ("a/x", "u3", 7, 3, "s2"), ("", "u", 1, 4, "s1")],
        "repo_full_name string, html_url string, stargazers_count bigint, position int, shard string",
    )
    row = ca.catalog_candidates(items).collect()
    assert len(row) == 1
    assert row[0]["source_shards"] == ["s2", "s1"]
    assert (row[0]["html_url"], row[0]["stargazers_count"]) == ("u3", 7)


def test_a_word_far_into_the_document_counts(spark):
    row = ("x/y", "y", "x", "Python", ["a"], "LLM", 10, 1)
    names = "repo_full_name string, repo_name string, owner_login string, primary_language string, topics array<string>, category string, stargazers_count bigint, star_count_in_window bigint"
    df = spark.createDataFrame([row], names).selectExpr("*", "repeat('filler ', 400) || 'needle' AS description")
    got = se.with_lexical_score(with_search_document(df), "filler needle").first()
    assert got["phrase_in_document"]
