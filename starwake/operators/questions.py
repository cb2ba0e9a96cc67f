"""Reading questions, collecting evidence and answering from templates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.functions import text as tx
from starwake.operators.joins import spread_left_join
from starwake.operators.market import listed
from starwake.vocab import (
    ANSWER_TEXTS,
    CATEGORY_QUESTION,
    EVIDENCE_TEXTS,
    FOLLOW_UPS,
    KNOWLEDGE_QUESTION,
    REPO_MENTION,
    SEARCH_QUESTION,
    TOPIC_QUESTION,
)

HISTORY_TURNS = 6


def intent_of(question: Column) -> Column:
    """knowledge, search or instant; NULL for a question of fewer than two characters."""
    asked = tx.strip(question)
    return (
        F.when(F.coalesce(F.length(asked), F.lit(0)) < 2, None)
        .when(F.rlike(asked, F.lit(REPO_MENTION)), "knowledge")
        .when(F.rlike(asked, F.lit(SEARCH_QUESTION)), "search")
        .when(F.rlike(asked, F.lit(KNOWLEDGE_QUESTION)), "knowledge")
        .otherwise("instant")
    )


def repo_mention(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, REPO_MENTION, 0), F.lit(""))


def classify_questions(turns: DataFrame) -> DataFrame:
    """Intent and wanted sections of every user turn."""
    asked = turns.where(F.col("role") == "user")
    question = tx.strip(F.col("text"))
    categories = F.rlike(question, F.lit(CATEGORY_QUESTION))
    topics = F.rlike(question, F.lit(TOPIC_QUESTION))
    return asked.select(
        "conv_id",
        "turn",
        intent_of(F.col("text")).alias("intent"),
        categories.alias("wants_categories"),
        topics.alias("wants_topics"),
        (~categories & ~topics).alias("wants_breakouts"),
    )


def extract_repo_mentions(turns: DataFrame) -> DataFrame:
    """Repository a user turn is about: its own mention, else the newest of the last six turns.

    ``turn`` numbers the messages of a conversation. Every mention is sent forward to the turns
    that may still refer to it, so turns meet on (conversation, turn) and a conversation of any
    length is spread over all tasks.
    """
    mentions = turns.select("conv_id", "turn", repo_mention(F.col("text")).alias("mention")).where(
        F.col("mention").isNotNull()
    )
    remembered = (
        mentions.select(
            "conv_id",
            F.explode(
                F.sequence(F.col("turn") + 1, F.col("turn") + HISTORY_TURNS)
            ).alias("turn"),
            F.col("turn").alias("said_at"),
            "mention",
        )
        .groupBy("conv_id", "turn")
        .agg(F.max_by("mention", "said_at").alias("remembered"))
    )
    return (
        turns.where(F.col("role") == "user")
        .select("conv_id", "turn", repo_mention(F.col("text")).alias("own"))
        .join(remembered, ["conv_id", "turn"], "left")
        .select("conv_id", "turn", F.coalesce("own", "remembered").alias("repo_name"))
    )


# --------------------------------------------------------------------------- market tables as lists


def market_lists(
    breakouts: DataFrame, categories: DataFrame, topics: DataFrame
) -> tuple[Column, Column, Column]:
    """The three top-k reports as ordered lists, each a scalar: all questions share them."""
    orders = (
        (
            breakouts,
            [
                F.desc("star_count_in_window"),
                F.desc("total_events_in_window"),
                F.desc("stargazers_count"),
                F.asc("repo_full_name"),
            ],
        ),
        (
            categories,
            [F.desc("total_stars_in_window"), F.desc("total_events_in_window"), F.asc("category")],
        ),
        (topics, [F.desc("star_count_in_window"), F.desc("repo_count"), F.asc("topic")]),
    )
    return tuple(listed(rows, order, "items").scalar() for rows, order in orders)


# --------------------------------------------------------------------------- evidence


@dataclass(frozen=True)
class Keep:
    """How many lines of each section are evidence, and how many of all."""

    breakouts: int = 5
    categories: int = 4
    topics: int = 5
    search: int = 5
    evidence: int = 12
    answer_topics: int = 6
    answer_categories: int = 5
    answer_evidence: int = 8


EVIDENCE = (
    "array<struct<section: int, place: int, label: string, value: string, source: string>>"
)


def _section(
    items: Column,
    keep: int,
    section: int,
    kind: str,
    label: Callable[[Column], Column],
    *values: Callable[[Column], Column],
) -> Column:
    """The first lines of a list as evidence, in its order."""
    pattern, source = EVIDENCE_TEXTS[kind]
    return F.transform(
        F.slice(items, 1, keep),
        lambda item, at: F.struct(
            F.lit(section).alias("section"),
            (at + 1).alias("place"),
            label(item).alias("label"),
            F.format_string(pattern, *[value(item) for value in values]).alias("value"),
            F.lit(source).alias("source"),
        ),
    )


def _field(name: str) -> Callable[[Column], Column]:
    return lambda item: item.getField(name)


def market_evidence(
    breakouts: Column, categories: Column, topics: Column, question: Column, keep: Keep = Keep()
) -> Column:
    """The market sections a question asks for; all three when it names none."""
    wants_categories = F.rlike(question, F.lit(CATEGORY_QUESTION))
    wants_topics = F.rlike(question, F.lit(TOPIC_QUESTION))
    everything = ~wants_categories & ~wants_topics
    nothing = F.array().cast(EVIDENCE)
    stars = _field("star_count_in_window")
    of_breakouts = _section(
        breakouts,
        keep.breakouts,
        1,
        "breakout",
        _field("repo_full_name"),
        stars,
        _field("total_events_in_window"),
        _field("unique_actors_in_window"),
    )
    of_categories = _section(
        categories,
        keep.categories,
        2,
        "category",
        _field("category"),
        _field("active_repo_count"),
        _field("total_stars_in_window"),
        _field("leader_repo_name"),
    )
    of_topics = _section(topics, keep.topics, 3, "topic", _field("topic"), stars, _field("repo_count"))
    return F.concat(
        F.when(everything, of_breakouts).otherwise(nothing),
        F.when(wants_categories | everything, of_categories).otherwise(nothing),
        F.when(wants_topics | everything, of_topics).otherwise(nothing),
    )


def search_evidence(results: Column, keep: Keep = Keep()) -> Column:
    """``results``: list of (repo_full_name, score, star_count_in_window, why_matched), best first."""
    return _section(
        results,
        keep.search,
        4,
        "search",
        _field("repo_full_name"),
        lambda item: F.bround(item.getField("score"), 2),
        _field("star_count_in_window"),
        lambda item: F.array_join(F.slice(item.getField("why_matched"), 1, 2), "; "),
    )


def repo_evidence(brief: Column) -> Column:
    """Two lines of a repository's report, none for null."""
    pattern, source = EVIDENCE_TEXTS["repo"]
    numbers = F.format_string(
        pattern,
        *[
            brief.getField(name)
            for name in (
                "trend_verdict",
                "star_count_in_window",
                "total_events_in_window",
                "unique_actors_in_window",
            )
        ],
    )

    def line(place: int, label: Column, value: Column) -> Column:
        return F.struct(
            F.lit(5).alias("section"),
            F.lit(place).alias("place"),
            label.alias("label"),
            value.alias("value"),
            F.lit(source).alias("source"),
        )

    lines = F.array(
        line(1, brief.getField("repo_full_name"), numbers),
        line(2, F.lit("why_trending"), brief.getField("why_trending")),
    )
    return F.when(brief.isNotNull(), lines).otherwise(F.array().cast(EVIDENCE))


# --------------------------------------------------------------------------- answers


def _numbered(title: str, items: Column, keep: int, kind: str, *values: Callable[[Column], Column]) -> Column:
    """Numbered lines under a title."""
    lines = F.transform(
        F.slice(items, 1, keep),
        lambda item, at: F.format_string(
            ANSWER_TEXTS[f"{kind}_line"], at + 1, *[value(item) for value in values]
        ),
    )
    return F.concat_ws("\n", F.lit(ANSWER_TEXTS[title]), F.array_join(lines, "\n"))


def topics_answer(topics: Column, keep: Keep = Keep()) -> Column:
    values = (_field("topic"), _field("star_count_in_window"), _field("repo_count"))
    return _numbered("topics_title", topics, keep.answer_topics, "topics", *values)


def categories_answer(categories: Column, keep: Keep = Keep()) -> Column:
    names = ("category", "active_repo_count", "total_stars_in_window", "leader_repo_name")
    return _numbered(
        "categories_title", categories, keep.answer_categories, "categories", *map(_field, names)
    )


def search_answer(results: Column, keep: Keep = Keep()) -> Column:
    values = (
        _field("repo_full_name"),
        lambda item: F.bround(item.getField("score"), 2),
        _field("star_count_in_window"),
    )
    return _numbered("search_title", results, keep.search, "search", *values)


def evidence_answer(evidence: Column, keep: Keep = Keep()) -> Column:
    lines = F.transform(
        F.slice(evidence, 1, keep.answer_evidence),
        lambda item: F.format_string(
            ANSWER_TEXTS["evidence_line"], *[item.getField(name) for name in ("label", "value", "source")]
        ),
    )
    return F.concat_ws("\n", F.lit(ANSWER_TEXTS["evidence_title"]), F.array_join(lines, "\n"))


def repo_answer(brief: Column) -> Column:
    def say(kind: str, *names: str) -> Column:
        return F.format_string(ANSWER_TEXTS[kind], *[brief.getField(name) for name in names])

    window = ("window_days", "star_count_in_window", "total_events_in_window", "unique_actors_in_window")
    return F.concat_ws(
        "\n",
        say("repo_verdict", "repo_full_name", "trend_verdict"),
        brief.getField("summary"),
        say("repo_window", *window),
        say("repo_reason", "why_trending"),
    )


def follow_ups(intent: Column, repo_name: Column) -> Column:
    """Questions to ask next: about the repository if there is one, else by intent."""

    def texts(kind: str) -> Column:
        return F.array(*[F.lit(text) for text in FOLLOW_UPS[kind]])

    of_repo = F.array(*[F.format_string(text, repo_name) for text in FOLLOW_UPS["repo"]])
    return (
        F.when(intent == "repo", of_repo)
        .when(intent == "search", texts("search"))
        .when(intent == "knowledge", texts("knowledge"))
        .when(intent == "instant", texts("instant"))
    )


# --------------------------------------------------------------------------- all questions at once


def answer_questions(
    turns: DataFrame,
    breakouts: DataFrame,
    categories: DataFrame,
    topics: DataFrame,
    briefs: DataFrame | None = None,
    searches: DataFrame | None = None,
    keep: Keep = Keep(),
) -> DataFrame:
    """Every user turn with ``intent``, ``repo_name``, ``tools_used``, ``evidence``, ``answer`` (from
    templates) and ``follow_up_questions``.

    The market reports are the same for all, so they are one-row lists of which conditions choose.
    ``briefs`` has a report per repository, met by the name that a turn or one of the six before it
    mentions; a repository that very many ask about is shared out. ``searches`` has ``conv_id``,
    ``turn`` and ``results`` of the turns that were searched for, best first. A question of fewer than
    two characters has no intent and no answer; neither has a search without results.
    """
    lists = dict(zip(("_breakouts", "_categories", "_topics"), market_lists(breakouts, categories, topics)))
    question = tx.strip(F.col("text"))
    asked = (
        turns.where(F.col("role") == "user")
        .select("conv_id", "turn", question.alias("_question"), intent_of(F.col("text")).alias("_intent"))
        .join(extract_repo_mentions(turns), ["conv_id", "turn"])
    )
    known = F.col("_intent") == "knowledge"
    if briefs is None:
        asked = asked.withColumn("_brief", F.lit(None).cast(_BRIEF))
    else:
        fields = ["repo_full_name", "trend_verdict", "summary", "window_days", "star_count_in_window",
                  "total_events_in_window", "unique_actors_in_window", "why_trending"]
        reports = briefs.select(
            tx.repo_key(F.col("repo_full_name")).alias("_key"), F.struct(*fields).cast(_BRIEF).alias("_brief")
        )
        named = asked.withColumn("_key", F.when(known, tx.repo_key(F.col("repo_name"))))
        asked = spread_left_join(named, reports, "_key", "conv_id").drop("_key")
    if searches is None:
        asked = asked.withColumn("_results", F.lit(None).cast(_RESULTS))
    else:
        found = searches.select("conv_id", "turn", F.col("results").cast(_RESULTS).alias("_results"))
        asked = asked.join(found, ["conv_id", "turn"], "left")
    rows = asked.withColumns(lists)
    breakout, category, topic = (F.col(name) for name in lists)
    brief, results = F.col("_brief"), F.col("_results")
    nothing = F.array().cast(EVIDENCE)
    of_search = F.coalesce(search_evidence(results, keep), nothing)
    evidence = (
        F.when(known, F.concat(market_evidence(breakout, category, topic, F.col("_question"), keep), of_search, repo_evidence(brief)))
        .when(F.col("_intent") == "search", of_search)
        .otherwise(nothing)
    )
    tools = F.array_compact(
        F.array(
            F.when(known, "market-brief"),
            F.when(results.isNotNull() & (F.col("_intent") != "instant"), "search"),
            F.when(known & brief.isNotNull(), "repo-brief"),
        )
    )
    wants = {
        "topics": F.rlike("_question", F.lit(TOPIC_QUESTION)),
        "categories": F.rlike("_question", F.lit(CATEGORY_QUESTION)),
    }
    answer = (
        F.when(F.col("_intent") == "instant", ANSWER_TEXTS["instant"])
        .when((F.col("_intent") == "search") & (F.size(results) > 0), search_answer(results, keep))
        .when(known & brief.isNotNull(), repo_answer(brief))
        .when(known & wants["topics"], topics_answer(topic, keep))
        .when(known & wants["categories"], categories_answer(category, keep))
        .when(known, evidence_answer(F.slice(F.col("evidence"), 1, keep.evidence), keep))
    )
    repo = F.col("repo_name")
    intent = F.when(known & repo.isNotNull(), "repo").otherwise(F.col("_intent"))
    return (
        rows.withColumn("evidence", F.slice(evidence, 1, keep.evidence))
        .withColumns({"tools_used": tools, "answer": answer, "intent": intent})
        .select(
            "conv_id",
            "turn",
            "intent",
            F.when(known, repo).alias("repo_name"),
            "tools_used",
            "evidence",
            "answer",
            follow_ups(F.col("intent"), repo).alias("follow_up_questions"),
        )
    )


def question_evidence(answers: DataFrame) -> DataFrame:
    """The evidence of :func:`answer_questions` as rows; turns without any have none."""
    return answers.select("conv_id", "turn", "intent", "tools_used", F.inline("evidence"))


_BRIEF = (
    "struct<repo_full_name: string, trend_verdict: string, summary: string, window_days: bigint, "
    "star_count_in_window: bigint, total_events_in_window: bigint, unique_actors_in_window: bigint, "
    "why_trending: string>"
)
_RESULTS = (
    "array<struct<repo_full_name: string, score: double, star_count_in_window: bigint, "
    "why_matched: array<string>>>"
)
