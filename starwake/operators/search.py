"""Search, its explanations, and related repositories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starwake.functions import scores
from starwake.functions import text as tx
from starwake.functions.times import Moment, in_window
from starwake.operators import rollups as ru
from starwake.operators.clean import (
    filter_catalog,
    with_effective_category,
    with_search_document,
)
from starwake.operators.ranking import top_k
from starwake.operators.reports import may_be_in_category
from starwake.vocab import QUERY_TERM, RELATED_REASONS, SEARCH_REASONS

HIT_KINDS = ["name", "topic", "language", "category", "description"]
HIT_POINTS = {"name": 3.0, "topic": 2.5, "language": 2.25, "category": 2.25, "description": 1.5}


def _pool_order() -> list[Column]:
    return [
        F.desc("star_count_in_window"),
        F.desc("stargazers_count"),
        F.desc("github_pushed_at"),
        F.asc("repo_full_name"),
    ]


def search_pool(
    metadata: DataFrame,
    star_counts: DataFrame,
    as_of: Moment,
    days: int = 30,
    min_stars: int = 0,
    category: str | None = None,
    language: str | None = None,
) -> DataFrame:
    """Every repository a search may return, with its stored stars of the window."""
    chosen = filter_catalog(ru.latest_metadata(metadata), min_stars, None, language)
    stars = ru.sum_star_counts(star_counts, as_of, days)
    return (
        may_be_in_category(chosen, category)
        .join(stars, "repo_key", "left")
        .withColumn("star_count_in_window", F.coalesce("star_count_in_window", F.lit(0)))
        .transform(with_effective_category)
        .transform(lambda repos: filter_catalog(repos, category=category))
        .transform(with_search_document)
        .drop("repo_key")
    )


def search_pool_from_events(
    events: DataFrame,
    as_of: Moment,
    days: int = 30,
    min_stars: int = 0,
    category: str | None = None,
    language: str | None = None,
) -> DataFrame:
    """The same when no repository has metadata; the category is the classified one."""
    seen = events.where(F.col("repo_stargazers_count") >= min_stars)
    if language:
        seen = seen.where(F.lower("repo_primary_language") == language.lower())
    rows = ru.repo_rollup_raw(seen, as_of, window=in_window(F.col("created_at"), as_of, days))
    classified = with_effective_category(rows)
    if category:
        classified = classified.where(F.col("category") == category)
    return with_search_document(classified)


def search_candidates(pool: DataFrame, limit: int = 40) -> DataFrame:
    """The most active repositories of the pool."""
    return top_k(pool, _pool_order(), limit)


def _check_query(query: str) -> str:
    normalised = " ".join(query.strip().lower().split())
    if len(normalised) < 2:
        raise ValueError("a search needs at least 2 characters")
    return normalised


def _hits(term: Column) -> Column:
    """Where a term is found first: name, topic, language, category or description."""

    def has(name: str) -> Column:
        return F.contains(F.lower(tx.text_or_empty(F.col(name))), term)

    in_topic = F.exists(scores.lowered(F.col("topics")), lambda topic: F.contains(topic, term))
    return (
        F.when(has("repo_full_name") | has("repo_name") | has("owner_login"), "name")
        .when(in_topic, "topic")
        .when(has("primary_language"), "language")
        .when(has("category"), "category")
        .when(has("description"), "description")
    )


def _terms(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(QUERY_TERM, _check_query(query))))


def with_lexical_score(pool: DataFrame, query: str) -> DataFrame:
    """Score of the words of the query; ``_kinds`` keeps where each term was found."""
    phrase, terms = _check_query(query), _terms(query)
    words = F.split(F.lit(" ".join(terms)), " ") if terms else tx.empty_list()
    rows = pool.withColumns(
        {"_kinds": F.transform(words, _hits), "_document": F.lower("search_document")}
    )

    def points_of(kind: Column) -> Column:
        value = F.lit(0.0)
        for name in reversed(HIT_KINDS):
            value = F.when(kind == name, HIT_POINTS[name]).otherwise(value)
        return value

    found = F.aggregate("_kinds", F.lit(0.0), lambda total, kind: total + points_of(kind))
    document = F.col("_document")
    everywhere = F.forall(words, lambda term: F.contains(document, term)) & F.lit(bool(terms))
    description = F.lower(tx.text_or_empty(F.col("description")))
    points = (
        found
        + F.when(F.contains(F.lower("repo_full_name"), F.lit(phrase)), 4.0).otherwise(0.0)
        + F.when(F.contains(description, F.lit(phrase)), 2.5).otherwise(0.0)
        + F.when(everywhere, min(3.0, 0.75 * len(terms))).otherwise(0.0)
    )
    best = 4.0 + 3.0 * max(1, len(terms)) + 3.0
    return rows.withColumns(
        {
            "lexical_score": scores.rounded(F.least(points / best, F.lit(1.0)), 4),
            "phrase_in_document": F.contains("_document", F.lit(phrase)),
        }
    ).drop("_document")


def with_popularity(pool: DataFrame) -> DataFrame:
    return pool.withColumn(
        "popularity_score",
        scores.popularity(F.col("stargazers_count"), F.col("star_count_in_window")),
    )


def with_semantic_score(
    pool: DataFrame, vectors: DataFrame, query_vector: Column, key: str = "repo_id"
) -> DataFrame:
    """Similarity of repository vectors (``key``, ``embedding``) to the query's vector."""
    similarity = scores.semantic(F.col("embedding"), F.col("_query"))
    scored = vectors.withColumn("_query", query_vector).select(
        key, similarity.alias("semantic_score")
    )
    return pool.join(scored, key, "left")


def _matched(terms: list[str], kind: str | None = None) -> Column:
    """Terms found at all, or found in one kind of place, sorted."""
    words = F.split(F.lit(" ".join(terms)), " ") if terms else tx.empty_list()
    slots = F.arrays_zip(words.alias("term"), F.col("_kinds").alias("kind"))
    hit = F.filter(
        slots,
        lambda slot: slot.getField("kind").isNotNull()
        if kind is None
        else slot.getField("kind") == kind,
    )
    return F.array_sort(F.transform(hit, lambda slot: slot.getField("term")))


def with_reasons(results: DataFrame, query: str, days: int) -> DataFrame:
    """Matched terms and up to four reasons, for the rows that are shown."""
    terms = _terms(query)
    found = results.withColumns(
        {f"_{kind}_terms": _matched(terms, kind) for kind in HIT_KINDS}
        | {"matched_terms": _matched(terms)}
    )

    def listing(kind: str) -> Column:
        hits = F.col(f"_{kind}_terms")
        line = F.format_string(SEARCH_REASONS[kind], F.array_join(hits, ", "))
        return F.when(F.size(hits) > 0, line)

    def naming(kind: str, column: str) -> Column:
        line = F.format_string(SEARCH_REASONS[kind], F.col(column))
        return F.when(F.size(f"_{kind}_terms") > 0, line)

    phrase_only = (F.size("matched_terms") == 0) & F.col("phrase_in_document")
    stars, recent = F.col("stargazers_count"), F.col("star_count_in_window")
    pace = F.format_string(SEARCH_REASONS["momentum"], tx.grouped(recent), F.lit(days))
    reasons = tx.non_null(
        listing("name"),
        listing("topic"),
        naming("language", "primary_language"),
        naming("category", "category"),
        listing("description"),
        F.when(phrase_only, SEARCH_REASONS["phrase"]),
        F.when(F.col("semantic_score") >= 0.68, SEARCH_REASONS["semantic"]),
        F.when(recent > 0, pace).when(
            stars >= 20_000, F.format_string(SEARCH_REASONS["established"], tx.grouped(stars))
        ),
    )
    return found.withColumn("why_matched", F.slice(reasons, 1, 4)).drop(
        *[f"_{kind}_terms" for kind in HIT_KINDS], "_kinds", "phrase_in_document"
    )


def search_repos(
    pool: DataFrame,
    query: str,
    days: int = 30,
    limit: int = 10,
    vectors: DataFrame | None = None,
    query_vector: Column | None = None,
    pool_size: int | None = None,
) -> DataFrame:
    """Best repositories for a query, by words and popularity, and by vectors when given.

    Every repository of the pool is scored; ``pool_size`` limits the scoring to the most active
    ones, as an interactive caller may want.
    """
    _check_query(query)
    if pool_size is not None:
        pool = search_candidates(pool, pool_size)
    scored = with_popularity(with_lexical_score(pool, query))
    words, popular = F.col("lexical_score"), F.col("popularity_score")
    by_words = scores.rounded(words * 0.75 + popular * 0.25, 4)
    if vectors is None or query_vector is None:
        scored = scored.withColumn("semantic_score", F.lit(None).cast("double"))
        mode, score, wanted = "lexical", by_words, words > 0
    else:
        scored = with_semantic_score(scored, vectors, query_vector)
        meaning = F.col("semantic_score")
        mixed = scores.rounded(words * 0.4 + meaning * 0.45 + popular * 0.15, 4)
        mode, score = "hybrid", F.when(meaning.isNull(), by_words).otherwise(mixed)
        wanted = (words > 0) | F.coalesce(meaning >= 0.58, F.lit(False))
    results = scored.withColumns(
        {"score": score, "retrieval_mode": F.lit(mode), "_wanted": wanted}
    )
    # Wanted rows sort first and the rest is dropped after the limit: the same rows as filtering
    # first, but the filter does not copy the whole score expression below every projection.
    order = [
        F.desc("_wanted"),
        F.desc("score"),
        F.desc("lexical_score"),
        F.desc(F.coalesce("semantic_score", F.lit(0.0))),
        F.desc("star_count_in_window"),
        F.desc("stargazers_count"),
        F.asc("repo_full_name"),
    ]
    best = top_k(results, order, limit).where("_wanted").drop("_wanted")
    return with_reasons(best, query, days)


# --------------------------------------------------------------------------- related repositories

SOURCE_FIELDS = [
    "repo_full_name",
    "topics",
    "category",
    "primary_language",
    "stargazers_count",
    "description",
]


def related_repos(
    metadata: DataFrame,
    events: DataFrame,
    star_counts: DataFrame,
    repo_name: str | None,
    as_of: Moment,
    days: int = 30,
    limit: int = 5,
    repo_id: int | None = None,
) -> DataFrame:
    """Repositories of the same category that resemble one source repository.

    The source is one row: it enters every score as a scalar subquery, so the candidates are
    scanned and scored where they are, without a join.
    """
    catalogue = with_effective_category(ru.latest_metadata(metadata))
    wanted = (
        F.col("repo_key") == repo_name.lower()
        if repo_name is not None
        else F.col("repo_id") == repo_id
    )
    source = catalogue.where(wanted)
    of_source = ru.keyed(events).where(wanted)
    recent = ru.window_star_metrics(of_source, as_of, days).drop("latest_event_at")
    source = (
        source.join(recent, "repo_key", "left")
        .agg(
            F.first(
                F.struct(
                    *SOURCE_FIELDS,
                    F.coalesce("star_count_in_window", F.lit(0)).alias("star_count_in_window"),
                )
            ).alias("source")
        )
        .select("source")
    )
    of = source.scalar()
    stars = ru.sum_star_counts(star_counts, as_of, days)
    source_stars = of.getField("stargazers_count")
    min_stars = F.greatest(
        F.least(F.floor(source_stars / 20), F.lit(10_000)), F.lit(1_000)
    )
    candidates = (
        catalogue.where(
            (F.col("category") == of.getField("category"))
            & (F.col("stargazers_count") >= min_stars)
            & (F.col("repo_full_name") != of.getField("repo_full_name"))
        )
        .join(stars, "repo_key", "left")
        .withColumn("star_count_in_window", F.coalesce("star_count_in_window", F.lit(0)))
        .withColumn("source", of)
    )
    return rank_related(candidates, limit)


def rank_related(candidates: DataFrame, limit: int) -> DataFrame:
    """Score candidates that carry their source repository in a ``source`` struct."""
    source_topics = F.array_distinct(scores.lowered(F.col("source.topics")))
    shared = scores.shared_topics(F.col("source.topics"), F.col("topics"))
    topic_part = F.when(
        F.size(source_topics) > 0, F.size("shared_topics") / F.greatest(F.size(source_topics), F.lit(1))
    ).otherwise(0.0)
    same_category = F.col("category") == F.col("source.category")
    same_language = (F.col("primary_language") != "") & (
        F.col("primary_language") == F.col("source.primary_language")
    )
    scale = scores.closeness(F.col("source.stargazers_count"), F.col("stargazers_count"))
    pace = scores.closeness(
        F.greatest(F.col("source.star_count_in_window"), F.lit(1)),
        F.greatest(F.col("star_count_in_window"), F.lit(1)),
    )
    overlap = scores.description_overlap(F.col("source.description"), F.col("description"))
    similarity = (
        topic_part * 0.4
        + F.when(same_category, 1.0).otherwise(0.0) * 0.2
        + F.when(same_language, 1.0).otherwise(0.0) * 0.1
        + F.col("_scale") * 0.15
        + F.col("_pace") * 0.1
        + F.col("_overlap") * 0.05
    )
    reasons = tx.non_null(
        F.when(
            F.size("shared_topics") > 0,
            F.format_string(
                RELATED_REASONS["topics"], F.array_join(F.slice("shared_topics", 1, 3), ", ")
            ),
        ),
        F.when(same_category, F.format_string(RELATED_REASONS["category"], F.col("category"))),
        F.when(
            same_language, F.format_string(RELATED_REASONS["language"], F.col("primary_language"))
        ),
        F.when(F.col("_scale") >= 0.5, RELATED_REASONS["scale"]),
        F.when(F.col("_pace") >= 0.5, RELATED_REASONS["momentum"]),
    )
    scored = (
        candidates.withColumns(
            {"shared_topics": shared, "_scale": scale, "_pace": pace, "_overlap": overlap}
        )
        .withColumn("similarity_score", scores.rounded(similarity, 4))
        .where("similarity_score >= 0.25")
        .withColumn("why_related", F.slice(reasons, 1, 4))
        .drop("_scale", "_pace", "_overlap", "source", "repo_key")
    )
    order = [
        F.desc("similarity_score"),
        F.desc("star_count_in_window"),
        F.desc("stargazers_count"),
        F.asc("repo_full_name"),
    ]
    return top_k(scored, order, limit)
