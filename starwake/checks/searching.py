"""Checks of search, related repositories and questions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwake.checks import check
from starwake.checks.insights import BREAKOUTS, CATEGORIES, CONTEXT, REPO_BRIEF, TOPICS
from starwake.checks.sql import EFFECTIVE, STAR, dates, meta_row, rollup, window
from starwake.functions import scores
from starwake.functions import text as tx
from starwake.operators import insight as ins
from starwake.operators import market as mk
from starwake.operators import questions as qs
from starwake.operators import rollups as ru
from starwake.operators import search as se
from starwake.testbed import AS_OF, Testbed
from starwake.vocab import (
    ANSWER_TEXTS,
    CATEGORY_QUESTION,
    EVIDENCE_TEXTS,
    FOLLOW_UPS,
    KNOWLEDGE_QUESTION,
    RELATED_REASONS,
    REPO_MENTION,
    SEARCH_QUESTION,
    SEARCH_REASONS,
    TOPIC_QUESTION,
)

QUERY = "  Red Widget   llm toolkit economy "
TERMS = ["red", "widget", "llm", "toolkit", "economy"]
PHRASE = "red widget llm toolkit economy"

def _sql_list(texts) -> str:
    return "[" + ", ".join(f"'{one}'" for one in texts) + "]"


def _sql_format(pattern: str, *values: str) -> str:
    parts = re.split("%[a-z]", pattern)
    joined = [f"'{parts[0]}'"]
    for value, part in zip(values, parts[1:], strict=True):
        joined += [value, f"'{part}'"]
    return " || ".join(joined)


POOL = f"""
, sums AS (SELECT lower(repo_name) AS repo_key, CAST(sum(star_count) AS BIGINT) AS n
           FROM star_counts WHERE {dates(30)} GROUP BY 1),
pool AS (
  SELECT {meta_row()}, topics AS topic_list, coalesce(n, 0) AS star_count_in_window,
         array_to_string(list_filter([repo_full_name, repo_name, owner_login, primary_language,
           {EFFECTIVE}, array_to_string(topics, ' '), description], lambda p: p <> ''), ' ')
           AS search_document
  FROM meta LEFT JOIN sums USING (repo_key))
"""


def _pool(t: Testbed, **filters) -> DataFrame:
    return se.search_pool(t.metadata(), t.star_counts(), AS_OF, **filters)


@check(
    "search_candidates",
    POOL
    + """SELECT * EXCLUDE (topic_list) FROM pool WHERE stargazers_count >= 1000
         ORDER BY star_count_in_window DESC, stargazers_count DESC, github_pushed_at DESC,
                  repo_full_name LIMIT 40""",
)
def search_candidates(t: Testbed) -> DataFrame:
    return se.search_candidates(_pool(t, min_stars=1000), 40)


@check(
    "search_category",
    POOL
    + """SELECT * EXCLUDE (topic_list) FROM pool WHERE category = 'Agent'
         ORDER BY star_count_in_window DESC, stargazers_count DESC, github_pushed_at DESC,
                  repo_full_name LIMIT 40""",
)
def search_category(t: Testbed) -> DataFrame:
    return se.search_candidates(_pool(t, category="Agent"), 40)


@check(
    "search_candidates_raw",
    rollup("r", "repo_stargazers_count >= 1000", star=f"{STAR} AND {window(30)}")
    + """SELECT * REPLACE (array_to_string(topics, ',') AS topics) FROM r WHERE category = 'Agent'
         ORDER BY star_count_in_window DESC, stargazers_count DESC, github_pushed_at DESC,
                  repo_full_name LIMIT 40""",
)
def search_candidates_raw(t: Testbed) -> DataFrame:
    pool = se.search_pool_from_events(t.events(), AS_OF, min_stars=1000, category="Agent")
    return se.search_candidates(pool, 40).drop("search_document")


@check(
    "tokenize_query",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text),
              '[a-z0-9][a-z0-9+.#/-]*'))), ' ') AS terms FROM documents""",
)
def tokenize_query(t: Testbed) -> DataFrame:
    """Whole documents as queries; terms are sorted for the comparison."""
    terms = F.array_sort(tx.query_terms(F.col("text")))
    return t.table("documents").select("doc_id", F.array_join(terms, " ").alias("terms"))


def _term_points() -> str:
    parts = []
    for term in TERMS:
        parts.append(f"""CASE
          WHEN strpos(lower(repo_full_name), '{term}') > 0 OR strpos(lower(owner_login), '{term}') > 0
            THEN 3.0::DOUBLE
          WHEN len(list_filter(topic_list, lambda x: strpos(lower(x), '{term}') > 0)) > 0
            THEN 2.5::DOUBLE
          WHEN strpos(lower(primary_language), '{term}') > 0 THEN 2.25::DOUBLE
          WHEN strpos(lower(category), '{term}') > 0 THEN 2.25::DOUBLE
          WHEN strpos(lower(description), '{term}') > 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END""")
    return " + ".join(parts)


ALL_TERMS = " AND ".join(f"strpos(lower(search_document), '{term}') > 0" for term in TERMS)
SCORED = (
    POOL
    + f""", points AS (
  SELECT *, {_term_points()}
    + CASE WHEN strpos(lower(repo_full_name), '{PHRASE}') > 0 THEN 4.0::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN strpos(lower(description), '{PHRASE}') > 0 THEN 2.5::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN {ALL_TERMS} THEN least(3.0::DOUBLE, 0.75::DOUBLE * {len(TERMS)}) ELSE 0::DOUBLE END
    AS points FROM pool),
scored AS (
  SELECT *, CAST(round_even(CAST(least(points / (4.0::DOUBLE + 3.0 * {len(TERMS)} + 3.0), 1.0) AS DECIMAL(38, 18)), 4) AS DOUBLE)
              AS lexical_score,
         CAST(round_even(CAST(0.6::DOUBLE * least(ln(1.0::DOUBLE + stargazers_count) / 12, 1)
                    + 0.4::DOUBLE * least(ln(1.0::DOUBLE + star_count_in_window) / 8, 1) AS DECIMAL(38, 18)), 4) AS DOUBLE)
              AS popularity_score FROM points)
"""
)


@check("lexical_score", SCORED + "SELECT repo_id, lexical_score FROM scored")
def lexical_score(t: Testbed) -> DataFrame:
    return se.with_lexical_score(_pool(t), QUERY).select("repo_id", "lexical_score")


@check("popularity_score", SCORED + "SELECT repo_id, popularity_score FROM scored")
def popularity_score(t: Testbed) -> DataFrame:
    return se.with_popularity(_pool(t)).select("repo_id", "popularity_score")


DOT = "list_sum(list_transform(range(1, len(a) + 1), lambda i: CAST(a[i] AS DOUBLE) * CAST(b[i] AS DOUBLE)))"
NORM_A = "sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
NORM_B = "sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
SEMANTIC = f"""
, pairs AS (SELECT vec_id, embedding AS a,
                   (SELECT embedding FROM embeddings WHERE vec_id = 0) AS b FROM embeddings),
semantic AS (SELECT vec_id, vec_id + 1 AS repo_id,
                    CAST(round_even(CAST(greatest(0, least(({DOT} / ({NORM_A} * {NORM_B}) + 1) / 2, 1)) AS DECIMAL(38, 18)), 4) AS DOUBLE)
                      AS semantic_score FROM pairs)
"""


def _vectors(t: Testbed):
    vectors = t.table("embeddings").select((F.col("vec_id") + 1).alias("repo_id"), "embedding")
    query = t.table("embeddings").where("vec_id = 0").select("embedding").scalar()
    return vectors, query


@check("semantic_score", SEMANTIC + "SELECT repo_id, semantic_score FROM semantic")
def semantic_score(t: Testbed) -> DataFrame:
    vectors, query = _vectors(t)
    score = scores.semantic(F.col("embedding"), F.col("query"))
    return vectors.withColumn("query", query).select("repo_id", score.alias("semantic_score"))


FOUND = "repo_id, repo_full_name, category, star_count_in_window, lexical_score, popularity_score"


@check(
    "search_repos",
    SCORED
    + f"""SELECT {FOUND}, 'lexical' AS retrieval_mode,
                 CAST(round_even(CAST(lexical_score * 0.75::DOUBLE + popularity_score * 0.25::DOUBLE AS DECIMAL(38, 18)), 4) AS DOUBLE)
                   AS score
          FROM scored WHERE lexical_score > 0
          ORDER BY score DESC, lexical_score DESC, star_count_in_window DESC,
                   stargazers_count DESC, repo_full_name LIMIT 20""",
)
def search_repos(t: Testbed) -> DataFrame:
    found = se.search_repos(_pool(t), QUERY, limit=20)
    return found.select(*FOUND.split(", "), "retrieval_mode", "score")


@check(
    "search_repos_hybrid",
    SCORED
    + SEMANTIC
    + f""", mixed AS (
      SELECT scored.*, semantic_score,
             CASE WHEN semantic_score IS NULL
               THEN CAST(round_even(CAST(lexical_score * 0.75::DOUBLE + popularity_score * 0.25::DOUBLE AS DECIMAL(38, 18)), 4) AS DOUBLE)
               ELSE CAST(round_even(CAST(lexical_score * 0.4::DOUBLE + semantic_score * 0.45::DOUBLE
                               + popularity_score * 0.15::DOUBLE AS DECIMAL(38, 18)), 4) AS DOUBLE) END AS score
      FROM scored LEFT JOIN semantic USING (repo_id))
    SELECT {FOUND}, semantic_score, 'hybrid' AS retrieval_mode, score FROM mixed
    WHERE lexical_score > 0 OR semantic_score >= 0.58
    ORDER BY score DESC, lexical_score DESC, coalesce(semantic_score, 0) DESC,
             star_count_in_window DESC, stargazers_count DESC, repo_full_name LIMIT 20""",
)
def search_repos_hybrid(t: Testbed) -> DataFrame:
    vectors, query = _vectors(t)
    found = se.search_repos(_pool(t), QUERY, limit=20, vectors=vectors, query_vector=query)
    return found.select(*FOUND.split(", "), "semantic_score", "retrieval_mode", "score")


def _sql_kind(term: str) -> str:
    """Where a term is found first."""
    return f"""CASE
      WHEN strpos(lower(repo_full_name), '{term}') > 0 OR strpos(lower(owner_login), '{term}') > 0 THEN 'name'
      WHEN len(list_filter(topic_list, lambda x: strpos(lower(x), '{term}') > 0)) > 0 THEN 'topic'
      WHEN strpos(lower(primary_language), '{term}') > 0 THEN 'language'
      WHEN strpos(lower(category), '{term}') > 0 THEN 'category'
      WHEN strpos(lower(description), '{term}') > 0 THEN 'description' END"""


def _sql_terms(kind: str) -> str:
    chosen = "x[2] IS NOT NULL" if kind == "" else f"x[2] = '{kind}'"
    return f"list_sort(list_transform(list_filter(list_zip({_sql_list(TERMS)}, kinds), lambda x: {chosen}), lambda x: x[1]))"


def _sql_listing(kind: str) -> str:
    text = _sql_format(SEARCH_REASONS[kind], f"array_to_string({_sql_terms(kind)}, ', ')")
    return f"CASE WHEN len({_sql_terms(kind)}) > 0 THEN {text} END"


def _sql_naming(kind: str, column: str) -> str:
    return f"CASE WHEN len({_sql_terms(kind)}) > 0 THEN {_sql_format(SEARCH_REASONS[kind], column)} END"


@check(
    "search_reasons",
    SCORED
    + f""", shown AS (SELECT *, [{", ".join(map(_sql_kind, TERMS))}] AS kinds,
          CAST(round_even(CAST(lexical_score * 0.75::DOUBLE + popularity_score * 0.25::DOUBLE AS DECIMAL(38, 18)), 4) AS DOUBLE)
            AS score
        FROM scored WHERE lexical_score > 0
        ORDER BY score DESC, lexical_score DESC, star_count_in_window DESC, stargazers_count DESC, repo_full_name LIMIT 20)
    SELECT repo_full_name, array_to_string({_sql_terms("")}, ',') AS matched_terms, array_to_string(list_filter([
        {_sql_listing("name")}, {_sql_listing("topic")}, {_sql_naming("language", "primary_language")},
        {_sql_naming("category", "category")}, {_sql_listing("description")},
        CASE WHEN len({_sql_terms("")}) = 0 AND strpos(lower(search_document), '{PHRASE}') > 0
             THEN '{SEARCH_REASONS["phrase"]}' END,
        CASE WHEN star_count_in_window > 0
             THEN {_sql_format(SEARCH_REASONS["momentum"], "format('{:,}', star_count_in_window)", "'30'")}
             WHEN stargazers_count >= 20000
             THEN {_sql_format(SEARCH_REASONS["established"], "format('{:,}', stargazers_count)")} END],
        lambda x: x IS NOT NULL)[1:4], ',') AS why_matched FROM shown""",
)
def search_reasons(t: Testbed) -> DataFrame:
    found = se.search_repos(_pool(t), QUERY, limit=20)
    return found.select("repo_full_name", "matched_terms", "why_matched")


# --------------------------------------------------------------------------- related

SOURCE = 3

RELATED = (
    POOL
    + f""", recent AS (SELECT repo_key, count(*) FILTER (WHERE {STAR}) AS stars FROM gh
                       WHERE {window(30)} GROUP BY 1),
source AS (
  SELECT pool.*, coalesce((SELECT stars FROM recent WHERE repo_key = lower(pool.repo_full_name)), 0)
           AS window_stars
  FROM pool WHERE repo_id = {SOURCE}),
words AS (
  SELECT p.*, s.repo_full_name AS source_name, s.stargazers_count AS source_stars,
    s.window_stars AS source_window, s.primary_language AS source_language,
    s.category AS source_category,
    list_distinct(list_transform(s.topic_list, lambda x: lower(x))) AS st,
    list_distinct(list_transform(p.topic_list, lambda x: lower(x))) AS pt,
    list_distinct(list_filter(string_split(lower(s.description), ' '), lambda w: len(w) >= 4)) AS sw,
    list_distinct(list_filter(string_split(lower(p.description), ' '), lambda w: len(w) >= 4)) AS pw
  FROM pool p, source s),
parts AS (
  SELECT *, list_sort(list_intersect(st, pt)) AS shared_topics,
    CAST(round_even(CAST(CAST(least(source_stars, stargazers_count) AS DOUBLE)
               / greatest(source_stars, stargazers_count, 1) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS scale,
    CAST(round_even(CAST(CAST(least(greatest(source_window, 1), greatest(star_count_in_window, 1)) AS DOUBLE)
               / greatest(source_window, star_count_in_window, 1) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS pace,
    CASE WHEN len(sw) = 0 OR len(pw) = 0 THEN 0.0::DOUBLE
         ELSE CAST(round_even(CAST(CAST(len(list_intersect(sw, pw)) AS DOUBLE)
                         / len(list_distinct(list_concat(sw, pw))) AS DECIMAL(38, 18)), 4) AS DOUBLE) END AS overlap
  FROM words)
"""
)


def _related(t: Testbed, limit: int = 20) -> DataFrame:
    return se.related_repos(
        t.metadata(), t.events(), t.star_counts(), None, AS_OF, limit=limit, repo_id=SOURCE
    )


RANKED_RELATED = (
    RELATED
    + """, s AS (SELECT *, CAST(round_even(CAST(
             CASE WHEN len(st) = 0 THEN 0.0::DOUBLE
                  ELSE CAST(len(shared_topics) AS DOUBLE) / len(st) END * 0.4::DOUBLE
             + CASE WHEN category = source_category THEN 1.0::DOUBLE ELSE 0::DOUBLE END * 0.2::DOUBLE
             + CASE WHEN primary_language <> '' AND primary_language = source_language
                    THEN 1.0::DOUBLE ELSE 0::DOUBLE END * 0.1::DOUBLE
             + scale * 0.15::DOUBLE + pace * 0.1::DOUBLE + overlap * 0.05::DOUBLE AS DECIMAL(38, 18)), 4) AS DOUBLE)
             AS similarity_score FROM parts)
    , related AS (SELECT * FROM s
    WHERE similarity_score >= 0.25 AND category = source_category AND repo_full_name <> source_name
      AND stargazers_count >= greatest(least(source_stars // 20, 10000), 1000)
    ORDER BY similarity_score DESC, star_count_in_window DESC, stargazers_count DESC, repo_full_name
    LIMIT 20)
    """
)


@check(
    "related_repos",
    RANKED_RELATED
    + """SELECT repo_id, repo_full_name, category, stargazers_count, star_count_in_window,
           array_to_string(shared_topics, ',') AS shared_topics, similarity_score FROM related""",
)
def related_repos(t: Testbed) -> DataFrame:
    return _related(t).select(
        "repo_id",
        "repo_full_name",
        "category",
        "stargazers_count",
        "star_count_in_window",
        "shared_topics",
        "similarity_score",
    )


@check(
    "shared_topics",
    RELATED + "SELECT repo_id, array_to_string(shared_topics, ',') AS shared_topics FROM parts",
)
def shared_topics(t: Testbed) -> DataFrame:
    latest = ru.latest_metadata(t.metadata())
    source = latest.where(F.col("repo_id") == SOURCE).select("topics").scalar()
    shared = scores.shared_topics(F.col("source"), F.col("topics"))
    return latest.withColumn("source", source).select("repo_id", shared.alias("shared_topics"))


@check("description_jaccard", RELATED + "SELECT repo_id, overlap AS description_score FROM parts")
def description_jaccard(t: Testbed) -> DataFrame:
    latest = ru.latest_metadata(t.metadata())
    source = latest.where(F.col("repo_id") == SOURCE).select("description").scalar()
    overlap = scores.description_overlap(F.col("source"), F.col("description"))
    return latest.withColumn("source", source).select(
        "repo_id", overlap.alias("description_score")
    )


@check(
    "why_related",
    RANKED_RELATED
    + f"""SELECT repo_full_name, array_to_string(list_filter([
        CASE WHEN len(shared_topics) > 0 THEN {_sql_format(RELATED_REASONS["topics"], "array_to_string(shared_topics[1:3], ', ')")} END,
        CASE WHEN category = source_category THEN {_sql_format(RELATED_REASONS["category"], "category")} END,
        CASE WHEN primary_language <> '' AND primary_language = source_language
             THEN {_sql_format(RELATED_REASONS["language"], "primary_language")} END,
        CASE WHEN scale >= 0.5 THEN '{RELATED_REASONS["scale"]}' END,
        CASE WHEN pace >= 0.5 THEN '{RELATED_REASONS["momentum"]}' END], lambda x: x IS NOT NULL)[1:4], ',')
        AS why_related FROM related""",
)
def why_related(t: Testbed) -> DataFrame:
    return _related(t).select("repo_full_name", "why_related")


# --------------------------------------------------------------------------- questions


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _questions(t: Testbed) -> DataFrame:
    return t.table("conversations")


@check(
    "classify_question",
    f"""SELECT conv_id, turn,
      CASE WHEN len(trim(text)) < 2 THEN NULL
           WHEN regexp_matches(text, '{REPO_MENTION}') THEN 'knowledge'
           WHEN regexp_matches(text, '{_re2(SEARCH_QUESTION)}') THEN 'search'
           WHEN regexp_matches(text, '{_re2(KNOWLEDGE_QUESTION)}') THEN 'knowledge'
           ELSE 'instant' END AS intent,
      regexp_matches(text, '{_re2(CATEGORY_QUESTION)}') AS wants_categories,
      regexp_matches(text, '{_re2(TOPIC_QUESTION)}') AS wants_topics,
      NOT regexp_matches(text, '{_re2(CATEGORY_QUESTION)}')
        AND NOT regexp_matches(text, '{_re2(TOPIC_QUESTION)}') AS wants_breakouts
    FROM conversations WHERE role = 'user'""",
)
def classify_question(t: Testbed) -> DataFrame:
    return qs.classify_questions(_questions(t))


def _linked_turns(t: Testbed) -> DataFrame:
    """The conversations with a mention added to every turn whose text is long enough."""
    conversations = t.table("conversations")
    said = F.when(
        F.length("text") % 5 == 0,
        F.concat(F.lit("see acme/tool-"), F.col("turn").cast("string"), F.lit(" "), F.col("text")),
    ).otherwise(F.col("text"))
    return conversations.withColumn("text", said)


@check(
    "extract_repo_mention",
    f""", said AS (SELECT conv_id, turn, role, nullif(regexp_extract(
                     CASE WHEN len(text) % 5 = 0 THEN 'see acme/tool-' || turn || ' ' || text
                          ELSE text END, '{REPO_MENTION}'), '') AS mention FROM conversations)
    SELECT u.conv_id, u.turn, coalesce(u.mention, (
             SELECT arg_max(h.mention, h.turn) FROM said h
             WHERE h.conv_id = u.conv_id AND h.turn BETWEEN u.turn - 6 AND u.turn - 1
               AND h.mention IS NOT NULL)) AS repo_name
    FROM said u WHERE role = 'user'""",
)
def extract_repo_mention(t: Testbed) -> DataFrame:
    return qs.extract_repo_mentions(_linked_turns(t))


#: Questions made of the conversations: by the length of the text, an opening before it.
OPENINGS = ["hot topic? ", "best category? ", "what is trending? ", "how is %s doing? ", "find something: ", ""]


def _asked(t: Testbed) -> DataFrame:
    names = ru.latest_metadata(t.metadata(), ["repo_id", "repo_full_name"]).select(
        (F.col("repo_id") - 1).alias("_at"), F.col("repo_full_name").alias("_name")
    )
    turns = t.table("conversations").withColumn("_at", F.pmod("conv_id", F.lit(60)))
    kind = F.pmod(F.length("text"), F.lit(len(OPENINGS)))
    openings = F.array(*[F.lit(one) for one in OPENINGS])
    opening = F.replace(F.get(openings, kind), F.lit("%s"), F.coalesce("_name", F.lit("it")))
    return (
        turns.join(names, "_at", "left")
        .withColumn("text", F.concat(opening, "text"))
        .select("conv_id", "turn", "role", "text")
    )


def _lines(section: int, kind: str, table: str, order: str, keep: int, label: str, *values: str) -> str:
    pattern, source = EVIDENCE_TEXTS[kind]
    return f"""SELECT {section} AS section, row_number() OVER (ORDER BY {order}) AS place, {label} AS label,
        {_sql_format(pattern, *values)} AS value, '{source}' AS source FROM {table} QUALIFY place <= {keep}"""


_BREAKOUT_ORDER = "star_count_in_window DESC, total_events_in_window DESC, stargazers_count DESC, repo_full_name"
_CATEGORY_ORDER = "total_stars_in_window DESC, total_events_in_window DESC, category"
_TOPIC_ORDER = "star_count_in_window DESC, repo_count DESC, topic"
_ASKED = f"""
, asked AS (
    SELECT conv_id, turn, role, replace({_sql_list(OPENINGS)}[len(text) % {len(OPENINGS)} + 1], '%s',
        coalesce(repo_full_name, 'it')) || text AS text
    FROM conversations LEFT JOIN meta ON repo_id - 1 = conv_id % 60),
said AS (SELECT *, nullif(regexp_extract(text, '{REPO_MENTION}'), '') AS mention FROM asked),
turns AS (
    SELECT u.conv_id, u.turn,
      CASE WHEN len(trim(text)) < 2 THEN NULL
           WHEN regexp_matches(text, '{REPO_MENTION}') THEN 'knowledge'
           WHEN regexp_matches(text, '{_re2(SEARCH_QUESTION)}') THEN 'search'
           WHEN regexp_matches(text, '{_re2(KNOWLEDGE_QUESTION)}') THEN 'knowledge'
           ELSE 'instant' END AS sort,
      regexp_matches(text, '{_re2(CATEGORY_QUESTION)}') AS wants_categories,
      regexp_matches(text, '{_re2(TOPIC_QUESTION)}') AS wants_topics,
      coalesce(u.mention, (SELECT arg_max(h.mention, h.turn) FROM said h
        WHERE h.conv_id = u.conv_id AND h.turn BETWEEN u.turn - 6 AND u.turn - 1
          AND h.mention IS NOT NULL)) AS repo_name
    FROM said u WHERE role = 'user'),
briefs AS ({REPO_BRIEF}),
routed AS (
    SELECT turns.*, b.*, CASE WHEN sort = 'knowledge' AND repo_name IS NOT NULL THEN 'repo' ELSE sort END AS intent,
        CASE WHEN sort <> 'knowledge' OR sort IS NULL THEN ''
             WHEN b.repo_full_name IS NULL THEN 'market-brief' ELSE 'market-brief,repo-brief' END AS tools_used
    FROM turns LEFT JOIN briefs b ON sort = 'knowledge' AND lower(repo_name) = lower(b.repo_full_name)),
lines AS (
    {_lines(1, "breakout", "breakouts", _BREAKOUT_ORDER, 5, "repo_full_name", "star_count_in_window",
            "total_events_in_window", "unique_actors_in_window")}
    UNION ALL {_lines(2, "category", "categories", _CATEGORY_ORDER, 4, "category", "active_repo_count",
                      "total_stars_in_window", "leader_repo_name")}
    UNION ALL {_lines(3, "topic", "topics", _TOPIC_ORDER, 5, "topic", "star_count_in_window", "repo_count")}),
evidence AS (
    SELECT conv_id, turn, intent, tools_used, l.* FROM routed JOIN lines l ON sort = 'knowledge' AND CASE l.section
        WHEN 1 THEN NOT wants_categories AND NOT wants_topics
        WHEN 2 THEN wants_categories OR NOT wants_topics ELSE wants_topics OR NOT wants_categories END
    UNION ALL
    SELECT conv_id, turn, intent, tools_used, 5, 1, repo_full_name,
        {_sql_format(EVIDENCE_TEXTS["repo"][0], "trend_verdict", "star_count_in_window", "total_events_in_window",
                     "unique_actors_in_window")}, '{EVIDENCE_TEXTS["repo"][1]}'
    FROM routed WHERE repo_full_name IS NOT NULL
    UNION ALL
    SELECT conv_id, turn, intent, tools_used, 5, 2, 'why_trending', why_trending, '{EVIDENCE_TEXTS["repo"][1]}'
    FROM routed WHERE repo_full_name IS NOT NULL),
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY section, place) AS n FROM evidence
    QUALIFY n <= 12)
"""
QUESTIONS = CONTEXT + BREAKOUTS.replace(", m AS (", ", m1 AS (", 1).replace("JOIN m USING", "JOIN m1 USING") + CATEGORIES + TOPICS + _ASKED


def _answers(t: Testbed) -> DataFrame:
    market = mk.market_brief_context(t.metadata(), t.events(), AS_OF)
    briefs = ins.repo_brief(ins.repo_brief_context(t.metadata(), t.events(), AS_OF), AS_OF)
    return qs.answer_questions(_asked(t), *market, briefs)


@check(
    "question_evidence",
    QUESTIONS
    + """SELECT conv_id, turn, intent, tools_used, CAST(section AS BIGINT) AS section, CAST(place AS BIGINT) AS place,
            label, value, source FROM kept""",
)
def question_evidence(t: Testbed) -> DataFrame:
    return qs.question_evidence(_answers(t))


@check(
    "answer_template",
    QUESTIONS
    + f"""SELECT p.conv_id, p.turn, p.intent, tools_used,
      CASE WHEN p.intent = 'instant' THEN '{ANSWER_TEXTS["instant"]}'
           WHEN repo_full_name IS NOT NULL THEN {_sql_format(ANSWER_TEXTS["repo_verdict"], "repo_full_name", "trend_verdict")}
             || chr(10) || summary || chr(10)
             || {_sql_format(ANSWER_TEXTS["repo_window"], "window_days", "star_count_in_window",
                             "total_events_in_window", "unique_actors_in_window")}
             || chr(10) || {_sql_format(ANSWER_TEXTS["repo_reason"], "why_trending")}
           WHEN sort = 'knowledge' AND wants_topics THEN '{ANSWER_TEXTS["topics_title"]}' || (
             SELECT string_agg(chr(10) || {_sql_format(ANSWER_TEXTS["topics_line"], "n", "topic", "star_count_in_window", "repo_count")}, '' ORDER BY n)
             FROM (SELECT *, row_number() OVER (ORDER BY {_TOPIC_ORDER}) AS n FROM topics) WHERE n <= 6)
           WHEN sort = 'knowledge' AND wants_categories THEN '{ANSWER_TEXTS["categories_title"]}' || (
             SELECT string_agg(chr(10) || {_sql_format(ANSWER_TEXTS["categories_line"], "n", "category", "active_repo_count",
                                                       "total_stars_in_window", "leader_repo_name")}, '' ORDER BY n)
             FROM (SELECT *, row_number() OVER (ORDER BY {_CATEGORY_ORDER}) AS n FROM categories) WHERE n <= 5)
           WHEN sort = 'knowledge' THEN '{ANSWER_TEXTS["evidence_title"]}' || chr(10) || shown END AS answer,
      CASE p.intent WHEN 'repo' THEN array_to_string([{", ".join(_sql_format(one, "repo_name") for one in FOLLOW_UPS["repo"])}], ',')
           WHEN 'search' THEN array_to_string({_sql_list(FOLLOW_UPS["search"])}, ',')
           WHEN 'knowledge' THEN array_to_string({_sql_list(FOLLOW_UPS["knowledge"])}, ',')
           WHEN 'instant' THEN array_to_string({_sql_list(FOLLOW_UPS["instant"])}, ',') END AS follow_up_questions
    FROM routed p LEFT JOIN (
      SELECT conv_id, turn, string_agg({_sql_format(ANSWER_TEXTS["evidence_line"], "label", "value", "source")}, chr(10) ORDER BY n) AS shown
      FROM kept WHERE n <= 8 GROUP BY ALL) k USING (conv_id, turn)""",
)
def answer_template(t: Testbed) -> DataFrame:
    """An answer for every user turn."""
    return _answers(t).drop("repo_name", "evidence")
