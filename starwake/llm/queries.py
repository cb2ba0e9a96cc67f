"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from starwake.llm import (
    ann,
    clustering,
    decontaminate,
    fill_middle,
    html_text,
    jaccard,
    licenses,
    lines,
    mixing,
    secrets,
    token_files,
    toxicity,
    urls,
)
from starwake.llm.tables import table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_common_lines(table(spark, folder, "documents"))
    return kept.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE_SQL["op3_line_dedup"] = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, {BLANKS}), {UPPER}, lower({UPPER})) AS key FROM numbered),
common AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT k.doc_id, k.pos, k.line, c.last IS NOT NULL AND c.last <> k.doc_id AS gone
    FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op7_source_mix"] = """
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM documents),
summed AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
numbered AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM summed),
weighed AS (
    SELECT *, [5, 2, 1][(no - 1) % 3 + 1] AS weight FROM numbered),
ratios AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM weighed),
levels AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
            ORDER BY ratio, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(weight) OVER (ORDER BY ratio, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM ratios),
targets AS (
    SELECT source, no, source_size, least(CAST(3 * source_size AS DOUBLE),
        max(level) FILTER (level <= ratio) OVER () * weight) AS target
    FROM levels),
queued AS (
    SELECT doc_id, size, source_size, target, no, sum(size) OVER (
        PARTITION BY no ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
copies AS (
    SELECT doc_id, size, CAST(copy * source_size + served AS DOUBLE) / target AS finish
    FROM queued, (VALUES (0), (1), (2)) AS c(copy) WHERE target > 0),
times AS (SELECT finish, sum(size) AS size FROM copies GROUP BY finish),
running AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS until FROM times),
cut AS (
    SELECT max(finish) AS finish FROM running WHERE until <= (SELECT sum(size) FROM sized)),
counted AS (
    SELECT doc_id, count(*) AS n FROM copies, cut WHERE copies.finish <= cut.finish GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
    CAST(coalesce(n, 0) * q.size AS BIGINT) AS taken
FROM queued q LEFT JOIN counted c ON q.doc_id = c.doc_id
"""


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    worst = F.array_max(F.transform("sentences", lambda s: F.struct(s["score"], -s["start"])))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("sentences").alias("n_offending"),
        (-worst["col2"]).alias("worst_start"),
    )


@query
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.drop("places", "expressions")


@query
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


@query
def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages"))


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    digest = token_files.token_digest(docs, vocabulary("word_bpe_49k.json"))
    return digest.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.find_leaks(docs, items).drop("_tag")


@query
def op1_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"))


@query
def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = clustering.cluster_vectors(table(spark, folder, "embeddings"))
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2("centroid", 256).alias("centroid_sha256"),
    )


def _clustering_sql(rounds: int = 3, count: int = 16) -> str:
    """The rounds of the clustering, one after the other."""
    apart = "CAST(list_sum(list_transform(list_zip(v.row, c.row), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT)"
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS nth,
        list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS row
    FROM embeddings
    WHERE len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS no, row
    FROM kept QUALIFY no < {count})"""
    ]
    for at in range(rounds + 1):
        steps.append(
            f"""a{at} AS MATERIALIZED (
    SELECT nth, arg_min(no, (far, no)) AS no, min(far) AS far
    FROM (SELECT v.nth, c.no, {apart} AS far FROM kept v, c{at} c) GROUP BY nth)"""
        )
        if at < rounds:
            steps.append(
                f"""m{at} AS MATERIALIZED (
    SELECT no, list(mean ORDER BY pos) AS row
    FROM (
        SELECT no, pos, CAST((total - ((total % n) + n) % n) // n AS HUGEINT) AS mean
        FROM (
            SELECT no, pos, CAST(sum(x) AS HUGEINT) AS total, CAST(count(*) AS HUGEINT) AS n
            FROM (SELECT no, unnest(row) AS x, generate_subscripts(row, 1) AS pos
                FROM kept JOIN a{at} USING (nth))
            GROUP BY no, pos))
    GROUP BY no),
c{at + 1} AS MATERIALIZED (
    SELECT c.no, coalesce(m.row, c.row) AS row FROM c{at} c LEFT JOIN m{at} m ON c.no = m.no)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.no AS INTEGER) AS "cluster", CAST(far AS BIGINT) AS distance,
    CAST(sum(far) OVER (PARTITION BY a.no) AS BIGINT) AS cluster_inertia,
    CAST(sum(far) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.row, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} a USING (nth) JOIN c{rounds} c ON a.no = c.no
"""


ORACLE_SQL["op11_centroid_clusters"] = _clustering_sql()


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    restored = fill_middle.restored_text(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )


_DRAWN = ", ".join(
    f"CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {1 + 8 * at}, 8) AS BIGINT) AS h{at + 1}"
    for at in range(4)
)

ORACLE_SQL["op12_fill_in_middle"] = f"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, {_DRAWN},
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
    FROM documents),
ranked AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parted AS (
    SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix,
        coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
        coalesce(array_to_string(units[high + 1:], ''), '') AS suffix
    FROM ranked)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parted
"""

#: Host, path and verdict of the rules that the query applies (fixed values).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urls.judge_urls(pages, urls.build_index(rules))
    return judged.select(
        F.col("c0").alias("page_id"),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )


_RULES_SQL = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)

ORACLE_SQL["op13_url_filter"] = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES_SQL}),
parted AS (
    SELECT row_number() OVER () AS nth, page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {UPPER}, lower({UPPER})) AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages),
fitting AS (
    SELECT nth, arg_max(rule_host || rule_path, (length(rule_host || rule_path), length(rule_host))) AS rule,
        arg_max(rule_verdict, (length(rule_host || rule_path), length(rule_host))) AS verdict
    FROM parted JOIN rules ON starts_with(path, rule_path)
        AND (host = rule_host OR ends_with(host, '.' || rule_host))
    GROUP BY nth)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parted LEFT JOIN fitting USING (nth)
"""


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
