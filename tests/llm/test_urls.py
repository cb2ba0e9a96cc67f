import random
import time

import pytest
from pyspark.sql import functions as F

from starwake.llm.queries import URL_RULES
from starwake.llm.urls import build_index, judge_urls
from tests.llm.corpus import low

RULES = "host string, path string, verdict string, _key string"


def rules(spark, rows):
    return spark.createDataFrame([(*row, "x") for row in rows], RULES)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((at for at, c in enumerate(rest) if c in "/?#"), len(rest))
    stop = next((at for at, c in enumerate(rest) if at >= end and c in "?#"), len(rest))
    return low(rest[:end]), rest[end:stop]


def brute(url, listed):
    host, path = split(url)
    fitting = {}
    for rule_host, rule_path, verdict in listed:
        rule_host, rule_path = rule_host and low(rule_host), rule_path or ""
        if not rule_host or verdict not in ("allow", "block"):
            continue
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            key = (len(rule_host + rule_path), len(rule_host))
            if key not in fitting or verdict == "block":
                fitting[key] = rule_host + rule_path, verdict
    rule, verdict = fitting[max(fitting)] if fitting else (None, "allow")
    return url, host, path, rule, verdict


def judged(spark, urls, listed, **options):
    pages = spark.createDataFrame([(one, "x", "x") for one in urls], "url string, _host string, verdict string")
    found = judge_urls(pages, build_index(rules(spark, listed), **options))
    return [tuple(row) for row in found.select("c0", "_host", "_path", "_rule", "_verdict").collect()]


URLS = [
    None, "", "no scheme", "example.org/es/", "://", "http://", "HTTP://WWW.Example.ORG/es/a?b#c", "https://example.org",
    "https://example.org/en/1", "https://example.org/en/12/x", "https://badexample.org/en/1", "x://org/", "x://ORG/a",
    "x://org.com/fr/", "x://.com/de/", "x://com./fr/", "x://a.com/FR/", "x://a.com/fr", "x://a.com?/fr/", "x://a.com/de/\nx",
    "a://b://example.org/es/", "x://üÄ.com/de/é", "x://user@h.com:80/de/", "x://..org/", "x://example.org/es/?u=x://a.com/fr/",
]


def test_the_registered_rules(spark):
    assert judged(spark, URLS * 2, URL_RULES) == [brute(one, URL_RULES) for one in URLS * 2]


@pytest.mark.parametrize("bits", [64, 9, 1])
def test_many_rules_over_shards_with_collisions(spark, bits):
    rng = random.Random(6)
    hosts = [".".join(rng.choices(["a", "bb", "c", "dé", "E"], k=rng.randint(1, 4))) for _ in range(300)]
    paths = ["", "/", "/x", "/x/", "/é", "/xy", None, "/x/y/z", "?", "x"]
    listed = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(900)]
    listed += [(None, "/", "block"), ("", "/", "block"), ("bb", "/", None), ("c", "/", "maybe")]
    urls = [f"h://{rng.choice(['', 'w.', 'w.a.'])}{rng.choice(hosts)}{rng.choice(paths) or ''}{rng.choice(['', 'q', '/y/z'])}" for _ in range(600)]
    got = judged(spark, urls, listed, bits=bits, shard_rules=100)
    assert got == [brute(one, listed) for one in urls]


def test_without_rules_or_urls(spark):
    assert judged(spark, URLS, []) == [brute(one, []) for one in URLS]
    assert judged(spark, [], URL_RULES) == []


def test_very_long_urls_in_linear_time(spark):
    urls = ["x://" + "a." * 300_000 + "example.org/en/1", "x://example.org/es/" + "p" * 1_000_000, "x" * 1_000_000,
            "x://" + "." * 500_000 + "com/de/"]
    listed = [*URL_RULES, *[("org", "/" + "p" * at, "block") for at in range(40)]]
    begun = time.perf_counter()
    assert judged(spark, urls, listed) == [brute(one, listed) for one in urls]
    assert time.perf_counter() - begun < 20


def test_columns_of_the_table_stay(spark):
    pages = spark.range(3).withColumns({"url": F.lit("x://org/"), "_rule": F.lit("own"), "host": F.lit(1)})
    found = judge_urls(pages, build_index(rules(spark, URL_RULES)))
    assert [tuple(row) for row in found.select("c0", "c2", "c3", "_rule").collect()] == [
        (at, "own", 1, "org/") for at in range(3)
    ]
