import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starwake.llm import toxicity
from tests.llm.corpus import documents, low, words

BAD = ["vileword", "nastything", "horridname"]


def corpus(seed, count):
    """Every third document has one sentence with a bad word."""
    rng, rows, labels = random.Random(seed), [], []
    plain = words(11, 400)
    for doc in range(count):
        sentences = [" ".join(rng.choices(plain, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 6))]
        toxic = int(doc % 3 == 0)
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += f" {rng.choice(BAD)}{rng.choice(['', 'en', 'er'])}"
        rows.append((doc, ". ".join(sentences).capitalize() + "!"))
        labels.append((doc, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus(1, 900)
    extra = [(None, 1), (3, None), (7, 0), (99_999, 1)]
    table = spark.createDataFrame(labels + extra, "doc_id bigint, toxic int")
    return rows, dict(labels), toxicity.fit(documents(spark, rows), table)


def test_held_out_accuracy(spark, trained):
    rows, labels, model = trained
    got = toxicity.score_documents(documents(spark, rows), model)
    got = got.withColumn("held_out", toxicity.held_out()).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {doc for doc, _ in rows if zlib.crc32(str(doc).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.5) == labels[r.doc_id] for r in out]) > 0.97


def test_offending_sentences(spark, trained):
    _, _, model = trained
    text = "Été ici. Sö you are a Vileword! Nothing here.\nnastything"
    rows = [(1, text), (2, None), (3, ""), (4, "?!. \n"), (1, text), (5, "fine words here. " * 40_000)]
    got = toxicity.score_documents(documents(spark, rows), model).collect()
    assert len(got) == len(rows)
    found = [text[s.start : s.end] for s in got[0].sentences]
    assert found == ["Sö you are a Vileword", "nastything"]
    assert got[0].score == got[4].score > 0.5
    assert [r.score for r in got[1:4]] == [0.0] * 3 and 0 <= got[5].score <= 1
    kept = toxicity.drop_toxic(documents(spark, rows), model)
    assert kept.columns == documents(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} >= {2, 3, 4}


def test_score_is_the_noisy_or(spark, trained):
    _, _, model = trained
    parts = ["you vileword", "nice day", "nastything again"]
    rows = [(at, part) for at, part in enumerate(parts)] + [(9, ". ".join(parts))]
    got = {r.doc_id: r.score for r in toxicity.score_documents(documents(spark, rows), model).collect()}
    assert got[9] == pytest.approx(1 - np.prod([1 - got[at] for at in range(3)]), rel=1e-6)


MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def hashed(word):
    """Sum of the bytes' codes times powers of the base."""
    return sum(mix((byte + 1) * BASE & MASK) * pow(BASE, at, 1 << 64) for at, byte in enumerate(word)) & MASK


def brute(text, weights, bias):
    """Score and spans, sentence by sentence and word by word."""
    data = (text or "").encode()
    score, spans, sentence = 1.0, [], []

    def close():
        nonlocal score
        if sentence:
            logit = bias
            for start, end in sentence:
                word = low(data[start:end].decode()).encode()
                logit += float(weights[mix((hashed(word) + len(word)) & MASK) >> 46])
                for size in (5, 6):
                    if len(word) > size:
                        logit += float(weights[mix(hashed(word[:size]) ^ size << 56) >> 46])
            chance = 1 / (1 + math.exp(-logit))
            score *= 1 - chance
            if chance >= 0.5:
                edges = [len(data[:at].decode(errors="replace")) for at in (sentence[0][0], sentence[-1][1])]
                spans.append((*edges, chance))
            sentence.clear()

    at = 0
    while at < len(data):
        if data[at] >= 128 or chr(data[at]).isalnum():
            end = at
            while end < len(data) and (data[end] >= 128 or chr(data[end]).isalnum()):
                end += 1
            sentence.append((at, end))
            at = end
        else:
            if chr(data[at]) in ".!?\n":
                close()
            at += 1
    close()
    return 1 - score, spans


def test_scores_and_spans_like_plain_python(spark):
    """A model with large random weights, so that every word tells."""
    rng = random.Random(4)
    weights = np.random.default_rng(4).normal(0, 1.5, 1 << toxicity.BITS).astype(np.float32)
    weights[0] = 0
    model = toxicity.ToxicityModel(weights, -3.0)
    parts = ["Été", "vile", "Ärger", "longerword", "abcdef", "abcde", "日本", "😀x", "a1", "-", ", ", ". ", "!", "?\n", "\n", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = list(enumerate([*texts, None, "", "...", " \n"]))
    for r in toxicity.score_documents(documents(spark, rows), model).collect():
        score, spans = brute(rows[r.doc_id][1], weights, -3.0)
        assert r.score == pytest.approx(score, rel=1e-6, abs=1e-9)
        assert [(s.start, s.end) for s in r.sentences] == [(a, b) for a, b, _ in spans]
        assert [s.score for s in r.sentences] == pytest.approx([c for _, _, c in spans], rel=1e-6)


def test_many_offending_sentences_in_one_text(spark):
    weights = np.full(1 << toxicity.BITS, 3.0, dtype=np.float32)
    text = "é vile. " * 120_000
    begun = time.perf_counter()
    row = toxicity.score_documents(documents(spark, [(1, text)]), toxicity.ToxicityModel(weights, -1.0)).collect()[0]
    assert time.perf_counter() - begun < 15
    assert len(row.sentences) == 120_000 and (row.sentences[-1].start, row.sentences[-1].end) == (959_992, 959_998)


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(spark, [(1, "text")]), none)
    assert toxicity.score_documents(documents(spark, [(1, "text")]), model).collect()[0].score < 0.01
    assert toxicity.score_documents(documents(spark, []), model).count() == 0


def test_same_sample_same_model(spark):
    rows, labels = corpus(2, 200)
    models = []
    for parts in (1, 5):
        table = spark.createDataFrame(labels, "doc_id bigint, toxic int").repartition(parts)
        models.append(toxicity.fit(documents(spark, rows).repartition(parts + 1), table, rounds=10))
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias


def test_a_giant_document_does_not_end_the_sample(spark):
    rows, labels = corpus(3, 900)
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    learned = table.where(~toxicity.held_out())
    first = learned.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    rows[first] = (first, f"{rows[first][1]} " * 3_000)
    model = toxicity.fit(documents(spark, rows), table, max_words=30_000)
    got = toxicity.score_documents(documents(spark, rows), model).where(toxicity.held_out()).collect()
    assert np.mean([(r.score >= 0.5) == dict(labels)[r.doc_id] for r in got]) > 0.97


def test_sentences_of_a_long_document():
    length = np.array([3, 50, 4, 5, 6, 2] * 50)
    taken = toxicity._spread(length, 40)
    assert 30 <= length[taken].sum() <= 40 and np.flatnonzero(taken).max() > 100
    assert toxicity._spread(length, 10_000).all()
    assert not toxicity._spread(np.array([41]), 40).any()
