import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from starwake.llm.fill_middle import RankIndex, boundaries, fill_in_middle, rank_indexes, restored_text
from tests.llm.corpus import documents


def brute(name, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()
    h = [int(digest[8 * at : 8 * at + 8], 16) for at in range(4)]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return name, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(part) for part in (units[:low], units[low:high], units[high:]))
    if h[3] % 100 < 20:
        return name, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return name, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def run(spark, rows):
    made = fill_in_middle(documents(spark, rows)).drop("n_segments")
    made = made.withColumn("restored", restored_text(F.col("output"), F.col("form")))
    return [tuple(row) for row in made.collect()]


def texts(seed, count):
    rng = random.Random(seed)
    alphabet = ["a", "Zb", "é", "中", "😀", " ", "\n", "\r\n", "\0", "<", "<P", "S>", ">", "9", "x" * 300, "ı", "İ"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(count)]


def test_like_plain_python(spark):
    rows = list(enumerate(texts(1, 400)))
    rows += [(500, None), (501, ""), (502, " "), (None, "a null id"), (503, "holds <M> itself"), (504, "<S"), (505, "<")]
    rows += [(506, "the same row")] * 3
    got = run(spark, rows)
    assert [row[:6] for row in got] == [brute(name, text) for name, text in rows]
    assert [row[6] for row in got] == [text or "" for _, text in rows]
    assert {row[2] for row in got} == {"plain", "psm", "spm"}
    assert run(spark, []) == []


def long_texts():
    rng = random.Random(4)
    mixed = "".join("w" * rng.choice((1, 2, 5, 9, 4_000)) + rng.choice(" .\n") for _ in range(3_000))
    return [mixed, "a" * 2_000_000, " " * 2_000_000, "中" * 500_000, "ab " * 700_000, ("q" * 400 + ". " * 3) * 5_000]


def test_very_long_texts_in_linear_time(spark):
    rows = list(enumerate(long_texts(), start=11))
    begun = time.perf_counter()
    got = run(spark, rows)
    assert time.perf_counter() - begun < 30
    assert [row[:6] for row in got] == [brute(name, text) for name, text in rows]
    assert [row[6] for row in got] == [text for _, text in rows]


@pytest.mark.parametrize("error", [1, 7, 126])
def test_index_is_exact_and_its_lines_keep_the_error(error):
    for text in [*texts(2, 60), *long_texts()[:1], "ab " * 5_000]:
        data = text.encode()
        (bounds,) = boundaries([data])
        want = [0, *np.cumsum([len(unit.encode()) for unit in re.findall(r"[A-Za-z]+|[^A-Za-z]", text)]).tolist()]
        assert bounds.tolist() == want
        index = RankIndex.fit(bounds, error)
        assert [index.at(rank) for rank in range(len(want))] == want
        assert all(abs(index.predicted(rank) - at) <= error + 1 for rank, at in enumerate(want))
    assert len(RankIndex.fit(np.arange(100_000) * 3).rank) == 1


def test_stored_index(spark):
    rows = list(enumerate(texts(3, 50))) + [(60, None)]
    for row in rank_indexes(documents(spark, rows)).collect():
        bounds = next(boundaries([(dict(rows)[row.doc_id] or "").encode()]))
        parts = np.array([(s["rank"], s["offset"]) for s in row.segments], dtype=np.int64)
        slopes = np.array([s["slope"] for s in row.segments])
        index = RankIndex(parts[:, 0], parts[:, 1], slopes, np.frombuffer(row.residuals, dtype=np.int8))
        assert [index.at(rank) for rank in range(row.n + 1)] == bounds.tolist()
