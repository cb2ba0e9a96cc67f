import random
from itertools import combinations

import numpy as np

from starwake.llm import jaccard
from starwake.llm.jaccard import keep_one, similar_documents
from starwake.session import shared_dir
from starwake.sources.files import child_names
from tests.llm.corpus import blank_words, documents, words


def shingles(text):
    found = blank_words(text)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[at : at + 5]) for at in range(len(found) - 4)}


def brute(rows):
    """component_id by id; rows that share an id are one node."""
    sets = [(doc, shingles(text)) for doc, text in rows if doc is not None]
    leader = {doc: doc for doc, _ in sets}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        both = len(x & y)
        if both and 100 * both >= 80 * len(x | y) and find(a) != find(b):
            leader[max(find(a), find(b))] = min(find(a), find(b))
    return {doc: find(doc) for doc in leader}


def check(spark, rows):
    expected = brute(rows)
    got = similar_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {(doc, len(shingles(text))) for doc, text in rows}
    for r in got:
        assert (r.doc_id, r.n_shingles) in sizes
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id]), r
    return expected


def edited(base, rng, changes):
    out = list(base)
    for _ in range(changes):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = f"x{rng.randrange(40)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"y{rng.randrange(40)}")
    return " ".join(out)


def test_groups_of_near_copies(spark):
    """Edits drawn from few words, so that copies also share what the smallest of them lacks."""
    rng = random.Random(5)
    rows = []
    for group in range(6):
        base = words(group, rng.choice([12, 60, 150]))
        rows += [(1000 * group + at, edited(base, rng, rng.randrange(7))) for at in range(40)]
    passage = " ".join(words(99, 60))
    rows += [(90_000 + at, f"{' '.join(words(500 + at, 80))} {passage}") for at in range(60)]
    expected = check(spark, rows)
    assert 20 < len(set(expected.values())) < len(expected)


def test_chain_without_a_link_to_the_smallest(spark):
    base = words(7, 300)
    rows = [(at, " ".join(base[5 * at : 200 + 5 * at])) for at in range(12)]
    expected = check(spark, rows)
    assert set(expected.values()) == {0}


def test_edge_cases(spark):
    long = " ".join(words(3, 30_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one\ttwo"), (6, "one two three four five"),
        (7, "ONE two three four five"), (8, long), (9, long + " more"), (None, long), (None, None),
        (10, "É b c d e f"), (11, "é b c d e f"), (12, "a b c d e f g"), (13, "a b c d e f g"),
        (14, long), (14, long), (4, "One two"), (20, "a b a b a b a b"), (21, "a b a b a b"),
    ]
    check(spark, rows)


def test_same_id_with_two_texts(spark):
    a, b = " ".join(words(1, 40)), " ".join(words(2, 40))
    check(spark, [(5, a), (5, b), (3, a), (2, b)])


def test_same_id_with_two_texts_that_have_near_copies(spark):
    a, b = words(1, 60), words(2, 60)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "more"])), (8, " ".join([*b, "more"]))]
    assert set(check(spark, rows).values()) == {5}
    check(spark, [*rows, (2, " ".join([*b, "more", "still"])), (5, " ".join(a)), (8, " ".join(a[:58]))])


def test_copies_around_several_texts_with_a_common_part(spark):
    """Groups whose members share half of their words with members of other groups, and single texts
    that share much with all copies of a group but link with few of them."""
    rng = random.Random(8)
    common, rows = words(400, 70), []
    for group in range(5):
        base = [*common, *words(410 + group, 75)]
        rows += [(100 * group + at, edited(base, rng, rng.randrange(4))) for at in range(25)]
        rows += [(100 * group + 50 + at, edited(base, rng, rng.randrange(4, 9))) for at in range(15)]
    expected = check(spark, rows)
    assert 5 < len(set(expected.values())) < 150


def test_stored_tables_go(spark):
    folder = f"{shared_dir(spark)}/starwake"
    before = len(child_names(spark, folder))
    similar_documents(documents(spark, [(1, " ".join(words(1, 30))), (2, " ".join(words(1, 29)))])).collect()
    assert len(child_names(spark, folder)) == before + 2  # the two that the result reads


def test_empty(spark):
    assert similar_documents(documents(spark, [])).count() == 0
    assert similar_documents(documents(spark, [(1, None)])).collect()[0].component_id == 1


def test_one_stays(spark):
    text = " ".join(words(1, 40))
    docs = documents(spark, [(3, text), (2, text), (9, "other words"), (None, text), (7, None)])
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [
        (False, 2), (False, 7), (False, 9), (True, 0),
    ]


def test_texts_of_documents_without_copies_are_filtered_before_the_shuffle(spark, tmp_path, monkeypatch):
    """Also where the ids of the others are too many to be sent to every task."""
    plans, ordered = [], jaccard._ordered_sets

    def planned(texts, buckets):
        plans.append(texts._jdf.queryExecution().optimizedPlan().toString())
        return ordered(texts, buckets)

    monkeypatch.setattr(jaccard, "_ordered_sets", planned)
    base = [f"w{at}" for at in range(60)]
    rows = [(at, " ".join(f"{at}x{one}" for one in range(8))) for at in range(100)]
    rows += [(200, " ".join(base)), (201, " ".join([*base, "more"]))]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = similar_documents(spark.read.parquet(f"{tmp_path}/documents")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id: r.component_id for r in found} == {doc: 200 if doc == 201 else doc for doc, _ in rows}
    assert len(plans) == 1 and "might_contain" in plans[0]


def test_parts_of_one_token_are_small():
    rng = np.random.default_rng(3)
    runs = [(int(name), np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))) for name in rng.integers(0, 1 << 62, 50)]
    rows = list(jaccard._by_bucket(runs, 100_000, low_bits=True))
    sent = sum(len(value) for row in rows for name, value in row.items() if name != "_bucket")
    assert sent <= 13 * sum(len(tokens) for _, tokens in runs)


def test_parts_of_any_number_of_tokens_are_counted():
    runs = [(7, np.arange(1, 70_000, dtype=np.uint64)), (8, np.arange(2, 302, dtype=np.uint64)), (9, np.arange(5, 7, dtype=np.uint64))]
    for low_bits, kind in ((True, np.uint32), (False, np.uint64)):
        for chosen in (runs, runs[1:], runs[2:]):
            (row,) = jaccard._by_bucket(chosen, 1, low_bits)
            bucket = jaccard._Bucket(jaccard.pd.DataFrame([row]), kind)
            got = {int(name): sorted(bucket.tokens[bucket.owner == at].tolist()) for at, name in enumerate(bucket.names)}
            assert got == {name: tokens.tolist() for name, tokens in chosen}
