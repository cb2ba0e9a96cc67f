import hashlib
from collections import Counter, defaultdict

from starwake.llm.mixing import mix_documents, mix_plan
from tests.llm.corpus import blank_words, documents


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[at % 3] for at, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in order if s not in stopped)
        over = [s for s in order if s not in stopped and left * weight[s] / share > 3 * sizes[s]]
        if not over:
            return {
                s: 3.0 * sizes[s] if s in stopped else left * weight[s] / share for s in order
            }
        stopped.update(over)


def test_shares_and_limits(spark):
    rows = [(at, "w " * (at % 50 + 1), "big" if at % 3 == 0 else f"s{at % 5}") for at in range(900)]
    rows += [(2000, "only one word"[:4], "tiny"), (2001, None, "void"), (2002, "a b", None), (None, "c d e", "big")]
    rows += [(3000, "twice the same row", "s1")] * 2
    got = mix_plan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for row in rows:
        sizes[row[2]] += len(blank_words(row[1]))
    expected = brute_targets(sizes)
    for r in got:
        assert abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert sum(taken.values()) <= sum(sizes.values())
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 51, (source, taken[source], target)
    again = mix_plan(documents(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_documents_come_as_often_as_planned(spark):
    rows = [(at, f"text of {at} " * (at % 7), f"s{at % 4}") for at in range(200)] + [(5, "twice", "s1")] * 2
    docs = documents(spark, rows)
    planned = Counter()
    for r in mix_plan(docs).collect():
        planned[r.doc_id, r.source] += r.copies
    got = mix_documents(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +planned


def test_order_is_shuffled_by_hash(spark):
    rows = [(at, "one two three four", "a" if at else "b") for at in range(40)]
    plan = {r.doc_id: r.copies for r in mix_plan(documents(spark, rows)).collect() if r.source == "a"}
    order = sorted(plan, key=lambda doc: hashlib.md5(str(doc).encode()).hexdigest())
    copies = [plan[doc] for doc in order]
    assert copies == sorted(copies, reverse=True)


def test_empty(spark):
    assert mix_plan(documents(spark, [])).count() == 0
    assert mix_documents(documents(spark, [])).count() == 0
    blank = mix_plan(documents(spark, [(1, None, None), (2, " \n", "s")])).collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
