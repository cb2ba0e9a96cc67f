import random
import re
from collections import Counter

from starwake.llm.decontaminate import drop_leaks, find_leaks
from tests.llm.corpus import documents, low, words


def found_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def shingles(found):
    width = min(5, len(found))
    return Counter(tuple(found[at : at + width]) for at in range(len(found) - width + 1)) if found else Counter()


def brute(rows, items):
    """The best window of every document and item, over all starts."""
    out = {}
    for doc, text in rows:
        own = found_words(text)
        for item, target in items:
            wanted = found_words(target)
            if not wanted or not own:
                continue
            for start in range(max(1, len(own) - len(wanted) + 1)):
                a, b = shingles(own[start : start + len(wanted)]), shingles(wanted)
                score = sum((a & b).values()) / sum((a | b).values())
                if score >= 0.8 and score > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (score, start)
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(at, " ".join(words(at, rng.randint(12, 60)))) for at in range(25)]
    items += [(50, "two words"), (51, "É"), (52, None), (53, ""), (54, "a b a b a b a b a b a b"), (55, items[0][1])]
    rows = [(1000, None), (1001, ""), (1002, "..."), (None, "before two words after"), (1003, "TWO, words!")]
    for at in range(120):
        text = words(1000 + at, rng.randint(0, 90))
        if at % 3 == 0:
            leak = items[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(3)):
                leak[rng.randrange(len(leak))] = "changed"
            if at % 4 == 0:
                leak = leak[: len(leak) - rng.randrange(4)]
            place = rng.randrange(len(text) + 1)
            text[place:place] = [word.capitalize() + "," for word in leak]
        rows.append((at, " ".join(text)))
    rows += [(2000, "é"), (2001, "x a b a b a b a b a b a b y"), (2002, " ".join(words(9000, 20_000)) + " " + items[3][1])]
    rows += [(2003, items[4][1])] * 2
    table = spark.createDataFrame([(*item, "x") for item in items], "item_id bigint, text string, start string")
    got = find_leaks(documents(spark, rows), table).collect()
    expected, texts, wanted = brute(rows, items), dict(rows), dict(items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == {k: v for k, (v, _) in expected.items()}
    for r in got:  # several starts can be equally good
        window = found_words(texts[r.doc_id])[r.start : r.start + r.n_words]
        a, b = shingles(window), shingles(found_words(wanted[r.item_id]))
        assert sum((a & b).values()) / sum((a | b).values()) == r.similarity
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    kept = drop_leaks(documents(spark, rows), table)
    leaked = {doc for doc, _ in brute(rows, items)}
    assert kept.columns == documents(spark, rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows if d not in leaked)


def test_similarity_just_at_the_limit(spark):
    rng, items, rows = random.Random(8), [], []
    for at in range(300):
        own = [f"w{one}" for one in rng.sample(range(10**6), 104)]
        items.append((at, " ".join(own)))
        rows.append((at, " ".join(own[:-11] + [f"c{one}" for one in rng.sample(range(10**6), 11)])))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(documents(spark, rows), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(at, at) for at in range(300)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "an item of a few words")], "item_id bigint, text string")
    assert find_leaks(documents(spark, [(1, "text")]), none).count() == 0
    assert find_leaks(documents(spark, []), some).count() == 0
    assert drop_leaks(documents(spark, [(1, "text")]), none).count() == 1
