import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from starwake.llm import decontaminate, jaccard, queries, toxicity
from tests.llm.corpus import blank_words, words
from tests.llm.test_decontaminate import brute as leaked
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import brute_targets
from tests.llm.test_token_files import expected as tokens
from tests.llm.test_token_files import tag
from tests.llm.test_toxicity import BAD
from tests.llm.test_toxicity import brute as noisy_or

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "similar documents", "benchmark leaks", "source mix", "token files",
    ]
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, FOLDER)
        assert out.columns == docs.columns
        kept = out.checkpoint()
        if name == "similar documents":
            found = jaccard.similar_documents(kept)
            assert found.where("doc_id <> component_id").count() == 0
        if name == "benchmark leaks":
            assert decontaminate.find_leaks(kept, items).count() == 0
    assert kept.count() > 0


def test_every_query_is_registered():
    names = list(queries.QUERIES)
    assert [name for n in range(1, 14) if len(got := [x for x in names if x.startswith(f"op{n}_")]) != 1 for name in got] == []
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)


def rough_documents():
    """Small documents with toxic ones, copies, leaks, several sources, nulls and repeated rows."""
    rng, plain = random.Random(21), words(50, 300)

    def prose(count):
        return ". ".join(" ".join(rng.choices(plain, k=rng.randint(4, 9))) for _ in range(count))

    items = [(at, " ".join(words(900 + at, 14))) for at in range(4)]
    rows, labels = [], []
    for doc in range(420):
        text, source = prose(rng.randint(1, 6)), rng.choice(["a", "a", "a", "b", "b", "c", None])
        toxic = doc % 6 == 0
        if toxic:
            text += f" {rng.choice(BAD)} and more"
        elif doc % 11 == 0:
            text = f"{text} {items[doc % 4][1]} {prose(1)}"
        rows.append((doc, text, "en", source, len(text)))
        labels.append((doc, int(toxic)))
    for doc in range(420, 470):  # copies, some with a word more
        text = f"{rows[rng.randrange(3, 60)][1]}{rng.choice(['', '', ' more'])}"
        rows.append((doc, text, "en", "b", len(text)))
    rows += [(470, None, None, None, None), (471, "", "", "", 0), (472, " \n", "de", "c", 2), rows[3], (5, rows[7][1], "en", "a", 1)]
    return rows, labels, items


def mixed(rows):
    """Weighted fair queueing, one copy after the other."""
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(blank_words(row[1]))
    target = brute_targets(sizes)
    copies = []
    for source in sizes:
        served = 0
        queue = sorted(
            (row for row in rows if row[3] == source),
            key=lambda row: (hashlib.md5(str(row[0]).encode()).hexdigest(), row[0], len(blank_words(row[1])), tag(row[1])),
        )
        if target[source] <= 0:
            continue
        for row in queue:
            served += len(blank_words(row[1]))
            copies += [(float(copy * sizes[source] + served) / target[source], row) for copy in range(3)]
    times = defaultdict(int)
    for finish, row in copies:
        times[finish] += len(blank_words(row[1]))
    total, cut = 0, -1.0
    for finish in sorted(times):
        total += times[finish]
        if total > sum(sizes.values()):
            break
        cut = finish
    return [row for finish, row in copies if finish <= cut]


def test_run_like_plain_python(spark, tmp_path):
    rows, labels, items = rough_documents()
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [tuple(row) for row in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    # The model is the operator's own; everything that follows from it is worked out here.
    model = toxicity.fit(spark.read.parquet(str(tmp_path / "documents.parquet")),
                         spark.read.parquet(str(tmp_path / "labels.parquet")))
    clean = [row for row in rows if noisy_or(row[1], model.weights, model.bias)[0] < 0.5]
    assert {row[0] for row in rows} - {row[0] for row in clean} == {doc for doc, label in labels if label} | (
        {row[0] for row in rows if row[0] >= 420 and any(bad in (row[1] or "") for bad in BAD)}
    )
    component = components([(row[0], row[1]) for row in clean])
    single = [row for row in clean if component[row[0]] == row[0]]
    leaks = {doc for doc, _ in leaked([(row[0], row[1]) for row in single], items)}
    kept = [row for row in single if row[0] not in leaks]
    assert len(rows) > len(clean) > len(single) > len(kept) > 100
    taken = mixed(kept)
    assert len(taken) != len(kept)
    expected = tokens([(row[0], row[1]) for row in taken])
    assert sorted(got, key=lambda row: row[2]) == expected
    assert Counter(row[0] for row in got) == Counter(row[0] for row in taken)
