import numpy as np
from pyspark.sql import functions as F

from starwake.llm import ann


def table(spark, rows):
    schema = "vec_id bigint, embedding array<float>, score string, rank string, query_id string"
    return spark.createDataFrame([(*row, "x", "x", "x") for row in rows], schema)


def brute(rows, k=20):
    usable = {}
    for name, vector in rows:
        if name is None or vector is None or any(one is None for one in vector):
            continue
        data = np.array(vector, dtype=np.float32).astype(np.float64)
        if len(data) == 16 and np.isfinite(data).all() and data.any():
            usable[name] = data
    out = {}
    for query in usable:
        if query % 20 == 0:
            scored = [(-sum(usable[query] * other), name) for name, other in usable.items() if name != query]
            out[query] = [(name, -score) for score, name in sorted(scored)][:k]
    return out


def search(spark, rows, **options):
    found = ann.search(table(spark, rows), F.col("vec_id") % 20 == 0, **options).collect()
    out = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    rows = [(at, one.tolist()) for at, one in enumerate(data)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15)]
    rows += [(2080, [float("inf")] * 16), (2100, [1.0, 2.0]), (2120, []), (None, [1.0] * 16)]
    rows += [(3000 + at, rows[40][1]) for at in range(60)] + [(7, rows[7][1])]
    expected, got = brute(rows), search(spark, rows)
    assert set(got) <= set(expected) and len(got) == len(expected)
    hits = sum(len({n for n, _ in expected[q]} & {n for n, _ in got[q]}) for q in expected)
    assert hits / sum(map(len, expected.values())) >= 0.9
    for query, found in got.items():
        assert [name for name, _ in sorted(found, key=lambda one: (-one[1], one[0]))] == [n for n, _ in found]
        assert query not in [name for name, _ in found]
    assert [name for name, _ in got[40]][:19] == list(range(3000, 3019))


def test_vectors_of_several_sizes(spark):
    rng = np.random.default_rng(9)
    rows = [(at, rng.standard_normal((3, 16, 5)[at % 3]).tolist()) for at in range(240)] + [(300, [2.0]), (301, [1.0])]
    got = search(spark, rows)
    data = {name: np.array(vector, dtype=np.float32).astype(np.float64) for name, vector in rows}
    for query in [name for name in data if name % 20 == 0]:
        others = [name for name in data if name != query and len(data[name]) == len(data[query])]
        best = sorted(others, key=lambda name: (-data[query] @ data[name], name))[:20]
        found = [name for name, _ in got.get(query, [])]
        assert len(found) == len(best) and len(set(found) & set(best)) >= 0.8 * len(best)


def test_fewer_than_a_thousand_vectors_are_hashed(spark):
    rng = np.random.default_rng(2)
    rows = [(at, one.tolist()) for at, one in enumerate(rng.standard_normal((700, 16)))]
    expected, got = brute(rows), search(spark, rows)
    hits = sum(len({n for n, _ in expected[q]} & {n for n, _ in got[q]}) for q in expected)
    assert 0.9 <= hits / sum(map(len, expected.values())) < 1  # not a scan


def share(data, k=20):
    """Share of the vectors that a query visits with the functions and probes that are chosen."""
    hashes, probes = ann.chosen(data[: ann.SAMPLE_ROWS], len(data), k, ann.TABLES, ann.WIDTH)
    norm = np.sqrt((data**2).sum(axis=1)).max()
    hashing = ann.Hashing(data.shape[1], norm, ann.TABLES, hashes, ann.WIDTH, probes)
    held, visits = hashing.buckets(data), hashing.probes(data[:50])
    seen = [np.isin(held[:, t], visits[at, t]) for at in range(50) for t in range(ann.TABLES)]
    return np.mean([np.any(seen[at * ann.TABLES : (at + 1) * ann.TABLES], axis=0).mean() for at in range(50)])


def clustered(count, clusters):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((clusters, 64))
    data = centres[rng.integers(0, clusters, count)] + 0.25 * rng.standard_normal((count, 64))
    return data / np.linalg.norm(data, axis=1)[:, None]


def test_share_visited_falls_on_clustered_data():
    shares = [share(clustered(count, count // 40)) for count in (2_000, 16_000)]
    assert shares[1] < shares[0] < 0.5, shares


def test_few_rows(spark):
    rows = [(20, [1.0] * 16), (21, [0.5] * 16), (22, [1.0] * 16)]
    assert [name for name, _ in search(spark, rows)[20]] == [22, 21]
    assert search(spark, [(20, [1.0] * 16)]) == {}
    assert search(spark, []) == {}


def test_probes_are_different_and_in_order():
    sets = ann.probe_sets(6, 200)
    assert len({tuple(row) for row in sets}) == len(sets) == 200
    assert not sets[0].any() and sets[1].tolist()[0] == 1
    assert not (sets[:, :6] & sets[:, :5:-1]).any()


def spread_norms(factors):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((6000, 64))
    data *= (np.resize(factors, len(data)) / np.linalg.norm(data, axis=1))[:, None]
    return data.astype(np.float32).astype(np.float64)


def recall(spark, data):
    got = search(spark, [(at, one.tolist()) for at, one in enumerate(data)])
    scores = data[::20] @ data.T
    scores[np.arange(len(scores)), np.arange(0, len(data), 20)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert all(len(got[20 * at]) == 20 for at in range(len(best)))
    return np.mean([len({n for n, _ in got[20 * at]} & set(one.tolist())) / 20 for at, one in enumerate(best)])


def test_recall_with_an_outlier(spark):
    data = spread_norms([1.0])
    data[777] *= 10
    assert recall(spark, data) >= 0.96


def test_recall_in_two_ranges_of_norms(spark):
    assert recall(spark, spread_norms([1.0, 1.0, 0.3])) >= 0.93


def test_queries_with_few_candidates_are_filled(spark):
    data = spread_norms([1.0])
    got = search(spark, [(at, one.tolist()) for at, one in enumerate(data)], tables=1, hashes=20, probes=1)
    assert len(got) == 300 and all(len(found) == 20 for found in got.values())
    assert got[0][0][1] == max(ann.inner_products(data[:1], data[1:])[0])
