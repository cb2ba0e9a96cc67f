import hashlib
import random

import numpy as np
import pytest

from starwake.llm import clustering
from starwake.llm.clustering import cluster_vectors

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="double"):
    schema = f"vec_id bigint, embedding array<{kind}>, cluster string, _id string, _planes string, distance string"
    return spark.createDataFrame([(*row, "x", "x", "x", "x") for row in rows], schema)


def exact_floor(x):
    top, bottom = float(x).as_integer_ratio()
    return 64 * top // bottom


def brute(rows, count=16, rounds=3):
    kept = []
    for name, vector in rows:
        if vector is None or len(vector) != 64 or any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept.append((name, [exact_floor(x) for x in vector]))

    def digest(name):
        return hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()

    centroids = [row for _, row in sorted(kept, key=lambda one: digest(one[0]))[:count]]

    def assigned():
        out = []
        for _, row in kept:
            far = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in centroids]
            out.append((min(far), far.index(min(far))))
        return out

    for _ in range(rounds):
        labels = [label for _, label in assigned()]
        for number in range(len(centroids)):
            mine = [row for (_, row), label in zip(kept, labels) if label == number]
            if mine:
                centroids[number] = [sum(column) // len(mine) for column in zip(*mine)]
    final = assigned()
    fits = lambda x: x if x < 1 << 63 else None
    out = []
    for (name, _), (far, label) in zip(kept, final):
        inside = [d for d, other in final if other == label]
        own = None if max(inside) >= 1 << 63 else fits(sum(inside))
        whole = None if max(d for d, _ in final) >= 1 << 63 else fits(sum(d for d, _ in final))
        out.append((name, label, fits(far), own, whole, ",".join(map(str, centroids[label]))))
    return sorted(out, key=repr)


def run(spark, rows, kind="double"):
    return sorted((tuple(row) for row in cluster_vectors(table(spark, rows, kind)).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.3, 40.0, 3e6])
def test_like_plain_arithmetic(spark, spread):
    rng = random.Random(7)
    centres = [[rng.uniform(-spread, spread) for _ in range(64)] for _ in range(5)]
    rows = [(at, [x + rng.gauss(0, spread / 9) for x in rng.choice(centres)]) for at in range(300)]
    rows += [(at, rows[3][1]) for at in range(400, 460)]  # a large group of equal vectors
    assert run(spark, rows) == brute(rows)


def test_rows_that_take_no_part_repeats_and_null_ids(spark):
    rng = random.Random(3)
    rows = [(at, [rng.uniform(-1, 1) for _ in range(64)]) for at in range(40)]
    rows += [rows[5], rows[5], (None, rows[7][1])]
    bad = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [0.5] * 63 + [None]),
           (105, [NAN] + [0.5] * 63), (106, [0.5] * 63 + [-INF])]
    assert run(spark, rows + bad) == brute(rows)
    zeros = [(at, [0.0] * 64) for at in range(20)]
    assert {row[1:5] for row in run(spark, zeros)} == {(0, 0, 0, 0)}  # ties go to centroid 0


def test_fewer_rows_than_centroids_and_none(spark):
    rows = [(at, [float(at)] * 64) for at in range(3)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] == run(spark, [(1, None), (2, [1.0])])
    assert cluster_vectors(table(spark, [])).columns[:3] == ["vec_id", "cluster", "distance"]


def test_components_of_any_size(spark):
    rng = random.Random(5)
    rows = [(at, [rng.uniform(-1, 1) for _ in range(64)]) for at in range(30)]
    rows += [(50, [1e19] * 64), (51, [-1e19] * 64), (52, [1e300, -1e300] * 32), (53, [1.7e308] * 64)]
    rows += [(54, [2.0**31] * 64), (55, [-(2.0**31)] * 64)]
    assert run(spark, rows) == brute(rows)


def test_floats_are_read_as_doubles(spark):
    rng = random.Random(9)
    rows = [(at, [float(np.float32(rng.uniform(-2, 2))) for _ in range(64)]) for at in range(50)]
    assert run(spark, rows, "float") == brute(rows)


def test_products_and_sums_of_planes():
    rng = np.random.default_rng(2)
    for bound, width in ((3, 8), (127, 8), (40_000, 24), (1 << 40, 48)):
        data = rng.integers(-bound, bound + 1, (20, 64))
        planes = clustering.to_planes(data, width)
        assert [clustering.from_planes(one) for one in planes] == data.tolist()
        whole = data.astype(object)
        assert (clustering.products(planes, planes) == whole @ whole.T).all()
        assert (clustering.own_products(planes) == (whole * whole).sum(axis=1)).all()
    edge = np.array([[-128, 127] * 32, [-129, 0] * 32, [255, 0] * 32])
    assert clustering.widths(edge).tolist() == [8, 16, 16]
    assert clustering.widths(edge.astype(object)).tolist() == [8, 16, 16]
