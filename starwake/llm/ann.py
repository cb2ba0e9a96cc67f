"""Nearest neighbours by inner product, with multi-probe p-stable hashing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwake.llm.packed import U64, mixed
from starwake.session import cut_lineage

TABLES = 4
#: Width of a hash's cells, as a multiple of the largest norm of a range.
WIDTH = 2.0
#: Numbers of functions a table may have, and the most buckets a query visits in it, its own included.
HASHES = (4, 6, 8, 10, 12, 16, 20)
MOST_PROBES = 300
#: Vectors and queries of the sample that functions and probes are chosen on, and the share of its
#: neighbours that they have to find.
SAMPLE_ROWS, SAMPLE_QUERIES = 4_096, 128
TARGET = 0.96
#: Vectors that a group of buckets holds, about; a fuller one is split.
GROUP_ROWS = 32_000
#: Groups of buckets in each table at most, the bound of the broadcast of their counts.
GROUPS = 4_096
#: Norms are counted in so many bins an octave, and a range of norms has RANGE_BINS of them.
BINS = 16
RANGE_BINS = 8
SEED = 20_240_229
#: Scores that a task holds at once.
_CELLS = 4_000_000


def probe_sets(hashes: int, probes: int) -> np.ndarray:
    """The ``probes`` likeliest sets of perturbations, as rows of 0 and 1 over the 2 * ``hashes``
    distances to cell borders sorted by size.

    A set's expected score is the sum of its expected squared distances; sets are generated in order
    by shifting or expanding the largest member. A set that moves one hash both ways is left out.
    """
    m = hashes
    near = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    far = [
        1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
        for j in range(m + 1, 2 * m + 1)
    ]
    expected = near + far
    rows = [np.zeros(2 * m, dtype=np.uint64)]
    queue = [(expected[0], (0,))]
    while queue and len(rows) < probes:
        score, members = heapq.heappop(queue)
        last = members[-1]
        if all(2 * m - 1 - j not in members for j in members):
            row = np.zeros(2 * m, dtype=np.uint64)
            row[list(members)] = 1
            rows.append(row)
        if last + 1 < 2 * m:
            shifted = score - expected[last] + expected[last + 1]
            heapq.heappush(queue, (shifted, (*members[:-1], last + 1)))
            heapq.heappush(queue, (score + expected[last + 1], (*members, last + 1)))
    return np.array(rows)


class Hashing:
    """``tables`` times ``hashes`` functions floor((a.x + b) / w) over vectors made equal in norm.

    The largest inner product becomes the smallest distance by one more component, which brings
    every candidate to the largest norm; a query has 0 there and is scaled to that norm.
    """

    def __init__(self, size: int, norm: float, tables: int, hashes: int, width: float, probes: int) -> None:
        rng = np.random.default_rng(SEED)
        self.norm, self.width = norm, width * norm
        self.tables, self.hashes = tables, hashes
        self.lines = rng.standard_normal((size + 1, tables * hashes))
        self.shifts = rng.uniform(0, self.width, tables * hashes)
        self.factors = mixed(np.arange(1, tables * hashes + 1, dtype=U64)) | U64(1)
        self.sets = probe_sets(hashes, probes)

    def _cells(self, rows: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return (rows @ self.lines[:-1] + extra[:, None] * self.lines[-1] + self.shifts) / self.width

    def _raw(self, cells: np.ndarray, table: int) -> np.ndarray:
        at = slice(table * self.hashes, (table + 1) * self.hashes)
        return (np.floor(cells[:, at]).astype(np.int64).view(U64) * self.factors[at]).sum(axis=1)

    def buckets(self, rows: np.ndarray) -> np.ndarray:
        """The bucket of each candidate in each table."""
        extra = np.sqrt(np.maximum(0, self.norm**2 - (rows**2).sum(axis=1)))
        cells = self._cells(rows, extra)
        return np.stack([mixed(self._raw(cells, table)) for table in range(self.tables)], axis=1).view(np.int64)

    def probes(self, rows: np.ndarray) -> np.ndarray:
        """The buckets each query visits: (query, table, probe), likeliest first."""
        scaled = rows * (self.norm / np.sqrt((rows**2).sum(axis=1)))[:, None]
        cells = self._cells(scaled, np.zeros(len(rows)))
        out = np.empty((len(rows), self.tables, len(self.sets)), dtype=U64)
        for table in range(self.tables):
            at = slice(table * self.hashes, (table + 1) * self.hashes)
            inside = cells[:, at] - np.floor(cells[:, at])
            order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1)
            moves = np.concatenate([-self.factors[at].view(np.int64), self.factors[at].view(np.int64)])
            out[:, table] = self._raw(cells, table)[:, None] + moves[order].view(U64) @ self.sets.T
        return mixed(out).view(np.int64)


def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products summed component by component in double precision: equal vectors score equal,
    whatever else is in the block."""
    out = np.zeros((len(queries), len(rows)))
    for at in range(rows.shape[1]):
        out += queries[:, at, None] * rows[None, :, at]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest scores; ``ids`` ascend, ties go to the smaller."""
    if scores.shape[1] > k:
        limit = np.partition(scores, -k, axis=1)[:, -k]
        rows, columns = np.nonzero(scores >= limit[:, None])
    else:
        rows, columns = np.nonzero(np.ones(scores.shape, dtype=bool))
    return ranked(rows, scores[rows, columns], ids[columns], k, columns)


def ranked(
    groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, values: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of each group by falling score and rising id: groups and values."""
    order = np.lexsort((ids, -scores, groups))
    groups, values = groups[order], values[order]
    begin = np.searchsorted(groups, groups)
    kept = np.arange(len(groups)) - begin < k
    return groups[kept], values[kept]


def _search_group(base: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of each query among the vectors of the buckets it visits."""
    if base.empty or asked.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    base = base.sort_values(["bucket", "vec_id"], kind="stable")
    rows = np.frombuffer(b"".join(base["vector"]), dtype=np.float64).reshape(len(base), -1)
    wanted = np.frombuffer(b"".join(asked["vector"]), dtype=np.float64).reshape(len(asked), -1)
    ids, names, bucket = (base["vec_id"].to_numpy(), asked["query_id"].to_numpy(), base["bucket"].to_numpy())
    visits = [np.frombuffer(one, dtype=np.int64) for one in asked["buckets"]]
    of_visit = np.repeat(np.arange(len(visits)), [len(one) for one in visits])
    visit = np.concatenate(visits)
    order = np.argsort(visit, kind="stable")
    visit, of_visit = visit[order], of_visit[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one in np.intersect1d(visit, bucket):
        low, high = np.searchsorted(bucket, [one, one + 1])
        visitors = of_visit[slice(*np.searchsorted(visit, [one, one + 1]))]
        step = max(1, _CELLS // (high - low))
        for begin in range(0, len(visitors), step):
            part = visitors[begin : begin + step]
            scores = inner_products(wanted[part], rows[low:high])
            scores[names[part][:, None] == ids[None, low:high]] = -np.inf
            at, column = best(scores, ids[low:high], k)
            found.append((part[at], low + column, scores[at, column]))
    if not found:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    query, row, score = (np.concatenate(parts) for parts in zip(*found))
    real = score > -np.inf
    query, row, score = query[real], row[real], score[real]
    _, kept = ranked(query, score, ids[row], k, np.arange(len(query)))
    return pd.DataFrame({"query_id": names[query[kept]], "vec_id": ids[row[kept]], "score": score[kept]})


def chosen(
    sample: np.ndarray, rows: int, k: int, tables: int, width: float, options: tuple[int, ...] = HASHES
) -> tuple[int, int]:
    """Functions a table and probes with which queries of a sample find their neighbours at least cost.

    The ``k`` nearest of ``rows`` vectors are as near as the ``k * len(sample) / rows`` nearest of the
    sample. For each number of functions, the probe at which a neighbour's bucket is first visited
    tells how many probes find ``TARGET`` of them; of the numbers that can, the one whose probes meet
    the fewest vectors of the sample is taken. With more rows neighbours are nearer, so the share
    that a query visits falls.
    """
    asks = np.arange(min(SAMPLE_QUERIES, len(sample)))
    near = max(1, -(-k * len(sample) // rows))
    if len(sample) <= near + 1:
        return options[0], MOST_PROBES
    scores = sample[asks] @ sample.T
    scores[asks, asks] = -np.inf
    best = np.argpartition(-scores, near, axis=1)[:, :near]
    norm = float(np.sqrt((sample**2).sum(axis=1)).max())
    found = []
    for hashes in options:
        hashing = Hashing(sample.shape[1], norm, tables, hashes, width, MOST_PROBES)
        held, visits = hashing.buckets(sample), hashing.probes(sample[asks])
        first = np.full(best.shape, MOST_PROBES, dtype=np.int64)
        for table in range(tables):
            same = visits[:, table, None, :] == held[best, table][:, :, None]
            first = np.where(same.any(axis=2), np.minimum(first, same.argmax(axis=2)), first)
        probes = int(np.sort(first, axis=None)[int(np.ceil(TARGET * first.size)) - 1]) + 1
        met = sum(
            np.isin(held[:, table], visits[at, table, :probes]).sum() for table in range(tables) for at in asks
        )
        found.append((probes > MOST_PROBES, met, hashes, min(probes, MOST_PROBES)))
    _, _, hashes, probes = min(found)
    return hashes, probes


class Ranges:
    """Ranges of norms of the vectors of one size, from the largest down, each with hashing of its
    own. Class 0 is for vectors whose norm is no double, which every query meets."""

    def __init__(self, first: int, size: int, bins: list, tables: int, hashes: int, width: float, probes: int) -> None:
        ranges: list[list] = []  # lowest bin, rows, largest norm
        for one in sorted((one for one in bins if one["bin"] is not None), key=lambda one: -one["bin"]):
            if not ranges or one["bin"] < ranges[-1][0]:
                ranges.append([one["bin"] - RANGE_BINS + 1, 0, 0.0])
            ranges[-1][1] += one["n"]
            ranges[-1][2] = max(ranges[-1][2], one["norm"])
        ranges.reverse()
        self.first = first  # number of the table of class 0; those of hashing follow
        self.lowest = np.array([low for low, _, _ in ranges])
        self.hashed = [
            (Hashing(size, norm, tables, hashes, width, probes), min(GROUPS, -(-n // GROUP_ROWS)))
            for _, n, norm in ranges
        ]
        self.end = first + 1 + tables * len(ranges)

    def classes(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", over="ignore"):
            bins = np.floor(np.log2(np.sqrt((rows**2).sum(axis=1))) * BINS)
        out = np.zeros(len(rows), dtype=np.int64)
        real = np.isfinite(bins)
        if len(self.lowest):
            out[real] = 1 + np.maximum(np.searchsorted(self.lowest, bins[real], side="right") - 1, 0)
        return out


def by_size(batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, ids and vectors of the rows of each size in a batch."""
    sizes = np.array([len(one) for one in batch["_vector"]])
    for size in np.unique(sizes).tolist():
        part = batch[sizes == size]
        yield size, part["vec_id"].to_numpy(), np.stack(part["_vector"].to_numpy()).astype(np.float64)


def usable(vector: Column) -> Column:
    """Vectors that are not null or zero and hold finite components only."""
    component = F.transform(vector, lambda one: one.cast("double"))
    finite = F.forall(component, lambda one: one.isNotNull() & (F.abs(one) < float("inf")))
    return F.coalesce(finite & F.exists(component, lambda one: one != 0), F.lit(False))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    hashes: int | None = None,
    width: float = WIDTH,
    probes: int | None = None,
) -> DataFrame:
    """The ``k`` rows with the largest inner products found for each query row.

    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (the inner product of the original
    vectors in double precision). Queries are the rows for which ``is_query`` holds; a row is never
    its own neighbour. Ties go to the smaller id; copies of a row count once. Vectors that are null
    or zero, hold null or non-finite components, or have a null id take no part. Vectors of
    different sizes have no inner product: those of each size are searched by themselves. A query
    with fewer candidates found is compared with every vector of its size; an empty table gives an
    empty result.

    Vectors are split into ranges of norms, as hashing needs norms that are about equal: each range
    has its own largest norm, cell width and tables. How many functions a table has and how many
    buckets a query visits is chosen on a sample of ``SAMPLE_ROWS`` vectors of the size, unless given
    (:func:`chosen`); every row is indexed. Each table's buckets are dealt to groups; counts say into
    how many parts a group is split, so that a bucket of many copies of a vector is shared out. A
    query goes to the groups of the buckets it visits, which are scored exactly in blocks; results of
    all tables are merged.
    """
    valid = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("_vector"),
        F.coalesce(is_query, F.lit(False)).alias("_asks"),
    )
    norm = F.sqrt(F.aggregate("_vector", F.lit(0.0), lambda total, one: total + one * one))
    bin_of = F.when((norm > 0) & (norm < float("inf")), F.floor(F.log2(norm) * BINS).cast("int"))
    sizes = (
        valid.groupBy(F.size("_vector").alias("size"), bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
        .groupBy("size")  # the bins of doubles are at most BINS * 2 098
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("bin", "n", "norm")).alias("bins"))
        .orderBy("size")
        .collect()
    )
    plans: dict[int, Ranges] = {}
    first = 0
    for one in sizes:
        of_size = valid.where(F.size("_vector") == one["size"])
        functions, visits = hashes, probes
        if functions is None or visits is None:
            most = max((bin_ for bin_ in one["bins"] if bin_["bin"] is not None), key=lambda bin_: bin_["n"], default=None)
            near = of_size if most is None else of_size.where(F.abs(bin_of - most["bin"]) < RANGE_BINS)
            picked = near.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("_vector").collect()
            data = np.array([row["_vector"] for row in picked], dtype=np.float64)
            options = HASHES if functions is None else (functions,)
            functions, calibrated = chosen(data, one["n"], k, tables, width, options)
            visits = calibrated if visits is None else visits
        plans[one["size"]] = Ranges(first, one["size"], one["bins"], tables, functions, width, visits)
        first = plans[one["size"]].end

    def scanned(table, data, names):
        vectors = np.array([one.tobytes() for one in data], dtype=object)
        return pd.DataFrame({"table": table, "slice": 0, "vec_id": names, "bucket": 0, "vector": vectors})

    def placed(batches):
        for batch in batches:
            for size, names, every in by_size(batch):
                ranges = plans[size]
                of = ranges.classes(every)
                yield scanned(ranges.first, every[of == 0], names[of == 0])
                for at, (hashing, groups) in enumerate(ranges.hashed):
                    data = every[of == at + 1]
                    found = hashing.buckets(data)
                    yield pd.DataFrame(
                        {
                            "table": np.tile(np.arange(1, tables + 1) + ranges.first + at * tables, len(data)),
                            "slice": (found.view(U64) % U64(groups)).astype(np.int64).ravel(),
                            "vec_id": np.repeat(names[of == at + 1], tables),
                            "bucket": found.ravel(),
                            "vector": np.repeat(np.array([one.tobytes() for one in data], dtype=object), tables),
                        }
                    )

    def placed_once(batches):
        for batch in batches:
            for size, names, every in by_size(batch):
                yield scanned(plans[size].first, every, names)

    zero = np.zeros(1, dtype=np.int64).tobytes()
    columns = ["table", "slice", "query_id", "buckets", "vector"]

    def sent(batches):
        for batch in batches:
            for size, names, data in by_size(batch):
                ranges = plans[size]
                out = [(ranges.first, 0, name, zero, vector.tobytes()) for name, vector in zip(names, data)]
                for at, (hashing, groups) in enumerate(ranges.hashed):
                    visited = hashing.probes(data)
                    for name, vector, by_table in zip(names, data, visited):
                        for table, buckets in enumerate(by_table, ranges.first + 1 + at * tables):
                            part = (buckets.view(U64) % U64(groups)).astype(np.int64)
                            for one in np.unique(part):
                                out.append((table, int(one), name, buckets[part == one].tobytes(), vector.tobytes()))
                yield pd.DataFrame(out, columns=columns)

    def sent_once(batches):
        for batch in batches:
            for size, names, data in by_size(batch):
                out = [(plans[size].first, 0, name, zero, vector.tobytes()) for name, vector in zip(names, data)]
                yield pd.DataFrame(out, columns=columns)

    place = "table int, slice bigint, vec_id bigint, bucket bigint, vector binary"
    ask = "table int, slice bigint, query_id bigint, buckets binary, vector binary"
    rows = valid.select("vec_id", "_vector")
    queries = valid.where("_asks").select("vec_id", "_vector")
    result = cut_lineage(_ranked_rows(_met(rows.mapInPandas(placed, place), queries.mapInPandas(sent, ask), k), k))
    full = result.where(F.col("rank") == k).select(F.col("query_id").alias("_full"))
    short = queries.join(full, F.col("vec_id") == F.col("_full"), "left_anti")
    if short.isEmpty():
        return result
    filled = _ranked_rows(_met(rows.mapInPandas(placed_once, place), short.mapInPandas(sent_once, ask), k), k)
    return result.join(full, F.col("query_id") == F.col("_full"), "left_semi").union(filled)


def _met(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best candidates of every query in each part of a group."""
    counts = base.groupBy("table", "slice").agg(
        F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_parts")
    )
    spread = F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int")
    base = base.join(F.broadcast(counts), ["table", "slice"]).withColumn("part", spread).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    asked = asked.join(F.broadcast(counts), ["table", "slice"]).withColumn("part", every).drop("_parts")
    key = ["table", "slice", "part"]
    return (
        base.groupBy(*key)
        .cogroup(asked.groupBy(*key))
        .applyInPandas(
            lambda left, right: _search_group(left, right, k), "query_id bigint, vec_id bigint, score double"
        )
    )


def _ranked_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.repartition("query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
