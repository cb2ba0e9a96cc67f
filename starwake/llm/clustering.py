"""Centroid clustering of integer vectors, with exact products from bit planes.

A vector of 64 integers is kept as its bit planes in two's complement: plane ``i`` is one unsigned
64-bit number whose bit ``j`` is bit ``i`` of component ``j``. The inner product of two vectors is
the sum, over all pairs of their planes, of the common bits times the weights of both planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwake.llm.stored import Scratch

SIZE = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
#: Planes whose weighted counts are added up as 64-bit integers before larger numbers are used.
BLOCK = 16
#: Planes that go into one 64-bit part of a sum of vectors.
LIMB = 32
#: Up to so many products, a pair of blocks is counted in one step: wide vectors are rare.
FEW_CELLS = 1_024
#: Vectors compared at once.
ROWS = 16_384
_LONGEST = (1 << 63) - 1


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as integers: 64-bit ones if all fit, else Python's."""
    with np.errstate(over="ignore"):
        product = np.floor(values * scale)
    if np.abs(product).max(initial=0) < 2.0**62:
        return product.astype(np.int64)
    # Doubles beyond 2^53 are whole numbers, so they can be multiplied as such.
    rows = [
        [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row]
        for row in values.tolist()
    ]
    return np.array(rows, dtype=object).reshape(values.shape)


def widths(rows: np.ndarray) -> np.ndarray:
    """Planes that each row needs, its sign's included, as a multiple of 8."""
    if rows.dtype == object:
        bits = [max((v if v >= 0 else ~v).bit_length() for v in row) for row in rows]
        most = np.array(bits, dtype=np.int64)
    else:
        largest = np.where(rows < 0, ~rows, rows).max(axis=1, initial=0)
        most = sum((largest >> at > 0).astype(np.int64) for at in range(63))
    return (most // 8 + 1) * 8


def to_planes(rows: np.ndarray, width: int) -> np.ndarray:
    """Planes of rows of 64 integers: (row, plane), least significant first."""
    if rows.dtype == object:
        raw = b"".join(int(v).to_bytes(width // 8, "little", signed=True) for row in rows for v in row)
        data = np.frombuffer(raw, dtype=np.uint8).reshape(len(rows), SIZE, width // 8)
    else:
        data = np.ascontiguousarray(rows, dtype="<i8").view(np.uint8).reshape(len(rows), SIZE, 8)
        data = data[:, :, : width // 8]
    bits = np.unpackbits(data, axis=2, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")
    return packed.reshape(len(rows), width * 8).view("<u8")


def from_planes(planes: np.ndarray) -> list[int]:
    """The 64 integers of one row of planes."""
    out = [0] * SIZE
    for at, (plane, weight) in enumerate(zip(planes.tolist(), plane_weights(len(planes)), strict=True)):
        for j in range(SIZE):
            if plane >> j & 1:
                out[j] += weight << (at // BLOCK * BLOCK)
    return out


def plane_weights(width: int, block: int = BLOCK) -> list[int]:
    """Weight of each plane within its block; the sign's plane counts negative."""
    weights = [1 << (at % block) for at in range(width)]
    weights[-1] = -weights[-1]
    return weights


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of planes ``a`` with all rows of planes ``b``, exact.

    Within a pair of blocks weighted counts of common bits stay below 2^38. The sums of blocks
    take 64 bits while the widths allow it, and Python's integers beyond.
    """
    kind = np.int64 if a.shape[1] + b.shape[1] <= 56 else object
    wa, wb = plane_weights(a.shape[1]), plane_weights(b.shape[1])
    out = np.zeros((len(a), len(b)), dtype=kind)
    for i0 in range(0, len(wa), BLOCK):
        for j0 in range(0, len(wb), BLOCK):
            i1, j1 = min(i0 + BLOCK, len(wa)), min(j0 + BLOCK, len(wb))
            if out.size <= FEW_CELLS:
                common = np.bitwise_count(a[:, None, i0:i1, None] & b[None, :, None, j0:j1])
                part = np.einsum("abij,i,j->ab", common.astype(np.int64), wa[i0:i1], wb[j0:j1])
            else:
                part = np.zeros(out.shape, dtype=np.int64)
                for i in range(i0, i1):
                    for j in range(j0, j1):
                        common = np.bitwise_count(a[:, i, None] & b[None, :, j])
                        part += common.astype(np.int64) * (wa[i] * wb[j])
            out += part.astype(kind) * (1 << (i0 + j0))
    return out


def own_products(a: np.ndarray) -> np.ndarray:
    """Inner product of each row with itself."""
    if a.shape[1] > 28:
        return np.array([sum(v * v for v in from_planes(row)) for row in a], dtype=object)
    weights = np.array([w << (at // BLOCK * BLOCK) for at, w in enumerate(plane_weights(a.shape[1]))])
    out = np.zeros(len(a), dtype=np.int64)
    for i in range(a.shape[1]):
        for j in range(i, a.shape[1]):
            common = np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64)
            out += common * (weights[i] * weights[j] * (1 if i == j else 2))
    return out


class Centroids:
    """Some rows of 64 integers, as planes by their width."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.count = len(rows)
        self.norms = [sum(v * v for v in row) for row in rows]
        data = np.array(rows, dtype=object).reshape(-1, SIZE)
        wide = widths(data)
        self.groups = [
            (np.flatnonzero(wide == width), to_planes(data[wide == width], int(width)))
            for width in np.unique(wide)
        ]

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid, the smaller among equals, and the squared distance."""
        squares = own_products(planes)
        columns = {}
        for numbers, group in self.groups:
            met = products(planes, group)
            for at, number in enumerate(numbers):
                big = met.dtype == object or squares.dtype == object or self.norms[number] >= 1 << 60
                kind = object if big else np.int64
                columns[number] = squares.astype(kind) - 2 * met[:, at].astype(kind) + self.norms[number]
        kind = object if any(one.dtype == object for one in columns.values()) else np.int64
        distances = np.stack([columns[number].astype(kind) for number in range(self.count)], axis=1)
        chosen = np.argmin(distances, axis=1)
        return chosen, distances[np.arange(len(planes)), chosen]


_PACKED = "_id string, _width int, _planes binary"


def _packing(scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                sized = pc.fill_null(pc.equal(pc.list_value_length(part.column(1)), SIZE), False)
                part = part.filter(sized)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False)
                values = values.astype(np.float64).reshape(-1, SIZE)
                finite = np.isfinite(values).all(axis=1)
                ids = part.column(0).filter(pa.array(finite))
                rows = scaled(values[finite], scale)
                wide = widths(rows)
                planes = [b""] * len(rows)
                for width in np.unique(wide).tolist():
                    chosen = np.flatnonzero(wide == width)
                    for at, one in zip(chosen, to_planes(rows[chosen], width), strict=True):
                        planes[at] = one.tobytes()
                columns = [ids, pa.array(wide, pa.int32()), pa.array(planes, pa.binary())]
                yield pa.record_batch(columns, names=["_id", "_width", "_planes"])

    return pack


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and planes of a batch's rows, of one width and at most ``ROWS`` at once."""
    wide = batch.column("_width").to_numpy(zero_copy_only=False)
    for width in np.unique(wide).tolist():
        every = np.flatnonzero(wide == width)
        for begin in range(0, len(every), ROWS):
            at = every[begin : begin + ROWS]
            raw = b"".join(batch.column("_planes").take(pa.array(at)).to_pylist())
            yield at, np.frombuffer(raw, dtype="<u8").reshape(len(at), width)


def _summing(centroids: list[list[int]]):
    """Per task, the rows of each cluster and the sums of their components in parts of ``LIMB`` planes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Centroids(centroids)
        counts = np.zeros(len(centroids), dtype=np.int64)
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, planes in _by_width(batch):
                chosen, _ = near.nearest(planes)
                weights = plane_weights(planes.shape[1], LIMB)
                for number in np.unique(chosen).tolist():
                    mine = planes[chosen == number]
                    counts[number] += len(mine)
                    for at, weight in enumerate(weights):
                        plane = np.ascontiguousarray(mine[:, at]).view(np.uint8).reshape(-1, 8)
                        bits = np.unpackbits(plane, axis=1, bitorder="little")
                        total = sums.setdefault((number, at // LIMB), np.zeros(SIZE, dtype=np.int64))
                        total += bits.sum(axis=0, dtype=np.int64) * weight
        names = ["_cluster", "_limb", "_rows", "_sums"]
        keys = sorted(sums)
        columns = [
            pa.array([number for number, _ in keys], pa.int32()),
            pa.array([limb for _, limb in keys], pa.int32()),
            # Every cluster that has rows has a limb 0, which carries their number.
            pa.array([int(counts[number]) if limb == 0 else 0 for number, limb in keys], pa.int64()),
            pa.array([sums[key].tolist() for key in keys], pa.list_(pa.int64())),
        ]
        yield pa.record_batch(columns, names=names)

    return add


def _assigning(centroids: list[list[int]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Centroids(centroids)
        for batch in batches:
            cluster = np.zeros(batch.num_rows, dtype=np.int32)
            distance: list[int | None] = [None] * batch.num_rows
            for at, planes in _by_width(batch):
                chosen, far = near.nearest(planes)
                cluster[at] = chosen
                for row, one in zip(at.tolist(), far.tolist(), strict=True):
                    distance[row] = one if one <= _LONGEST else None
            columns = [batch.column("_id"), pa.array(cluster), pa.array(distance, pa.int64())]
            yield pa.record_batch(columns, names=["_id", "cluster", "distance"])

    return assign


def _moved(packed: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round. The driver gets 64 numbers a centroid and part."""
    parts = packed.mapInArrow(
        _summing(centroids), "_cluster int, _limb int, _rows bigint, _sums array<bigint>"
    )
    totals = (
        parts.select("_cluster", "_limb", "_rows", F.posexplode("_sums").alias("_at", "_sum"))
        .groupBy("_cluster", "_limb", "_at")
        .agg(
            F.sum("_rows").alias("_rows"),
            F.sum(F.col("_sum").cast("decimal(20,0)")).cast("string").alias("_sum"),
        )
        .collect()
    )
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for row in totals:
        if row["_limb"] == 0:
            counts[row["_cluster"]] = row["_rows"]
        mine = sums.setdefault(row["_cluster"], [0] * SIZE)
        mine[row["_at"]] += int(row["_sum"]) << (LIMB * row["_limb"])
    return [
        [total // counts[number] for total in sums[number]] if number in sums else old
        for number, old in enumerate(centroids)
    ]


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = 1,
) -> DataFrame:
    """Clusters vectors of 64 components, each turned into ``floor(scale * x)``.

    A row per kept row of ``vectors``: its id under its own name and type, ``cluster``, ``distance``
    (squared, to the final centroid), ``cluster_inertia``, ``inertia`` (sums of distances over the
    cluster and over all) and ``centroid`` (the final centroid's integers, joined by commas).

    The first centroids are the rows with the smallest SHA-256 of ``<seed>:<id>``. In each round all
    rows go to their nearest centroid, the smaller number among equals, and centroids move to the
    floor of the mean of their rows; one without rows stays.

    Vectors that are null, of another size, or hold a null or non-finite component are left out.
    Repeated rows are rows of their own. A null id counts as an empty text in the hash; rows of one
    id are ordered by their vectors. With fewer rows than ``count`` each row is a first centroid. An
    empty table gives an empty result. Other columns are not read. Components of any size are
    exact; a distance that does not fit a long is null, and so are the sums that hold it.

    Vectors are packed once and stored; a round reads only planes. Tasks send one sum a cluster,
    which add up by component, so no cluster's size matters. The driver holds the centroids.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_col]
    rows = vectors.select(
        F.col(id_col).cast("string").alias("_id"),
        F.col(vector_col).cast("array<double>").alias("_vector"),
    )
    with Scratch(spark) as scratch:
        packed = scratch.stored(rows.mapInArrow(_packing(scale), _PACKED))
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("_id", F.lit(""))), 256)
        first = packed.orderBy(order, "_width", "_planes").limit(count).collect()
        centroids = [from_planes(np.frombuffer(row["_planes"], dtype="<u8")) for row in first]
        if centroids:
            for _ in range(rounds):
                centroids = _moved(packed, centroids)
        assigned = scratch.kept(
            packed.mapInArrow(_assigning(centroids), "_id string, cluster int, distance bigint")
        )
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(20,0)")))
    held = assigned.groupBy("cluster").agg(whole.alias("_sum"), F.count("*").alias("_n")).collect()
    sums = {row["cluster"]: None if row["_sum"] is None else int(row["_sum"]) for row in held}
    total = None if None in sums.values() else sum(sums.values())

    def fitting(number: int | None) -> int | None:
        return None if number is None or number > _LONGEST else number

    told = [
        (number, fitting(sums[number]), fitting(total), ",".join(map(str, centroids[number])))
        for number in sums
    ]
    schema = "_cluster int, cluster_inertia bigint, inertia bigint, centroid string"
    # One row a centroid.
    about = F.broadcast(spark.createDataFrame(told, schema))
    return assigned.join(about, F.col("cluster") == F.col("_cluster")).select(
        F.col("_id").cast(kind).alias(id_col),
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        "centroid",
    )
