"""Ranks. Top-k results are ranked directly; whole tables are ranked in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwake.session import cut_lineage


def top_k(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def top_k_ranked(
    df: DataFrame, order: list[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """The first ``limit`` rows with their 1-based rank.

    The window has no partition, but it only ever sees the ``limit`` rows that are left.
    """
    return top_k(df, order, limit).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def rank_all(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based rank of every row of a table of any size.

    Rows are range-partitioned on the full order (ties on the first column are split by the
    others) and sorted inside their partitions. ``monotonically_increasing_id`` then holds the
    partition number in its upper bits and the position in the lower 33, so the rank is that
    position plus the sizes of the partitions before. The checkpoint fixes the sampled ranges for
    both uses. The offsets table has one row per partition; that is the bound of its broadcast.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(partitions, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    position = F.col("_at") - F.shiftleft(part, 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumns({"_part": part, "_position": position})
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, (F.col("_offset") + F.col("_position") + 1).cast("bigint"))
        .drop("_at", "_part", "_position", "_offset")
    )


def first_non_empty(*sources: DataFrame) -> DataFrame:
    """The first source that has a row, in the order given.

    Sources are top-k reports. Each is computed once, into the shared folder, until one has a row;
    later ones are not read at all. The last one is returned as it is.
    """
    for source in sources[:-1]:
        report = cut_lineage(source)
        if not report.isEmpty():
            return report
    return sources[-1]
