"""Joining events to one row per repository when a few repositories have most events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Copies of a hot key's dimension row for each even share of rows that it has.
SPREAD = 4


def hot_keys(counts: DataFrame, key: str, parts: int) -> DataFrame:
    """Keys with more rows than an even share of one of ``parts`` tasks, and into how many copies each is
    shared out. There are fewer of them than ``parts``."""
    share = counts.agg((F.sum("_n") / parts).alias("share")).scalar()
    copies = F.least(F.ceil(F.col("_n") / share * SPREAD), F.lit(SPREAD * parts))
    return counts.where(F.col("_n") > share).select(key, copies.cast("int").alias("_copies"))


def spread_left_join(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    spread_by: str,
    parts: int | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join in which a hot key is shared out over several tasks.

    A hot key gets several copies of its dimension row, and ``spread_by`` decides which copy a fact
    row meets. Other keys are joined as usual. ``hot`` has the hot keys and their ``_copies``, few
    enough to be sent to every task; without it one extra pass counts the keys of the facts.
    """
    if hot is None:
        if parts is None:
            parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        hot = hot_keys(counts, key, parts)
    copies = F.coalesce("_copies", F.lit(1))

    def marked(table: DataFrame, salt: Column) -> DataFrame:
        return table.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_copies")

    placed = F.pmod(F.xxhash64(spread_by), copies).cast("int")
    every = F.explode(F.sequence(F.lit(0), copies - 1))
    return (
        marked(facts, placed)
        .join(marked(dimension, every), [key, "_salt"], "left")
        .drop("_salt")
    )
