"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwake.llm.stored import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``_node`` and ``_comp``, the smallest node of its component, for edges (``_a``, ``_b``).

    In each round every component takes the smallest label among the neighbours of its nodes and
    then its label's label, so that chains shrink by doubling. Labels are stored in ``scratch`` after each round;
    minima combine on the map side, so nodes with very many links do not gather.
    """
    both = scratch.stored(edges.select("_a", "_b").union(edges.select(F.col("_b"), F.col("_a"))).distinct())
    first = both.groupBy(F.col("_a").alias("_node")).agg(F.min("_b").alias("_least"))
    labels = scratch.stored(first.select("_node", F.least("_node", "_least").alias("_comp")))
    while True:
        heard = (
            both.join(labels, F.col("_b") == F.col("_node"))
            .groupBy("_a")
            .agg(F.min("_comp").alias("_heard"))
        )
        met = labels.join(heard, F.col("_node") == F.col("_a")).select(
            "_node", "_comp", F.least("_comp", "_heard").alias("_low")
        )
        # What a component's nodes have heard holds for all of them.
        told = scratch.stored(met.groupBy(F.col("_comp").alias("_name")).agg(F.min("_low").alias("_told")))
        if told.where(F.col("_name") != F.col("_told")).isEmpty():
            return labels
        jump = told.select(F.col("_name").alias("_via"), F.col("_told").alias("_jump"))
        labels = scratch.stored(
            labels.join(told, F.col("_comp") == F.col("_name"))
            .join(jump, F.col("_told") == F.col("_via"), "left")
            .select("_node", F.least("_told", F.coalesce("_jump", "_told")).alias("_comp"))
        )
