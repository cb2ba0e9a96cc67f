"""Carrying any columns through an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plain(docs: DataFrame) -> DataFrame:
    """The same rows under names c0, c1, ..., which no operator uses for columns of its own."""
    return docs.toDF(*[f"c{at}" for at in range(len(docs.columns))])


def plain_name(docs: DataFrame, name: str) -> str:
    return f"c{docs.columns.index(name)}"


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names again."""
    return rows.select(*[f"c{at}" for at in range(len(docs.columns))]).toDF(*docs.columns)
