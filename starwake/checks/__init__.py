"""Every operator on the test tables, with the same question asked in plain SQL where possible."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starwake.session import use_utc
from starwake.testbed import SQL_TABLES, Testbed, testbed


@dataclass(frozen=True)
class Check:
    build: Callable[[Testbed], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        bed = testbed(spark, sf_dir)
        use_utc(spark)
        return flat(self.build(bed))


CHECKS: dict[str, Check] = {}


def check(name: str, body: str | None = None):
    """Register a query. ``body`` follows the common table expressions of the test tables."""

    def register(build: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
        if name in CHECKS:
            raise KeyError(f"{name} is registered twice")
        CHECKS[name] = Check(build, None if body is None else f"WITH {SQL_TABLES}{body}")
        return build

    return register


def flat(df: DataFrame) -> DataFrame:
    """Plain columns only, so that both engines' results have the same types."""

    def plain(field: T.StructField):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType):
                return F.to_json(column)
            return F.array_join(column.cast("array<string>"), ",")
        if isinstance(kind, T.StructType):
            return F.to_json(column)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return column.cast("bigint")
        if isinstance(kind, T.TimestampType):
            return column.cast("timestamp_ntz")
        return column

    return df.select(*[plain(field).alias(field.name) for field in df.schema])


def load() -> dict[str, Check]:
    """Import all check modules."""
    from starwake.checks import (  # noqa: F401
        cleaning,
        insights,
        operations,
        reporting,
        rolling,
        searching,
        storing,
    )

    return CHECKS
