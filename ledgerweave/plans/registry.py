"""Registration of queries and the last step that makes their columns portable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.session import apply_runtime_defaults
from ledgerweave.sources.ledger import Ledger

# Slice size for queries that are registered to show the cutting of hot keys: small enough
# that the test tables are cut too.
SMALL_SLICES = 500
# Digits after the point of the money in the given tables.
CENTS = 2


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[Ledger], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, directory: str) -> DataFrame:
        apply_runtime_defaults(spark)
        return portable(self.build(Ledger(spark, directory)))


_plans: dict[str, Plan] = {}


def plan(sql: str | None = None):
    """Register a function of a ``Ledger`` under its own name."""

    def register(build: Callable[[Ledger], DataFrame]) -> Callable[[Ledger], DataFrame]:
        if build.__name__ in _plans:
            raise ValueError(f"query {build.__name__} is registered twice")
        _plans[build.__name__] = Plan(build.__name__, build, sql)
        return build

    return register


def all_plans() -> dict[str, Plan]:
    return dict(_plans)


def portable(df: DataFrame) -> DataFrame:
    """Final column types that both engines return alike.

    Money is summed as exact decimals throughout; the two engines give such sums different
    precisions, so only the finished value is turned into a double. Times become
    TIMESTAMP_NTZ.
    """

    def final(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType)):
            return column.cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return column.cast("bigint").alias(field.name)
        return column

    return df.select(*[final(field) for field in df.schema.fields])
