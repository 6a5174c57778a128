"""Files laid out for pruning and for ordered export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_partitioned(
    df: DataFrame, path: str, keys: Sequence[str], mode: str = "errorifexists"
) -> None:
    """Write one folder per key value.

    The rebalance hint lets adaptive execution size the write tasks: small folders are
    gathered into one task, and a folder that holds a large share of the rows is cut over
    several tasks instead of being sent to one.
    """
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).parquet(path)


def canonical_order(df: DataFrame, keys: Sequence[str], files: int | None = None) -> DataFrame:
    """Total order by ``keys`` across and within partitions, ready to be written.

    Give a key that ends in a tie-break: rows equal on all of ``keys`` stay together.
    """
    if files is None:
        placed = df.repartitionByRange(*keys)
    else:
        placed = df.repartitionByRange(files, *keys)
    return placed.sortWithinPartitions(*keys)
