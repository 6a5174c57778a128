"""Row selection by time and by shard."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import digest


def _time(value: Any) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else F.lit(value)


def time_slice(df: DataFrame, column: str, start: Any = None, end: Any = None) -> DataFrame:
    """Rows with ``start <= column < end``; either side may be open."""
    if start is not None:
        df = df.filter(F.col(column) >= _time(start))
    if end is not None:
        df = df.filter(F.col(column) < _time(end))
    return df


def select_shard(
    df: DataFrame, prefix: str, id_col: str | None = None, shard_col: str | None = None
) -> DataFrame:
    """Rows of one shard.

    With ``shard_col`` (the partition column of a table written by ``write_partitioned``)
    the comparison prunes folders; otherwise the digest of ``id_col`` is computed per row.
    """
    if shard_col is not None:
        return df.filter(F.col(shard_col).startswith(prefix))
    if id_col is None:
        raise ValueError("give id_col or shard_col")
    return df.filter(F.startswith(digest(id_col), F.lit(prefix)))
