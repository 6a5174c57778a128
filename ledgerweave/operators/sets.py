"""Set operations and content deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def removed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b does not have, counting copies."""
    return a.exceptAll(b)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both, counting copies."""
    return a.intersectAll(b)


def merge_shards(*shards: DataFrame) -> DataFrame:
    """Union of shard tables by column name, each row once."""
    return reduce(DataFrame.unionByName, shards).distinct()


def dedupe_by_digest(df: DataFrame, content: str, ident: str) -> DataFrame:
    """One row per distinct content: digest, lowest id, number of copies.

    Only the 64-character digest is shuffled, and copies are counted before the shuffle.
    """
    return (
        df.select(F.sha2(content, 256).alias("digest"), ident)
        .groupBy("digest")
        .agg(F.min(ident).alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
    )
