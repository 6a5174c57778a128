"""Joins between accounts, transactions, messages and shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import DIGEST_LENGTH, digest


def attach_messages(tx: DataFrame, msg: DataFrame, tx_key: str, msg_key: str) -> DataFrame:
    """Every transaction with each of its messages."""
    return tx.join(msg, F.col(tx_key) == F.col(msg_key), "inner")


def _message_keys(msg: DataFrame, msg_key: str, predicate: Column | None) -> DataFrame:
    # distinct first: it combines on the map side, so a transaction with very many
    # messages reaches the join as one row
    if predicate is not None:
        msg = msg.filter(predicate)
    return msg.select(msg_key).distinct()


def unmatched(
    tx: DataFrame, msg: DataFrame, tx_key: str, msg_key: str, predicate: Column | None = None
) -> DataFrame:
    """Transactions without a (qualifying) message."""
    found = _message_keys(msg, msg_key, predicate)
    return tx.join(found, F.col(tx_key) == F.col(msg_key), "left_anti")


def matched(
    tx: DataFrame, msg: DataFrame, tx_key: str, msg_key: str, predicate: Column | None = None
) -> DataFrame:
    """Transactions with at least one (qualifying) message."""
    found = _message_keys(msg, msg_key, predicate)
    return tx.join(found, F.col(tx_key) == F.col(msg_key), "left_semi")


def assign_shard(
    accounts: DataFrame, shards: DataFrame, id_col: str, prefix_col: str, hashed: bool = True
) -> DataFrame:
    """Each account with every shard whose prefix its digest starts with.

    A containment condition alone would compare every account with every shard. Here each
    account is joined on equality, once per prefix length in use: as many as there are
    digits in a digest, or in the longest id, whatever the number of shards.

    ``hashed=False`` takes ``id_col`` itself as the hex id instead of its digest.
    """
    lengths = [
        row["n"]
        for row in shards.select(F.length(prefix_col).alias("n")).distinct().collect()
        if row["n"] is not None and not (hashed and row["n"] > DIGEST_LENGTH)
    ]
    if not lengths:
        return accounts.join(shards, F.lit(False), "inner")
    full = digest(id_col) if hashed else F.col(id_col)
    candidates = F.array(*[F.lit(n) for n in sorted(lengths)])
    probes = (
        accounts.withColumn("_digest", full)
        .withColumn("_length", F.explode(candidates))
        # an id shorter than the prefix cannot contain it
        .filter(F.length("_digest") >= F.col("_length"))
        .withColumn("_prefix", F.substring("_digest", F.lit(1), F.col("_length")))
        .drop("_digest", "_length")
    )
    return probes.join(shards, F.col("_prefix") == F.col(prefix_col), "inner").drop("_prefix")


def account_edges(
    tx: DataFrame,
    msg: DataFrame,
    tx_key: str,
    msg_key: str,
    source: str,
    destination: str,
) -> DataFrame:
    """Distinct directed pairs (src, dst) of accounts that exchanged a message."""
    # repeated (transaction, destination) pairs go before the join, repeated account pairs after
    sent = msg.select(msg_key, F.col(destination).alias("dst")).distinct()
    return (
        tx.select(tx_key, F.col(source).alias("src"))
        .join(sent, F.col(tx_key) == F.col(msg_key))
        .select("src", "dst")
        .distinct()
    )


def balance_at(tx: DataFrame, key: str, time: str, value: Column, until: Column) -> DataFrame:
    """Balance per account from all transactions at or before ``until``."""
    return (
        tx.filter(F.col(time) <= until).groupBy(key).agg(F.sum(value).alias("balance"))
    )


def state_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Keys added, removed or changed between two states, with both values.

    One row per key in each state. Null is a key like others. Both states go through one
    aggregation, which combines on the map side.
    """
    both = before.select(*keys, F.struct(F.col(value)).alias("_before")).unionByName(
        after.select(*keys, F.struct(F.col(value)).alias("_after")), allowMissingColumns=True
    )
    change = (
        F.when(F.col("_before").isNull(), "added")
        .when(F.col("_after").isNull(), "removed")
        .otherwise("changed")
    )
    old, new = F.col(f"_before.{value}"), F.col(f"_after.{value}")
    return (
        both.groupBy(*keys)
        .agg(F.max("_before").alias("_before"), F.max("_after").alias("_after"))
        .filter(F.col("_before").isNull() | F.col("_after").isNull() | ~old.eqNullSafe(new))
        .select(*keys, old.alias("before"), new.alias("after"), change.alias("change"))
    )
