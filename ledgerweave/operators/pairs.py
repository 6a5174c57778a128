"""Pairs of a transaction and what the same account does after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.hotkeys import MIN_SLICE_ROWS, KeyedOrder, null_safe_join
from ledgerweave.operators.temporal import follow_ups
from ledgerweave.session import written


def follow_up_pairs(
    tx: DataFrame,
    key: str,
    time: str,
    ident: str,
    horizon_days: int,
    most: int | None = None,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """``key, ident, n_follow_ups, rank, follow_id, follow_time``: a row for each transaction and each
    later one of its account in (time, time + horizon].

    With ``most`` only the first so many (by time, then id) are given, ``n_follow_ups`` still
    counting all: an account with n transactions in one horizon has n * n pairs, and ``most`` is the
    caller's bound on them. Null keys are an account like others; rows without a time are in no
    pair. ``ident`` must be unique within a key.

    The rows of an account are numbered in order of time. Those that follow a row are then
    consecutive numbers, which begin after its equals and of which ``follow_ups`` knows how many
    there are. So each pair comes from one equality join on account and number; no candidate
    is formed that is not a pair, and an account with very many rows is many join keys.
    """
    rows = tx.filter(F.col(time).isNotNull()).select(key, time, ident)
    one = F.lit(1).cast("bigint")
    numbered = KeyedOrder(rows, [key], [time, ident], (), min_slice_rows).sums({"_place": one})
    numbered, _ = written(numbered.done(), "numbered")
    upto = KeyedOrder(numbered, [key], [time], (), min_slice_rows).sums({"_upto": one}, peers=True)
    counted = follow_ups(upto.done(), key, time, ident, horizon_days, min_slice_rows)
    last = F.col("n_follow_ups") if most is None else F.least("n_follow_ups", F.lit(int(most)))
    wanted = counted.select(
        F.col(key).alias("_key"), F.col(ident).alias("_ident"), "n_follow_ups", "_upto",
        F.explode(F.sequence(one, last)).alias("rank"),
    ).withColumn("_place", F.col("_upto") + F.col("rank"))
    following = numbered.select(
        F.col(key).alias("_key"), "_place", F.col(ident).alias("follow_id"), F.col(time).alias("follow_time")
    )
    return null_safe_join(wanted, following, ["_key", "_place"]).select(
        F.col("_key").alias(key), F.col("_ident").alias(ident), "n_follow_ups", "rank", "follow_id", "follow_time"
    )
