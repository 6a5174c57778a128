"""Running balances, chain links, gaps, quorums and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.hotkeys import (
    MIN_SLICE_ROWS,
    NOTHING_HOT,
    KeyedOrder,
    find_hot_keys,
)
from ledgerweave.session import written


def running_balance(
    tx: DataFrame,
    key: str,
    order: Sequence[str],
    value: Column,
    out: str = "balance",
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Cumulative value per account. ``order`` must end in a tie-break."""
    return KeyedOrder(tx, [key], order, (), min_slice_rows).sums({out: value}).done()


def prev_link(
    tx: DataFrame,
    key: str,
    order: Sequence[str],
    columns: Sequence[str],
    prefix: str = "prev_",
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Columns of the account's previous transaction; null on its first."""
    ordered = KeyedOrder(tx, [key], order, (), min_slice_rows)
    before = F.struct(*[F.col(name) for name in columns])
    linked = ordered.last("_prev", before, inclusive=False).done()
    return linked.select(
        *tx.columns, *[F.col(f"_prev.{name}").alias(f"{prefix}{name}") for name in columns]
    )


def chain_gaps(
    blocks: DataFrame,
    shard: Sequence[str],
    seqno: str,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Runs of missing sequence numbers between the first and last block of each shard."""
    # counting its keys and using it are two readings of the distinct rows
    present, _ = written(blocks.select(*shard, seqno).distinct(), "present")
    ordered = KeyedOrder(present, shard, [seqno], (), min_slice_rows)
    linked = ordered.last("_prev", F.col(seqno), inclusive=False).done()
    return linked.filter(F.col(seqno) - F.col("_prev") > 1).select(
        *shard,
        (F.col("_prev") + 1).alias("gap_start"),
        (F.col(seqno) - 1).alias("gap_end"),
        (F.col(seqno) - F.col("_prev") - 1).alias("n_missing"),
    )


def quorum(
    validators: DataFrame,
    ident: str,
    weight: str,
    keys: Sequence[str] = (),
    more_than: bool = True,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Smallest heaviest-first set of validators that reaches two thirds of the weight.

    With ``more_than`` the set must exceed two thirds, otherwise reaching them is enough.
    A validator belongs while those before it fall short. ``weight`` must be an integer or
    a decimal: the comparison is exact and divides nothing. ``validators`` is written once,
    as it is often an aggregate and is read twice.
    """
    heaviest, _ = written(validators.withColumn("_light", -F.col(weight)), "validators")
    ordered = KeyedOrder(heaviest, keys, ["_light", ident], (), min_slice_rows)
    ordered = ordered.sums({"cumulative": F.col(weight)}, {"total": F.col(weight)})
    before = (F.col("cumulative") - F.col(weight)) * 3
    needed = F.col("total") * 2
    short = before <= needed if more_than else before < needed
    return ordered.done().filter(short).drop("_light")


def global_index(
    df: DataFrame,
    order: Sequence[str],
    out: str = "index",
    min_slice_rows: int = MIN_SLICE_ROWS,
    total: int | None = None,
) -> DataFrame:
    """Dense position 0..n-1 in the total order given by ``order``.

    The table is one long order, cut into slices that are numbered in parallel and moved up
    by the size of the slices before them. ``order`` must be unique. ``total`` saves counting
    the rows where their number is known.
    """
    finding = find_hot_keys(df, [], min_slice_rows, total) or NOTHING_HOT
    ordered = KeyedOrder(df, [], order, (), min_slice_rows, finding)
    counted = ordered.sums({out: F.lit(1).cast("bigint")}).done()
    return counted.withColumn(out, F.col(out) - 1)
