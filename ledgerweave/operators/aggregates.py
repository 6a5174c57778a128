"""Totals, rollups, distinct counts, percentiles and consistency checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.columns import to_units
from ledgerweave.operators.hotkeys import MIN_SLICE_ROWS, KeyedOrder
from ledgerweave.session import written


# Sketches are first merged into this many, then into one.
_SKETCH_GROUPS = 64


def account_flow(
    accounts: DataFrame,
    tx: DataFrame,
    msg: DataFrame,
    account_key: str,
    tx_key: str,
    tx_account: str,
    msg_key: str,
    value: str,
    scale: int,
) -> DataFrame:
    """Message count and value per account (accounts with at least one message).

    Messages are added up per transaction before any join and per account before the last
    one. The per-transaction sums are already partitioned by the join key, so the join adds
    no shuffle of its own on that side, and a transaction with very many messages is one row.
    """
    per_tx = msg.groupBy(msg_key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(to_units(value, scale)).alias("v")
    )
    per_account = (
        tx.select(tx_key, tx_account)
        .join(per_tx, F.col(tx_key) == F.col(msg_key))
        .groupBy(tx_account)
        .agg(F.sum("n").alias("n_messages"), F.sum("v").alias("total_value"))
    )
    return accounts.join(per_account, F.col(account_key) == F.col(tx_account)).select(
        *accounts.columns, "n_messages", "total_value"
    )


def block_summary(
    tx: DataFrame, block: Column, ident: str, value: str, scale: int
) -> DataFrame:
    """Count, value, first and last transaction id per block."""
    return tx.groupBy(block.alias("block")).agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.sum(to_units(value, scale)).alias("total_value"),
        F.min(ident).alias("first_id"),
        F.max(ident).alias("last_id"),
    )


def _finest(msg: DataFrame, keys: Sequence[str], value: str, scale: int) -> DataFrame:
    # Grouping sets copy every input row once per set. Adding up on the finest keys first
    # makes that a copy of the few finest groups.
    return msg.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(to_units(value, scale)).alias("_v")
    )


def _levels(grouped, keys: Sequence[str]) -> DataFrame:
    return grouped.agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("_n").alias("n_messages"),
        F.sum("_v").alias("total_value"),
    ).select(*keys, "level", "n_messages", "total_value")


def flow_rollup(msg: DataFrame, keys: Sequence[str], value: str, scale: int) -> DataFrame:
    """Hierarchical totals; ``level`` is the grouping id (0 = all keys present)."""
    return _levels(_finest(msg, keys, value, scale).rollup(*keys), keys)


def flow_cube(msg: DataFrame, keys: Sequence[str], value: str, scale: int) -> DataFrame:
    return _levels(_finest(msg, keys, value, scale).cube(*keys), keys)


def flow_grouping_sets(
    msg: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], value: str, scale: int
) -> DataFrame:
    columns = [[F.col(name) for name in chosen] for chosen in sets]
    finest = _finest(msg, keys, value, scale)
    return _levels(finest.groupingSets(columns, *[F.col(key) for key in keys]), keys)


def distinct_parties(msg: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """Exact distinct count. Planned as two aggregations, the first on (keys, ident)."""
    return msg.groupBy(*keys).agg(F.count_distinct(ident).alias("n_parties"))


def parties_sketch(
    msg: DataFrame, keys: Sequence[str], ident: str, precision: int = 14
) -> DataFrame:
    """One mergeable distinct-count sketch per group, to be stored and combined later."""
    return msg.groupBy(*keys).agg(
        F.hll_sketch_agg(ident, F.lit(precision)).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct count per ``keys`` from finer sketches."""
    return sketches.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_parties")
    )


def distinct_parties_approx(
    msg: DataFrame, keys: Sequence[str], ident: str, precision: int = 14
) -> DataFrame:
    """Sketched distinct count; standard error about 1.04 / sqrt(2 ** precision)."""
    return parties_sketch(msg, keys, ident, precision).select(
        *keys, F.hll_sketch_estimate("sketch").alias("n_parties")
    )


def fee_percentile(
    msg: DataFrame,
    keys: Sequence[str],
    value: str,
    p: float,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Exact percentile per group, linear between the two nearest ranks.

    The built-in exact percentile keeps all distinct values of a group in one task. Here the
    group becomes a histogram (value, count), its running count says which values hold the
    two ranks, and a group with many distinct values is cut into slices.
    """
    histogram = msg.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # counting its keys and using it are two readings, and more if a key is cut
    histogram, _ = written(histogram.filter(F.col(value).isNotNull()), "histogram")
    ordered = KeyedOrder(histogram, keys, [value], (), min_slice_rows)
    ordered = ordered.sums({"_upto": F.col("_n")}, {"_all": F.col("_n")})
    place = F.lit(float(p)) * (F.col("_all") - 1)
    holds_low = (F.col("_upto") > F.floor(place)) & (F.col("_upto") - F.col("_n") <= F.floor(place))
    holds_high = (F.col("_upto") > F.ceil(place)) & (F.col("_upto") - F.col("_n") <= F.ceil(place))
    low = F.max(F.when(holds_low, F.col(value).cast("double")))
    high = F.max(F.when(holds_high, F.col(value).cast("double")))
    part = F.max(place - F.floor(place))
    return (
        ordered.done()
        .filter(holds_low | holds_high)
        .groupBy(*keys)
        .agg((low + (high - low) * part).alias("percentile"))
    )


def heavy_destinations(msg: DataFrame, destination: str, n: int) -> DataFrame:
    """The ``n`` most frequent destinations with their counts, equals of the last included.

    Exact: counts combine on the map side, each partition hands on its ``n`` largest, and the
    last of these is the count that a destination must have. Null is no destination.
    """
    counts = (
        msg.filter(F.col(destination).isNotNull())
        .groupBy(destination)
        .agg(F.count(F.lit(1)).alias("n_messages"))
    )
    counts, _ = written(counts, "destinations")
    least = counts.orderBy(F.col("n_messages").desc()).limit(n).agg(F.min("n_messages"))
    return counts.filter(F.col("n_messages") >= least.scalar())


def heavy_destinations_approx(
    msg: DataFrame, destination: str, n: int, tracked: int = 10_000
) -> DataFrame:
    """Approximate most frequent destinations, equals of the last place included, from one
    pass and fixed memory; ``exact`` says whether all destinations were tracked.

    Sketches of fixed size, merged in two steps so that no task receives one from every map
    task; exact while there are no more than ``tracked`` distinct destinations. What is
    ranked afterwards is the sketch's content, at most ``tracked`` rows.
    """
    tracked = int(tracked)
    sketches = (
        msg.select(destination, (F.spark_partition_id() % _SKETCH_GROUPS).alias("_group"))
        .groupBy("_group")
        .agg(F.expr(f"approx_top_k_accumulate(`{destination}`, {tracked})").alias("sketch"))
    )
    merged = sketches.agg(F.expr("approx_top_k_combine(sketch)").alias("sketch"))
    top = F.expr(f"approx_top_k_estimate(sketch, {tracked})")
    listed, _ = written(merged.select(F.inline(top)), "heavy")  # at most ``tracked`` rows
    # a full sketch may have dropped some and counted their messages to others
    exact = F.lit(listed.count() < tracked)
    place = F.rank().over(Window.orderBy(F.col("count").desc()))
    return (
        listed.withColumn("_place", place)
        .filter(F.col("_place") <= n)
        .select(
            F.col("item").alias(destination),
            F.col("count").alias("n_messages"),
            exact.alias("exact"),
        )
    )


def conservation_breaks(
    tx: DataFrame,
    msg: DataFrame,
    tx_key: str,
    tx_total: str,
    msg_key: str,
    value: str,
    scale: int,
) -> DataFrame:
    """Transactions whose total differs from the sum of their messages, or is not known."""
    parts = msg.groupBy(msg_key).agg(F.sum(to_units(value, scale)).alias("parts"))
    total = to_units(tx_total, scale)
    return (
        tx.select(tx_key, total.alias("total"))
        .join(parts, F.col(tx_key) == F.col(msg_key), "left")
        .filter(~F.col("total").eqNullSafe(F.coalesce("parts", F.lit(0))))
        .select(
            tx_key,
            "total",
            F.coalesce("parts", F.lit(0).cast(parts.schema["parts"].dataType)).alias("parts"),
            F.when(F.col("total").isNull(), "no total")
            .when(F.col("parts").isNull(), "no messages")
            .when(F.col("parts") < F.col("total"), "short")
            .otherwise("over")
            .alias("kind"),
        )
    )


def status_pivot(
    tx: DataFrame,
    row_key: str | Column,
    col_key: str,
    values: Mapping[str, str],
    other: str = "other",
) -> DataFrame:
    """Counts spread to columns. ``values`` maps each known value to its column name, so no
    job has to look for the values first. Column ``other`` counts what is not among them,
    null included, so each row's counts add up to its rows."""
    listed = F.coalesce(F.col(col_key).cast("string").isin(list(values)), F.lit(False))
    spread = [
        F.count_if(F.col(col_key).cast("string") == value).alias(name)
        for value, name in values.items()
    ]
    return tx.groupBy(row_key).agg(*spread, F.count_if(~listed).alias(other))
