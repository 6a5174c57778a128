"""State at a point in time, follow-ups, trailing windows and sessions per account."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import micros
from ledgerweave.operators.hotkeys import (
    MIN_SLICE_ROWS,
    NOTHING_HOT,
    KeyedOrder,
    null_safe_join,
    split_hot,
)
from ledgerweave.operators.slices import _time

_AT = "_at"
_PHASE = "_phase"
_DELTA = "_delta"
_READ = "_read"


def state_as_of(
    accounts: DataFrame,
    tx: DataFrame,
    account_key: str,
    tx_key: str,
    time: str,
    tie: Sequence[str],
    values: Sequence[str],
    until: Any,
) -> DataFrame:
    """Latest record of each account at or before one time; accounts without one are left out."""
    newest = (
        tx.filter(F.col(time) <= _time(until))
        .groupBy(tx_key)
        .agg(F.max_by(F.struct(time, *values), F.struct(time, *tie)).alias("_state"))
    )
    return (
        accounts.join(newest, F.col(account_key) == F.col(tx_key))
        .drop(tx_key)
        .select(
            *accounts.columns,
            *[F.col(f"_state.{name}").alias(name) for name in [time, *values]],
        )
    )


def state_as_of_each(
    records: DataFrame,
    probes: DataFrame,
    key: str,
    record_time: str,
    probe_time: str,
    tie: Sequence[str],
    values: Sequence[str],
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Each probe with the latest record of its key at or before the probe's own time.

    Records and probes are one table in time order, records first at equal times; each
    probe takes the last record above it. No pair of record and probe is formed. Probes
    before the first record are kept with nulls, and so are probes without a time; records
    without a time are the state at no time. ``records`` and ``probes`` must both name the
    key column ``key``; ``values`` must not occur in ``probes``.
    """
    records = records.filter(F.col(record_time).isNotNull())
    order_types = {name: records.schema[name].dataType for name in tie}
    state = F.struct(F.col(record_time), *[F.col(name) for name in values])
    record_side = records.select(
        F.col(key),
        F.col(record_time).alias(_AT),
        F.lit(0).alias(_PHASE),
        *[F.col(name).alias(f"_tie_{name}") for name in tie],
        state.alias("_state"),
    )
    probe_side = probes.select(
        F.col(key),
        F.col(probe_time).alias(_AT),
        F.lit(1).alias(_PHASE),
        *[F.lit(None).cast(kind).alias(f"_tie_{name}") for name, kind in order_types.items()],
        F.struct(*[F.col(name) for name in probes.columns if name != key]).alias(_READ),
    )
    union = record_side.unionByName(probe_side, allowMissingColumns=True)
    ordered = KeyedOrder(
        union, [key], [_AT, _PHASE, *[f"_tie_{name}" for name in tie]], (), min_slice_rows
    ).last("_latest", F.col("_state"))
    return (
        ordered.done()
        .filter(F.col(_PHASE) == 1)
        .select(
            key,
            *[F.col(f"{_READ}.{name}").alias(name) for name in probes.columns if name != key],
            *[F.col(f"_latest.{name}").alias(name) for name in [record_time, *values]],
        )
    )


def _trailing(
    rows: DataFrame, key: str, time: str, days: int, min_slice_rows: int, finding=None
) -> DataFrame:
    """Adds ``_volume`` and ``_rows`` over [time - days, time] of the same key.

    Each row adds its amount at its time and takes it away again just after its last day,
    so the trailing sum is a running sum: one sort per key, whatever the window holds. The
    amounts that are there are counted too: a sum of none of them is null, not zero.
    """
    arrivals = rows.withColumn(_AT, F.col(time)).withColumn(_PHASE, F.lit(0))
    leaving = rows.select(
        key,
        (F.col(time) + F.expr(f"INTERVAL {int(days)} DAYS")).alias(_AT),
        F.lit(1).alias(_PHASE),
        *[(-F.col(name)).alias(name) for name in ("_amount", "_one", "_given")],
    )
    union = arrivals.unionByName(leaving, allowMissingColumns=True)
    ordered = KeyedOrder(union, [key], [_AT, _PHASE], (), min_slice_rows, finding)
    named = {"_volume": "_amount", "_rows": "_one", "_there": "_given"}
    ordered = ordered.sums({out: F.col(name) for out, name in named.items()}, peers=True)
    return (
        ordered.done()
        .filter(F.col(_PHASE) == 0)
        .withColumn("_volume", F.when(F.col("_there") > 0, F.col("_volume")))
        .drop(_AT, _PHASE, "_there")
    )


def trailing_volume(
    tx: DataFrame,
    key: str,
    time: str,
    value: Column,
    days: int,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Each transaction with ``volume`` and ``n_tx`` of its account over the last days.

    Same result as ``sum(...) over (... range between interval N days preceding and
    current row)``, which would add up the whole window again for every row. Null keys are
    an account like others; rows without a time are each other's window; amounts that are
    null are passed over, and a window of such amounts alone has a null volume.
    """
    rows = tx.withColumns(
        {
            "_amount": value,
            "_one": F.lit(1).cast("bigint"),
            "_given": value.isNotNull().cast("bigint"),
        }
    )
    cold, hot = split_hot(rows, [key], min_slice_rows)
    result = _trailing(cold, key, time, days, min_slice_rows, NOTHING_HOT)
    if hot is not None:
        # rows of one account at one instant cannot be cut apart, so they are added up first
        instants = hot.groupBy(key, time).agg(
            *[F.sum(name).alias(name) for name in ("_amount", "_one", "_given")]
        )
        totals = _trailing(instants, key, time, days, min_slice_rows)
        totals = totals.select(key, time, "_volume", "_rows")
        result = result.unionByName(null_safe_join(hot, totals, [key, time]))
    return (
        result.withColumnRenamed("_volume", "volume")
        .withColumnRenamed("_rows", "n_tx")
        .drop("_amount", "_one", "_given")
    )


def _following(
    reads: DataFrame, instants: DataFrame, key: str, time: str, horizon_micros: int,
    min_slice_rows: int, finding=None,
) -> DataFrame:
    """Adds ``_n`` (rows of the key in (time, time + horizon]) and ``_first`` (the earliest).

    ``instants`` has one row per key and time: how many rows (``_one``), the lowest id
    (``_lowest``). Time runs backwards: an instant counts from just after its own position
    until the horizon has passed, and each row reads the count before its equals are added.
    """
    reading = reads.withColumn(_AT, -micros(time)).withColumn(_PHASE, F.lit(0))
    starting = instants.select(
        key,
        (-micros(time)).alias(_AT),
        F.lit(1).alias(_PHASE),
        F.col("_one").alias(_DELTA),
        F.struct(F.col(time).alias("time"), F.col("_lowest").alias("id")).alias("_start"),
    )
    ending = instants.select(
        key,
        (F.lit(horizon_micros) - micros(time)).alias(_AT),
        F.lit(1).alias(_PHASE),
        (-F.col("_one")).alias(_DELTA),
    )
    union = reading.unionByName(starting, allowMissingColumns=True).unionByName(
        ending, allowMissingColumns=True
    )
    ordered = KeyedOrder(union, [key], [_AT, _PHASE], (), min_slice_rows, finding)
    ordered = ordered.sums({"_n": F.col(_DELTA)}, peers=True)
    ordered = ordered.last("_first", F.col("_start"))
    return (
        ordered.done()
        .filter((F.col(_PHASE) == 0) & (F.col("_n") > 0))
        .drop(_AT, _PHASE, _DELTA, "_start")
    )


def follow_ups(
    tx: DataFrame,
    key: str,
    time: str,
    ident: str,
    horizon_days: int,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Transactions that the same account follows up within the horizon.

    Adds ``n_follow_ups`` (later transactions in (time, time + horizon]), and id and time of
    the first of them (lowest id among equals; ids can be of any type that has an order).
    Pairs are never formed: an account with n transactions inside one horizon would have
    n * n of them. Null keys are an account like others; rows without a time follow nothing
    and are not followed.
    """
    horizon = horizon_days * 86_400_000_000
    rows = tx.filter(F.col(time).isNotNull())
    cold, hot = split_hot(rows, [key], min_slice_rows)

    def at_instants(part: DataFrame) -> DataFrame:
        return part.groupBy(key, time).agg(
            F.count(F.lit(1)).alias("_one"), F.min(ident).alias("_lowest")
        )

    result = _following(cold, at_instants(cold), key, time, horizon, min_slice_rows, NOTHING_HOT)
    if hot is not None:
        instants = at_instants(hot)
        found = _following(
            instants.select(key, time), instants, key, time, horizon, min_slice_rows
        ).select(key, time, "_n", "_first")
        result = result.unionByName(null_safe_join(hot, found, [key, time]))
    return result.select(
        *tx.columns,
        F.col("_n").alias("n_follow_ups"),
        F.col("_first.id").alias("first_id"),
        F.col("_first.time").alias("first_time"),
    )


def sessions_batch(
    df: DataFrame,
    key: str,
    time: str,
    ident: str,
    gap_seconds: int,
    aggregates: Sequence[Column],
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Activity sessions: runs of one key's rows no more than the gap apart.

    Gives key, ``session_start``, ``session_end`` (last row plus the gap) and the aggregates,
    as ``session_window`` does; a key with very many rows is cut like in every other
    ordered operator. Rows without a time belong to no session.
    """
    df = df.filter(F.col(time).isNotNull())
    gap = F.expr(f"INTERVAL {int(gap_seconds)} SECONDS")
    ordered = KeyedOrder(df, [key], [time, ident], (), min_slice_rows)
    ordered = ordered.last("_previous", F.col(time), inclusive=False)
    opens = F.col("_previous").isNull() | (F.col(time) > F.col("_previous") + gap)
    ordered = ordered.with_df(ordered.df.withColumn("_opened", F.when(opens, F.col(time))))
    ordered = ordered.last("session_start", F.col("_opened"))
    return (
        ordered.done()
        .groupBy(key, "session_start")
        .agg((F.max(time) + gap).alias("session_end"), *aggregates)
    )
