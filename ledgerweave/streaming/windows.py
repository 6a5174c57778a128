"""Windowed counts, deduplication and interval joins on streams.

Every function takes and returns a streaming DataFrame whose event-time column is a
TIMESTAMP (see ``with_event_time``). In append mode only closed windows come out: those
that end at or before the newest event time less the delay.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import to_units
from ledgerweave.functions.udfs import combine_batches


def _counted(
    stream: DataFrame, window: Column, keys: Sequence[str], value: str, scale: int
) -> DataFrame:
    # counts and exact sums combine on the map side, so one busy key is no burden
    return (
        stream.groupBy(window.alias("_window"), *keys)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.sum(to_units(value, scale)).alias("total_value"),
        )
        .select(
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            *keys,
            "n_events",
            "total_value",
        )
    )


def tumbling_counts(
    stream: DataFrame, time: str, delay: str, width: str, keys: Sequence[str], value: str,
    scale: int,
) -> DataFrame:
    return _counted(stream.withWatermark(time, delay), F.window(time, width), keys, value, scale)


def sliding_counts(
    stream: DataFrame,
    time: str,
    delay: str,
    width: str,
    step: str,
    keys: Sequence[str],
    value: str,
    scale: int,
) -> DataFrame:
    window = F.window(time, width, step)
    return _counted(stream.withWatermark(time, delay), window, keys, value, scale)


def sessions(
    stream: DataFrame, time: str, delay: str, gap: str, keys: Sequence[str], value: str,
    scale: int,
) -> DataFrame:
    """Activity sessions per key.

    Rows of a session are merged within each map task before the shuffle if the session has
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` set, which
    ``tuned_session`` does.
    """
    window = F.session_window(time, gap)
    return _counted(stream.withWatermark(time, delay), window, keys, value, scale)


def dedupe_stream(stream: DataFrame, time: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """The first row per key among repeats that are no more than the delay apart.

    Repeats with the same event time that lie in the same Arrow batch go before the shuffle,
    so a key with very many copies reaches its task as about one row per batch and time. Such
    copies are late all together or not at all; copies with different times must not be
    dropped there, as a late one could take the place of a timely one.
    """
    keys = list(keys)
    columns = stream.columns
    schema = stream.schema

    def first_of_each(table: pa.Table) -> pa.Table:
        position = pa.array(range(table.num_rows), type=pa.int64())
        same = [*keys, time] if time not in keys else keys
        numbered = table.select(same).append_column("_position", position)
        first = numbered.group_by(same).aggregate([("_position", "min")])
        return table.take(first.column("_position_min").combine_chunks().sort())

    local = combine_batches(stream, first_of_each, schema)
    return local.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys).select(*columns)


def match_stream(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    left_id: str,
    delay: str,
    horizon: str,
    busy: Sequence = (),
    salts: int = 8,
) -> DataFrame:
    """Pairs of one key where the right row comes within the horizon after the left one.

    The two sides must share only the column ``key``. ``busy`` names keys with very many rows:
    their left rows are spread over ``salts`` join keys by their id, and each of their right
    rows is offered to all of these, so that their state and work are shared by several tasks.
    Rows of other keys are held once. Give the smaller side as right.

    ``busy`` may be another list whenever the query is started again: a key that has become busy is
    spread from then on, and what the state holds of it stays valid. Right rows that came before
    are at the first join key only, so each left row of a busy key is held there a second time for
    them alone. ``busykeys.learn`` keeps such a list. ``salts`` must stay the same.
    """
    is_busy = F.coalesce(F.col(key).isin(list(busy)), F.lit(False))
    salt = F.pmod(F.xxhash64(left_id), F.lit(salts)).cast("int")

    def place(salt, kind: int):
        return F.struct(salt.cast("int").alias("salt"), F.lit(kind).alias("kind"))

    places = F.when(is_busy, F.array(place(salt, SPREAD), place(F.lit(0), FOR_EARLIER))).otherwise(
        F.array(place(F.lit(0), PLAIN))
    )
    spread = left.withColumn("_place", F.explode(places))
    last = F.when(is_busy, F.lit(salts - 1)).otherwise(0)
    offered = right.withColumn("_right_spread", is_busy).withColumn(
        "_right_salt", F.explode(F.sequence(F.lit(0), last))
    )
    offered = offered.withColumnRenamed(key, "_right_key")
    kind = F.col("_place.kind")
    within = (
        (F.col(key) == F.col("_right_key"))
        & (F.col("_place.salt") == F.col("_right_salt"))
        & (F.col(right_time) > F.col(left_time))
        & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {horizon}"))
        & ((kind == PLAIN) | ((kind == SPREAD) == F.col("_right_spread")))
    )
    joined = spread.withWatermark(left_time, delay).join(
        offered.withWatermark(right_time, delay), within
    )
    return joined.drop("_place", "_right_salt", "_right_key", "_right_spread")


# How a left row is held: alone, or spread over join keys, or for right rows that were not spread.
PLAIN, SPREAD, FOR_EARLIER = 0, 1, 2
