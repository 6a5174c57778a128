"""Counts of windows that are still open, kept in a table that each micro-batch brings up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.sources.streams import LatestState
from ledgerweave.streaming import windows

KEY = "window_key"


def provisional_counts(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    time: str,
    delay: str,
    width: str,
    keys: Sequence[str],
    value: str,
    scale: int,
    buckets: int = 16,
) -> LatestState:
    """Keep the counts of all windows, open or closed, in a ``LatestState`` at ``path``; run until the
    input is used up.

    The query is in update mode: a batch gives the windows that it changed. A window only gains
    rows, so of two states of it that with more rows is the newer one, and merging a batch once
    more changes nothing. Rows behind the watermark by then are in no window.
    """
    state = table(stream, path, time, delay, width, keys, value, scale, buckets)
    counted = _keyed(windows.tumbling_counts(stream, time, delay, width, keys, value, scale), keys)
    query = (
        counted.writeStream.outputMode("update")
        .foreachBatch(state.merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return state


def table(stream, path, time, delay, width, keys, value, scale, buckets: int = 16) -> LatestState:
    """The table that ``provisional_counts`` with the same parameters keeps."""
    counted = _keyed(windows.tumbling_counts(stream, time, delay, width, keys, value, scale), keys)
    return LatestState(stream.sparkSession, path, counted.schema, KEY, ["n_events"], buckets)


def _keyed(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    # one text stands for window and keys, null being a key like others
    parts = F.to_json(F.struct("window_start", *keys), {"ignoreNullFields": "false"})
    return counted.withColumn(KEY, parts)
