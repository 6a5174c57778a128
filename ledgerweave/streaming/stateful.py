"""Totals per key that live across micro-batches, with custom state.

Amounts are whole numbers of the smallest unit (``base_units``) with up to 38 digits, so that
the state is exact; a total with more digits is an error. Null amounts add nothing.
All forms add rows up before the shuffle, per Arrow batch or a few of them: a key that holds a
third of all rows reaches its task as one row per batch instead of one per event.
``expiring_totals`` lets go of keys that have been idle; the other two keep every key for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from ledgerweave.functions.udfs import combine_batches

_STATE = "n_rows bigint, total decimal(38,0)"
_MOST = Decimal(10) ** 38
# the usual 28 digits would round sums
_EXACT = Context(prec=60)


def _partials(stream: DataFrame, key: str, units: str) -> DataFrame:
    kind = stream.schema[key].dataType.simpleString()
    total = F.coalesce(F.col(units).cast("decimal(38,0)"), F.lit(0)).cast("decimal(38,0)")
    narrow = stream.select(key, total.alias("total"))

    def add_up(table: pa.Table) -> pa.Table:
        summed = table.group_by(key).aggregate([([], "count_all"), ("total", "sum")])
        summed = summed.select([key, "count_all", "total_sum"]).rename_columns([key, "n_rows", "total"])
        return summed.set_column(2, "total", summed.column("total").cast(pa.decimal128(38, 0)))

    return combine_batches(narrow, add_up, f"`{key}` {kind}, {_STATE}")


def _added(n: int, total: Decimal, batches) -> tuple[int, Decimal]:
    for batch in batches:
        n += int(batch["n_rows"].sum())
        for value in batch["total"]:
            total = _EXACT.add(total, value)
    if abs(total) >= _MOST:
        raise OverflowError("a total has more than 38 digits")
    return n, total


def _output(stream: DataFrame, key: str) -> str:
    return f"`{key}` {stream.schema[key].dataType.simpleString()}, {_STATE}"


def running_totals(stream: DataFrame, key: str, units: str) -> DataFrame:
    """Per key the number of rows and the total so far, one row per key and micro-batch.

    State is kept for every key for ever: a total of everything has no point at which it
    could be dropped. It grows with the number of keys, not with the number of rows.
    """

    def update(
        keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        n, total = _added(*(state.get if state.exists else (0, Decimal(0))), batches)
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n_rows": [n], "total": [total]})

    return (
        _partials(stream, key, units)
        .groupBy(key)
        .applyInPandasWithState(update, _output(stream, key), _STATE, "append", "NoTimeout")
    )


class TotalsProcessor(StatefulProcessor):
    """Keeps (rows, total) per key in one value state."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total = _added(*(self.state.get() if self.state.exists() else (0, Decimal(0))), rows)
        self.state.update((n, total))
        yield pd.DataFrame({self.key: [key[0]], "n_rows": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals_v2(stream: DataFrame, key: str, units: str) -> DataFrame:
    """The same on the state-processor API; needs the RocksDB state store."""
    return (
        _partials(stream, key, units)
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=TotalsProcessor(key),
            outputStructType=_output(stream, key),
            outputMode="append",
            timeMode="None",
        )
    )


BUCKETS = 1024
_PACKED_ROWS = 100_000  # rows that a task adds up and packs at a time


def _kept(kind: pa.DataType) -> pa.Schema:
    """What is kept of a key. Totals have room for sums of which only the last must have 38 digits."""
    total = pa.decimal256(76, 0)
    return pa.schema({"key": kind, "n_rows": pa.int64(), "total": total, "last_millis": pa.int64()}.items())


def _summed(table: pa.Table, keys: list[str], kept: pa.Schema) -> pa.Table:
    """One row per key, in the columns of ``kept`` behind other keys."""
    groups = table.group_by(keys, use_threads=False)
    out = groups.aggregate([("n_rows", "sum"), ("total", "sum"), ("last_millis", "max")])
    out = out.select([*keys, "n_rows_sum", "total_sum", "last_millis_max"])
    out = out.rename_columns([*keys, *kept.names[1:]])
    return out.cast(pa.schema([out.schema.field(k) for k in keys if k not in kept.names] + list(kept)))


def _packed(stream: DataFrame, key: str, units: str, time: str, buckets: int, kept: pa.Schema) -> DataFrame:
    """``bucket, partials``: sums per key of some rows, those of one bucket of keys as one record batch."""
    narrow = stream.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(key).alias("key"),
        F.lit(1).cast("bigint").alias("n_rows"),
        F.coalesce(F.col(units).cast("decimal(38,0)"), F.lit(0)).cast("decimal(38,0)").alias("total"),
        F.unix_millis(F.col(time).cast("timestamp")).alias("last_millis"),
    )
    read = pa.schema([pa.field("bucket", pa.int32()), *kept])

    def pack(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _summed(pa.Table.from_batches(some).cast(read), ["bucket", "key"], kept)
        table = table.sort_by("bucket").combine_chunks()
        numbers, starts = np.unique(table.column("bucket").to_numpy(), return_index=True)
        rows = table.drop_columns("bucket").to_batches()[0]
        ends = [*starts[1:], len(rows)]
        whole = [rows.slice(a, b - a).serialize().to_pybytes() for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(whole)], ["bucket", "partials"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some += [batch] if batch.num_rows else []
            if sum(len(b) for b in some) >= _PACKED_ROWS:
                yield from pack(some)
                some = []
        if some:
            yield from pack(some)

    return narrow.mapInArrow(packed, "bucket int, partials binary")


class ExpiringProcessor(StatefulProcessor):
    """Keeps (rows, total, time of the last row) of a bucket's keys in one value state, as a record
    batch, and one timer for when the first of them will be idle."""

    def __init__(self, key: str, idle_millis: int, kept: pa.Schema):
        self.key = key
        self.idle_millis = idle_millis
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", "kept binary")

    def _read(self, packed: bytes) -> pa.Table:
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(packed)), self.kept)])

    def _held(self) -> pa.Table:
        return self._read(self.state.get()[0]) if self.state.exists() else self.kept.empty_table()

    def _keep(self, table: pa.Table) -> None:
        if not len(table):
            return self.state.clear()
        self.state.update((table.combine_chunks().to_batches()[0].serialize().to_pybytes(),))

    def _due(self, table: pa.Table) -> int | None:
        """When the first key will be idle."""
        first = pc.min(table.column("last_millis")).as_py()
        return None if first is None else first + self.idle_millis

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        arrived = [self._read(packed) for frame in rows for packed in frame["partials"]]
        table = _summed(pa.concat_tables([held, *arrived]), ["key"], self.kept)
        largest = pc.max(pc.abs(table.column("total"))).as_py()
        if largest >= _MOST:
            raise OverflowError("a total has more than 38 digits")
        # rows without any time are due at once
        timeless = max(0, timerValues.getCurrentWatermarkInMs()) - self.idle_millis
        last = pc.fill_null(table.column("last_millis"), timeless)
        table = table.set_column(3, self.kept.field(3), last)
        self._keep(table)
        before, due = self._due(held), self._due(table)
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        idle_since = timerValues.getCurrentWatermarkInMs() - self.idle_millis
        idle = pc.less_equal(held.column("last_millis"), idle_since)
        gone, rest = held.filter(idle), held.filter(pc.invert(idle))
        self._keep(rest)
        if len(rest):
            self.handle.registerTimer(self._due(rest))
        if len(gone):
            yield pd.DataFrame(
                {
                    # whole numbers beside nulls stay whole
                    self.key: gone.column("key").to_pandas(integer_object_nulls=True),
                    "n_rows": gone.column("n_rows").to_pandas(),
                    "total": gone.column("total").to_pandas(),
                    "last_time": pd.to_datetime(gone.column("last_millis").to_pandas(), unit="ms", utc=True),
                }
            )

    def close(self) -> None:
        pass


def expiring_totals(
    stream: DataFrame,
    key: str,
    units: str,
    time: str,
    delay: str,
    idle_seconds: int,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per key the number of rows, the total and the time of the last row, once it has been idle.

    A key is idle when the watermark (the newest time of the stream less ``delay``) has reached
    its last row's time plus ``idle_seconds``. It then gives one row, and its state goes; rows that
    come later begin a new total. So state grows with the keys that are active, not with all
    there ever were. A batch's rows count before its timers are looked at, and the watermark of a
    batch is that of the rows before it. Rows behind the watermark are added like others. Times
    count in milliseconds; a key of rows without time is due with the next watermark.

    Keys are hashed into ``buckets``, and a bucket is what the state store knows: it is called, read,
    written and timed once per micro-batch, and its keys are added up as columns. A micro-batch writes
    the whole buckets it touches, some 60 bytes a key; choose ``buckets`` so that one holds some
    thousand active keys. The number is fixed with the first micro-batch of a checkpoint.

    Timers follow event time, so ``availableNow`` ends as soon as its input is used up, and results do
    not depend on the clock. Needs the RocksDB state store.
    """
    marked = stream.withWatermark(time, delay)
    kind = stream.schema[key].dataType
    kept = _kept(to_arrow_type(kind))
    return (
        _packed(marked, key, units, time, buckets, kept)
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=ExpiringProcessor(key, int(idle_seconds) * 1000, kept),
            outputStructType=f"`{key}` {kind.simpleString()}, {_STATE}, last_time timestamp",
            outputMode="append",
            timeMode="EventTime",
        )
    )
