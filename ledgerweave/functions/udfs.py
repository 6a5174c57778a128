"""Record decoding and combining on Arrow batches, a weighted mean, and JSON members as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_records(df: DataFrame, keep: Sequence[str], binary: str, fields: Sequence[str]) -> DataFrame:
    """Decode a binary column of fixed-width records into bigint columns.

    A record is ``len(fields)`` big-endian signed 64-bit integers. A value of any other
    length, and null, decodes to nulls.
    """
    names = list(fields)
    keep = list(keep)
    width = 8 * len(names)
    schema = ", ".join(
        [f"`{name}` {df.schema[name].dataType.simpleString()}" for name in keep]
        + [f"`{name}` bigint" for name in names]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(binary))
            good = pc.fill_null(pc.equal(pc.binary_length(raw), width), False)
            # whole records lie one after the other in the buffer of the values
            whole = raw.filter(good).cast(pa.large_binary())
            offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset :]
            begin = int(offsets[0]) if len(whole) else 0
            values = np.frombuffer(whole.buffers()[2] or b"", dtype=np.uint8)
            table = np.zeros((len(raw), len(names)), dtype=np.int64)
            mask = good.to_numpy(zero_copy_only=False)
            packed = values[begin : begin + len(whole) * width]
            table[mask] = packed.view(">i8").reshape(-1, len(names))
            columns = [batch.column(batch.schema.get_field_index(name)) for name in keep]
            decoded = [
                pa.array(table[:, i], type=pa.int64(), mask=~mask) for i in range(len(names))
            ]
            yield pa.RecordBatch.from_arrays(columns + decoded, names=keep + names)

    return df.select(*keep, binary).mapInArrow(decode, schema)


def combine_batches(
    df: DataFrame, partial: Callable[[pa.Table], pa.Table], schema: str
) -> DataFrame:
    """Apply ``partial`` to each Arrow batch where it lies: a combine step before a shuffle.

    Works on streams too. ``partial`` should return one row per key of the batch.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from partial(pa.Table.from_batches([batch])).to_batches()

    return df.mapInArrow(combine, schema)


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Sum of weight times value over the sum of weights, per key; built-in sums do it.

    Rows where either is null count in neither sum; NaN makes the result NaN, as in other
    sums; weights that add up to zero give null.
    """
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")
    both = x.isNotNull() & w.isNotNull()
    sums = df.groupBy(*keys).agg(
        F.sum(F.when(both, w * x)).alias("_wx"), F.sum(F.when(both, w)).alias("_w")
    )
    return sums.select(*keys, F.try_divide("_wx", "_w").alias("weighted_mean"))


def json_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per member of the JSON object in ``column``: strings as they are, other values
    as JSON. Text that is no JSON object has no members."""
    parsed = F.try_parse_json(F.col(column))
    flat = df.select(F.col(key), parsed.alias("_parsed"))
    members = flat.filter(F.startswith(F.schema_of_variant("_parsed"), F.lit("OBJECT")))
    exploded = members.lateralJoin(
        flat.sparkSession.tvf.variant_explode(F.col("_parsed").outer())
    ).filter(F.col("key").isNotNull())
    text = F.coalesce(
        F.when(F.schema_of_variant("value") == "STRING", F.expr("try_variant_get(value, '$', 'string')")),
        F.to_json("value"),
    )
    return exploded.select(F.col(key), "key", text.alias("value"))
