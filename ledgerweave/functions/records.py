"""Streams of variable-length records in a binary column, as rows.

A record is one byte for its kind, four for the length of its body (big-endian), and the body. A
value holds any number of records, one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = 5  # bytes before a record's body


def _cut(data: bytes) -> tuple[list[tuple[int, int, int]], int]:
    """(kind, begin, end) of the records of a value, and how many bytes of it were understood."""
    out, at, size = [], 0, len(data)
    while at + HEAD <= size:
        end = at + HEAD + int.from_bytes(data[at + 1 : at + HEAD], "big")
        if end > size:
            break
        out.append((data[at], at + HEAD, end))
        at = end
    return out, at


class _Records:
    """Takes Arrow batches of (key, data); gives key, place, kind and body of each record."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        key, data = batch.column(0), batch.column(1)
        rows, places, kinds, bodies = [], [], [], []
        for row, value in enumerate(data.to_pylist()):
            if value is None:
                continue
            found, understood = _cut(value)
            for place, (kind, begin, end) in enumerate(found):
                rows.append(row)
                places.append(place)
                kinds.append(kind)
                bodies.append(value[begin:end])
            if understood < len(value):  # what is left is no record
                rows.append(row)
                places.append(len(found))
                kinds.append(None)
                bodies.append(value[understood:])
        yield pa.table(
            {
                "key": key.take(pa.array(np.array(rows, dtype=np.int64))),
                "place": pa.array(places, pa.int32()),
                "kind": pa.array(kinds, pa.int32()),
                "body": pa.array(bodies, pa.binary()),
            }
        )


def record_rows(df: DataFrame, key: str, data: str) -> DataFrame:
    """``key, place, kind, body``: a row for each record in the binary column ``data``.

    A table function over the whole table, on Arrow batches. ``place`` counts from 0 within a value.
    What is left of a value after its last whole record (a cut head or body) is one more row
    with a null kind. Null and empty values have no rows. Rows of equal keys are not told apart;
    other columns are not read.
    """
    narrow = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{data}`").alias("data"))
    kind = narrow.schema["key"].dataType.simpleString()
    records = F.arrow_udtf(_Records, returnType=f"key {kind}, place int, kind int, body binary")
    return records(narrow.asTable()).withColumnRenamed("key", key)
