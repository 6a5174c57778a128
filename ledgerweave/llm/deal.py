"""Distinct texts kept once, and packed rows that send small records to shards.

``distinct_texts`` writes each different text once, compressed, in a table bucketed by its key.
Later joins by the key then move only the other, narrow side.

``Packed`` rows carry what one chunk of texts sends to one shard: a text's key once, its
records as packed binary. A posting of some bytes so costs little more than these bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import CHUNK_BYTES, as_bytes, mix
from ledgerweave.session import in_buckets, shuffle_width, written

KEY = ["k1", "k2"]
SHARD_BYTES = 48_000_000  # text whose records one shard receives
SHARDS_PER_BUCKET = 4  # reports are much smaller than records


def text_key(text: bytes) -> tuple[int, int]:
    """128 bits that stand for a text, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(text)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(
        digest[8:], "big", signed=True
    )


def unpacked(batch: pa.RecordBatch) -> list[bytes]:
    reader = zstandard.ZstdDecompressor()
    return [reader.decompress(z) for z in batch.column("z").to_pylist()]


def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of rows of ``distinct_texts`` and their texts, about CHUNK_BYTES at a time."""
    for batch in batches:
        ends = np.cumsum(batch.column("n_bytes").to_numpy())
        begin, before = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            end = min(end, begin + 60_000)
            part = batch.slice(begin, end - begin)
            yield part, unpacked(part)
            begin, before = end, ends[end - 1]


def heads(part: pa.RecordBatch) -> dict[str, np.ndarray]:
    """What a shard is told of each text: its key, and whether it has copies."""
    return {
        "k1": part.column("k1").to_numpy(),
        "k2": part.column("k2").to_numpy(),
        "twice": (part.column("copies").to_numpy() > 1).astype(np.uint8),
    }


HEADS = {"count": "<i4", "k1": "<i8", "k2": "<i8", "twice": "u1"}


def _packed_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        found: dict[tuple[int, int], list] = {}
        for text in as_bytes(batch.column(0)):
            key = text_key(text)
            if key in found:
                found[key][1] += 1
            else:
                found[key] = [writer.compress(text), 1, len(text)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in found], pa.int64()),
                pa.array([k[1] for k in found], pa.int64()),
                pa.array([v[1] for v in found.values()], pa.int64()),
                pa.array([v[2] for v in found.values()], pa.int64()),
                pa.array([v[0] for v in found.values()], pa.binary()),
            ],
            names=["k1", "k2", "copies", "n_bytes", "z"],
        )


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Table ``k1, k2, copies, n_bytes, z``: each different text once; null counts as empty.

    Copies meet within a batch first, so a text that fills a third of all rows sends one row
    for each batch. The table is bucketed by the key.
    """
    texts = (
        docs.select(F.col(f"`{text}`").alias("text"))
        .mapInArrow(_packed_texts, "k1 long, k2 long, copies long, n_bytes long, z binary")
        .repartition(shuffle_width(docs.sparkSession), *KEY)
        .groupBy(*KEY)
        .agg(
            F.sum("copies").alias("copies"),
            F.first("n_bytes").alias("n_bytes"),
            F.first("z").alias("z"),
        )
    )
    return in_buckets(texts, KEY, "distinct-texts", compression="none")[0]


def keyed(docs: DataFrame, text: str = "text", *columns: str) -> DataFrame:
    """``columns`` of the documents and the key of each text; no text leaves the task."""

    def keys(batches):
        for batch in batches:
            pairs = [text_key(t) for t in as_bytes(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([p[0] for p in pairs], pa.int64()),
                    pa.array([p[1] for p in pairs], pa.int64()),
                ],
                names=[*batch.schema.names[:-1], *KEY],
            )

    narrow = docs.select(
        *[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("__text")
    )
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]]
        + ["k1 long", "k2 long"]
    )
    return narrow.mapInArrow(keys, schema)


def shard_count(total_bytes: int | None, spark, shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for so much text; small inputs get some too, to use the cores."""
    return max(min(12, shuffle_width(spark)), math.ceil((total_bytes or 0) / shard_bytes))


def binary(data: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
    """Binary values: ``data`` cut at ``ends`` (counted in items of ``width`` bytes)."""
    offsets = np.append(0, ends).astype(np.int64) * width
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).cast(pa.binary())


def dealt(
    shard: np.ndarray, doc: np.ndarray, heads: dict[str, np.ndarray], items: dict[str, np.ndarray]
) -> pa.RecordBatch:
    """A row for each shard that gets something.

    ``shard`` and ``doc`` say for each item where it goes and whose it is (``doc`` must not
    decrease); ``heads`` holds values of each doc, ``items`` of each item. A row has column
    ``count`` (items of each doc in it) and each head and item column, packed.
    """
    order = np.argsort(shard, kind="stable")
    shard, doc = shard[order], doc[order]
    places = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else order
    new = np.append(True, (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1])) if len(shard) else []
    begins = np.flatnonzero(new)
    ends = np.append(places[1:], len(shard)) if len(shard) else places
    head_ends = np.searchsorted(begins, ends)
    counts = np.diff(np.append(begins, len(shard))).astype(np.int32)
    columns = {"shard": pa.array(shard[places].astype(np.int32))}
    columns["count"] = binary(counts, head_ends, 4)
    for name, values in heads.items():
        columns[name] = binary(values[doc[begins]], head_ends, values.itemsize)
    for name, values in items.items():
        columns[name] = binary(np.ascontiguousarray(values[order]), ends, values.itemsize)
    return pa.RecordBatch.from_pydict(columns)


def dealt_schema(*names: str) -> str:
    return ", ".join(["shard int", "count binary", *[f"{n} binary" for n in names]])


def gathered(batches: Iterable[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """All packed rows of a task put together; ``kinds`` gives each column's numpy type."""
    parts: dict[str, list[bytes]] = {name: [] for name in kinds}
    for batch in batches:
        for name in kinds:
            parts[name].extend(batch.column(batch.schema.get_field_index(name)).to_pylist())
    out = {}
    for name, kind in kinds.items():
        out[name] = np.frombuffer(b"".join(parts.pop(name)), dtype=kind)
    return out


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``values``, and the number of the group of each sorted value."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(values) else np.zeros(0, dtype=bool)
    return order, np.cumsum(new) - 1


def by_shard(
    batches: Iterable[pa.RecordBatch], kinds: dict[str, str]
) -> Iterator[dict[str, np.ndarray]]:
    """What each of a task's shards got, one after the other; ``shard`` is its number."""
    rows: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        for s in np.unique(shard):
            rows.setdefault(int(s), []).append(batch.filter(pa.array(shard == s)))
    for s in sorted(rows):
        yield gathered(rows.pop(s), kinds) | {"shard": s}


REPORT = {"k1": "<i8", "k2": "<i8", "shard": "<i4", "size": "<i4", "bits": "u1"}


def report(got: dict, found: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """For each text of a shard with anything ``found`` a bit for each of its items, packed in
    a row for each bucket of texts. ``doc`` says whose an item is and does not decrease."""
    n = len(got["count"])
    some = np.flatnonzero(np.bincount(doc[found], minlength=n))
    bucket = (mix(got["k1"][some].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, bucket = some[order], bucket[order]
    begins = np.searchsorted(doc, np.arange(n + 1))
    bits = [np.packbits(found[begins[d] : begins[d + 1]]) for d in some]
    sizes = np.array([len(b) for b in bits], dtype=np.int32)
    packed = np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint8)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(some) else some
    ends = np.append(cuts[1:], len(some)) if len(some) else some
    byte_ends = np.append(0, np.cumsum(sizes, dtype=np.int64))[ends]
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(bucket[cuts], pa.int32()),
            "k1": binary(np.ascontiguousarray(got["k1"][some]), ends, 8),
            "k2": binary(np.ascontiguousarray(got["k2"][some]), ends, 8),
            "shard": binary(np.full(len(some), got["shard"], dtype=np.int32), ends, 4),
            "size": binary(sizes, ends, 4),
            "bits": binary(packed, byte_ends, 1),
        }
    )


def _merged(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """All reports of a text in one row; they are in the order of the shards."""
    got = gathered(batches, REPORT)
    order = np.lexsort((got["shard"], got["k2"], got["k1"]))
    ends = np.cumsum(got["size"], dtype=np.int64)
    bits = got["bits"].tobytes()
    k1, k2 = got["k1"][order], got["k2"][order]
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))[: len(k1)]
    cuts = np.append(np.flatnonzero(new), len(k1))
    kind = pa.struct([("shard", pa.int32()), ("bits", pa.binary())])
    for first in range(0, len(cuts) - 1, 5_000):
        last = min(first + 5_000, len(cuts) - 1)
        rows = order[cuts[first] : cuts[last]]
        reports = pa.StructArray.from_arrays(
            [
                pa.array(got["shard"][rows]),
                pa.array([bits[ends[r] - got["size"][r] : ends[r]] for r in rows], pa.binary()),
            ],
            fields=list(kind),
        )
        yield pa.RecordBatch.from_pydict(
            {
                "k1": pa.array(k1[cuts[first:last]]),
                "k2": pa.array(k2[cuts[first:last]]),
                name: pa.ListArray.from_arrays(
                    pa.array(cuts[first : last + 1] - cuts[first], pa.int32()), reports
                ),
            }
        )


REPORTS = "array<struct<shard:int,bits:binary>>"


def round_trip(sent: DataFrame, shards: int, meet, name: str) -> DataFrame:
    """Table ``k1, k2, name``: what all shards report on the items that they were ``sent``.

    A task has one shard, or one bucket of reports. The number of both follows the bytes of text.
    """
    buckets = max(shuffle_width(sent.sparkSession), math.ceil(shards / SHARDS_PER_BUCKET))
    reports = sent.repartitionById(shards, "shard").mapInArrow(
        partial(meet, buckets=buckets),
        "bucket int, k1 binary, k2 binary, shard binary, size binary, bits binary",
    )
    merged = reports.repartitionById(buckets, "bucket").mapInArrow(
        partial(_merged, name=name), f"k1 long, k2 long, {name} {REPORTS}"
    )
    return written(merged, name)[0]


def with_reports(texts: DataFrame, reports: DataFrame, name: str) -> DataFrame:
    """``texts`` with the reports on each, none being an empty list."""
    joined = texts.join(reports, KEY, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(REPORTS)))


def told(column: pa.Array, doc: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Mask of the items that were reported. ``column`` has each text's reports; the items of
    a text and shard must be in the order in which they were sent."""
    mask = np.zeros(len(doc), dtype=bool)
    if not len(doc):
        return mask
    where = doc * shards + shard
    order = np.argsort(where, kind="stable")
    where = where[order]
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    keys = rows * shards + flat.field("shard").to_numpy()
    begins = np.searchsorted(where, keys)
    ends = np.searchsorted(where, keys, side="right")
    for begin, end, bits in zip(begins, ends, flat.field("bits").to_pylist(), strict=True):
        mask[order[begin:end]] = np.unpackbits(
            np.frombuffer(bits, np.uint8), count=end - begin
        ).astype(bool)
    return mask
