"""Media payloads in archive files, written and read by a Spark data source.

An archive directory holds archive files. Each has its members' bytes one after the other,
then a directory (offset, length, checksum and id of each member), then a fixed trailer that
says where the directory is. The source

* plans byte ranges of about ``partition_bytes`` of each file from the list of files alone; a
  task reads its file's directory and takes the members that begin in its range,
* streams the payloads of a partition as Arrow batches of bounded size, and
* reads a member again, by its own offset and from a file opened anew, if reading it fails or its
  checksum is wrong; other members of the partition are not read again.

Members are grey PNG images 64 samples wide: a lossless form of 8-bit samples.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from ledgerweave.llm.text import as_bytes
from ledgerweave.session import scratch_path

FORMAT = "media_archive"
SUFFIX = ".media"
PARTITION_BYTES = 8_000_000
BATCH_BYTES = 4_000_000
ATTEMPTS = 4
RENAMES = 16  # files given their final names at once
WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
LENGTH = b"lnTh"  # by its letters: private, may be skipped and copied
TRAILER = struct.Struct("<QQI4s")  # directory's offset, members, its checksum, mark
MARK = b"MDA1"
DIRECTORY = np.dtype([("offset", "<u8"), ("length", "<u8"), ("crc", "<u4"), ("id", "<i8"),
                      ("known", "u1")])


# the media form


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, content: int) -> bytes:
    """8-bit samples, a positive multiple of WIDTH, as a grey image. A private chunk says how
    many of the samples are ``content``, the rest being padding."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each with filter 0 before it
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    body = zlib.compress(lines.tobytes(), 6)
    length = _chunk(LENGTH, struct.pack(">Q", content))
    return PNG + _chunk(b"IHDR", head) + length + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """Samples and content size of an image that ``to_png`` made; ValueError if damaged."""
    if image[:8] != PNG:
        raise ValueError("not a PNG image")
    at, body, head, content = 8, [], None, 0
    while at < len(image):
        (length,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + length]
        (crc,) = struct.unpack_from(">I", image, at + 8 + length)
        if zlib.crc32(kind + data) != crc:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == LENGTH:
            (content,) = struct.unpack(">Q", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + length
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    lines = lines.reshape(head[1], head[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes(), content


def padded(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of WIDTH."""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def feature(samples: bytes) -> str:
    """Size, mean, spread and entropy of the samples, as text."""
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    n = int(counts.sum())
    values = np.arange(256)
    mean = float((counts * values).sum()) / n
    spread = float((counts * values * values).sum()) / n - mean * mean
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    return f"{WIDTH}x{n // WIDTH} mean={mean:.4f} var={spread:.4f} entropy={entropy:.4f}"


# files, wherever they are


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or ":" in path else f"file://{path}")


def archive_files(path: str) -> list[tuple[str, int]]:
    store, place = _store(path)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(SUFFIX))


def read_directory(store: fs.FileSystem, file: str, size: int) -> np.ndarray:
    """The members of one archive; reads the trailer and the directory only."""
    with store.open_input_file(file) as source:
        offset, members, crc, mark = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        raw = source.read_at(members * DIRECTORY.itemsize, offset)
    if mark != MARK or zlib.crc32(raw) != crc:
        raise ValueError(f"{file} has no whole directory")
    return np.frombuffer(raw, dtype=DIRECTORY)


class OpenFile:
    """A file for reading, opened when it is first needed and again after ``renew``."""

    def __init__(self, open_it: Callable):
        self.open_it, self.file = open_it, None

    def read_at(self, length: int, offset: int) -> bytes:
        if self.file is None:
            self.file = self.open_it()
        return self.file.read_at(length, offset)

    def renew(self) -> None:
        """Let go of the file: its connection may be lost."""
        lost, self.file = self.file, None
        if lost is not None:
            with contextlib.suppress(OSError):
                lost.close()


def read_member(
    source, offset: int, length: int, crc: int, attempts: int = ATTEMPTS, wait: float = 0.05
) -> bytes:
    """One member by its offset, tried again on its own, with the file opened anew, if it fails."""
    for attempt in range(attempts):
        try:
            payload = source.read_at(length, offset)
            if len(payload) == length and zlib.crc32(payload) == crc:
                return payload
            problem: Exception = ValueError(f"wrong checksum at offset {offset}")
        except OSError as error:
            problem = error
        source.renew()
        if attempt + 1 < attempts:
            time.sleep(wait * 2**attempt)
    raise problem


# the data source


@dataclass
class ByteRange(InputPartition):
    """The members of one file that begin in a range of its bytes."""

    file: str
    size: int
    begin: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> list[ByteRange]:
        """From the size of each file alone; a task reads the directory of its file."""
        return [
            ByteRange(file, size, begin, begin + self.partition_bytes)
            for file, size in archive_files(self.path)
            for begin in range(0, size, self.partition_bytes)
        ]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        store, _ = _store(self.path)
        members = read_directory(store, partition.file, partition.size)
        first, last = np.searchsorted(members["offset"], [partition.begin, partition.end])
        name = partition.file.rsplit("/", 1)[-1]
        rows, held = [], 0
        source = OpenFile(partial(store.open_input_file, partition.file))
        try:
            for number in range(first, last):
                m = members[number]
                payload = read_member(source, int(m["offset"]), int(m["length"]), int(m["crc"]))
                rows.append((number, m, payload))
                held += len(payload)
                if held >= BATCH_BYTES:
                    yield self._batch(name, rows)
                    rows, held = [], 0
        finally:
            source.renew()
        if rows:
            yield self._batch(name, rows)

    @staticmethod
    def _batch(name: str, rows: list) -> pa.RecordBatch:
        ids = [int(m["id"]) if m["known"] else None for _, m, _ in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([name] * len(rows), pa.string()),
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([int(m["offset"]) for _, m, _ in rows], pa.int64()),
                pa.array([p for _, _, p in rows], pa.binary()),
            ],
            names=["id", "archive", "member", "offset", "payload"],
        )


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class ArchiveWriter(DataSourceArrowWriter):
    """A task writes one archive under a name of its own and gives it its final name when it is
    whole; a repeated task writes another file, and only the files of the commit stay."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, place = _store(self.path)
        store.create_dir(place, recursive=True)
        file = f"{place}/{uuid.uuid4().hex}.part"
        try:
            whole = self._filled(store, file, iterator)
        except BaseException:
            with contextlib.suppress(OSError):
                store.delete_file(file)
            raise
        if not whole:
            store.delete_file(file)
            return Written(None)
        return Written(file)

    @staticmethod
    def _filled(store: fs.FileSystem, file: str, iterator: Iterator[pa.RecordBatch]) -> bool:
        directory, offset = [], 0
        with store.open_output_stream(file) as out:
            for batch in iterator:
                for i, payload in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
                ):
                    out.write(payload)
                    crc = zlib.crc32(payload)
                    directory.append((offset, len(payload), crc, i or 0, i is not None))
                    offset += len(payload)
            raw = np.array(directory, dtype=DIRECTORY).tobytes()
            out.write(raw + TRAILER.pack(offset, len(directory), zlib.crc32(raw), MARK))
        return bool(directory)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        files = [m.file for m in messages if m and m.file]
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda f: store.move(f, f.removesuffix(".part") + SUFFIX), files))

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            if message and message.file:
                store.delete_file(message.file)


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)`` gives id, archive, member, offset and
    payload; option ``partition_bytes`` sets the size of a partition."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id long, archive string, member long, offset long, payload binary"

    def reader(self, schema) -> ArchiveReader:
        size = int(self.options.get("partition_bytes", PARTITION_BYTES))
        return ArchiveReader(self.options["path"], size)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def _to_media(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images, ids, held = [], [], 0
        texts = as_bytes(batch.column(1))
        for i, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            images.append(to_png(padded(text), len(text)))
            ids.append(i)
            held += len(images[-1])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["id", "payload"]
                )
                images, ids, held = [], [], 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["id", "payload"]
        )


def _describe(batches: Iterable[pa.RecordBatch], id_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for image in batch.column("payload").to_pylist():
            samples, content = from_png(image)
            rows.append(
                (
                    content,
                    len(samples),
                    hashlib.sha256(samples).hexdigest(),
                    zlib.crc32(samples[-WIDTH:]),
                    len(image),
                    hashlib.sha256(image).hexdigest(),
                    feature(samples),
                )
            )
        columns = list(zip(*rows, strict=True)) or [()] * len(DESCRIBED)
        kinds = [pa.string() if k == "string" else pa.int64() for k in DESCRIBED.values()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
             batch.column("archive"), batch.column("offset")],
            names=[id_name, *DESCRIBED, "archive", "offset"],
        )


DESCRIBED = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long",
    "media_bytes": "long", "media_sha256": "string", "feature": "string",
}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


def store_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> None:
    """Write each row's text (null: empty) as a member of the archives in ``path``.

    Ids are whole numbers or null; others raise TypeError.
    """
    kind = docs.schema[id_column].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"ids must be whole numbers, {id_column} is {kind.simpleString()}")
    register(docs.sparkSession)
    (
        docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(_to_media, "id long, payload binary")
        .write.format(FORMAT)
        .mode("append")
        .save(path)
    )


def read_media(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``id, archive, member, offset, payload`` of all members in ``path``."""
    register(spark)
    return spark.read.format(FORMAT).option("partition_bytes", partition_bytes).load(path)


def describe(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What is stored of each member, read back: sizes, digests and a feature text."""
    return media.mapInArrow(
        partial(_describe, id_name=id_column),
        f"`{id_column}` long, "
        + "".join(f"{name} {kind}, " for name, kind in DESCRIBED.items())
        + "archive string, offset long",
    )


def media_column(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as media in a scratch folder, read it back and describe it.

    One row for each row of ``docs``. Null and empty texts are one line of zeros. Ids are whole
    numbers (else TypeError), and may be null or repeated; other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    store_texts(docs, path, id_column, text)
    return describe(read_media(spark, path), id_column)
