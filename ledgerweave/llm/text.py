"""Words and hashes of many texts at once, as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LONG_WORD = 1024  # bytes from which a word is hashed by itself
CHUNK_BYTES = 4_000_000  # text handled at once; arrays of a chunk take some ten times as much

_U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of at most ``most`` bytes, or one text."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and (size + len(text) > most or i - begin >= 60_000):
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of a column in UTF-8; null gives an empty text."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


class Words:
    """The words (runs of bytes that are no ASCII white space) of some texts.

    ``start`` and ``end`` are places in ``buffer``, ``doc`` is the place of a word's text in
    the list, ``first`` the number of the first word of each text, with one more at the end.
    """

    def __init__(self, texts: list[bytes], fold: bool = False):
        joined = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, dtype=np.uint8)
        self.buffer = LOWER[joined] if fold else joined
        blank = SPACE[joined]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_start = 1 + np.cumsum(lengths + 1) - (lengths + 1)
        self.first = np.append(np.searchsorted(self.start, self.text_start), len(self.start))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, of its bytes alone."""
        word8 = np.ndarray(len(self.buffer) - 7, dtype="<u8", buffer=self.buffer, strides=(1,))
        length = self.end - self.start
        h = mix(length.astype(_U), seed)
        live = np.flatnonzero(length < LONG_WORD)
        at, left = self.start[live], length[live]
        while len(live):
            piece = word8[at]
            short = left < 8
            piece[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
            h[live] = mix(h[live] ^ piece)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for i in np.flatnonzero(length >= LONG_WORD):
            whole = self.buffer[self.start[i] : self.end[i]].tobytes()
            h[i] = xxhash.xxh3_64_intdigest(whole, seed=seed)
        return h


def rolling(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values; the result is ``width - 1`` shorter.

    Runs are put together from runs of powers of two, so the cost grows with log(width).
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out, used, power, size = None, 0, mix(h, seed), 1
    while True:
        if width & size:
            part = power[used : used + n]
            out = part if out is None else mix(out * _U(0x9FB21C651E98DF25) + part, size)
            used += size
        if size * 2 > width:
            return out
        power = mix(power[:-size] * _U(0xD6E8FEB86659FD93) + power[size:], size + 1)
        size *= 2


def whole_runs(doc: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` words whether it lies in one text."""
    n = len(doc) - width + 1
    return doc[:n] == doc[width - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def texts_of(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the texts of a column, about CHUNK_BYTES of text each."""
    for batch in batches:
        texts = as_bytes(batch.column(name))
        for begin, end in chunks(texts):
            yield batch.slice(begin, end - begin), texts[begin:end]
