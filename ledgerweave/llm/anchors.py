"""Repeated passages found by anchors: fixed blocks of words, looked up by every window.

A passage of ``window`` words, wherever it starts, holds one whole block of its own text,
when texts are cut into blocks of ``(window + 1) // 2`` words. So:

1. Every text sends the hash of each run of block length (the probes) to the shard of that
   hash, with a mark on the runs that are blocks (the index). A shard reports the blocks
   that were met by another run.
2. A reported block is extended to the windows around it, and a 96-bit hash of each such
   window goes to its shard, which reports the windows that start more than once.
3. Windows found are laid together to maximal repeats, whose words are removed.

Both rounds send a fixed number of bytes a word; what a shard holds is bounded by the number
of shards, and copies of a text count as one text with a weight.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm import deal
from ledgerweave.llm.deal import KEY
from ledgerweave.llm.text import Words, mix, rolling, whole_runs

WINDOW = 35
SHARD_BYTES = 20_000_000

_U = np.uint64


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for part, texts in deal.opened(batches):
        yield part, Words(texts)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> _U(40)) * _U(shards)) >> _U(24)).astype(np.int64)


class _Runs:
    """Runs of ``width`` words that lie in one text: hash, text, place in the text."""

    def __init__(self, words: Words, hashes: np.ndarray, width: int):
        inside = np.flatnonzero(whole_runs(words.doc, width))
        self.hash = rolling(hashes, width)[inside]
        self.doc = words.doc[inside]
        self.place = inside - words.first[self.doc]
        self.inside = inside


def _block(window: int) -> int:
    return (window + 1) // 2


def _send_probes(batches, window: int, shards: int):
    """Items: 31 bits of a run's hash and a bit that marks blocks."""
    block = _block(window)
    for part, words in _opened(batches):
        runs = _Runs(words, words.hashes(), block)
        enough = (np.diff(words.first) >= window)[runs.doc]
        h, doc, place = runs.hash[enough], runs.doc[enough], runs.place[enough]
        if len(h):
            items = ((h & _U(0x7FFFFFFF)) << _U(1) | (place % block == 0)).astype(np.uint32)
            yield deal.dealt(_shard(h, shards), doc, deal.heads(part), {"probe": items})


def _meet_blocks(batches, buckets: int):
    for got in deal.by_shard(batches, deal.HEADS | {"probe": "<u4"}):
        doc = np.repeat(np.arange(len(got["count"])), got["count"])
        is_block = (got["probe"] & 1).astype(bool)
        order, group = deal.repeated(got["probe"] >> 1)
        size = np.bincount(group, weights=1 + got["twice"][doc[order]])
        met = np.empty(len(doc), dtype=bool)
        met[order] = size[group] > 1
        yield deal.report(got, met[is_block], doc[is_block], buckets)


def _candidates(part, words: Words, window: int, shards: int):
    """Windows around reported blocks: their hashes of 64 and 32 bits, texts, places."""
    block = _block(window)
    hashes = words.hashes()
    blocks = _Runs(words, hashes, block)
    met = np.zeros(len(words) + 1, dtype=bool)
    own = np.flatnonzero(blocks.place % block == 0)
    shard = _shard(blocks.hash[own], shards)
    own = own[deal.told(part.column("blocks"), blocks.doc[own], shard, shards)]
    met[blocks.inside[own]] = True
    inside = np.flatnonzero(whole_runs(words.doc, window))
    place = inside - words.first[words.doc[inside]]
    inside = inside[met[inside + (-place) % block]]  # the one block that starts in time
    first, second = rolling(hashes, window, 1), rolling(mix(hashes, 7), window, 2)
    return first[inside], second[inside].astype(np.uint32), words.doc[inside], inside


def _send_windows(batches, window: int, shards: int):
    for part, words in _opened(batches):
        first, second, doc, _ = _candidates(part, words, window, shards)
        if len(first):
            items = {"first": first, "second": second}
            yield deal.dealt(_shard(first, shards), doc, deal.heads(part), items)


def _meet_windows(batches, buckets: int):
    for got in deal.by_shard(batches, deal.HEADS | {"first": "<u8", "second": "<u4"}):
        doc = np.repeat(np.arange(len(got["count"])), got["count"])
        order = np.lexsort((got["second"], got["first"]))
        first, second = got["first"][order], got["second"][order]
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        group = np.cumsum(new[: len(order)]) - 1
        size = np.bincount(group, weights=1 + got["twice"][doc[order]])
        again = np.empty(len(doc), dtype=bool)
        again[order] = size[group] > 1
        yield deal.report(got, again, doc, buckets)


def _cut(batches, window: int, shards: int):
    for part, words in _opened(batches):
        first, _, doc, inside = _candidates(part, words, window, shards)
        found = inside[deal.told(part.column("windows"), doc, _shard(first, shards), shards)]
        step = np.zeros(len(words) + 1, dtype=np.int32)
        step[found] += 1
        np.add.at(step, found + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        kept = np.flatnonzero(~gone)
        # bytes of the kept words, each with the white space after it, as one space
        edge = np.zeros(len(words.buffer) + 1, dtype=np.int8)
        edge[words.start[kept]] += 1
        edge[words.end[kept] + 1] -= 1
        taken = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        out = words.buffer[taken]
        spaces = np.cumsum(taken)[words.end[kept]] - 1
        out[spaces] = 32
        per_doc = np.bincount(words.doc[kept], weights=(words.end - words.start)[kept] + 1,
                              minlength=part.num_rows).astype(np.int64)
        ends = np.cumsum(per_doc)
        texts = [
            out[e - n : e - 1].tobytes() if n else b"" for e, n in zip(ends, per_doc, strict=True)
        ]
        yield pa.RecordBatch.from_pydict(
            {
                "k1": part.column("k1"),
                "k2": part.column("k2"),
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "n_removed": pa.array(
                    np.bincount(words.doc[gone], minlength=part.num_rows), pa.int64()
                ),
                "kept": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )


def repeated_passages(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each text of ``deal.distinct_texts``: ``k1, k2, n_words, n_removed, kept``.

    ``kept`` has the words outside all windows that start more than once, joined by a space.
    """
    spark = texts.sparkSession
    shards = deal.shard_count(texts.agg(F.sum("n_bytes")).first()[0], spark, SHARD_BYTES)
    narrow = ["k1", "k2", "twice"]
    blocks = deal.round_trip(
        texts.mapInArrow(
            partial(_send_probes, window=window, shards=shards),
            deal.dealt_schema(*narrow, "probe"),
        ),
        shards, _meet_blocks, "blocks",
    )
    windows = deal.round_trip(
        texts.join(blocks, KEY).mapInArrow(
            partial(_send_windows, window=window, shards=shards),
            deal.dealt_schema(*narrow, "first", "second"),
        ),
        shards, _meet_windows, "windows",
    )
    told = deal.with_reports(deal.with_reports(texts, blocks, "blocks"), windows, "windows")
    return told.mapInArrow(
        partial(_cut, window=window, shards=shards),
        "k1 long, k2 long, n_words long, n_removed long, kept string",
    )


def remove_repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``id_column, n_words, n_removed, kept`` for each row of ``docs``.

    A word goes if one of the windows of ``window`` consecutive words that hold it starts
    anywhere else too: in another row, in a copy of this row, or elsewhere in this text.
    Windows are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

    Null and empty texts have no words and an empty ``kept``; texts shorter than a window
    keep all words. Null and repeated ids are values like others: each row gets its result.
    Other columns are not read.
    """
    passages = repeated_passages(deal.distinct_texts(docs, text), window)
    ids = deal.keyed(docs, text, id_column)
    return ids.join(passages, KEY, "left").select(id_column, "n_words", "n_removed", "kept")
