"""Repeated byte strings found by suffix arrays.

The strings of ``length`` bytes that start at neighbouring places mostly share their smallest
gram (the run of some bytes inside with the smallest hash). Strings that are equal have the
same smallest gram, wherever they stand, so it names the shard where they meet:

1. Each text sends the gram of each run of starts that share one to the gram's shard, which
   reports grams that come twice.
2. The pieces of text around reported runs go to shards by gram. A shard keeps each different
   piece once and sorts the suffixes of the pieces, put one after the other, by induced
   sorting: suffixes are classified, the leftmost smaller (LMS) substrings are sorted by
   inducing and named, the string of names is sorted recursively, and the order of all
   suffixes is induced from it, bucket by bucket.
3. Permuted common prefixes tell which starts have a neighbour in the suffix array with
   ``length`` equal bytes; these starts are reported.
4. Each text removes the bytes of the strings that start there.

A block of pieces is at most BLOCK_BYTES long. The pieces of one gram that are more are dealt
out once more, by longer grams: a text that everybody has, with something else before and
behind it, so falls apart before it is sorted.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm import deal
from ledgerweave.llm.deal import KEY
from ledgerweave.llm.text import mix

LENGTH = 200
GRAMS = (64, 160, 192)  # bytes; of whole texts, and of pieces that are dealt out again
BLOCK_BYTES = 1_000_000
SCAN_BYTES = 1_500_000
PLACE = (1 << 22) - 1  # a scan has at most two times SCAN_BYTES
SHARD_BYTES = 24_000_000
SMALL_ALPHABET = 2_000  # names up to which the string of names is sorted by inducing too

# Two bytes that no UTF-8 text holds: between pieces, and behind the last one.
BETWEEN, BEHIND = 0xFF, 0xFE

_U = np.uint64


# grams


def _smallest_grams(buffer: np.ndarray, gram: int, length: int) -> tuple:
    """For each start of ``length`` bytes the smallest hash of the grams inside, and its place."""
    word8 = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer, strides=(1,))
    h = word8 * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(32)
    size, whole = 8, None
    used = 0
    n = len(buffer) - gram + 1
    while True:  # runs of 8, 16, 32 ... bytes; the gram is put together from them
        if gram & size:
            part = h[used : used + n]
            whole = part.copy() if whole is None else whole * _U(0xD6E8FEB86659FD93) + part
            used += size
        if size * 2 > gram:
            break
        h = h[:-size] * _U(0x9FB21C651E98DF25) + h[size:]
        h ^= h >> _U(29)
        size *= 2
    whole *= _U(0xBF58476D1CE4E5B9)
    whole ^= whole >> _U(31)
    whole *= _U(0x94D049BB133111EB)
    window, span = length - gram + 1, 1
    # of equal hashes (in the bits left) the first one counts
    place = np.arange(len(whole), dtype=_U)
    least = whole & ~_U(PLACE) | place
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = window - span
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    least &= _U(PLACE)
    return whole[least], least


class Runs:
    """Runs of starts of one text that share their smallest gram: ``doc``, first start ``at``,
    number of starts ``count``, and ``key``, whose lowest bit says that the gram comes twice in
    the run, so that strings inside may be equal."""

    def __init__(self, texts: list[bytes], gram: int, length: int):
        found: list[tuple] = []
        batch: list[tuple[int, int, bytes]] = []
        size = 0
        for doc, text in enumerate(texts):
            for at in range(0, len(text) - length + 1, SCAN_BYTES):
                part = text[at : at + SCAN_BYTES + length - 1]
                batch.append((doc, at, part))
                size += len(part)
                if size >= SCAN_BYTES:
                    found.append(self._scan(batch, gram, length))
                    batch, size = [], 0
        if batch:
            found.append(self._scan(batch, gram, length))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [
            np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0, dtype=_U)]
        self.doc, self.at, self.count, self.key = columns

    @staticmethod
    def _scan(batch, gram: int, length: int):
        buffer = np.frombuffer(b"".join(part for _, _, part in batch), dtype=np.uint8)
        sizes = np.array([len(part) for _, _, part in batch])
        begin = np.cumsum(sizes) - sizes
        least, place = _smallest_grams(buffer, gram, length)
        # starts whose string lies in one part, and where runs of them begin
        last = begin + sizes - length
        new = np.zeros(len(least) + 1, dtype=bool)
        new[1 : len(least)] = least[1:] != least[:-1]
        new[begin] = True
        new[last + 1] = True
        cuts = np.flatnonzero(new)
        part = np.searchsorted(begin, cuts, side="right") - 1
        inside = cuts <= last[part]
        ends = np.minimum(np.append(cuts[1:], len(least)), len(least))
        cuts, part, ends = cuts[inside], part[inside], ends[inside]
        doc = np.array([d for d, _, _ in batch])[part]
        at = np.array([a for _, a, _ in batch])[part] + cuts - begin[part]
        count = ends - cuts
        twice = (place[cuts] != place[ends - 1]).astype(_U)
        return doc, at, count, mix(least[cuts], 5) & ~_U(1) | twice


# suffix arrays


def _kinds(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one, a sentinel, counts so."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    place = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(place[::-1])[::-1]
    smaller = np.ones(n, dtype=bool)
    smaller[:-1] = np.where(following < n - 1, step[np.minimum(following, n - 2)] > 0, True)
    return smaller


class _Induce:
    """The order of all suffixes from an order of the LMS suffixes, by buckets of a letter."""

    def __init__(self, text: np.ndarray, letters: int, smaller: np.ndarray):
        self.text, self.letters, self.smaller = text, letters, smaller
        self.size = np.bincount(text, minlength=letters)
        self.tail = np.cumsum(self.size)
        self.head = self.tail - self.size
        self.used = np.flatnonzero(self.size)

    def _put(self, where: np.ndarray, edge: np.ndarray, way: int, items: np.ndarray) -> None:
        letter = self.text[items]
        order = np.argsort(letter, kind="stable")
        letter, items = letter[order], items[order]
        count = np.bincount(letter, minlength=self.letters)
        rank = np.arange(len(items)) - (np.cumsum(count) - count)[letter]
        if way > 0:
            where[edge[letter] + rank] = items
        else:
            where[edge[letter] - 1 - rank] = items
        edge += way * count

    def order(self, lms: np.ndarray) -> np.ndarray:
        """``lms`` holds the LMS places, sorted as far as is known."""
        text, smaller = self.text, self.smaller
        where = np.full(len(text), -1, dtype=np.int64)
        grouped = lms[np.argsort(text[lms], kind="stable")]
        count = np.bincount(text[lms], minlength=self.letters)
        lms_end = np.cumsum(count)
        edge = self.head.copy()
        for c in self.used:  # larger suffixes, from the front
            done = self.head[c]
            while True:
                items = where[done : edge[c]]
                if not len(items):
                    break
                done = edge[c]
                before = items[items > 0] - 1
                self._put(where, edge, 1, before[~smaller[before]])
            items = grouped[lms_end[c] - count[c] : lms_end[c]]
            if len(items):
                before = items[items > 0] - 1
                self._put(where, edge, 1, before[~smaller[before]])
        larger_end = edge
        edge = self.tail.copy()
        edge[text[-1]] -= 1  # the sentinel, which no suffix induces
        where[edge[text[-1]]] = len(text) - 1
        for c in self.used[::-1]:  # smaller suffixes, from the back
            done = self.tail[c]
            if c == text[-1]:
                done = edge[c]
                before = np.array([len(text) - 2]) if len(text) > 1 else np.zeros(0, dtype=np.int64)
                self._put(where, edge, -1, before[smaller[before]])
            while True:
                items = where[edge[c] : done][::-1]
                if not len(items):
                    break
                done = edge[c]
                before = items[items > 0] - 1
                self._put(where, edge, -1, before[smaller[before]])
            items = where[self.head[c] : larger_end[c]][::-1]
            if len(items):
                before = items[items > 0] - 1
                self._put(where, edge, -1, before[smaller[before]])
        return where


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray, depth: int) -> np.ndarray:
    """Number of each LMS substring, in text order; equal ones (up to ``depth``) share it."""
    following = np.append(lms[1:], len(text) - 1)
    size = np.zeros(len(text), dtype=np.int64)
    size[lms] = following - lms + 1
    one, two = ordered[:-1], ordered[1:]
    differ = size[one] != size[two]
    live = np.flatnonzero(~differ)
    for k in range(depth):
        live = live[k < size[one[live]]]
        if not len(live):
            break
        apart = text[one[live] + k] != text[two[live] + k]
        differ[live[apart]] = True
        live = live[~apart]
    number = np.zeros(len(text), dtype=np.int64)
    number[ordered] = np.append(0, np.cumsum(differ))
    return number[lms]


def _by_ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by doubling ranks, to ``depth`` names."""
    rank, known = names.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        if new.all() or known >= depth:
            return order
        rank[order] = np.cumsum(new)
        second = np.zeros(len(rank), dtype=np.int64)
        second[:-known] = rank[known:]
        rank = rank * (len(rank) + 1) + second
        known *= 2


def suffix_array(text: np.ndarray, letters: int, depth: int) -> np.ndarray:
    """Places of the suffixes of ``text`` in order. Its last value must be 0 and no other is.

    Suffixes that agree in ``depth`` values stand next to each other, in any order; all others
    are in order.
    """
    if len(text) == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = _kinds(text)
    induce = _Induce(text, letters, smaller)
    lms = 1 + np.flatnonzero(smaller[1:] & ~smaller[:-1])
    if len(lms) > 1:
        is_lms = np.zeros(len(text), dtype=bool)
        is_lms[lms] = True
        first = induce.order(lms)
        names = _names(text, lms, first[is_lms[first]], depth)
        different = int(names.max()) + 1
        if different == len(lms):
            order = np.argsort(names)
        elif different <= SMALL_ALPHABET:
            order = suffix_array(names, different, depth)  # the sentinel's name is 0 and alone
        else:
            order = _by_ranks(names, depth // 2 + 1)  # an LMS substring adds two values or more
        lms = lms[order]
    return induce.order(lms)


def common_prefixes(buffer: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in ``buffer``, bytes its suffix shares with the one before it in order.

    Permuted, that is in text order: where the bytes before both suffixes agree, the value is
    that of the place before less one. Only the other places are compared, eight bytes a step.
    ``buffer`` ends in eight bytes that occur nowhere else.
    """
    n = len(order)
    previous = np.full(n, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    here = np.arange(n)
    follows = np.zeros(n, dtype=bool)
    later = (previous > 0) & (here > 0)
    follows[later] = buffer[here[later] - 1] == buffer[previous[later] - 1]
    # the place before must have its neighbour just before ours, as the first rank breaks that
    follows[1:] &= previous[1:] - 1 == previous[:-1]
    word8 = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer, strides=(1,))
    shared = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(~follows & (previous >= 0))
    while len(live):
        one, two = live + shared[live], previous[live] + shared[live]
        inside = (one < n) & (two < n)
        live, one, two = live[inside], one[inside], two[inside]
        apart = word8[one] ^ word8[two]
        equal = apart == 0
        lowest = apart & (~apart + _U(1))  # its place is eight times the equal bytes, and more
        with np.errstate(divide="ignore"):
            bits = np.where(equal, 64, np.log2(np.maximum(lowest, _U(1)).astype(np.float64)))
        shared[live] += bits.astype(np.int64) // 8
        live = live[equal]
    start = np.maximum.accumulate(np.where(follows, 0, here))
    return np.maximum(shared[start] - (here - start), 0)


def _sorted_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, mask of the starts whose string starts elsewhere in the pieces too."""
    sizes = np.array([len(p) for p in pieces])
    joined = bytes([BETWEEN]).join(pieces) + bytes([BEHIND]) * 8
    buffer = np.frombuffer(joined, dtype=np.uint8)
    n = len(buffer) - 7
    text = buffer[:n].astype(np.int16) + 1
    text[-1] = 0
    order = suffix_array(text, 257, length)
    shared = common_prefixes(buffer, order)[order]
    long = shared >= length
    long[:-1] |= shared[1:] >= length
    again = np.empty(n, dtype=bool)
    again[order] = long
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    return [again[b : b + max(0, s - length + 1)] for b, s in zip(begin, sizes, strict=True)]


def _counted_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """The same as ``_sorted_starts`` for pieces that no gram parts: very many different ones around
    one long gram, with a few starts each. Their strings are counted, those of some hashes at a
    time, so that what is held stays near BLOCK_BYTES."""
    out = [np.zeros(max(0, len(p) - length + 1), dtype=bool) for p in pieces]
    turns = max(1, sum(map(len, out)) * length // BLOCK_BYTES)
    for turn in range(turns):
        first: dict[bytes, tuple[int, int]] = {}
        for number, piece in enumerate(pieces):
            for at in range(len(out[number])):
                string = piece[at : at + length]
                if hash(string) % turns != turn:
                    continue
                if string in first:
                    other, place = first[string]
                    out[number][at] = out[other][place] = True
                else:
                    first[string] = (number, at)
    return out


def repeated_starts(pieces: list[bytes], length: int, level: int = 0) -> list[np.ndarray]:
    """For each of different pieces, mask of the starts whose string starts elsewhere too, in
    blocks of up to BLOCK_BYTES."""
    if sum(map(len, pieces)) <= BLOCK_BYTES:
        return _sorted_starts(pieces, length)
    if level == len(GRAMS):
        return _counted_starts(pieces, length)
    out = [np.zeros(max(0, len(p) - length + 1), dtype=bool) for p in pieces]
    runs = Runs(pieces, GRAMS[level], length)
    order, group = deal.repeated(runs.key >> _U(1))
    weight = np.bincount(group, weights=1 + (runs.key[order] & _U(1)).astype(np.int64))
    order, group = order[weight[group] > 1], group[weight[group] > 1]
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    block: dict[bytes, list] = {}
    held, begin = 0, 0

    def settle(block, level):
        if block:
            found = repeated_starts(list(block), length, level)
            for mask, places in zip(found, block.values(), strict=True):
                for p, at in places:
                    out[p][at : at + len(mask)] |= True if len(places) > 1 else mask

    for end in ends if len(group) else []:
        own: dict[bytes, list] = {}
        for r in order[begin:end]:
            p, at, count = runs.doc[r], runs.at[r], runs.count[r]
            own.setdefault(pieces[p][at : at + count + length - 1], []).append((p, at))
        begin = end
        size = sum(map(len, own))
        if size > BLOCK_BYTES:
            settle(own, level + 1)
            continue
        if held + size > BLOCK_BYTES:
            settle(block, len(GRAMS))
            block, held = {}, 0
        for piece, places in own.items():
            block.setdefault(piece, []).extend(places)
        held += size
    settle(block, len(GRAMS))
    return out


# the job


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (((key >> _U(40)) * _U(shards)) >> _U(24)).astype(np.int64)


def _send_grams(batches, length: int, shards: int):
    for part, texts in deal.opened(batches):
        runs = Runs(texts, GRAMS[0], length)
        if len(runs.key):
            yield deal.dealt(
                _shard(runs.key, shards), runs.doc, deal.heads(part), {"gram": runs.key}
            )


def _meet_grams(batches, buckets: int):
    for got in deal.by_shard(batches, deal.HEADS | {"gram": "<u8"}):
        doc = np.repeat(np.arange(len(got["count"])), got["count"])
        order, group = deal.repeated(got["gram"] >> _U(1))
        weight = 1 + (got["gram"][order] & _U(1)).astype(np.int64) + got["twice"][doc[order]]
        met = np.empty(len(doc), dtype=bool)
        met[order] = np.bincount(group, weights=weight)[group] > 1
        yield deal.report(got, met, doc, buckets)


def _reported(part, runs: Runs, shards: int) -> np.ndarray:
    """Numbers of the runs whose gram was reported."""
    return np.flatnonzero(
        deal.told(part.column("grams"), runs.doc, _shard(runs.key, shards), shards)
    )


def _send_pieces(batches, length: int, shards: int):
    for part, texts in deal.opened(batches):
        runs = Runs(texts, GRAMS[0], length)
        mine = _reported(part, runs, shards)
        if not len(mine):
            continue
        shard = _shard(runs.key[mine], shards)
        order = np.argsort(shard, kind="stable")
        mine, shard = mine[order], shard[order]
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        columns: dict[str, list] = {name: [] for name in (*deal.HEADS, *PIECES)}
        heads = deal.heads(part)
        for begin, end in zip(cuts, np.append(cuts[1:], len(mine)), strict=True):
            own = mine[begin:end]
            doc, count = np.unique(runs.doc[own], return_counts=True)
            columns["count"].append(count.astype(np.int32).tobytes())
            for name, values in heads.items():
                columns[name].append(values[doc].tobytes())
            # equal pieces of the chunk go once
            number: dict[bytes, int] = {}
            which = [
                number.setdefault(texts[d][a : a + c + length - 1], len(number))
                for d, a, c in zip(runs.doc[own], runs.at[own], runs.count[own], strict=True)
            ]
            for name, values in (
                ("runs", [len(own)]), ("pieces", [len(number)]), ("which", which),
                ("size", [len(piece) for piece in number]),
            ):
                columns[name].append(np.array(values, dtype=np.int32).tobytes())
            columns["data"].append(b"".join(number))
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array(shard[cuts].astype(np.int32))}
            | {name: pa.array(values, pa.binary()) for name, values in columns.items()}
        )


# of a row: how many runs and pieces it has, the piece of each run, and the pieces
PIECES = {"runs": "<i4", "pieces": "<i4", "which": "<i4", "size": "<i4", "data": "u1"}


def _meet_pieces(batches, length: int, buckets: int):
    for got in deal.by_shard(batches, deal.HEADS | PIECES):
        data, sizes = got.pop("data").tobytes(), got["size"]
        doc = np.repeat(np.arange(len(got["count"])), got["count"])
        ends = np.cumsum(sizes.astype(np.int64))
        number: dict[bytes, int] = {}
        same = np.array(
            [number.setdefault(data[e - s : e], len(number)) for e, s in zip(ends, sizes, strict=True)],
            dtype=np.int64,
        )
        del data
        place = got["which"] + np.repeat(np.cumsum(got["pieces"]) - got["pieces"], got["runs"])
        which = same[place]
        weight = np.bincount(which, weights=1 + got["twice"][doc])
        masks = repeated_starts(list(number), length)
        for i in np.flatnonzero(weight > 1):
            masks[i] = np.ones(len(masks[i]), dtype=bool)
        starts = sizes[place] - length + 1
        found = np.concatenate([masks[w] for w in which])
        yield deal.report(got, found, np.repeat(doc, starts), buckets)


def _cut(batches, length: int, shards: int):
    for part, texts in deal.opened(batches):
        runs = Runs(texts, GRAMS[0], length)
        mine = _reported(part, runs, shards)
        count = runs.count[mine]
        doc = np.repeat(runs.doc[mine], count)
        at = np.repeat(runs.at[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shard = np.repeat(_shard(runs.key[mine], shards), count)
        found = deal.told(part.column("starts"), doc, shard, shards)
        doc, at = doc[found], at[found]
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        rows = []
        for i, text in enumerate(texts):
            starts = at[first[i] : first[i + 1]]
            if not len(starts):
                rows.append((len(text), 0, 0, text))
                continue
            step = np.zeros(len(text) + 1, dtype=np.int32)
            step[starts] += 1
            step[starts + length] -= 1
            gone = np.cumsum(step[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            rows.append((len(text), int(gone.sum()), spans, kept))
        sizes, removed, spans, kept = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict(
            {
                "k1": part.column("k1"),
                "k2": part.column("k2"),
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def repeated_bytes(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each text of ``deal.distinct_texts``: ``k1, k2, n_bytes, n_removed, n_spans, kept``."""
    if length < GRAMS[-1] + 1:
        raise ValueError(f"strings must be longer than {GRAMS[-1]} bytes")
    spark = texts.sparkSession
    shards = deal.shard_count(texts.agg(F.sum("n_bytes")).first()[0], spark, SHARD_BYTES)
    narrow = ["k1", "k2", "twice"]
    grams = deal.round_trip(
        texts.mapInArrow(
            partial(_send_grams, length=length, shards=shards), deal.dealt_schema(*narrow, "gram")
        ),
        shards, _meet_grams, "grams",
    )
    starts = deal.round_trip(
        texts.join(grams, KEY).mapInArrow(
            partial(_send_pieces, length=length, shards=shards),
            deal.dealt_schema(*narrow, *PIECES),
        ),
        shards, partial(_meet_pieces, length=length), "starts",
    )
    told = deal.with_reports(deal.with_reports(texts, grams, "grams"), starts, "starts")
    return told.mapInArrow(
        partial(_cut, length=length, shards=shards),
        "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary",
    )


def remove_repeated_bytes(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """``id_column, n_bytes, n_removed, n_spans, kept`` for each row of ``docs``.

    A byte of the UTF-8 text goes if one of the strings of ``length`` bytes that hold it starts
    anywhere else too: in another row, in a copy of this row, or elsewhere in this text, also
    overlapping. Strings are judged on the input and do not cross rows. ``n_spans`` counts the
    longest runs of removed bytes; ``kept`` is binary, as a cut can part a character.

    Null and empty texts give 0 bytes; texts shorter than ``length`` stay whole. Null and
    repeated ids are values like others: each row gets its result. Other columns are not read.
    """
    found = repeated_bytes(deal.distinct_texts(docs, text), length)
    ids = deal.keyed(docs, text, id_column)
    return ids.join(found, KEY, "left").select(id_column, "n_bytes", "n_removed", "n_spans", "kept")

