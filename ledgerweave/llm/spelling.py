"""Spelling variants: words at one edit from each other, by pairs of trie nodes.

The words of a corpus form a trie, and the words read backwards another one. Every node has a
number. A word with the code point at place i left out is then a pair of integers: the node of
what stands before i, and the backward node of what stands after it. So

* words that differ in one replaced code point share the pair that leaves it out, and
* a word with one code point more than another has, where it is left out, the pair at which the
  shorter one is cut in two without leaving anything out.

Equal pairs are equal texts, so nothing needs to be verified afterwards. All words that share a
pair are one text with one code point put in at one place, so there are at most as many as the
alphabet has letters, and one more: no pair is hot, whatever the corpus.

Tries are numbered on words sorted over the cluster: a word adds the nodes beyond what it shares
with the word before it. Each partition numbers its own nodes; where it begins within a branch of
the partition before it, its first numbers stand for nodes of that one. That is settled from the
first and last word of each partition, the only words that reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import LOWER, as_bytes, chunks
from ledgerweave.session import shuffle_width, written

LEAST_LENGTH = 7  # code points
LEAST_COUNT = 2
RATIO = 10  # times as frequent a form must be
HELD_ROWS = 1_000_000  # counted words that a task holds before it sends them on
LONG_RUN = 64  # bytes from which a checksum is taken by itself

_ASCII = np.zeros(256, dtype=bool)
_ASCII[65:91] = _ASCII[97:123] = True
_TWO = 0xC3  # first byte of the letters from U+00C0 to U+00FF, which have two


def _crc_table() -> np.ndarray:
    """The checksum of each single byte (reflected polynomial of CRC-32)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` of each run, carried on from the checksums ``before``."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG_RUN]
    ordered = size[order]
    state = ~before[order].astype(np.uint32)
    at = start[order]
    for k in range(int(ordered[0]) if len(ordered) else 0):
        live = int(np.searchsorted(-ordered, -k))  # those of more than k bytes
        part = state[:live]
        state[:live] = _CRC[(part ^ data[at[:live] + k]) & 0xFF] ^ (part >> 8)
    out = np.zeros(len(start), dtype=np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(size > LONG_RUN):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return out


def _words(ids: list[str], texts: list[bytes], least: int, slips: int | None) -> pa.StructArray:
    """The words of some texts and how often they stand there."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    two = raw == _TWO
    letter = _ASCII[raw] | two
    letter[1:] |= two[:-1]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    seen = np.append(0, np.cumsum(two))
    length = end - start - (seen[end] - seen[start])
    long = length >= least
    start, end, length = start[long], end[long], length[long]
    low = LOWER[raw]
    slipped: list[str] = []
    if slips:
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        doc = np.searchsorted(begins, start, side="right") - 1
        heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
        h = checksums(low, start, end, heads[doc])
        hit = h % np.uint32(slips) == 0
        for i in np.flatnonzero(hit & (length > least)):
            run = low[start[i] : end[i]].tobytes().decode()
            place = int(h[i]) % len(run)
            slipped.append(run[:place] + run[place + 1 :])
        start, end = start[~hit], end[~hit]
    step = np.zeros(len(low) + 1, dtype=np.int8)
    step[start] += 1
    step[end] -= 1
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
    data = low[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    whole = pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return pc.value_counts(pa.concat_arrays([whole, pa.array(slipped, pa.large_string())]))


def _added(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
    return total.select(["word", "n_sum"]).rename_columns(["word", "n"])


def _counted(batches: Iterable[pa.RecordBatch], least: int, slips: int | None):
    parts: list[pa.Table] = []
    rows = 0

    def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.set_column(0, "word", table.column("word").cast(pa.string()))
        yield from table.to_batches(max_chunksize=50_000)

    for batch in batches:
        texts = as_bytes(batch.column(1))
        ids = [i or "" for i in batch.column(0).to_pylist()]
        for begin, end in chunks(texts):
            found = _words(ids[begin:end], texts[begin:end], least, slips)
            parts.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            rows += len(found)
            if rows > HELD_ROWS:
                parts = [_added(parts)]
                rows = len(parts[0])
                if rows > HELD_ROWS // 2:
                    yield from sent(parts[0])
                    parts, rows = [], 0
    if rows:
        yield from sent(_added(parts))


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, slips: int | None = None,
) -> DataFrame:
    """``word, n``: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, and their number.

    Only words of ``least`` code points or more that occur ``least_count`` times are given. With
    ``slips`` a run loses one code point, as if by a slip, where ``slips`` divides h, the CRC-32
    of ``<id>:<run>``: the one at ``h`` modulo the run's length. Words are counted after that. A
    null id counts as empty text; null texts have no words; other columns are not read.
    """
    narrow = docs.select(
        F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")
    )
    found = narrow.mapInArrow(partial(_counted, least=least, slips=slips), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def shared(a: str, b: str) -> int:
    """The number of code points that two words have in common at their beginning."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low = 0
    while most - low > 16:  # long words
        middle = (low + most) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            most = middle
    while a[low] == b[low]:
        low += 1
    return low


def _numbered(batches: Iterable[pa.RecordBatch], backward: bool, prefix: str):
    """Rows with the nodes of each word, numbered from 0 in this partition, and its number."""
    before, path, free = "", [], 0
    part = TaskContext.get().partitionId()
    for batch in batches:
        flat: list[int] = []
        ends = [0]
        for word in batch.column("word").to_pylist():
            if backward:
                word = word[::-1]
            common = shared(before, word)
            new = len(word) - common
            path = path[:common] + list(range(free, free + new))
            free += new
            before = word
            flat.extend(path)
            ends.append(len(flat))
        nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), nodes],
            names=[*batch.schema.names, f"{prefix}_part", f"{prefix}_nodes"],
        )


def _trie(words: DataFrame, backward: bool, prefix: str) -> tuple[DataFrame, dict]:
    """``words`` with the nodes of one trie, and what turns partitions' numbers into the trie's."""
    spark = words.sparkSession
    order = F.reverse("word") if backward else F.col("word")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    numbered = (
        words.withColumn("__order", order)
        .repartitionByRange(shuffle_width(spark), "__order")
        .sortWithinPartitions("__order")
        .drop("__order")
        .mapInArrow(
            partial(_numbered, backward=backward, prefix=prefix),
            f"{kinds}, {prefix}_part int, {prefix}_nodes array<long>",
        )
    )
    table, _ = written(numbered, f"trie-{prefix}")
    part, nodes = f"{prefix}_part", f"{prefix}_nodes"
    edges = table.groupBy(part).agg(F.min(order).alias("first"), F.max(order).alias("last"))
    last = table.select(part, order.alias("last"), nodes)
    rows = edges.join(last, [part, "last"]).orderBy(part).collect()  # one for each partition
    return table, _joined_up([(r[part], r["first"], r["last"], r[nodes]) for r in rows])


def _joined_up(partitions: list[tuple[int, str, str, list[int]]]) -> dict[int, tuple[int, list[int]]]:
    """For each partition where its numbers begin, and the nodes that its first numbers stand for.

    0 is the root, the node of the empty text.
    """
    out, base, path, before = {}, 1, [], ""
    for number, first, last, nodes in partitions:
        common = shared(before, first)
        known = path[:common]
        out[number] = (base, known)
        path = [known[x] if x < common else base + x for x in nodes]
        base += nodes[-1] + 1  # the last word of a partition has its newest node
        before = last
    return out


def _whole_numbers(batch: pa.RecordBatch, prefix: str, joined: dict) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of all words of a batch, numbered over all partitions, and where each word's end."""
    lists = batch.column(f"{prefix}_nodes")
    ends = lists.offsets.to_numpy()
    local = lists.flatten().to_numpy(zero_copy_only=False)
    ends = ends - ends[0]
    part = np.repeat(batch.column(f"{prefix}_part").to_numpy(), np.diff(ends))
    out = np.empty_like(local)
    for number in np.unique(part):
        mine = part == number
        base, known = joined[int(number)]
        x = local[mine]
        moved = x + base
        if known:
            early = x < len(known)
            moved[early] = np.array(known, dtype=np.int64)[x[early]]
        out[mine] = moved
    return out, ends


def _place_lists(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its number and 0, 1, ... of so many items."""
    word = np.repeat(np.arange(len(sizes)), sizes)
    return word, np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


SKIPPED, FIRST_SKIPPED, WHOLE = 0, 1, 2


def _pairs(batches: Iterable[pa.RecordBatch], forward: dict, backward: dict):
    """Pairs of nodes of each word: one for each code point left out, one for each cut.

    Of a run of one code point, leaving out any gives the same word; the first is marked, so
    that a longer and a shorter word meet once as neighbours.
    """
    for batch in batches:
        p, ends = _whole_numbers(batch, "f", forward)
        s, _ = _whole_numbers(batch, "b", backward)
        size = np.diff(ends)
        begin = ends[:-1]
        ident = p[ends[1:] - 1]
        n = batch.column("n").to_numpy()
        points = np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), "<u4")

        def before(word, place, p=p, begin=begin):  # node of what stands before a place
            return np.where(place > 0, p[np.maximum(begin[word] + place - 1, 0)], 0)

        def after(word, count, s=s, begin=begin):  # backward node of the last so many
            return np.where(count > 0, s[np.maximum(begin[word] + count - 1, 0)], 0)

        word, place = _place_lists(size)
        new = np.append(True, points[1:] != points[:-1])[: len(points)] | (place == 0)
        cut, at = _place_lists(size + 1)
        columns = {
            "p": np.concatenate([before(word, place), before(cut, at)]),
            "s": np.concatenate([after(word, size[word] - 1 - place), after(cut, size[cut] - at)]),
            "kind": np.concatenate(
                [np.where(new, FIRST_SKIPPED, SKIPPED), np.full(len(cut), WHOLE)]
            ).astype(np.int8),
            "id": np.concatenate([ident[word], ident[cut]]),
            "n": np.concatenate([n[word], n[cut]]),
        }
        yield from pa.table(columns).to_batches(max_chunksize=200_000)


def _best_two(group: np.ndarray, ident: np.ndarray, n: np.ndarray, use: np.ndarray, groups: int):
    """Places of the most frequent and the next of the used rows of each group, -1 for none; of
    equally frequent ones, that with the smaller number."""
    at = np.flatnonzero(use)
    order = at[np.lexsort((ident[at], -n[at], group[at]))]
    first = np.full(groups, -1)
    second = np.full(groups, -1)
    own = group[order]
    new = np.append(True, own[1:] != own[:-1])[: len(own)]
    first[own[new]] = order[new]
    follows = np.append(False, new[:-1] & ~new[1:])[: len(own)]
    second[own[follows]] = order[follows]
    return first, second


def _met(p, s, kind, ident, n) -> pa.RecordBatch | None:
    """What the members of each pair are to each other; rows are sorted by pair."""
    new = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1]))[: len(p)]
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(group) else new
    if not many.any():
        return None
    kind, ident, n = kind[many], ident[many], n[many]
    group = np.unique(group[many], return_inverse=True)[1]
    groups = int(group[-1]) + 1
    whole, marked = kind == WHOLE, kind == FIRST_SKIPPED
    count = lambda mask: np.bincount(group[mask], minlength=groups)
    skips, firsts, wholes = count(~whole), count(marked), count(whole)
    near = np.where(whole, firsts[group], skips[group] - 1 + np.where(marked, wholes[group], 0))
    first, second = _best_two(group, ident, n, ~whole, groups)
    longer, _ = _best_two(group, ident, n, marked, groups)
    shorter, _ = _best_two(group, ident, n, whole, groups)
    rows = np.arange(len(group))
    other = np.where(first[group] == rows, second[group], first[group])
    also = np.where(marked, shorter[group], -1)
    # of the best with one code point replaced and the one without it
    better = (also >= 0) & (
        (other < 0) | (n[also] > n[other]) | ((n[also] == n[other]) & (ident[also] < ident[other]))
    )
    best = np.where(whole, longer[group], np.where(better, also, other))
    some = near > 0
    best = best[some]
    return pa.RecordBatch.from_pydict(
        {
            "id": pa.array(ident[some]),
            "n_near": pa.array(near[some].astype(np.int64)),
            "best_n": pa.array(n[best]),
            "best": pa.array(ident[best]),
        }
    )


def _meet(batches: Iterable[pa.RecordBatch]):
    """Members of pairs, which come sorted; the last pair of a batch waits for the next one."""
    names = ["p", "s", "kind", "id", "n"]
    held = None
    for batch in batches:
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in names]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        p, s = columns[:2]
        last = int(np.flatnonzero((p != p[-1]) | (s != s[-1]))[-1]) + 1 if len(p) and (
            (p[0] != p[-1]) or (s[0] != s[-1])
        ) else 0
        held = [c[last:] for c in columns]
        found = _met(*[c[:last] for c in columns])
        if found is not None:
            yield found
    if held is not None and len(held[0]):
        found = _met(*held)
        if found is not None:
            yield found


def _identified(batches: Iterable[pa.RecordBatch], forward: dict):
    for batch in batches:
        nodes, ends = _whole_numbers(batch, "f", forward)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[ends[1:] - 1]), batch.column("word"), batch.column("n")],
            names=["id", "word", "n"],
        )


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of a table ``word, n``.

    Two words are near if one inserted, deleted or replaced code point makes one the other;
    ``n_near`` counts them. The form is the near word of largest n (the smallest in code-point
    order of equal ones), if that n is ``ratio`` times the word's own; ``root`` follows forms to the
    last, and is the word itself if it has none. Rows with a null or empty word or null n take no
    part; of repeated words the n are added. Other columns are not read.
    """
    own = (
        words.select(F.col("word"), F.col("n").cast("long").alias("n"))
        .filter("word <> '' and n is not null")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    table, forward = _trie(own, False, "f")
    table, backward = _trie(table, True, "b")
    named, _ = written(
        table.select("word", "n", "f_part", "f_nodes")
        .mapInArrow(partial(_identified, forward=forward), "id long, word string, n long"),
        "words",
    )
    pairs = table.mapInArrow(
        partial(_pairs, forward=forward, backward=backward),
        "p long, s long, kind byte, id long, n long",
    )
    width = shuffle_width(table.sparkSession)
    met = (
        pairs.repartition(width, "p", "s")
        .sortWithinPartitions("p", "s")
        .mapInArrow(_meet, "id long, n_near long, best_n long, best long")
    )
    # numbers of words follow their order, so that the smaller number is the smaller word
    near = met.groupBy("id").agg(
        F.sum("n_near").alias("n_near"),
        F.max(F.struct("best_n", (-F.col("best")).alias("place"))).alias("top"),
    )
    known = named.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("top.best_n") >= ratio * F.col("n"), -F.col("top.place")).alias("form_id"),
        F.when(F.col("top.best_n") >= ratio * F.col("n"), F.col("top.best_n")).alias("form_n"),
    )
    known, _ = written(known, "variants")
    links = known.filter("form_id is not null").select("id", "form_id")
    ends = links.select("id", F.col("form_id").alias("root_id"), F.lit(True).alias("moved"))
    # a form is ratio times as frequent, so paths have few steps
    follow = links.select(F.col("id").alias("root_id"), F.col("form_id").alias("next"))
    while ends.filter("moved").limit(1).count():
        ends, _ = written(
            ends.join(follow, "root_id", "left").select(
                "id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")
            ),
            "roots",
        )
    names = named.select(F.col("id").alias("__id"), F.col("word").alias("__word"))
    linked = (
        links.join(ends, "id")
        .join(names, F.col("form_id") == F.col("__id")).withColumnRenamed("__word", "form").drop("__id", "form_id")
        .join(names, F.col("root_id") == F.col("__id")).withColumnRenamed("__word", "root").drop("__id")
        .select("id", "form", "root")
    )
    return known.join(linked, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, ratio: int = RATIO, slips: int | None = None,
) -> DataFrame:
    """``variants`` of the ``word_counts`` of a table of texts, over all rows and whole texts.
    Empty tables, and texts without words, give no rows."""
    counts, _ = written(
        word_counts(docs, id_column, text, least, least_count, slips), "word-counts"
    )
    return variants(counts, ratio)
