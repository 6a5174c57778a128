"""Byte-pair encoding and decoding of texts, many words at once.

Texts are normalised and split into words; each different word of a chunk is encoded once. The
symbols of all new words lie in one flat array. In each round the keys of all neighbouring
pairs are looked up by binary search among the sorted keys of the merge table, and each word
merges its lowest-ranked pair, at all places from the left; words without a pair leave. A word
of n symbols takes at most n - 1 rounds; as each goes over all of the word, words of more than
``LONG_WORD`` bytes (which text hardly has) are merged one by one, lowest rank first, with a heap
of pairs, in a time that grows little faster than their length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable
from contextlib import contextmanager
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerweave.llm.text import chunks

# Fixed values of the vocabulary's format: its splitting pattern and the characters that are
# white space in it, and the end mark of a word.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"

KNOWN_WORDS = 300_000  # words a task remembers; beyond it, it starts anew
LONG_WORD = 2_000  # bytes
CHUNK_BYTES = 2_000_000
_NONE = np.iinfo(np.int32).max

_words = regex.compile(PATTERN)
_white = regex.compile(rf"[{WHITE}]+")
_high = regex.compile("[^\\x00-\u04ff]")  # below, all Unicode tables agree


def _ranges(characters: Iterable[str]) -> str:
    """A set of characters as the inside of a regular expression's class."""
    points = sorted(map(ord, characters))
    out, begin = [], 0
    for i in range(1, len(points) + 1):
        if i == len(points) or points[i] != points[i - 1] + 1:
            out.append(f"\\U{points[begin]:08x}-\\U{points[i - 1]:08x}")
            begin = i
    return "".join(out)


class Tables:
    """Where the library's Unicode tables differ from those of ``regex`` and ``unicodedata``.

    They are of other versions of Unicode, so that some characters are letters or numbers, or have
    a lower case, in one only. The tables are asked for every character once.
    """

    def __init__(self) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers

        kinds = (r"\p{L}", r"\p{N}")
        cut = {kind: pre_tokenizers.Split(Regex(rf"[{kind}]+"), "removed") for kind in kinds}
        lowered = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        more: dict[str, list[str]] = {kind: [] for kind in kinds}  # of the kind there only
        less: dict[str, list[str]] = {kind: [] for kind in kinds}  # here only
        self.written: dict[str, str] = {}
        for begin in range(0x500, 0x110000, 0x4000):  # a part at a time, to hold little
            part = [chr(c) for c in range(begin, min(begin + 0x4000, 0x110000)) if not 0xD800 <= c < 0xE000]
            whole = "".join(part)
            disputed: set[str] = set()
            for kind in kinds:
                outside = set("".join(piece for piece, _ in cut[kind].pre_tokenize_str(whole)))
                ours = set(regex.findall(kind, whole))
                more[kind] += [c for c in part if c not in outside and c not in ours]
                less[kind] += [c for c in part if c in outside and c in ours]
                disputed.update(more[kind][-len(part) :], less[kind][-len(part) :])
            theirs = lowered.normalize_str("\n".join(part)).split("\n")
            for c, t in zip(part, theirs, strict=True):
                if c in disputed or _plain(c) != t:
                    self.written[c] = t
        classes = {}
        for kind in kinds:
            own = rf"[{kind}{_ranges(more[kind])}]"
            classes[kind] = rf"[{own}--[{_ranges(less[kind])}]]" if less[kind] else own
        disputed = set(self.written)
        letter, number = classes[r"\p{L}"], classes[r"\p{N}"]
        marks = "'s|'t|'re|'ve|'m|'ll|'d"
        other = rf"[[^{WHITE}]--{letter}--{number}]"
        self.words = regex.compile(rf"(?V1){marks}|{letter}+|{number}|{other}+")
        self.disputed = regex.compile(rf"[{_ranges(disputed)}]") if disputed else regex.compile(r"(?!)")

    def split(self, text: str) -> list[str]:
        """The words of a text that holds disputed characters."""
        out, at = [], 0
        for found in self.disputed.finditer(text):
            out += [_plain(text[at : found.start()]), self.written[found.group()]]
            at = found.end()
        out.append(_plain(text[at:]))
        return self.words.findall(_white.sub(" ", "".join(out)))


@lru_cache(maxsize=1)
def _tables() -> Tables:
    return Tables()


def _plain(text: str) -> str:
    # a capital sigma is lowered alike wherever it stands
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, others from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special = special
        self.tokens = [""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, number in [*vocabulary.items(), *special.items()]:
            self.tokens[number] = token
        self.marks = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], dtype=np.int64)
        self.last = np.array([vocabulary[x + WORD_END] for x in letters], dtype=np.int64)
        pairs = content["model"]["merges"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in pairs]
        self.size = len(self.tokens)
        key = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs])
        order = np.argsort(key)
        self.key = key[order]
        self.rank = order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.ranks: dict[int, tuple[int, int]] | None = None  # made for the first long word
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.begin = np.zeros(1, dtype=np.int64)

    def _pieces(self, text: str) -> Iterable[str]:
        """The words of a text; special tokens as they are."""
        if "<|" in text or any(not m.startswith("<|") for m in self.special):
            at = 0
            for mark in self.marks.finditer(text):
                yield from self._split(text[at : mark.start()])
                yield mark.group()
                at = mark.end()
            text = text[at:]
        yield from self._split(text)

    @staticmethod
    def _split(text: str) -> list[str]:
        if text.isascii():
            return _words.findall(_white.sub(" ", text).lower())
        if _high.search(text) and _tables().disputed.search(text):
            return _tables().split(text)
        return _words.findall(_white.sub(" ", _plain(text)))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's ids end."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbol = self.inner[raw]
        last = np.cumsum(lengths) - 1
        symbol[last] = self.last[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        while len(symbol):
            rank = np.full(len(symbol), _NONE, dtype=np.int32)
            inside = np.flatnonzero(word[:-1] == word[1:])
            key = symbol[inside] * self.size + symbol[inside + 1]
            found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[found] == key
            rank[inside[hit]] = self.rank[found[hit]]
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(word)))
            mine = np.repeat(lowest, size)
            ended = mine == _NONE
            if ended.any():
                done_symbol.append(symbol[ended])
                done_word.append(word[ended])
                symbol, word, rank, mine = (x[~ended] for x in (symbol, word, rank, mine))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == mine)
            # of places side by side (one symbol repeated) every second one merges
            new = np.append(True, at[1:] != at[:-1] + 1)
            run = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done_word:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(words), dtype=np.int64)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ids = np.concatenate(done_symbol)[order].astype(np.uint32)
        return ids, np.cumsum(np.bincount(word, minlength=len(words)))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word. Pairs wait in a heap by rank and place; a pair whose symbols have
        changed meanwhile is passed over."""
        if self.ranks is None:
            self.ranks = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.merged[self.rank].tolist())))
        raw = np.frombuffer(word, dtype=np.uint8)
        symbol = self.inner[raw].tolist()
        symbol[-1] = int(self.last[raw[-1]])
        size, ranks = self.size, self.ranks
        after = [*range(1, len(symbol)), -1]
        before = [*range(-1, len(symbol) - 1)]
        heap = []

        def offer(at: int) -> None:
            if at >= 0 and after[at] >= 0:
                key = symbol[at] * size + symbol[after[at]]
                if key in ranks:
                    heap.append((ranks[key][0], at, key))

        for at in range(len(symbol) - 1):
            offer(at)
        heapq.heapify(heap)
        while heap:
            _, at, key = heapq.heappop(heap)
            right = after[at]
            if symbol[at] < 0 or right < 0 or symbol[at] * size + symbol[right] != key:
                continue
            symbol[at], symbol[right] = ranks[key][1], -1
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for changed in (before[at], at):
                new = len(heap)
                offer(changed)
                if len(heap) > new:
                    heapq.heappush(heap, heap.pop())
        return np.array([x for x in symbol if x >= 0], dtype=np.uint32)

    def _learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.place)
        plain = [w for w in new if w not in self.special]
        marks = [w for w in new if w in self.special]
        encoded = [w.encode("utf-8") for w in plain]
        long = {i for i, w in enumerate(encoded) if len(w) > LONG_WORD}
        plain = [w for i, w in enumerate(plain) if i not in long] + [plain[i] for i in sorted(long)]
        ids, ends = self.merge([w for i, w in enumerate(encoded) if i not in long])
        for i in sorted(long):
            ids = np.append(ids, self.merge_long(encoded[i]))
            ends = np.append(ends, len(ids))
        ids = np.append(ids, np.array([self.special[m] for m in marks], dtype=np.uint32))
        ends = np.append(ends, (ends[-1] if len(ends) else 0) + 1 + np.arange(len(marks)))
        for i, w in enumerate([*plain, *marks], start=len(self.place)):
            self.place[w] = i
        self.begin = np.append(self.begin, len(self.flat) + ends)
        self.flat = np.append(self.flat, ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array (uint32), and where each text's ids end."""
        if len(self.place) > KNOWN_WORDS:
            self.forget()
        words: list[str] = []
        ends = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            words.extend(self._pieces(text))
            ends[i] = len(words)
        self._learn(set(words))
        place = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        size = self.begin[place + 1] - self.begin[place]
        total = np.append(0, np.cumsum(size))
        item = np.repeat(self.begin[place] - total[:-1], size) + np.arange(total[-1])
        return self.flat[item], total[ends]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids, one space between two; this vocabulary has no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _strings(column: pa.Array) -> list[str]:
    return [value or "" for value in column.cast(pa.large_string()).to_pylist()]


def _slices(batches, name: str):
    for batch in batches:
        texts = _strings(batch.column(batch.schema.get_field_index(name)))
        # sizes in characters, which are at most four bytes each
        for begin, end in chunks(texts, CHUNK_BYTES):
            yield batch.slice(begin, end - begin), texts[begin:end]


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


@contextmanager
def _task_codec(path: str):
    """The vocabulary, kept by the worker; the words it met go with the task."""
    known = codec(path)
    try:
        yield known
    finally:
        known.forget()


def _encode(batches, path: str, text: str, ids: str):
    with _task_codec(path) as known:
        for batch, texts in _slices(batches, text):
            flat, ends = known.encode(texts)
            lists = pa.LargeListArray.from_arrays(
                pa.array(np.append(0, ends), pa.int64()), pa.array(flat.astype(np.int32))
            )
            yield _with(batch, **{ids: lists.cast(pa.list_(pa.int32()))})


def _decode(batches, path: str, ids: str, text: str):
    known = codec(path)
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        yield _with(batch, **{text: pa.array([known.decode(r or []) for r in rows], pa.string())})


def _digest(batches, path: str, text: str):
    with _task_codec(path) as known:
        for batch, texts in _slices(batches, text):
            flat, ends = known.encode(texts)
            counts, first, second, begin = [], [], [], 0
            for end in ends.tolist():
                own = flat[begin:end]
                counts.append(end - begin)
                first.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(known.decode(own.tolist()).encode("utf-8")).hexdigest())
                begin = end
            yield _with(
                batch.drop_columns([text]),
                n_tokens=pa.array(counts, pa.int64()),
                ids_sha256=pa.array(first, pa.string()),
                decoded_sha256=pa.array(second, pa.string()),
            )


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None
) -> DataFrame:
    """``docs`` with the ids of each whole text, as an array of int.

    Null and empty texts, and those of white space, give no ids. Special tokens of the
    vocabulary that stand in a text become their ids. A column that is called like the new one
    is replaced; all others pass through. ``path`` is the vocabulary on each machine.
    """
    bare = docs.drop(ids) if ids != text else docs
    call = partial(_encode, path=path or default_path(), text=text, ids=ids)
    return bare.mapInArrow(call, f"{_kinds(bare)}, `{ids}` array<int>")


def decode(
    docs: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None
) -> DataFrame:
    """``docs`` with the tokens of ``ids`` in one string; null ids give an empty one."""
    bare = docs.drop(text)
    call = partial(_decode, path=path or default_path(), ids=ids, text=text)
    return bare.mapInArrow(call, f"{_kinds(bare)}, `{text}` string")


def digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without the text, with ``n_tokens, ids_sha256, decoded_sha256``: what ``encode``
    and then ``decode`` give, in one pass and without moving the ids."""
    call = partial(_digest, path=path or default_path(), text=text)
    bare = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    return bare.mapInArrow(
        call, f"{_kinds(bare.drop(text))}, n_tokens long, ids_sha256 string, decoded_sha256 string"
        if len(bare.columns) > 1 else "n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
