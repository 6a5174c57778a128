"""Tokens of the sections of a text, counted on the whole text.

A section encoded by itself has other tokens than the text has there. So each text is encoded
once, whole; a token's span follows from the sizes of the tokens before it, as the tokens of a
byte-level vocabulary laid together are the text. Spans meet sections by an interval join on
sorted ends. Sections are the lines of a text, or spans of characters given with it, or fields that
together are the text. A token that crosses a boundary is allocated by a rule that is a parameter:

* ``start``: to the section that holds its first byte,
* ``end``: to the section that holds its last byte,
* ``most``: to the section with most of its bytes, the first of equals.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import as_bytes

RULES = ("start", "end", "most")
BATCH_ROWS = 20_000
LONG_RUN = 2_000  # characters of white space that are not left to the splitting pattern
# The characters that are white space in the pattern.
_LONG_WHITE = re.compile(
    rf"[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}"
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding of a rank file, and the size in bytes of each token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    encoding = tiktoken.Encoding(
        "sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return encoding, sizes


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of these cross a boundary of it.

    ``ends`` are the ends of the tokens, ``bounds`` those of the sections; both cover the text.
    """
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    first = np.searchsorted(bounds, begins, side="right")
    last = np.searchsorted(bounds, ends - 1, side="right")
    chosen = {"start": first, "end": last}.get(rule)
    if chosen is None:
        chosen = first.copy()
        for i in np.flatnonzero(first != last):  # sections of a token: few, as it is short
            edges = np.concatenate(([begins[i]], bounds[first[i] : last[i]], [ends[i]]))
            chosen[i] = first[i] + int(np.argmax(np.diff(edges)))
    n = len(bounds)
    return np.bincount(chosen, minlength=n), np.bincount(chosen[first != last], minlength=n)


def encode_whole(encoding, text: str) -> list[int]:
    """Ids of a whole text.

    The splitting pattern looks ahead over a run of white space, once for each of its characters
    on a stack, which a very long run overflows. What the pattern does there is plain: all of the run
    but its last character is one piece (all of it at the end of the text), and the last one goes
    with what follows. So such runs are cut out here, and the pattern gets what lies between.
    """
    ids: list[int] = []
    at = 0
    for run in _LONG_WHITE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def _lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and ends of the lines of a text, each with its newline; an empty text is one line."""
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    if not len(ends) or ends[-1] != len(text):
        ends = np.append(ends, len(text))
    return np.arange(len(ends)), ends


def _given(text: bytes, spans: list[dict | None] | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and ends of given spans of characters, and of what lies between them (-1)."""
    chars = np.append(np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80), len(text))
    numbers, ends, at = [], [], 0
    for number, span in enumerate(spans or []):
        begin, end = (span or {}).get("begin"), (span or {}).get("end")
        begin = at if begin is None else min(max(begin, at), len(chars) - 1)
        end = begin if end is None else min(max(end, begin), len(chars) - 1)
        if begin > at:
            numbers.append(-1)
            ends.append(begin)
        numbers.append(number)
        ends.append(end)
        at = end
    if at < len(chars) - 1 or not ends:
        numbers.append(-1)
        ends.append(len(chars) - 1)
    return np.array(numbers), chars[np.array(ends)]


def _fields(parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Fields in one text, a newline after each but the last, and their numbers and ends."""
    ends = np.cumsum([len(p) + 1 for p in parts])
    ends[-1] -= 1
    return b"\n".join(parts), np.arange(len(parts)), ends


_OUT = ("section", "begin_byte", "n_bytes", "n_tokens", "n_crossing", "begin_char", "n_chars")


def _count(batches: Iterable[pa.RecordBatch], path: str, rule: str, id_name: str, kind: str):
    encoding, sizes = encoder(path)
    for batch in batches:
        ids = batch.column(0)
        held: dict[str, list] = {k: [] for k in ("row", *_OUT)}
        rows = 0

        def flush(held=held, ids=ids):
            columns = {k: np.concatenate(v) for k, v in held.items()}
            for v in held.values():
                v.clear()
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(columns["row"])), *[pa.array(columns[k], pa.int64()) for k in _OUT]],
                names=[id_name, *_OUT],
            )

        columns = [as_bytes(batch.column(i)) for i in range(1, batch.num_columns - (kind == "spans"))]
        spans = batch.column(batch.num_columns - 1).to_pylist() if kind == "spans" else None
        for i, parts in enumerate(zip(*columns, strict=True)):
            if kind == "fields":
                text, numbers, bounds = _fields(list(parts))
            elif kind == "spans":
                text = parts[0]
                numbers, bounds = _given(text, spans[i])
            else:
                text = parts[0]
                numbers, bounds = _lines(text)
            tokens = np.asarray(encode_whole(encoding, text.decode("utf-8")), dtype=np.int64)
            counts, crossing = allocate(np.cumsum(sizes[tokens]), bounds, rule)
            begins = np.append(0, bounds[:-1])
            # bytes that begin a character, before each place
            heads = np.append(0, np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))
            for name, values in zip(
                ("row", *_OUT),
                (np.full(len(bounds), i), numbers, begins, bounds - begins, counts, crossing,
                 heads[begins], heads[bounds] - heads[begins]),
                strict=True,
            ):
                held[name].append(values)
            rows += len(bounds)
            if rows >= BATCH_ROWS:
                yield flush()
                rows = 0
        if rows:
            yield flush()


def section_counts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", rule: str = "start",
    path: str | None = None, spans: str | None = None, fields: list[str] | None = None,
) -> DataFrame:
    """A row for each section of each text: ``id_column, section`` (from 0), ``begin_byte``,
    ``n_bytes``, ``n_tokens`` allocated to it, ``n_crossing`` of these, ``begin_char``, ``n_chars``.

    Sections are the lines of ``text``, each with its newline. ``spans`` names a column of
    ``array<struct<begin, end>>`` instead, in characters: sections given in order; where one begins before
    the last one ended it begins there, ends past the text are cut, a null span or end is empty.
    What lies between is section -1. Or ``fields`` are columns that are encoded as one text, joined by
    newlines, each with the newline after it; ``text`` is not read then.

    The counts of a text's sections add up to the tokens of the whole text. Null and empty texts
    have one section without bytes and tokens, null fields and spans are empty. Null and repeated ids are
    values like others; the sections of rows that share an id are not told apart. Other columns are
    not read. Whole texts are encoded, whatever runs of white space they hold.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if spans and fields:
        raise ValueError("give spans or fields, not both")
    texts = [F.col(f"`{c}`").alias(f"text{i}") for i, c in enumerate(fields or [text])]
    given = [
        F.transform(
            F.col(f"`{spans}`"),
            lambda s: F.struct(s["begin"].cast("long").alias("begin"), s["end"].cast("long").alias("end")),
        ).alias("spans")
    ] if spans else []
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), *texts, *given)
    kind = narrow.schema["id"].dataType.simpleString()
    how = "fields" if fields else "spans" if spans else "lines"
    call = partial(_count, path=path or default_path(), rule=rule, id_name=id_column, kind=how)
    return narrow.mapInArrow(call, ", ".join([f"`{id_column}` {kind}", *[f"{c} long" for c in _OUT]]))
