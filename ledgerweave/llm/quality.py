"""Quality of texts: hashed word n-grams, logistic regression, follow the regularised leader.

Features of a text are hashed runs of one and two words, in lower case and without marks, and
hashed runs of one to three word shapes. The shape of a word says how it is written (letters' case, digits, marks at its end)
and whether it repeats one of the words just before it, so repeated or shouted text is known
by its form whatever its words are. Each n-gram counts with one over the root of the number of
n-grams in its text.

Training reads a sample of the labelled rows that is bounded by ``max_rows`` and ``MAX_CHARS``,
spread over ``TRAINERS`` tasks. Each task passes over its rows ``EPOCHS`` times; weights are averaged, so
the driver sees at most ``2 ** BITS`` numbers whatever the input. Scoring
is a sparse dot product against the weights, sent once to each task.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.text import LOWER, Words, chunks, mix, rolling, texts_of, whole_runs

BITS = 18
TRAINERS = 6
EPOCHS = 3
MAX_ROWS = 24_000
MAX_CHARS = 200_000  # longer texts are scored, but nothing is learned from them
MINI_BATCH = 8
ALPHA, BETA, L1, L2 = 0.5, 0.05, 0.005, 0.01

_U = np.uint64
_KIND = np.zeros(256, dtype=np.uint8)  # of a byte: 1 lower, 2 upper, 3 digit, 4 mark, 5 other
_KIND[:] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_PLAIN = np.where(_KIND == 4, 32, LOWER).astype(np.uint8)  # lower case, marks as spaces


def _shapes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """How each word is written, and whether it stood one to four words before."""
    n = len(words)
    kind = _KIND[words.buffer]
    first, second = kind[words.start], kind[np.minimum(words.start + 1, words.end - 1)]
    last, before = words.buffer[words.end - 1], kind[np.maximum(words.end - 2, words.start)]
    last = np.where(_KIND[last] == 4, last, _KIND[last])
    length = np.minimum(words.end - words.start, 24) // 4
    again = np.zeros(n, dtype=np.int64)
    for back in (4, 3, 2, 1):
        same = np.zeros(n, dtype=bool)
        same[back:] = (hashes[back:] == hashes[:-back]) & (words.doc[back:] == words.doc[:-back])
        again[same] = back
    out = again
    for part, size in ((first, 8), (second, 8), (before, 8), (last, 256), (length, 8)):
        out = out * size + part
    return mix(out.astype(_U), 31)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc and feature of each n-gram of the texts, and the value that each text's n-grams have:
    one over the root of their number."""
    written = Words(texts)
    shape = _shapes(written, Words(texts, fold=True).hashes())
    spoken = Words([_PLAIN[np.frombuffer(t, dtype=np.uint8)].tobytes() for t in texts])
    docs, slots = [], []
    for words, source, widths, seed in (
        (spoken, spoken.hashes(), (1, 2), 41),
        (written, shape, (1, 2, 3), 51),
    ):
        for width in widths:
            inside = whole_runs(words.doc, width)
            slots.append(rolling(source, width, seed + width)[inside])
            docs.append(words.doc[: len(inside)][inside])
    doc = np.concatenate(docs)
    slot = (np.concatenate(slots) >> _U(64 - BITS)).astype(np.int64)
    count = np.bincount(doc, minlength=len(texts))
    return doc, slot, 1 / np.sqrt(np.maximum(count, 1))


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


class FollowTheLeader:
    """Weights of logistic regressions, learned by per-coordinate FTRL-proximal updates.

    Several models of the same texts are columns; each has its own targets.
    """

    def __init__(self, models: int = 1) -> None:
        self.z = np.zeros((1 << BITS, models))
        self.n = np.zeros((1 << BITS, models))
        self.bias_z, self.bias_n = np.zeros(models), np.zeros(models)

    def _weights(self, z, n, l1):
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def weights(self) -> np.ndarray:
        """All weights, the bias last; a column for each model."""
        bias = self._weights(self.bias_z, self.bias_n, 0.0)
        return np.vstack([self._weights(self.z, self.n, L1), bias])

    def learn(self, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray):
        """One step over a few texts; ``doc`` counts from 0, ``target`` has a column a model."""
        used, place = np.unique(slot, return_inverse=True)
        z, n = self.z[used], self.n[used]
        w = self._weights(z, n, L1)
        bias = self._weights(self.bias_z, self.bias_n, 0.0)
        g = np.empty_like(w)
        for k in range(w.shape[1]):
            margin = np.bincount(doc, weights=w[place, k] * value, minlength=len(target)) + bias[k]
            error = _probability(margin) - target[:, k]
            g[:, k] = np.bincount(place, weights=error[doc] * value)
            total = error.sum()
            step = (np.sqrt(self.bias_n[k] + total**2) - np.sqrt(self.bias_n[k])) / ALPHA
            self.bias_z[k] += total - step * bias[k]
            self.bias_n[k] += total**2
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[used] = z + g - step * w
        self.n[used] = n + g * g


def _train(batches: Iterable[pa.RecordBatch], models: int) -> Iterator[pa.RecordBatch]:
    """Weights of a task's rows. Texts go as soon as their features are taken, a chunk at a time."""
    slots, values, counts, places, labels = [], [], [], [], []
    for batch, texts in texts_of(batches, "text"):
        places.append(batch.column("place").to_numpy())
        labels.append(batch.column("label").to_numpy())
        for begin, end in chunks(texts, 1_000_000):
            doc, slot, value = features(texts[begin:end])
            slots.append(slot.astype(np.int32)[np.argsort(doc, kind="stable")])
            values.append(value)
            counts.append(np.bincount(doc, minlength=end - begin))
    if not slots:
        return
    value, count = np.concatenate(values), np.concatenate(counts)
    place, label = np.concatenate(places), np.concatenate(labels)
    slot = np.concatenate(slots)
    slots.clear()
    first = np.append(0, np.cumsum(count))
    target = (label[:, None] == np.arange(models)) if models > 1 else label[:, None]
    target = target.astype(float)
    model = FollowTheLeader(models)
    fixed = np.lexsort((label, place))  # whatever order the rows came in
    for epoch in range(EPOCHS):
        # another order in each pass, the same in each run
        order = fixed[np.argsort(mix(np.arange(len(label), dtype=_U), 60 + epoch))]
        for begin in range(0, len(order), MINI_BATCH):
            mine = order[begin : begin + MINI_BATCH]
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in mine])
            own = np.repeat(np.arange(len(mine)), [first[d + 1] - first[d] for d in mine])
            model.learn(own, slot[at], value[mine][own], target[mine])
    weights = model.weights()
    used = np.flatnonzero((weights != 0).any(axis=1))
    used = np.union1d(used, [len(weights) - 1])
    lists = pa.ListArray.from_arrays(
        pa.array(np.arange(0, len(used) * models + 1, models), pa.int32()),
        pa.array(weights[used].ravel() * len(label)),
    )
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), lists, pa.array(np.full(len(used), len(label)), pa.int32())],
        names=["slot", "weight", "rows"],
    )


def training_rows(
    docs: DataFrame, labelled: DataFrame, id_column: str, text: str, label: str, max_rows: int,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """``place, text, label``: the bounded sample that a classifier learns from.

    At most ``max_rows`` rows: ids and labels that are not null, those with the smallest hashes
    of their ids first; of the texts of one id, whatever their number, the one with the smallest
    hash. Texts that are null or of more than ``max_chars`` characters teach nothing.
    """
    known = (
        labelled.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("label"))
        .dropna()
        .distinct()
    )
    total = known.count()
    if total > max_rows:
        # a threshold on the hash first: little over max_rows rows are then sorted
        bound = int(2**31 * min(1.0, 1.2 * max_rows / total + 100 / total))
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(2**31)) < bound)
        known = known.orderBy(F.pmod(F.xxhash64("id"), F.lit(2**31)), "id", "label").limit(max_rows)
    return (
        docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .filter(F.length("text") <= max_chars)
        .join(F.broadcast(known), "id")  # bounded by max_rows
        .groupBy("id", "label")  # combined where the rows lie
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
        .select(
            F.xxhash64("id", F.lit(4)).alias("place"),
            F.col("first.text").alias("text"),
            F.col("label").cast("double").alias("label"),
        )
    )


def train(
    docs: DataFrame, labelled: DataFrame, id_column: str, text: str, label: str,
    max_rows: int = MAX_ROWS, models: int = 1,
) -> np.ndarray:
    """Weights learned from ``training_rows``; without any row all weights are 0.

    One model has labels 0 and 1 and gives a vector. Several learn from one pass over the same
    features: labels count from 0, model k tells label k from the others, and weights of models
    are columns.
    """
    rows = training_rows(docs, labelled, id_column, text, label, max_rows)
    dealt = rows.withColumn("trainer", F.pmod(F.xxhash64("place"), F.lit(TRAINERS)).cast("int"))
    # averaged before they reach the driver: a few numbers for each feature in use
    summed = (
        dealt.repartitionById(TRAINERS, "trainer")
        .mapInArrow(partial(_train, models=models), "slot int, weight array<double>, rows int")
        .groupBy("slot")
        .agg(*[F.sum(F.col("weight")[k]).alias(f"w{k}") for k in range(models)], F.sum("rows").alias("rows"))
        .toArrow()
    )
    weights = np.zeros(((1 << BITS) + 1, models))
    slots = summed.column("slot").to_numpy()
    for k in range(models):
        weights[slots, k] = summed.column(f"w{k}").to_numpy()
    taught = summed.column("rows").to_numpy()[slots == 1 << BITS].sum()  # all tasks have a bias
    weights /= max(1, taught)
    return weights if models > 1 else weights[:, 0]


def margins(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Log odds of each text; weights of several models are columns and give columns."""
    doc, slot, value = features(texts)
    return _sums(doc, slot, value, weights[:-1]) + weights[-1]


def _sums(doc, slot, value, weights) -> np.ndarray:
    if weights.ndim == 1:
        return np.bincount(doc, weights=weights[slot], minlength=len(value)) * value
    return np.stack([_sums(doc, slot, value, w) for w in weights.T], axis=1)


def score(
    docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs``, or the columns ``keep`` of them, and the probability of label 1 for each whole
    text in column ``name``. Columns that are not kept do not come back from Python."""
    packed = io.BytesIO()
    np.save(packed, weights.astype(np.float32))
    sent = docs.sparkSession.sparkContext.broadcast(packed.getvalue())  # bounded by 2 ** BITS
    kept = docs.columns if keep is None else list(keep)

    def scores(batches: Iterable[pa.RecordBatch]):
        known = np.load(io.BytesIO(sent.value)).astype(float)
        for batch, texts in texts_of(batches, text):
            values = np.concatenate(
                [margins(texts[a:b], known) for a, b in chunks(texts, 1_000_000)] or [np.zeros(0)]
            )
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(_probability(values))], names=[*kept, name]
            )

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(scores, ", ".join([*kinds, f"`{name}` double"]))


def score_quality(
    docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", text: str = "text",
    label: str = "quality", threshold: float = 0.3, max_rows: int = MAX_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Only texts enter a score. Null and empty texts have no features and get the score of the
    bias; equal texts get equal scores. Rows of ``docs`` are kept as they are, with all
    columns (or those of ``keep``) but earlier ones of these two names, which are replaced.
    A labelled id that many rows share teaches one text, see ``training_rows``; null ids and
    labels teach nothing.
    """
    weights = train(docs, labelled, id_column, text, label, max_rows)
    bare = docs.drop("score", "predicted")
    return score(bare, weights, text, keep=keep).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
