"""Hard negatives by inner product, filtered by summaries of vector segments.

A vector is cut into segments; of each its mean and its deviation are stored. With L numbers in a
segment, means a and b and deviations c and d, the segment's part of the inner product of two
vectors is within ``L * a * b`` plus or minus ``L * c * d``, as what is left of two vectors without
their means has at most the product of its lengths. The sums over all segments bound the score.
A few segments come first; vectors that these bounds do not settle get finer ones, and only
what is left then is multiplied out. At each level the rows whose bounds lie highest are multiplied
out at once, and what they reach rules out rows whose upper bound is less.

Rows are dealt into blocks by a hash; blocks of anchors meet blocks of rows in a grid, a cell being
one task's work that yields a few rows for each anchor. The grid is passed twice: for each anchor's
positives, and then for the negatives, whose range follows from the positives' scores.
All arithmetic on scores is on whole numbers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerweave.session import shuffle_width, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score between which a negative's lies
LEVELS = (8, 32)  # segments, coarse to fine
ROW_BLOCK, ANCHOR_BLOCK = 8192, 1024
_EXACT = 2**53  # whole numbers up to which double arithmetic is exact


# Blocks


def _whole_numbers(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """Vectors times SCALE, rounded down; all rows have ``dimension`` finite numbers."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    numbers = np.floor(flat.astype(np.float64)).reshape(-1, dimension)
    if numbers.size and np.abs(numbers).max() >= 2**31:
        raise OverflowError("a component times the scale has more than 32 bits")
    return numbers.astype(np.int32)


def summaries(numbers: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each segment, both times the root of the segment's length."""
    d = numbers.shape[1]
    cuts = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    x = numbers.astype(np.float64)
    size = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    spread = np.add.reduceat((x - np.repeat(total / size, size, axis=1)) ** 2, cuts[:-1], axis=1)
    return total / np.sqrt(size), np.sqrt(spread)


def _block_rows(batches: Iterable[pa.RecordBatch], dimension: int, positives: bool):
    """One row for each block (a task holds one): packed columns and summaries of its rows.

    Rows that are equal in id, label and numbers count once, and go as they come.
    """
    seen: dict[tuple, int] = {}
    block = 0
    extra: list[tuple[bytes, bytes]] = []
    for batch in batches:
        numbers = _whole_numbers(batch, dimension)
        ids, labels = (batch.column(c).to_pylist() for c in ("id", "label"))
        block = batch.column("block")[0].as_py() if batch.num_rows else block
        for i, (ident, label) in enumerate(zip(ids, labels, strict=True)):
            key = (ident, label, numbers[i].tobytes())
            if key not in seen:
                seen[key] = len(seen)
                if positives:
                    own = batch.column("positives")[i].as_py()
                    extra.append((
                        np.array([p["row"] for p in own], dtype=np.int64).tobytes(),
                        np.array([p["score"] for p in own], dtype=np.int64).tobytes(),
                    ))
    if not seen:
        return
    keys = list(seen)
    order = sorted(range(len(keys)), key=lambda i: (keys[i][1], keys[i][0]))  # by label
    keys = [keys[i] for i in order]
    numbers = np.frombuffer(b"".join(k[2] for k in keys), dtype=np.int32).reshape(-1, dimension)
    columns = {
        "ids": np.array([k[0] for k in keys], dtype=np.int64).tobytes(),
        "labels": np.array([k[1] for k in keys], dtype=np.int64).tobytes(),
        # two rows may share an id; this tells them apart
        "marks": np.array([xxhash.xxh3_64_intdigest(k[2], seed=k[1] & (2**64 - 1)) >> 1 for k in keys],
                          dtype=np.int64).tobytes(),
        "numbers": numbers.tobytes(),
    }
    for level, segments in enumerate(LEVELS):
        mean, deviation = summaries(numbers, segments)
        columns[f"means{level}"] = mean.astype(np.float32).tobytes()
        columns[f"deviations{level}"] = deviation.astype(np.float32).tobytes()
    if positives:
        columns["of"] = b"".join(extra[i][0] for i in order)
        columns["scores"] = b"".join(extra[i][1] for i in order)
        columns["counts"] = np.array([len(extra[i][0]) // 8 for i in order], dtype=np.int32).tobytes()
    yield pa.RecordBatch.from_pydict(
        {"number": pa.array([block], pa.int32())}
        | {name: pa.array([value], pa.binary()) for name, value in columns.items()}
    )


def _columns(positives: bool) -> list[str]:
    names = ["ids", "labels", "marks", "numbers"]
    names += [f"{kind}{level}" for level in range(len(LEVELS)) for kind in ("means", "deviations")]
    return names + (["of", "scores", "counts"] if positives else [])


def _blocks(rows: DataFrame, dimension: int, size: int, name: str, positives: bool = False):
    """A written table of blocks and their number; rows reach their block by a hash."""
    spark = rows.sparkSession
    total = rows.count()
    n = max(math.ceil(total / size), min(12, shuffle_width(spark), math.ceil(total / 64)), 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(n)).cast("int"))
    packed = ", ".join(f"{c} binary" for c in _columns(positives))
    made = dealt.repartitionById(n, "block").mapInArrow(
        partial(_block_rows, dimension=dimension, positives=positives), f"number int, {packed}"
    )
    return written(made, name)[0], n


class _Block:
    """The columns of a block as arrays."""

    def __init__(self, row: pa.RecordBatch, prefix: str, dimension: int):
        def numbers(name, kind):
            return np.frombuffer(row.column(prefix + name)[0].as_py(), dtype=kind)

        self.ids, self.labels, self.marks = (numbers(c, np.int64) for c in ("ids", "labels", "marks"))
        self.numbers = numbers("numbers", np.int32).reshape(-1, dimension)
        self.levels = [
            tuple(numbers(f"{kind}{level}", np.float32).reshape(len(self.ids), -1)
                  for kind in ("means", "deviations"))
            for level in range(len(LEVELS))
        ]
        self.length = np.sqrt((self.numbers.astype(np.float64) ** 2).sum(axis=1))
        most = np.abs(self.numbers.astype(np.int64)).max(initial=0)
        self.most = int(most)
        if prefix + "counts" in row.schema.names:
            counts = numbers("counts", np.int32)
            self.first = np.append(0, np.cumsum(counts))
            self.of, self.scores = numbers("of", np.int64), numbers("scores", np.int64)


def bounds(rows: _Block, at: np.ndarray, anchors: _Block, a: int, level: int):
    """Lowest and highest score that rows ``at`` can have with an anchor, from one level's
    summaries. The summaries are of single precision, which the last term makes up for."""
    mean, deviation = rows.levels[level]
    own_mean, own_deviation = anchors.levels[level]
    middle = (mean[at] @ own_mean[a]).astype(np.float64)
    reach = (deviation[at] @ own_deviation[a]).astype(np.float64)
    reach += 1e-5 * rows.length[at] * anchors.length[a] + 1e-6
    return middle - reach, middle + reach


def exact(rows: _Block, at: np.ndarray, anchors: _Block, a: int) -> np.ndarray:
    """Scores as whole numbers."""
    d = rows.numbers.shape[1]
    largest = d * rows.most * anchors.most
    if largest >= 2**63:
        raise OverflowError("a score may have more than 64 bits")
    kind = np.float64 if largest < _EXACT else np.int64
    return (rows.numbers[at].astype(kind) @ anchors.numbers[a].astype(kind)).astype(np.int64)


def _reached(rows, at, anchors, a, middle, most, floor=-np.inf, roof=np.inf) -> float:
    """A score between ``floor`` and ``roof`` that ``most`` of the rows ``at`` are sure to reach, from
    the exact scores of those in the middle of whose bounds is highest."""
    inside = np.flatnonzero(middle <= roof)
    if len(inside) > 2 * most:
        inside = inside[np.argpartition(-middle[inside], 2 * most - 1)[: 2 * most]]
    score = exact(rows, at[inside], anchors, a)
    score = score[(score >= floor) & (score <= roof)]
    return -np.inf if len(score) < most else np.partition(score, len(score) - most)[len(score) - most]


def _nearest_in(rows: _Block, anchors: _Block, most: int):
    """(anchor, row, score) of the best rows of the anchor's label for each anchor."""
    found = []
    begin = np.searchsorted(rows.labels, anchors.labels)
    end = np.searchsorted(rows.labels, anchors.labels, side="right")
    for a in range(len(anchors.ids)):
        at = np.arange(begin[a], end[a])
        at = at[rows.ids[at] != anchors.ids[a]]
        for level in range(len(LEVELS)):
            if len(at) <= most:
                break
            low, high = bounds(rows, at, anchors, a, level)
            at = at[high >= _reached(rows, at, anchors, a, low + high, most)]
        if len(at):
            score = exact(rows, at, anchors, a)
            best = np.lexsort((rows.ids[at], -score))[:most]
            found.append((np.full(len(best), a), at[best], score[best]))
    return found


def _between_in(rows: _Block, anchors: _Block, most: int, percent: tuple[int, int]):
    """(positive, row, score) of the best rows of other labels in each positive's range."""
    found = []
    begin = np.searchsorted(rows.labels, anchors.labels)
    end = np.searchsorted(rows.labels, anchors.labels, side="right")
    everything = np.arange(len(rows.ids))
    for a in range(len(anchors.ids)):
        own = np.arange(anchors.first[a], anchors.first[a + 1])
        score = anchors.scores[own].tolist()
        floor = np.array([-(-percent[0] * p // 100) for p in score])  # least whole score allowed
        roof = np.array([percent[1] * p // 100 for p in score])
        own, floor, roof = (x[floor <= roof] for x in (own, floor, roof))
        at = np.concatenate([everything[: begin[a]], everything[end[a] :]])
        at = at[rows.ids[at] != anchors.ids[a]]
        for level in range(len(LEVELS)):
            if not len(own) or not len(at):
                break
            low, high = bounds(rows, at, anchors, a, level)
            needed = np.zeros(len(at), dtype=bool)
            for f, r in zip(floor, roof, strict=True):
                within = (high >= f) & (low <= r)
                needed |= within & (high >= _reached(rows, at, anchors, a, (low + high) / 2, most, f, r))
            at = at[needed]
        if not len(own) or not len(at):
            continue
        score = exact(rows, at, anchors, a)
        order = np.lexsort((rows.ids[at], -score))
        at, score = at[order], score[order]
        for p, f, r in zip(own, floor, roof, strict=True):
            first = int(np.searchsorted(-score, -r))  # scores fall
            last = int(np.searchsorted(-score, -f, side="right"))
            best = np.arange(first, min(last, first + most))
            if len(best):
                found.append((np.full(len(best), p), at[best], score[best]))
    return found


def _cells(batches: Iterable[pa.RecordBatch], dimension: int, most: int, percent):
    for many in batches:
        for i in range(many.num_rows):
            cell = many.slice(i, 1)
            rows, anchors = _Block(cell, "", dimension), _Block(cell, "a_", dimension)
            if percent is None:
                found = _nearest_in(rows, anchors, most)
            else:
                found = _between_in(rows, anchors, most, percent)
            if not found:
                continue
            who, row, score = (np.concatenate(part) for part in zip(*found, strict=True))
            if percent is not None:
                place = np.searchsorted(anchors.first, who, side="right") - 1
                out = {"positive": anchors.of[who], "positive_score": anchors.scores[who]}
            else:
                place, out = who, {}
            out |= {"anchor": anchors.ids[place], "mark": anchors.marks[place],
                    "row": rows.ids[row], "score": score}
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})


def _grid(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int) -> DataFrame:
    """Each block of rows with each block of anchors."""
    right = anchors.select(
        *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "number"],
        F.col("number").alias("a"),
        F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"),
    )
    left = rows.withColumnRenamed("number", "r").withColumn(
        "a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))
    )
    return left.join(right.hint("shuffle_merge"), ["r", "a"]).drop("r", "a")


def _best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _common_length(rows: DataFrame) -> int:
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    first = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    return first["length"] if first else 0


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: tuple[int, int] = (LOW, HIGH),
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as ``floor(scale * x)``, a score is the whole inner product with the
    anchor; higher scores come first, equal ones by smaller id. ``anchors`` is a condition on the
    columns of ``vectors``. The positives of an anchor are the first ``positives`` other rows of its
    label. For each of them the first ``negatives`` rows of other labels are given whose score is
    between the two ``percent`` of the positive's, both included; a negative positive's range is
    empty.

    Rows take no part if the id, label or vector is null, the vector is empty, a component is null
    or not finite, or the length is not the one that most rows have (of equally many, the longer).
    Rows equal in id, label and numbers count once; a row is no partner of rows with its own
    id, and rows that share an id but differ are anchors each, with ranks of their own. Components
    times scale of 32 bits or more, and scores that may need over 64, raise OverflowError. An empty
    table, or no anchor, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, "
              "positive_score long, negative_score long")  # fmt: skip
    numbers = F.col(f"`{vector}`").cast("array<double>")
    usable = (
        vectors.select(
            F.col(f"`{id_column}`").cast("long").alias("id"),
            F.col(f"`{label}`").cast("long").alias("label"),
            F.transform(numbers, lambda x: x * F.lit(float(scale))).alias("vector"),
            F.coalesce(anchors, F.lit(False)).alias("anchor"),
        )
        .filter("id is not null and label is not null and size(vector) > 0")
        .filter(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))  # NaN is above
    )
    dimension = _common_length(usable)
    if not dimension:
        return spark.createDataFrame([], schema)
    usable = usable.filter(F.size("vector") == dimension)
    rows, n_rows = _blocks(usable.drop("anchor"), dimension, ROW_BLOCK, "row-blocks")
    asking = usable.filter("anchor").drop("anchor")
    asked, n_asked = _blocks(asking, dimension, ANCHOR_BLOCK, "anchor-blocks")
    near = _grid(rows, n_rows, asked, n_asked).mapInArrow(
        partial(_cells, dimension=dimension, most=positives, percent=None),
        "anchor long, mark long, row long, score long",
    )
    own = _best(near.distinct(), ["anchor", "mark"], positives)
    marks = partial(_marked, dimension=dimension)
    with_marks = asking.mapInArrow(marks, "id long, label long, vector array<double>, mark long")
    listed = own.groupBy("anchor", "mark").agg(F.collect_list(F.struct("row", "score")).alias("positives"))
    answered = with_marks.join(
        listed.withColumnRenamed("anchor", "id"), ["id", "mark"]
    ).drop("mark")
    answered, _ = written(answered, "anchors-with-positives")
    asked, n_asked = _blocks(answered, dimension, ANCHOR_BLOCK, "anchor-blocks", positives=True)
    between = _grid(rows, n_rows, asked, n_asked).mapInArrow(
        partial(_cells, dimension=dimension, most=negatives, percent=percent),
        "positive long, positive_score long, anchor long, mark long, row long, score long",
    )
    best = _best(between.distinct(), ["anchor", "mark", "positive", "positive_score"], negatives)
    return best.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("row").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _marked(batches: Iterable[pa.RecordBatch], dimension: int):
    """Rows with the mark that blocks give them."""
    for batch in batches:
        numbers = _whole_numbers(batch, dimension)
        labels = batch.column("label").to_pylist()
        marks = [
            xxhash.xxh3_64_intdigest(numbers[i].tobytes(), seed=label & (2**64 - 1)) >> 1
            for i, label in enumerate(labels)
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(marks, pa.int64())], names=[*batch.schema.names, "mark"]
        )
