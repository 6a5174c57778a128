"""Nearest vectors by cosine, with randomly rotated one-bit codes.

A vector of length 1 is padded to ``bits`` dimensions and rotated by a random matrix; the
signs are its code, packed in words of 64 bits. With x the code as a vector of length 1, o the
rotated vector and q a rotated query, <x, q> / <x, o> estimates <o, q>. The error is below
``sqrt((1 - <x, o>^2) / <x, o>^2) * EPSILON / sqrt(bits - 1)`` but for a small chance.

A query is rounded to whole steps, of whose numbers each binary digit is a plane of bits. Its product
with a code is then a sum of population counts of the code's words with the planes; what rounding
can add to the error is added to the bound.

Blocks of queries meet blocks of vectors in a grid; a cell is one task's work and yields a few rows
for each query of the block. The vectors with the highest estimates are compared exactly; of the
others those whose upper bound reaches a score that is then already reached. Of equal vectors those
with the smallest ids stand for all, as no query can have others of them among its nearest: so a
vector that a third of all rows share is a few rows. Nothing is drawn, fitted or sampled but the
rotation, which follows from a seed, so all vectors are indexed and all are candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerweave.session import shuffle_width, written

BITS = 256
EPSILON = 2.5
SEED = 7
PLANES = 4  # binary digits of a rounded query's numbers
QUERY_BLOCK = 2048
VECTOR_BLOCK = 8192
NEAREST = 5


def rotation(dimension: int, bits: int, seed: int = SEED) -> np.ndarray:
    """The first ``dimension`` rows of a random orthogonal matrix."""
    normal = np.random.default_rng(seed).standard_normal((bits, bits))
    q, r = np.linalg.qr(normal)
    return (q * np.sign(np.diag(r)))[:dimension]


def _length(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no cosine and no digit, so that their
    largest numbers are about 1 and no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    return np.ldexp(vectors, -exponent[:, None])


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated vectors in words of 64 bits, and the product of each with its code."""
    turned = (vectors / _length(vectors)[:, None]) @ turn
    product = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
    return np.packbits(turned > 0, axis=1).view(np.uint64), product


def planes(query: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
    """A rotated query rounded to whole steps: the binary digits of these as packed planes, the
    least number, the step, and the rounded query."""
    low, high = query.min(), query.max()
    step = max((high - low) / (2**PLANES - 1), 1e-300)
    whole = np.rint((query - low) / step).astype(np.uint8)
    bits = np.stack([(whole >> j) & 1 for j in range(PLANES)])
    return np.packbits(bits, axis=1).view(np.uint64), low, step, low + step * whole


def estimates(codes: np.ndarray, products: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of a rotated query of length 1 with all codes, and how far off they are."""
    bits = len(query)
    plane, low, step, rounded = planes(query)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    weighted = np.zeros(len(codes), dtype=np.int64)
    for j in range(PLANES):
        weighted += np.bitwise_count(codes & plane[j]).sum(axis=1, dtype=np.int64) << j
    # the code's numbers are 1 and -1 over the root of bits
    inner = (2 * (step * weighted + low * ones) - rounded.sum()) / math.sqrt(bits)
    spread = EPSILON / math.sqrt(bits - 1)
    off = np.sqrt(np.maximum(0, 1 - products**2)) + math.sqrt(((query - rounded) ** 2).sum())
    return inner / products, off / products * spread + 1e-9


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors of one length without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _marks(vectors: np.ndarray) -> list[int]:
    """What tells apart vectors under one id."""
    return [xxhash.xxh3_64_intdigest(np.ascontiguousarray(v).tobytes()) >> 1 for v in vectors]


def _smallest_ids(ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that are among the ``most`` smallest ids of their vector."""
    rows = np.ascontiguousarray(vectors)
    whole = rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, group = np.unique(whole, return_inverse=True)
    order = np.lexsort((ids, group))
    same = group[order]
    first = np.searchsorted(same, same)
    return np.sort(order[np.arange(len(order)) - first < most])


def _fewer(batches: Iterable[pa.RecordBatch], dimension: int, most: int):
    """Rows of a batch without those that equal vectors of smaller ids stand for. Repeated rows may
    take places, so they go first."""
    for batch in batches:
        vectors = _matrix(batch.column("vector"), dimension)
        ids = batch.column("id").to_numpy()
        _, first = np.unique(np.stack([ids, np.array(_marks(vectors), dtype=np.int64)]), axis=1, return_index=True)
        kept = _smallest_ids(ids[first], vectors[first], most)
        yield batch.take(pa.array(first[kept]))


def _block_rows(batches: Iterable[pa.RecordBatch], dimension: int, bits: int, ask: bool, copies: int):
    """One row for each block (a task holds one): packed ids, vectors, and codes and their products,
    or of queries the rotated vectors. Equal rows count once, and go as they come; of equal vectors
    the ``copies`` smallest ids stay in a block of codes."""
    turn = rotation(dimension, bits)
    seen: dict[tuple[int, int], None] = {}
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    block = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block")[0].as_py()
        vectors = _matrix(batch.column("vector"), dimension)
        ids = batch.column("id").to_pylist()
        new = []
        for i, key in enumerate(zip(ids, _marks(vectors), strict=True)):
            if key not in seen:
                seen[key] = None
                new.append(i)
        vectors = scaled(vectors[new])
        if ask:
            turned = (vectors / _length(vectors)[:, None]) @ turn
            parts.append((turned, np.zeros(len(new)), vectors))
        else:
            parts.append((*encode(vectors, turn), vectors))
    if not seen:
        return
    first, second, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, marks = (np.array([k[i] for k in seen], dtype=np.int64) for i in (0, 1))
    kept = np.arange(len(ids)) if ask else _smallest_ids(ids, marks[:, None], copies)
    columns = {
        "ids": ids[kept], "codes": first[kept], "products": second[kept], "vectors": vectors[kept],
    }
    yield pa.RecordBatch.from_pydict(
        {"number": pa.array([block], pa.int32())}
        | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in columns.items()}
    )


def _nearest(query, turned, other, ids, codes, products, vectors, length, most):
    """Places and scores of a block's nearest vectors, among those of ``other`` ids."""
    enough = min(most, int(other.sum()))
    if not enough:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    estimate, off = estimates(codes, products, turned)
    own = math.sqrt((query * query).sum())

    def exact(at):
        return (vectors[at] * query).sum(axis=1) / (length[at] * own)

    first = np.argpartition(np.where(other, -estimate, np.inf), enough - 1)[:enough]
    reached = exact(first).min()  # that many vectors score at least this
    at = np.union1d(np.flatnonzero(other & (estimate + off >= reached)), first)
    scores = exact(at)
    best = np.lexsort((ids[at], -scores))[:most]
    return at[best], scores[best]


def _cells(batches: Iterable[pa.RecordBatch], dimension: int, bits: int, most: int):
    """The nearest vectors of a cell for each of its queries."""

    def numbers(row, name, kind):
        return np.frombuffer(row.column(name)[0].as_py(), dtype=kind)

    for many in batches:
        for i in range(many.num_rows):
            cell = many.slice(i, 1)
            ids = numbers(cell, "ids", np.int64)
            codes = numbers(cell, "codes", np.uint64).reshape(len(ids), -1)
            products = numbers(cell, "products", np.float64)
            vectors = numbers(cell, "vectors", np.float64).reshape(-1, dimension)
            length = _length(vectors)
            q_ids = numbers(cell, "q_ids", np.int64)
            queries = numbers(cell, "q_vectors", np.float64).reshape(-1, dimension)
            turned = numbers(cell, "q_codes", np.float64).reshape(len(q_ids), bits)
            found = []
            for q_id, query, turn in zip(q_ids, queries, turned, strict=True):
                at, score = _nearest(query, turn, ids != q_id, ids, codes, products, vectors, length, most)
                found.append((np.full(len(at), q_id), ids[at], score))
            if found:
                q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_pydict(
                    {"q": pa.array(q), "id": pa.array(v), "score": pa.array(s)}
                )


def _usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id, vector`` of the rows that take part, whatever their length."""
    return (
        table.select(
            F.col(f"`{id_column}`").cast("long").alias("id"),
            F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        )
        .filter("id is not null and size(vector) > 0")
        .filter(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))  # NaN is above
        .filter(F.exists("vector", lambda x: x != 0))
    )


def _dimension(rows: DataFrame) -> int:
    """The length that most of the rows have, 0 if there are none."""
    common = (
        rows.groupBy(F.size("vector").alias("length"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), F.desc("length"))
        .first()
    )
    return common["length"] if common else 0


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    most: int = NEAREST,
    bits: int = BITS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``most`` nearest vectors of each query by cosine.

    Both tables have a whole-number id and an array of numbers. Equal scores go to the
    smaller id; rows with the query's own id are never its neighbours. Rows that are equal in
    id and vector count once; of different vectors under one query id the nearest of any count.
    Rows take no part if the id or vector is null, a component is null or not finite, the vector is
    zero, or its length is not the one that most of the other ``vectors`` have (of equally many, the
    longer). Components may be as large or small as doubles are. An empty table or no partner gives
    no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    every = _usable(vectors, id_column, vector)
    dimension = _dimension(every)
    if not dimension:
        return spark.createDataFrame([], schema)
    every = every.filter(F.size("vector") == dimension)
    asked = _usable(queries, id_column, vector).filter(F.size("vector") == dimension)
    bits = 64 * math.ceil(max(bits, dimension) / 64)

    def blocks(rows: DataFrame, size: int, name: str, ask: bool) -> tuple[DataFrame, int]:
        total = rows.count()
        n = max(math.ceil(total / size), min(12, shuffle_width(spark), math.ceil(total / 64)), 1)
        if not ask:  # combined where the rows lie
            call = partial(_fewer, dimension=dimension, most=most + 1)
            rows = rows.mapInArrow(call, "id long, vector array<double>")
        by = ["id", "vector"] if ask else ["vector"]
        dealt = rows.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(n)).cast("int"))
        made = dealt.repartitionById(n, "block").mapInArrow(
            partial(_block_rows, dimension=dimension, bits=bits, ask=ask, copies=most + 1),
            "number int, ids binary, codes binary, products binary, vectors binary",
        )
        return written(made, name)[0], n

    codes, n_codes = blocks(every, VECTOR_BLOCK, "code-blocks", False)
    rotated, n_queries = blocks(asked, QUERY_BLOCK, "query-blocks", True)
    columns = rotated.select(
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "codes", "vectors")],
        F.col("number").alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(n_codes - 1))).alias("a"),
    )
    rows = codes.withColumnRenamed("number", "a").withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))
    )
    cells = rows.join(columns.hint("shuffle_merge"), ["a", "b"]).drop("a", "b")
    found = cells.mapInArrow(
        partial(_cells, dimension=dimension, bits=bits, most=most), "q long, id long, score double"
    )
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= most)
        .select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
    )
