"""Ordered work per key that stays parallel when one key holds a large share of the rows.

A window partitioned by account puts all rows of an account into one task. That is right
for ordinary accounts. For the few that hold far more than one task's share, the rows are
cut into consecutive slices of the order; each slice is a window partition of its own, and
what the earlier slices contribute is added from a table with one row per slice.

A slice holds a partition's share of the rows, but no fewer than ``min_slice_rows`` and no
more than MAX_SLICE_ROWS. A hot key has more than two slices, so there are at most 1.5 slices
per partition, or 1.5 per MAX_SLICE_ROWS rows of the table if that is more. That bound is what
makes it safe to broadcast the per-slice tables: 50,000 rows of some bytes for 10^12 rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ledgerweave.session import shuffle_width, written

# Below this many rows one task sorts a key without trouble, whatever its share.
MIN_SLICE_ROWS = 1_000_000
# More rows than this are never left in one slice, however few partitions there are.
MAX_SLICE_ROWS = 20_000_000
# Sampled rows per slice when choosing where to cut; affects balance, never the result.
SAMPLE_PER_SLICE = 50

SLICE = "_slice"
# True on rows of hot keys. Filters use this and not SLICE: the optimizer would move a filter
# on SLICE below the search and repeat the search inside it.
CUT = "_slice_cut"
_AT = "_slice_at"
_BOUNDS = "_slice_bounds"
_KEY = "_slice_key_"


@dataclass(frozen=True)
class HotKeys:
    """Keys to be cut: a table (key columns, ``_rows``, ``_slices``), one row per key."""

    keys: tuple[str, ...]
    table: DataFrame
    rows: int
    slices: int


def _slice_rows(total: int, width: int, min_slice_rows: int) -> int:
    return max(min_slice_rows, min(math.ceil(total / width), MAX_SLICE_ROWS))


def find_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    min_slice_rows: int = MIN_SLICE_ROWS,
    total: int | None = None,
) -> HotKeys | None:
    """Keys with more than two slices' worth of rows, or None.

    Without keys the whole table is one; its number of rows can be given as ``total``.

    One aggregation over the key columns alone, combined on the map side. Only if the largest
    key is hot, a second one lists the hot keys.
    """
    spark = df.sparkSession
    width = shuffle_width(spark)
    if not keys:
        total = df.count() if total is None else total
        share = _slice_rows(total, width, min_slice_rows)
        if total <= 2 * share:
            return None
        slices = math.ceil(total / share)
        table = spark.createDataFrame([(total, slices)], "_rows bigint, _slices int")
        return HotKeys((), table, total, slices)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    share = _slice_rows(total or 0, width, min_slice_rows)
    if not total or largest <= 2 * share:
        return None
    found = [
        (*row[: len(keys)], row["_rows"], math.ceil(row["_rows"] / share))
        for row in counts.filter(F.col("_rows") > 2 * share).collect()
    ]
    schema = T.StructType(
        [df.schema[key] for key in keys]
        + [T.StructField("_rows", T.LongType()), T.StructField("_slices", T.IntegerType())]
    )
    return HotKeys(
        tuple(keys),
        spark.createDataFrame(found, schema),
        sum(row[-2] for row in found),
        sum(row[-1] for row in found),
    )


def _renamed(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    for position, key in enumerate(keys):
        table = table.withColumnRenamed(key, f"{_KEY}{position}")
    return table


def _same_keys(keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for position, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"{_KEY}{position}"))
    return condition


def _drop_renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{_KEY}{position}" for position, _ in enumerate(keys)])


def split_hot(
    df: DataFrame, keys: Sequence[str], min_slice_rows: int = MIN_SLICE_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys, and those of hot keys (None if there are no hot keys).

    What is then ordered from the first part needs no counting: see ``NOTHING_HOT``.
    """
    hot = find_hot_keys(df, keys, min_slice_rows)
    if hot is None:
        return df, None
    listed = F.broadcast(_renamed(hot.table.select(*keys), keys))
    condition = _same_keys(keys)
    return df.join(listed, condition, "left_anti"), df.join(listed, condition, "left_semi")


# Given to KeyedOrder in place of a finding: its keys are known to be ordinary.
NOTHING_HOT = "nothing hot"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal ``keys``, null being equal to null; ``right``'s keys are dropped."""
    return _drop_renamed(left.join(_renamed(right, keys), _same_keys(keys)), keys)


def _slice_bounds(df: DataFrame, order: Sequence[str], hot: HotKeys) -> DataFrame:
    """Per hot key, the order positions where its slices begin, from a sample of its rows.

    Written once, so that every later reading of the rows cuts at the same places.
    """
    keys = hot.keys
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rows = df.select(*keys, at.alias(_AT))
    if keys:
        listed = F.broadcast(_renamed(hot.table.select(*keys, "_slices"), keys))
        rows = _drop_renamed(rows.join(listed, _same_keys(keys)), keys)
    else:
        rows = rows.withColumn("_slices", F.lit(hot.slices))
    fraction = min(1.0, SAMPLE_PER_SLICE * hot.slices / hot.rows)
    sampled = rows.sample(fraction=fraction, seed=17) if fraction < 1.0 else rows
    picked = sampled.groupBy(*keys, "_slices").agg(F.sort_array(F.collect_list(_AT)).alias("_seen"))
    place = F.transform(
        F.sequence(F.lit(1), F.col("_slices") - 1),
        lambda i: F.get(
            F.col("_seen"), F.floor(i * F.size("_seen") / F.col("_slices")).cast("int")
        ),
    )
    bounds = picked.select(
        *keys, F.array_distinct(F.filter(place, lambda at: at.isNotNull())).alias(_BOUNDS)
    )
    return written(bounds, "slice-bounds")[0]


def _with_slice(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """Adds CUT, and SLICE: 0 without bounds, else one more than the bounds at or before.

    A search by halving, one projection per step. Each step is compiled; a search inside a
    higher-order function would be interpreted for every row.
    """
    at = F.col(order[0]) if len(order) == 1 else F.col(_AT)
    if len(order) > 1:
        df = df.withColumn(_AT, F.struct(*order))
    df = df.withColumn(SLICE, F.lit(0))
    for bit in range(max(1, most.bit_length()) - 1, -1, -1):
        target = F.col(SLICE) + (1 << bit)
        bound = F.get(_BOUNDS, target - 1)
        # past the last bound this is null, and so not passed
        passed = bound <= at
        df = df.withColumn(SLICE, F.when(passed, target).otherwise(F.col(SLICE)))
    number = F.when(F.col(_BOUNDS).isNull(), 0).otherwise(F.col(SLICE) + 1)
    cut = F.col(_BOUNDS).isNotNull()
    return df.withColumns({SLICE: number, CUT: cut}).drop(_BOUNDS, _AT)


class KeyedOrder:
    """Rows of each key in ascending ``order`` (nulls first), with running results over them.

    ``order`` decides where slices may be cut: rows equal on key and order stay together.
    ``tie`` only adds to the sort within a slice. Without keys the whole table is one
    order. Each method returns a new object whose ``df`` has more columns.

    Where keys are cut, a result reads its input again to learn what each slice adds, so
    ``df`` must give the same rows each time; pass a written table if it does not, or if it
    is expensive to compute.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        tie: Sequence[str] = (),
        min_slice_rows: int = MIN_SLICE_ROWS,
        finding: HotKeys | str | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        self.tie = list(tie)
        if finding is None:
            finding = find_hot_keys(df, self.keys, min_slice_rows)
        self.hot = None if finding == NOTHING_HOT else finding
        if self.hot is None:
            self.df = df
            return
        bounds = _slice_bounds(df, self.order, self.hot)
        if self.keys:
            listed = F.broadcast(_renamed(bounds, self.keys))
            placed = _drop_renamed(df.join(listed, _same_keys(self.keys), "left"), self.keys)
        else:
            placed = df.withColumn(_BOUNDS, bounds.select(_BOUNDS).scalar())
        self.df = _with_slice(placed, self.order, self.hot.slices)

    def with_df(self, df: DataFrame) -> KeyedOrder:
        """The same keys, order and slices over rows derived from ``self.df``."""
        other = object.__new__(KeyedOrder)
        other.keys, other.order, other.tie = self.keys, self.order, self.tie
        other.hot, other.df = self.hot, df
        return other

    def done(self) -> DataFrame:
        return self.df if self.hot is None else self.df.drop(SLICE, CUT)

    def _group(self) -> list[str]:
        return self.keys if self.hot is None else [*self.keys, SLICE]

    def _window(self, tie: bool = True) -> WindowSpec:
        order = self.order + (self.tie if tie else [])
        return Window.partitionBy(*self._group()).orderBy(*order)

    def _over_slices(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(SLICE)

    def _every_slice(self) -> DataFrame:
        """One row per slice of the hot keys, known without reading the rows."""
        number = F.explode(F.sequence(F.lit(1), F.col("_slices")))
        return self.hot.table.select(*self.keys, number.alias(SLICE))

    def _on_slice(self, df: DataFrame, per_slice: DataFrame) -> DataFrame:
        group = self._group()
        named = F.broadcast(_renamed(per_slice, group))
        return _drop_renamed(df.join(named, _same_keys(group), "left"), group)

    def sums(
        self,
        running: Mapping[str, Column],
        totals: Mapping[str, Column] | None = None,
        peers: bool = False,
    ) -> KeyedOrder:
        """Running sums up to each row, or up to the last of its equals in ``order`` if
        ``peers``; and sums over all rows of the key."""
        totals = totals or {}
        if peers:
            frame = self._window(tie=False).rangeBetween(Window.unboundedPreceding, 0)
        else:
            frame = self._window().rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*self._group())
        here = {out: F.sum(value).over(frame) for out, value in running.items()}
        all_here = {out: F.sum(value).over(whole) for out, value in totals.items()}
        if self.hot is None:
            return self.with_df(self.df.withColumns({**here, **all_here}))

        earlier = self._over_slices().rowsBetween(Window.unboundedPreceding, -1)
        every = Window.partitionBy(*self.keys)
        named = {**running, **totals}
        added = (
            self.df.filter(CUT)
            .groupBy(*self._group())
            .agg(*[F.sum(value).alias(f"_slice_{out}") for out, value in named.items()])
        )
        carried = added.select(
            *self._group(),
            *[F.sum(f"_slice_{out}").over(earlier).alias(f"_slice_{out}") for out in running],
            *[F.sum(f"_slice_{out}").over(every).alias(f"_slice_{out}") for out in totals],
        )
        df = self._on_slice(self.df, carried)
        results = {}
        for out, inside in here.items():
            before = F.col(f"_slice_{out}")
            results[out] = F.when(before.isNull(), inside).otherwise(
                before + F.coalesce(inside, F.lit(0))
            )
        for out, inside in all_here.items():
            results[out] = F.when(F.col(CUT), F.col(f"_slice_{out}")).otherwise(inside)
        return self.with_df(df.withColumns(results).drop(*[f"_slice_{out}" for out in results]))

    def last(self, out: str, value: Column, inclusive: bool = True) -> KeyedOrder:
        """The latest non-null ``value`` up to this row, or strictly before it."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        here = F.last(value, ignorenulls=True).over(frame)
        if self.hot is None:
            return self.with_df(self.df.withColumn(out, here))

        position = F.struct(*self.order, *self.tie)
        newest = (
            self.df.filter(F.col(CUT) & value.isNotNull())
            .groupBy(*self._group())
            .agg(F.max_by(value, position).alias("_slice_newest"))
        )
        # a slice may hold no value, so the newest is handed on over every slice number
        earlier = self._over_slices().rowsBetween(Window.unboundedPreceding, -1)
        carried = self._on_slice(self._every_slice(), newest).select(
            *self._group(),
            F.last("_slice_newest", ignorenulls=True).over(earlier).alias("_slice_before"),
        )
        df = self._on_slice(self.df, carried)
        both = F.coalesce(here, F.col("_slice_before"))
        return self.with_df(df.withColumn(out, both).drop("_slice_before"))
