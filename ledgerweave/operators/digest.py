"""Tree digest: one hash that commits to every row and to their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.operators.hotkeys import MIN_SLICE_ROWS
from ledgerweave.operators.windows import global_index

# Levels folded per shuffle: groups of 2 ** LEVELS neighbouring nodes.
LEVELS = 10


def row_text(columns: Sequence[str]) -> Column:
    """Text that is hashed into a leaf: each column's length in characters, ``:`` and its text,
    or ``~`` for null. Rows that differ have different texts."""

    def field(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("~"))

    return F.concat(*[field(name) for name in columns])


def _parents(nodes: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))

    def parent(pair: Column) -> Column:
        left = F.get(nodes, pair * 2)
        right = F.coalesce(F.get(nodes, pair * 2 + 1), left)
        return F.unhex(F.sha2(F.concat(left, right), 256))

    return F.transform(pairs, parent)


def _fold(nodes: Column, levels: int, to_root: bool) -> Column:
    """Go up ``levels`` levels; with ``to_root`` stop at the first single node."""

    def up(reached: Column, _: Column) -> Column:
        parents = _parents(reached)
        return F.when(F.size(reached) > 1, parents).otherwise(reached) if to_root else parents

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), nodes, up)


def _gather(nodes: DataFrame, group: Column, levels: int, to_root: bool) -> DataFrame:
    # a group holds at most 2 ** levels nodes, by construction of the index
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("index", "node"))), lambda item: item["node"]
    )
    gathered = nodes.groupBy(group.alias("_group")).agg(ordered.alias("_nodes"))
    return gathered.select(
        F.col("_group").alias("index"), _fold(F.col("_nodes"), levels, to_root)[0].alias("node")
    )


def tree_digest(
    df: DataFrame,
    order: Sequence[str],
    text: Column,
    levels: int = LEVELS,
    min_slice_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Root (hex) of a binary SHA-256 tree over the rows in ``order``, and the leaf count.

    A leaf is the SHA-256 of ``text``; a parent is the SHA-256 of its two children's bytes;
    a node without a right neighbour is paired with itself. One shuffle folds ``levels``
    levels: an aligned group of 2 ** levels nodes is a whole subtree, and the short last
    group pairs its odd nodes exactly as the whole level would, because it begins at an even
    position on each of those levels.
    """
    leaves = df.select(*order, F.unhex(F.sha2(text, 256)).alias("node"))
    n = leaves.count()
    if n == 0:
        raise ValueError("a tree needs at least one row")
    nodes = global_index(leaves, order, "index", min_slice_rows, n).select("index", "node")
    width = 1 << levels
    left = n
    while left > width:
        nodes = _gather(nodes, F.floor(F.col("index") / width), levels, to_root=False)
        left = -(-left // width)
    root = _gather(nodes, F.lit(0).cast("bigint"), levels, to_root=True)
    return root.select(
        F.lit(n).cast("bigint").alias("n_leaves"), F.lower(F.hex("node")).alias("root")
    )
