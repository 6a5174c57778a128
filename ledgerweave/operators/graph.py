"""Reachability and connected components over account graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ledgerweave.session import drop_path, drop_written, written, written_by


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Nodes within ``hops`` steps of the start nodes along (src, dst), with distance.

    ``start`` has one column ``node``. Every round joins the edges only with the nodes that
    were new in the round before. The edges are written once instead of being computed in
    each round, laid out by ``src``, and so is each round's table: a lost executor costs at
    most one round. Whether new nodes are broadcast is left to the size that execution sees.
    """
    edges, edges_path = written_by(edges.select("src", "dst"), "src", "edges")
    frontier, _ = written(start.select("node").distinct(), "reach")
    found = frontier.withColumn("distance", F.lit(0))
    size = frontier.count()
    for distance in range(1, hops + 1):
        if size == 0:
            break
        # distinct combines before its shuffle, also behind a hub with very many neighbours
        step = (
            edges.join(frontier, F.col("src") == F.col("node"))
            .select(F.col("dst").alias("node"))
            .distinct()
        )
        frontier, _ = written(step.join(found.select("node"), "node", "left_anti"), "reach")
        size = frontier.count()
        found = found.unionByName(frontier.withColumn("distance", F.lit(distance)))
    drop_written(edges.sparkSession, edges_path)
    return found


def _written_pairs(pairs: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The pairs as a written table, its path, and a fingerprint taken while writing."""
    seen = Observation()
    marked = pairs.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.expr("bit_xor(xxhash64(src, dst))").alias("bits"),
        F.sum(F.xxhash64("dst", "src").cast("decimal(38,0)")).alias("total"),
    )
    table, path = written(marked, "stars")
    return table, path, tuple(seen.get[name] for name in ("rows", "bits", "total"))


def _lowest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src").agg(F.min("dst").alias("_low")).withColumnRenamed("src", "_node")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Point every higher neighbour of a node at the node's lowest neighbour, or at the node
    itself if it has no lower one. Pairs run from the higher to the lower node throughout."""
    lowest = _lowest(pairs)
    return pairs.join(lowest, F.col("dst") == F.col("_node"), "left").select(
        "src", F.coalesce("_low", "dst").alias("dst")
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Point a node and its lower neighbours at the lowest of them."""
    lowest = _lowest(pairs)
    ends = F.explode(F.array("src", "dst"))
    return (
        pairs.join(lowest, F.col("src") == F.col("_node"))
        .select(ends.alias("src"), F.col("_low").alias("dst"))
        .filter(F.col("src") > F.col("dst"))
        .distinct()
    )


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected component of each node: its lowest node id, as (node, component).

    Alternates the two star steps until nothing changes; the number of rounds grows with the
    logarithm of the size and not with the length of the longest path. All steps are
    aggregations to a minimum and joins against one row per node, so a hub is added up
    before its shuffle and its join is one that adaptive execution can split. Nodes that
    occur in no edge are included only if given in ``nodes`` (column ``node``).
    """
    spark = edges.sparkSession
    pairs = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(
            F.greatest("src", "dst").alias("src"),
            F.least("src", "dst").alias("dst"),
        )
        .distinct()
    )
    current, path, seen = _written_pairs(pairs)
    while True:
        following, next_path, mark = _written_pairs(_small_star(_large_star(current)))
        drop_path(spark, path)
        current, path = following, next_path
        if mark == seen:
            break
        seen = mark
    lowest = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = current.select(F.col("dst").alias("node")).distinct()
    labelled = lowest.unionByName(roots.withColumn("component", F.col("node")))
    if nodes is None:
        loops = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("node"))
    else:
        loops = nodes.select("node")
    alone = loops.distinct().join(labelled.select("node"), "node", "left_anti")
    return labelled.unionByName(alone.withColumn("component", F.col("node")))
