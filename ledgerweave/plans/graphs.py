"""Shard assignment, reachability and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import digest
from ledgerweave.operators import graph, joins, windows
from ledgerweave.plans.registry import plan
from ledgerweave.sources.ledger import Ledger


@plan("""
    WITH ids AS (SELECT c_custkey, sha256(CAST(c_custkey AS VARCHAR)) AS h FROM customer),
    loads AS (SELECT substr(h, 1, 1) AS p, count(*) AS n FROM ids GROUP BY 1),
    shards AS (
      SELECT p AS prefix FROM loads WHERE n * 16 <= (SELECT count(*) FROM customer)
      UNION ALL
      SELECT DISTINCT substr(h, 1, 2) FROM ids
      WHERE substr(h, 1, 1) IN (
        SELECT p FROM loads WHERE n * 16 > (SELECT count(*) FROM customer)))
    SELECT c_custkey, prefix FROM ids JOIN shards ON starts_with(h, prefix)
""")
def assign_shard(t: Ledger) -> DataFrame:
    """Shards of mixed depth: a one-digit shard with more than its share of accounts is split."""
    ids = t.customer.select("c_custkey", digest("c_custkey").alias("h"))
    loads = ids.groupBy(F.substring("h", 1, 1).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    total = loads.agg(F.sum("n").alias("total")).scalar()
    split = loads.withColumn("busy", F.col("n") * 16 > total)
    whole = split.filter(~F.col("busy")).select(F.col("p").alias("prefix"))
    halves = (
        ids.withColumn("p", F.substring("h", 1, 1))
        .join(split.filter("busy").select("p"), "p", "left_semi")
        .select(F.substring("h", 1, 2).alias("prefix"))
        .distinct()
    )
    shards = whole.unionByName(halves)
    return joins.assign_shard(t.customer.select("c_custkey"), shards, "c_custkey", "prefix")


@plan("""
    WITH RECURSIVE edges AS (
      SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
    reached AS (
      SELECT 'c0' AS node, 0 AS distance
      UNION
      SELECT dst, distance + 1 FROM reached JOIN both_ways ON src = node WHERE distance < 3)
    SELECT node, CAST(min(distance) AS BIGINT) AS distance FROM reached GROUP BY 1
""")
def reachable(t: Ledger) -> DataFrame:
    """Accounts within three messages of one account, in either direction."""
    pairs = joins.account_edges(
        t.orders, t.lineitem, "o_orderkey", "l_orderkey", "o_custkey", "l_suppkey"
    )
    named = pairs.select(
        F.concat(F.lit("c"), F.col("src").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("dst").cast("string")).alias("dst"),
    )
    start = named.filter(F.col("src") == "c0").select(F.col("src").alias("node")).distinct()
    return graph.reachable(graph.both_directions(named), start, 3)


@plan("""
    SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component
    FROM orders
""")
def components(t: Ledger) -> DataFrame:
    """Transactions chained to the previous one of their account: one component per account,
    each a path as long as the account's history."""
    tx = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    linked = windows.prev_link(tx, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    edges = linked.filter(F.col("prev_o_orderkey").isNotNull()).select(
        F.col("prev_o_orderkey").alias("src"), F.col("o_orderkey").alias("dst")
    )
    return graph.components(edges, t.orders.select(F.col("o_orderkey").alias("node")))


@plan("""
    WITH RECURSIVE edges AS (
      SELECT DISTINCT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
    walk AS (
      SELECT a AS node, a AS label FROM both_ways
      UNION
      SELECT b, label FROM walk JOIN both_ways ON a = node)
    SELECT node, min(label) AS component FROM walk GROUP BY 1
""")
def account_components(t: Ledger) -> DataFrame:
    """Accounts connected by messages."""
    pairs = joins.account_edges(
        t.orders, t.lineitem, "o_orderkey", "l_orderkey", "o_custkey", "l_suppkey"
    )
    edges = pairs.select((F.col("src") * 2).alias("src"), (F.col("dst") * 2 + 1).alias("dst"))
    return graph.components(edges)
