"""Gaps, quorums, positions, ordered export and tree digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import base_units, with_shard
from ledgerweave.operators import digest, windows
from ledgerweave.plans.registry import SMALL_SLICES, plan
from ledgerweave.sources import layout
from ledgerweave.sources.ledger import Ledger

_GAPS_SQL = """
    WITH blocks AS (
      SELECT DISTINCT {shard} AS shard,
             CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) AS seqno
      FROM orders),
    linked AS (
      SELECT shard, seqno, lag(seqno) OVER (PARTITION BY shard ORDER BY seqno) AS prev
      FROM blocks)
    SELECT shard, prev + 1 AS gap_start, seqno - 1 AS gap_end, seqno - prev - 1 AS n_missing
    FROM linked WHERE seqno - prev > 1
"""


def _seqno():
    return F.date_diff("o_orderdate", F.lit("1995-01-01").cast("timestamp_ntz")).cast("bigint")


@plan(_GAPS_SQL.format(shard="substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 1)"))
def chain_gaps(t: Ledger) -> DataFrame:
    blocks = with_shard(t.orders, "o_custkey", 1).select("shard", _seqno().alias("seqno"))
    return windows.chain_gaps(blocks, ["shard"], "seqno")


@plan(_GAPS_SQL.format(shard="o_orderstatus"))
def chain_gaps_hot(t: Ledger) -> DataFrame:
    blocks = t.orders.select(F.col("o_orderstatus").alias("shard"), _seqno().alias("seqno"))
    return windows.chain_gaps(blocks, ["shard"], "seqno", min_slice_rows=100)


@plan(_GAPS_SQL.format(shard="'all'"))
def chain_gaps_global(t: Ledger) -> DataFrame:
    """One chain over all rows, still cut into slices."""
    blocks = t.orders.select(_seqno().alias("seqno"))
    gaps = windows.chain_gaps(blocks, [], "seqno", min_slice_rows=100)
    return gaps.select(F.lit("all").alias("shard"), "gap_start", "gap_end", "n_missing")


_QUORUM_SQL = """
    WITH validators AS (
      SELECT {columns}, CAST(count(*) AS BIGINT) AS weight FROM {source} GROUP BY ALL),
    summed AS (
      SELECT *, sum(weight) OVER ({part} ORDER BY weight DESC, id
                                  ROWS UNBOUNDED PRECEDING) AS cumulative,
             sum(weight) OVER ({part}) AS total FROM validators)
    SELECT {out}, weight, CAST(cumulative AS BIGINT) AS cumulative, CAST(total AS BIGINT) AS total
    FROM summed WHERE (cumulative - weight) * 3 {compare} total * 2
"""


def _weights(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*names).agg(F.count(F.lit(1)).alias("weight"))


@plan(_QUORUM_SQL.format(
    columns="l_suppkey AS id", source="lineitem", part="", out="id", compare="<="
))
def quorum(t: Ledger) -> DataFrame:
    """More than two thirds; a supplier's weight is its number of messages."""
    validators = _weights(t.lineitem.select(F.col("l_suppkey").alias("id")), "id")
    return windows.quorum(validators, "id", "weight")


@plan(_QUORUM_SQL.format(
    columns="o_orderpriority AS shard, o_custkey AS id",
    source="orders",
    part="PARTITION BY shard",
    out="shard, id",
    compare="<",
))
def quorum_per_shard(t: Ledger) -> DataFrame:
    """At least two thirds, per shard."""
    named = t.orders.select(
        F.col("o_orderpriority").alias("shard"), F.col("o_custkey").alias("id")
    )
    return windows.quorum(
        _weights(named, "shard", "id"), "id", "weight", ["shard"], more_than=False
    )


@plan(_QUORUM_SQL.format(
    columns="o_custkey AS id", source="orders", part="", out="id", compare="<="
))
def quorum_cut(t: Ledger) -> DataFrame:
    """One order over all accounts, cut into slices."""
    validators = _weights(t.orders.select(F.col("o_custkey").alias("id")), "id")
    return windows.quorum(validators, "id", "weight", min_slice_rows=100)


@plan("""
    SELECT o_orderkey, o_orderdate,
           row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position
    FROM orders
""")
def global_index(t: Ledger) -> DataFrame:
    return windows.global_index(
        t.orders.select("o_orderkey", "o_orderdate"),
        ["o_orderdate", "o_orderkey"],
        "position",
        min_slice_rows=SMALL_SLICES,
    )


@plan("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders")
def canonical_order(t: Ledger) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return layout.canonical_order(rows, ["o_custkey", "o_orderkey"])


@plan("""
    WITH RECURSIVE leaves AS (
      SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
             unhex(sha256(concat(length(a), ':', a, length(b), ':', b, length(c), ':', c,
                                 length(d), ':', d))) AS h,
             count(*) OVER () AS n
      FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b,
                   CAST(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT)
                        AS VARCHAR) AS c,
                   o_orderstatus AS d FROM orders)),
    tree AS (
      SELECT i, h, n FROM leaves
      UNION ALL
      SELECT i // 2,
             unhex(sha256(max(h) FILTER (i % 2 = 0)
                          || coalesce(max(h) FILTER (i % 2 = 1), max(h) FILTER (i % 2 = 0)))),
             (n + 1) // 2
      FROM tree WHERE n > 1 GROUP BY i // 2, n)
    SELECT (SELECT count(*) FROM orders) AS n_leaves, lower(hex(h)) AS root
    FROM tree WHERE n = 1
""")
def tree_digest(t: Ledger) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        "o_custkey",
        base_units("o_totalprice", 2).cast("bigint").alias("cents"),
        "o_orderstatus",
    )
    text = digest.row_text(["o_orderkey", "o_custkey", "cents", "o_orderstatus"])
    return digest.tree_digest(rows, ["o_orderkey"], text, min_slice_rows=SMALL_SLICES)
