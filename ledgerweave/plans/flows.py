"""Totals, rollups, distinct counts, percentiles and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import (
    base64_form,
    base_units,
    block_day,
    hex_form,
    json_field,
    time_bucket,
    to_units,
    variant_field,
    with_shard,
)
from ledgerweave.operators import aggregates, joins, ranking, sets, slices
from ledgerweave.plans.registry import CENTS, SMALL_SLICES, plan
from ledgerweave.sources.ledger import Ledger


@plan("""
    SELECT c_custkey, c_name, CAST(count(*) AS BIGINT) AS n_messages,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM customer
    JOIN orders ON o_custkey = c_custkey
    JOIN lineitem ON l_orderkey = o_orderkey
    GROUP BY c_custkey, c_name
""")
def account_flow(t: Ledger) -> DataFrame:
    return aggregates.account_flow(
        t.customer.select("c_custkey", "c_name"),
        t.orders,
        t.lineitem,
        account_key="c_custkey",
        tx_key="o_orderkey",
        tx_account="o_custkey",
        msg_key="l_orderkey",
        value="l_extendedprice",
        scale=CENTS,
    )


@plan("""
    SELECT substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 1) AS shard,
           CAST(count(*) AS BIGINT) AS n_accounts,
           CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM customer GROUP BY 1
""")
def shard_totals(t: Ledger) -> DataFrame:
    return (
        with_shard(t.customer, "c_custkey", 1)
        .groupBy("shard")
        .agg(F.count(F.lit(1)).alias("n_accounts"), F.sum(to_units("c_acctbal", CENTS)).alias("balance"))
    )


@plan("""
    SELECT o_orderkey, o_custkey,
           CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 100) AS BIGINT) AS cents
    FROM orders
""")
def order_units(t: Ledger) -> DataFrame:
    cents = base_units("o_totalprice", CENTS).cast("bigint")
    return t.orders.select("o_orderkey", "o_custkey", cents.alias("cents"))


@plan("""
    SELECT o_orderkey, o_custkey, o_orderdate
    FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
""")
def time_slice(t: Ledger) -> DataFrame:
    sliced = slices.time_slice(t.orders, "o_orderdate", "1997-01-01", "1998-01-01")
    return sliced.select("o_orderkey", "o_custkey", "o_orderdate")


@plan("""
    SELECT c_custkey, c_name FROM customer
    WHERE starts_with(sha256(CAST(c_custkey AS VARCHAR)), 'a')
""")
def select_shard(t: Ledger) -> DataFrame:
    return slices.select_shard(t.customer, "a", id_col="c_custkey").select("c_custkey", "c_name")


@plan("""
    SELECT o_orderkey, o_custkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def attach_messages(t: Ledger) -> DataFrame:
    return joins.attach_messages(
        t.orders.select("o_orderkey", "o_custkey"),
        t.lineitem.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"
        ),
        "o_orderkey",
        "l_orderkey",
    ).drop("l_orderkey")


@plan("""
    SELECT o_orderkey, o_custkey FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def unmatched(t: Ledger) -> DataFrame:
    found = joins.unmatched(t.orders, t.lineitem, "o_orderkey", "l_orderkey")
    return found.select("o_orderkey", "o_custkey")


@plan("""
    SELECT o_orderkey, o_custkey FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)
""")
def matched(t: Ledger) -> DataFrame:
    found = joins.matched(
        t.orders, t.lineitem, "o_orderkey", "l_orderkey", F.col("l_quantity") > 30
    )
    return found.select("o_orderkey", "o_custkey")


@plan("""
    SELECT DISTINCT o_custkey AS src, l_suppkey AS dst
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
""")
def account_edges(t: Ledger) -> DataFrame:
    return joins.account_edges(
        t.orders, t.lineitem, "o_orderkey", "l_orderkey", "o_custkey", "l_suppkey"
    )


@plan("""
    SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS block,
           CAST(count(*) AS BIGINT) AS n_tx,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
           min(o_orderkey) AS first_id, max(o_orderkey) AS last_id
    FROM orders GROUP BY 1
""")
def block_summary(t: Ledger) -> DataFrame:
    return aggregates.block_summary(
        t.orders, block_day("o_orderdate"), "o_orderkey", "o_totalprice", CENTS
    )


_FLOW_KEYS = ["l_returnflag", "l_linestatus"]


def _labelled(df: DataFrame) -> DataFrame:
    # the level says which keys were summed over; the label keeps the key columns free of null
    return df.withColumns({key: F.coalesce(key, F.lit("(all)")) for key in _FLOW_KEYS})


_FLOW_SQL = """
    SELECT coalesce(l_returnflag, '(all)') AS l_returnflag,
           coalesce(l_linestatus, '(all)') AS l_linestatus,
           CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level,
           CAST(count(*) AS BIGINT) AS n_messages,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM lineitem GROUP BY {grouping}
"""


@plan(_FLOW_SQL.format(grouping="ROLLUP (l_returnflag, l_linestatus)"))
def flow_rollup(t: Ledger) -> DataFrame:
    return _labelled(aggregates.flow_rollup(t.lineitem, _FLOW_KEYS, "l_extendedprice", CENTS))


@plan(_FLOW_SQL.format(grouping="CUBE (l_returnflag, l_linestatus)"))
def flow_cube(t: Ledger) -> DataFrame:
    return _labelled(aggregates.flow_cube(t.lineitem, _FLOW_KEYS, "l_extendedprice", CENTS))


@plan(_FLOW_SQL.format(grouping="GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def flow_grouping_sets(t: Ledger) -> DataFrame:
    wanted = [["l_returnflag"], ["l_linestatus"], []]
    return _labelled(
        aggregates.flow_grouping_sets(t.lineitem, _FLOW_KEYS, wanted, "l_extendedprice", CENTS)
    )


@plan("""
    SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_parties
    FROM lineitem GROUP BY 1
""")
def distinct_parties(t: Ledger) -> DataFrame:
    return aggregates.distinct_parties(t.lineitem, ["l_returnflag"], "l_suppkey")


_APPROX_SQL = """
    SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS exact,
           true AS within_bound
    FROM lineitem GROUP BY 1
"""


def _within(exact: DataFrame, estimate: DataFrame) -> DataFrame:
    """Whether each estimate is within four standard errors of the sketch's precision."""
    bound = 4 * 1.04 / 2**7
    off = F.abs(F.col("n_parties") - F.col("exact")) / F.col("exact")
    joined = exact.withColumnRenamed("n_parties", "exact").join(estimate, "l_returnflag")
    return joined.select("l_returnflag", "exact", (off <= bound).alias("within_bound"))


@plan(_APPROX_SQL)
def distinct_parties_approx(t: Ledger) -> DataFrame:
    exact = aggregates.distinct_parties(t.lineitem, ["l_returnflag"], "l_partkey")
    direct = aggregates.distinct_parties_approx(t.lineitem, ["l_returnflag"], "l_partkey")
    return _within(exact, direct)


@plan(_APPROX_SQL)
def distinct_parties_error(t: Ledger) -> DataFrame:
    """The same with finer sketches that are stored and merged."""
    exact = aggregates.distinct_parties(t.lineitem, ["l_returnflag"], "l_partkey")
    fine = aggregates.parties_sketch(t.lineitem, ["l_returnflag", "l_linestatus"], "l_partkey")
    merged = aggregates.merge_sketches(fine, ["l_returnflag"])
    return _within(exact, merged)


_PERCENTILE_SQL = """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS percentile
    FROM lineitem GROUP BY 1
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("percentile", F.round("percentile", 6))


@plan(_PERCENTILE_SQL)
def fee_percentile(t: Ledger) -> DataFrame:
    return _rounded(
        aggregates.fee_percentile(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.9)
    )


@plan(_PERCENTILE_SQL)
def fee_percentile_cut(t: Ledger) -> DataFrame:
    """The same three groups, each holding a third of all rows, cut into slices."""
    return _rounded(
        aggregates.fee_percentile(
            t.lineitem, ["l_returnflag"], "l_extendedprice", 0.9, SMALL_SLICES
        )
    )


@plan("""
    SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n_messages
    FROM lineitem GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 10
""")
def heavy_destinations(t: Ledger) -> DataFrame:
    return aggregates.heavy_destinations(t.lineitem, "l_suppkey", 10)


@plan("""
    SELECT l_partkey, CAST(count(*) AS BIGINT) AS n_messages
    FROM lineitem GROUP BY 1 QUALIFY rank() OVER (ORDER BY count(*) DESC) <= 25
""")
def heavy_parts(t: Ledger) -> DataFrame:
    """The same where there are many destinations, each with few messages."""
    return aggregates.heavy_destinations(t.lineitem, "l_partkey", 25)


@plan("""
    SELECT o_orderkey, CAST(total AS DOUBLE) AS total, CAST(parts AS DOUBLE) AS parts, kind
    FROM (
      SELECT o_orderkey, total, coalesce(p, 0) AS parts,
             CASE WHEN p IS NULL THEN 'no messages'
                  WHEN p < total THEN 'short' ELSE 'over' END AS kind
      FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total FROM orders)
      LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p
                 FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    ) WHERE total <> parts
""")
def conservation_breaks(t: Ledger) -> DataFrame:
    return aggregates.conservation_breaks(
        t.orders, t.lineitem, "o_orderkey", "o_totalprice", "l_orderkey", "l_extendedprice", CENTS
    )


@plan("""
    SELECT o_orderpriority,
           CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS finished,
           CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS open,
           CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS partial,
           CAST(count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P') OR o_orderstatus IS NULL)
                AS BIGINT) AS other
    FROM orders GROUP BY 1
""")
def status_pivot(t: Ledger) -> DataFrame:
    return aggregates.status_pivot(
        t.orders, "o_orderpriority", "o_orderstatus", {"F": "finished", "O": "open", "P": "partial"}
    )


@plan("""
    SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20
""")
def top_holders(t: Ledger) -> DataFrame:
    return ranking.top_holders(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 20)


@plan("""
    SELECT o_custkey, o_orderkey, o_orderdate, rank FROM (
      SELECT o_custkey, o_orderkey, o_orderdate,
             row_number() OVER (PARTITION BY o_custkey
                                ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank
      FROM orders) WHERE rank <= 3
""")
def latest_per_account(t: Ledger) -> DataFrame:
    return ranking.latest_per_account(
        t.orders.select("o_custkey", "o_orderkey", "o_orderdate"),
        "o_custkey",
        [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()],
        3,
    )


@plan("""
    SELECT o_custkey AS account, o_orderpriority AS tag FROM orders
    EXCEPT ALL
    SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
""")
def removed(t: Ledger) -> DataFrame:
    pairs = t.orders.select(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("tag"))
    done = t.orders.filter(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderpriority")
    return sets.removed(pairs, done)


@plan("""
    SELECT o_custkey AS account, o_orderpriority AS tag FROM orders WHERE o_orderstatus = 'O'
    INTERSECT ALL
    SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
""")
def common(t: Ledger) -> DataFrame:
    def of(status: str) -> DataFrame:
        return t.orders.filter(F.col("o_orderstatus") == status).select(
            F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("tag")
        )

    return sets.common(of("O"), of("F"))


@plan("""
    SELECT c_custkey AS account FROM customer
    UNION SELECT o_custkey FROM orders
    UNION SELECT user_id FROM events
""")
def merge_shards(t: Ledger) -> DataFrame:
    return sets.merge_shards(
        t.customer.select(F.col("c_custkey").alias("account")),
        t.orders.select(F.col("o_custkey").alias("account")),
        t.events.select(F.col("user_id").alias("account")),
    )


@plan("""
    SELECT sha256(text) AS digest, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS n_copies
    FROM documents GROUP BY 1
""")
def dedupe_by_digest(t: Ledger) -> DataFrame:
    return sets.dedupe_by_digest(t.documents, "text", "doc_id")


@plan("""
    SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket,
           CAST(count(*) AS BIGINT) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM events GROUP BY 1
""")
def hourly_buckets(t: Ledger) -> DataFrame:
    return t.events.groupBy(time_bucket("ts", "1 hour").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(to_units("value", CENTS)).alias("total_value")
    )


@plan("""
    SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k
    FROM events GROUP BY 1
""")
def json_fields(t: Ledger) -> DataFrame:
    field = json_field("props", "$.k").cast("bigint")
    return t.events.groupBy("event_type").agg(F.sum(field).alias("k"))


@plan("""
    SELECT event_type, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k,
           CAST(count(*) AS BIGINT) AS n_events
    FROM events GROUP BY 1
""")
def variant_fields(t: Ledger) -> DataFrame:
    field = variant_field("props", "$.k", "bigint")
    return t.events.groupBy("event_type").agg(
        F.max(field).alias("k"), F.count(F.lit(1)).alias("n_events")
    )


@plan("""
    SELECT c_custkey, hex(c_name) AS as_hex, to_base64(CAST(c_name AS BLOB)) AS as_base64
    FROM customer
""")
def text_forms(t: Ledger) -> DataFrame:
    return t.customer.select(
        "c_custkey", hex_form("c_name").alias("as_hex"), base64_form("c_name").alias("as_base64")
    )
