"""Shards by binary prefix, pairs of follow-ups, totals by currency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import base_units, digest
from ledgerweave.operators import currency, pairs, shards
from ledgerweave.plans.registry import CENTS, SMALL_SLICES, plan
from ledgerweave.sources.ledger import Ledger

_BITS = 60  # of a digest, as text


def _bits(column: str) -> Column:
    return F.lpad(F.conv(F.substring(digest(column), 1, _BITS // 4), 16, 2), _BITS, "0")


def _bits_sql(column: str) -> str:
    nibbles = "".join(f"{n:04b}" for n in range(16))
    return f"""array_to_string(list_transform(range(1, {_BITS // 4 + 1}), lambda i: substr('{nibbles}',
        4 * strpos('0123456789abcdef', substr(sha256(CAST({column} AS VARCHAR)), i, 1)) - 3, 4)), '')"""


_SPECIFIC_SQL = f"""
    WITH s AS (SELECT DISTINCT substr({_bits_sql('s_suppkey')}, 1, CAST(2 + s_suppkey % 9 AS INTEGER)) AS prefix
               FROM supplier),
    a AS (SELECT c_custkey, {_bits_sql('c_custkey')} AS bits FROM customer)
    SELECT c_custkey, coalesce(max(prefix), '') AS shard, CAST(count(prefix) AS BIGINT) AS n_covering
    FROM a LEFT JOIN s ON starts_with(bits, prefix) GROUP BY 1
"""


def _specific(t: Ledger, **options) -> DataFrame:
    """Prefixes of 2 to 10 bits of suppliers' digests, some within others, with gaps."""
    prefixes = t.supplier.select(F.expr(f"substring({_bits_expr()}, 1, 2 + s_suppkey % 9)").alias("prefix"))
    found = shards.assign_most_specific(t.customer.select("c_custkey"), prefixes, "c_custkey", "prefix", **options)
    return found.withColumn("shard", F.coalesce("shard", F.lit("")))


def _bits_expr() -> str:
    return f"lpad(conv(substring(sha2(cast(s_suppkey as string), 256), 1, {_BITS // 4}), 16, 2), {_BITS}, '0')"


@plan(_SPECIFIC_SQL)
def most_specific_shard(t: Ledger) -> DataFrame:
    return _specific(t)


@plan(_SPECIFIC_SQL)
def most_specific_shard_cut(t: Ledger) -> DataFrame:
    return _specific(t, min_slice_rows=3)


@plan(f"""
    WITH o AS (SELECT o_orderkey, o_orderdate, year(o_orderdate) AS y, {_bits_sql('o_custkey')} AS bits
               FROM orders)
    SELECT o_orderkey,
           CASE WHEN y % 4 = 3 THEN '' ELSE
             substr(bits, 1, CAST(y % 4 + CASE WHEN substr(bits, 1, 1) = '1' THEN 3 ELSE 1 END AS INTEGER))
           END AS shard,
           CASE WHEN y % 4 = 3 THEN 0 ELSE y END AS since
    FROM o
""")
def shard_in_time(t: Ledger) -> DataFrame:
    """Shards that split and merge each year, one half of them finer; every fourth year has none."""
    years = t.orders.select(F.year("o_orderdate").alias("y")).distinct().filter("y % 4 <> 3")
    halves = years.select("y", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("half"))
    depth = F.col("y") % 4 + F.when(F.col("half") == "1", 3).otherwise(1)  # with the half's own bit
    versions = halves.withColumn("depth", depth.cast("int")).select(
        F.col("y"),
        F.explode(
            F.when(F.col("depth") == 1, F.array("half")).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.shiftleft(F.lit(1), 10) - 1),
                    lambda i: F.concat("half", F.right(F.lpad(F.bin(i), 10, "0"), F.col("depth") - 1)),
                )
            )
        ).alias("prefix"),
    ).distinct().select(
        "prefix",
        F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("begins"),
        F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("ends"),
    )
    probes = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    found = shards.assign_shard_at(
        probes, versions, "o_custkey", "o_orderdate", "prefix", "begins", "ends", min_slice_rows=SMALL_SLICES
    )
    return found.select(
        "o_orderkey",
        F.coalesce("shard", F.lit("")).alias("shard"),
        F.coalesce(F.year("shard_since"), F.lit(0)).alias("since"),
    )


_PAIRS_SQL = """
    SELECT {key}, o_orderkey, n_follow_ups, rank, follow_id, follow_time FROM (
      SELECT a.{key}, a.o_orderkey, b.o_orderkey AS follow_id, b.o_orderdate AS follow_time,
             CAST(count(*) OVER (PARTITION BY a.o_orderkey) AS BIGINT) AS n_follow_ups,
             CAST(row_number() OVER (PARTITION BY a.o_orderkey
                                     ORDER BY b.o_orderdate, b.o_orderkey) AS BIGINT) AS rank
      FROM orders a JOIN orders b ON a.{key} = b.{key} AND b.o_orderdate > a.o_orderdate
       AND b.o_orderdate <= a.o_orderdate + INTERVAL {days} DAYS)
    WHERE rank <= {most}
"""


def _pairs(t: Ledger, key: str, days: int, most: int | None = None, **options) -> DataFrame:
    return pairs.follow_up_pairs(t.orders, key, "o_orderdate", "o_orderkey", days, most, **options)


@plan(_PAIRS_SQL.format(key="o_custkey", days=180, most=1_000_000_000))
def follow_up_pairs(t: Ledger) -> DataFrame:
    return _pairs(t, "o_custkey", 180)


@plan(_PAIRS_SQL.format(key="o_orderpriority", days=20, most=2))
def follow_up_pairs_hot(t: Ledger) -> DataFrame:
    return _pairs(t, "o_orderpriority", 20, 2, min_slice_rows=SMALL_SLICES)


_LEGS = """
    legs AS (
      SELECT l_suppkey, 1 AS currency, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 100) AS HUGEINT) AS x
      FROM lineitem
      UNION ALL
      SELECT l_suppkey, 2, -CAST(round(CAST(l_tax AS DECIMAL(18,2)) * 100) AS HUGEINT) FROM lineitem
      WHERE l_returnflag <> 'R'),
    sums AS (
      SELECT l_suppkey, CAST(currency AS BIGINT) AS currency, CAST(count(*) AS BIGINT) AS n,
             CAST(CAST(sum(x) AS HUGEINT) AS VARCHAR) AS total
      FROM legs GROUP BY 1, 2)
"""


def _with_amounts(t: Ledger) -> DataFrame:
    """Lines with a map of amounts: the price in one currency, some with the tax in another."""
    price, tax = base_units("l_extendedprice", CENTS), base_units("l_tax", CENTS)
    both = F.create_map(F.lit(1), price, F.lit(2), -tax)
    amounts = F.when(F.col("l_returnflag") != "R", both).otherwise(F.create_map(F.lit(1), price))
    return t.lineitem.select("l_suppkey", amounts.alias("amounts"))


@plan(f"WITH {_LEGS} SELECT l_suppkey, currency, n, total FROM sums")
def currency_totals(t: Ledger) -> DataFrame:
    return currency.currency_totals(_with_amounts(t), ["l_suppkey"], "amounts")


@plan(f"""
    WITH {_LEGS}
    SELECT l_suppkey, string_agg(currency || '=' || total, ',' ORDER BY currency) AS totals
    FROM sums GROUP BY 1
""")
def currency_maps(t: Ledger) -> DataFrame:
    found = currency.currency_maps(_with_amounts(t), ["l_suppkey"], "amounts")
    entries = F.transform(F.map_entries("totals"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return found.select("l_suppkey", F.array_join(entries, ",").alias("totals"))
