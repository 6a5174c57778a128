"""Nested records, partitioned folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import json_entries, with_shard
from ledgerweave.operators import slices
from ledgerweave.plans.registry import plan
from ledgerweave.session import scratch_path
from ledgerweave.sources import layout
from ledgerweave.sources.ledger import Ledger, flatten_records, load_ledger


@plan("""
    SELECT event_id, CAST(pos - 1 AS BIGINT) AS pos, key,
           CAST(json_extract_string(props, '$.' || key) AS BIGINT) AS value
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS key,
                 generate_subscripts(json_keys(props), 1) AS pos FROM events)
""")
def flatten_records_json(t: Ledger) -> DataFrame:
    return flatten_records(t.events, "event_id", json_entries("props", "bigint"))


@plan("""
    SELECT vec_id, CAST(pos - 1 AS BIGINT) AS pos, round(CAST(value AS DOUBLE), 6) AS value
    FROM (SELECT vec_id, unnest(embedding) AS value,
                 generate_subscripts(embedding, 1) AS pos FROM embeddings)
""")
def flatten_records_array(t: Ledger) -> DataFrame:
    flat = flatten_records(t.embeddings, "vec_id", "embedding")
    return flat.withColumn("value", F.round(F.col("value").cast("double"), 6))


@plan("""
    SELECT o_orderkey, o_custkey, substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 1) AS shard,
           CAST(year(o_orderdate) AS BIGINT) AS year
    FROM orders
    WHERE year(o_orderdate) = 1997
      AND starts_with(sha256(CAST(o_custkey AS VARCHAR)), 'a')
""")
def write_partitioned(t: Ledger) -> DataFrame:
    """Write all orders by shard and year, then read one shard's year back from its folder."""
    path = scratch_path(t.spark, "partitioned")
    rows = with_shard(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", 1)
    layout.write_partitioned(
        rows.withColumn("year", F.year("o_orderdate")).drop("o_orderdate"), path, ["shard", "year"]
    )
    stored = t.spark.read.schema(
        "o_orderkey bigint, o_custkey bigint, shard string, year int"
    ).parquet(path)
    return slices.select_shard(stored, "a", shard_col="shard").filter(F.col("year") == 1997)


_COUNTED = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


@plan("\nUNION ALL\n".join(
    f"SELECT '{name}' AS name, CAST(count(*) AS BIGINT) AS n_rows FROM {name}" for name in _COUNTED
))
def load_ledger_counts(t: Ledger) -> DataFrame:
    """Every table read with its schema checked."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        for name, df in load_ledger(t.spark, t.directory).items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result
