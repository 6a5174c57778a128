"""Shapes of plans that matter at scale."""

import glob
import os
import re

import pytest
from conftest import MEDIUM, plan_text, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from ledgerweave.operators import ranking, slices
from ledgerweave.session import scratch_root, shuffle_width, written
from ledgerweave.sources import layout
from ledgerweave.sources.ledger import Ledger, load_table

STREAMING = {
    "tumbling_counts", "sliding_counts", "sessions", "dedupe_stream", "match_stream",
    "running_totals", "running_totals_v2", "late_report", "upsert_accounts",
}
BATCH = [name for name in entry_module.queries() if name not in STREAMING]


@pytest.mark.parametrize("name", BATCH)
def test_no_product_join(spark, no_broadcast, name):
    text = plan_text(entry_module.queries()[name](spark, MEDIUM))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_top_n_is_limited_before_the_shuffle(spark):
    orders = load_table(spark, MEDIUM, "orders")
    text = plan_text(ranking.latest_per_account(orders, "o_custkey", [F.col("o_orderdate")], 2))
    assert text.count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_text(ranking.top_holders(orders, "o_totalprice", "o_orderkey", 5))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_text(entry_module.queries()["time_slice"](spark, MEDIUM))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate.*LessThan\(o_orderdate", text)
    assert "o_totalprice" not in text
    text = plan_text(entry_module.queries()["account_flow"](spark, MEDIUM))
    assert "l_shipdate" not in text and "o_totalprice" not in text


def test_shard_folders_are_pruned(spark, folder):
    orders = load_table(spark, MEDIUM, "orders").withColumn("year", F.year("o_orderdate"))
    layout.write_partitioned(orders, f"{folder}/t", ["o_orderstatus", "year"])
    assert len(glob.glob(f"{folder}/t/o_orderstatus=*/year=*")) >= 18
    stored = spark.read.parquet(f"{folder}/t")
    picked = slices.select_shard(stored, "F", shard_col="o_orderstatus").filter("year = 1996")
    assert re.search(r"PartitionFilters: \[.*StartsWith\(o_orderstatus", plan_text(picked))
    assert picked.count() == orders.filter("o_orderstatus = 'F' and year = 1996").count() > 0
    assert stored.count() == 15_000


def test_hot_folder_is_cut_over_several_tasks(spark, folder):
    """Nine tenths of the rows in one folder; the write must not be one task's work."""
    df = spark.range(400_000).select(
        "id", F.sha2(F.col("id").cast("string"), 256).alias("h"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(7).alias("k"),
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1m")
    try:
        layout.write_partitioned(df, f"{folder}/t", ["k"])
    finally:
        spark.conf.set(size, before)
    assert len(glob.glob(f"{folder}/t/k=7/*.parquet")) >= 3
    assert spark.read.parquet(f"{folder}/t").count() == 400_000


def test_canonical_order_is_total(spark, folder):
    orders = load_table(spark, MEDIUM, "orders").select("o_custkey", "o_orderkey")
    layout.canonical_order(orders, ["o_custkey", "o_orderkey"], files=5).write.parquet(f"{folder}/t")
    files = sorted(glob.glob(f"{folder}/t/*.parquet"))
    assert len(files) == 5
    read = [tuple(r) for file in files for r in spark.read.parquet(file).collect()]
    assert read == sorted(read) == rows(orders)


def test_written_tables_go_to_the_named_folder(spark, folder):
    key = "spark.checkpoint.dir"
    named = spark.conf.get(key, None)
    if named is not None:
        assert scratch_root(spark).startswith(named.rstrip("/"))
    table, path = written(spark.range(10), "probe")
    assert path.startswith(scratch_root(spark)) and rows(table) == [(i,) for i in range(10)]
    assert os.path.isdir(path)


def test_width_follows_the_session(spark):
    assert shuffle_width(spark) == 8


def test_streamed_and_batch_sessions_agree(spark):
    """Closed sessions of the stream are among those of the batch operator."""
    streamed = entry_module.queries()["sessions"](spark, MEDIUM)
    batch = entry_module.queries()["sessions_batch"](spark, MEDIUM)
    batch = batch.select(
        F.col("session_start").alias("window_start"), F.col("session_end").alias("window_end"),
        "user_id", "n_events", "total_value",
    )
    high = Ledger(spark, MEDIUM).events.agg(F.max("ts")).first()[0]
    closed = batch.filter(F.col("window_end") <= F.lit(high) - F.expr("INTERVAL 10 MINUTES"))
    assert rows(streamed.select(*closed.columns)) == rows(closed)
