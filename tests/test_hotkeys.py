"""Cutting hot keys must not change any result."""

import random

import pytest
from conftest import plan_text, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerweave.operators import aggregates, temporal, windows
from ledgerweave.operators.hotkeys import CUT, SLICE, KeyedOrder, find_hot_keys, split_hot


def skewed(spark, n=4000, seed=3, null_times=False):
    """One key with half of the rows, one with a fifth, many times repeated, values null."""
    pick = random.Random(seed)
    data = []
    for ident in range(n):
        share = pick.random()
        key = "hot" if share < 0.5 else "warm" if share < 0.7 else f"k{pick.randrange(60)}"
        if share > 0.98:
            key = None
        time = None if null_times and pick.random() < 0.05 else pick.randrange(400)
        value = None if pick.random() < 0.1 else pick.randrange(-50, 1000)
        data.append((ident, key, time, value))
    return spark.createDataFrame(data, "id bigint, k string, t int, v bigint").repartition(5)


def test_hot_keys_found(spark):
    hot = find_hot_keys(skewed(spark), ["k"], min_slice_rows=100)
    assert {row["k"] for row in hot.table.collect()} == {"hot"}
    assert hot.rows > 1500 and hot.slices >= 4
    assert find_hot_keys(skewed(spark), ["k"], min_slice_rows=10_000) is None
    assert find_hot_keys(skewed(spark).filter("false"), ["k"], 1) is None
    assert find_hot_keys(skewed(spark).filter("false"), [], 1) is None


def test_slices_cover_and_follow_the_order(spark):
    ordered = KeyedOrder(skewed(spark, null_times=True), ["k"], ["t", "id"], (), 100)
    found = ordered.df.filter("k = 'hot'").groupBy(SLICE).agg(
        F.count("*").alias("n"), F.min(F.struct("t", "id")).alias("lo"),
        F.max(F.struct("t", "id")).alias("hi"),
    ).orderBy(SLICE).collect()
    assert len(found) >= 4
    assert max(row["n"] for row in found) < 3 * min(row["n"] for row in found) + 100
    ends = [(tuple(a["hi"]), tuple(b["lo"])) for a, b in zip(found, found[1:])]
    assert all(hi < lo for hi, lo in ends if None not in hi + lo)
    assert ordered.df.filter(~F.col(CUT)).select(SLICE).distinct().collect() == [(0,)]


@pytest.mark.parametrize("null_times", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_sums_and_last(spark, keys, null_times):
    df = skewed(spark, null_times=null_times)
    by = Window.partitionBy(*keys)
    total = by.orderBy("t", "id")
    expected = df.select(
        "*",
        F.sum("v").over(total.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.sum("v").over(by.orderBy("t").rangeBetween(Window.unboundedPreceding, 0)).alias("peer"),
        F.sum("v").over(by).alias("whole"),
        F.last("v", True).over(total.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.last("v", True).over(total.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
    )
    fine = KeyedOrder(df, keys, ["t", "id"], (), 100).sums({"run": F.col("v")}, {"whole": F.col("v")})
    fine = fine.last("upto", F.col("v")).last("prev", F.col("v"), inclusive=False)
    coarse = KeyedOrder(df, keys, ["t"], (), 100).sums({"peer": F.col("v")}, peers=True)
    found = fine.done().join(coarse.done().select("id", "peer"), "id").select(*expected.columns)
    assert fine.hot is not None and coarse.hot is not None
    key = lambda row: row[0]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(
        map(tuple, expected.collect()), key=key
    )


def test_values_missing_in_whole_slices(spark):
    """The only value lies in the first slice and must reach the last one."""
    df = spark.range(1000).select(
        F.lit("a").alias("k"), F.col("id").alias("t"), F.when(F.col("id") == 3, 42).alias("v")
    )
    found = KeyedOrder(df, ["k"], ["t"], (), 50).last("seen", F.col("v"))
    assert found.hot is not None
    assert found.done().filter("t >= 3 and seen = 42").count() == 997
    assert found.done().filter("t < 3 and seen is null").count() == 3


def test_one_instant_holds_most_rows(spark):
    """Equal times cannot be cut apart; they are added up first."""
    df = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") < 2500, "a").otherwise("b").alias("k"),
        F.timestamp_seconds(
            F.when(F.col("id") < 2000, 86400 * 10).otherwise(86400 * (F.col("id") % 40))
        ).cast("timestamp_ntz").alias("t"),
    )
    one = F.lit(1).cast("bigint")
    plain = temporal.trailing_volume(df, "k", "t", one, 7)
    cut = temporal.trailing_volume(df, "k", "t", one, 7, min_slice_rows=50)
    assert rows(plain.select("id", "volume", "n_tx")) == rows(cut.select("id", "volume", "n_tx"))
    window = (
        Window.partitionBy("k").orderBy(F.col("t").cast("timestamp").cast("long"))
        .rangeBetween(-7 * 86400, 0)
    )
    assert rows(plain.select("id", "n_tx")) == rows(
        df.select("id", F.count("*").over(window).alias("n_tx"))
    )
    plain = temporal.follow_ups(df, "k", "t", "id", 5)
    cut = temporal.follow_ups(df, "k", "t", "id", 5, min_slice_rows=50)
    assert rows(plain) == rows(cut)
    pairs = df.alias("a").join(
        df.alias("b"),
        F.expr("a.k = b.k and b.t > a.t and b.t <= a.t + interval 5 days"),
    )
    assert rows(plain.select("id", "n_follow_ups", "first_id")) == rows(
        pairs.groupBy("a.id").agg(
            F.count("*"), F.min(F.struct("b.t", "b.id"))["id"].alias("first")
        )
    )


def test_split_hot_is_a_partition(spark):
    df = skewed(spark)
    cold, hot = split_hot(df, ["k"], 100)
    assert cold.filter("k = 'hot'").count() == 0 and hot.filter("k <> 'hot'").count() == 0
    assert rows(cold.unionByName(hot).select("id")) == rows(df.select("id"))
    assert cold.filter("k is null").count() == df.filter("k is null").count() > 0


def test_null_key_can_be_hot(spark):
    df = spark.range(2000).select(
        "id", F.when(F.col("id") % 10 == 0, "x").alias("k"), F.lit(1).alias("v")
    )
    found = KeyedOrder(df, ["k"], ["id"], (), 50).sums({"n": F.col("v")})
    assert found.hot is not None
    assert found.done().filter("k is null").agg(F.max("n"), F.count("*")).first() == (1800, 1800)


def test_percentile_equals_builtin(spark):
    df = skewed(spark)
    built_in = df.groupBy("k").agg(F.percentile("v", 0.37).alias("p"))
    for size in (50, 1_000_000):
        found = aggregates.fee_percentile(df, ["k"], "v", 0.37, size)
        joined = found.join(built_in, found["k"].eqNullSafe(built_in["k"]))
        assert joined.count() == built_in.count() > 50
        assert joined.filter(F.abs(F.col("percentile") - F.col("p")) > 1e-9).count() == 0


def test_global_index_is_dense(spark):
    df = skewed(spark)
    found = windows.global_index(df, ["t", "id"], "i", min_slice_rows=50)
    listed = [tuple(row) for row in found.select("i", "t", "id").orderBy("i").collect()]
    assert [row[0] for row in listed] == list(range(4000))
    assert [row[1:] for row in listed] == sorted(row[1:] for row in listed)


def test_cut_windows_are_partitioned_by_slice(spark):
    df = skewed(spark)
    cut = windows.running_balance(df, "k", ["t", "id"], F.col("v"), min_slice_rows=100)
    assert f"hashpartitioning(k" in plan_text(cut) and SLICE in plan_text(cut)
    assert "SinglePartition" not in plan_text(
        windows.global_index(df, ["t", "id"], "i", min_slice_rows=100).select("i", "id")
    ).split("BroadcastExchange")[0]
