"""Nulls, amounts of any size, and limits that must not change a result."""

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest
from conftest import MEDIUM, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

import check
from ledgerweave.functions.columns import base_units, to_units
from ledgerweave.operators import aggregates, digest, hotkeys, joins, temporal, windows
from ledgerweave.plans import all_plans
from ledgerweave.sources.ledger import Ledger, SchemaDrift, load_table, missing_columns

START = dt.datetime(2024, 1, 1)


def holed(spark, n=3000, seed=11):
    """One null key with most rows, null times and values, many equal instants."""
    pick = random.Random(seed)
    data = []
    for ident in range(n):
        key = None if pick.random() < 0.6 else f"k{pick.randrange(30)}"
        time = None if pick.random() < 0.03 else START + dt.timedelta(days=pick.randrange(300))
        value = None if pick.random() < 0.4 else pick.randrange(-9, 99)
        data.append((ident, f"id{ident:05d}", key, time, value))
    return spark.createDataFrame(data, "id bigint, name string, k string, t timestamp_ntz, v bigint")


@pytest.mark.parametrize("size", [50, hotkeys.MIN_SLICE_ROWS])
def test_trailing_volume_equals_range_window(spark, size):
    df = holed(spark)
    assert (hotkeys.find_hot_keys(df, ["k"], size) is not None) == (size == 50)
    found = temporal.trailing_volume(df, "k", "t", F.col("v"), 7, size)
    window = (
        Window.partitionBy("k").orderBy(F.col("t").cast("timestamp").cast("long"))
        .rangeBetween(-7 * 86400, 0)
    )
    expected = df.select(
        "id", F.sum("v").over(window).alias("volume"), F.count("*").over(window).alias("n_tx")
    )
    sort = lambda df: sorted(map(tuple, df.select("id", "volume", "n_tx").collect()))
    assert [r[0] for r in sort(found)] == list(range(3000))
    assert sort(found) == sort(expected)


def test_volume_of_nulls_alone_is_null(spark):
    data = [(1, "a", START, 5), (2, "a", START + dt.timedelta(days=60), None)]
    df = spark.createDataFrame(data, "id int, k string, t timestamp_ntz, v int")
    found = temporal.trailing_volume(df, "k", "t", F.col("v"), 7)
    assert rows(found.select("id", "volume", "n_tx")) == [(1, 5, 1), (2, None, 1)]


@pytest.mark.parametrize("size", [50, hotkeys.MIN_SLICE_ROWS])
@pytest.mark.parametrize("ident", ["id", "name"])
def test_follow_ups_equal_pairs(spark, size, ident):
    df = holed(spark, 900)
    found = temporal.follow_ups(df, "k", "t", ident, 5, size)
    pairs = df.alias("a").join(
        df.alias("b"), F.expr("a.k <=> b.k and b.t > a.t and b.t <= a.t + interval 5 days")
    )
    expected = pairs.groupBy("a.id").agg(
        F.count("*"), F.min(F.struct("b.t", f"b.{ident}"))[ident].alias("first")
    )
    assert rows(found.select("id", "n_follow_ups", "first_id")) == rows(expected)
    assert expected.count() > 500


@pytest.mark.parametrize("size", [50, hotkeys.MIN_SLICE_ROWS])
def test_records_without_time_are_no_state(spark, size):
    records = spark.createDataFrame(
        [("x", None, 7), ("x", 10, 1), (None, 5, 2)] + [(None, n, n) for n in range(100, 400)],
        "id string, t int, v int",
    )
    probes = spark.createDataFrame(
        [("x", 9), ("x", 11), ("x", None), (None, 6), (None, 250)], "id string, p int"
    )
    found = temporal.state_as_of_each(records, probes, "id", "t", "p", ["v"], ["v"], size)
    assert sorted(map(str, found.select("id", "p", "v").collect())) == sorted(map(str, [
        *spark.createDataFrame(
            [("x", 9, None), ("x", 11, 1), ("x", None, None), (None, 6, 2), (None, 250, 250)],
            "id string, p int, v int",
        ).collect()
    ]))


def test_sessions_without_times(spark):
    events = spark.createDataFrame(
        [(1, "a", START), (2, "a", None), (3, None, START), (4, None, None)],
        "id int, k string, t timestamp_ntz",
    )
    for size in (1, hotkeys.MIN_SLICE_ROWS):
        found = temporal.sessions_batch(events, "k", "t", "id", 60, [F.count("*").alias("n")], size)
        assert found.count() == 2 and found.agg(F.sum("n")).first()[0] == 2


def test_state_diff_with_null_keys(spark):
    before = spark.createDataFrame([(None, 1), ("b", None), ("c", 3)], "id string, v int")
    after = spark.createDataFrame([(None, 1), ("b", 2), ("d", None)], "id string, v int")
    found = joins.state_diff(before, after, ["id"], "v")
    assert rows(found) == [
        ("b", None, 2, "changed"), ("c", 3, None, "removed"), ("d", None, None, "added"),
    ]


def test_long_ids_have_shards(spark):
    ids = spark.createDataFrame([("0:" + "a" * 64,)], "id string")
    shards = spark.createDataFrame([("0:" + "a" * 63,)], "prefix string")
    assert joins.assign_shard(ids, shards, "id", "prefix", hashed=False).count() == 1
    assert joins.assign_shard(ids, shards, "id", "prefix").count() == 0


def test_leaves_of_different_rows_differ(spark):
    data = [("a|b", "c"), ("a", "b|c"), (None, ""), ("", None), ("1:a", ""), ("", "1:a")]
    df = spark.createDataFrame(data, "x string, y string")
    assert df.select(digest.row_text(["x", "y"]).alias("t")).distinct().count() == len(data)


def test_status_pivot_counts_the_rest(spark):
    df = spark.createDataFrame([("r", "F"), ("r", "O"), ("r", "X"), ("r", None)], "k string, s string")
    found = aggregates.status_pivot(df, "k", "s", {"F": "finished", "O": "open"})
    assert rows(found) == [("r", 1, 1, 2)] and found.columns == ["k", "finished", "open", "other"]


def test_heavy_destinations_among_many(spark):
    common = spark.range(50_000).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(8))))
    top = spark.range(10).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(500))))
    msg = common.unionByName(top).select(F.col("id").alias("dst"))
    assert rows(aggregates.heavy_destinations(msg, "dst", 10)) == [(n, 508) for n in range(10)]
    rough = aggregates.heavy_destinations_approx(msg, "dst", 10)
    assert not any(row["exact"] for row in rough.collect())


def test_small_and_large_amounts(spark):
    amounts = [Decimal("0.000000001"), Decimal("0.004"), Decimal(2 * 10**9), Decimal(10**20)]
    df = spark.createDataFrame([("a", n, v) for n, v in enumerate(amounts)], "k string, i int, v decimal(38,9)")
    total = Decimal("100000000002000000000.004000001")
    rolled = aggregates.flow_rollup(df, ["k"], "v", 9)
    assert {row["total_value"] for row in rolled.collect()} == {total}
    block = aggregates.block_summary(df, F.col("k"), "i", "v", 9).first()
    assert block["total_value"] == total
    assert df.agg(F.sum(to_units("v", 9))).first()[0] == total
    units = df.filter("i = 3").select(base_units("v", 9)).first()[0]
    assert units == 10**29
    flow = aggregates.account_flow(
        df.select("k").distinct().withColumnRenamed("k", "a"),
        df.select(F.col("i").alias("tx"), F.col("k").alias("owner")),
        df.select(F.col("i").alias("m"), "v"), "a", "tx", "owner", "m", "v", 9,
    )
    assert flow.first()["total_value"] == total


MONEY = ["account_flow", "block_summary", "flow_cube", "running_balance", "hourly_buckets",
         "trailing_volume", "sessions_batch"]


@pytest.mark.parametrize("name", MONEY)
def test_money_is_exact(spark, name):
    """The queries before their sums become doubles, against decimals in SQL."""
    plan = all_plans()[name]
    found = plan.build(Ledger(spark, MEDIUM))
    money = [f.name for f in found.schema.fields if f.dataType.typeName() == "decimal"]
    assert money
    connection = check.database(MEDIUM)
    sql = plan.sql.replace("AS DOUBLE)", "AS DECIMAL(38,2))")
    names = ", ".join(f"CAST(sum({m}) AS DECIMAL(38,2)), min({m}), max({m})" for m in money)
    wanted = connection.execute(f"SELECT {names} FROM ({sql})").fetchone()
    got = found.agg(*[f(m) for m in money for f in (F.sum, F.min, F.max)]).first()
    assert all(isinstance(v, Decimal) for v in got) and tuple(got) == wanted
    assert isinstance(connection, duckdb.DuckDBPyConnection)


def test_drift_in_any_file(spark, folder):
    good = load_table(spark, MEDIUM, "labels")
    path = f"{folder}/labels.parquet"
    good.write.parquet(path)
    good.limit(5).withColumnRenamed("toxic", "poison").write.mode("append").parquet(path)
    for _ in range(6):
        with pytest.raises(SchemaDrift, match="poison"):
            load_table(spark, folder, "labels")
    path = f"{folder}/types/labels.parquet"
    good.write.parquet(path)
    good.limit(5).withColumn("toxic", F.lit("x")).write.mode("append").parquet(path)
    with pytest.raises(SchemaDrift):
        load_table(spark, f"{folder}/types", "labels")
    path = f"{folder}/less/labels.parquet"
    good.coalesce(1).write.parquet(path)
    good.limit(5).coalesce(1).drop("toxic").write.mode("append").parquet(path)
    found = missing_columns(load_table(spark, f"{folder}/less", "labels")).collect()
    assert [row["column"] for row in found] == ["toxic"]


def test_slices_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "MAX_SLICE_ROWS", 100)
    df = spark.range(3000).select(F.lit("a").alias("k"), "id")
    hot = hotkeys.find_hot_keys(df, ["k"], 10)
    assert hot.slices == 30
    assert hotkeys.find_hot_keys(df, [], 10).slices == 30
    found = windows.running_balance(df, "k", ["id"], F.lit(1), min_slice_rows=10)
    assert found.agg(F.max("balance")).first()[0] == 3000


def test_one_counting_pass_when_nothing_is_hot(spark):
    """Jobs that a plan starts: one to count the keys, and one for the result."""
    df = holed(spark, 500)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counting", "test")
    temporal.trailing_volume(df, "k", "t", F.col("v"), 7)
    before = len(tracker.getJobIdsForGroup("counting"))
    spark.sparkContext.setJobGroup("once", "test")
    hotkeys.find_hot_keys(df, ["k"])
    assert before == len(tracker.getJobIdsForGroup("once"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
