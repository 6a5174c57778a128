"""Hand-made inputs for what the given tables cannot show."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from conftest import MEDIUM, rows
from pyspark.sql import functions as F

from ledgerweave.functions import udfs
from ledgerweave.functions.columns import json_entries
from ledgerweave.operators import aggregates, joins, sets, temporal, windows
from ledgerweave.sources.ledger import (
    SCHEMAS,
    Ledger,
    SchemaDrift,
    flatten_records,
    load_ledger,
    load_table,
)


def test_load_checks_schema(spark, folder):
    good = load_table(spark, MEDIUM, "labels")
    good.write.parquet(f"{folder}/labels.parquet")
    assert load_table(spark, folder, "labels").count() == good.count() > 0
    good.withColumn("toxic", F.col("toxic").cast("string")).withColumn("more", F.lit(1)).write.parquet(
        f"{folder}/drift/labels.parquet"
    )
    with pytest.raises(SchemaDrift, match="more: declared nothing, found int; toxic: declared int"):
        load_table(spark, f"{folder}/drift", "labels")


def test_load_all(spark):
    tables = load_ledger(spark, MEDIUM)
    assert set(tables) == set(SCHEMAS)
    assert Ledger(spark, MEDIUM).nation.count() == 25
    with pytest.raises(AttributeError):
        Ledger(spark, MEDIUM).nothing


def test_flatten_empty_and_null(spark):
    tx = spark.createDataFrame(
        [(1, [("a", Decimal(5)), ("b", Decimal(7))]), (2, []), (3, None)],
        "id bigint, msgs array<struct<dst:string, value:decimal(38,9)>>",
    )
    assert rows(flatten_records(tx, "id", "msgs")) == [(1, 0, "a", Decimal(5)), (1, 1, "b", Decimal(7))]
    kept = flatten_records(tx, "id", "msgs", prefix="m_", keep_empty=True)
    assert kept.columns == ["id", "pos", "m_dst", "m_value"]
    assert {row["id"] for row in kept.collect()} == {1, 2, 3}


def test_conservation(spark):
    tx = spark.createDataFrame(
        [(1, Decimal("10.5")), (2, Decimal("10")), (3, Decimal("10")), (4, Decimal("1")),
         (5, Decimal("0")), (6, None)],
        "id bigint, total decimal(38,9)",
    )
    msg = spark.createDataFrame(
        [(1, Decimal("4.25")), (1, Decimal("6.25")), (2, Decimal("9.999999999")), (3, Decimal("11"))],
        "tx_id bigint, value decimal(38,9)",
    )
    found = aggregates.conservation_breaks(tx, msg, "id", "total", "tx_id", "value", scale=9)
    assert rows(found.select("id", "kind")) == [
        (2, "short"), (3, "over"), (4, "no messages"), (6, "no total"),
    ]


def test_gaps(spark):
    blocks = spark.createDataFrame(
        [(0, "8", n) for n in (1, 2, 5, 6, 6, 9)] + [(0, "c", n) for n in (7, 8)] + [(1, "8", 4)],
        "workchain int, shard string, seqno bigint",
    )
    for size in (1, 1_000_000):
        found = windows.chain_gaps(blocks, ["workchain", "shard"], "seqno", size)
        assert rows(found) == [(0, "8", 3, 4, 2), (0, "8", 7, 8, 2)]


def test_quorum_at_the_edge(spark):
    # the two heaviest hold exactly two thirds
    exact = spark.createDataFrame([("a", 30), ("b", 30), ("c", 20), ("d", 10)], "id string, w bigint")
    assert rows(windows.quorum(exact, "id", "w", more_than=False).select("id")) == [("a",), ("b",)]
    assert rows(windows.quorum(exact, "id", "w").select("id")) == [("a",), ("b",), ("c",)]
    above = spark.createDataFrame([("a", 31), ("b", 30), ("c", 20), ("d", 9)], "id string, w bigint")
    assert rows(windows.quorum(above, "id", "w").select("id")) == [("a",), ("b",)]
    # weights beyond 2 ** 53, where a division in doubles would be wrong
    for last, expected in [(0, [("a",)]), (2, [("a",), ("b",)])]:
        weights = [("a", 2 * 10**17 + 1), ("b", 10**17), ("c", last)]
        large = spark.createDataFrame([(i, Decimal(w)) for i, w in weights], "id string, w decimal(20,0)")
        assert rows(windows.quorum(large, "id", "w").select("id")) == expected


def test_shards_of_mixed_depth(spark):
    accounts = spark.createDataFrame([(x,) for x in ("0a1", "0b2", "1c3", "7f0", "1")], "id string")
    shards = spark.createDataFrame([("0",), ("0a",), ("1c",), ("f",)], "prefix string")
    found = joins.assign_shard(accounts, shards, "id", "prefix", hashed=False)
    assert rows(found) == [("0a1", "0"), ("0a1", "0a"), ("0b2", "0"), ("1c3", "1c")]
    everywhere = spark.createDataFrame([("",)], "prefix string")
    assert joins.assign_shard(accounts, everywhere, "id", "prefix", hashed=False).count() == 5
    assert joins.assign_shard(accounts, shards.filter("false"), "id", "prefix").count() == 0


def test_shards_equal_containment_join(spark):
    accounts = spark.range(400).select(F.col("id").alias("a"))
    hexes = accounts.select(F.sha2(F.col("a").cast("string"), 256).alias("h"))
    shards = (
        hexes.select(F.substring("h", 1, 1).alias("prefix"))
        .unionByName(hexes.select(F.substring("h", 1, 3).alias("prefix")))
        .distinct()
    )
    slow = accounts.join(
        shards, F.expr("startswith(sha2(cast(a as string), 256), prefix)")
    )
    assert rows(joins.assign_shard(accounts, shards, "a", "prefix")) == rows(slow)


def test_state_as_of_each(spark):
    states = spark.createDataFrame(
        [("x", 10, Decimal(1)), ("x", 20, Decimal(2)), ("x", 20, Decimal(3)), ("y", 5, Decimal(9))],
        "id string, lt bigint, balance decimal(38,9)",
    )
    probes = spark.createDataFrame(
        [("x", 9), ("x", 10), ("x", 15), ("x", 20), ("x", 99), ("y", 4), ("z", 1)],
        "id string, probe_lt bigint",
    )
    for size in (1, 1_000_000):
        found = temporal.state_as_of_each(
            states, probes, "id", "lt", "probe_lt", ["balance"], ["balance"], size
        )
        got = {(r["id"], r["probe_lt"]): (r["lt"], r["balance"]) for r in found.collect()}
        assert got == {
            ("x", 9): (None, None), ("x", 10): (10, 1), ("x", 15): (10, 1), ("x", 20): (20, 3),
            ("x", 99): (20, 3), ("y", 4): (None, None), ("z", 1): (None, None),
        }


def test_state_diff(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("e", 5)], "id string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 4)], "id string, v int")
    found = joins.state_diff(before, after, ["id"], "v")
    assert sorted((r["id"], r["change"]) for r in found.collect()) == [
        ("b", "changed"), ("d", "added"), ("e", "removed"),
    ]


def test_sessions_equal_session_window(spark):
    """Including rows exactly one gap apart."""
    start = dt.datetime(2024, 1, 1)
    minutes = {"a": [0, 30, 60, 91, 91, 200], "b": [5, 36], "c": [7]}
    data = [
        (n * 10 + i, key, start + dt.timedelta(minutes=m))
        for n, (key, times) in enumerate(minutes.items())
        for i, m in enumerate(times)
    ]
    events = spark.createDataFrame(data, "id bigint, k string, t timestamp_ntz")
    counted = [F.count(F.lit(1)).alias("n")]
    built_in = events.groupBy("k", F.session_window("t", "30 minutes").alias("w")).agg(*counted)
    expected = rows(built_in.select("k", "w.start", "w.end", "n"))
    for size in (1, 1_000_000):
        found = temporal.sessions_batch(events, "k", "t", "id", 1800, counted, size)
        assert rows(found) == expected


def test_set_operations_count_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,), (3,)], "x int")
    assert rows(sets.removed(a, b)) == [(1,), (1,)]
    assert rows(sets.common(a, b)) == [(1,), (2,)]
    assert rows(sets.merge_shards(a, b)) == [(1,), (2,), (3,)]
    # splitting and merging gives the original
    assert rows(sets.merge_shards(b.filter("x < 2"), b.filter("x >= 2"))) == rows(b.distinct())


def test_heavy_destinations_keeps_equals(spark):
    msg = spark.createDataFrame([(d,) for d in "aaabbbccd"], "dst string")
    assert rows(aggregates.heavy_destinations(msg, "dst", 1)) == [("a", 3), ("b", 3)]
    assert rows(aggregates.heavy_destinations(msg, "dst", 3)) == [("a", 3), ("b", 3), ("c", 2)]


def test_decode_records(spark):
    import struct

    def packed(*values):
        return bytearray(struct.pack(f">{len(values)}q", *values))

    raw = [(1, packed(-5, 2**62)), (2, None), (3, bytearray(b"short")), (4, packed(0, 1))]
    found = udfs.decode_records(
        spark.createDataFrame(raw, "id bigint, record binary"), ["id"], "record", ["p", "q"]
    )
    got = {row["id"]: (row["p"], row["q"]) for row in found.collect()}
    assert got == {1: (-5, 2**62), 2: (None, None), 3: (None, None), 4: (0, 1)}


def test_json_forms(spark):
    text = [(1, '{"a": 1, "b": "x"}'), (2, "{}"), (3, None), (4, "not json"), (5, "[1]")]
    df = spark.createDataFrame(text, "id bigint, props string")
    assert rows(udfs.json_rows(df, "id", "props")) == [(1, "a", "1"), (1, "b", "x")]
    assert rows(flatten_records(df, "id", json_entries("props"))) == [(1, 0, "a", "1"), (1, 1, "b", "x")]


def test_weighted_mean(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 3.0), ("a", 5.0, 1.0), ("a", None, 9.0), ("b", 2.0, 0.0)],
        "k string, x double, w double",
    )
    found = udfs.weighted_mean(df, ["k"], "x", "w")
    assert {row["k"]: row["weighted_mean"] for row in found.collect()} == {"a": 2.0, "b": None}
    wrong = spark.createDataFrame([("a", float("nan"), 1.0), ("a", 2.0, 1.0)], "k string, x double, w double")
    assert math.isnan(udfs.weighted_mean(wrong, ["k"], "x", "w").first()["weighted_mean"])


def test_sketches_merge(spark):
    df = spark.range(50_000).select((F.col("id") % 4).alias("k"), (F.col("id") % 7).alias("day"), "id")
    fine = aggregates.parties_sketch(df, ["k", "day"], "id")
    merged = aggregates.merge_sketches(fine, ["k"])
    direct = aggregates.distinct_parties_approx(df, ["k"], "id")
    for found in (merged, direct):
        assert all(abs(row["n_parties"] - 12_500) < 12_500 * 0.04 for row in found.collect())
        assert found.count() == 4


def test_running_balance_ends_in_totals(spark):
    orders = load_table(spark, MEDIUM, "orders")
    value = F.col("o_totalprice").cast("decimal(18,2)")
    running = windows.running_balance(orders, "o_custkey", ["o_orderdate", "o_orderkey"], value)
    last = running.groupBy("o_custkey").agg(
        F.max_by("balance", F.struct("o_orderdate", "o_orderkey")).alias("b")
    )
    totals = orders.groupBy("o_custkey").agg(F.sum(value).alias("b"))
    assert rows(last) == rows(totals) and last.count() == 1500
