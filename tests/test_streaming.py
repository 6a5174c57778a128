"""Streams: batches in order, repeats across batches, late rows, restarts."""

import datetime as dt
import random
from decimal import Decimal

from conftest import MEDIUM, rows
from pyspark.sql import functions as F

from ledgerweave.sources import streams as sources
from ledgerweave.sources.ledger import load_table
from ledgerweave.streaming import late, stateful, windows

START = dt.datetime(2024, 1, 1)
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event(ident, minute, user=1, kind="click", value=1.5):
    return (ident, START + dt.timedelta(minutes=minute), user, kind, value, "{}")


class Landing:
    """A folder that is filled one batch at a time."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, df):
        df = df if hasattr(df, "write") else self.spark.createDataFrame(df, EVENTS)
        df.write.mode("append").parquet(f"{self.folder}/in")
        stream = sources.stream_source(self.spark, f"{self.folder}/in", df.schema)
        return sources.with_event_time(stream, "ts")

    def run(self, stream):
        sources.run_available(stream, f"{self.folder}/out", f"{self.folder}/state")
        return self.spark.read.parquet(f"{self.folder}/out")


def test_dedupe_across_batches(spark, folder):
    landing = Landing(spark, folder)

    def deliver(batch):
        return landing.run(windows.dedupe_stream(landing.add(batch), "ts", "1 hour", ["event_id"]))

    deliver([event(1, 0), event(1, 0), event(2, 10)])
    deliver([event(1, 20), event(3, 30)])  # a repeat within the hour
    # moves the watermark far on; the next delivery of 1 is no repeat any more
    deliver([event(4, 600)])
    found = deliver([event(1, 610), event(4, 600)])
    assert sorted(row["event_id"] for row in found.collect()) == [1, 1, 2, 3, 4]


def test_a_late_copy_does_not_displace_a_timely_one(spark, folder):
    landing = Landing(spark, folder)

    def deliver(batch):
        return landing.run(windows.dedupe_stream(landing.add(batch), "ts", "1 hour", ["event_id"]))

    deliver([event(1, 600)])
    deliver([event(2, 0), event(2, 610)])
    found = deliver([event(3, 620)])
    assert sorted(row["event_id"] for row in found.collect()) == [1, 2, 3]


def test_dedupe_equals_builtin_with_late_copies(spark, folder):
    pick = random.Random(5)
    batches = [
        [event(pick.randrange(40), pick.randrange(200) + 120 * n) for _ in range(60)]
        for n in range(4)
    ]
    own, built_in = Landing(spark, f"{folder}/a"), Landing(spark, f"{folder}/b")
    for batch in batches:
        one = spark.createDataFrame(batch, EVENTS).coalesce(1)
        mine = own.run(windows.dedupe_stream(own.add(one), "ts", "1 hour", ["event_id"]))
        stream = built_in.add(one).withWatermark("ts", "1 hour")
        theirs = built_in.run(stream.dropDuplicatesWithinWatermark(["event_id"]))
    count = [("event_id", "n")]  # which of two copies comes first is open, how many is not
    assert rows(mine.groupBy(count[0][0]).count()) == rows(theirs.groupBy(count[0][0]).count())


def test_dedupe_of_one_id_with_most_rows(spark, folder):
    landing = Landing(spark, folder)
    copies = spark.range(50_000).select(
        F.when(F.col("id") < 40_000, 7).otherwise(F.col("id")).alias("event_id"),
        F.lit(START).cast("timestamp_ntz").alias("ts"),
    )
    found = landing.run(windows.dedupe_stream(landing.add(copies), "ts", "1 hour", ["event_id"]))
    assert found.count() == 10_001 == found.select("event_id").distinct().count()


def test_tumbling_same_for_one_and_four_batches(spark, folder):
    events = load_table(spark, MEDIUM, "events")
    landing = Landing(spark, folder)

    def counted(stream):
        return windows.tumbling_counts(stream, "ts", "10 minutes", "1 hour", ["event_type"], "value", 2)

    for day in (0, 8, 15, 22):
        last = {0: 8, 8: 15, 15: 22, 22: 99}[day]
        low, high = START + dt.timedelta(days=day), START + dt.timedelta(days=last)
        part = events.filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))
        four = landing.run(counted(landing.add(part)))
    whole = sources.with_event_time(sources.stream_table(spark, MEDIUM, "events"), "ts")
    sources.run_available(counted(whole), f"{folder}/one", f"{folder}/one-state")
    one = spark.read.parquet(f"{folder}/one")
    assert rows(four) == rows(one) and one.count() == 3380


def test_late_rows_are_all_accounted_for(spark, folder):
    landing = Landing(spark, folder)

    def deliver(batch):
        stream = landing.add(batch)
        return late.late_report(stream, "ts", "10 minutes", f"{folder}/report", f"{folder}/state")

    deliver([event(1, 0), event(2, 100)])
    deliver([event(3, 95), event(4, 89), event(5, 90), event(6, 300)])
    report = deliver([event(7, 1), event(8, 2)])  # wholly behind the watermark
    assert sorted(r["event_id"] for r in report.late().collect()) == [4, 7, 8]
    assert sorted(r["event_id"] for r in report.on_time().collect()) == [1, 2, 3, 5, 6]
    # repeating a batch decides the same and leaves no second copy
    again = spark.createDataFrame([event(7, 1), event(8, 2)], EVENTS)
    report.split(again.withColumn("ts", F.col("ts").cast("timestamp")), 2)
    assert sorted(r["event_id"] for r in report.late().collect()) == [4, 7, 8]


def test_match_keeps_state_between_batches(spark, folder):
    landing = Landing(spark, folder)

    def deliver(batch):
        stream = landing.add(batch)
        left = stream.filter("event_type = 'click'").select(
            "user_id", F.col("event_id").alias("a"), F.col("ts").alias("at")
        )
        right = stream.filter("event_type = 'view'").select(
            "user_id", F.col("event_id").alias("b"), F.col("ts").alias("bt")
        )
        return landing.run(
            windows.match_stream(left, right, "user_id", "at", "bt", "a", "10 minutes", "1 hour", [1], 3)
        )

    deliver([event(1, 0), event(2, 5, user=2), event(3, 6)])
    found = deliver([
        event(10, 60, kind="view"), event(11, 66, kind="view"), event(12, 67, kind="view"),
        event(13, 5, user=2, kind="view"),
    ])
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [(1, 10), (3, 10), (3, 11)]
    assert found.columns == ["user_id", "a", "at", "b", "bt"]


def totals(spark, folder, operator):
    landing = Landing(spark, folder)

    def deliver(batch):
        stream = landing.add(batch)
        return landing.run(operator(stream.withColumn("units", F.col("user_id") * 10), "user_id", "units"))

    deliver([event(1, 0), event(2, 1), event(3, 2, user=2)])
    deliver([event(4, 3), event(5, 4, user=3)])
    found = deliver([event(6, 5), event(7, 6, user=2)])
    assert rows(found) == [
        (1, 2, 20), (1, 3, 30), (1, 4, 40), (2, 1, 20), (2, 2, 40), (3, 1, 30),
    ]


def test_running_totals(spark, folder):
    totals(spark, folder, stateful.running_totals)


def test_running_totals_v2(spark, folder):
    totals(spark, folder, stateful.running_totals_v2)


def test_totals_beyond_64_bits(spark, folder):
    for n, operator in enumerate((stateful.running_totals, stateful.running_totals_v2)):
        landing = Landing(spark, f"{folder}/{n}")
        units = F.when(F.col("value") > 0, F.lit(Decimal(6 * 10**18))).cast("decimal(38,0)")

        def deliver(batch, operator=operator, landing=landing, units=units):
            stream = landing.add(batch).withColumn("units", units)
            return landing.run(operator(stream, "user_id", "units"))

        deliver([event(1, 0), event(2, 1)])
        found = deliver([event(3, 2), event(4, 3, value=-1.0)])
        assert rows(found) == [(1, 2, Decimal(12 * 10**18)), (1, 4, Decimal(18 * 10**18))]


def test_state_reads_do_not_grow_with_batches(spark, folder):
    schema = spark.createDataFrame([], "id bigint, t bigint, v string").schema
    state = sources.LatestState(spark, f"{folder}/state", schema, "id", ["t"], buckets=3)
    for n in range(6):
        state.merge(spark.createDataFrame([(i, n, f"{n}") for i in range(30)], schema), n)
        assert len(state.read().inputFiles()) == 3
    assert state.drop_replaced() == 12
    assert state.drop_replaced() == 0
    assert state._commits() == [4, 5]
    assert state.read().filter("t = 5").count() == 30


def test_late_report_keeps_two_marks(spark, folder):
    landing = Landing(spark, folder)
    for n in range(5):
        stream = landing.add([event(n, 100 * n)])
        late.late_report(stream, "ts", "10 minutes", f"{folder}/report", f"{folder}/state")
    assert sources.finished_batches(spark, f"{folder}/report/marks") == [3, 4]


def test_upsert_repeats_a_batch_without_harm(spark, folder):
    schema = spark.createDataFrame([], "id bigint, t bigint, v string").schema
    state = sources.LatestState(spark, f"{folder}/state", schema, "id", ["t"], buckets=4)

    def batch(*values):
        return spark.createDataFrame(values, schema)

    assert state.read().count() == 0
    state.merge(batch((1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 5, "d")), 0)
    state.merge(batch((1, 1, "old"), (2, 9, "new"), (4, 1, "e")), 1)
    expected = [(1, 2, "b"), (2, 9, "new"), (3, 5, "d"), (4, 1, "e")]
    assert rows(state.read()) == expected
    state.merge(batch((1, 1, "old"), (2, 9, "new"), (4, 1, "e")), 1)
    assert rows(state.read()) == expected
    state.merge(batch(), 2)
    assert rows(state.read()) == expected
    third = batch((1, 20, "x"), (2, 20, "x"), (3, 20, "x"), (4, 20, "x"))
    state.merge(third, 3)
    assert state.drop_replaced() > 0
    for _ in range(2):  # the last batch may still run again
        assert rows(state.read()) == [(n, 20, "x") for n in (1, 2, 3, 4)]
        state.merge(third.filter("id < 3"), 3)
        state.merge(third, 3)
    state.merge(third.filter("id < 0"), 3)
    assert rows(state.read()) == expected


def test_upsert_ignores_an_unfinished_batch(spark, folder):
    schema = spark.createDataFrame([], "id bigint, t bigint, v string").schema
    state = sources.LatestState(spark, f"{folder}/state", schema, "id", ["t"], buckets=2)
    state.merge(spark.createDataFrame([(1, 1, "a")], schema), 0)
    # rows of a batch that stopped before its commit
    spark.createDataFrame([(1, 9, "never", 0), (1, 9, "never", 1)], "id bigint, t bigint, v string, bucket int") \
        .write.partitionBy("bucket").parquet(f"{state.rows_path}/batch=1")
    assert rows(state.read()) == [(1, 1, "a")]
    state.merge(spark.createDataFrame([(1, 2, "b")], schema), 1)
    assert rows(state.read()) == [(1, 2, "b")]


def test_bounded_rate(spark, folder):
    events = load_table(spark, MEDIUM, "events")
    events.repartition(6).write.parquet(f"{folder}/in")
    stream = sources.stream_source(spark, f"{folder}/in", events.schema, files_per_trigger=2)
    query = sources.run_available(stream, f"{folder}/out", f"{folder}/state")
    assert query.lastProgress["batchId"] == 2
    assert spark.read.parquet(f"{folder}/out").count() == 10_000
