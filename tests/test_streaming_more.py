"""Streams: keys that go when idle, files in event order, open windows, old commits."""

import datetime as dt
import os
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_streaming import EVENTS, START, Landing, event

from ledgerweave.plans import streams_more
from ledgerweave.sources import ordered
from ledgerweave.sources import streams as sources
from ledgerweave.sources.ledger import Ledger
from ledgerweave.streaming import provisional, stateful, windows


def at(minute):
    return START + dt.timedelta(minutes=minute)


def test_idle_keys_give_their_total_once_and_go(spark, folder):
    landing = Landing(spark, folder)

    def deliver(batch):
        stream = landing.add(batch).withColumn("units", F.col("event_id") * 10)
        return landing.run(stateful.expiring_totals(stream, "user_id", "units", "ts", "5 minutes", 3600))

    assert rows(deliver([event(1, 0), event(2, 30), event(3, 0, user=2)])) == []
    # the watermark reaches 95: user 2 was due at 60, user 1 at 90
    assert rows(deliver([event(4, 100, user=3)])) == [(1, 2, 30, at(30)), (2, 1, 30, at(0))]
    # user 1 begins anew, at first still with a late row; user 3 stays, as its row came again
    deliver([event(5, 110), event(6, 20), event(7, 150, user=3)])
    found = rows(deliver([event(8, 400, user=9)]))
    assert found == [(1, 2, 30, at(30)), (1, 2, 110, at(110)), (2, 1, 30, at(0)), (3, 2, 110, at(150))]
    assert rows(deliver([event(9, 401, user=9)])) == found


def test_state_holds_active_keys_only(spark, folder):
    landing = Landing(spark, folder)
    for n in range(4):
        batch = [event(100 * n + i, 1000 * n + i % 7, user=100 * n + i) for i in range(50)]
        stream = landing.add(batch).withColumn("units", F.lit(1))
        result = stateful.expiring_totals(stream, "user_id", "units", "ts", "0 minutes", 60)
        query = sources.run_available(result, f"{folder}/out", f"{folder}/state")
    state = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    # of the last batch's keys those less than a minute behind the newest row, each with a few rows
    assert spark.read.parquet(f"{folder}/out").count() >= 150 and state < 50 * 4


def expired(batches, delay, idle):
    """What one run per batch gives, by a plain dict: rows first, then timers, then the new watermark's."""
    out, state, mark = [], {}, 0
    for batch in batches:
        newest = mark
        for key, millis, cents in batch:
            old = state.get(key, (0, 0, None))
            times = [x for x in (old[2], millis) if x is not None]
            state[key] = (old[0] + 1, old[1] + (cents or 0), max(times, default=None))
            newest = max([newest] + ([] if millis is None else [millis - delay]))
        state = {k: (n, total, mark - idle if last is None else last) for k, (n, total, last) in state.items()}
        for mark in (mark, newest):
            gone = {k for k, v in state.items() if v[2] + idle <= mark}
            out += [(k, *state.pop(k)) for k in gone]
    return sorted(out, key=repr), state


def test_state_is_kept_by_the_bucket(spark, folder):
    """Calls of Python and rows of state go by buckets of keys; results are those of single keys."""
    pick = random.Random(3)
    keys = [None, 2**53 + 1, 2**53 + 2, *range(4000)]
    batches = [
        [(k, 1000 * (200 * n + pick.randrange(90)) + 7 if pick.random() < 0.9 else None, pick.choice([None, -5, 10**37]))
         for k in pick.sample(keys, 3000) + keys[:3] for _ in range(pick.choice([1, 1, 3]))]
        for n in range(4)
    ]
    landing = Landing(spark, folder)
    schema = "user_id bigint, ts timestamp_ntz, units decimal(38,0)"
    for batch in batches:
        data = [(k, m if m is None else dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=m), u and Decimal(u)) for k, m, u in batch]
        stream = landing.add(spark.createDataFrame(data, schema))
        result = stateful.expiring_totals(stream, "user_id", "units", "ts", "20 seconds", 100)
        query = sources.run_available(result, f"{folder}/out", f"{folder}/state")
    found = [
        (k, n, int(total), round(1000 * last.replace(tzinfo=dt.timezone.utc).timestamp()))
        for k, n, total, last in spark.read.parquet(f"{folder}/out").collect()
    ]
    want, left = expired(batches, 20_000, 100_000)
    assert sorted(found, key=repr) == want and len(want) > 2500
    operators = query.lastProgress["stateOperators"]
    # a value and a timer, listed twice, for each bucket
    assert len(left) > 1500 and sum(s["numRowsTotal"] for s in operators) <= 3 * stateful.BUCKETS


def test_totals_of_idle_keys_have_38_digits(spark, folder):
    """Sums may pass 38 digits on the way; a total of more is an error."""
    landing = Landing(spark, folder)
    schema = "user_id bigint, ts timestamp_ntz, units decimal(38,0)"

    def deliver(amounts):
        data = [(1, at(i), Decimal(x) * 10**37) for i, x in enumerate(amounts)]
        stream = landing.add(spark.createDataFrame(data, schema).coalesce(1))
        return landing.run(stateful.expiring_totals(stream, "user_id", "units", "ts", "0 minutes", 600))

    deliver([9, 9, 9, -9, -9])
    deliver([-9, -9])
    with pytest.raises(Exception, match="38 digits"):
        deliver([9, 9, 9])


def shuffled_files(spark, folder, parts=4):
    """Events of four files whose names and modification times are not in event order."""
    pick = random.Random(5)
    data = [event(i, 60 * i // 10, user=pick.randrange(9), value=1.25 * i) for i in range(400)]
    size = len(data) // parts
    for k, part in enumerate([2, 0, 3, 1]):
        df = spark.createDataFrame(data[part * size : (part + 1) * size], EVENTS).coalesce(1)
        df.write.mode("append").parquet(f"{folder}/in/{k}")
        for name in os.listdir(f"{folder}/in/{k}"):
            os.utime(f"{folder}/in/{k}/{name}", (1_000_000 + k, 1_000_000 + k))
    return data


def closed(data):
    newest = max(row[1] for row in data) - dt.timedelta(minutes=10)
    out = defaultdict(int)
    for row in data:
        out[row[1].replace(minute=0, second=0)] += 1
    return sorted((w, n) for w, n in out.items() if w + dt.timedelta(hours=1) <= newest)


def test_files_in_event_order_close_the_same_windows(spark, folder):
    data = shuffled_files(spark, folder)

    def once():
        stream = ordered.ordered_source(spark, f"{folder}/in", EVENTS, "ts", f"{folder}/log")
        counted = windows.tumbling_counts(sources.with_event_time(stream, "ts"), "ts", "10 minutes", "1 hour", [], "value", 2)
        return sources.run_available(counted, f"{folder}/out", f"{folder}/state")

    def found():
        return sorted((r["window_start"].replace(tzinfo=None), r["n_events"]) for r in spark.read.parquet(f"{folder}/out").collect())

    first = once()  # one file, then a restart for each other
    assert sum(p["numInputRows"] for p in first.recentProgress) == 100
    assert ordered.drained(once) == 4
    assert found() == closed(data) and len(found()) > 30
    # a file that turns up later is taken after the others
    late = [event(1000 + i, 3000 + i) for i in range(50)]
    spark.createDataFrame(late, EVENTS).coalesce(1).write.parquet(f"{folder}/in/9")
    ordered.drained(once)
    assert found() == closed([*data, *late])


def test_files_of_ordered_counts_are_bounded(spark, folder, monkeypatch):
    """No task writes, and no file has, much more than FILE_ROWS; equal and null times too."""
    pick = random.Random(6)
    data = [event(i, pick.randrange(3000) if i % 3 else 2222, value=float(i % 50)) for i in range(3000)]
    data += [(i, None, 1, "view", 1.0, "{}") for i in range(3000, 3600)]
    pick.shuffle(data)
    spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    monkeypatch.setattr(streams_more, "FILE_ROWS", 150)
    t = Ledger(spark, folder)
    events, _ = streams_more._parted(t.events)
    written, together = streams_more._shuffled(t, events)
    files = spark.read.parquet(written).groupBy(F.input_file_name()).agg(F.count("*"), F.min("ts"), F.max("ts")).collect()
    assert sum(f[1] for f in files) == 3600 and max(f[1] for f in files) <= 300
    times = sorted((f[3], f[2]) for f in files if f[3])
    assert all(low >= high for (high, _), (_, low) in zip(times, times[1:]))

    def once():
        stream = ordered.ordered_source(spark, written, EVENTS, "ts", f"{folder}/log", together)
        counted = windows.tumbling_counts(sources.with_event_time(stream, "ts"), "ts", "10 minutes", "1 hour", [], "value", 2)
        return sources.run_available(counted, f"{folder}/out", f"{folder}/state")

    # as many runs as there are parts at most, and one that finds no more
    assert ordered.drained(once) <= streams_more.PARTS + 1
    found = spark.read.parquet(f"{folder}/out").collect()
    got = sorted((r["window_start"].replace(tzinfo=None), r["n_events"]) for r in found)
    assert got == closed([r for r in data if r[1] is not None]) and len(got) > 40


def test_modification_times_lose_windows(spark, folder):
    """What the source is for: by modification time rows of whole files are late."""
    data = shuffled_files(spark, folder)
    stream = sources.stream_source(spark, f"{folder}/in/*", EVENTS, files_per_trigger=1)
    counted = windows.tumbling_counts(sources.with_event_time(stream, "ts"), "ts", "10 minutes", "1 hour", [], "value", 2)
    sources.run_available(counted, f"{folder}/out", f"{folder}/state")
    assert spark.read.parquet(f"{folder}/out").agg(F.sum("n_events")).first()[0] < sum(n for _, n in closed(data))


def test_order_of_files_without_times(spark, folder):
    spark.createDataFrame([event(1, 50)], EVENTS).coalesce(1).write.parquet(f"{folder}/in/b")
    spark.createDataFrame([event(2, 10)], EVENTS).coalesce(1).write.parquet(f"{folder}/in/c")
    spark.createDataFrame([(3, None, 1, "x", 1.0, "{}")], EVENTS).coalesce(1).write.parquet(f"{folder}/in/a")
    spark.createDataFrame([event(4, 0)], EVENTS).drop("ts", "props").coalesce(1).write.parquet(f"{folder}/in/d")
    options = {"path": f"{folder}/in", "time": "ts", "log": f"{folder}/log", "files_per_batch": "2"}
    schema = spark.createDataFrame([], EVENTS).schema
    reader = ordered.OrderedReader(options, schema)
    assert reader.latestOffset() == reader.latestOffset() == {"files": 2}
    paths = [p.path.split("/in/")[1][0] for p in reader.partitions({"files": 0}, {"files": 4})]
    assert paths == ["c", "b", "a", "d"]
    assert ordered.OrderedReader(options, schema).latestOffset() == {"files": 4}
    batch = next(reader.read(reader.partitions({"files": 3}, {"files": 4})[0]))
    assert batch.column("event_id").to_pylist() == [4] and batch.column("ts").null_count == 1


def test_open_windows_follow_each_batch(spark, folder):
    landing = Landing(spark, folder)
    seen = []

    def deliver(batch):
        seen.extend(batch)
        stream = landing.add(batch)
        state = provisional.provisional_counts(
            stream, f"{folder}/table", f"{folder}/state", "ts", "10 minutes", "1 hour", ["event_type"], "value", 2, buckets=3
        )
        want = defaultdict(lambda: [0, 0.0])
        for _, ts, _, kind, value, _ in seen:
            own = want[ts.replace(minute=0, second=0), kind]
            own[0] += 1
            own[1] += value
        got = {(r["window_start"].replace(tzinfo=None), r["event_type"]): [r["n_events"], float(r["total_value"])] for r in state.read().collect()}
        assert got == dict(want)
        return state

    deliver([event(1, 0), event(2, 30, kind=None), event(3, 70)])
    deliver([event(4, 75), event(5, 71, kind="view")])
    state = deliver([event(6, 140, value=-1.5), event(7, 80)])
    before = sorted(map(tuple, state.read().collect()), key=repr)
    # the last batch once more
    last = state._commits()[-1]
    state.merge(state.read().filter("n_events > 1"), last)
    assert sorted(map(tuple, state.read().collect()), key=repr) == before


def test_commits_are_pruned_while_running(spark, folder):
    schema = spark.createDataFrame([], "id bigint, t bigint").schema
    state = sources.LatestState(spark, f"{folder}/state", schema, "id", ["t"], buckets=2, keep=3)
    for n in range(12):
        state.merge(spark.createDataFrame([(i, n) for i in range(10)], schema), n)
        assert len(state._commits()) < 2 * 3 and rows(state.read()) == [(i, n) for i in range(10)]


def test_a_key_is_spread_once_it_is_busy(spark, folder):
    """Pairs over a change from plain to spread and back, with left rows that come after right ones."""
    pick = random.Random(8)
    data, ident = [], 0
    for part in range(5):
        rows_ = []
        for _ in range(60):
            minute = part * 60 + pick.randrange(60) - (30 if part and pick.random() < 0.3 else 0)
            kind = pick.choice(["click", "purchase"])
            rows_.append(event(ident, minute, user=pick.choice([1, 1, 1, 2, 3]), kind=kind))
            ident += 1
        data.append(rows_)
    landing = Landing(spark, folder)
    for part, busy in enumerate([[], [], [1], [1, 2], []]):
        stream = landing.add(data[part])
        clicks = stream.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("c"), F.col("ts").alias("ct"))
        buys = stream.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("p"), F.col("ts").alias("pt"))
        found = landing.run(windows.match_stream(clicks, buys, "user_id", "ct", "pt", "c", "3 hours", "40 minutes", busy, salts=4))
    every = [r for part in data for r in part]
    want = sorted(
        (a[0], b[0]) for a in every for b in every
        if a[3] == "click" and b[3] == "purchase" and a[2] == b[2] and a[1] < b[1] <= a[1] + dt.timedelta(minutes=40)
    )
    assert sorted((r["c"], r["p"]) for r in found.collect()) == want and len(want) > 200


def test_busy_keys_are_learned(spark, folder):
    from ledgerweave.streaming import busykeys

    landing = Landing(spark, folder)

    def deliver(batch):
        busykeys.learn(landing.add(batch), "user_id", f"{folder}/busy", f"{folder}/busy-state", 3)
        return busykeys.known(spark, f"{folder}/busy")

    assert busykeys.known(spark, f"{folder}/busy") == []
    assert deliver([event(i, i, user=u) for i, u in enumerate([1, 1, 2, None, None, None])]) == []
    assert deliver([event(i, i, user=2) for i in range(10, 14)] + [event(20, 1, user=1)]) == [2]
    assert deliver([event(i, i, user=5) for i in range(30, 39)]) == [5, 2]
