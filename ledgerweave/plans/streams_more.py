"""Streams whose state ends, whose files come in event order, and whose windows are still open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import base_units
from ledgerweave.plans.registry import CENTS, plan
from ledgerweave.plans.streams import (
    DELAY, PARTS, _CLOSED, _collected, _feed, _parted, _streaming, matched_pairs,
)
from ledgerweave.session import scratch_path
from ledgerweave.sources import ordered, streams as sources
from ledgerweave.sources.ledger import Ledger
from ledgerweave.streaming import busykeys, provisional, stateful, windows

IDLE_DAYS = 2
FILE_ROWS = 500_000  # of the files that are taken in event order

# A key's rows of one part are one batch, after which timers go by the newest time so far. A total is
# closed after the first part whose mark has passed the key's last row by the idle time.
_EXPIRED_SQL = f"""
    WITH bounds AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
    parted AS (
      SELECT user_id * 10 + length(event_type) AS k, value, ts,
             least({PARTS - 1}, ((epoch_us(ts) - lo) * {PARTS}) // (hi - lo)) AS part
      FROM events, bounds),
    highs AS (SELECT part, max(ts) - INTERVAL 10 MINUTES AS mark FROM parted GROUP BY 1),
    per_part AS (
      SELECT k, part, count(*) AS n, max(ts) AS last_time,
             sum(CAST(round(CAST(value AS DECIMAL(18,2)) * 100) AS BIGINT)) AS cents
      FROM parted GROUP BY 1, 2),
    placed AS (
      SELECT *, max(last_time) OVER (PARTITION BY k ORDER BY part) AS newest,
             lead(part) OVER (PARTITION BY k ORDER BY part) AS next_part FROM per_part),
    closing AS (
      SELECT p.*, EXISTS (SELECT 1 FROM highs h
                          WHERE h.part >= p.part AND h.part < coalesce(p.next_part, {PARTS})
                            AND h.mark >= p.newest + INTERVAL {IDLE_DAYS} DAYS) AS closed
      FROM placed p),
    runs AS (
      SELECT *, coalesce(sum(CASE WHEN closed THEN 1 ELSE 0 END) OVER (
                  PARTITION BY k ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM closing)
    SELECT k, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(cents) AS BIGINT) AS total,
           date_trunc('millisecond', max(last_time)) AS last_time
    FROM runs GROUP BY k, run HAVING bool_or(closed)
"""


@plan(_EXPIRED_SQL)
def expiring_totals(t: Ledger) -> DataFrame:
    """Totals of user and kind of event, given and let go when two days idle."""
    events, _ = _parted(t.events)
    keyed = events.withColumn("k", F.col("user_id") * 10 + F.length("event_type"))
    run, read = _collected(
        t,
        lambda s: stateful.expiring_totals(
            s.withColumn("cents", base_units("value", CENTS)), "k", "cents", "ts", DELAY, IDLE_DAYS * 86_400
        ),
    )
    _feed(t, keyed, F.col("part"), PARTS, run)
    return read().withColumn("total", F.col("total").cast("bigint"))


def _shuffled(t: Ledger, events: DataFrame) -> tuple[str, int]:
    """A folder of files whose names are not in event order, and how many make up a part's worth.

    A file holds consecutive events, so those of a part can be taken together or one after the other.
    """
    folder = scratch_path(t.spark, "shuffled")
    rows = events.withColumn("file", F.pmod(F.col("part") * 3 + 2, F.lit(PARTS)))
    # a task sorts what it writes, so that is as many rows whatever the table has; equal times may be
    # cut, as the watermark stays behind them
    slices = max(1, -(-events.count() // (PARTS * FILE_ROWS)))
    ranges = rows.repartitionByRange(PARTS * slices, "part", "ts", "event_id")
    ranges.write.partitionBy("file").parquet(folder)
    return folder, slices + 1  # a range that two parts share is two files


@plan(f"""
    SELECT date_trunc('hour', ts) AS window_start,
           date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
           CAST(count(*) AS BIGINT) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM events GROUP BY 1, 2, 3
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}
""")
def ordered_counts(t: Ledger) -> DataFrame:
    """Hourly counts over files that were written in another order than that of their events."""
    events, _ = _parted(t.events)
    folder, together = _shuffled(t, events)
    session = _streaming(t).spark
    schema = events.drop("part").schema
    log = scratch_path(t.spark, "file-order")
    run, read = _collected(
        t, lambda s: windows.tumbling_counts(s, "ts", DELAY, "1 hour", ["event_type"], "value", CENTS)
    )
    done = []

    def once():
        stream = ordered.ordered_source(session, folder, schema, "ts", log, files_per_batch=together)
        done.append(run(sources.with_event_time(stream, "ts")))
        return done[-1]

    ordered.drained(once)
    return read()


@plan("""
    SELECT date_trunc('hour', ts) AS window_start,
           date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
           CAST(count(*) AS BIGINT) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM events GROUP BY 1, 2, 3
""")
def provisional_counts(t: Ledger) -> DataFrame:
    """All hourly counts, those of windows that are not closed yet too."""
    events, _ = _parted(t.events)
    path, checkpoint = scratch_path(t.spark, "open-windows"), scratch_path(t.spark, "open-windows-state")
    states = []

    def run(stream: DataFrame) -> None:
        states.append(provisional.provisional_counts(
            stream, path, checkpoint, "ts", DELAY, "1 hour", ["event_type"], "value", CENTS, buckets=8
        ))

    _feed(t, events, F.col("part"), PARTS, run)
    return states[-1].read().drop(provisional.KEY)




@plan("""
    SELECT l.user_id, l.event_id AS click_id, r.event_id AS purchase_id,
           l.ts AS click_time, r.ts AS purchase_time
    FROM events l JOIN events r ON l.user_id = r.user_id
     AND r.ts > l.ts AND r.ts <= l.ts + INTERVAL 2 HOURS
    WHERE l.event_type = 'click' AND r.event_type = 'purchase'
""")
def match_stream_learned(t: Ledger) -> DataFrame:
    """Clicks with later purchases; users with many events in a part are spread from the next one."""
    learned, marks = scratch_path(t.spark, "busy"), scratch_path(t.spark, "busy-state")
    state, out = scratch_path(t.spark, "stream-state"), scratch_path(t.spark, "stream-out")
    schemas = []

    def run(stream: DataFrame) -> None:
        pairs = matched_pairs(stream, busykeys.known(stream.sparkSession, learned))
        schemas.append(pairs.schema)
        sources.run_available(pairs, out, state)
        busykeys.learn(stream, "user_id", learned, marks, BUSY_ROWS)

    events, _ = _parted(t.events)
    _feed(t, events, F.col("part"), PARTS, run)
    return t.spark.read.schema(schemas[-1]).parquet(out)


BUSY_ROWS = 25  # in a part of the small tables that makes some users busy
