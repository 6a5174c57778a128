"""Stream operators run over the events table.

The windowed counts stream the given table itself. The others need several micro-batches:
the events, in parts by time, are added to a folder one part after the other, and the query
is run after each, going on from its checkpoint. What one batch holds therefore does not
depend on file times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import base_units, micros
from ledgerweave.plans.registry import CENTS, plan
from ledgerweave.session import apply_runtime_defaults, drop_path, scratch_path, shuffle_width
from ledgerweave.sources import streams as sources
from ledgerweave.sources.ledger import Ledger
from ledgerweave.streaming import late, stateful, windows

PARTS = 4
DELAY = "10 minutes"

_PART_SQL = """
    bounds AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
    parted AS (
      SELECT events.*, least(3, ((epoch_us(ts) - lo) * 4) // (hi - lo)) AS part
      FROM events, bounds)
"""


STATE_BYTES = 32 * 1024 * 1024  # input per state partition


def _streaming(t: Ledger) -> Ledger:
    """The same tables in a session whose number of state partitions suits the input.

    Streams have no adaptive execution: each state partition costs a task and a commit in
    every micro-batch, and the number is fixed with the first one. It is taken from the
    size of the events, between the cores there are and the session's own setting.
    """
    session = t.spark.newSession()
    apply_runtime_defaults(session)
    path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{t.directory}/events.parquet")
    files = path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
    wanted = files.getContentSummary(path).getLength() // STATE_BYTES + 1
    cores = session.sparkContext.defaultParallelism
    partitions = min(shuffle_width(t.spark), max(cores, wanted))
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return Ledger(session, t.directory)


def _parted(events: DataFrame) -> tuple[DataFrame, int]:
    """Events with ``part``: their quarter of the table's time range; and the range in seconds."""
    low, high = events.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    quarter = F.floor((micros("ts") - low) * PARTS / F.lit(high - low))
    part = F.least(F.lit(PARTS - 1), quarter.cast("int"))
    return events.withColumn("part", part), (high - low) // 1_000_000


def _feed(
    t: Ledger, arrivals: DataFrame, arrives: Column, parts: int, run: Callable[[DataFrame], object]
) -> None:
    """Let ``run`` take up the rows part by part, each part going on from the one before.

    The rows are written once, a folder for each part; the stream's folder is then added to by
    moving in one part after the other.
    """
    staged, landing = scratch_path(t.spark, "staged"), scratch_path(t.spark, "landing")
    schema = arrivals.schema
    part_column = "_arrives"
    arrivals.withColumn(part_column, arrives).write.partitionBy(part_column).parquet(staged)
    session = _streaming(t).spark
    stream_schema = sources.stream_source(session, staged, schema).schema
    for part in range(parts):
        sources.move_in(session, f"{staged}/{part_column}={part}", f"{landing}/{part}")
        stream = sources.stream_source(session, f"{landing}/*", stream_schema)
        run(sources.with_event_time(stream, "ts"))
    drop_path(t.spark, staged)
    drop_path(t.spark, landing)


def _collected(t: Ledger, operator: Callable[[DataFrame], DataFrame]):
    """A run that appends the operator's output to one folder, and that folder's reader."""
    out, checkpoint = scratch_path(t.spark, "stream-out"), scratch_path(t.spark, "stream-state")
    schemas = []

    def run(stream: DataFrame):
        result = operator(stream)
        schemas.append(result.schema)
        return sources.run_available(result, out, checkpoint)

    def read() -> DataFrame:
        return t.spark.read.schema(schemas[-1]).parquet(out)

    return run, read


def _over_table(t: Ledger, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    run, read = _collected(t, operator)
    stream = sources.stream_table(_streaming(t).spark, t.directory, "events")
    run(sources.with_event_time(stream, "ts"))
    return read()


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


@plan(f"""
    SELECT date_trunc('hour', ts) AS window_start,
           date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type,
           CAST(count(*) AS BIGINT) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM events GROUP BY 1, 2, 3
    HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}
""")
def tumbling_counts(t: Ledger) -> DataFrame:
    return _over_table(
        t, lambda s: windows.tumbling_counts(s, "ts", DELAY, "1 hour", ["event_type"], "value", CENTS)
    )


@plan(f"""
    WITH placed AS (
      SELECT time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL (15 * i) MINUTES AS window_start,
             value
      FROM events, range(4) r(i))
    SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end,
           CAST(count(*) AS BIGINT) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM placed GROUP BY 1, 2
    HAVING window_start + INTERVAL 1 HOUR <= {_CLOSED}
""")
def sliding_counts(t: Ledger) -> DataFrame:
    return _over_table(
        t, lambda s: windows.sliding_counts(s, "ts", DELAY, "1 hour", "15 minutes", [], "value", CENTS)
    )


@plan(f"""
    WITH opened AS (
      SELECT user_id, ts, value,
             CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts
                                 RANGE UNBOUNDED PRECEDING) AS session FROM opened)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTES AS window_end, user_id,
           CAST(count(*) AS BIGINT) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM numbered GROUP BY user_id, session
    HAVING max(ts) + INTERVAL 30 MINUTES <= {_CLOSED}
""")
def sessions(t: Ledger) -> DataFrame:
    return _over_table(
        t, lambda s: windows.sessions(s, "ts", DELAY, "30 minutes", ["user_id"], "value", CENTS)
    )


@plan("SELECT event_id, ts, user_id, event_type, value FROM events")
def dedupe_stream(t: Ledger) -> DataFrame:
    """Every part is delivered again with the next one; each event comes out once."""
    events, span = _parted(t.events)
    again = events.withColumn("part", F.col("part") + 1)
    arrivals = events.unionByName(again)
    keep = f"{2 * span // PARTS} seconds"
    run, read = _collected(t, lambda s: windows.dedupe_stream(s, "ts", keep, ["event_id"]))
    _feed(t, arrivals, F.col("part"), PARTS + 1, run)
    return read().select("event_id", "ts", "user_id", "event_type", "value")


@plan("""
    SELECT l.user_id, l.event_id AS click_id, r.event_id AS purchase_id,
           l.ts AS click_time, r.ts AS purchase_time
    FROM events l JOIN events r ON l.user_id = r.user_id
     AND r.ts > l.ts AND r.ts <= l.ts + INTERVAL 2 HOURS
    WHERE l.event_type = 'click' AND r.event_type = 'purchase'
""")
def match_stream(t: Ledger) -> DataFrame:
    events, _ = _parted(t.events)
    run, read = _collected(t, matched_pairs)
    _feed(t, events, F.col("part"), PARTS, run)
    return read()


def matched_pairs(stream: DataFrame, busy: Sequence = ()) -> DataFrame:
    clicks = stream.filter("event_type = 'click'").select(
        "user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_time")
    )
    purchases = stream.filter("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_time")
    )
    return windows.match_stream(
        clicks,
        purchases,
        "user_id",
        "click_time",
        "purchase_time",
        "click_id",
        DELAY,
        "2 hours",
        busy,
    )


_TOTALS_SQL = f"""
    WITH {_PART_SQL},
    per_part AS (
      SELECT user_id, part, count(*) AS n,
             sum(CAST(round(CAST(value AS DECIMAL(18,2)) * 100) AS BIGINT)) AS cents
      FROM parted GROUP BY 1, 2)
    SELECT user_id,
           CAST(sum(n) OVER w AS BIGINT) AS n_rows, CAST(sum(cents) OVER w AS BIGINT) AS total
    FROM per_part
    WINDOW w AS (PARTITION BY user_id ORDER BY part ROWS UNBOUNDED PRECEDING)
"""


def _totals(t: Ledger, operator: Callable[..., DataFrame]) -> DataFrame:
    events, _ = _parted(t.events)
    run, read = _collected(
        t, lambda s: operator(s.withColumn("cents", base_units("value", CENTS)), "user_id", "cents")
    )
    _feed(t, events, F.col("part"), PARTS, run)
    return read().withColumn("total", F.col("total").cast("bigint"))


@plan(_TOTALS_SQL)
def running_totals(t: Ledger) -> DataFrame:
    return _totals(t, stateful.running_totals)


@plan(_TOTALS_SQL)
def running_totals_v2(t: Ledger) -> DataFrame:
    return _totals(t, stateful.running_totals_v2)


@plan(f"""
    WITH {_PART_SQL},
    arriving AS (
      SELECT *, CASE WHEN event_type = 'error' THEN part + 1 ELSE part END AS batch FROM parted),
    highs AS (SELECT batch, max(ts) AS high FROM arriving GROUP BY 1),
    marks AS (
      SELECT b.batch, max(h.high) AS mark FROM (SELECT DISTINCT batch FROM arriving) b
      LEFT JOIN highs h ON h.batch < b.batch GROUP BY 1)
    SELECT event_id, ts, event_type, CAST(arriving.batch AS BIGINT) AS batch,
           coalesce(ts < mark - INTERVAL 10 MINUTES, false) AS late
    FROM arriving JOIN marks ON marks.batch = arriving.batch
""")
def late_report(t: Ledger) -> DataFrame:
    """Errors arrive one part later than the rest, most of them behind the mark by then."""
    events, _ = _parted(t.events)
    arrives = F.col("part") + (F.col("event_type") == "error").cast("int")
    path, checkpoint = scratch_path(t.spark, "late"), scratch_path(t.spark, "late-state")
    schemas = []

    def run(stream: DataFrame) -> None:
        schemas.append(stream.schema)
        late.late_report(stream, "ts", DELAY, path, checkpoint)

    _feed(t, events, arrives, PARTS + 1, run)
    report = late.LateReport(t.spark, path, schemas[-1], "ts", DELAY)
    both = (
        report.late().withColumn("late", F.lit(True))
        .unionByName(report.on_time().withColumn("late", F.lit(False)))
    )
    return both.select("event_id", "ts", "event_type", "batch", "late")


@plan("""
    SELECT user_id, event_id, ts, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def upsert_accounts(t: Ledger) -> DataFrame:
    events, _ = _parted(t.events)
    path, checkpoint = scratch_path(t.spark, "accounts"), scratch_path(t.spark, "accounts-state")
    order, schemas = ["ts", "event_id"], []

    def run(stream: DataFrame) -> None:
        schemas.append(stream.schema)
        sources.upsert_accounts(stream, path, checkpoint, "user_id", order, buckets=8)

    _feed(t, events, F.col("part"), PARTS, run)
    state = sources.LatestState(t.spark, path, schemas[-1], "user_id", order, buckets=8)
    return state.read().select("user_id", "event_id", "ts", "event_type")
