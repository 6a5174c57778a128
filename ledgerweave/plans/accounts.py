"""Account state in time: balances, links, follow-ups, trailing volumes, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.columns import to_units
from ledgerweave.operators import joins, temporal, windows
from ledgerweave.plans.registry import CENTS, SMALL_SLICES, plan
from ledgerweave.session import written
from ledgerweave.sources.ledger import Ledger

_RUNNING_SQL = """
    SELECT o_orderkey, {key},
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (
             PARTITION BY {key} ORDER BY o_orderdate, o_orderkey
             ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance
    FROM orders
"""


def _running(t: Ledger, key: str, **options) -> DataFrame:
    tx = t.orders.select("o_orderkey", key, "o_orderdate", "o_totalprice")
    balance = windows.running_balance(
        tx, key, ["o_orderdate", "o_orderkey"], to_units("o_totalprice", CENTS), **options
    )
    return balance.select("o_orderkey", key, "balance")


@plan(_RUNNING_SQL.format(key="o_custkey"))
def running_balance(t: Ledger) -> DataFrame:
    return _running(t, "o_custkey")


@plan(_RUNNING_SQL.format(key="o_orderstatus"))
def running_balance_hot(t: Ledger) -> DataFrame:
    """Three keys that each hold a third of all rows, cut into slices."""
    return _running(t, "o_orderstatus", min_slice_rows=SMALL_SLICES)


_LINK_SQL = """
    SELECT o_orderkey, {key}, coalesce(prev_key, -1) AS prev_o_orderkey,
           coalesce(CAST(date_diff('day', prev_date, o_orderdate) AS BIGINT), -1) AS days_since
    FROM (SELECT *, lag(o_orderkey) OVER w AS prev_key, lag(o_orderdate) OVER w AS prev_date
          FROM orders
          WINDOW w AS (PARTITION BY {key} ORDER BY o_orderdate, o_orderkey))
"""


def _links(t: Ledger, key: str, **options) -> DataFrame:
    tx = t.orders.select("o_orderkey", key, "o_orderdate")
    order = ["o_orderdate", "o_orderkey"]
    linked = windows.prev_link(tx, key, order, ["o_orderkey", "o_orderdate"], **options)
    days = F.date_diff("o_orderdate", "prev_o_orderdate")
    return linked.select(
        "o_orderkey",
        key,
        F.coalesce("prev_o_orderkey", F.lit(-1)).alias("prev_o_orderkey"),
        F.coalesce(days, F.lit(-1)).alias("days_since"),
    )


@plan(_LINK_SQL.format(key="o_custkey"))
def prev_link(t: Ledger) -> DataFrame:
    return _links(t, "o_custkey")


@plan(_LINK_SQL.format(key="o_orderpriority"))
def prev_link_hot(t: Ledger) -> DataFrame:
    return _links(t, "o_orderpriority", min_slice_rows=SMALL_SLICES)


_TRAILING_SQL = """
    SELECT o_orderkey, {key},
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DOUBLE) AS volume,
           CAST(count(*) OVER w AS BIGINT) AS n_tx
    FROM orders
    WINDOW w AS (PARTITION BY {key} ORDER BY o_orderdate
                 RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)
"""


def _trailing(t: Ledger, key: str, **options) -> DataFrame:
    tx = t.orders.select("o_orderkey", key, "o_orderdate", "o_totalprice")
    volume = temporal.trailing_volume(
        tx, key, "o_orderdate", to_units("o_totalprice", CENTS), 7, **options
    )
    return volume.select("o_orderkey", key, "volume", "n_tx")


@plan(_TRAILING_SQL.format(key="o_custkey"))
def trailing_volume(t: Ledger) -> DataFrame:
    return _trailing(t, "o_custkey")


@plan(_TRAILING_SQL.format(key="o_orderstatus"))
def trailing_volume_hot(t: Ledger) -> DataFrame:
    return _trailing(t, "o_orderstatus", min_slice_rows=SMALL_SLICES)


_NO_STATUS = "(SELECT *, nullif(o_orderstatus, 'F') AS status FROM orders)"


def _without_status(t: Ledger) -> DataFrame:
    """Orders with a key that is null for a large share of the rows."""
    return t.orders.withColumn("status", F.nullif("o_orderstatus", F.lit("F")))


@plan(_TRAILING_SQL.format(key="status").replace("FROM orders", f"FROM {_NO_STATUS}"))
def trailing_volume_null(t: Ledger) -> DataFrame:
    """The rows without a key are one account, and it is cut."""
    tx = _without_status(t).select("o_orderkey", "status", "o_orderdate", "o_totalprice")
    value = to_units("o_totalprice", CENTS)
    volume = temporal.trailing_volume(tx, "status", "o_orderdate", value, 7, SMALL_SLICES)
    return volume.select("o_orderkey", "status", "volume", "n_tx")


_FOLLOW_SQL = """
    SELECT a.o_orderkey, a.{key}, a.o_orderdate, CAST(count(*) AS BIGINT) AS n_follow_ups,
           arg_min(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) AS first_id,
           min(b.o_orderdate) AS first_time
    FROM orders a JOIN orders b
      ON a.{key} = b.{key} AND b.o_orderdate > a.o_orderdate
     AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAYS
    GROUP BY 1, 2, 3
"""


@plan(_FOLLOW_SQL.format(key="o_custkey"))
def follow_ups(t: Ledger) -> DataFrame:
    tx = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return temporal.follow_ups(tx, "o_custkey", "o_orderdate", "o_orderkey", 30)


@plan(_FOLLOW_SQL.format(key="o_orderstatus"))
def follow_ups_hot(t: Ledger) -> DataFrame:
    tx = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    return temporal.follow_ups(
        tx, "o_orderstatus", "o_orderdate", "o_orderkey", 30, min_slice_rows=SMALL_SLICES
    )


@plan(
    _FOLLOW_SQL.format(key="status")
    .replace("a.status = b.status", "a.status IS NOT DISTINCT FROM b.status")
    .replace("orders a", f"{_NO_STATUS} a")
    .replace("orders b", f"{_NO_STATUS} b")
)
def follow_ups_null(t: Ledger) -> DataFrame:
    """The rows without a key are one account, and it is cut."""
    tx = _without_status(t).select("o_orderkey", "status", "o_orderdate")
    return temporal.follow_ups(tx, "status", "o_orderdate", "o_orderkey", 30, SMALL_SLICES)


@plan("""
    SELECT c_custkey, c_name, o_orderdate, o_orderkey, o_totalprice FROM customer JOIN (
      SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders
      WHERE o_orderdate <= TIMESTAMP '1998-06-30'
      QUALIFY row_number() OVER (PARTITION BY o_custkey
                                 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
    ) ON o_custkey = c_custkey
""")
def state_as_of(t: Ledger) -> DataFrame:
    return temporal.state_as_of(
        t.customer.select("c_custkey", "c_name"),
        t.orders,
        "c_custkey",
        "o_custkey",
        "o_orderdate",
        ["o_orderkey"],
        ["o_orderkey", "o_totalprice"],
        "1998-06-30",
    )


_AS_OF_SQL = """
    WITH probes AS (
      SELECT {key} AS account, l_orderkey, l_linenumber, l_suppkey, l_shipdate
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    states AS (
      SELECT {key} AS account, o_orderdate, max(o_orderkey) AS state_id
      FROM orders GROUP BY 1, 2)
    SELECT probes.account, l_orderkey, l_linenumber, l_suppkey, l_shipdate,
           coalesce(state_id, -1) AS state_id,
           coalesce(o_orderdate, TIMESTAMP '1900-01-01') AS state_time
    FROM probes ASOF LEFT JOIN states
      ON probes.account = states.account AND probes.l_shipdate >= states.o_orderdate
"""


def _as_of_each(t: Ledger, key: str, **options) -> DataFrame:
    """The state of the account at each message's own time."""
    records = t.orders.select(
        F.col(key).alias("account"), "o_orderdate", F.col("o_orderkey").alias("state_id")
    )
    probes = joins.attach_messages(
        t.orders.select("o_orderkey", F.col(key).alias("account")),
        t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"),
        "o_orderkey",
        "l_orderkey",
    ).drop("o_orderkey")
    probes, _ = written(probes, "probes")  # a join, read once to count keys and once for use
    found = temporal.state_as_of_each(
        records,
        probes,
        "account",
        "o_orderdate",
        "l_shipdate",
        ["state_id"],
        ["state_id"],
        **options,
    )
    never = F.lit("1900-01-01").cast("timestamp_ntz")
    return found.select(
        "account",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_shipdate",
        F.coalesce("state_id", F.lit(-1)).alias("state_id"),
        F.coalesce("o_orderdate", never).alias("state_time"),
    )


@plan(_AS_OF_SQL.format(key="o_custkey"))
def state_as_of_each(t: Ledger) -> DataFrame:
    return _as_of_each(t, "o_custkey")


@plan(_AS_OF_SQL.format(key="o_orderstatus"))
def state_as_of_each_hot(t: Ledger) -> DataFrame:
    return _as_of_each(t, "o_orderstatus", min_slice_rows=SMALL_SLICES)


@plan("""
    WITH balances AS (
      SELECT o_custkey,
             sum(CAST(o_totalprice AS DECIMAL(18,2)))
               FILTER (o_orderdate <= TIMESTAMP '1998-01-01') AS b,
             sum(CAST(o_totalprice AS DECIMAL(18,2)))
               FILTER (o_orderdate <= TIMESTAMP '1998-02-01') AS a
      FROM orders GROUP BY 1)
    SELECT o_custkey, coalesce(CAST(b AS DOUBLE), 0) AS before,
           coalesce(CAST(a AS DOUBLE), 0) AS after,
           CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM balances WHERE b IS DISTINCT FROM a
""")
def state_diff(t: Ledger) -> DataFrame:
    def at(day: str) -> DataFrame:
        until = F.lit(day).cast("timestamp_ntz")
        return joins.balance_at(
            t.orders, "o_custkey", "o_orderdate", to_units("o_totalprice", CENTS), until
        )

    found = joins.state_diff(at("1998-01-01"), at("1998-02-01"), ["o_custkey"], "balance")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ["before", "after"]})


_SESSIONS_SQL = """
    WITH opened AS (
      SELECT {key}, ts, value,
             CASE WHEN ts <= lag(ts) OVER w + INTERVAL {gap} THEN 0 ELSE 1 END AS opens
      FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
    numbered AS (
      SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY ts
                                 RANGE UNBOUNDED PRECEDING) AS session FROM opened)
    SELECT {key}, min(ts) AS session_start, max(ts) + INTERVAL {gap} AS session_end,
           CAST(count(*) AS BIGINT) AS n_events,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
    FROM numbered GROUP BY {key}, session
"""


def _sessions(t: Ledger, key: str, gap_seconds: int, **options) -> DataFrame:
    events = t.events.select(key, "ts", "event_id", "value")
    aggregates = [
        F.count(F.lit(1)).alias("n_events"),
        F.sum(to_units("value", CENTS)).alias("total_value"),
    ]
    return temporal.sessions_batch(events, key, "ts", "event_id", gap_seconds, aggregates, **options)


@plan(_SESSIONS_SQL.format(key="user_id", gap="30 MINUTES"))
def sessions_batch(t: Ledger) -> DataFrame:
    return _sessions(t, "user_id", 1800)


@plan(_SESSIONS_SQL.format(key="event_type", gap="30 MINUTES"))
def sessions_batch_hot(t: Ledger) -> DataFrame:
    return _sessions(t, "event_type", 1800, min_slice_rows=SMALL_SLICES)
