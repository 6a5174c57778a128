"""Python functions on Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions import records, udfs
from ledgerweave.plans.registry import plan
from ledgerweave.sources.ledger import Ledger


@plan("SELECT o_orderkey, o_orderkey AS tx, o_custkey AS account FROM orders")
def decode_records(t: Ledger) -> DataFrame:
    def packed(name: str):
        return F.lpad(F.hex(name), 16, "0")

    stored = t.orders.select(
        "o_orderkey", F.unhex(F.concat(packed("o_orderkey"), packed("o_custkey"))).alias("record")
    )
    return udfs.decode_records(stored, ["o_orderkey"], "record", ["tx", "account"])


@plan("""
    SELECT l_returnflag,
           round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS weighted_mean
    FROM lineitem GROUP BY 1
""")
def weighted_mean(t: Ledger) -> DataFrame:
    found = udfs.weighted_mean(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return found.withColumn("weighted_mean", F.round("weighted_mean", 6))


@plan("""
    SELECT event_id, key, json_extract_string(props, '$.' || key) AS value
    FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)
""")
def json_rows(t: Ledger) -> DataFrame:
    return udfs.json_rows(t.events, "event_id", "props")


@plan("""
    SELECT event_id, 0 AS place, length(event_type) AS kind, event_type AS body FROM events
    UNION ALL SELECT event_id, 1, 0, '' FROM events
    UNION ALL SELECT event_id, 2, 200, props FROM events
""")
def record_rows(t: Ledger) -> DataFrame:
    def record(kind, text):
        body = text.cast("binary")
        head = F.concat(F.lpad(F.hex(kind), 2, "0"), F.lpad(F.hex(F.octet_length(body)), 8, "0"))
        return F.concat(F.unhex(head), body)

    kind = F.col("event_type")
    stored = t.events.select(
        "event_id",
        F.concat(
            record(F.length(kind), kind), record(F.lit(0), F.lit("")), record(F.lit(200), F.col("props"))
        ).alias("data"),
    )
    found = records.record_rows(stored, "event_id", "data")
    return found.withColumn("body", F.col("body").cast("string"))
