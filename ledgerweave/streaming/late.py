"""Late rows kept aside instead of lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerweave.session import drop_path
from ledgerweave.sources.streams import finished_batches


class LateReport:
    """Splits each micro-batch into on-time and late rows, and keeps both.

    A row is late if its event time is before the high-water mark of all *earlier* batches
    less the delay. Each batch writes under its own id (``rows/batch=<id>/_late=<bool>`` and
    ``marks/batch=<id>``), and its mark is that of all batches so far. It reads the mark of the
    last smaller id alone, so a batch that runs again replaces its own output and decides as it
    did before. Marks before the last two are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema, time: str, delay: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.time = time
        self.delay = delay

    def _read(self, part: str, columns: str) -> DataFrame:
        return self.spark.read.schema(columns).parquet(f"{self.path}/{part}")

    def split(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` target."""
        marks = f"{self.path}/marks"
        earlier = [b for b in finished_batches(self.spark, marks) if b < batch_id]
        high = None
        if earlier:
            high = self._read(f"marks/batch={earlier[-1]}", "high bigint").first()[0]
        if high is None:
            is_late = F.lit(False)
        else:
            # one value per batch, put back into the plan as a literal
            bound = F.timestamp_micros(F.lit(high)) - F.expr(f"INTERVAL {self.delay}")
            is_late = F.coalesce(F.col(self.time) < bound, F.lit(False))
        own = f"{self.path}/rows/batch={batch_id}"
        seen = Observation()
        rows = batch.observe(seen, F.max(F.unix_micros(self.time)).alias("high"))
        rows.withColumn("_late", is_late).write.mode("overwrite").partitionBy("_late").parquet(own)
        known = [mark for mark in (high, seen.get["high"]) if mark is not None]
        mark = self.spark.createDataFrame([(max(known, default=None),)], "high bigint")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        for old in earlier[:-1]:
            drop_path(self.spark, f"{marks}/batch={old}")

    def _rows(self, late: bool) -> DataFrame:
        ddl = ", ".join(
            f"`{field.name}` {field.dataType.simpleString()}" for field in self.schema.fields
        )
        rows = self._read("rows", f"{ddl}, batch bigint, _late boolean")
        return rows.filter(F.col("_late") == late).drop("_late")

    def late(self) -> DataFrame:
        return self._rows(True)

    def on_time(self) -> DataFrame:
        return self._rows(False)


def late_report(stream: DataFrame, time: str, delay: str, path: str, checkpoint: str) -> LateReport:
    """Run over what is there now; returns the report, readable as two tables."""
    report = LateReport(stream.sparkSession, path, stream.schema, time, delay)
    query = (
        stream.writeStream.foreachBatch(report.split)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return report
