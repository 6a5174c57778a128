"""Streaming reads of ledger tables, and an idempotent latest-state table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerweave.session import drop_path
from ledgerweave.sources.ledger import declared_schema


def stream_source(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | str,
    files_per_trigger: int | None = None,
    file_glob: str | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, at a bounded rate if asked.

    A bounded rate hands files over by modification time. If event time does not follow
    it, a file may arrive wholly behind the watermark; see ``late_report``.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if file_glob is not None:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(directory)


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One named ledger table of ``directory`` as a stream."""
    return stream_source(
        spark, directory, declared_schema(name), file_glob=f"{name}.parquet"
    )


def with_event_time(stream: DataFrame, column: str) -> DataFrame:
    """Watermarks need TIMESTAMP; stored columns are TIMESTAMP_NTZ."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def move_in(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, or make an empty one if there is none to rename."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(new.getParent())
    if not (files.exists(old) and files.rename(old, new)):
        files.mkdirs(new)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there now in append mode into parquet files, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the folders ``batch=<id>`` in ``path`` that were written to the end, ascending."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    done = [
        status.getPath().getName()
        for status in files.listStatus(target)
        if files.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
    ]
    return sorted(int(name.partition("=")[2]) for name in done)


class LatestState:
    """Newest row per key, kept as files that each micro-batch rewrites only where touched.

    Keys are hashed into ``buckets``. A batch reads the current files of the buckets it
    touches, merges, and writes ``rows/batch=<id>/bucket=<n>``; after that it writes a commit,
    ``commits/batch=<id>``: for every bucket the batch that wrote its current files, one row per
    bucket. Readers take the newest commit and read the folders it names, so what is read does
    not grow with the number of batches. A batch that runs again after a failure goes by the
    newest commit before its own and replaces its own folders, so its result is the same.

    A bucket is read and written by one task; choose ``buckets`` so that one holds about a
    file's worth of rows. After each ``keep`` commits beyond ``keep``, older ones and the files
    that only they name are deleted, so that a stream that runs on does not pile them up; a reader
    that takes longer than ``keep`` batches may lose its files and has to read again.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: str,
        order: Sequence[str],
        buckets: int = 64,
        keep: int = 10,
    ):
        self.keep = max(2, keep)
        self.spark = spark
        self.rows_path = f"{path.rstrip('/')}/rows"
        self.commits_path = f"{path.rstrip('/')}/commits"
        self.schema = schema
        self.key = key
        self.order = list(order)
        self.buckets = buckets

    def _commits(self) -> list[int]:
        """Ids of the finished commits, ascending; two after ``drop_replaced``."""
        return finished_batches(self.spark, self.commits_path)

    def _places(self, commit: int | None) -> dict[int, int]:
        """The batch that wrote each bucket, as of a commit."""
        if commit is None:
            return {}
        table = self.spark.read.schema("bucket int, written bigint").parquet(
            f"{self.commits_path}/batch={commit}"
        )
        return {row["bucket"]: row["written"] for row in table.collect()}

    def _rows(self, places: dict[int, int]) -> DataFrame | None:
        if not places:
            return None
        folders = [f"{self.rows_path}/batch={batch}/bucket={n}" for n, batch in places.items()]
        columns = T.StructType(
            self.schema.fields
            + [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
        )
        reader = self.spark.read.schema(columns).option("basePath", self.rows_path)
        return reader.parquet(*folders).drop("batch")

    def _newest_rows(self, df: DataFrame) -> DataFrame:
        payload = F.struct(*self.schema.names)
        position = F.struct(*self.order)
        return (
            df.groupBy("bucket", self.key)
            .agg(F.max_by(payload, position).alias("_row"))
            .select("bucket", *[F.col(f"_row.{name}") for name in self.schema.names])
        )

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` target."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        arrived = self._newest_rows(
            batch.select(*self.schema.names).withColumn("bucket", bucket)
        ).persist()
        touched = [row["bucket"] for row in arrived.select("bucket").distinct().collect()]
        earlier = [commit for commit in self._commits() if commit < batch_id]
        places = self._places(earlier[-1] if earlier else None)
        kept = self._rows({n: places[n] for n in touched if n in places})
        merged = arrived if kept is None else self._newest_rows(kept.unionByName(arrived))
        # one task, and so one file, for each bucket
        merged.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(f"{self.rows_path}/batch={batch_id}")
        places |= {n: batch_id for n in touched}
        commit = self.spark.createDataFrame(sorted(places.items()), "bucket int, written bigint")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.commits_path}/batch={batch_id}")
        arrived.unpersist()
        if len(earlier) + 1 >= 2 * self.keep:
            self.drop_replaced(self.keep)

    def read(self) -> DataFrame:
        commits = self._commits()
        current = self._rows(self._places(commits[-1] if commits else None))
        if current is None:
            return self.spark.createDataFrame([], self.schema)
        return current.select(*self.schema.names)

    def drop_replaced(self, keep: int = 2) -> int:
        """Delete commits but the last ``keep``, and the bucket files that only those name.

        The last batch may run again and then goes by the commit before it, so that one stays.
        Not while another process merges. Returns how many bucket folders were deleted; what is
        gone is not looked at again.
        """
        commits = self._commits()
        keep = max(2, keep)
        needed = {place for c in commits[-keep:] for place in self._places(c).items()}
        dropped = set()
        for commit in commits[:-keep]:
            for place in self._places(commit).items():
                if place not in needed and place not in dropped:
                    dropped.add(place)
                    drop_path(self.spark, f"{self.rows_path}/batch={place[1]}/bucket={place[0]}")
            drop_path(self.spark, f"{self.commits_path}/batch={commit}")
        return len(dropped)

    def clear(self) -> None:
        drop_path(self.spark, self.rows_path)
        drop_path(self.spark, self.commits_path)


def upsert_accounts(
    stream: DataFrame, path: str, checkpoint: str, key: str, order: Sequence[str], buckets: int = 64
) -> LatestState:
    """Keep the newest row per account of a stream in ``path``; run until input is used up."""
    state = LatestState(stream.sparkSession, path, stream.schema, key, order, buckets)
    query = (
        stream.writeStream.foreachBatch(state.merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    state.drop_replaced()  # no batch runs now
    return state
