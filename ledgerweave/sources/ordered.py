"""Parquet files as a stream in the order of their event times.

Spark's file stream hands files over by modification time. If a file that was written early holds
late events, the watermark passes over the others' rows and they are dropped. This source takes the
files by the largest event time in their footers instead, a few to a micro-batch.

The order of the files found so far is kept in a folder beside the checkpoint, as files that are only
ever added: an offset is a number of files in that order, so it means the same after a restart.
Files that turn up later come after those already in the order, by event time among themselves.
Rows are read in tasks, one file each. The folder's store must be one that Arrow can open.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

FORMAT = "event_ordered_parquet"
AVAILABLE_NOW = "spark.sql.streaming.triggerAvailableNowWrapper.enabled"
FOOTER_THREADS = 16
_ORDER = "order-"
_PLANNED = "planned.json"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class OrderedFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def newest_time(system: fs.FileSystem, path: str, time: str) -> int | None:
    """The largest value of a time column by the footer, in microseconds; null if it does not say."""
    with system.open_input_file(path) as file:
        footer = pq.ParquetFile(file).metadata
    names = [footer.schema.column(i).name for i in range(footer.num_columns)]
    if time not in names:
        return None
    at, best = names.index(time), None
    for group in range(footer.num_row_groups):
        seen = footer.row_group(group).column(at).statistics
        if seen is None or not seen.has_min_max:
            if footer.row_group(group).num_rows:
                return None
            continue
        value = pa.scalar(seen.max).cast(pa.timestamp("us")).value
        best = value if best is None else max(best, value)
    return best


class OrderedReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.folder, self.time = options["path"], options["time"]
        self.log = options["log"]
        self.per_batch = int(options.get("files_per_batch", 1))
        self.schema = schema
        self.order: list[str] | None = None
        self.planned: int | None = None

    # the order of files

    def _logged(self) -> list[str]:
        system, path = _opened(self.log)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        parts = sorted(f.path for f in found if f.base_name.startswith(_ORDER) and f.base_name.endswith(".json"))
        order: list[str] = []
        for part in parts:
            with system.open_input_file(part) as file:
                order += json.loads(file.read())
        return order

    def _write(self, name: str, content: object) -> None:
        """A file is written under another name and then moved, so that it is whole or absent."""
        system, path = _opened(self.log)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/.{name}") as file:
            file.write(json.dumps(content).encode())
        system.move(f"{path}/.{name}", f"{path}/{name}")

    def _discover(self) -> list[str]:
        if self.order is None:
            self.order = self._logged()
        system, path = _opened(self.folder)
        known = set(self.order)
        new = [
            f.path
            for f in system.get_file_info(fs.FileSelector(path, recursive=True))
            if f.is_file and f.path.endswith(".parquet") and f.path not in known
            and not any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/"))
        ]
        if new:
            with ThreadPoolExecutor(FOOTER_THREADS) as pool:
                times = list(pool.map(lambda p: newest_time(system, p, self.time), new))
            # files whose footer does not say come last: nothing can be late because of them
            ranked = sorted(zip(times, new, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            self._write(f"{_ORDER}{len(self.order):012d}.json", [p for _, p in ranked])
            self.order += [p for _, p in ranked]
        return self.order

    def _last_planned(self) -> int:
        system, path = _opened(self.log)
        file = system.get_file_info(f"{path}/{_PLANNED}")
        if not file.is_file:
            return 0
        with system.open_input_file(file.path) as content:
            return json.loads(content.read())

    # what the stream asks

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        """A batch beyond what was planned last, however often it is asked before it is planned."""
        order = self._discover()
        if self.planned is None:
            self.planned = self._last_planned()
        return {"files": min(len(order), self.planned + self.per_batch)}

    def partitions(self, start: dict, end: dict) -> list[OrderedFile]:
        order = self._discover()
        known = self._last_planned() if self.planned is None else self.planned
        self.planned = max(known, end["files"])
        if self.planned > known:  # the stream's own log has this offset by now
            self._write(_PLANNED, self.planned)
        return [OrderedFile(p) for p in order[start["files"] : end["files"]]]

    def read(self, partition: OrderedFile) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        kinds = to_arrow_schema(self.schema)
        with system.open_input_file(partition.path) as file:
            stored = pq.ParquetFile(file)
            here = [n for n in kinds.names if n in stored.schema_arrow.names]
            for batch in stored.iter_batches(columns=here):
                columns = [
                    batch.column(f.name).cast(f.type) if f.name in here else pa.nulls(len(batch), f.type)
                    for f in kinds
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def commit(self, end: dict) -> None:
        pass


class EventOrderedParquet(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the schema to the reader")

    def streamReader(self, schema: T.StructType) -> OrderedReader:
        return OrderedReader(dict(self.options), schema)


def ordered_source(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    time: str,
    log: str,
    files_per_batch: int = 1,
) -> DataFrame:
    """Parquet files of ``folder`` as a stream, ``files_per_batch`` at a time, by the largest ``time`` in
    their footers (equal ones by name). ``log`` is a folder for the order, one for each checkpoint.

    Files without a footer statistic of ``time`` come last, a column that a file lacks is null. In
    ``availableNow`` a run takes one micro-batch; ``drained`` runs it until all files are taken.
    """
    spark.dataSource.register(EventOrderedParquet)
    # else a run ends with its batch, and what the batch's watermark closes would wait for more files
    spark.conf.set(AVAILABLE_NOW, "true")
    reader = spark.readStream.format(FORMAT).schema(schema)
    return (
        reader.option("path", folder)
        .option("time", time)
        .option("log", log)
        .option("files_per_batch", str(files_per_batch))
        .load()
    )


def drained(run: Callable[[], StreamingQuery]) -> int:
    """Call ``run`` (one availableNow run of a query on an ``ordered_source``) until it has taken all
    files. Returns the number of runs."""
    taken, runs = None, 0
    while True:
        progress = run().lastProgress
        runs += 1
        now = progress.sources[0].endOffset if progress is not None and progress.sources else taken
        if now == taken:
            return runs
        taken = now
