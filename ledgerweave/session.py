"""Session settings, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings every job here is written for. The timezone matters for results: stream
# operators need TIMESTAMP, the stored columns are TIMESTAMP_NTZ, and the cast between
# them goes through the session timezone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # a commit then uploads the batch's changes and not whole state files
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

_local_roots: dict[str, str] = {}
_tables: dict[str, list[str]] = {}  # catalog entries of intermediate tables, by application


def tuned_session(app: str = "ledgerweave", **settings: str) -> SparkSession:
    """A session with DEFAULTS; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def apply_runtime_defaults(spark: SparkSession) -> None:
    """Set DEFAULTS on a session somebody else created (all are runtime settings)."""
    for name, value in DEFAULTS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's shared one, or a test folder in local mode."""
    context = spark.sparkContext
    shared = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        shared = _local_roots.get(context.applicationId)
        if shared is None:
            shared = tempfile.mkdtemp(prefix="ledgerweave-")
            _local_roots[context.applicationId] = shared
    return f"{shared.rstrip('/')}/ledgerweave/{context.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, so it works on any shared filesystem."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote as intermediate tables, and their entries in the
    catalog."""
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    drop_path(spark, scratch_root(spark))


def drop_written(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table, and its entry in the catalog if it has one."""
    name = _table_name(path)
    listed = _tables.get(spark.sparkContext.applicationId, [])
    if name in listed:
        listed.remove(name)
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    drop_path(spark, path)


def _table_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace("-", "_")


def in_buckets(df: DataFrame, columns: list[str], label: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df``, which must be partitioned by ``columns`` in ``shuffle_width`` parts, as a table
    bucketed by them. Buckets need an entry in the catalog; ``drop_scratch`` and ``drop_written``
    take it away again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = _table_name(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    writer = df.write.option("path", path).options(**options)
    writer.bucketBy(shuffle_width(spark), *columns).saveAsTable(name)
    return spark.table(name), path


def written_by(df: DataFrame, column: str, label: str) -> tuple[DataFrame, str]:
    """As ``written``, in buckets by a column: joins on it then move only the other side."""
    return in_buckets(df.repartition(shuffle_width(df.sparkSession), column), [column], label)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and read it back: fixed content and a short lineage that
    outlives any executor. Returns the table and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
