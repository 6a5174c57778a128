"""Ledger tables on disk: declared schemas, checked reads, nested records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
import pyarrow.fs  # noqa: F401
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


class SchemaDrift(ValueError):
    """A table on disk does not have the declared columns."""


def declared_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def schema_differences(found: T.StructType, declared: T.StructType) -> list[str]:
    """What differs in names and types; nullability and column order are not drift."""
    have = {field.name: field.dataType.simpleString() for field in found.fields}
    want = {field.name: field.dataType.simpleString() for field in declared.fields}
    return [
        f"{name}: declared {want.get(name, 'nothing')}, found {have.get(name, 'nothing')}"
        for name in sorted(have.keys() | want.keys())
        if have.get(name) != want.get(name)
    ]


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table with its declared schema, after checking that of all its files.

    Spark reads the footers in a distributed job and puts their columns together. If that fails,
    or the columns are not the declared ones, the footers of all files are looked at one by
    one in tasks, and the error names files, columns and both types. A file that lacks a column
    which others have gives nulls; ``missing_columns`` finds such files.
    """
    path = f"{directory.rstrip('/')}/{name}.parquet"
    declared = declared_schema(name)
    try:
        df = spark.read.option("mergeSchema", "true").parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        if "MERGE" not in str(error):
            raise
        files = spark.read.schema(declared).parquet(path).inputFiles()
        raise SchemaDrift(f"{path}: " + _named(footer_drift(spark, files, declared))) from None
    differences = schema_differences(df.schema, declared)
    if differences:
        named = _named(footer_drift(spark, df.inputFiles(), declared))
        raise SchemaDrift(f"{path}: " + "; ".join([*differences, named]))
    return df.select(*declared.names)


FOOTERS_PER_TASK = 200
SHOWN = 20  # differences in an error's text


def _footers(batches: Iterable[pa.RecordBatch]):
    """Columns of each Parquet file and their types, from footers alone."""
    for batch in batches:
        files, names, types = [], [], []
        for uri in batch.column("file").to_pylist():
            system, path = pa.fs.FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                arrow = pq.read_schema(file)
            for field in arrow:
                try:
                    found = from_arrow_schema(pa.schema([field]), prefer_timestamp_ntz=True)
                    kind = found.fields[0].dataType.simpleString()
                except PySparkException:  # a type that Spark has not
                    kind = str(field.type)
                files.append(uri)
                names.append(field.name)
                types.append(kind)
        yield pa.RecordBatch.from_pydict(
            {"file": pa.array(files, pa.string()), "column": pa.array(names, pa.string()),
             "type": pa.array(types, pa.string())}
        )


def footers(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``file, column, type`` of Parquet files, read in tasks; no data page is read.

    The files' store must be one that Arrow can open (local and mounted folders, S3, GCS, HDFS).
    """
    listed = spark.createDataFrame([(name,) for name in files], "file string")
    parts = max(1, min(len(files), -(-len(files) // FOOTERS_PER_TASK)))
    return listed.repartition(parts).mapInArrow(_footers, "file string, column string, type string")


def footer_drift(spark: SparkSession, files: Sequence[str], declared: T.StructType) -> DataFrame:
    """``file, column, declared, found`` where a file has another type or another column."""
    wanted = spark.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in declared.fields], "column string, declared string"
    )
    found = footers(spark, files).withColumnRenamed("type", "found")
    return (
        found.join(F.broadcast(wanted), "column", "left")  # one row for each declared column
        .filter(~F.col("declared").eqNullSafe(F.col("found")))
        .select("file", "column", "declared", "found")
    )


def _named(drift: DataFrame) -> str:
    rows = drift.orderBy("file", "column").limit(SHOWN + 1).collect()
    said = [
        f"{r['file']}: {r['column']}: declared {r['declared'] or 'nothing'}, found {r['found']}"
        for r in rows[:SHOWN]
    ]
    return "; ".join([*said, "and more"] if len(rows) > SHOWN else said)


def missing_columns(df: DataFrame) -> DataFrame:
    """``file, column`` of columns of ``df`` that some of its Parquet files have and others lack;
    from the footers alone. Columns that no file has are not listed."""
    spark = df.sparkSession
    files = df.inputFiles()
    known = footers(spark, files).select("file", "column")
    seen = [r["column"] for r in known.select("column").distinct().collect()]
    some = F.array(*[F.lit(name) for name in df.columns if name in seen]).cast("array<string>")
    every = spark.createDataFrame([(name,) for name in files], "file string")
    wanted = every.select("file", F.explode(some).alias("column"))
    return wanted.join(known, ["file", "column"], "left_anti")


def load_ledger(
    spark: SparkSession, directory: str, names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    return {name: load_table(spark, directory, name) for name in (names or SCHEMAS)}


class Ledger:
    """Tables of one directory as attributes, each read on first use."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = load_table(self.spark, self.directory, name)
        setattr(self, name, table)
        return table


def flatten_records(
    df: DataFrame, key: str, records: str | Column, prefix: str = "", keep_empty: bool = False
) -> DataFrame:
    """One row per element of a nested array, with its position.

    Struct elements become columns (``prefix`` before each name), other elements one
    column ``value``. Rows with an empty or null array vanish unless ``keep_empty``.
    """
    column = F.col(records) if isinstance(records, str) else records
    explode = F.posexplode_outer if keep_empty else F.posexplode
    flat = df.select(F.col(key), explode(column).alias("pos", "_item"))
    item = flat.schema["_item"].dataType
    if isinstance(item, T.StructType):
        fields = [F.col(f"_item.`{name}`").alias(f"{prefix}{name}") for name in item.names]
    else:
        fields = [F.col("_item").alias(f"{prefix}value")]
    return flat.select(key, "pos", *fields)
