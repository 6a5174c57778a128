"""Keys with very many rows, learned from a stream beside its main query.

Each micro-batch writes the keys that had at least so many rows in it, in a folder of its own, so a
batch that runs again replaces what it wrote. A query that spreads such keys reads the list when it
starts, see ``windows.match_stream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.sources.streams import finished_batches

MOST_KEYS = 10_000  # of the largest, which is what a condition over the list can bear


def learn(stream: DataFrame, key: str, path: str, checkpoint: str, least_rows: int) -> None:
    """Note the keys with ``least_rows`` rows or more in a micro-batch; run until input is used up.

    One count per key, combined on the map side. Null is no key, as it matches nothing.
    """

    def note(batch: DataFrame, batch_id: int) -> None:
        counts = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
        counts.filter(F.col("n_rows") >= least_rows).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    query = (
        stream.writeStream.foreachBatch(note)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def known(spark: SparkSession, path: str) -> list:
    """The keys noted so far, those with most rows in a batch first.

    Beyond ``MOST_KEYS`` the largest are given; the others are held like ordinary keys, which costs
    balance and no row.
    """
    folders = [f"{path}/batch={n}" for n in finished_batches(spark, path)]
    if not folders:
        return []
    noted = spark.read.option("basePath", path).parquet(*folders).drop("batch")
    key = next(c for c in noted.columns if c != "n_rows")
    largest = noted.groupBy(key).agg(F.max("n_rows").alias("n_rows"))
    rows = largest.orderBy(F.desc("n_rows"), key).limit(MOST_KEYS).collect()
    return [row[key] for row in rows]
