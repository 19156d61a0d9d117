"""Change statistics kept up to date as new positions land.

New positions come through a file stream.  A batch adds its rows to the store
and recomputes the clusters that it touches from all their stored positions:
endpoints and fits depend on the whole series, so nothing is patched.  Results
carry the batch that made them; the current ones are the latest by cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import change
from tidemark.params import Params


def positions_stream(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", late: str = "30 days", keys: tuple[str, ...] = ("gt_family", "cluster_id")) -> DataFrame:
    """Positions as they land; a repeat of a cluster's date and position within the watermark counts once."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.withWatermark("acq_time", late).dropDuplicatesWithinWatermark([*keys, "acq_time", "bluff_x"])


def maintain(positions: DataFrame, store: str, results: str, checkpoint: str, keys: tuple[str, ...] = ("gt_family", "cluster_id"), params: Params | None = None, once: bool = True) -> StreamingQuery:
    """Start the query that keeps ``results`` current; ``once``: work off what is there and stop."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        # A batch that is run again overwrites its own folder.
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")
        stored = spark.read.option("basePath", store).parquet(f"{store}/batch=*")
        touched = spark.read.parquet(f"{store}/batch={number}").select(*keys).distinct()
        fresh = change.statistics(stored.join(touched, list(keys), "left_semi"), list(keys), params)
        fresh.write.mode("overwrite").parquet(f"{results}/batch={number}")

    writer = positions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, results: str, keys: tuple[str, ...] = ("gt_family", "cluster_id")) -> DataFrame:
    """The latest result of every cluster."""
    rows = spark.read.option("basePath", results).parquet(f"{results}/batch=*")
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "batch")
