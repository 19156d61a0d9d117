"""What a beam is known by: its family and name, and its track where tables hold several."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

TRACK = "track_id"


def scoped(table: DataFrame, *keys: str) -> list[str]:
    """``keys``, after the track if ``table`` has one."""
    return [*([TRACK] if TRACK in table.columns else []), *keys]


def numbered(table: DataFrame, order: list, name: str) -> DataFrame:
    """``table`` with ``name``: numbers from 0 in ``order``, by track where there is one.

    Without tracks rows are range-sorted and each sorted partition starts where
    the (few) counts of those before it end, so no task sees all rows.
    """
    if TRACK in table.columns:
        return table.withColumn(name, F.row_number().over(Window.partitionBy(TRACK).orderBy(*order)) - 1)
    placed = staged(table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    both = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return both.withColumn(name, (F.col("__base") + F.col("__at") - F.col("__first")).cast("int")).drop("__at", "__part", "__first", "__base")
