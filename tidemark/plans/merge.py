"""Merging of result tables: which setups are missing, and which row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a row of the result table is known by.
RESULT_KEYS = ["track_id", "ClusterSize", "bias_tolerance", "gt_family", "cluster_id"]


def missing_setups(grid: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Setups of the grid that the existing results do not hold."""
    return grid.join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Both tables as one, the fresh row where a key is in both; of repeats within one the last by all other columns."""
    keys = keys or RESULT_KEYS
    both = existing.withColumn("__age", F.lit(0)).unionByName(fresh.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    rest = [F.desc_nulls_last(c) for c in both.columns if c not in {*keys, "__age"}]
    last = Window.partitionBy(*keys).orderBy(F.desc("__age"), *rest)
    return both.withColumn("__k", F.row_number().over(last)).where("__k = 1").drop("__k", "__age")
