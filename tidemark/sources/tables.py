"""Tables from storage: Parquet and CSV in, NaN and infinities as null, missing columns added."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tidemark.functions.names import beam_file, stem


def parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def parquet_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files under a folder as one table, whatever columns each of them has."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(folder)


def csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV with a header, read by name: columns that the file lacks are null, keys stay text if the schema says so."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.csv(path, header=True)
    return conform(raw, wanted)


def conform(table: DataFrame, schema: str | StructType) -> DataFrame:
    """The columns of ``schema``, cast to its types (null where a value does not fit), missing ones as null."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = []
    for field in wanted.fields:
        value = F.col(f"`{field.name}`").try_cast(field.dataType) if field.name in table.columns else F.lit(None).cast(field.dataType)
        out.append(value.alias(field.name))
    return without_nan(table.select(*out))


def without_nan(table: DataFrame) -> DataFrame:
    """NaN and infinities of floating columns as null."""
    odd = [f.name for f in table.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return table.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in odd}) if odd else table


def write_results(table: DataFrame, path: str, keys: tuple[str, ...] = ("track_id",)) -> None:
    """The result table as Parquet, in folders by track."""
    table.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def named_beams(points: DataFrame, path: str = "file_path", keep: list[str] | None = None) -> DataFrame:
    """Points of files whose name says track, beam and date, with those three, columns ``keep`` and no null position."""
    tagged = points.withColumn("__file", beam_file(stem(F.col(path)))).where("__file IS NOT NULL").dropna(subset=["longitude", "latitude"])
    return tagged.select(*[F.col(f"__file.{c}").alias(c) for c in ("track_id", "gt", "acq_date")], *[c for c in (keep or points.columns) if c not in ("track_id", "gt", "acq_date")])


def write_profiles(table: DataFrame, path: str) -> None:
    """Profiles as Parquet in folders by track, beam and date; a repeated write replaces the folders that it has rows for."""
    keys = ["track_id", "gt", "acq_date"]
    table.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_granules(table: DataFrame, path: str) -> None:
    """Photons as Parquet in folders by granule and beam, the granule by the name of its file."""
    named = table.withColumn("granule", stem(F.col("granule")))
    named.repartition("granule", "gt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("granule", "gt").parquet(path)


def write_query(spark: SparkSession, path: str, query: dict) -> None:
    """What was asked for, as one JSON line."""
    spark.createDataFrame([(json.dumps(query, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)
