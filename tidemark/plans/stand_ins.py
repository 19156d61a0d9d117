"""Test tables seen as the domain's tables, for Spark and, in the same words, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.planar import segments
from tidemark.sources.tables import parquet


def r6(expression: str) -> str:
    return f"floor(({expression}) * 1e6 + 0.5) / 1e6"


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated positions of one cluster for each customer."""
    return parquet(spark, sf, "orders").select(
        F.col("o_custkey").alias("cluster_id"), F.concat(F.lit("gt"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("gt_family"),
        F.to_date("o_orderdate").alias("acq_date"), (F.col("o_totalprice") / 1000).alias("bluff_x"),
    )


SERIES = "series AS (SELECT o_custkey AS cluster_id, 'gt' || CAST(o_custkey % 3 + 1 AS VARCHAR) AS gt_family, CAST(o_orderdate AS DATE) AS acq_date, o_totalprice / 1000 AS bluff_x FROM orders)"


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as points of profiles: a supplier in a year, by price.

    Dealt by pass before they are grouped: nearly every line is a group of its
    own, so combining them where they are read would only fill memory, and
    whatever follows by pass finds them in place.  The number of parts is given
    since parts that are joined again would fill memory too.
    """
    line = parquet(spark, sf, "lineitem")
    family = F.when(F.col("l_returnflag") == "A", "gt1").when(F.col("l_returnflag") == "N", "gt2").otherwise("gt3")
    rows = line.select(
        family.alias("gt_family"), F.col("l_suppkey").cast("string").alias("beam_id"), F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("acq_date"),
        (F.col("l_extendedprice") / 100).alias("distance_from_offshore"), "l_quantity",
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "gt_family", "beam_id", "acq_date")
    return rows.groupBy("gt_family", "beam_id", "acq_date", "distance_from_offshore").agg((F.avg("l_quantity") - 25).alias("h_li"))


PROFILES = """profiles AS (
    SELECT CASE l_returnflag WHEN 'A' THEN 'gt1' WHEN 'N' THEN 'gt2' ELSE 'gt3' END AS gt_family, CAST(l_suppkey AS VARCHAR) AS beam_id,
           make_date(CAST(year(l_shipdate) AS INT), 1, 1) AS acq_date, l_extendedprice / 100 AS distance_from_offshore, avg(l_quantity) - 25 AS h_li
    FROM lineitem GROUP BY 1, 2, 3, 4)"""


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as points of ground tracks: one for each supplier, 30 rows of 20 metres."""
    line = parquet(spark, sf, "lineitem")
    return (
        line.groupBy("l_suppkey", ((F.col("l_partkey") % 30) * 20.0).alias("y"))
        .agg((F.avg("l_discount") * 20).alias("shift"), (F.avg("l_quantity") - 25).alias("h_li"))
        .select(
            F.concat(F.lit("gt"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("gt_family"), F.col("l_suppkey").cast("string").alias("beam_id"),
            (F.col("l_suppkey") * 7.0 + F.col("shift")).alias("x"), "y", "h_li",
        )
    )


TRACKS = """tracks AS (
    SELECT 'gt' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS gt_family, CAST(l_suppkey AS VARCHAR) AS beam_id,
           l_suppkey * 7.0::DOUBLE + avg(l_discount) * 20 AS x, (l_partkey % 30) * 20.0::DOUBLE AS y, avg(l_quantity) - 25 AS h_li
    FROM lineitem GROUP BY l_suppkey, (l_partkey % 30) * 20.0::DOUBLE)"""


def shore(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier as a vertex of the shore."""
    s = parquet(spark, sf, "supplier")
    vertices = s.select(F.lit(0).alias("part"), F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") * 7.0).alias("x"), (F.lit(293.0) + F.col("s_suppkey") % 3 * 5.0).alias("y"))
    return segments(vertices, ["part"], ["seq"])


SHORE = """vertices AS (SELECT s_suppkey AS seq, s_suppkey * 7.0::DOUBLE AS x, 293.0::DOUBLE + s_suppkey % 3 * 5.0::DOUBLE AS y FROM supplier),
shore AS (
    SELECT * FROM (SELECT row_number() OVER w - 1 AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM vertices WINDOW w AS (ORDER BY seq))
    WHERE x1 IS NOT NULL)"""

#: Segments of the tracks.
LINES = """lines AS (
    SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS len,
           coalesce(sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) OVER (PARTITION BY gt_family, beam_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum
    FROM (SELECT gt_family, beam_id, row_number() OVER w - 1 AS seg, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1
          FROM tracks WINDOW w AS (PARTITION BY gt_family, beam_id ORDER BY y, x)) WHERE x1 IS NOT NULL)"""


def clouds(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as clouds of points, one for each vector: all pairs of components that are not too near to 0, so clouds differ in size."""
    e = parquet(spark, sf, "embeddings")
    pair = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k")
    at = lambda k: (F.try_element_at("embedding", k + 1).cast("double") * 1000)
    return e.select("vec_id", "label", "embedding", pair).select(
        F.concat(F.lit("gt"), (F.col("label") % 3 + 1).cast("string")).alias("gt_family"), F.col("vec_id").cast("string").alias("beam_id"), "k",
        at(F.col("k") * 2).alias("x"), at(F.col("k") * 2 + 1).alias("y"), (at(F.col("k") * 2) / 20).alias("h_li"),
    ).where("x * x + y * y >= 10000")


CLOUDS = """clouds AS (
    SELECT 'gt' || CAST(label % 3 + 1 AS VARCHAR) AS gt_family, CAST(vec_id AS VARCHAR) AS beam_id, k,
           CAST(embedding[2 * k + 1] AS DOUBLE) * 1000 AS x, CAST(embedding[2 * k + 2] AS DOUBLE) * 1000 AS y, CAST(embedding[2 * k + 1] AS DOUBLE) * 1000 / 20 AS h_li
    FROM (SELECT vec_id, label, embedding, unnest(range(0, 32)) AS k FROM embeddings) WHERE x * x + y * y >= 10000)"""


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as file names of beams and of granules."""
    o = parquet(spark, sf, "orders")
    day, track = F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    side = F.when(F.col("o_orderkey") % 2 == 0, "l").otherwise("r")
    return o.select(
        "o_orderkey", F.concat(F.lit("ATL06_"), track, F.lit("_gt"), (F.col("o_orderkey") % 3 + 1).cast("string"), side, F.lit("_"), day).alias("name"),
        F.concat(F.lit("ATL06_"), day, F.lit("010203_"), track, F.lit("0203_006_02.h5")).alias("granule"),
        F.concat(F.lit("ATL06_"), day, F.lit("_"), track, F.lit("0203_007")).alias("odd_name"),
    )


NAMES = """names AS (
    SELECT o_orderkey, 'ATL06_' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '_gt' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN 'l' ELSE 'r' END || '_' || strftime(o_orderdate, '%Y%m%d') AS name,
           'ATL06_' || strftime(o_orderdate, '%Y%m%d') || '010203_' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '0203_006_02.h5' AS granule,
           'ATL06_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || '0203_007' AS odd_name
    FROM orders)"""
