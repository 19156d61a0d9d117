"""From raw points to profiles ready for analysis: checks, clips, orders, corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geodesy import polar
from tidemark.functions.numeric import finite
from tidemark.operators.planar import segments
from tidemark.operators.profiles import distance_from_first, geodesic_along
from tidemark.operators.spatial import within_segments


def good_points(points: DataFrame) -> DataFrame:
    """Points with finite position and height, of quality 0 where a quality is given; odd numbers become null first."""
    held = points.withColumns({c: finite(F.col(c)) for c in ("latitude", "longitude", "h_li")}).dropna(subset=["latitude", "longitude", "h_li"])
    return held.where("atl06_quality_summary = 0") if "atl06_quality_summary" in points.columns else held


def granule_numbers(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rgt, cycle: the whole part of the median over a granule's group."""
    return points.groupBy(*keys).agg(F.median("rgt").cast("int").alias("rgt"), F.median("cycle_number").cast("int").alias("cycle"))


def clipped_profiles(points: DataFrame, shore: DataFrame, keys: list[str], reach: float = 500.0, closed: bool = True, minimum: int = 1, spherical: bool = False) -> DataFrame:
    """Good points within ``reach`` metres of the shore (polar plane), north to south, with the distance run.

    ``shore``: segments (x0, y0, x1, y1) in the polar plane.  Profiles with fewer
    than ``minimum`` points left are dropped.  ``spherical``: great-circle
    metres from the first point, in the order of ``seq``, as older tables have.
    """
    plane = good_points(points).withColumn("__p", polar(F.col("latitude"), F.col("longitude"))).withColumns({"x": F.col("__p.x"), "y": F.col("__p.y")}).drop("__p")
    near = within_segments(plane, shore, reach, closed)
    full = near.join(near.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= minimum).drop("__n"), keys, "left_semi")
    if spherical:
        return distance_from_first(full, keys, ["seq"])
    return geodesic_along(full.withColumn("__south", -F.col("latitude")), keys, ["__south", "longitude"]).drop("__south")


def whole_profiles(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Good points of whole profiles, without a clip, with great-circle metres from the first one in ``order``."""
    return distance_from_first(good_points(points), keys, order)


def display_range(points: DataFrame, keys: list[str], low: float = -2.0, high: float = 10.0, minimum: int = 80) -> DataFrame:
    """Points in a range of heights, of profiles with ``minimum`` of them at least."""
    held = points.where(F.col("h_li").between(low, high))
    return held.join(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= minimum).drop("__n"), keys, "left_semi")


def corridor_files(points: DataFrame, axis: DataFrame, file: str, reach: float = 25.0) -> DataFrame:
    """All points of files that have any point within ``reach`` of the line through ``axis`` (seq, x, y)."""
    line = segments(axis.withColumn("line", F.lit(0)), ["line"], ["seq"])
    hit = within_segments(points.select(file, "x", "y"), line, reach).select(file).distinct()
    return points.join(hit, file, "left_semi")


def shore_files(points: DataFrame, shore: DataFrame, file: str, reach: float = 300.0) -> DataFrame:
    """All points of files that have any point within ``reach`` of the shore."""
    hit = within_segments(points.select(file, "x", "y"), shore, reach).select(file).distinct()
    return points.join(hit, file, "left_semi")


def batches(files: DataFrame, family: str = "gt_family") -> DataFrame:
    """How many files and passes each family has."""
    return files.groupBy(family).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("track_id").alias("tracks"))
