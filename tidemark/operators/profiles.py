"""Operators on ordered profiles: distance along the track, interpolation, crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geodesy import geodesic_m, haversine_km
from tidemark.functions.numeric import finite, is_close
from tidemark.params import Params, pick


def along_track(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``points`` of profiles with two or more, numbered from north to south from 0, with the distance run so far."""
    order = Window.partitionBy(*keys).orderBy(F.desc(y), F.asc(x), *[F.asc(c) for c in points.columns if c not in {*keys, x, y}])
    step = F.hypot(F.col(x) - F.lag(x).over(order), F.col(y) - F.lag(y).over(order))
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns(
        {"point_id": F.row_number().over(order) - 1, "__step": F.coalesce(step, F.lit(0.0)), "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
    )
    so_far = F.sum("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.where("__n >= 2").withColumn("distance_from_offshore", so_far).drop("__step", "__n")


def distance_from_first(points: DataFrame, keys: list[str], order: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``points`` with ``distance``: great-circle metres from the first point of the profile."""
    run = Window.partitionBy(*keys).orderBy(*order)
    return points.withColumn("distance", haversine_km(F.first(lat).over(run), F.first(lon).over(run), F.col(lat), F.col(lon)) * 1000)


def geodesic_along(points: DataFrame, keys: list[str], order: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """``points`` with ``distance_m``: metres on the ellipsoid run so far, in the order given (north to south)."""
    run = Window.partitionBy(*keys).orderBy(*order)
    step = F.coalesce(geodesic_m(F.lag(lat).over(run), F.lag(lon).over(run), F.col(lat), F.col(lon)), F.lit(0.0))
    return points.withColumn("__step", step).withColumn("distance_m", F.sum("__step").over(run.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def at_distance(points: DataFrame, keys: list[str], x0: float, x: str = "distance_from_offshore", y: str = "h_li", every: bool = False, ends: bool = False) -> DataFrame:
    """keys, value: each profile's linear interpolation at ``x0``, flat beyond its ends, null with under two points.

    Points at the same distance count with their mean.  Profiles without a
    single known point are absent, unless ``every`` asks for them, with null.
    With ``ends``, also ``low`` and ``high``: the least and the greatest height
    of the points that count, as they are given.
    """
    given = [F.col(y).alias("low"), F.col(y).alias("high")] if ends else []
    rows = points.select(*keys, finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y"), *given)
    if every:
        rows = rows.withColumn("x", F.when(F.col("y").isNotNull(), F.col("x")))
    else:
        rows = rows.where("x IS NOT NULL AND y IS NOT NULL")
    extremes = [F.min("low").alias("low"), F.max("high").alias("high")] if ends else []
    rows = rows.groupBy(*keys, "x").agg(F.avg("y").alias("y"), F.count("x").alias("n"), *extremes)
    before, after = F.when(F.col("x") <= x0, F.col("x")), F.when(F.col("x") >= x0, F.col("x"))
    # Numbers only: the greatest of structs would be found by sorting.
    sides = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max(before).alias("ax"), F.max_by("y", before).alias("ay"), F.min(after).alias("bx"), F.min_by("y", after).alias("by"), *extremes)
    between = F.col("ay") + (F.lit(x0) - F.col("ax")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0)) * (F.col("by") - F.col("ay"))
    value = F.when(F.col("n") < 2, None).when(F.col("ax").isNull(), F.col("by")).when(F.col("bx").isNull() | (F.col("ax") == F.col("bx")), F.col("ay")).otherwise(between)
    return sides.select(*keys, value.alias("value"), *(["low", "high"] if ends else []))


def crossings(points: DataFrame, keys: list[str], reference: Column, which: str = "first", params: Params | None = None, atol: float | None = None,
              x: str = "distance_from_offshore", y: str = "h_li", respect_gaps: bool = False) -> DataFrame:
    """keys, bluff_x, bluff_y: where each profile meets the ``reference`` height (one for each profile), first or last by distance.

    A point at the height (within ``atol``) wins over every interpolated
    crossing.  Between neighbours on either side the position is interpolated,
    however wide the gap; ``respect_gaps`` leaves gaps over the threshold out.
    A profile that is flat at the height gives its median distance.  Profiles
    without a crossing, or with under two points, give null.

    One shuffle and one sort by profile serve all steps, and the last one adds
    up numbers only, so it needs neither another sort nor buffers of values.
    """
    if which not in ("first", "last"):
        raise ValueError("which is 'first' or 'last'")
    tolerance = pick(atol, params, "crossing_atol")
    rows = points.select(*keys, finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y"), reference.cast("double").alias("ref"))
    run = Window.partitionBy(*keys).orderBy("x", "y")
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL AND ref IS NOT NULL").withColumns({"x1": F.lead("x").over(run), "y1": F.lead("y").over(run)})
    rows = rows.where("x1 IS NULL OR x1 <> x OR y1 <> y")  # of repeated points the last counts, whose neighbour is another
    rows = rows.withColumns({"k": F.row_number().over(run), "points": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    d0, d1 = F.col("y") - F.col("ref"), F.col("y1") - F.col("ref")
    flips = F.signum(d0) * F.signum(d1) < 0
    if respect_gaps:
        flips = flips & (F.col("x1") - F.col("x") <= pick(None, params, "gap_threshold_m"))
    crossed = F.col("x") + (F.col("ref") - F.col("y")) / F.nullif(F.col("y1") - F.col("y"), F.lit(0.0)) * (F.col("x1") - F.col("x"))
    crossed = F.when(~is_close(F.col("y"), F.col("y1"), tolerance), crossed)
    end, end_by = (F.min, F.min_by) if which == "first" else (F.max, F.max_by)
    in_middle = (F.col("k") * 2).between(F.col("points"), F.col("points") + 2)
    each = rows.groupBy(*keys).agg(
        F.max("ref").alias("ref"), F.count(F.lit(1)).alias("n"),
        end(F.when(F.abs(d0) <= tolerance, F.col("x"))).alias("exact"),
        F.count_if(flips).alias("flips"), end_by(crossed, F.when(flips, F.col("k"))).alias("at"),
        F.min("y").alias("low"), F.max("y").alias("high"), F.avg(F.when(in_middle, F.col("x"))).alias("middle"),
    )
    flat = is_close(F.col("low"), F.col("high"), tolerance) & is_close(F.col("low"), F.col("ref"), tolerance)
    found = F.when(F.col("n") < 2, None).when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("flips") > 0, F.col("at")).when(flat, F.col("middle"))
    return each.select(*keys, found.alias("bluff_x"), F.when(found.isNotNull(), F.col("ref")).alias("bluff_y"))


def advancing(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Optional filter, off by default in the workflow: dates whose position has not fallen since the one before."""
    run = Window.partitionBy(*keys).orderBy("acq_date")
    return positions.withColumn("__dx", F.col("bluff_x") - F.lag("bluff_x").over(run)).where("__dx IS NULL OR __dx >= 0").drop("__dx")
