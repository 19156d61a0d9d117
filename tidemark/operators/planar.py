"""Ground tracks and shoreline as tables of segments, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keys import scoped
from tidemark.operators.spatial import along, crossing_at, overlap_at
from tidemark.sources.staging import staged


def segments(vertices: DataFrame, keys: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, seg (from 0), x0, y0, x1, y1, len and cum (length before the segment): lines through vertices in ``order``."""
    run = Window.partitionBy(*keys).orderBy(*order)
    rows = vertices.select(*keys, (F.row_number().over(run) - 1).alias("seg"), F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(run).alias("x1"), F.lead(y).over(run).alias("y1"))
    rows = rows.where("x1 IS NOT NULL").withColumn("len", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    before = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("cum", F.coalesce(F.sum("len").over(before), F.lit(0.0)))


def beam_lines(points: DataFrame) -> DataFrame:
    """Segments of every beam with two or more points and a length, from south to north."""
    beam = scoped(points, "gt_family", "beam_id")
    lines = segments(points.where("x IS NOT NULL AND y IS NOT NULL"), beam, ["y", "x"])
    long = lines.groupBy(*beam).agg(F.sum("len").alias("total")).where("total > 0").drop("total")
    return lines.join(long, beam, "left_semi")


def measures(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, length and length-weighted centroid (cx, cy) of each line."""
    middle = lambda a, b: F.sum(F.col("len") * (F.col(a) + F.col(b)) / 2) / F.nullif(F.sum("len"), F.lit(0.0))
    return lines.groupBy(*keys).agg(F.sum("len").alias("length"), middle("x0", "x1").alias("cx"), middle("y0", "y1").alias("cy"))


def at_length(lines: DataFrame, keys: list[str], places: DataFrame) -> DataFrame:
    """keys and columns of ``places`` (keys, at: a length along the line, clamped to its ends), with the point (px, py).

    Places and segments meet by stretches of the line as long as its segments
    are on average, so a place is not held against the whole line.
    """
    ends = lines.groupBy(*keys).agg(F.sum("len").alias("__total"), F.max("seg").alias("__last"), F.avg("len").alias("__step"))
    stretch = lambda at: F.coalesce(F.floor(at / F.nullif(F.col("__step"), F.lit(0.0))), F.lit(0)).cast("long")
    asked = places.join(ends, keys).withColumn("__at", F.greatest(F.least("at", "__total"), F.lit(0.0)))
    asked = asked.withColumn("__stretch", stretch(F.col("__at"))).drop("__total", "__step")
    end = F.col("cum") + F.col("len")
    end = F.when(F.col("seg") == F.col("__last"), F.greatest(end, F.col("__total"))).otherwise(end)
    spread = lines.select(*keys, "seg", "x0", "y0", "x1", "y1", "len", "cum").join(ends, keys)
    spread = spread.withColumn("__stretch", F.explode(F.sequence(stretch(F.col("cum")), stretch(end)))).drop("__total", "__step", "__last")
    held = asked.join(spread, [*keys, "__stretch"]).where((F.col("__at") >= F.col("cum")) & ((F.col("__at") < F.col("cum") + F.col("len")) | (F.col("seg") == F.col("__last"))))
    share = F.coalesce((F.col("__at") - F.col("cum")) / F.nullif(F.col("len"), F.lit(0.0)), F.lit(0.0))
    px, py = F.col("x0") + share * (F.col("x1") - F.col("x0")), F.col("y0") + share * (F.col("y1") - F.col("y0"))
    return held.select(*places.columns, px.alias("px"), py.alias("py"))


def family_centers(points: DataFrame) -> DataFrame:
    """gt_family, x, y: the mean of the family's distinct points."""
    family = scoped(points, "gt_family")
    return points.select(*family, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct().groupBy(*family).agg(F.avg("x").alias("center_x"), F.avg("y").alias("center_y"))


def nearest_lines(lines: DataFrame, centers: DataFrame) -> DataFrame:
    """gt_family, nearest_beam and its distance: the line whose centroid is nearest to the family's center (then by beam)."""
    family = scoped(lines, "gt_family")
    away = measures(lines, [*family, "beam_id"]).join(centers, family).withColumn("d", F.hypot(F.col("cx") - F.col("center_x"), F.col("cy") - F.col("center_y")))
    return away.groupBy(*family).agg(F.min(F.struct("d", "beam_id")).alias("best")).select(*family, F.col("best.beam_id").alias("nearest_beam"), F.col("best.d").alias("center_dist"))


def shore_crossings(lines: DataFrame, keys: list[str], shore: DataFrame, width: float = 500.0) -> DataFrame:
    """keys, x, y, run: distinct points where lines meet the shore's segments, and middles of what they share where they run
    along each other, ``run`` metres long; candidates share a cell."""
    spread = lambda t: t.withColumn("c", F.explode(along(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), width, 0.0)))
    a = spread(lines.select(*keys, "x0", "y0", "x1", "y1"))
    b = spread(shore.select("x0", "y0", "x1", "y1")).select(*[F.col(c).alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")], F.col("c").alias("sc"))
    met = a.join(b, a["c"] == b["sc"])
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1", "sx0", "sy0", "sx1", "sy1")]
    at = crossing_at(*ends)
    at = F.when(at.isNotNull(), F.struct(at.x.alias("x"), at.y.alias("y"), F.lit(0.0).alias("run"))).otherwise(overlap_at(*ends))
    return met.select(*keys, at.alias("p")).where("p IS NOT NULL").select(*keys, "p.x", "p.y", "p.run").distinct()


def boxes(points: DataFrame, shore: DataFrame, half_along: float, half_across: float) -> DataFrame:
    """One oriented box for each family whose nearest beam crosses the shore: center, crossing, beam and unit tangent.

    The crossing is the one nearest to the family's center or, where the beam
    runs along the shore, the middle of that run; the tangent runs from 0.4 to
    0.6 of the nearest beam's length.
    """
    family = scoped(points, "gt_family")
    lines, centers = staged(beam_lines(points)), staged(family_centers(points))
    near = staged(nearest_lines(lines, centers))
    chosen = staged(lines.join(near.select(*family, F.col("nearest_beam").alias("beam_id")), [*family, "beam_id"], "left_semi"))
    away = F.hypot(F.col("x") - F.col("center_x"), F.col("y") - F.col("center_y"))
    met = shore_crossings(chosen, family, shore).join(centers, family)
    middle = lambda c: F.sum(F.col(c) * F.col("run")) / F.nullif(F.sum("run"), F.lit(0.0))
    cross = met.groupBy(*family).agg(F.min(F.struct(away.alias("d"), "x", "y")).alias("c"), middle("x").alias("mx"), middle("y").alias("my"))
    cross = cross.select(*family, F.coalesce("mx", "c.x").alias("cross_x"), F.coalesce("my", "c.y").alias("cross_y"))
    total = measures(chosen, family).select(*family, F.explode(F.array(F.lit(0.4), F.lit(0.6))).alias("share"), "length").withColumn("at", F.col("share") * F.col("length"))
    ends = at_length(chosen, family, total).groupBy(*family).agg(F.min_by(F.struct("px", "py"), "share").alias("a"), F.max_by(F.struct("px", "py"), "share").alias("b"))
    vx, vy = F.col("b.px") - F.col("a.px"), F.col("b.py") - F.col("a.py")
    unit = ends.withColumn("norm", F.hypot(vx, vy)).where("norm > 0").select(*family, (vx / F.col("norm")).alias("tx"), (vy / F.col("norm")).alias("ty"))
    return centers.join(near, family).join(cross, family).join(unit, family).select(
        *family, "center_x", "center_y", "cross_x", "cross_y", "nearest_beam", "tx", "ty", F.lit(float(half_along)).alias("half_along"), F.lit(float(half_across)).alias("half_across")
    )


def in_box(x: Column, y: Column) -> Column:
    """Whether a point lies in the closed box of its row."""
    dx, dy = x - F.col("cross_x"), y - F.col("cross_y")
    return (F.abs(dx * F.col("tx") + dy * F.col("ty")) <= F.col("half_along")) & (F.abs(-dx * F.col("ty") + dy * F.col("tx")) <= F.col("half_across"))


def clip(points: DataFrame, box: DataFrame) -> DataFrame:
    """Points in the box of their family, with ``radial_dist_m`` from its crossing."""
    family = scoped(points, "gt_family")
    held = points.join(box.select(*family, "cross_x", "cross_y", "tx", "ty", "half_along", "half_across"), family).where(in_box(F.col("x"), F.col("y")))
    return held.withColumn("radial_dist_m", F.hypot(F.col("x") - F.col("cross_x"), F.col("y") - F.col("cross_y"))).select(*points.columns, "radial_dist_m")


def beam_spacing(lines: DataFrame) -> DataFrame:
    """n_beams, max_dist, avg_dist, west_beam and east_beam of families with two or more beams, by their lines' middles."""
    family = scoped(lines, "gt_family")
    beam = [*family, "beam_id"]
    middles = at_length(lines, beam, measures(lines, beam).select(*beam, (F.col("length") / 2).alias("at")))
    run = Window.partitionBy(*family).orderBy("px", "beam_id")
    gaps = middles.withColumn("gap", F.col("px") - F.lag("px").over(run))
    each = gaps.groupBy(*family).agg(
        F.count(F.lit(1)).alias("n_beams"), (F.max("px") - F.min("px")).alias("max_dist"), F.avg("gap").alias("avg_dist"),
        F.min(F.struct("px", "beam_id"))["beam_id"].alias("west_beam"), F.max(F.struct("px", "beam_id"))["beam_id"].alias("east_beam"),
    )
    return each.where("n_beams >= 2")
