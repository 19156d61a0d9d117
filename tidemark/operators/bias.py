"""Vertical bias against a reference pass, and edge positions, for all clusters at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keys import TRACK
from tidemark.operators.profiles import at_distance, crossings
from tidemark.operators.spatial import point_segment
from tidemark.params import Params, pick


def members(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reference_beam, beam_id: one line per beam of a cluster, whatever family it was listed under."""
    return clusters.select(*keys, F.trim("beam_id").alias("reference_beam"), F.explode(F.transform("beam_ids", lambda b: F.trim(b["beam_id"]))).alias("beam_id")).distinct()


def profiles_in(clusters: DataFrame, profiles: DataFrame, keys: list[str], lines: DataFrame | None = None) -> DataFrame:
    """Points of the member beams of a cluster's family; with ``lines``, those within half the cluster's size of its seed."""
    track = [TRACK] if TRACK in keys else []
    held = members(clusters, keys).join(profiles, [*track, "gt_family", "beam_id"])
    if lines is None:
        return held
    seed = lines.select(*track, "gt_family", F.col("beam_id").alias("reference_beam"), "x0", "y0", "x1", "y1")
    near = held.select(*keys, "reference_beam", "beam_id", "x", "y").distinct().join(seed, [*track, "gt_family", "reference_beam"])
    away = F.min(point_segment(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    near = near.groupBy(*keys, "reference_beam", "beam_id", "x", "y").agg(away.alias("away")).where(F.col("away") <= F.col("cluster_distance_m") / 2).drop("away")
    return held.join(near, [*keys, "reference_beam", "beam_id", "x", "y"], "left_semi")


def report(clusters: DataFrame, profiles: DataFrame, keys: list[str], x0: float | None = None, params: Params | None = None, include_reference: bool = True) -> DataFrame:
    """keys, reference_beam, beam_id, acq_date, bias: each member's height at ``x0`` less the seed's, all dates pooled."""
    at = float(pick(x0, params, "bias_x0"))
    family = [*([TRACK] if TRACK in keys else []), "gt_family"]
    beam = [*family, "beam_id"]
    beams = profiles.select(*beam).distinct()
    values = at_distance(profiles, beam, at).join(profiles.groupBy(*beam).agg(F.min("acq_date").alias("acq_date")), beam)
    seeds = values.select(*family, F.col("beam_id").alias("reference_beam"), F.col("value").alias("y_ref")).where("y_ref IS NOT NULL")
    rows = members(clusters, keys).join(beams, beam, "left_semi").join(seeds, [*family, "reference_beam"]).join(values, beam, "left")
    own = F.col("beam_id") == F.col("reference_beam")
    rows = rows.select(*keys, "reference_beam", "beam_id", "acq_date", F.when(own, F.lit(0.0)).otherwise(F.col("value") - F.col("y_ref")).alias("bias"))
    return rows if include_reference else rows.where(~(F.col("beam_id") == F.col("reference_beam")))


def passes(profiles: DataFrame, x0: float | None = None, params: Params | None = None) -> DataFrame:
    """One line per pass: its keys, ``value`` (height at ``x0``) and ``half`` (middle of its heights).

    Clusters without a clip take whole passes.  All that is judged of a pass is
    found here once, so its points need not be copied into every cluster.
    """
    cycle = [*([TRACK] if TRACK in profiles.columns else []), "gt_family", "beam_id", "acq_date"]
    each = at_distance(profiles, cycle, float(pick(x0, params, "bias_x0")), every=True, ends=True)
    return each.select(*cycle, "value", ((F.col("low") + F.col("high")) / 2).alias("half"))


def evaluate(points: DataFrame, keys: list[str], x0: float | None = None, params: Params | None = None) -> DataFrame:
    """Biases of ``points`` of clusters: keys, reference_beam, beam_id, acq_date, bias, is_ref.

    The height to compare with is that of the seed on its most recent date on
    which it can be interpolated; clusters without one are absent.  Every date
    of the seed has bias 0.
    """
    cycle = [*keys, "reference_beam", "beam_id", "acq_date"]
    dated = points.where("acq_date IS NOT NULL")
    return judged(at_distance(dated, cycle, float(pick(x0, params, "bias_x0")), every=True), keys)


def judged(values: DataFrame, keys: list[str]) -> DataFrame:
    """``evaluate`` for passes of clusters whose ``value`` is known: keys, reference_beam, beam_id, acq_date, value."""
    cycle = [*keys, "reference_beam", "beam_id", "acq_date"]
    is_ref = F.col("beam_id") == F.col("reference_beam")
    seed = F.when(is_ref & F.col("value").isNotNull(), F.col("acq_date"))
    cluster = Window.partitionBy(*keys, "reference_beam")  # one line a pass, whatever the number of points
    rows = values.where("acq_date IS NOT NULL").withColumn("y_ref", F.max_by("value", seed).over(cluster)).where("y_ref IS NOT NULL")
    return rows.select(*cycle, F.when(is_ref, F.lit(0.0)).otherwise(F.col("value") - F.col("y_ref")).alias("bias"), is_ref.alias("is_ref"))


def keep(biases: DataFrame, tolerances: list[float]) -> DataFrame:
    """``biases`` once for each tolerance, with ``keep``: the seed's dates, and those within the tolerance (closed)."""
    grid = biases.withColumn("bias_tolerance", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])))
    return grid.withColumn("keep", F.col("is_ref") | F.coalesce(F.abs("bias") <= F.col("bias_tolerance"), F.lit(False)))


def summary(kept: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """One line per cluster that has other dates than its seed's: counts, and extremes of all and of kept biases."""
    setup = [*keys, "bias_tolerance"] if "bias_tolerance" in kept.columns else keys
    other, own = ~F.col("is_ref"), F.col("keep") & ~F.col("is_ref")
    when = lambda c, v: F.when(c, F.col(v))
    each = kept.groupBy(*setup, "reference_beam").agg(
        F.count_distinct(when(other, "beam_id")).alias("n_beams"), F.count_if(own).alias("n_kept_nonref"),
        *[f(when(other, "bias")).alias(f"bias_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev))],
        *[f(when(own, "bias")).alias(f"kept_bias_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev))],
        F.count_if("keep").alias("n_kept"),
    )
    sizes = clusters.select(*keys, F.trim("beam_id").alias("reference_beam"), F.size("beam_ids").alias("n_beams_total"))
    return each.where("n_beams > 0").join(sizes, [*keys, "reference_beam"], "left")


def allowed(points: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` of the passes that ``kept`` (keys, beam_id, acq_date, keep) allows, and all of clusters for which it allows none.

    A cluster whose list is empty has not been judged, so nothing of it is taken away.
    """
    listed = kept.where("keep").select(*keys, "beam_id", "acq_date").distinct()
    marked = points.join(listed.withColumn("__listed", F.lit(True)), [*keys, "beam_id", "acq_date"], "left")
    marked = marked.join(listed.select(*keys).distinct().withColumn("__judged", F.lit(True)), keys, "left")
    return marked.where("__listed OR __judged IS NULL").select(*points.columns)


def accepted_view(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted points of clusters with what is drawn of them: whether their pass is the seed's, and where it crosses."""
    marked = points.withColumn("is_ref", F.col("beam_id") == F.col("reference_beam"))
    return marked.join(edges.select(*keys, "beam_id", "acq_date", "bluff_x", "bluff_y"), [*keys, "beam_id", "acq_date"], "left")


def bluffs(points: DataFrame, keys: list[str], which: str = "first", params: Params | None = None) -> DataFrame:
    """keys, beam_id, acq_date, bluff_x, bluff_y, ref_line: where accepted profiles meet half the height of the oldest one.

    ``points``: accepted points of clusters, with reference_beam; of several
    oldest passes the seed's is taken first, then by beam.
    """
    each = points.groupBy(*keys, "reference_beam", "beam_id", "acq_date").agg(((F.min("h_li") + F.max("h_li")) / 2).alias("half"))
    return crossed(points.join(levels(each, keys), keys), keys, which, params)


def levels(passes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ref_line: the ``half`` of the oldest of a cluster's ``passes`` (keys, reference_beam, beam_id, acq_date, half)."""
    rank = F.struct("acq_date", (F.col("beam_id") != F.col("reference_beam")).alias("other"), "beam_id")
    half = F.struct(F.when(F.col("acq_date").isNotNull(), F.col("half")).alias("half"))  # in a struct, since a null is the oldest pass's too
    return passes.groupBy(*keys).agg(F.min_by(half, rank)["half"].alias("ref_line")).where("ref_line IS NOT NULL")


def crossed(points: DataFrame, keys: list[str], which: str = "first", params: Params | None = None) -> DataFrame:
    """Where the passes of ``points`` of clusters meet their ``ref_line``: columns as of ``bluffs``."""
    found = crossings(points, [*keys, "beam_id", "acq_date"], F.col("ref_line"), which, params)
    return found.where("bluff_x IS NOT NULL").select(*keys, "beam_id", "acq_date", "bluff_x", "bluff_y", F.col("bluff_y").alias("ref_line"))
