"""Clusters of neighbouring ground tracks, their angle to the shore, and their selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import crs
from tidemark.functions.geodesy import acute_angle
from tidemark.functions.numeric import rounded
from tidemark.operators.keys import numbered, scoped
from tidemark.operators.outlines import axis, corridors, ring, vertices
from tidemark.operators.planar import at_length
from tidemark.operators.spatial import directed, filed, meeting, nearest_segments, point_segment, squared_gaps
from tidemark.params import Params, pick
from tidemark.sources.staging import staged


def pair_distances(lines: DataFrame, reach: float) -> DataFrame:
    """(family, beam, other family, other beam, distance) of lines within ``reach``, each with itself at 0.

    Segments, in pieces of at most two cells, are filed under the cells of their
    boxes, widened by the reach on one side only.  Two pieces may share several
    cells; they are measured in the one that holds the lower corner of what
    their boxes share, and only one of two lines looks for the other.  The
    arithmetic goes step by step, each step once for a pair and small enough to
    be compiled.
    """
    reach = float(reach)
    width, beam = max(2 * reach, 25.0), scoped(lines, "gt_family", "beam_id")
    track = beam[:-2]
    own = directed(lines).select(*beam, "x0", "y0", "x1", "y1", "dx", "dy", "size")
    met = meeting(filed(own, width, reach), filed(own, width, 0.0), [*track, "cx", "cy"], width)
    met = met.where((F.col("gt_family") < F.col("ogt_family")) | ((F.col("gt_family") == F.col("ogt_family")) & (F.col("beam_id") < F.col("obeam_id"))))
    both = [*beam, "ogt_family", "obeam_id"]
    near = squared_gaps(met, both).groupBy(*both).agg(F.sqrt(F.min("gap")).alias("dist")).where(F.col("dist") <= reach)
    way = lambda f, b, of, ob: F.struct(F.col(f).alias("gt_family"), F.col(b).alias("beam_id"), F.col(of).alias("other_family"), F.col(ob).alias("other_beam"))
    ways = F.array(way("gt_family", "beam_id", "ogt_family", "obeam_id"), way("ogt_family", "obeam_id", "gt_family", "beam_id"))
    near = near.select(*track, F.explode(ways).alias("w"), "dist").select(*track, "w.*", "dist")
    alone = lines.select(*beam).distinct()
    return near.unionByName(alone.withColumns({"other_family": F.col("gt_family"), "other_beam": F.col("beam_id"), "dist": F.lit(0.0)}))


def candidates(points: DataFrame, lines: DataFrame, sizes: list[float], min_beams: int, families: tuple[str, ...], plane: int | str = Params.utm_epsg, centers: bool = True) -> DataFrame:
    """One candidate for each size and seed beam: the beams (of any family) whose line comes within half the size of it.

    A candidate's center is the centroid of its corridor, of half the size on
    either side of the seed's line, in ``plane`` and in degrees; without
    ``centers`` the four columns are left out, and nothing is drawn.  Ids number the seeds by family (in the order given) and beam, before small
    candidates are left out, so they have gaps.
    """
    beam = scoped(lines, "gt_family", "beam_id")
    order = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("gt_family"))
    counts = points.groupBy(*beam).agg(F.count(F.lit(1)).cast("int").alias("num_points"))
    seeds = lines.select(*beam).distinct().join(counts, beam).where(order > 0)
    seeds = numbered(seeds, [order, F.col("beam_id")], "cluster_id")
    near = pair_distances(lines, max(sizes) / 2)
    grid = F.explode(F.array(*[F.lit(float(s)) for s in sizes])).alias("cluster_distance_m")
    member = F.struct(F.col("other_family").alias("gt_family"), F.col("other_beam").alias("beam_id"))
    groups = near.select("*", grid).where(F.col("dist") <= F.col("cluster_distance_m") / 2).groupBy("cluster_distance_m", *beam).agg(F.array_sort(F.collect_list(member)).alias("beam_ids"))
    full = groups.withColumn("num_beams", F.size("beam_ids")).where(F.col("num_beams") >= min_beams).join(seeds, beam)
    columns = [*beam, "num_points", "cluster_distance_m", "cluster_id", "beam_ids", "num_beams"]
    if not centers:
        return full.select(*columns)
    middle = staged(corridors(lines, beam, [s / 2 for s in sizes])).select(*beam, (F.col("radius") * 2).alias("cluster_distance_m"), F.col("cx").alias("center_x"), F.col("cy").alias("center_y"))
    full = full.join(middle, [*beam, "cluster_distance_m"]).withColumn("center", crs.inverse(crs.parse(plane), F.col("center_x"), F.col("center_y")))
    return full.select(*columns, "center_x", "center_y", F.col("center.lon").alias("center_lon"), F.col("center.lat").alias("center_lat"))


def family_track(clusters: DataFrame) -> DataFrame:
    """gt_family, track_id: the track that most of a family's clusters name, the smallest on ties."""
    return clusters.where("track_id IS NOT NULL").groupBy("gt_family").agg(F.mode("track_id", True).alias("track_id"))


def angles(clusters: DataFrame, lines: DataFrame, shore: DataFrame, search_radius: float | None = None, params: Params | None = None) -> DataFrame:
    """``clusters`` with ``angle_deg``: between the principal axis of the cluster's corridor and the shore's run near the seed.

    ``shore``: segments (part, seg, x0, y0, x1, y1, len, cum) of which every
    seed finds the nearest; the run is measured between the points ``search_radius``
    before and after along that part, clamped to its ends.
    """
    radius = float(pick(search_radius, params, "angle_search_radius"))
    key = scoped(clusters, "gt_family", "beam_id")
    sized = [*key, "cluster_distance_m"]
    drawn = vertices(lines, key).join(clusters.select(*sized).distinct(), key).select(*sized, ring(F.col("line"), F.col("cluster_distance_m") / 2).alias("ring"))
    axes = staged(drawn.select(*sized, axis(F.col("ring")).alias("a"))).select(*sized, F.col("a.dx").alias("ax"), F.col("a.dy").alias("ay"))
    own = clusters.select(*key).distinct()
    best = nearest_segments(lines.join(own, key, "left_semi"), key, shore, ["part", "seg", "len", "cum"])
    best = best.withColumns({"part": F.col("spart"), "sseg": F.col("sseg")})
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1", "sx0", "sy0", "sx1", "sy1")]
    place_on = lambda px, py: F.greatest(F.least(((px - F.col("sx0")) * (F.col("sx1") - F.col("sx0")) + (py - F.col("sy0")) * (F.col("sy1") - F.col("sy0"))) / F.nullif(F.col("slen"), F.lit(0.0)), F.col("slen")), F.lit(0.0))
    t = F.coalesce(((F.col("sx0") - F.col("x0")) * (F.col("y1") - F.col("y0")) - (F.col("sy0") - F.col("y0")) * (F.col("x1") - F.col("x0"))) / F.nullif((F.col("y0") - F.col("y1")) * (F.col("sx1") - F.col("sx0")) - (F.col("x0") - F.col("x1")) * (F.col("sy1") - F.col("sy0")), F.lit(0.0)), F.lit(0.0))
    # Where the two segments cross, there; else from whichever end of either is nearest to the other.
    tries = F.array(
        F.struct(point_segment(F.col("x0"), F.col("y0"), *ends[4:]).alias("d"), place_on(F.col("x0"), F.col("y0")).alias("at")),
        F.struct(point_segment(F.col("x1"), F.col("y1"), *ends[4:]).alias("d"), place_on(F.col("x1"), F.col("y1")).alias("at")),
        F.struct(point_segment(F.col("sx0"), F.col("sy0"), *ends[:4]).alias("d"), F.lit(0.0).alias("at")),
        F.struct(point_segment(F.col("sx1"), F.col("sy1"), *ends[:4]).alias("d"), F.col("slen").alias("at")),
    )
    where = F.when(F.col("d") == 0, F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0)) * F.col("slen")).otherwise(F.array_min(tries)["at"])
    place = best.select(*key, "part", (F.col("scum") + where).alias("on"))
    asked = place.select(*key, "part", F.explode(F.array(F.lit(-radius), F.lit(radius))).alias("side"), "on").withColumn("at", F.col("on") + F.col("side"))
    run = at_length(shore, ["part"], asked).groupBy(*key).agg(F.min_by(F.struct("px", "py"), "side").alias("a"), F.max_by(F.struct("px", "py"), "side").alias("b"))
    run = run.select(*key, (F.col("b.px") - F.col("a.px")).alias("bx"), (F.col("b.py") - F.col("a.py")).alias("by"))
    angle = rounded(acute_angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 2)
    return clusters.join(axes.join(run, key).select(*sized, angle.alias("angle_deg")), sized, "left")


def select(clusters: DataFrame, min_beams: int, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters with ``selected``, summary): in each group, by falling number of beams, a cluster is
    selected if it has a beam that none before it has.  Ties go by id; small clusters are not eligible.

    The first cluster in that order that holds a beam is always selected, and
    the beam is covered from then on, so the selected ones are those that come
    first for one of their beams: an aggregation by beam.
    """
    groups = groups or scoped(clusters, "gt_family")
    core = clusters.where(F.col("num_beams") >= min_beams)
    rank = F.struct((-F.col("num_beams")).alias("rank"), "cluster_id")
    firsts = core.select(*groups, rank.alias("r"), F.explode("beam_ids").alias("beam")).groupBy(*groups, "beam").agg(F.min("r").alias("r"))
    chosen = firsts.select(*groups, "r.rank", "r.cluster_id").distinct()
    marked = core.join(chosen.select(*groups, "cluster_id", F.lit(True).alias("selected")), [*groups, "cluster_id"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    totals = clusters.groupBy(*groups).agg(F.count(F.lit(1)).alias("total_clusters"), F.count_if(F.col("num_beams") < min_beams).alias("too_few_beams"))
    each = chosen.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min_by("cluster_id", F.struct("rank", "cluster_id")).alias("first"))
    selected = F.coalesce("n", F.lit(0))
    report = totals.join(each, groups, "left").select(
        *groups, "total_clusters", selected.alias("selected_clusters"), (F.col("total_clusters") - F.col("too_few_beams") - selected).alias("skipped_clusters"), "too_few_beams",
        F.col("first").alias("representative_cluster_id"),
    )
    return marked.select(*clusters.columns, "selected"), report
