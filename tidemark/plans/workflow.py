"""The workflow for one setup or a whole grid of setups, of one track or many, in one run.

Boxes and tracks do not depend on the setup, clusters depend on the size
only, biases not on the tolerance: each is computed once, staged, and used by
all that needs it; tracks, sizes and tolerances are columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import track_normalised
from tidemark.operators import bias, change, clusters, planar
from tidemark.operators.keys import scoped
from tidemark.params import BIAS_TOLERANCES, CLUSTER_SIZES, Params
from tidemark.plans.merge import missing_setups, upsert
from tidemark.sources.cache import SetupCache
from tidemark.sources.staging import staged

CLUSTER = ["track_id", "cluster_distance_m", "gt_family", "cluster_id"]
SETUP = [*CLUSTER, "bias_tolerance"]


@dataclass
class Workflow:
    boxes: DataFrame
    clusters: DataFrame
    selected: DataFrame
    selection_summary: DataFrame
    bias: DataFrame
    bias_summary: DataFrame
    accepted: DataFrame
    bluffs: DataFrame
    statistics: DataFrame


def run(points: DataFrame, shore: DataFrame, track_id: str | None = None, params: Params | None = None, sizes: tuple[float, ...] | None = None, tolerances: tuple[float, ...] | None = None, which: str = "first", cache: SetupCache | None = None) -> Workflow:
    """``points``: gated points with gt_family, beam_id, acq_date, distance_from_offshore, h_li, x, y and, unless all are of
    ``track_id``, the track of each in a column of that name; ``shore``: its segments, all tracks' together.

    With a ``cache``, boxes and tracks, clusters with their angles (for each
    size) and biases (for each size) are kept across runs: one more size adds
    that size's, one more tolerance adds nothing before the choice of passes.
    """
    p = params or Params()
    sizes, tolerances = sizes or (p.cluster_distance_m,), tolerances or (p.bias_tolerance,)
    track = F.lit(str(track_id)) if track_id is not None else F.col("track_id").cast("string")
    points, shore = staged(points.where(F.col("gt_family").isin(*p.gtx)).withColumn("track_id", track_normalised(track))), staged(shore)
    own, base = cache.of(points, shore) if cache else None, {"half": [p.half_along_m, p.half_across_m], "families": p.gtx}

    def step(name: str, made_with: dict, make) -> DataFrame:
        return own.table(name, base | made_with, make) if own else staged(make())

    def by_size(name: str, made_with: dict, make) -> DataFrame:
        """One table of all sizes; in a cache one for each."""
        if not own:
            return staged(make(list(sizes)))
        return reduce(DataFrame.unionByName, [step(name, made_with | {"size": float(s)}, lambda s=s: make([s])) for s in sizes])

    box = step("boxes", {}, lambda: planar.boxes(points, shore, p.half_along_m, p.half_across_m))
    clipped = step("clipped", {}, lambda: planar.clip(points, box))
    lines = step("lines", {}, lambda: planar.beam_lines(clipped))
    chosen = {"min_beams": p.min_beams, "plane": p.utm_epsg}
    candidates = by_size("candidates", chosen, lambda some: clusters.candidates(clipped, lines, some, p.min_beams, p.gtx, p.utm_epsg))
    of = lambda some: candidates.where(F.col("cluster_distance_m").isin([float(s) for s in some]))
    found = by_size("angles", chosen | {"radius": p.angle_search_radius}, lambda some: clusters.angles(of(some), lines, shore, params=p))
    marked, summary = clusters.select(found, p.min_beams, ["track_id", "cluster_distance_m", "gt_family"])
    selected = staged(marked.where("selected").drop("selected"))
    inside = by_size("inside", chosen, lambda some: bias.profiles_in(selected.where(F.col("cluster_distance_m").isin([float(s) for s in some])), points, CLUSTER, lines))
    inside_of = lambda some: inside.where(F.col("cluster_distance_m").isin([float(s) for s in some]))
    judged = by_size("biases", chosen | {"x0": p.bias_x0}, lambda some: bias.evaluate(inside_of(some), CLUSTER, params=p))
    biases = staged(bias.keep(judged, list(tolerances)))
    cycle = [*CLUSTER, "reference_beam", "beam_id", "acq_date"]
    accepted = staged(inside.join(biases.where("keep").select(*cycle, "bias_tolerance", "bias"), cycle))
    edges = staged(bias.bluffs(accepted, SETUP, which, p))
    return Workflow(box, found, selected, summary, biases, bias.summary(biases, selected, CLUSTER), accepted, edges, change.statistics(edges, SETUP, p))


def metrics(flow: Workflow, quality_summary: DataFrame | None = None) -> DataFrame:
    """The result table: one line per setup and cluster, with its geometry and how many passes were used."""
    family = ["track_id", "cluster_distance_m", "bias_tolerance", "gt_family"]
    used = flow.accepted.select(*family, "beam_id").distinct()
    overall = used.groupBy(*family).agg(F.count(F.lit(1)).alias("used_cycles"))
    # Beams of a cluster that were accepted anywhere in the family count, in whichever cluster that was.
    listed = flow.selected.select(*CLUSTER, F.explode(F.transform("beam_ids", lambda b: b["beam_id"])).alias("beam_id")).distinct()
    own = listed.join(used, ["track_id", "cluster_distance_m", "gt_family", "beam_id"]).groupBy(*SETUP).agg(F.count(F.lit(1)).alias("used_cycles_cluster"))
    place = flow.selected.select(*CLUSTER, "angle_deg", "center_lat", "center_lon")
    rows = flow.statistics.join(place, CLUSTER, "left").join(overall, family, "left").join(own, SETUP, "left")
    if quality_summary is not None:
        own = scoped(quality_summary, "gt_family")
        rows = rows.join(quality_summary.select(*own, F.col("loaded").alias("initial_cycles")), own, "left")
    else:
        rows = rows.withColumn("initial_cycles", F.lit(None).cast("long"))
    return rows.select(
        "track_id", F.col("cluster_distance_m").cast("int").alias("ClusterSize"), "bias_tolerance", "gt_family", "cluster_id", *change.METRICS, "TemporalSpan_days",
        (F.col("TemporalSpan_days") / F.lit(365.25)).alias("ClusterTemporalSpanYears"), "ValidRegression", "angle_deg", "center_lat", "center_lon", "first_date", "last_date",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("initial_cycles", "used_cycles", "used_cycles_cluster")],
    )


def sweep(
    points: DataFrame, shore: DataFrame, track_id: str | None = None, quality_summary: DataFrame | None = None, params: Params | None = None, existing: DataFrame | None = None,
    sizes: tuple[float, ...] = CLUSTER_SIZES, tolerances: tuple[float, ...] = BIAS_TOLERANCES, cache: SetupCache | None = None,
) -> DataFrame:
    """The result table of the full grid, in one run.

    ``existing``: results of earlier runs.  Setups of a track that it holds any
    row of are not run again; the result has its rows and the fresh ones.
    Setups that gave no rows are run again.
    """
    if existing is None:
        return metrics(run(points, shore, track_id, params, sizes, tolerances, cache=cache), quality_summary)
    setup = ["track_id", "ClusterSize", "bias_tolerance"]
    track = F.lit(str(track_id)) if track_id is not None else F.col("track_id").cast("string")
    points = points.withColumn("track_id", track_normalised(track))
    grid = points.select("track_id").distinct().withColumns({"ClusterSize": F.explode(F.array(*[F.lit(int(s)) for s in sizes]))}).withColumn("bias_tolerance", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])))
    left = staged(missing_setups(grid, existing, setup))
    todo = left.select("ClusterSize", "bias_tolerance").distinct().collect()  # of one grid
    if not todo:
        return existing
    points = points.join(left.select("track_id").distinct(), "track_id", "left_semi")
    flow = run(points, shore, None, params, tuple(sorted({float(r.ClusterSize) for r in todo})), tuple(sorted({r.bias_tolerance for r in todo})), cache=cache)
    return upsert(existing, metrics(flow, quality_summary).join(left, setup, "left_semi"))
