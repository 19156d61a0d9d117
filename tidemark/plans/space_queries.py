"""Queries on planes: tracks, shores, boxes, clusters, gates, clips; and the whole workflow."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded
from tidemark.operators import aoi, clusters, outlines, planar, prep, profiles, quality, spatial
from tidemark.params import Params
from tidemark.plans import workflow
from tidemark.plans.stand_ins import CLOUDS, LINES, SHORE, TRACKS, clouds, r6, shore, tracks
from tidemark.sources.staging import scope, staged
from tidemark.sources.tables import parquet

BEAM = ["gt_family", "beam_id"]


def _tidy(table):
    return table.withColumns({c: rounded(F.col(c)) for c, t in table.dtypes if t == "double"})


def _flags(spark, sf):
    return quality.beam_flags(clouds(spark, sf), Params(elev_trash=17.0, too_far_beam=40.0))


def quality_few(spark, sf):
    return _flags(spark, sf).select(*BEAM, "few_points")


def quality_trash(spark, sf):
    return _flags(spark, sf).select(*BEAM, "elev_trash")


def quality_too_far(spark, sf):
    return _tidy(_flags(spark, sf).select(*BEAM, "nearest_dist", "too_far"))


def knn1(spark, sf):
    middles = clouds(spark, sf).groupBy(*BEAM).agg(F.median("x").alias("x"), F.median("y").alias("y"))
    return _tidy(spatial.nearest_other(middles, "gt_family", "beam_id"))


def quality_status(spark, sf):
    return _flags(spark, sf).select(*BEAM, "status")


def quality_pivot(spark, sf):
    return quality.summary(_flags(spark, sf), Params())


def family_center(spark, sf):
    return _tidy(planar.family_centers(clouds(spark, sf)))


def polyline_length(spark, sf):
    return _tidy(planar.measures(planar.beam_lines(tracks(spark, sf)), BEAM).select(*BEAM, "length"))


def polyline_centroid(spark, sf):
    return _tidy(planar.measures(planar.beam_lines(tracks(spark, sf)), BEAM).select(*BEAM, "cx", "cy"))


def nearest_line(spark, sf):
    points = tracks(spark, sf)
    return _tidy(planar.nearest_lines(planar.beam_lines(points), planar.family_centers(points)))


def line_cross_shore(spark, sf):
    return _tidy(planar.shore_crossings(planar.beam_lines(tracks(spark, sf)), BEAM, shore(spark, sf), 100.0).drop("run"))


def boxes(spark, sf):
    return _tidy(planar.boxes(staged(tracks(spark, sf)), shore(spark, sf), 300.0, 300.0))


def _clipped(spark, sf):
    points = staged(tracks(spark, sf))
    return planar.clip(points, planar.boxes(points, shore(spark, sf), 300.0, 300.0))


def box_clip(spark, sf):
    return _tidy(_clipped(spark, sf).select(*BEAM, "x", "y"))


def box_radial(spark, sf):
    return _tidy(_clipped(spark, sf).select(*BEAM, "y", "radial_dist_m"))


def beam_spacing(spark, sf):
    return _tidy(planar.beam_spacing(planar.beam_lines(tracks(spark, sf))))


def neighbour_join(spark, sf):
    return _tidy(clusters.pair_distances(planar.beam_lines(tracks(spark, sf)), 21.0))


def _candidates(spark, sf, sizes=(18.0, 42.0), centers=False):
    points = staged(tracks(spark, sf))
    return staged(clusters.candidates(points, staged(planar.beam_lines(points)), list(sizes), 2, ("gt1", "gt2", "gt3"), centers=centers))


def candidate_clusters(spark, sf):
    return _candidates(spark, sf).select("cluster_distance_m", *BEAM, "cluster_id", "num_points", "num_beams", F.array_join(F.transform("beam_ids", lambda b: b.beam_id), ",").alias("members"))


def greedy_select(spark, sf):
    marked, _ = clusters.select(_candidates(spark, sf), 2, ["cluster_distance_m", "gt_family"])
    return marked.select("cluster_distance_m", *BEAM, "cluster_id", "selected")


def greedy_summary(spark, sf):
    return clusters.select(_candidates(spark, sf), 3, ["cluster_distance_m", "gt_family"])[1]


def cluster_angle(spark, sf):
    points = staged(tracks(spark, sf))
    lines = staged(planar.beam_lines(points))
    found = staged(clusters.candidates(points, lines, [42.0], 2, ("gt1", "gt2", "gt3"), centers=False))
    return clusters.angles(found, lines, shore(spark, sf)).select(*BEAM, "cluster_id", "angle_deg")


def cluster_center(spark, sf):
    return _tidy(_candidates(spark, sf, centers=True).select("cluster_distance_m", *BEAM, "cluster_id", "center_x", "center_y"))


def corridor_outline(spark, sf):
    lines = staged(planar.beam_lines(tracks(spark, sf)))
    found = outlines.corridors(lines, BEAM, [9.0, 30.0])
    turned = F.degrees(F.atan2("ay", "ax"))
    return _tidy(found.select(*BEAM, "radius", "area", "cx", "cy", F.when(turned < 0, turned + 180).otherwise(turned).alias("axis_deg")))


def buffer_points(spark, sf):
    return _tidy(spatial.within_segments(tracks(spark, sf), shore(spark, sf), 25.0).select(*BEAM, "x", "y"))


def file_semijoin(spark, sf):
    marked = tracks(spark, sf).where("h_li > 0")
    return _tidy(prep.shore_files(marked, shore(spark, sf), "beam_id", 12.0).select(*BEAM, "x", "y"))


def corridor_select(spark, sf):
    points = tracks(spark, sf)
    axis = points.where("beam_id = '7'").select(F.col("y").alias("seq"), "x", "y")
    return _tidy(prep.corridor_files(points, axis, "beam_id").select(*BEAM, "x", "y"))


def display_range(spark, sf):
    return _tidy(prep.display_range(tracks(spark, sf), BEAM, -6.0, 6.0, 25).select(*BEAM, "y", "h_li"))


#: A ring in the plane of value and second of the day.
RING = [(5.0, 10_000.0), (60.0, 5_000.0), (80.0, 50_000.0), (40.0, 80_000.0), (30.0, 40_000.0), (5.0, 60_000.0)]


def photon_clip(spark, sf):
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    points = parquet(spark, sf, "events").select("event_id", "value", seconds.cast("double").alias("second"))
    return aoi.clip(points, aoi.normalised([RING], tolerance=0.0), "value", "second").select("event_id")


def padded_bounds(spark, sf):
    return _tidy(aoi.padded_bounds(tracks(spark, sf), 100.0))


def family_batches(spark, sf):
    return prep.batches(tracks(spark, sf).select("gt_family", F.col("beam_id").alias("track_id"), "y"))


GATE = Params(elev_trash=17.0, too_far_beam=40.0)


def gate_kept(spark, sf):
    """How many points of each beam pass the gate."""
    return quality.gate(clouds(spark, sf), GATE)[0].groupBy(*BEAM).agg(F.count(F.lit(1)).alias("n"))


def gate_flagged(spark, sf):
    """The isolated beams, with their distance."""
    return _tidy(quality.gate(clouds(spark, sf), GATE)[2])


def dated_tracks(spark, sf):
    """Tracks of supplier and year, with heights that cross 0 along the way, run through distance and gate."""
    line = parquet(spark, sf, "lineitem")
    day = F.make_date(F.year("l_shipdate"), F.lit(7), F.lit(1))
    points = line.groupBy("l_suppkey", day.alias("acq_date"), ((F.col("l_partkey") % 30) * 20.0).alias("y")).agg(F.avg("l_discount").alias("shift"), F.avg("l_quantity").alias("q"))
    late = F.year("acq_date") - 1995
    points = points.select(
        F.concat(F.lit("gt"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("gt_family"), F.concat(F.col("l_suppkey").cast("string"), F.lit("_"), F.year("acq_date").cast("string")).alias("beam_id"),
        "acq_date", (F.col("l_suppkey") * 7.0 + late * 1.5 + F.col("shift")).alias("x"), "y", ((F.col("y") - 300 - late * 2) / 60 + (F.col("q") - 25) / 100).alias("h_li"),
    )
    return staged(profiles.along_track(points, [*BEAM, "acq_date"]))


def quality_gate(spark, sf):
    kept, _, _ = quality.gate(dated_tracks(spark, sf), Params())
    return kept.groupBy(*BEAM).agg(F.count(F.lit(1)).alias("n"))


def workflow_single(spark, sf):
    """One setup, from tracks to the result table; the tables staged on the way are deleted."""
    with scope() as kept_table:
        kept, report, _ = quality.gate(dated_tracks(spark, sf), Params())
        return kept_table(_tidy(workflow.metrics(workflow.run(kept, shore(spark, sf), "129", Params(bias_x0=250.0)), report)))


def grid_sweep(spark, sf):
    """All 28 setups in one run."""
    with scope() as kept_table:
        kept, report, _ = quality.gate(dated_tracks(spark, sf), Params())
        return kept_table(_tidy(workflow.sweep(kept, shore(spark, sf), "129", report, Params(bias_x0=250.0))))


def _flags_sql(table: str, name: str) -> str:
    """The gate's flags of the points of a table."""
    return f"""{table},
    each AS (SELECT gt_family, beam_id, count(*) AS n, coalesce(bool_or(abs(h_li) > 17), false) AS elev_trash, median(x) AS x, median(y) AS y FROM {name} GROUP BY ALL),
    means AS (SELECT gt_family, avg(n) AS mean FROM each GROUP BY gt_family),
    near AS (SELECT a.gt_family, a.beam_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS nearest_dist FROM each a JOIN each b ON a.gt_family = b.gt_family AND a.beam_id <> b.beam_id GROUP BY ALL),
    flags AS (SELECT gt_family, beam_id, n / mean < 0.8 AS few_points, elev_trash, coalesce(nearest_dist > 40, false) AS too_far, nearest_dist,
                     CASE WHEN elev_trash THEN 'elev_trash' WHEN n / mean < 0.8 THEN 'few_points' WHEN nearest_dist > 40 THEN 'too_far' ELSE 'loaded' END AS status
              FROM each JOIN means USING (gt_family) LEFT JOIN near USING (gt_family, beam_id))"""


_FLAGS = _flags_sql(CLOUDS, "clouds")
#: Tracks of supplier and year, profiles of one point left out.
_DATED = """dated_points AS (SELECT 'gt' || CAST(l_suppkey % 3 + 1 AS VARCHAR) AS gt_family, CAST(l_suppkey AS VARCHAR) || '_' || CAST(year(l_shipdate) AS VARCHAR) AS beam_id, (l_partkey % 30) * 20.0::DOUBLE AS y,
        l_suppkey * 7.0::DOUBLE + (year(l_shipdate) - 1995) * 1.5::DOUBLE + avg(l_discount) AS x, ((l_partkey % 30) * 20.0::DOUBLE - 300 - (year(l_shipdate) - 1995) * 2) / 60 + (avg(l_quantity) - 25) / 100 AS h_li
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate), (l_partkey % 30) * 20.0::DOUBLE),
    dated AS (SELECT * FROM dated_points QUALIFY count(*) OVER (PARTITION BY gt_family, beam_id) >= 2)"""
_LINES = f"{TRACKS}, {LINES}"
_MEASURES = f"{_LINES}, measures AS (SELECT gt_family, beam_id, sum(len) AS length, sum(len * (x0 + x1) / 2) / sum(len) AS cx, sum(len * (y0 + y1) / 2) / sum(len) AS cy FROM lines GROUP BY ALL)"
_CENTERS = "centers AS (SELECT gt_family, avg(x) AS center_x, avg(y) AS center_y FROM (SELECT DISTINCT gt_family, x, y FROM tracks) GROUP BY gt_family)"
_NEAREST = f"""{_MEASURES}, {_CENTERS}, nearest AS (SELECT gt_family, min({{'d': sqrt((cx - center_x) ** 2 + (cy - center_y) ** 2), 'b': beam_id}}) AS b FROM measures JOIN centers USING (gt_family) GROUP BY gt_family)"""
_DET = "((l.x1 - l.x0) * (s.y1 - s.y0) - (l.y1 - l.y0) * (s.x1 - s.x0))"
_CROSS = f"""{SHORE}, tu AS (SELECT gt_family, beam_id, l.x0, l.y0, l.x1, l.y1,
        ((s.x0 - l.x0) * (s.y1 - s.y0) - (s.y0 - l.y0) * (s.x1 - s.x0)) / nullif({_DET}, 0) AS t, ((s.x0 - l.x0) * (l.y1 - l.y0) - (s.y0 - l.y0) * (l.x1 - l.x0)) / nullif({_DET}, 0) AS u
        FROM lines l, shore s),
    crossings AS (SELECT DISTINCT gt_family, beam_id, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""
_BOXES = f"""{_NEAREST}, {_CROSS},
    picked AS (SELECT gt_family, b.b AS nearest_beam, b.d AS center_dist, center_x, center_y, min({{'d': sqrt((x - center_x) ** 2 + (y - center_y) ** 2), 'x': x, 'y': y}}) AS c
               FROM nearest JOIN centers USING (gt_family) JOIN crossings ON crossings.gt_family = nearest.gt_family AND crossings.beam_id = nearest.b.b GROUP BY ALL),
    places AS (SELECT gt_family, nearest_beam AS beam_id, share, share * length AS pos FROM picked JOIN measures USING (gt_family), (VALUES (0.4::DOUBLE), (0.6::DOUBLE)) v(share) WHERE measures.beam_id = nearest_beam),
    ends AS (SELECT p.gt_family, min_by({{'x': x0 + (pos - cum) / len * (x1 - x0), 'y': y0 + (pos - cum) / len * (y1 - y0)}}, share) AS a, max_by({{'x': x0 + (pos - cum) / len * (x1 - x0), 'y': y0 + (pos - cum) / len * (y1 - y0)}}, share) AS b
             FROM places p JOIN lines l ON p.gt_family = l.gt_family AND p.beam_id = l.beam_id AND pos >= cum AND pos < cum + len GROUP BY ALL),
    boxes AS (SELECT gt_family, center_x, center_y, c.x AS cross_x, c.y AS cross_y, nearest_beam, center_dist,
                     (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS tx, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS ty FROM picked JOIN ends USING (gt_family)),
    clipped AS (SELECT tracks.*, sqrt((x - cross_x) ** 2 + (y - cross_y) ** 2) AS radial_dist_m FROM tracks JOIN boxes USING (gt_family)
                WHERE abs((x - cross_x) * tx + (y - cross_y) * ty) <= 300 AND abs(-(x - cross_x) * ty + (y - cross_y) * tx) <= 300)"""


def _to_segment(px: str, py: str, a: str) -> str:
    """Distance of a point from a segment of table ``a``."""
    t = f"greatest(least((({px} - {a}.x0) * ({a}.x1 - {a}.x0) + ({py} - {a}.y0) * ({a}.y1 - {a}.y0)) / (({a}.x1 - {a}.x0) ** 2 + ({a}.y1 - {a}.y0) ** 2), 1), 0)"
    return f"sqrt(({px} - ({a}.x0 + {t} * ({a}.x1 - {a}.x0))) ** 2 + ({py} - ({a}.y0 + {t} * ({a}.y1 - {a}.y0))) ** 2)"


def _between(a: str, b: str) -> str:
    det = f"(({a}.x1 - {a}.x0) * ({b}.y1 - {b}.y0) - ({a}.y1 - {a}.y0) * ({b}.x1 - {b}.x0))"
    t = f"(({b}.x0 - {a}.x0) * ({b}.y1 - {b}.y0) - ({b}.y0 - {a}.y0) * ({b}.x1 - {b}.x0)) / nullif({det}, 0)"
    u = f"(({b}.x0 - {a}.x0) * ({a}.y1 - {a}.y0) - ({b}.y0 - {a}.y0) * ({a}.x1 - {a}.x0)) / nullif({det}, 0)"
    ends = ", ".join([_to_segment(f"{a}.x{k}", f"{a}.y{k}", b) for k in (0, 1)] + [_to_segment(f"{b}.x{k}", f"{b}.y{k}", a) for k in (0, 1)])
    return f"CASE WHEN {t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1 THEN 0 ELSE least({ends}) END"


_PAIRS = f"""{_LINES}, pairs AS (SELECT a.gt_family, a.beam_id, b.gt_family AS other_family, b.beam_id AS other_beam,
        min(CASE WHEN a.gt_family = b.gt_family AND a.beam_id = b.beam_id THEN 0::DOUBLE ELSE {_between('a', 'b')} END) AS dist
    FROM lines a JOIN lines b ON abs(a.x0 - b.x0) < 60 AND abs(a.y0 - b.y0) < 80 GROUP BY ALL HAVING dist <= 21)"""
_CANDIDATES = f"""{_PAIRS}, seeds AS (SELECT *, CAST(row_number() OVER (ORDER BY gt_family, beam_id) - 1 AS INT) AS cluster_id FROM (SELECT gt_family, beam_id, count(*) AS num_points FROM tracks GROUP BY ALL)),
    groups AS (SELECT size AS cluster_distance_m, gt_family, beam_id, list({{'f': other_family, 'b': other_beam}} ORDER BY other_family, other_beam) AS beams
               FROM pairs, (VALUES (18.0::DOUBLE), (42.0::DOUBLE)) v(size) WHERE dist <= size / 2 GROUP BY ALL),
    candidates AS (SELECT *, CAST(len(beams) AS INT) AS num_beams FROM groups JOIN seeds USING (gt_family, beam_id) WHERE len(beams) >= 2)"""


def _outline(sizes: str) -> str:
    """The corridors' vertices, areas, centroids and axes, a row for each vertex of the ring."""
    step = math.pi / 32

    def joins(part: int, side: int) -> str:
        """Vertices where two pieces (u, then v) meet, on one side."""
        n = lambda d: f"({-side} * {d}y), ({side} * {d}x)".split(", ")
        (ux, uy), (vx, vy) = n("ud"), n("vd")
        about = f"atan2(abs(cr), dt) * {-side} * k / greatest(1, floor(atan2(abs(cr), dt) / {step!r} + 0.5))"
        return f"""
            SELECT gt_family, beam_id, r, {part} AS part, {side} * seg AS a, {side} * k AS b,
                   CASE WHEN {side} * cr < 0 THEN x1 + r * (cos({about}) * {ux} - sin({about}) * {uy}) WHEN NOT short THEN x1 + r * ({ux} + {vx}) / (1 + dt)
                        WHEN k = 0 THEN x1 + r * {ux} WHEN k = 1 THEN x1 ELSE x1 + r * {vx} END AS x,
                   CASE WHEN {side} * cr < 0 THEN y1 + r * (sin({about}) * {ux} + cos({about}) * {uy}) WHEN NOT short THEN y1 + r * ({uy} + {vy}) / (1 + dt)
                        WHEN k = 0 THEN y1 + r * {uy} WHEN k = 1 THEN y1 ELSE y1 + r * {vy} END AS y
            FROM (SELECT *, unnest(range(CAST(CASE WHEN {side} * cr < 0 THEN greatest(1, floor(atan2(abs(cr), dt) / {step!r} + 0.5)) + 1 WHEN short THEN 3 ELSE 1 END AS BIGINT))) AS k FROM turns)"""

    return f"""pieces AS (SELECT *, (x1 - x0) / len AS udx, (y1 - y0) / len AS udy, lead((x1 - x0) / len) OVER w AS vdx, lead((y1 - y0) / len) OVER w AS vdy, lead(len) OVER w AS vlen,
                      row_number() OVER w = 1 AS head FROM lines WHERE len > 0 WINDOW w AS (PARTITION BY gt_family, beam_id ORDER BY seg)),
        sized AS (SELECT * FROM pieces, (VALUES {sizes}) v(r)),
        turns AS (SELECT *, r * abs(cr) / nullif(1 + dt, 0) > least(len, vlen) OR dt <= -1 + 1e-12::DOUBLE AS short
                  FROM (SELECT *, udx * vdy - udy * vdx AS cr, udx * vdx + udy * vdy AS dt FROM sized WHERE vdx IS NOT NULL) WHERE abs(cr) >= 1e-12::DOUBLE OR dt <= 0),
        vertices_of AS (
            SELECT gt_family, beam_id, r, 0 AS part, 0 AS a, 0 AS b, x0 - r * udy AS x, y0 + r * udx AS y FROM sized WHERE head
            UNION ALL {joins(1, 1)}
            UNION ALL SELECT gt_family, beam_id, r, 2, 0, k, x1 + r * (-udy * cos(-k * {step!r}) - udx * sin(-k * {step!r})), y1 + r * (-udy * sin(-k * {step!r}) + udx * cos(-k * {step!r})) FROM sized, range(33) g(k) WHERE vdx IS NULL
            UNION ALL {joins(3, -1)}
            UNION ALL SELECT gt_family, beam_id, r, 4, 0, k, x0 + r * (udy * cos(-k * {step!r}) + udx * sin(-k * {step!r})), y0 + r * (udy * sin(-k * {step!r}) - udx * cos(-k * {step!r})) FROM sized, range(32) g(k) WHERE head),
        framed AS (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny
                   FROM vertices_of WINDOW w AS (PARTITION BY gt_family, beam_id, r ORDER BY part, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        ground AS (SELECT gt_family, beam_id, r, any_value(fx) AS fx, any_value(fy) AS fy, count(*) + 1 AS n, sum(x - fx) AS sx, sum(y - fy) AS sy, sum((x - fx) ** 2) AS sxx, sum((x - fx) * (y - fy)) AS sxy, sum((y - fy) ** 2) AS syy,
                          sum((x - fx) * (ny - fy) - (nx - fx) * (y - fy)) AS w, sum((x + nx - 2 * fx) * ((x - fx) * (ny - fy) - (nx - fx) * (y - fy))) AS wx, sum((y + ny - 2 * fy) * ((x - fx) * (ny - fy) - (nx - fx) * (y - fy))) AS wy
                   FROM framed GROUP BY ALL),
        corridors AS (SELECT gt_family, beam_id, r, abs(w) / 2 AS area, fx + wx / (3 * w) AS cx, fy + wy / (3 * w) AS cy, atan2(2 * (sxy - sx * sy / n), (sxx - sx * sx / n) - (syy - sy * sy / n)) / 2 AS turn FROM ground)"""


_ON_SHORE = """ends_of AS (SELECT l.gt_family, l.beam_id, l.seg, l.x0, l.y0, l.x1, l.y1, s.seg AS sseg, s.x0 AS sx0, s.y0 AS sy0, s.x1 AS sx1, s.y1 AS sy1, sqrt((s.x1 - s.x0) ** 2 + (s.y1 - s.y0) ** 2) AS slen,
            ((s.x0 - l.x0) * (s.y1 - s.y0) - (s.y0 - l.y0) * (s.x1 - s.x0)) / nullif((l.x1 - l.x0) * (s.y1 - s.y0) - (l.y1 - l.y0) * (s.x1 - s.x0), 0) AS t,
            ((s.x0 - l.x0) * (l.y1 - l.y0) - (s.y0 - l.y0) * (l.x1 - l.x0)) / nullif((l.x1 - l.x0) * (s.y1 - s.y0) - (l.y1 - l.y0) * (s.x1 - s.x0), 0) AS u
            FROM lines l, shore s),
        tried AS (SELECT *, t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AS meets, least(greatest(((x0 - sx0) * (sx1 - sx0) + (y0 - sy0) * (sy1 - sy0)) / slen ** 2, 0), 1) AS p, least(greatest(((x1 - sx0) * (sx1 - sx0) + (y1 - sy0) * (sy1 - sy0)) / slen ** 2, 0), 1) AS q,
            least(greatest(((sx0 - x0) * (x1 - x0) + (sy0 - y0) * (y1 - y0)) / nullif((x1 - x0) ** 2 + (y1 - y0) ** 2, 0), 0), 1) AS m, least(greatest(((sx1 - x0) * (x1 - x0) + (sy1 - y0) * (y1 - y0)) / nullif((x1 - x0) ** 2 + (y1 - y0) ** 2, 0), 0), 1) AS o FROM ends_of),
        nearest_on AS (SELECT gt_family, beam_id, sseg, seg, slen, CASE WHEN meets THEN {'d': 0.0::DOUBLE, 'on_': u * slen} ELSE list_min([
            {'d': sqrt((x0 - sx0 - p * (sx1 - sx0)) ** 2 + (y0 - sy0 - p * (sy1 - sy0)) ** 2), 'on_': p * slen}, {'d': sqrt((x1 - sx0 - q * (sx1 - sx0)) ** 2 + (y1 - sy0 - q * (sy1 - sy0)) ** 2), 'on_': q * slen},
            {'d': sqrt((sx0 - x0 - m * (x1 - x0)) ** 2 + (sy0 - y0 - m * (y1 - y0)) ** 2), 'on_': 0.0::DOUBLE}, {'d': sqrt((sx1 - x0 - o * (x1 - x0)) ** 2 + (sy1 - y0 - o * (y1 - y0)) ** 2), 'on_': slen}]) END AS b FROM tried),
        chosen AS (SELECT * FROM nearest_on QUALIFY row_number() OVER (PARTITION BY gt_family, beam_id ORDER BY b.d, sseg, seg) = 1),
        along_shore AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS slen, coalesce(sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) OVER (ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS scum FROM shore),
        placed AS (SELECT gt_family, beam_id, scum + b.on_ AS spot FROM chosen JOIN along_shore a ON a.seg = sseg),
        asked AS (SELECT gt_family, beam_id, side, least(greatest(spot + side, 0), (SELECT max(scum + slen) FROM along_shore)) AS spot FROM placed, (VALUES (-10.0::DOUBLE), (10.0::DOUBLE)) v(side)),
        spots AS (SELECT gt_family, beam_id, side, x0 + (spot - scum) / slen * (x1 - x0) AS x, y0 + (spot - scum) / slen * (y1 - y0) AS y FROM asked JOIN along_shore ON spot >= scum AND spot <= scum + slen
                  QUALIFY row_number() OVER (PARTITION BY gt_family, beam_id, side ORDER BY seg) = 1),
        run AS (SELECT gt_family, beam_id, max(x) FILTER (side > 0) - max(x) FILTER (side < 0) AS rx, max(y) FILTER (side > 0) - max(y) FILTER (side < 0) AS ry FROM spots GROUP BY ALL)"""


def _greedy(least: int) -> str:
    """The fold as a recursion over ranks, one row a step in each group."""
    return f"""WITH RECURSIVE {_CANDIDATES},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_distance_m, gt_family ORDER BY num_beams DESC, cluster_id) AS k FROM candidates WHERE num_beams >= {least}),
    fold AS (
        SELECT cluster_distance_m, gt_family, beam_id, cluster_id, k, beams AS covered, true AS selected FROM ranked WHERE k = 1
        UNION ALL
        SELECT r.cluster_distance_m, r.gt_family, r.beam_id, r.cluster_id, r.k, list_distinct(list_concat(f.covered, r.beams)), NOT list_has_all(f.covered, r.beams)
        FROM fold f JOIN ranked r ON r.cluster_distance_m = f.cluster_distance_m AND r.gt_family = f.gt_family AND r.k = f.k + 1)"""


def _inside(x: str, y: str) -> str:
    ring = aoi.normalised([RING], tolerance=0.0)
    terms = [f"CASE WHEN ({a[1]} > {y}) <> ({b[1]} > {y}) AND {x} < ({b[0]} - {a[0]})::DOUBLE * ({y} - {a[1]}) / ({b[1]} - {a[1]})::DOUBLE + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(ring, ring[1:])]
    return f"({' + '.join(terms)}) % 2 = 1"


def _each(*names: str) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


QUERIES = {
    f.__name__: f
    for f in (
        quality_few, quality_trash, quality_too_far, knn1, quality_status, quality_pivot, family_center, polyline_length, polyline_centroid, nearest_line, line_cross_shore, boxes,
        box_clip, box_radial, beam_spacing, neighbour_join, candidate_clusters, greedy_select, greedy_summary, cluster_angle, cluster_center, corridor_outline, buffer_points, file_semijoin, corridor_select,
        display_range, photon_clip, padded_bounds, family_batches, gate_kept, gate_flagged, quality_gate, workflow_single, grid_sweep,
    )
}

SQL = {
    "quality_few": f"WITH {_FLAGS} SELECT gt_family, beam_id, few_points FROM flags",
    "quality_trash": f"WITH {_FLAGS} SELECT gt_family, beam_id, elev_trash FROM flags",
    "quality_too_far": f"WITH {_FLAGS} SELECT gt_family, beam_id, {_each('nearest_dist')}, too_far FROM flags",
    "knn1": f"WITH {_FLAGS} SELECT gt_family, beam_id, {_each('nearest_dist')} FROM near",
    "quality_status": f"WITH {_FLAGS} SELECT gt_family, beam_id, status FROM flags",
    "quality_pivot": f"""WITH {_FLAGS} SELECT gt_family, 48::BIGINT AS ideal_case, count(*) AS files_found, 48 - count(*) AS missing,
        {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in quality.STATUSES)} FROM flags GROUP BY gt_family""",
    "gate_kept": f"WITH {_FLAGS} SELECT gt_family, beam_id, count(*) AS n FROM clouds WHERE beam_id IN (SELECT beam_id FROM flags WHERE status = 'loaded') GROUP BY ALL",
    "gate_flagged": f"WITH {_FLAGS} SELECT gt_family, beam_id, {r6('nearest_dist')} AS nearest_dist FROM flags WHERE too_far",
    "quality_gate": f"WITH {_flags_sql(_DATED, 'dated')} SELECT gt_family, beam_id, count(*) AS n FROM dated WHERE beam_id IN (SELECT beam_id FROM flags WHERE status = 'loaded') GROUP BY ALL",
    "family_center": f"WITH {CLOUDS} SELECT gt_family, {r6('avg(x)')} AS center_x, {r6('avg(y)')} AS center_y FROM (SELECT DISTINCT gt_family, x, y FROM clouds) GROUP BY gt_family",
    "polyline_length": f"WITH {_MEASURES} SELECT gt_family, beam_id, {_each('length')} FROM measures",
    "polyline_centroid": f"WITH {_MEASURES} SELECT gt_family, beam_id, {_each('cx', 'cy')} FROM measures",
    "nearest_line": f"WITH {_NEAREST} SELECT gt_family, b.b AS nearest_beam, {r6('b.d')} AS center_dist FROM nearest",
    "line_cross_shore": f"WITH {_LINES}, {_CROSS} SELECT gt_family, beam_id, {_each('x', 'y')} FROM crossings",
    "boxes": f"WITH {_BOXES} SELECT gt_family, {_each('center_x', 'center_y', 'cross_x', 'cross_y')}, nearest_beam, {_each('tx', 'ty')}, 300.0::DOUBLE AS half_along, 300.0::DOUBLE AS half_across FROM boxes",
    "box_clip": f"WITH {_BOXES} SELECT gt_family, beam_id, {_each('x', 'y')} FROM clipped",
    "box_radial": f"WITH {_BOXES} SELECT gt_family, beam_id, {_each('y', 'radial_dist_m')} FROM clipped",
    "beam_spacing": f"""WITH {_MEASURES}, middles AS (SELECT m.gt_family, m.beam_id, x0 + (length / 2 - cum) / len * (x1 - x0) AS px FROM measures m JOIN lines l ON m.gt_family = l.gt_family AND m.beam_id = l.beam_id AND length / 2 >= cum AND length / 2 < cum + len),
        gaps AS (SELECT *, px - lag(px) OVER (PARTITION BY gt_family ORDER BY px, beam_id) AS gap FROM middles)
        SELECT gt_family, count(*) AS n_beams, {r6('max(px) - min(px)')} AS max_dist, {r6('avg(gap)')} AS avg_dist, min_by(beam_id, px) AS west_beam, max_by(beam_id, px) AS east_beam FROM gaps GROUP BY gt_family HAVING count(*) >= 2""",
    "neighbour_join": f"WITH {_PAIRS} SELECT gt_family, beam_id, other_family, other_beam, {_each('dist')} FROM pairs",
    "candidate_clusters": f"WITH {_CANDIDATES} SELECT cluster_distance_m, gt_family, beam_id, cluster_id, CAST(num_points AS INT) AS num_points, num_beams, list_reduce(list_transform(beams, lambda s: s.b), lambda p, q: p || ',' || q) AS members FROM candidates",
    "cluster_center": f"WITH {_CANDIDATES}, {_outline('(9.0::DOUBLE), (21.0::DOUBLE)')} SELECT cluster_distance_m, gt_family, beam_id, cluster_id, {r6('cx')} AS center_x, {r6('cy')} AS center_y FROM candidates JOIN corridors USING (gt_family, beam_id) WHERE r = cluster_distance_m / 2",
    "corridor_outline": f"WITH {_LINES}, {_outline('(9.0::DOUBLE), (30.0::DOUBLE)')} SELECT gt_family, beam_id, r AS radius, {_each('area', 'cx', 'cy')}, {r6('degrees(CASE WHEN turn < 0 THEN turn + pi() ELSE turn END)')} AS axis_deg FROM corridors",
    "cluster_angle": f"""WITH {_CANDIDATES}, {SHORE}, {_outline('(21.0::DOUBLE)')}, {_ON_SHORE}
        SELECT gt_family, beam_id, cluster_id, floor(degrees(acos(least(abs(cos(turn) * rx + sin(turn) * ry) / sqrt(rx * rx + ry * ry), 1))) * 100 + 0.5) / 100 AS angle_deg
        FROM candidates JOIN corridors USING (gt_family, beam_id) JOIN run USING (gt_family, beam_id) WHERE cluster_distance_m = 42""",
    "greedy_select": f"{_greedy(2)} SELECT cluster_distance_m, gt_family, beam_id, cluster_id, selected FROM fold",
    "greedy_summary": f"""{_greedy(3)}, totals AS (SELECT cluster_distance_m, gt_family, count(*) AS total_clusters, count(*) FILTER (num_beams < 3) AS too_few_beams FROM candidates GROUP BY ALL),
        chosen AS (SELECT cluster_distance_m, gt_family, count(*) FILTER (selected) AS selected_clusters, count(*) FILTER (NOT selected) AS skipped_clusters, min_by(cluster_id, k) FILTER (selected) AS representative_cluster_id FROM fold GROUP BY ALL)
        SELECT cluster_distance_m, gt_family, total_clusters, coalesce(selected_clusters, 0) AS selected_clusters, coalesce(skipped_clusters, 0) AS skipped_clusters, too_few_beams, representative_cluster_id FROM totals LEFT JOIN chosen USING (cluster_distance_m, gt_family)""",
    "buffer_points": f"WITH {TRACKS}, {SHORE} SELECT gt_family, beam_id, {r6('tracks.x')} AS x, {r6('tracks.y')} AS y FROM tracks WHERE EXISTS (SELECT 1 FROM shore s WHERE {_to_segment('tracks.x', 'tracks.y', 's')} <= 25)",
    "file_semijoin": f"""WITH {TRACKS}, {SHORE}, high AS (SELECT * FROM tracks WHERE h_li > 0), hit AS (SELECT DISTINCT beam_id FROM high WHERE EXISTS (SELECT 1 FROM shore s WHERE {_to_segment('high.x', 'high.y', 's')} <= 12))
        SELECT gt_family, beam_id, {_each('x', 'y')} FROM high SEMI JOIN hit USING (beam_id)""",
    "corridor_select": f"""WITH {_LINES}, hit AS (SELECT DISTINCT beam_id FROM tracks WHERE EXISTS (SELECT 1 FROM lines s WHERE s.beam_id = '7' AND {_to_segment('tracks.x', 'tracks.y', 's')} <= 25))
        SELECT gt_family, beam_id, {_each('x', 'y')} FROM tracks SEMI JOIN hit USING (beam_id)""",
    "display_range": f"WITH {TRACKS}, held AS (SELECT *, count(*) OVER (PARTITION BY gt_family, beam_id) AS n FROM tracks WHERE h_li BETWEEN -6 AND 6) SELECT gt_family, beam_id, {_each('y', 'h_li')} FROM held WHERE n >= 25",
    "photon_clip": f"WITH p AS (SELECT event_id, value, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS sec FROM events) SELECT event_id FROM p WHERE value BETWEEN 5 AND 80 AND sec BETWEEN 5000 AND 80000 AND {_inside('value', 'sec')}",
    "padded_bounds": f"WITH {TRACKS} SELECT {r6('min(x) - 100')} AS x_min, {r6('min(y) - 100')} AS y_min, {r6('max(x) + 100')} AS x_max, {r6('max(y) + 100')} AS y_max FROM tracks",
    "family_batches": f"WITH {TRACKS} SELECT gt_family, count(*) AS files, count(DISTINCT beam_id) AS tracks FROM tracks GROUP BY gt_family",
}
