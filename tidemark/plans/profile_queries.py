"""Queries on profiles: interpolation, crossings, biases, distances; and on names."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import crs, geodesy, names
from tidemark.functions.numeric import rounded
from tidemark.operators import bias, prep, profiles as P
from tidemark.plans.stand_ins import NAMES, PROFILES, TRACKS, file_names, profiles, r6, tracks
from tidemark.sources.staging import staged
from tidemark.sources.tables import parquet

CYCLE = ["gt_family", "beam_id", "acq_date"]


def _tidy(table):
    return table.withColumns({c: rounded(F.col(c)) for c, t in table.dtypes if t == "double"})


def interp_at_x0(spark, sf):
    return _tidy(P.at_distance(profiles(spark, sf), CYCLE, 550.0))


def crossing_first(spark, sf):
    return _tidy(P.crossings(profiles(spark, sf), CYCLE, F.lit(0.25), "first"))


def crossing_last(spark, sf):
    return _tidy(P.crossings(profiles(spark, sf), CYCLE, F.lit(0.25), "last"))


def crossing_exact(spark, sf):
    return _tidy(P.crossings(profiles(spark, sf), CYCLE, F.lit(4.0), "first"))


def stand_clusters(spark, sf, points=None):
    """Each beam with the next one of its family as a cluster."""
    beams = (points or profiles(spark, sf)).select("gt_family", "beam_id").distinct()
    number = F.col("beam_id").cast("long")
    other = F.when(number % 2 == 0, number + 1).otherwise(number + 3)
    pair = lambda b: F.struct(F.col("gt_family"), b.cast("string").alias("beam_id"))
    return beams.select("gt_family", "beam_id", number.alias("cluster_id"), F.array(pair(number), pair(other)).alias("beam_ids"))


KEYS = ["gt_family", "cluster_id"]


def bias_report(spark, sf):
    return _tidy(bias.report(stand_clusters(spark, sf), profiles(spark, sf), KEYS))


def _kept(spark, sf):
    """(passes of clusters, biases, clusters): of the points only what is found of each pass goes on."""
    passes = staged(bias.passes(profiles(spark, sf)))
    listed = staged(stand_clusters(spark, sf, passes))
    inside = staged(bias.profiles_in(listed, passes, KEYS))
    return inside, staged(bias.keep(bias.judged(inside, KEYS), [2.0])), listed


def bias_filter(spark, sf):
    return _tidy(_kept(spark, sf)[1])


def bias_summary(spark, sf):
    _, kept, listed = _kept(spark, sf)
    return _tidy(bias.summary(kept, listed, KEYS))


def _accepted(spark, sf):
    inside, kept, _ = _kept(spark, sf)
    return bias.allowed(inside, kept, KEYS)


def _bluffs(spark, sf):
    """The points meet the accepted passes and their levels where they lie, since they are dealt by pass."""
    accepted = staged(_accepted(spark, sf))
    lined = staged(accepted.join(bias.levels(accepted, KEYS), KEYS).select(*KEYS, "beam_id", "acq_date", "ref_line"))
    return bias.crossed(profiles(spark, sf).join(lined, CYCLE), KEYS)


def bluff_positions(spark, sf):
    return _tidy(_bluffs(spark, sf))


def yref_oldest(spark, sf):
    return _tidy(_bluffs(spark, sf).select(*KEYS, "ref_line").distinct())


def used_cycles(spark, sf):
    return _accepted(spark, sf).groupBy(*KEYS).agg(F.count_distinct("beam_id").alias("used_beams"), F.count_distinct("beam_id", "acq_date").alias("used_cycles"))


def along_track(spark, sf):
    return _tidy(P.along_track(tracks(spark, sf), ["gt_family", "beam_id"]).select("gt_family", "beam_id", "point_id", "y", "distance_from_offshore"))


def point_id(spark, sf):
    return P.along_track(tracks(spark, sf), ["gt_family", "beam_id"]).groupBy("gt_family", "beam_id").agg(F.max("point_id").alias("last_point"), F.count(F.lit(1)).alias("n"))


def places(spark, sf):
    """Events as positions: a profile for each user, in the order of events."""
    return parquet(spark, sf, "events").select("event_id", "user_id", (F.col("value") / 50 + 69).alias("latitude"), ((F.col("event_id") % 97) / 20 - 150).alias("longitude"))


def haversine_first(spark, sf):
    return _tidy(P.distance_from_first(places(spark, sf), ["user_id"], ["event_id"]).select("event_id", "distance"))


def cum_geodesic(spark, sf):
    ordered = P.geodesic_along(places(spark, sf).withColumn("south", -F.col("latitude")), ["user_id"], ["south", "event_id"])
    return ordered.select("event_id", F.floor(F.col("distance_m") * 100 + 0.5).cast("long").alias("centimetres"))


def granule_numbers(spark, sf):
    rows = parquet(spark, sf, "events").select("user_id", (F.col("event_id") % 1387).alias("rgt"), (F.col("event_id") % 24).alias("cycle_number"))
    return prep.granule_numbers(rows, ["user_id"])


def utm_fwd(spark, sf):
    p = places(spark, sf).select("event_id", geodesy.utm(F.col("latitude"), F.col("longitude")).alias("p"))
    return p.select("event_id", rounded(F.col("p.x"), 3).alias("x"), rounded(F.col("p.y"), 3).alias("y"))


def utm_round_trip(spark, sf):
    p = places(spark, sf).select("event_id", "latitude", "longitude", geodesy.utm(F.col("latitude"), F.col("longitude")).alias("p"))
    back = p.select("event_id", "latitude", "longitude", geodesy.utm_inverse(F.col("p.x"), F.col("p.y")).alias("b"))
    return back.select("event_id", (F.greatest(F.abs(F.col("b.lat") - F.col("latitude")), F.abs(F.col("b.lon") - F.col("longitude"))) < 1e-8).alias("returns"))


def polar_fwd(spark, sf):
    p = places(spark, sf).select("event_id", geodesy.polar(F.col("latitude"), F.col("longitude")).alias("p"))
    return p.select("event_id", rounded(F.col("p.x"), 3).alias("x"), rounded(F.col("p.y"), 3).alias("y"))


def crs_transform(spark, sf):
    """Places given in five different systems, all carried to zone 6 north."""
    target, lat, lon = crs.parse(32606), F.col("latitude"), F.col("longitude")
    feet = crs.System("transverse", central=-153.0, origin=60.0, scale=0.9999, easting=1_000_000.0, northing=250_000.0, metre=0.3048006096012192)
    systems = [crs.DEGREES, crs.parse(3413), crs.parse(32605), crs.parse("EPSG:3857"), feet]
    given, there = F, F
    for k, system in enumerate(systems):
        given = given.when(F.col("event_id") % 5 == k, crs.forward(system, lat, lon))
        there = there.when(F.col("event_id") % 5 == k, crs.transform(system, target, F.col("g.x"), F.col("g.y")))
    p = places(spark, sf).select("event_id", given.alias("g")).select("event_id", there.alias("p"))
    return p.select("event_id", rounded(F.col("p.x"), 2).alias("x"), rounded(F.col("p.y"), 2).alias("y"))


def crs_south(spark, sf):
    """Places mirrored at the equator in the southern polar plane and a southern zone."""
    lat, lon = -F.col("latitude"), F.col("longitude")
    p = places(spark, sf).select("event_id", crs.forward(crs.parse(3031), lat, lon).alias("p"), crs.forward(crs.parse(32706), lat, lon).alias("z"))
    return p.select("event_id", *[rounded(F.col(f"{a}.{b}"), 3).alias(f"{n}{b}") for a, n in (("p", "polar_"), ("z", "zone_")) for b in "xy"])


def whole_profiles(spark, sf):
    """Events of known place and height as profiles without a clip, with the distance from each user's first."""
    points = places(spark, sf).join(parquet(spark, sf, "events").select("event_id", (F.col("value") - 40).alias("h_li"), (F.col("event_id") % 3).alias("atl06_quality_summary")), "event_id")
    return _tidy(prep.whole_profiles(points, ["user_id"], ["event_id"]).select("event_id", "h_li", "distance"))


def old_names(spark, sf):
    n = file_names(spark, sf)
    old = names.old_name(F.concat(F.lit("processed_"), "granule"))
    return n.select("o_orderkey", old["day"].alias("day"), old["track"].alias("track"), names.granule_track(F.col("granule")).alias("granule_track"), names.granule_track(F.regexp_replace("odd_name", "^ATL06", "a_b_c")).alias("odd_track"))


def lon_wrap(spark, sf):
    return _tidy(places(spark, sf).select("event_id", geodesy.wrapped_longitude(F.col("longitude") * 1.5).alias("longitude")))


def name_date(spark, sf):
    n = file_names(spark, sf)
    return n.select("o_orderkey", names.acquisition_date(F.col("name")).alias("acq_date"), names.plausible_date(names.acquisition_date(F.col("name"))).alias("plausible"), F.year(names.acquisition_date(F.col("name"))).alias("year"))


def name_family(spark, sf):
    return file_names(spark, sf).select("o_orderkey", names.family(F.col("name")).alias("family"), names.family(F.col("granule")).alias("granule_family"))


def name_track(spark, sf):
    return file_names(spark, sf).select("o_orderkey", names.track_number_legacy(F.col("name")).alias("track"), names.track_number_legacy(F.col("odd_name")).alias("odd_track"))


def name_rgt(spark, sf):
    n = file_names(spark, sf)
    return n.select("o_orderkey", names.reference_track(F.col("granule")).alias("rgt"), names.granule_date(F.col("granule")).alias("day"))


def track_norm(spark, sf):
    c = parquet(spark, sf, "customer")
    raw = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise((F.col("c_custkey") * 11).cast("string"))
    return c.select("c_custkey", names.track_normalised(raw).alias("track_id"))


_INTERP = """sides AS (
    SELECT {k}, sum(n) AS n, max({{'x': x, 'y': y}}) FILTER (x <= 550) AS a, min({{'x': x, 'y': y}}) FILTER (x >= 550) AS b
    FROM (SELECT {k}, distance_from_offshore AS x, avg(h_li) AS y, count(*) AS n FROM {t} WHERE distance_from_offshore IS NOT NULL AND h_li IS NOT NULL GROUP BY ALL) GROUP BY {k}),
    vals AS (SELECT {k}, CASE WHEN n < 2 THEN NULL WHEN a IS NULL THEN b.y WHEN b IS NULL OR a.x = b.x THEN a.y ELSE a.y + (550 - a.x) / (b.x - a.x) * (b.y - a.y) END AS value FROM sides)"""
_CYCLE = "gt_family, beam_id, acq_date"


def _crossing(k: str, t: str, ref: str, end: str) -> str:
    return f"""rows_in AS (SELECT DISTINCT {k}, distance_from_offshore AS x, h_li AS y, {ref} AS ref FROM {t} WHERE distance_from_offshore IS NOT NULL AND h_li IS NOT NULL),
    steps AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM rows_in WINDOW w AS (PARTITION BY {k} ORDER BY x, y)),
    ends AS (SELECT {k}, ref, count(*) AS n, {end}(x) FILTER (abs(y - ref) <= 1e-3) AS exact,
                    {end}({{'x': x, 'at': CASE WHEN NOT abs(y - y1) <= 1e-3 + 1e-5 * abs(y1) THEN x + (ref - y) / (y1 - y) * (x1 - x) END}}) FILTER (sign(y - ref) * sign(y1 - ref) < 0) AS flip,
                    min(y) AS low, max(y) AS high, median(x) AS middle FROM steps GROUP BY {k}, ref),
    crossed AS (SELECT {k}, ref, CASE WHEN n < 2 THEN NULL WHEN exact IS NOT NULL THEN exact WHEN flip IS NOT NULL THEN flip.at
                WHEN abs(low - high) <= 1e-3 + 1e-5 * abs(high) AND abs(low - ref) <= 1e-3 + 1e-5 * abs(ref) THEN middle END AS bluff_x FROM ends)"""


def _crossing_query(ref: str, end: str) -> str:
    return f"WITH {PROFILES}, {_crossing(_CYCLE, 'profiles', ref, end)} SELECT {_CYCLE}, {r6('bluff_x')} AS bluff_x, CASE WHEN bluff_x IS NOT NULL THEN {r6('ref')} END AS bluff_y FROM crossed"


_CLUSTERS = """clusters AS (SELECT DISTINCT gt_family, CAST(beam_id AS BIGINT) AS cluster_id, beam_id AS reference_beam,
    [CAST(beam_id AS BIGINT), CASE WHEN CAST(beam_id AS BIGINT) % 2 = 0 THEN CAST(beam_id AS BIGINT) + 1 ELSE CAST(beam_id AS BIGINT) + 3 END] AS beams FROM profiles),
    members AS (SELECT gt_family, cluster_id, reference_beam, CAST(unnest(beams) AS VARCHAR) AS beam_id FROM clusters)"""
_INSIDE = f"{PROFILES}, {_CLUSTERS}, inside AS (SELECT m.cluster_id, m.reference_beam, p.* FROM members m JOIN profiles p USING (gt_family, beam_id))"
_FIVE = "gt_family, cluster_id, reference_beam, beam_id, acq_date"
_BIASES = f"""{_INSIDE}, {_INTERP.format(k=_FIVE, t='inside')},
    base AS (SELECT gt_family, cluster_id, max_by(value, acq_date) AS y_ref FROM vals WHERE beam_id = reference_beam AND value IS NOT NULL GROUP BY gt_family, cluster_id),
    biases AS (SELECT {_FIVE}, CASE WHEN beam_id = reference_beam THEN 0.0::DOUBLE ELSE value - y_ref END AS bias, beam_id = reference_beam AS is_ref,
                      beam_id = reference_beam OR coalesce(abs(value - y_ref) <= 2, false) AS keep
               FROM (SELECT DISTINCT {_FIVE} FROM inside) LEFT JOIN vals USING ({_FIVE}) JOIN base USING (gt_family, cluster_id)),
    accepted AS (SELECT inside.* FROM inside WHERE EXISTS (FROM biases b WHERE b.keep AND b.gt_family = inside.gt_family AND b.cluster_id = inside.cluster_id AND b.beam_id = inside.beam_id AND b.acq_date = inside.acq_date)
        OR NOT EXISTS (FROM biases b WHERE b.keep AND b.gt_family = inside.gt_family AND b.cluster_id = inside.cluster_id))"""
_BLUFFS = f"""{_BIASES},
    oldest AS (SELECT gt_family, cluster_id, min({{'d': acq_date, 'o': beam_id <> reference_beam, 'b': beam_id}}) AS o FROM accepted GROUP BY ALL),
    levels AS (SELECT gt_family, cluster_id, (min(h_li) + max(h_li)) / 2 AS level FROM accepted JOIN oldest USING (gt_family, cluster_id) WHERE beam_id = o.b AND acq_date = o.d GROUP BY ALL),
    with_level AS (SELECT * FROM accepted JOIN levels USING (gt_family, cluster_id)),
    {_crossing('gt_family, cluster_id, beam_id, acq_date', 'with_level', 'level', 'min')}"""
_ALONG = f"""{TRACKS}, steps AS (SELECT *, row_number() OVER w - 1 AS point_id, count(*) OVER (PARTITION BY gt_family, beam_id) AS n,
        coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM tracks WINDOW w AS (PARTITION BY gt_family, beam_id ORDER BY y DESC, x)),
    along AS (SELECT gt_family, beam_id, point_id, y, n, sum(step) OVER (PARTITION BY gt_family, beam_id ORDER BY point_id) AS distance_from_offshore FROM steps WHERE n >= 2)"""


def r3(expression: str) -> str:
    return f"floor(({expression}) * 1e3 + 0.5) / 1e3"


def r2(expression: str) -> str:
    return f"floor(({expression}) * 1e2 + 0.5) / 1e2"


_PLACES = "places AS (SELECT event_id, user_id, value / 50 + 69 AS latitude, (event_id % 97) / 20 - 150 AS longitude FROM events)"
_HAVERSINE = "2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) * 1000"


# WGS 84 and the coefficients of its transverse Mercator series, as published.
_E, _RADIUS = 0.08181919084262149, 6367449.145823415
_SERIES = (8.377318206244698e-4, 7.608527773572307e-7, 1.197645503329453e-9, 2.429170607201359e-12, 5.711757677865804e-15, 1.491117731258390e-17)


def _series(coefficients, outer: str, inner: str) -> str:
    return " + ".join(f"({a!r}::DOUBLE * {outer}({2 * j} * xi) * {inner}({2 * j} * eta))" for j, a in enumerate(coefficients, 1))


_UTM = f"""s AS (SELECT event_id, radians(longitude + 147) AS lam, sin(radians(latitude)) AS si FROM places),
    t AS (SELECT event_id, lam, sinh(atanh(si) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * si)) AS t FROM s),
    p AS (SELECT event_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)"""
_ZONE_X = f"500000 + {0.9996 * _RADIUS!r}::DOUBLE * (eta + {_series(_SERIES, 'cos', 'sinh')})"
_ZONE_Y = f"{0.9996 * _RADIUS!r}::DOUBLE * (xi + {_series(_SERIES, 'sin', 'cosh')})"
#: Of the polar grid with true scale at 70 degrees north.
_SIN70 = math.sin(math.radians(70))
_POLAR_RHO = 6378137.0 * math.cos(math.radians(70)) / math.sqrt(1 - (_E * _SIN70) ** 2) / (math.tan(math.radians(10)) / ((1 - _E * _SIN70) / (1 + _E * _SIN70)) ** (_E / 2))
_SIN71 = math.sin(math.radians(71))
_SOUTH_RHO = 6378137.0 * math.cos(math.radians(71)) / math.sqrt(1 - (_E * _SIN71) ** 2) / (math.tan(math.radians(9.5)) / ((1 - _E * _SIN71) / (1 + _E * _SIN71)) ** (_E / 2))



def _geodesic(rounds: int = 8) -> str:
    """Lengths between a user's places, one after the other, each of Vincenty's rounds a table of its own."""
    a, f = 6378137.0, 1 / 298.257223563
    b, d = a * (1 - f), "::DOUBLE"
    tables = f"""g0 AS (SELECT event_id, user_id, latitude, atan({1 - f!r}{d} * tan(radians(lag(latitude) OVER w))) AS u, atan({1 - f!r}{d} * tan(radians(latitude))) AS v,
        radians(longitude - lag(longitude) OVER w) AS l, radians(longitude - lag(longitude) OVER w) AS lam FROM places WINDOW w AS (PARTITION BY user_id ORDER BY -latitude, event_id))"""
    for k in range(rounds):
        tables += f""",
        s{k} AS (SELECT * EXCLUDE (lam), lam, sqrt((cos(v) * sin(lam)) ** 2 + (cos(u) * sin(v) - sin(u) * cos(v) * cos(lam)) ** 2) AS ss, sin(u) * sin(v) + cos(u) * cos(v) * cos(lam) AS cs FROM g{k}),
        a{k} AS (SELECT *, CASE WHEN ss > 0 THEN cos(u) * cos(v) * sin(lam) / ss ELSE 0 END AS sa FROM s{k}),
        c{k} AS (SELECT *, 1 - sa * sa AS c2, CASE WHEN 1 - sa * sa > 1e-12{d} THEN cs - 2 * sin(u) * sin(v) / (1 - sa * sa) ELSE 0 END AS cm FROM a{k}),
        t{k} AS (SELECT *, {f / 16!r}{d} * c2 * (4 + {f!r}{d} * (4 - 3 * c2)) AS c FROM c{k}),
        g{k + 1} AS (SELECT event_id, user_id, latitude, u, v, l, l + (1 - c) * {f!r}{d} * sa * (atan2(ss, cs) + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS lam FROM t{k})"""
    return f"""{tables},
        p AS (SELECT *, c2 * {(a * a - b * b) / (b * b)!r}{d} AS q FROM t{rounds - 1}),
        big AS (SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS big, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS small FROM p),
        geodesic AS (SELECT event_id, user_id, latitude, {b!r}{d} * big * (atan2(ss, cs) - small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) AS step FROM big)"""


GEODESIC = f"{_PLACES}, {_geodesic()}"

QUERIES = {
    f.__name__: f
    for f in (
        interp_at_x0, crossing_first, crossing_last, crossing_exact, bias_report, bias_filter, bias_summary, bluff_positions, yref_oldest, used_cycles, along_track, point_id,
        haversine_first, cum_geodesic, granule_numbers, utm_fwd, utm_round_trip, polar_fwd, crs_transform, crs_south, whole_profiles, old_names, lon_wrap, name_date, name_family, name_track, name_rgt, track_norm,
    )
}

SQL = {
    "interp_at_x0": f"WITH {PROFILES}, {_INTERP.format(k=_CYCLE, t='profiles')} SELECT {_CYCLE}, {r6('value')} AS value FROM vals",
    "crossing_first": _crossing_query("0.25::DOUBLE", "min"),
    "crossing_last": _crossing_query("0.25::DOUBLE", "max"),
    "crossing_exact": _crossing_query("4.0::DOUBLE", "min"),
    "bias_report": f"""WITH {PROFILES}, {_CLUSTERS}, pooled AS (SELECT gt_family, beam_id, distance_from_offshore, h_li FROM profiles), {_INTERP.format(k='gt_family, beam_id', t='pooled')},
        days AS (SELECT gt_family, beam_id, min(acq_date) AS acq_date FROM profiles GROUP BY ALL)
        SELECT m.gt_family, m.cluster_id, m.reference_beam, m.beam_id, days.acq_date, {r6("CASE WHEN m.beam_id = m.reference_beam THEN 0.0::DOUBLE ELSE v.value - r.value END")} AS bias
        FROM members m JOIN days USING (gt_family, beam_id) JOIN vals r ON r.gt_family = m.gt_family AND r.beam_id = m.reference_beam AND r.value IS NOT NULL
        LEFT JOIN vals v ON v.gt_family = m.gt_family AND v.beam_id = m.beam_id""",
    "bias_filter": f"WITH {_BIASES} SELECT {_FIVE}, {r6('bias')} AS bias, is_ref, 2.0::DOUBLE AS bias_tolerance, keep FROM biases",
    "bias_summary": f"""WITH {_BIASES} SELECT gt_family, cluster_id, reference_beam, 2.0::DOUBLE AS bias_tolerance, count(DISTINCT beam_id) FILTER (NOT is_ref) AS n_beams, count(*) FILTER (keep AND NOT is_ref) AS n_kept_nonref,
        {', '.join(f"{r6(f'{f}(bias) FILTER (NOT is_ref)')} AS bias_{n}" for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg'), ('std', 'stddev')))},
        {', '.join(f"{r6(f'{f}(bias) FILTER (keep AND NOT is_ref)')} AS kept_bias_{n}" for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg'), ('std', 'stddev')))},
        count(*) FILTER (keep) AS n_kept, CAST(2 AS INT) AS n_beams_total FROM biases GROUP BY gt_family, cluster_id, reference_beam HAVING count(DISTINCT beam_id) FILTER (NOT is_ref) > 0""",
    "bluff_positions": f"WITH {_BLUFFS} SELECT gt_family, cluster_id, beam_id, acq_date, {r6('bluff_x')} AS bluff_x, {r6('ref')} AS bluff_y, {r6('ref')} AS ref_line FROM crossed WHERE crossed.bluff_x IS NOT NULL",
    "yref_oldest": f"WITH {_BLUFFS} SELECT DISTINCT gt_family, cluster_id, {r6('ref')} AS ref_line FROM crossed WHERE bluff_x IS NOT NULL",
    "used_cycles": f"WITH {_BIASES} SELECT gt_family, cluster_id, count(DISTINCT beam_id) AS used_beams, count(DISTINCT (beam_id, acq_date)) AS used_cycles FROM accepted GROUP BY ALL",
    "along_track": f"WITH {_ALONG} SELECT gt_family, beam_id, CAST(point_id AS INT) AS point_id, {r6('y')} AS y, {r6('distance_from_offshore')} AS distance_from_offshore FROM along",
    "point_id": f"WITH {_ALONG} SELECT gt_family, beam_id, CAST(max(point_id) AS INT) AS last_point, count(*) AS n FROM along GROUP BY ALL",
    "haversine_first": f"""WITH {_PLACES}, f AS (SELECT *, first_value(latitude) OVER w AS lat0, first_value(longitude) OVER w AS lon0 FROM places WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        h AS (SELECT event_id, sin(radians(latitude - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(latitude)) * sin(radians(longitude - lon0) / 2) ** 2 AS a FROM f)
        SELECT event_id, {r6(_HAVERSINE)} AS distance FROM h""",
    "whole_profiles": f"""WITH {_PLACES}, good AS (SELECT places.*, value - 40 AS h_li FROM places JOIN events USING (event_id) WHERE event_id % 3 = 0 AND value IS NOT NULL),
        f AS (SELECT *, first_value(latitude) OVER w AS lat0, first_value(longitude) OVER w AS lon0 FROM good WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        h AS (SELECT event_id, h_li, sin(radians(latitude - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(latitude)) * sin(radians(longitude - lon0) / 2) ** 2 AS a FROM f)
        SELECT event_id, {r6('h_li')} AS h_li, {r6(_HAVERSINE)} AS distance FROM h""",
    "old_names": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS track, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS granule_track, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS odd_track FROM orders",
    "cum_geodesic": f"""WITH {GEODESIC} SELECT event_id, CAST(floor(sum(coalesce(step, 0)) OVER (PARTITION BY user_id ORDER BY -latitude, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100 + 0.5) AS BIGINT) AS centimetres FROM geodesic""",
    "granule_numbers": "SELECT user_id, CAST(trunc(median(event_id % 1387)) AS INT) AS rgt, CAST(trunc(median(event_id % 24)) AS INT) AS cycle FROM events GROUP BY user_id",
    "utm_fwd": f"WITH {_PLACES}, {_UTM} SELECT event_id, {r3(f'500000 + {0.9996 * _RADIUS!r}::DOUBLE * (eta + {_series(_SERIES, 'cos', 'sinh')})')} AS x, {r3(f'{0.9996 * _RADIUS!r}::DOUBLE * (xi + {_series(_SERIES, 'sin', 'cosh')})')} AS y FROM p",
    "crs_transform": f"WITH {_PLACES}, {_UTM} SELECT event_id, {r2(_ZONE_X)} AS x, {r2(_ZONE_Y)} AS y FROM p",
    "crs_south": f"""WITH {_PLACES}, {_UTM}, q AS (SELECT event_id, radians(longitude) AS lam, sin(radians(latitude)) AS si, radians(latitude) AS phi FROM places),
        r AS (SELECT event_id, lam, {_SOUTH_RHO!r}::DOUBLE * tan(pi() / 4 - phi / 2) / ((1 - {_E!r}::DOUBLE * si) / (1 + {_E!r}::DOUBLE * si)) ** {_E / 2!r}::DOUBLE AS r FROM q)
        SELECT event_id, {r3('r * sin(lam)')} AS polar_x, {r3('r * cos(lam)')} AS polar_y, {r3(_ZONE_X)} AS zone_x, {r3(f'10000000 - ({_ZONE_Y})')} AS zone_y FROM r JOIN p USING (event_id)""",
    "utm_round_trip": "SELECT event_id, true AS returns FROM events",
    "polar_fwd": f"""WITH {_PLACES}, q AS (SELECT event_id, radians(longitude + 45) AS lam, sin(radians(latitude)) AS si, radians(latitude) AS phi FROM places),
        r AS (SELECT event_id, lam, {_POLAR_RHO!r}::DOUBLE * tan(pi() / 4 - phi / 2) / ((1 - {_E!r}::DOUBLE * si) / (1 + {_E!r}::DOUBLE * si)) ** {_E / 2!r}::DOUBLE AS r FROM q)
        SELECT event_id, {r3('r * sin(lam)')} AS x, {r3('-r * cos(lam)')} AS y FROM r""",
    "lon_wrap": f"WITH {_PLACES} SELECT event_id, {r6('CASE WHEN longitude * 1.5::DOUBLE < -180 THEN longitude * 1.5::DOUBLE + 360 WHEN longitude * 1.5::DOUBLE > 180 THEN longitude * 1.5::DOUBLE - 360 ELSE longitude * 1.5::DOUBLE END')} AS longitude FROM places",
    "name_date": f"""WITH {NAMES}, d AS (SELECT o_orderkey, CAST(try_strptime(list_filter(string_split(name, '_'), lambda t: regexp_full_match(t, '[0-9]{{8}}'))[-1], '%Y%m%d') AS DATE) AS acq_date FROM names)
        SELECT o_orderkey, acq_date, acq_date >= DATE '2018-01-01' AS plausible, CAST(year(acq_date) AS INT) AS year FROM d""",
    "name_family": f"WITH {NAMES} SELECT o_orderkey, nullif(regexp_extract(lower(name), '(?:^|_)(gt[123])', 1), '') AS family, nullif(regexp_extract(lower(granule), '(?:^|_)(gt[123])', 1), '') AS granule_family FROM names",
    "name_track": f"WITH {NAMES} SELECT o_orderkey, split_part(name, '_', 2) AS track, substr(split_part(odd_name, '_', 2), 1, 4) AS odd_track FROM names",
    "name_rgt": f"WITH {NAMES} SELECT o_orderkey, substr(split_part(granule, '_', 3), 1, 4) AS rgt, substr(split_part(granule, '_', 2), 1, 8) AS day FROM names",
    "track_norm": "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey WHEN c_custkey * 11 >= 1000 THEN CAST(c_custkey * 11 AS VARCHAR) ELSE lpad(CAST(c_custkey * 11 AS VARCHAR), 4, '0') END AS track_id FROM customer",
}
