"""The engine's functions in SQL text: scalar and table functions, registered on a session.

``register`` makes temporary SQL functions, which the optimizer inlines, so a
query that calls them has the plan of its body and no Python runs.  Table
functions read views: ``points`` (profiles) and ``results`` (result tables),
given at registration.  Queries in SQL then take named arguments:

    sql.register(spark, points=points)
    spark.sql("SELECT * FROM profile_crossings(:height) WHERE bluff_x > :least", args={"height": 0.25, "least": 10.0})

Null arguments give null; a zero vector has no angle; degrees of freedom under
1 have no critical value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.geodesy import A, EARTH_KM, FLAT
from tidemark.operators import student

POINTS, RESULTS = "tidemark_points", "tidemark_results"


def _haversine() -> str:
    a = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"
    return f"{2000 * EARTH_KM}D * atan2(sqrt({a}), sqrt(1D - ({a})))"


def _geodesic(rounds: int = 8) -> str:
    """Vincenty's rounds as a fold of three steps each, so that every step reads plain fields of the one before."""
    b = A * (1 - FLAT)
    u, v = (f"atan({1 - FLAT!r}D * tan(radians({lat})))" for lat in ("lat1", "lat2"))
    fields = ("u", "v", "l", "lam", "ss", "cs", "sa", "c2", "cm")

    def state(**new: str) -> str:
        return "named_struct(" + ", ".join(f"'{f}', {new.get(f, f's.{f}')}" for f in fields) + ")"

    sines = state(ss="sqrt(pow(cos(s.v) * sin(s.lam), 2) + pow(cos(s.u) * sin(s.v) - sin(s.u) * cos(s.v) * cos(s.lam), 2))", cs="sin(s.u) * sin(s.v) + cos(s.u) * cos(s.v) * cos(s.lam)")
    sa = "CASE WHEN s.ss > 0 THEN cos(s.u) * cos(s.v) * sin(s.lam) / s.ss ELSE 0D END"
    c2 = f"(1D - pow({sa}, 2))"
    azimuth = state(sa=sa, c2=c2, cm=f"CASE WHEN {c2} > 1e-12D THEN s.cs - 2D * sin(s.u) * sin(s.v) / {c2} ELSE 0D END")
    c = f"({FLAT / 16!r}D * s.c2 * (4D + {FLAT!r}D * (4D - 3D * s.c2)))"
    turned = state(lam=f"s.l + (1D - {c}) * {FLAT!r}D * s.sa * (atan2(s.ss, s.cs) + {c} * s.ss * (s.cm + {c} * s.cs * (2D * s.cm * s.cm - 1D)))")
    start = "named_struct(" + ", ".join(f"'{f}', {x}" for f, x in zip(fields, (u, v, "radians(lon2 - lon1)", "radians(lon2 - lon1)", *["0D"] * 5))) + ")"
    u2 = f"(s.c2 * {(A * A - b * b) / (b * b)!r}D)"
    big = f"(1D + {u2} / 16384 * (4096D + {u2} * (-768D + {u2} * (320D - 175D * {u2}))))"
    small = f"({u2} / 1024 * (256D + {u2} * (-128D + {u2} * (74D - 47D * {u2}))))"
    turn = f"{small} * s.ss * (s.cm + {small} / 4 * (s.cs * (2D * s.cm * s.cm - 1D) - {small} / 6 * s.cm * (4D * s.ss * s.ss - 3D) * (4D * s.cm * s.cm - 3D)))"
    return f"""aggregate(sequence(1, {3 * rounds}), {start}, (s, k) -> CASE k % 3 WHEN 1 THEN {sines} WHEN 2 THEN {azimuth} ELSE {turned} END,
        s -> {b!r}D * {big} * (atan2(s.ss, s.cs) - {turn}))"""


def _angle() -> str:
    cosine = "abs(ax * bx + ay * by) / nullif(hypot(ax, ay) * hypot(bx, by), 0D)"
    return f"CASE WHEN {cosine} IS NOT NULL THEN degrees(acos(least({cosine}, 1D))) END"


def _critical(confidence: float) -> str:
    listed = ", ".join(f"{t!r}D" for t in student.critical(confidence))
    terms, z = student.expansion(confidence)
    beyond = f"{z!r}D + {terms[0]!r}D / dof + {terms[1]!r}D / (dof * dof) + {terms[2]!r}D / (dof * dof * dof)"
    return f"CASE WHEN dof BETWEEN 1 AND {student.TABLE} THEN try_element_at(array({listed}), CAST(dof AS INT)) WHEN dof > {student.TABLE} THEN {beyond} END"


_PLACE = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"


def _scalars(confidence: float) -> dict[str, tuple[str, str]]:
    return {
        "haversine_m": (_PLACE, _haversine()),
        "geodesic_m": (_PLACE, _geodesic()),
        "wrapped_longitude": ("lon DOUBLE", "CASE WHEN lon > 180 THEN lon - 360 WHEN lon < -180 THEN lon + 360 ELSE lon END"),
        "year_fraction": ("day DATE", "year(day) + dayofyear(day) / 365.25D"),
        "acute_angle": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE", _angle()),
        "t_critical": ("dof DOUBLE", _critical(confidence)),
        "presented": ("value DOUBLE", "bround(value, 2)"),
    }


def _crossings(keys: str, types: str) -> tuple[str, str, str]:
    """Where profiles first meet a height; exact hits win, flat profiles give their median distance."""
    close = lambda a, b: f"abs({a} - {b}) <= 1e-3D + 1e-5D * abs({b})"
    body = f"""
        WITH steps AS (SELECT {keys}, x, y, ref, lead(x) OVER w AS x1, lead(y) OVER w AS y1
                       FROM (SELECT {keys}, distance_from_offshore AS x, h_li AS y, height AS ref FROM {POINTS} WHERE abs(distance_from_offshore) < double('inf') AND abs(h_li) < double('inf'))
                       WINDOW w AS (PARTITION BY {keys} ORDER BY x, y)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x, y) AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM steps WHERE x1 IS NULL OR x1 <> x OR y1 <> y),
        ends AS (SELECT {keys}, max(n) AS n, max(ref) AS ref, min(x) FILTER (WHERE abs(y - ref) <= 1e-3D) AS exact, count_if(signum(y - ref) * signum(y1 - ref) < 0) AS flips,
                        min_by(CASE WHEN NOT ({close('y', 'y1')}) THEN x + (ref - y) / nullif(y1 - y, 0D) * (x1 - x) END, CASE WHEN signum(y - ref) * signum(y1 - ref) < 0 THEN k END) AS at,
                        min(y) AS low, max(y) AS high, avg(x) FILTER (WHERE 2 * k BETWEEN n AND n + 2) AS middle FROM placed GROUP BY {keys})
        SELECT {keys}, CASE WHEN n < 2 THEN NULL WHEN exact IS NOT NULL THEN exact WHEN flips > 0 THEN at WHEN {close('low', 'high')} AND {close('low', 'ref')} THEN middle END AS bluff_x FROM ends"""
    return "height DOUBLE", f"{types}, bluff_x DOUBLE", body


def _setup_rows(types: str) -> tuple[str, str, str]:
    """Results of one setup whose regression rate is known and in range."""
    body = f"SELECT * FROM {RESULTS} WHERE ClusterSize = size AND bias_tolerance = tolerance AND LRR BETWEEN least AND most"
    return "size INT, tolerance DOUBLE, least DOUBLE, most DOUBLE", types, body


def register(spark: SparkSession, confidence: float = 0.95, points: DataFrame | None = None, results: DataFrame | None = None, keys: tuple[str, ...] = ("gt_family", "beam_id", "acq_date")) -> list[str]:
    """Makes the functions of a session, in place of earlier ones of the same names; returns their names.

    Scalars: ``haversine_m``, ``geodesic_m``, ``wrapped_longitude``,
    ``year_fraction``, ``acute_angle``, ``t_critical`` (at ``confidence``) and
    ``presented``.  With ``points``: the table function
    ``profile_crossings(height)`` over the profiles named by ``keys``.  With
    ``results``: ``setup_rows(size, tolerance, least, most)``.
    """
    if not 0 < confidence < 1 or math.isnan(confidence):
        raise ValueError("confidence lies between 0 and 1")
    made = []
    for name, (given, body) in _scalars(confidence).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS DOUBLE RETURN {body}")
        made.append(name)
    tables = {}
    typed = lambda table, names: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name in names)
    if points is not None:
        points.createOrReplaceTempView(POINTS)
        tables["profile_crossings"] = _crossings(", ".join(f"`{k}`" for k in keys), typed(points.select(*keys), keys))
    if results is not None:
        results.createOrReplaceTempView(RESULTS)
        tables["setup_rows"] = _setup_rows(typed(results, results.columns))
    for name, (given, returned, body) in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE ({returned}) RETURN {body}")
        made.append(name)
    return made
