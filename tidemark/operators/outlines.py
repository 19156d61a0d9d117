"""Outlines of corridors around lines: the offset curve with round joins and caps, its centroid and its principal axis.

A line's vertices are one array (a beam's, so bounded by its length), and all
else is arithmetic on arrays: no join and no exchange but the one that gathers
the line.  A quarter circle has ``QUADRANT`` pieces.  On the outer side of a
turn the curve follows the circle about the vertex, on the inner side it goes
through the point where the two offset lines cross, or, where the pieces are
too short for that, back over the vertex.  Vertices on a straight run add
nothing.  Where a corridor overlaps itself, the shared ground counts twice in
the centroid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUADRANT = 16
_STEP = math.pi / 2 / QUADRANT


def vertices(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``line``: the vertices of each line (seg, x0, y0, x1, y1) as an array of (x, y), without pieces of no length."""
    # In a number of partitions that stays: the work is in what is drawn, which the bytes read do not show.
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = lines.where("len > 0").repartition(parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg", "x0", "y0", "x1", "y1"))).alias("s"))
    first = F.transform(F.slice("s", 1, 1), lambda s: F.struct(s.x0.alias("x"), s.y0.alias("y")))
    return held.select(*keys, F.concat(first, F.transform("s", lambda s: F.struct(s.x1.alias("x"), s.y1.alias("y")))).alias("line"))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _arc(p: Column, nx: Column, ny: Column, r: Column, turn: Column, start: Column, stop: Column, pieces: Column) -> Column:
    """Points about ``p`` at distance ``r``: direction (nx, ny) turned by ``turn * k / pieces`` for k from start to stop; none if stop < start."""

    def at(k: Column) -> Column:
        a = turn * k / pieces
        return _point(p.x + r * (F.cos(a) * nx - F.sin(a) * ny), p.y + r * (F.sin(a) * nx + F.cos(a) * ny))

    return F.when(stop >= start, F.transform(F.sequence(start, F.greatest(start, stop)), at)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def _join(p: Column, u: Column, v: Column, r: Column, side: float) -> Column:
    """The curve's points at a vertex between directions ``u`` and ``v`` (dx, dy, len), on the left (1) or right (-1)."""
    cross, dot = u.dx * v.dy - u.dy * v.dx, u.dx * v.dx + u.dy * v.dy
    ux, uy, vx, vy = -side * u.dy, side * u.dx, -side * v.dy, side * v.dx
    before, behind = _point(p.x + r * ux, p.y + r * uy), _point(p.x + r * vx, p.y + r * vy)
    reach = r * F.abs(cross) / (F.lit(1.0) + dot)  # how far from the vertex the offset lines cross, along either
    meet = _point(p.x + r * (ux + vx) / (F.lit(1.0) + dot), p.y + r * (uy + vy) / (F.lit(1.0) + dot))
    inner = F.when((dot > -1 + 1e-12) & (reach <= F.least(u.len, v.len)), F.array(meet)).otherwise(F.array(before, _point(p.x, p.y), behind))
    angle = F.atan2(F.abs(cross), dot)
    pieces = F.greatest(F.lit(1), F.floor(angle / F.lit(_STEP) + 0.5).cast("int"))
    outer = _arc(p, ux, uy, r, F.lit(-side) * angle, F.lit(0), pieces, pieces)
    return F.when((F.abs(cross) < 1e-12) & (dot > 0), F.array().cast("array<struct<x:double,y:double>>")).when(F.lit(side) * cross > 0, inner).otherwise(outer)


def ring(line: Column, radius: Column | float) -> Column:
    """The outline of everything within ``radius`` of a line (array of (x, y), consecutive ones different), clockwise, its first point not repeated."""
    r = (radius if isinstance(radius, Column) else F.lit(radius)).cast("double")
    last = F.size(line) - 1

    def direction(k: Column) -> Column:
        a, b = F.element_at(line, k), F.element_at(line, k + 1)
        size = F.hypot(b.x - a.x, b.y - a.y)
        return F.struct(((b.x - a.x) / size).alias("dx"), ((b.y - a.y) / size).alias("dy"), size.alias("len"))

    def drawn(d: Column) -> Column:
        u, v = F.element_at(d, 1), F.element_at(d, -1)
        p, q = F.element_at(line, 1), F.element_at(line, -1)
        # Inside joins of both sides, in order; a line of one piece has none.
        inner = lambda side: F.when(last >= 2, F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), last)), lambda k: _join(F.element_at(line, k), F.element_at(d, k - 1), F.element_at(d, k), r, side)))).otherwise(
            F.array().cast("array<struct<x:double,y:double>>")
        )
        half, ends = F.lit(-math.pi), F.lit(2 * QUADRANT)
        return F.concat(
            F.array(_point(p.x - r * u.dy, p.y + r * u.dx)), inner(1.0),
            _arc(q, -v.dy, v.dx, r, half, F.lit(0), ends, ends),
            F.reverse(inner(-1.0)),
            _arc(p, u.dy, -u.dx, r, half, F.lit(0), ends - 1, ends),
        )

    return F.element_at(F.transform(F.array(F.transform(F.sequence(F.lit(1), last), direction)), drawn), 1)


def centroid(outline: Column) -> Column:
    """struct(area, x, y) of a ring, by cross products about its first point; the area is positive either way round."""
    origin = F.element_at(outline, 1)
    n = F.size(outline)

    def step(acc: Column, k: Column) -> Column:
        a, b = F.element_at(outline, k), F.element_at(outline, k % n + 1)
        ax, ay, bx, by = a.x - origin.x, a.y - origin.y, b.x - origin.x, b.y - origin.y
        w = ax * by - bx * ay
        return F.struct((acc.w + w).alias("w"), (acc.x + (ax + bx) * w).alias("x"), (acc.y + (ay + by) * w).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(
        F.sequence(F.lit(1), n), zero, step,
        lambda s: F.struct((F.abs(s.w) / 2).alias("area"), (origin.x + s.x / (3 * F.nullif(s.w, F.lit(0.0)))).alias("x"), (origin.y + s.y / (3 * F.nullif(s.w, F.lit(0.0)))).alias("y")),
    )


def axis(outline: Column) -> Column:
    """struct(dx, dy): the direction in which the ring's vertices, the first counted twice as where it closes, vary most."""
    first = F.element_at(outline, 1)
    closed = F.concat(outline, F.slice(outline, 1, 1))
    n = F.size(outline) + 1

    def sums(acc: Column, p: Column) -> Column:
        x, y = p.x - first.x, p.y - first.y
        return F.struct((acc.x + x).alias("x"), (acc.y + y).alias("y"), (acc.xx + x * x).alias("xx"), (acc.xy + x * y).alias("xy"), (acc.yy + y * y).alias("yy"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "xy", "yy")])

    def turned(s: Column) -> Column:
        turn = F.atan2(2 * (s.xy - s.x * s.y / n), (s.xx - s.x * s.x / n) - (s.yy - s.y * s.y / n)) / 2
        return F.struct(F.cos(turn).alias("dx"), F.sin(turn).alias("dy"))

    return F.aggregate(closed, zero, sums, turned)


def corridors(lines: DataFrame, keys: list[str], radii: list[float]) -> DataFrame:
    """keys, radius, area, cx, cy, ax, ay: the corridor of each line for each radius."""
    held = vertices(lines, keys).withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    drawn = held.select(*keys, "radius", ring(F.col("line"), F.col("radius")).alias("ring"))
    found = drawn.select(*keys, "radius", centroid(F.col("ring")).alias("c"), axis(F.col("ring")).alias("a"))
    return found.select(*keys, "radius", "c.area", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("a.dx").alias("ax"), F.col("a.dy").alias("ay"))
