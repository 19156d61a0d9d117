"""Areas of interest: polygons made fit for a query, and clips to them."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.outlines import QUADRANT
from tidemark.operators.outlines import ring as outline

Ring = list[tuple[float, float]]


def area(ring: Ring) -> float:
    """Signed area, positive counter-clockwise."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def simplified(ring: Ring, tolerance: float) -> Ring:
    """Douglas and Peucker's line simplification, without recursion."""
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        (x0, y0), (x1, y1) = ring[a], ring[b]
        size = math.hypot(x1 - x0, y1 - y0)
        best, at = tolerance, None
        for k in range(a + 1, b):
            x, y = ring[k]
            d = abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) / size if size else math.hypot(x - x0, y - y0)
            if d > best:
                best, at = d, k
        if at is not None:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [ring[k] for k in sorted(keep)]


def hull(points: list[tuple[float, float]]) -> Ring:
    """The convex hull, counter-clockwise, by two monotone chains; without the points on its sides."""
    held = sorted(set(points))
    if len(held) < 3:
        return held

    def chain(row: Ring) -> Ring:
        out: Ring = []
        for p in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(held) + chain(held[::-1])


def _meets(p, q, r, s) -> list[tuple[Fraction, Fraction]]:
    """Where two closed segments meet, exactly: nowhere, in a point, or at the ends of what they share."""
    dx, dy, ex, ey = q[0] - p[0], q[1] - p[1], s[0] - r[0], s[1] - r[1]
    det = dx * ey - dy * ex
    if det:
        t, u = ((r[0] - p[0]) * ey - (r[1] - p[1]) * ex) / det, ((r[0] - p[0]) * dy - (r[1] - p[1]) * dx) / det
        return [(p[0] + t * dx, p[1] + t * dy)] if 0 <= t <= 1 and 0 <= u <= 1 else []
    if (r[0] - p[0]) * dy != (r[1] - p[1]) * dx:
        return []
    on = lambda v, a, b: min(a[0], b[0]) <= v[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= v[1] <= max(a[1], b[1])
    return [v for v in (r, s) if on(v, p, q)] + [v for v in (p, q) if on(v, r, s)]


def _noded(ring: Ring) -> tuple[set, bool]:
    """The ring's sides cut at all crossings, those covered an even number of times left out; and whether it was simple."""
    exact = [(Fraction(x), Fraction(y)) for x, y in ring]
    n, x, y = len(ring), np.array([p[0] for p in ring]), np.array([p[1] for p in ring])
    low_x, high_x, low_y, high_y = np.minimum(x, np.roll(x, -1)), np.maximum(x, np.roll(x, -1)), np.minimum(y, np.roll(y, -1)), np.maximum(y, np.roll(y, -1))
    cuts, simple = [{exact[k], exact[(k + 1) % n]} for k in range(n)], True
    for k in range(n):
        near = np.flatnonzero((low_x[k] <= high_x[k + 1 :]) & (low_x[k + 1 :] <= high_x[k]) & (low_y[k] <= high_y[k + 1 :]) & (low_y[k + 1 :] <= high_y[k])) + k + 1
        for j in near.tolist():
            found = _meets(exact[k], exact[(k + 1) % n], exact[j], exact[(j + 1) % n])
            shared = {exact[j]} if j == k + 1 else {exact[k]} if (j + 1) % n == k else set()
            simple &= set(found) <= shared
            cuts[k].update(found)
            cuts[j].update(found)
    sides: set = set()
    for k in range(n):
        (px, py), (qx, qy) = exact[k], exact[(k + 1) % n]
        row = sorted(cuts[k], key=lambda v: (v[0] - px) * (qx - px) + (v[1] - py) * (qy - py))
        for side in zip(row, row[1:]):
            sides ^= {frozenset(side)}
    return sides, simple


def repaired(ring: Ring) -> list[Ring]:
    """The simple rings, counter-clockwise, that bound what a ring encloses an odd number of times, the largest first.

    Crossings, ends of touching sides and places passed twice are where rings
    part; sides passed there and back vanish.  Everything is decided in exact
    fractions.  A ring without faults comes back as it is.
    """
    ring = [p for k, p in enumerate(ring) if p != ring[k - 1]] if len(set(ring)) > 1 else ring[:1]
    if len(ring) < 3:
        return []
    sides, simple = _noded(ring)
    if simple:
        return [ring if area(ring) > 0 else ring[::-1]]
    pairs = [tuple(s) for s in sides]

    def below(at: tuple[Fraction, Fraction], axis: int) -> bool:
        """Whether an odd number of sides lie before a point on the line through it along ``axis``."""
        other, odd = 1 - axis, False
        for p, q in pairs:
            if (p[other] <= at[other]) != (q[other] <= at[other]):
                odd ^= p[axis] + (at[other] - p[other]) * (q[axis] - p[axis]) / (q[other] - p[other]) < at[axis]
        return odd

    leaving: dict = {}
    for p, q in pairs:
        middle = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
        upright = p[1] != q[1]
        first = below(middle, 0) if upright else below(middle, 1)
        # The inside lies to the left of a side's direction.
        forward = ((q[1] > p[1]) == first) if upright else ((q[0] > p[0]) != first)
        a, b = (p, q) if forward else (q, p)
        leaving.setdefault(a, []).append(b)
    out = []

    def closed(row: list) -> None:
        flat = [(float(px), float(py)) for px, py in row]
        if area(flat) > 0:  # the others bound holes
            out.append(flat)

    while leaving:
        row, at, came = [], next(iter(leaving)), None
        while at in leaving:
            if at in row:  # a loop of its own
                closed(row[row.index(at) :])
                del row[row.index(at) :]
            choices = leaving[at]
            if came is None or len(choices) == 1:
                to = choices[0]
            else:  # the first side clockwise from where it came bounds the same inside
                back = math.atan2(came[1] - at[1], came[0] - at[0])
                to = min(choices, key=lambda v: (back - math.atan2(v[1] - at[1], v[0] - at[0])) % (2 * math.pi) or 2 * math.pi)
            choices.remove(to)
            if not choices:
                del leaving[at]
            row.append(at)
            at, came = to, at
        closed(row[row.index(at) :])
    return sorted(out, key=area, reverse=True)


def circle(x: float, y: float, radius: float) -> Ring:
    """A round of ``4 * QUADRANT`` points."""
    return [(x + radius * math.cos(k * math.pi / 2 / QUADRANT), y + radius * math.sin(k * math.pi / 2 / QUADRANT)) for k in range(4 * QUADRANT)]


def buffered(line: Ring, radius: float) -> Ring:
    """The outer ring of everything within ``radius`` of a point or line."""
    line = [p for k, p in enumerate(line) if not k or p != line[k - 1]]
    if len(line) == 1:
        return circle(*line[0], radius)
    held = F.array(*[F.struct(F.lit(float(px)).alias("x"), F.lit(float(py)).alias("y")) for px, py in line])
    drawn = SparkSession.active().range(1).select(outline(held, radius).alias("r")).first().r
    return repaired([(v.x, v.y) for v in drawn])[0]


def normalised(parts: list[Ring], buffer: float = 0.001, most: int = 500, tolerance: float = 0.0002, collection: bool = False) -> Ring:
    """One closed counter-clockwise ring of at least four points.

    Of several areas the largest is taken; a point or line gets a round buffer;
    a ``collection`` of other things becomes its convex hull.  What crosses
    itself is repaired, and the largest part of it taken.  Longitudes are
    wrapped; rings over ``most`` points are simplified (and repaired if that
    made sides cross).
    """
    if not any(parts):
        raise ValueError("no geometry")
    wrap = lambda x: x - 360 if x > 180 else x + 360 if x < -180 else x
    parts = [[(wrap(x), y) for x, y in p] for p in parts if p]
    if collection:
        parts = [hull([v for p in parts for v in p])]
    opened = [p[:-1] if len(p) > 1 and p[0] == p[-1] else p for p in parts]
    areas = [r for p in opened if len(hull(p)) > 2 for r in repaired(p)]
    if areas:
        ring = max(areas, key=area)
    else:  # points and lines, which have no inside
        ring = buffered(max(parts, key=len), buffer)
    if len(ring) > most:
        ring = max(repaired(simplified(ring + ring[:1], tolerance)[:-1]) or [ring], key=area)
    if area(ring) < 0:
        ring = ring[::-1]
    return ring + ring[:1]


def inside(x: Column, y: Column, ring: Ring) -> Column:
    """Even-odd test against a ring given by the caller; its points stand in the expression."""
    edges = F.array(*[F.struct(F.lit(float(a[0])).alias("ax"), F.lit(float(a[1])).alias("ay"), F.lit(float(b[0])).alias("bx"), F.lit(float(b[1])).alias("by")) for a, b in zip(ring, ring[1:])])
    crossed = F.filter(edges, lambda e: ((e.ay > y) != (e.by > y)) & (x < (e.bx - e.ax) * (y - e.ay) / F.nullif(e.by - e.ay, F.lit(0.0)) + e.ax))
    return F.size(crossed) % 2 == 1


def clip(points: DataFrame, ring: Ring, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Points in a ring: its bounds, which reach the scan, then the exact test."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    bounds = F.col(x).between(min(xs), max(xs)) & F.col(y).between(min(ys), max(ys))
    return points.where(bounds).where(inside(F.col(x), F.col(y), ring))


def padded_bounds(points: DataFrame, pad: float, x: str = "x", y: str = "y") -> DataFrame:
    return points.agg((F.min(x) - pad).alias("x_min"), (F.min(y) - pad).alias("y_min"), (F.max(x) + pad).alias("x_max"), (F.max(y) + pad).alias("y_max"))
