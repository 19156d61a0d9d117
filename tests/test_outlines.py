"""Corridor outlines against hand-worked cases and against the ground that they cover."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import outlines, planar

BASE = (434_000.0, 7_798_000.0)


def drawn(spark, line, radius):
    rows = [("gt1", "b", BASE[0] + x, BASE[1] + y) for x, y in line]
    lines = planar.segments(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "gt_family string, beam_id string, x double, y double, k int"), ["gt_family", "beam_id"], ["k"])
    held = outlines.vertices(lines, ["beam_id"])
    ring = [(p.x - BASE[0], p.y - BASE[1]) for p in held.select(outlines.ring(F.col("line"), radius).alias("r")).first().r]
    return ring, outlines.corridors(lines, ["beam_id"], [radius]).first()


def covered(line, radius, step):
    """Area and centroid of what lies within ``radius`` of a line, by a fine lattice."""
    (x0, y0), (x1, y1) = np.min(line, axis=0) - radius, np.max(line, axis=0) + radius
    x, y = np.meshgrid(np.arange(x0 + step / 2, x1, step), np.arange(y0 + step / 2, y1, step))
    near = np.full(x.shape, np.inf)
    for (ax, ay), (bx, by) in zip(line, line[1:]):
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        near = np.minimum(near, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    inside = near <= radius
    return inside.sum() * step * step, x[inside].mean(), y[inside].mean()


def test_straight_corridor(spark):
    ring, found = drawn(spark, [(0, 0), (0, 30), (0, 100)], 9.0)
    # Two sides and two half circles of 32 pieces; the vertex between adds nothing.
    assert len(ring) == 66 and all(math.isclose(math.hypot(x, y - min(max(y, 0), 100)), 9.0) for x, y in ring)
    assert found.area == pytest.approx(100 * 18 + 32 * 81 * math.sin(math.pi / 32), rel=1e-9)
    assert (found.cx - BASE[0], found.cy - BASE[1]) == (pytest.approx(0, abs=1e-6), pytest.approx(50, abs=1e-6))
    # One end cap has its first vertex twice: the axis leans by far less than 0.03 degrees of a long corridor.
    lean = math.degrees(math.atan2(found.ax, found.ay))
    assert min(abs(lean), abs(abs(lean) - 180)) < 1.0


def test_axis_by_hand(spark):
    ring, found = drawn(spark, [(0, 0), (6, 400), (3, 600)], 9.0)
    points = np.array([*ring, ring[0]])
    values, vectors = np.linalg.eig(np.cov((points - points.mean(axis=0)).T))
    x, y = vectors[:, int(np.argmax(values))]
    assert abs(x * found.ay - y * found.ax) < 1e-9
    along = math.degrees(math.atan2(found.ay, found.ax)) % 180
    assert abs(along - math.degrees(math.atan2(600, 3)) % 180) < 0.3


@pytest.mark.parametrize("line, radius", [
    ([(0, 0), (2, 20), (1, 40), (5, 61), (4, 80)], 9.0),
    ([(0, 0), (40, 0), (40, 40)], 5.0),
    ([(0, 0), (40, 0), (10, 30)], 6.0),
    ([(0, 0), (0, 20), (1, 40), (0, 60)], 21.0),
])
def test_corridors_cover_what_is_near(spark, line, radius):
    ring, found = drawn(spark, line, radius)
    area, cx, cy = covered(line, radius, 0.05)
    assert found.area == pytest.approx(area, rel=0.006)
    assert math.hypot(found.cx - BASE[0] - cx, found.cy - BASE[1] - cy) < 0.05 * radius / 5
    away = [min(np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) for (ax, ay), (bx, by) in zip(line, line[1:]) for t in [min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))]) for x, y in ring]
    assert max(away) == pytest.approx(radius, rel=1e-6)


def test_turning_back(spark):
    ring, found = drawn(spark, [(0, 0), (0, 50), (0, 20)], 4.0)
    assert len(ring) > 66 and all(math.isfinite(v) for p in ring for v in p) and math.isfinite(found.cx) and found.area > 50 * 8
