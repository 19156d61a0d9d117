"""Worked examples, by hand, of every operator's rule."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import geodesy, names, numeric
from tidemark.operators import aoi, bias, change, clusters, planar, profiles, qa, quality, quantiles, spatial, student
from tidemark.params import Params
from tidemark.plans.merge import upsert
from tidemark.sources.shapefile import dbf_rows
from tidemark.sources.tables import conform

day = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def profile(spark, xs, hs, **extra):
    return spark.createDataFrame([("p", float(x), None if h is None else float(h)) for x, h in zip(xs, hs)], "beam_id string, distance_from_offshore double, h_li double")


@pytest.mark.parametrize("xs, hs, want", [((500, 600), (1, 3), 2.0), ((100, 200), (7, 8), 8.0), ((600, 700), (4, 9), 4.0), ((500, 600), (1, None), None), ((550, 550, 600), (1, 3, 9), 2.0)])
def test_interpolation(spark, xs, hs, want):
    assert profiles.at_distance(profile(spark, xs, hs), ["beam_id"], 550.0).first().value == want


@pytest.mark.parametrize(
    "xs, hs, ref, which, want",
    [
        ((0, 10, 20, 30), (0, 2, 4, 1), 3.0, "first", 15.0), ((0, 10, 20, 30), (0, 2, 4, 1), 3.0, "last", 70 / 3), ((0, 10, 20, 30), (0, 2, 3, 1), 2.0, "last", 10.0),
        ((0, 10, 20, 30), (0, 4, 1, 2), 2.0, "first", 30.0), ((0, 100), (0, 10), 5.0, "first", 50.0), ((0, 10, 20), (1, 2, 3), 9.0, "first", None), ((0,), (1,), 1.0, "first", None),
    ],
)
def test_crossings(spark, xs, hs, ref, which, want):
    got = profiles.crossings(profile(spark, xs, hs), ["beam_id"], F.lit(ref), which).first().bluff_x
    assert got is want or got == pytest.approx(want)


def test_gaps_are_no_barrier_unless_asked(spark):
    table = profile(spark, (0, 100), (0, 10))
    assert profiles.crossings(table, ["beam_id"], F.lit(5.0), respect_gaps=True).first().bluff_x is None
    with pytest.raises(ValueError):
        profiles.crossings(table, ["beam_id"], F.lit(5.0), "middle")


def stats(spark, rows):
    return change.statistics(spark.createDataFrame([(1, d, float(x)) for d, x in rows], "k int, acq_date date, bluff_x double"), ["k"]).first()


def test_change_statistics(spark):
    r = stats(spark, [(day(2019, 1, 1), 100), (day(2020, 1, 1), 110), (day(2021, 1, 1), 120)])
    assert (r.NSM, r.SCE, r.TemporalSpan_days, r.ValidRegression) == (-20, -20, 731, True)
    assert (r.EPR, r.LRR, r.LR2) == (pytest.approx(-9.993160, abs=1e-6), pytest.approx(-10, abs=0.01), pytest.approx(1, abs=1e-6))
    r = stats(spark, [(day(2019, 1, 1), 100), (day(2020, 1, 1), 110), (day(2021, 1, 1), 111)])
    assert r.EPR == pytest.approx(-5.496238, abs=1e-6) and r.LRR == pytest.approx(-5.5, abs=0.01) and r.LCI == pytest.approx(33.0117, abs=0.05)
    r = stats(spark, [(day(2020, 1, 1), 5), (day(2020, 7, 1), 8)])
    assert (r.NSM, r.SCE, r.TemporalSpan_days, r.EPR, r.LRR, r.LCI, r.ValidRegression) == (-3, -3, 182, None, None, None, False)
    r = stats(spark, [(day(2020, 1, 1), 4), (day(2020, 1, 1), 6)])
    assert (r.NSM, r.TemporalSpan_days, r.ValidRegression) == (None, None, False)
    r = stats(spark, [(day(2019, 1, 1), 10), (day(2020, 1, 1), 4)])
    assert (r.NSM, r.SCE, r.TemporalSpan_days, r.LRR) == (6, -6, 365, None) and r.EPR == pytest.approx(6.004110, abs=1e-6)


def test_student_quantiles():
    assert [round(student.quantile(0.975, k), 4) for k in (1, 2, 10, 30)] == [12.7062, 4.3027, 2.2281, 2.0423]


def test_student_beyond_the_table(spark):
    assert one(spark, student.tcrit(0.95, F.lit(2000))) == pytest.approx(student.quantile(0.975, 2000), abs=1e-8)


def candidate_table(spark, sets):
    rows = [("gt1", f"s{k}", k, [("gt1", b) for b in beams], len(beams)) for k, beams in sets.items()]
    return spark.createDataFrame(rows, "gt_family string, beam_id string, cluster_id int, beam_ids array<struct<gt_family:string,beam_id:string>>, num_beams int")


@pytest.mark.parametrize("least, skipped, few", [(1, 2, 0), (2, 1, 1)])
def test_greedy_selection(spark, least, skipped, few):
    table = candidate_table(spark, {1: "abc", 2: "ab", 3: "cd", 4: "d"})
    marked, report = clusters.select(table, least)
    assert sorted(r.cluster_id for r in marked.where("selected").collect()) == [1, 3]
    r = report.first()
    assert (r.selected_clusters, r.skipped_clusters, r.too_few_beams, r.representative_cluster_id) == (2, skipped, few, 1)


def test_along_track(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 3.0, 4.0), ("a", 6.0, 8.0), ("b", 1.0, 1.0)], "beam_id string, x double, y double")
    got = {(r.x, r.y): (r.point_id, r.distance_from_offshore) for r in profiles.along_track(points, ["beam_id"]).collect()}
    assert got == {(6.0, 8.0): (0, 0.0), (3.0, 4.0): (1, 5.0), (0.0, 0.0): (2, 10.0)}


def test_quality_flags(spark):
    rows = [("gt1", "a", 0.0, 0.0, 20.0)] * 10 + [("gt1", "b", 46.0, 0.0, 20.01)] * 10 + [("gt1", "c", 200.0, 0.0, -20.01)] * 4
    got = {r.beam_id: r for r in quality.beam_flags(spark.createDataFrame(rows, "gt_family string, beam_id string, x double, y double, h_li double")).collect()}
    assert [got[b].few_points for b in "abc"] == [False, False, True]
    assert [got[b].elev_trash for b in "abc"] == [False, True, True]
    assert [(got[b].nearest_dist, got[b].too_far) for b in "abc"] == [(46.0, False), (46.0, False), (154.0, True)]
    assert got["c"].status == "elev_trash" and got["a"].status == "loaded"


def test_bias_baseline_is_the_latest_interpolable_date(spark):
    rows = [("gt1", 1, "s", "s", day(2019, 1, 1), 500.0, 1.0), ("gt1", 1, "s", "s", day(2019, 1, 1), 600.0, 1.0), ("gt1", 1, "s", "s", day(2021, 1, 1), 500.0, 2.0), ("gt1", 1, "s", "s", day(2021, 1, 1), 600.0, 2.0)]
    rows += [("gt1", 1, "s", "s", day(2022, 1, 1), 500.0, 9.0), ("gt1", 1, "s", "t", day(2020, 1, 1), 500.0, 2.5), ("gt1", 1, "s", "t", day(2020, 1, 1), 600.0, 2.5)]
    points = spark.createDataFrame(rows, "gt_family string, cluster_id int, reference_beam string, beam_id string, acq_date date, distance_from_offshore double, h_li double")
    got = bias.keep(bias.evaluate(points, ["gt_family", "cluster_id"]), [0.5]).collect()
    assert sorted((r.beam_id, str(r.acq_date), r.bias, r.keep) for r in got) == [("s", "2019-01-01", 0.0, True), ("s", "2021-01-01", 0.0, True), ("s", "2022-01-01", 0.0, True), ("t", "2020-01-01", 0.5, True)]


def test_acute_angle(spark):
    assert one(spark, geodesy.acute_angle(*[F.lit(v) for v in (1.0, 0.0, -1.0, 1.0)])) == pytest.approx(45.0)
    assert one(spark, geodesy.acute_angle(*[F.lit(v) for v in (0.0, 0.0, 1.0, 0.0)])) is None


def test_box_is_closed(spark):
    box = spark.createDataFrame([("gt1", 0.0, 0.0, 0.0, 1.0, 300.0, 300.0)], "gt_family string, cross_x double, cross_y double, tx double, ty double, half_along double, half_across double")
    points = spark.createDataFrame([("gt1", 300.0, 0.0), ("gt1", 300.1, 0.0)], "gt_family string, x double, y double")
    assert [r.x for r in planar.clip(points, box).collect()] == [300.0]


def test_names(spark):
    n = F.lit("ATL06_0129_gt1l_20190105")
    assert one(spark, F.struct(names.acquisition_date(n).alias("d"), names.family(n).alias("f"), names.track_number_legacy(n).alias("t"))) == (day(2019, 1, 5), "gt1", "0129")
    odd = F.lit("ATL06_20190105_01290203_007")
    assert one(spark, F.struct(names.acquisition_date(odd).alias("d"), names.family(odd).alias("f"), names.track_number_legacy(odd).alias("t"))) == (day(129, 2, 3), None, "2019")
    assert one(spark, names.reference_track(F.lit("ATL03_20190105212430_01290203_007_01.h5"))) == "0129"
    assert [one(spark, names.track_normalised(F.lit(v))) for v in ("129", "0129", "abc", "12345")] == ["0129", "0129", "abc", "12345"]
    assert [one(spark, geodesy.wrapped_longitude(F.lit(v))) for v in (190.0, -190.0)] == [-170.0, 170.0]


def test_distances_and_projections(spark):
    d = lambda *v: one(spark, geodesy.haversine_km(*[F.lit(float(x)) for x in v]))
    assert d(70, -150, 71, -150) == pytest.approx(111.194927, abs=1e-6) and d(70, -150, 70, -149) == pytest.approx(38.030479, abs=1e-6)
    p = one(spark, geodesy.utm(F.lit(0.0), F.lit(-144.0)))
    assert (p.x, p.y) == (pytest.approx(833978.5569, abs=1e-3), pytest.approx(0, abs=1e-6))
    assert one(spark, geodesy.utm(F.lit(45.0), F.lit(-147.0))).y == pytest.approx(4982950.4002, abs=1e-3)
    assert one(spark, geodesy.geodesic_m(*[F.lit(float(v)) for v in (0, 0, 0, 1)])) == pytest.approx(111319.4908, abs=1e-3)
    assert one(spark, geodesy.geodesic_m(*[F.lit(float(v)) for v in (0, 0, 1, 0)])) == pytest.approx(110574.3886, abs=1e-3)
    back = one(spark, geodesy.utm_inverse(geodesy.utm(F.lit(70.3), F.lit(-148.9))["x"], geodesy.utm(F.lit(70.3), F.lit(-148.9))["y"]))
    assert (back.lat, back.lon) == (pytest.approx(70.3, abs=1e-9), pytest.approx(-148.9, abs=1e-9))


def test_suspicious_reasons(spark):
    row = spark.createDataFrame([(5.0, -6.0, 1.0, 1.0, 400, 1.1, 50.0)], "NSM double, SCE double, EPR double, LRR double, TemporalSpan_days int, ClusterTemporalSpanYears double, angle_deg double")
    assert qa.suspicious(row).first().suspicious_reason == "NSM >= 0 (should be negative), angle_deg < 60"


def test_upsert_keeps_the_fresh_row(spark):
    old, new = spark.createDataFrame([("k", 1)], "k string, NSM int"), spark.createDataFrame([("k", 2)], "k string, NSM int")
    assert [tuple(r) for r in upsert(old, new, ["k"]).collect()] == [("k", 2)]


def test_spacing(spark):
    lines = spark.createDataFrame([("gt1", str(x), 0, float(x), 0.0, float(x), 10.0, 10.0, 0.0) for x in (0, 10, 40)], "gt_family string, beam_id string, seg int, x0 double, y0 double, x1 double, y1 double, len double, cum double")
    r = planar.beam_spacing(lines).first()
    assert (r.n_beams, r.max_dist, r.avg_dist, r.west_beam, r.east_beam) == (3, 40.0, 20.0, "0", "40")


def test_rounding_helpers(spark):
    assert one(spark, numeric.finite(F.lit("nan"))) is None and one(spark, numeric.finite(F.lit("1.5"))) == 1.5
    assert one(spark, numeric.is_close(F.lit(1.0), F.lit(1.0005), 1e-3))


def test_conform_adds_and_casts(spark):
    table = spark.createDataFrame([("0129", "x", float("nan"))], "track_id string, NSM string, SCE double")
    r = conform(table, "track_id string, NSM double, SCE double, EPR double").first()
    assert tuple(r) == ("0129", None, None, None)


def test_dbf_reader():
    fields = [(b"longitude", b"N", 12), (b"h_li", b"N", 8), (b"gt", b"C", 4)]
    head = b"\x03\0\0\0" + (2).to_bytes(4, "little") + (32 + 32 * 3 + 1).to_bytes(2, "little") + (25).to_bytes(2, "little") + b"\0" * 20
    head += b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([size]) + b"\0" * 15 for n, t, size in fields) + b"\r"
    rows = b" " + b"-147.5".rjust(12) + b"1.25".rjust(8) + b"gt1l" + b" " + b"".rjust(12) + b"x".rjust(8) + b"gt2r"
    assert dbf_rows(head + rows) == [{"longitude": -147.5, "h_li": 1.25, "gt": "gt1l"}, {"longitude": None, "h_li": None, "gt": "gt2r"}]


def test_aoi_is_closed_counter_clockwise_and_wrapped():
    ring = aoi.normalised([[(0.0, 0.0)], [(190.0, 0.0), (190.0, 1.0), (191.0, 1.0), (191.0, 0.0)]])
    assert ring[0] == ring[-1] and aoi.area(ring[:-1]) > 0 and {x for x, _ in ring} == {-170.0, -169.0}
    assert len(aoi.normalised([[(1.0, 2.0)]])) == 65


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=2, max_size=12))
def test_nearest_other_is_the_nearest(spark, places):
    table = spark.createDataFrame([("g", str(k), float(x), float(y)) for k, (x, y) in enumerate(places)], "g string, k string, x double, y double")
    got = {r.k: r.nearest_dist for r in spatial.nearest_other(table, "g", "k", 2).collect()}
    for k, a in enumerate(places):
        assert got[str(k)] == pytest.approx(min(math.dist(a, b) for j, b in enumerate(places) if j != k))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(-20, 20)), min_size=2, max_size=15, unique_by=lambda p: p[0]), st.integers(-20, 20))
def test_crossing_lies_where_the_sign_changes(spark, points, ref):
    points.sort()
    got = profiles.crossings(profile(spark, *zip(*points)), ["beam_id"], F.lit(float(ref))).first().bluff_x
    spans = [(a[0], b[0]) for a, b in zip(points, points[1:]) if (a[1] - ref) * (b[1] - ref) <= 0]
    assert (got is None) == (not spans) and (got is None or any(a <= got <= b for a, b in spans))


def test_nearest_other_whatever_the_density(spark):
    draw = random.Random(4)
    heap = [(draw.gauss(0, 0.001), draw.gauss(0, 0.001)) for _ in range(300)]
    spread = [(draw.uniform(-1e6, 1e6), draw.uniform(-1e6, 1e6)) for _ in range(60)]
    places = [*heap, *spread, heap[0], heap[0], (1e-9, 1e-9), (2e-9, 1e-9)]
    rows = [(g, k, x, y) for g in ("a", None) for k, (x, y) in enumerate(places)] + [("lonely", 1, 5.0, 5.0), ("nowhere", 1, None, 1.0), ("pair", 1, 0.0, 0.0), ("pair", 2, 3.0, 4.0)]
    table = spark.createDataFrame(rows, "g string, k int, x double, y double")
    tree = spatial.cell_tree(table.where("x IS NOT NULL"), ["g"]).where("g = 'a'")
    assert tree.count() == len(places) and tree.agg(F.max("level") - F.min("level")).first()[0] > 5
    got = {(r.g, r.k): r.nearest_dist for r in spatial.nearest_other(table, "g", "k").collect()}
    assert len([k for k in got if k[0] == "a"]) == len(places) and ("lonely", 1) not in got and ("nowhere", 1) not in got and got["pair", 1] == 5.0
    for k, a in enumerate(places):
        assert got["a", k] == pytest.approx(min(math.dist(a, b) for j, b in enumerate(places) if j != k), rel=1e-9)


@pytest.mark.parametrize("gather", [50_000, 5, 0])
def test_exact_quantiles(spark, gather):
    draw = random.Random(6)
    values = [draw.choice([draw.gauss(0, 1), -1e-300 * draw.random(), 1e300 * draw.random(), 2.5, -0.0, 0.0, -7.25]) for _ in range(400)]
    rows = [(v, abs(v), None, float("inf") if k < 3 else float(k)) for k, v in enumerate(values)] + [(None, None, None, None), (float("nan"), 1.0, None, 1.0)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    shares = (0.0, 0.01, 0.25, 0.5, 0.6123, 1.0)
    got = quantiles.exact_quantiles(table, {c: F.col(c) for c in "abcd"}, shares, gather)
    for name, held in (("a", values), ("b", [*map(abs, values), 1.0])):
        held = sorted(held)
        for share, value in zip(shares, got[name]):
            at = share * (len(held) - 1)
            low, high = held[int(at)], held[min(int(at) + 1, len(held) - 1)]
            assert value == pytest.approx(low + (at - int(at)) * (high - low), rel=1e-12, abs=0)
    assert got["c"] == [None] * 6 and got["d"][0] == 1.0 and got["d"][-1] == float("inf")


def even_odd(ring, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def test_areas_are_repaired(spark):
    bow = aoi.repaired([(0, 0), (4, 4), (4, 0), (0, 3)])
    assert [round(aoi.area(r), 9) for r in bow] == sorted([round(aoi.area(r), 9) for r in bow], reverse=True) and len(bow) == 2 and all(len(r) == 3 for r in bow)
    assert [aoi.area(r) for r in aoi.repaired([(0, 0), (4, 0), (4, 4), (2, 4), (2, 9), (2, 4), (0, 4)])] == [16]  # a spike
    # Two squares that touch in a corner, walked as one ring; a ring walked twice encloses nothing an odd number of times.
    assert sorted(aoi.area(r) for r in aoi.repaired([(0, 0), (2, 0), (2, 2), (5, 2), (5, 5), (2, 5), (2, 2), (0, 2)])) == [4, 9]
    assert aoi.repaired([(0, 0), (2, 0), (2, 2)] * 2) == [] == aoi.repaired([(0, 0), (1, 1), (2, 2)]) == aoi.repaired([(1, 1)])
    assert aoi.repaired([(0, 0), (0, 2), (2, 2), (2, 0)]) == [[(2, 0), (2, 2), (0, 2), (0, 0)]]
    draw = random.Random(9)
    for _ in range(60):
        ring = [(draw.randint(0, 9), draw.randint(0, 9)) for _ in range(draw.randint(3, 9))]
        fixed = aoi.repaired(ring)
        for r in fixed:
            assert aoi.area(r) > 0 and aoi._noded(r)[1]
        for _ in range(40):
            x, y = draw.uniform(0, 9), draw.uniform(0, 9)
            if even_odd(ring, x, y):
                assert any(even_odd(r, x, y) for r in fixed)
    assert aoi.hull([(0, 0), (2, 0), (1, 0), (2, 2), (1, 1), (0, 2), (0, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_areas_of_interest_of_any_kind(spark):
    round_ = aoi.normalised([[(1.0, 2.0)]])
    assert len(round_) == 65 and all(math.dist(p, (1.0, 2.0)) == pytest.approx(0.001) for p in round_)
    line = aoi.normalised([[(0.0, 0.0), (0.0, 1.0)]], buffer=0.1)
    assert aoi.area(line[:-1]) == pytest.approx(0.2 + math.pi * 0.01, rel=0.01)
    tie = aoi.normalised([[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]])
    assert len(tie) == 4 and aoi.area(tie[:-1]) == 1.0
    parts = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (9.0, 5.0), (9.0, 9.0), (5.0, 9.0)]]
    assert aoi.area(aoi.normalised(parts)[:-1]) == 16.0 and len(aoi.normalised(parts, collection=True)) == 6
    with pytest.raises(ValueError):
        aoi.normalised([[]])


def test_params_are_frozen_and_arguments_win():
    p = Params()
    assert p.ideal_case == 48 and p.with_values(n_cycles=2).ideal_case == 4
    with pytest.raises(Exception):
        p.min_beams = 3


def test_student_quantiles_are_those_of_the_printed_table():
    # 0.975 quantiles for 1 to 30 degrees of freedom, as printed.
    table = [
        12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450,
        2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
    ]
    assert all(abs(a - b) < 1e-6 for a, b in zip(student.critical(0.95), table))


@pytest.mark.parametrize("shore_angle", [30.0, 90.0, 150.0, 0.0])
def test_cluster_angle(spark, shore_angle):
    """A beam from south to north meets, or comes near, a straight shore at a known angle; another shore lies far off.

    The corridor's two half circles have 33 vertices each; the first of all, at
    the left of the beam's start, closes the ring and counts twice.
    """
    caps = [(9 * math.cos(math.pi * k / 32), 90 + 9 * math.sin(math.pi * k / 32)) for k in range(33)] + [(-9 * math.cos(math.pi * k / 32), -9 * math.sin(math.pi * k / 32)) for k in range(33)]
    held = np.array([*caps, (-9.0, 0.0)])
    values, vectors = np.linalg.eigh(np.cov(held.T))
    ax, ay = vectors[:, int(np.argmax(values))]
    want = math.degrees(math.acos(min(1, abs(ax * math.cos(math.radians(shore_angle)) + ay * math.sin(math.radians(shore_angle))))))
    turn = math.radians(shore_angle)
    points = spark.createDataFrame([("gt1", "a", 5.0, float(y)) for y in range(0, 100, 10)] + [("gt1", "b", 9000.0, float(y)) for y in range(0, 100, 10)], "gt_family string, beam_id string, x double, y double")
    along = [(t * math.cos(turn), 50 + t * math.sin(turn)) for t in range(-300, 301, 20)]
    vertices = spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate(along)] + [(1, k, 50_000.0 + k, -7.0 * k) for k in range(5)], "part int, seq int, x double, y double")
    lines = planar.beam_lines(points)
    seeds = spark.createDataFrame([("gt1", b, k, 18.0) for k, b in enumerate("ab")], "gt_family string, beam_id string, cluster_id int, cluster_distance_m double")
    got = {r.beam_id: r.angle_deg for r in clusters.angles(seeds, lines, planar.segments(vertices, ["part"], ["seq"])).collect()}
    assert got == {"a": pytest.approx(want, abs=0.01), "b": pytest.approx(want, abs=0.01)}
