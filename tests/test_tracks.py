"""Several tracks in one run, resumed sweeps, and the rules beside them."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bias, clusters, planar, quality
from tidemark.params import Params
from tidemark.plans import workflow
from tidemark.plans.space_queries import dated_tracks
from tidemark.plans.stand_ins import shore
from tidemark.sources.cache import SetupCache, content

SF = "/root/testdata/sf0.001"
P = Params(bias_x0=250.0)


def cells(table):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in table.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_two_tracks_in_one_run_equal_two_runs_and_a_sweep_resumes(spark):
    kept, report, flagged = quality.gate(dated_tracks(spark, SF), P)
    coast, both = shore(spark, SF), None
    single = workflow.metrics(workflow.run(kept, coast, "129", P), report)
    two = kept.crossJoin(spark.createDataFrame([("129",), ("0204",)], "track_id string"))
    reports = report.crossJoin(spark.createDataFrame([("0129",), ("0204",)], "track_id string"))
    flow = workflow.run(two, coast, None, P)
    both = workflow.metrics(flow, reports).cache()
    assert single.count() > 0 and both.columns == single.columns
    for track in ("0129", "0204"):
        assert cells(both.where(F.col("track_id") == track).drop("track_id")) == cells(single.drop("track_id"))
    drawn = bias.accepted_view(flow.accepted, flow.bluffs, workflow.SETUP)
    assert drawn.where("is_ref").count() > 0 and drawn.where("bluff_x IS NOT NULL").count() > 0
    # One setup of one track is there already, with a mark that must stay; the other track's is computed.
    existing = both.where("track_id = '0129'").withColumn("NSM", F.lit(-1.0))
    resumed = workflow.sweep(two, coast, None, reports, P, existing, sizes=(18.0,), tolerances=(0.5,))
    assert {r.NSM for r in resumed.where("track_id = '0129'").collect()} == {-1.0}
    assert cells(resumed.where("track_id = '0204'").select(both.columns)) == cells(both.where("track_id = '0204'"))
    assert workflow.sweep(two, coast, None, reports, P, both, sizes=(18.0,), tolerances=(0.5,)) is both


def test_operators_keep_tracks_apart(spark):
    rows = [(t, "gt1", b, x, y) for t, shift in (("0001", 0.0), ("0002", 5.0)) for b, x0 in (("a", 0.0), ("b", 8.0)) for x, y in ((x0 + shift, 0.0), (x0 + shift, 50.0))]
    points = spark.createDataFrame(rows, "track_id string, gt_family string, beam_id string, x double, y double")
    lines = planar.beam_lines(points)
    pairs = {(r.track_id, r.beam_id, r.other_beam): r.dist for r in clusters.pair_distances(lines, 10.0).collect()}
    assert pairs == {(t, a, b): (0.0 if a == b else 8.0) for t in ("0001", "0002") for a in "ab" for b in "ab"}
    found = clusters.candidates(points, lines, [18.0], 2, ("gt1",)).collect()
    assert sorted((r.track_id, r.beam_id, r.cluster_id) for r in found) == [(t, b, k) for t in ("0001", "0002") for k, b in enumerate("ab")]
    assert {r.track_id: r.center_x for r in planar.family_centers(points).collect()} == {"0001": 4.0, "0002": 9.0}


def test_numbers_without_tracks_follow_the_order(spark):
    from tidemark.operators.keys import numbered

    table = spark.range(500).select(((F.col("id") * 37) % 500).alias("v")).repartition(7)
    assert sorted((r.n, r.v) for r in numbered(table, [F.col("v")], "n").collect()) == [(k, k) for k in range(500)]


def test_an_empty_list_keeps_all_profiles(spark):
    day = dt.date(2020, 1, 1)
    points = spark.createDataFrame([("gt1", c, b, day) for c in (1, 2) for b in "st"], "gt_family string, cluster_id int, beam_id string, acq_date date")
    kept = spark.createDataFrame([("gt1", 1, "s", day, True), ("gt1", 1, "t", day, False), ("gt1", 2, "s", day, False)], "gt_family string, cluster_id int, beam_id string, acq_date date, keep boolean")
    got = sorted((r.cluster_id, r.beam_id) for r in bias.allowed(points, kept, ["gt_family", "cluster_id"]).collect())
    assert got == [(1, "s"), (2, "s"), (2, "t")]


def test_a_beam_along_the_shore_meets_it_in_the_middle(spark):
    lines = spark.createDataFrame([("gt1", 0, 0.0, 0.0, 0.0, 10.0), ("gt1", 1, 0.0, 10.0, 5.0, 20.0)], "gt_family string, seg int, x0 double, y0 double, x1 double, y1 double")
    coast = spark.createDataFrame([(0.0, 4.0, 0.0, 30.0), (-5.0, 2.0, 5.0, 2.0)], "x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.x, r.y, r.run) for r in planar.shore_crossings(lines, ["gt_family"], coast).collect())
    assert (0.0, 7.0, 6.0) in got and (0.0, 2.0, 0.0) in got


@pytest.mark.parametrize("seed", range(3))
def test_selection_is_that_of_the_loop(spark, seed):
    import random

    draw = random.Random(seed)
    sets = {k: [draw.choice("abcdefgh") for _ in range(draw.randrange(1, 5))] for k in range(30)}
    rows = [("gt1", f"s{k}", k, sorted({("gt1", b) for b in beams}), len(set(beams))) for k, beams in sets.items()]
    table = spark.createDataFrame(rows, "gt_family string, beam_id string, cluster_id int, beam_ids array<struct<gt_family:string,beam_id:string>>, num_beams int")
    covered, want = set(), []
    for _, _, k, beams, n in sorted(rows, key=lambda r: (-r[4], r[2])):
        if set(beams) - covered:
            want.append(k)
            covered |= set(beams)
    marked, report = clusters.select(table, 1)
    assert sorted(r.cluster_id for r in marked.where("selected").collect()) == sorted(want) and report.first().representative_cluster_id == want[0]


def test_steps_are_kept_across_runs(spark, tmp_path, monkeypatch):
    kept, coast = dated_tracks(spark, SF), shore(spark, SF)
    held = SetupCache(spark, str(tmp_path / "cache"))
    run = lambda cache, sizes, tolerances: cells(workflow.metrics(workflow.run(kept, coast, "129", P, sizes, tolerances, cache=cache)))
    run(held, (18.0,), (0.5,))
    made = {p.name for p in (tmp_path / "cache").iterdir()}
    assert {n.rsplit("-", 1)[0] for n in made if not n.startswith(".")} == {"boxes", "clipped", "lines", "candidates", "angles", "inside", "biases"}

    def never(*a, **b):
        raise AssertionError("computed again")

    with monkeypatch.context() as m:
        for module, name in ((clusters, "candidates"), (clusters, "angles"), (bias, "evaluate"), (planar, "boxes"), (planar, "beam_lines")):
            m.setattr(module, name, never)
        more = run(SetupCache(spark, str(tmp_path / "cache")), (18.0,), (0.5, 1.0))
    assert {p.name for p in (tmp_path / "cache").iterdir()} == made
    # One more size adds that size's steps; without a cache the rows are the same.
    wide = run(held, (18.0, 42.0), (0.5, 1.0))
    assert len({p.name for p in (tmp_path / "cache").iterdir()} - made) == 4 and more and set(more) < set(wide)
    assert wide == run(None, (18.0, 42.0), (0.5, 1.0))
    # The same rows in another order and other partitions are the same input.
    assert content(kept) == content(kept.repartition(5)) != content(kept.limit(kept.count() - 1)) and held.of(kept).inputs != held.of(coast).inputs


def test_a_step_that_fails_leaves_nothing(spark, tmp_path):
    held = SetupCache(spark, str(tmp_path / "cache"), "inputs")
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        held.table("step", {"size": 1}, lambda: broken)
    assert held.table("step", {"size": 1}, lambda: spark.range(3)).count() == 3 == held.table("step", {"size": 1}, lambda: broken).count()
    assert held.name("step", {"size": 1}) != held.name("step", {"size": 2})
