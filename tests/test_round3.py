"""What the findings of round 3 came from, on small inputs."""

import ast
import datetime
import inspect
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bias, clusters, planar, spatial
from tidemark.plans import change_queries, profile_queries, space_queries, sql_queries
from tidemark.sources.staging import staged


@pytest.mark.parametrize("module", [change_queries, profile_queries, space_queries, sql_queries])
def test_no_function_of_a_query_module_is_defined_twice(module):
    names = Counter(node.name for node in ast.parse(inspect.getsource(module)).body if isinstance(node, ast.FunctionDef))
    assert not [name for name, n in names.items() if n > 1]


def _largest_method(table):
    """Bytes of the largest method that Spark generates for a plan; over 8,000 the virtual machine never compiles it."""
    stats = table._jdf.queryExecution().debug().codegenToSeq()
    return max(stats.apply(k)._3().maxMethodCodeSize() for k in range(stats.size()))


@pytest.fixture
def still(spark):
    """The session with plans that do not change while they run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def _crossed(spark, n=60):
    """Lines of one to three pieces, short and long, at random and alongside each other."""
    rng = random.Random(3)
    rows = []
    for k in range(n):
        x, y, seq = rng.uniform(0, 300), rng.uniform(0, 300), 0
        for _ in range(rng.choice([2, 3, 4])):
            rows.append((f"gt{k % 3 + 1}", str(k), float(seq), x, y))
            step = rng.choice([3, 20, 250])
            x, y, seq = x + rng.uniform(-step, step), y + rng.choice([0.0, rng.uniform(-step, step)]), seq + 1
    points = spark.createDataFrame(rows, "gt_family string, beam_id string, seq double, x double, y double")
    return planar.segments(points, ["gt_family", "beam_id"], ["seq"])


def test_pair_distances_as_by_comparing_all(spark):
    lines = staged(_crossed(spark))
    other = lines.select(*[F.col(c).alias(f"o{c}") for c in ("gt_family", "beam_id", "x0", "y0", "x1", "y1")])
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1", "ox0", "oy0", "ox1", "oy1")]
    apart = F.when(F.col("beam_id") == F.col("obeam_id"), F.lit(0.0)).otherwise(spatial.segment_segment(*ends))
    both = lines.crossJoin(other).groupBy("gt_family", "beam_id", "ogt_family", "obeam_id").agg(F.min(apart).alias("dist")).where("dist <= 21")
    want = {tuple(r[:4]): r.dist for r in both.collect()}
    rows = clusters.pair_distances(lines, 21.0).select("gt_family", "beam_id", "other_family", "other_beam", "dist").collect()
    got = {tuple(r[:4]): r.dist for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(got) > 100
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pair_distances_are_compiled(still):
    assert _largest_method(clusters.pair_distances(staged(_crossed(still)), 21.0)) < 8000


def test_places_on_a_long_line_meet_its_segments_by_stretches(spark, capsys):
    rng = random.Random(1)
    xs = [0.0]
    for _ in range(300):
        xs.append(xs[-1] + rng.choice([0.0, 0.5, 1.0, 30.0]))
    shore = planar.segments(spark.createDataFrame([(0, k, x, 2.0) for k, x in enumerate(xs)], "part int, seq int, x double, y double"), ["part"], ["seq"])
    at = [-5.0, 0.0, xs[-1], xs[-1] + 9, *[rng.uniform(0, xs[-1]) for _ in range(200)], *xs[::7]]
    found = planar.at_length(staged(shore), ["part"], spark.createDataFrame([(0, k, a) for k, a in enumerate(at)], "part int, k int, at double"))
    got = {(r.k, round(r.px, 6), r.py) for r in found.collect()}
    assert got == {(k, round(min(max(a, 0.0), xs[-1]), 6), 2.0) for k, a in enumerate(at)}
    found.explain()
    assert "__stretch" in capsys.readouterr().out


@pytest.fixture
def passes(spark, monkeypatch):
    """Small profiles in place of the line items', and the row counts of what queries on them stage."""
    rng = random.Random(5)
    days = [None, *[datetime.date(y, 1, 1) for y in (1993, 1994, 1995, 1996)]]
    rows = []
    for beam in range(1, 25):
        for family in ("gt1", "gt2"):
            for day in rng.sample(days[rng.random() < 0.8 :], 3):
                for _ in range(rng.choice([1, 2, 40])):
                    far, high = rng.choice([rng.uniform(300, 700), 550.0, 551.0, None]), rng.choice([rng.uniform(-3, 3), 0.0, None, float("nan")])
                    rows.append((family, str(beam), day, far, high))
    points = staged(spark.createDataFrame(rows, "gt_family string, beam_id string, acq_date date, distance_from_offshore double, h_li double"))
    counts = []

    def counted(table):
        out = staged(table)
        counts.append(out.count())
        return out

    monkeypatch.setattr(profile_queries, "profiles", lambda spark, sf: points)
    monkeypatch.setattr(profile_queries, "staged", counted)
    return points, counts


def _by_points(spark, points):
    """Biases, accepted points and edges with every point copied into the clusters that list its beam."""
    keys = profile_queries.KEYS
    listed = staged(profile_queries.stand_clusters(spark, None, points))
    inside = staged(bias.profiles_in(listed, points, keys))
    kept = staged(bias.keep(bias.evaluate(inside, keys), [2.0]))
    accepted = staged(bias.allowed(inside, kept, keys))
    return listed, kept, accepted, bias.bluffs(accepted, keys)


def _same(got, want):
    got, want = profile_queries._tidy(got), profile_queries._tidy(want)
    rows = sorted(map(str, got.select(*want.columns).collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) > 5


@pytest.mark.parametrize("name", ["bias_filter", "bias_summary", "used_cycles", "bluff_positions", "yref_oldest"])
def test_clusters_judge_passes_not_points(spark, passes, name):
    points, counts = passes
    keys = profile_queries.KEYS
    got = getattr(profile_queries, name)(spark, None)
    assert max(counts) * 3 < points.count()
    listed, kept, accepted, edges = _by_points(spark, points)
    want = {
        "bias_filter": lambda: kept, "bias_summary": lambda: bias.summary(kept, listed, keys), "bluff_positions": lambda: edges,
        "yref_oldest": lambda: edges.select(*keys, "ref_line").distinct(),
        "used_cycles": lambda: accepted.groupBy(*keys).agg(F.count_distinct("beam_id").alias("used_beams"), F.count_distinct("beam_id", "acq_date").alias("used_cycles")),
    }
    _same(got, want[name]())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_profiles_are_dealt_once_and_not_grouped_where_they_are_read(still):
    plan = profile_queries.interp_at_x0(still, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in plan.split("Exchange hashpartitioning")[1]
