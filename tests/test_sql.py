"""Functions in SQL text against the Column functions."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geodesy, numeric, sql
from tidemark.operators import profiles, student


def test_scalars_agree_with_columns(spark):
    made = sql.register(spark, confidence=0.9)
    assert {"haversine_m", "geodesic_m", "t_critical", "acute_angle", "year_fraction"} <= set(made)
    rows = [(70.1, -150.2, 70.2, -149.9, 3.0, 1), (0.0, 0.0, 0.0, 0.0, 0.0, 0), (-33.5, 179.9, -33.4, -179.9, 301.5, 400), (None, 1.0, 2.0, 3.0, None, None)]
    table = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, n int").withColumn("day", F.make_date(F.lit(2020), F.lit(12), F.lit(31)))
    names = ["a", "b", "c", "d"]
    columns = [F.col(c) for c in names]
    want = table.select(
        (geodesy.haversine_km(*columns) * 1000).alias("h"), geodesy.geodesic_m(*columns).alias("g"), geodesy.wrapped_longitude(F.col("e")).alias("w"), numeric.year_fraction(F.col("day")).alias("y"),
        geodesy.acute_angle(*columns).alias("t"), student.tcrit(0.9, F.col("n")).alias("q"),
    )
    table.createOrReplaceTempView("sql_cases")
    got = spark.sql("SELECT haversine_m(a, b, c, d) AS h, geodesic_m(a, b, c, d) AS g, wrapped_longitude(e) AS w, year_fraction(day) AS y, acute_angle(a, b, c, d) AS t, t_critical(n) AS q FROM sql_cases")
    for p, q in zip(got.collect(), want.collect()):
        for x, y in zip(p, q):
            assert x is None and y is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    assert got.first().q == pytest.approx(6.313752, abs=1e-6)  # printed tables, one degree of freedom, 90 %
    with pytest.raises(ValueError):
        sql.register(spark, confidence=1.0)


def test_table_functions_with_named_arguments(spark):
    points = [("a", 0.0, 1.0), ("a", 2.0, 5.0), ("a", 2.0, 5.0), ("a", 4.0, 1.0), ("b", 1.0, 3.0), ("b", 9.0, 3.0), ("b", 2.0, 3.0), ("c", 1.0, 3.0), ("d", 1.0, 0.0), ("d", 2.0, float("nan")), ("d", None, 9.0), ("d", 3.0, 1.0)]
    table = spark.createDataFrame(points, "beam_id string, distance_from_offshore double, h_li double")
    results = spark.createDataFrame([(18, 0.5, -3.0), (18, 0.5, None), (18, 0.5, -40.0), (24, 0.5, -3.0)], "ClusterSize int, bias_tolerance double, LRR double")
    sql.register(spark, points=table, results=results, keys=("beam_id",))
    for height in (3.0, 1.0, 100.0):
        got = {r.beam_id: r.bluff_x for r in spark.sql("SELECT * FROM profile_crossings(:height)", args={"height": height}).collect()}
        assert got == {r.beam_id: r.bluff_x for r in profiles.crossings(table, ["beam_id"], F.lit(height)).collect()}
    rows = spark.sql("SELECT LRR FROM setup_rows(:size, :tolerance, least => -20, most => 20)", args={"size": 18, "tolerance": 0.5}).collect()
    assert [r.LRR for r in rows] == [-3.0]


def test_flat_profiles_give_the_median_of_distinct_points(spark):
    table = spark.createDataFrame([("a", float(x), 500.004) for x in (1, 1, 1, 2, 7, 9)] + [("b", float(x), 500.004) for x in (5, 5, 1, 3)], "beam_id string, distance_from_offshore double, h_li double")
    got = {r.beam_id: r.bluff_x for r in profiles.crossings(table, ["beam_id"], F.lit(500.0)).collect()}
    assert got == {"a": 4.5, "b": 3.0}
