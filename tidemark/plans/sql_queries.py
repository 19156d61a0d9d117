"""Queries written in SQL text, with named arguments, on the functions that the session has registered."""

from __future__ import annotations

from tidemark.functions import sql
from tidemark.plans import change_queries as change, profile_queries as profile
from tidemark.plans.stand_ins import profiles, r6, series


def sql_map_subset(spark, sf):
    sql.register(spark, results=change.results(spark, sf))
    text = f"SELECT gt_family, cluster_id, {r6('NSM')} AS NSM, {r6('LRR')} AS LRR FROM setup_rows(:size, :tolerance, :least, :most)"
    return spark.sql(text, args={"size": 18, "tolerance": 0.75, "least": -20.0, "most": 20.0})


def sql_dsas_lci(spark, sf):
    sql.register(spark, confidence=0.9)
    text = f"""WITH days AS (SELECT gt_family, cluster_id, acq_date, avg(bluff_x) AS x FROM {{series}} WHERE acq_date IS NOT NULL AND bluff_x IS NOT NULL GROUP BY ALL),
        fits AS (SELECT gt_family, cluster_id, count(*) AS n, date_diff(max(acq_date), min(acq_date)) AS span, regr_sxx(x, year_fraction(acq_date)) AS sxx,
                        regr_syy(x, year_fraction(acq_date)) AS syy, regr_sxy(x, year_fraction(acq_date)) AS sxy FROM days GROUP BY gt_family, cluster_id),
        bounds AS (SELECT *, CASE WHEN n >= 3 AND span >= :span THEN t_critical(n - 2) * sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0) / (n - 2)) / sqrt(sxx) END AS LCI FROM fits)
        SELECT gt_family, cluster_id, {r6('LCI')} AS LCI FROM bounds"""
    return spark.sql(text, args={"span": 365}, series=series(spark, sf))


def sql_crossings(spark, sf):
    sql.register(spark, points=profiles(spark, sf))
    return spark.sql(f"SELECT gt_family, beam_id, acq_date, {r6('bluff_x')} AS bluff_x FROM profile_crossings(:height)", args={"height": 0.25})


def sql_geodesic(spark, sf):
    """Metres on the ellipsoid between a user's places one after the other, and on the sphere from the first, both in centimetres."""
    sql.register(spark)
    text = """WITH steps AS (SELECT event_id, latitude, longitude, lag(latitude) OVER w AS lat0, lag(longitude) OVER w AS lon0 FROM {places} WINDOW w AS (PARTITION BY user_id ORDER BY -latitude, event_id))
        SELECT event_id, CAST(floor(coalesce(geodesic_m(lat0, lon0, latitude, longitude), 0) * :scale + 0.5) AS BIGINT) AS centimetres FROM steps"""
    return spark.sql(text, args={"scale": 100.0}, places=profile.places(spark, sf))


QUERIES = {f.__name__: f for f in (sql_map_subset, sql_dsas_lci, sql_crossings, sql_geodesic)}

SQL = {
    "sql_map_subset": change.SQL["map_subset"],
    "sql_dsas_lci": change.SQL["dsas_lci"],
    "sql_crossings": f"SELECT gt_family, beam_id, acq_date, bluff_x FROM ({profile.SQL['crossing_first']})",
    "sql_geodesic": f"WITH {profile.GEODESIC} SELECT event_id, CAST(floor(coalesce(step, 0) * 100 + 0.5) AS BIGINT) AS centimetres FROM geodesic",
}
