"""Queries on change statistics and on the checks of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded, year_fraction
from tidemark.operators import change, clusters, profiles, qa, student
from tidemark.plans.stand_ins import SERIES, r6, series
from tidemark.plans.merge import missing_setups, upsert

KEY = ["gt_family", "cluster_id"]


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return change.statistics(series(spark, sf), KEY)


def _tidy(table: DataFrame) -> DataFrame:
    """Doubles to six decimals, so that engines agree on the sum's last bits."""
    return table.withColumns({c: rounded(F.col(c)) for c, t in table.dtypes if t == "double"})


def dsas_metrics(spark, sf):
    return _tidy(stats(spark, sf))


def dsas_endpoint(spark, sf):
    return _tidy(stats(spark, sf).select(*KEY, "NSM", "EPR", "TemporalSpan_days", "first_date", "last_date"))


def dsas_regression(spark, sf):
    return _tidy(stats(spark, sf).select(*KEY, "LRR", "LR2", "LSE", "ValidRegression"))


def dsas_lci(spark, sf):
    return _tidy(change.statistics(series(spark, sf), KEY, confidence=0.9).select(*KEY, "LCI"))


def envelope(spark, sf):
    return _tidy(stats(spark, sf).select(*KEY, "SCE"))


def collapse_dates(spark, sf):
    return _tidy(change.collapsed(series(spark, sf), KEY))


def frac_year(spark, sf):
    return _tidy(series(spark, sf).select("acq_date", year_fraction(F.col("acq_date")).alias("year_fraction")).distinct())


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics with what the checks look at besides."""
    c = F.col("cluster_id")
    return stats(spark, sf).withColumns({
        "track_id": F.lpad((c % 4 + 129).cast("string"), 4, "0"), "ClusterSize": ((c % 7 + 1) * 6).cast("int"), "bias_tolerance": (c % 4 + 1) * F.lit(0.25),
        "angle_deg": F.when(c % 17 != 0, (c % 91).cast("double")), "ClusterTemporalSpanYears": F.col("TemporalSpan_days") / F.lit(365.25),
    })


def qa_profile(spark, sf):
    table = results(spark, sf)
    return qa.profile(table.select("track_id", "gt_family", "cluster_id", "ClusterSize", "angle_deg", "TemporalSpan_days", "ValidRegression")).drop("dtype")


def qa_health(spark, sf):
    return _tidy(qa.health(results(spark, sf)))


def qa_topn(spark, sf):
    return _tidy(qa.extremes(results(spark, sf), "NSM", KEY, top=True))


def qa_bottomn(spark, sf):
    return _tidy(qa.extremes(results(spark, sf), "LRR", KEY, top=False))


def qa_rules_v1(spark, sf):
    return qa.suspicious_simple(results(spark, sf)).select(*KEY, "suspicious")


def qa_rules_v2(spark, sf):
    return qa.suspicious(results(spark, sf)).select(*KEY, "suspicious", "suspicious_reason")


def qa_clean(spark, sf):
    return _tidy(qa.export_columns(qa.suspicious(results(spark, sf)).where("NOT suspicious")).select(*KEY, "NSM", "LRR"))


def qa_iqr(spark, sf):
    return qa.iqr_outliers(results(spark, sf)).select(*KEY, *[f"iqr_{m}" for m in qa.METRICS], "iqr_any")


def qa_mad(spark, sf):
    return _tidy(qa.robust_z(results(spark, sf)).select(*KEY, *[f"z_{m}" for m in qa.METRICS], "mad_any"))


def qa_most_negative(spark, sf):
    return _tidy(qa.most_negative(results(spark, sf), KEY))


def family_track(spark, sf):
    return clusters.family_track(results(spark, sf))


def qa_score(spark, sf):
    return _tidy(qa.top_outliers(results(spark, sf), KEY))


def qa_impossible(spark, sf):
    return _tidy(qa.possible(results(spark, sf)).select(*KEY, "LRR"))


def qa_breakdown(spark, sf):
    return qa.regression_breakdown(results(spark, sf))


def qa_distinct_keys(spark, sf):
    return qa.distinct_keys(results(spark, sf), ["track_id", "ClusterSize", "bias_tolerance", "gt_family"])


def resume_antijoin(spark, sf):
    table = results(spark, sf).select("ClusterSize", "bias_tolerance", "gt_family")
    return missing_setups(table.distinct(), table.where("gt_family = 'gt1'"), ["ClusterSize", "bias_tolerance", "gt_family"])


def upsert_keep_last(spark, sf):
    table = results(spark, sf).select(*KEY, "NSM")
    old, new = table.where("cluster_id % 3 <> 0"), table.where("cluster_id % 3 <> 1").withColumn("NSM", F.col("NSM") + 1)
    return _tidy(upsert(old, new, KEY))


def union_by_name(spark, sf):
    table = results(spark, sf)
    a, b = table.where("gt_family = 'gt1'").select(*KEY, "NSM"), table.where("gt_family = 'gt2'").select(*KEY, "SCE")
    return _tidy(a.unionByName(b, allowMissingColumns=True))


def set_ops(spark, sf):
    table = results(spark, sf)
    a, b = table.where("angle_deg >= 30").select("cluster_id"), table.where("ClusterSize <= 24").select("cluster_id")
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.exceptAll(b).withColumn("part", F.lit("first")))


def map_subset(spark, sf):
    """Rows of one setup with a rate in range, as a map shows them."""
    return _tidy(qa.setup_rows(results(spark, sf), 18, 0.75, -20.0, 20.0).select(*KEY, "NSM", "LRR"))


def advancing(spark, sf):
    return _tidy(profiles.advancing(change.collapsed(series(spark, sf), KEY), KEY).select(*KEY, "acq_date", "bluff_x"))


_FIT = f"""{SERIES},
    dated AS (SELECT gt_family, cluster_id, acq_date, avg(bluff_x) AS bluff_x, year(acq_date) + dayofyear(acq_date) / 365.25::DOUBLE AS t
              FROM series WHERE bluff_x IS NOT NULL AND acq_date IS NOT NULL GROUP BY gt_family, cluster_id, acq_date),
    fit AS (SELECT gt_family, cluster_id, count(*) AS n, min(acq_date) AS first_date, max(acq_date) AS last_date,
                   min_by(bluff_x, acq_date) AS x_first, max_by(bluff_x, acq_date) AS x_last, min(bluff_x) AS least, max(bluff_x) AS most,
                   regr_slope(bluff_x, t) AS slope, regr_r2(bluff_x, t) AS r2, regr_sxx(bluff_x, t) AS sxx, regr_syy(bluff_x, t) AS syy, regr_sxy(bluff_x, t) AS sxy
            FROM dated GROUP BY gt_family, cluster_id),
    spans AS (SELECT *, CASE WHEN n >= 2 THEN date_diff('day', first_date, last_date) END AS span FROM fit)"""


def _stats_sql(confidence: float) -> str:
    listed = ", ".join(f"({k}, {t!r}::DOUBLE)" for k, t in enumerate(student.critical(confidence), 1))
    return f"""{_FIT},
    tcrit(dof, t) AS (VALUES {listed}),
    stats AS (SELECT gt_family, cluster_id, CASE WHEN n >= 2 THEN x_first - x_last END AS NSM, CASE WHEN n >= 2 THEN least - most END AS SCE,
                     CASE WHEN span >= 365 THEN (x_first - x_last) / (span / 365.25::DOUBLE) END AS EPR,
                     CASE WHEN n >= 3 AND span >= 365 THEN -slope END AS LRR, CASE WHEN n >= 3 AND span >= 365 THEN r2 END AS LR2,
                     CASE WHEN n >= 3 AND span >= 365 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) END AS LSE,
                     CASE WHEN n >= 3 AND span >= 365 THEN tcrit.t * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) / sqrt(sxx) END AS LCI,
                     span AS TemporalSpan_days, coalesce(n >= 3 AND span >= 365, false) AS ValidRegression, first_date, last_date
              FROM spans LEFT JOIN tcrit ON dof = n - 2)"""


_STATS = _stats_sql(0.95)
_RESULTS = f"""{_STATS},
    results AS (SELECT *, lpad(CAST(cluster_id % 4 + 129 AS VARCHAR), 4, '0') AS track_id, CAST((cluster_id % 7 + 1) * 6 AS INT) AS ClusterSize,
                       (cluster_id % 4 + 1) * 0.25::DOUBLE AS bias_tolerance, CASE WHEN cluster_id % 17 <> 0 THEN CAST(cluster_id % 91 AS DOUBLE) END AS angle_deg,
                       TemporalSpan_days / 365.25::DOUBLE AS ClusterTemporalSpanYears FROM stats)"""


def _each(names) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


_RULES = [
    ("TemporalSpan_days <= 0 or missing", "TemporalSpan_days IS NULL OR TemporalSpan_days <= 0"),
    ("ClusterTemporalSpanYears <= 0 or missing", "ClusterTemporalSpanYears IS NULL OR ClusterTemporalSpanYears <= 0"),
    ("NSM missing", "NSM IS NULL"), ("NSM >= 0 (should be negative)", "NSM >= 0"), ("angle_deg missing", "angle_deg IS NULL"), ("angle_deg < 60", "angle_deg < 60"),
    ("|NSM| > 200", "abs(NSM) > 200"), ("|SCE| > 200", "abs(SCE) > 200"), ("|EPR| > 50", "abs(EPR) > 50"), ("|LRR| > 50", "abs(LRR) > 50"),
    ("Has inf", "isinf(NSM) OR isinf(SCE) OR isinf(EPR) OR isinf(LRR)"),
]
_REASON = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES) + ")"
_FULL = "full_rows AS (SELECT * FROM results WHERE NSM IS NOT NULL AND SCE IS NOT NULL AND EPR IS NOT NULL AND LRR IS NOT NULL)"
_M = qa.METRICS
_MAD = f"""{_RESULTS}, {_FULL},
    m AS (SELECT {', '.join(f'median({m}) AS m_{m}' for m in _M)} FROM full_rows),
    d AS (SELECT {', '.join(f'median(abs({m} - m_{m})) AS d_{m}' for m in _M)} FROM full_rows, m),
    z AS (SELECT full_rows.*, {', '.join(f'0.6745::DOUBLE * ({m} - m_{m}) / nullif(d_{m}, 0) AS z_{m}' for m in _M)} FROM full_rows, m, d),
    scored AS (SELECT *, greatest({', '.join(f'abs(z_{m})' for m in _M)}) AS outlier_score FROM z)"""
_PROFILED = ("track_id", "gt_family", "cluster_id", "ClusterSize", "angle_deg", "TemporalSpan_days", "ValidRegression")

QUERIES = {
    f.__name__: f
    for f in (
        dsas_metrics, dsas_endpoint, dsas_regression, dsas_lci, envelope, collapse_dates, frac_year, qa_profile, qa_health, qa_topn, qa_bottomn, qa_rules_v1, qa_rules_v2,
        qa_clean, qa_iqr, qa_mad, qa_score, qa_most_negative, family_track, qa_impossible, qa_breakdown, qa_distinct_keys, resume_antijoin, upsert_keep_last, union_by_name, set_ops, map_subset, advancing,
    )
}

SQL = {
    "dsas_metrics": f"WITH {_STATS} SELECT gt_family, cluster_id, {_each(change.METRICS)}, TemporalSpan_days, ValidRegression, first_date, last_date FROM stats",
    "dsas_endpoint": f"WITH {_STATS} SELECT gt_family, cluster_id, {_each(['NSM', 'EPR'])}, TemporalSpan_days, first_date, last_date FROM stats",
    "dsas_regression": f"WITH {_STATS} SELECT gt_family, cluster_id, {_each(['LRR', 'LR2', 'LSE'])}, ValidRegression FROM stats",
    "dsas_lci": f"WITH {_stats_sql(0.9)} SELECT gt_family, cluster_id, {_each(['LCI'])} FROM stats",
    "envelope": f"WITH {_STATS} SELECT gt_family, cluster_id, {_each(['SCE'])} FROM stats",
    "collapse_dates": f"WITH {_FIT} SELECT gt_family, cluster_id, acq_date, {_each(['bluff_x'])} FROM dated",
    "frac_year": f"WITH {SERIES} SELECT DISTINCT acq_date, {r6('year(acq_date) + dayofyear(acq_date) / 365.25::DOUBLE')} AS year_fraction FROM series",
    "qa_profile": f"WITH {_RESULTS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS nulls, floor((count(*) - count({c})) / count(*) * 10000 + 0.5) / 10000 AS null_pct, count(DISTINCT {c}) AS n_unique FROM results" for c in _PROFILED),
    "qa_health": f"WITH {_RESULTS} " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(*) AS n, count(*) FILTER ({m} IS NULL) AS nulls, count(*) FILTER (isinf({m})) AS infinite, {r6(f'min({m})')} AS least, {r6(f'quantile_cont({m}, 0.01)')} AS p01, {r6(f'quantile_cont({m}, 0.5)')} AS median, {r6(f'quantile_cont({m}, 0.99)')} AS p99, {r6(f'max({m})')} AS most FROM results" for m in _M),
    "qa_topn": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {_each(['NSM'])} FROM results ORDER BY results.NSM DESC NULLS LAST, gt_family, cluster_id LIMIT 15",
    "qa_bottomn": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {_each(['LRR'])} FROM results ORDER BY results.LRR ASC NULLS LAST, gt_family, cluster_id LIMIT 15",
    "qa_rules_v1": f"""WITH {_RESULTS} SELECT gt_family, cluster_id, coalesce(SCE > 0, false) OR coalesce(TemporalSpan_days <= 0, false) OR coalesce(ClusterTemporalSpanYears <= 0, false)
        OR coalesce(TemporalSpan_days < 365 AND (abs(EPR) > 50 OR abs(LRR) > 50), false) OR coalesce(abs(NSM) > 200, false) OR coalesce(abs(SCE) > 200, false)
        OR coalesce(abs(EPR) > 50, false) OR coalesce(abs(LRR) > 50, false) AS suspicious FROM results""",
    "qa_rules_v2": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {_REASON} <> '' AS suspicious, {_REASON} AS suspicious_reason FROM results",
    "qa_clean": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {_each(['NSM', 'LRR'])} FROM results WHERE {_REASON} = ''",
    "qa_iqr": f"""WITH {_RESULTS}, {_FULL}, q AS (SELECT {', '.join(f'quantile_cont({m}, 0.25) AS a_{m}, quantile_cont({m}, 0.75) AS b_{m}' for m in _M)} FROM full_rows),
        f AS (SELECT gt_family, cluster_id, {', '.join(f'({m} < a_{m} - 1.5 * (b_{m} - a_{m}) OR {m} > b_{m} + 1.5 * (b_{m} - a_{m})) AS iqr_{m}' for m in _M)} FROM full_rows, q)
        SELECT *, {' OR '.join(f'iqr_{m}' for m in _M)} AS iqr_any FROM f""",
    "qa_mad": f"WITH {_MAD} SELECT gt_family, cluster_id, {_each([f'z_{m}' for m in _M])}, coalesce(outlier_score > 3.5, false) AS mad_any FROM scored",
    "qa_most_negative": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {_each(['LRR'])} FROM results WHERE results.LRR IS NOT NULL ORDER BY results.LRR, gt_family, cluster_id LIMIT 50",
    "family_track": f"""WITH {_RESULTS}, counts AS (SELECT gt_family, track_id, count(*) AS n FROM results GROUP BY ALL)
        SELECT gt_family, min(track_id) AS track_id FROM counts c WHERE n = (SELECT max(n) FROM counts d WHERE d.gt_family = c.gt_family) GROUP BY gt_family""",
    "qa_score": f"WITH {_MAD} SELECT gt_family, cluster_id, {_each(['outlier_score'])} FROM scored WHERE scored.outlier_score > 3.5 ORDER BY scored.outlier_score DESC, gt_family, cluster_id LIMIT 50",
    "qa_impossible": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {_each(['LRR'])} FROM results WHERE NOT coalesce(results.LRR < -30, false)",
    "qa_breakdown": f"WITH {_RESULTS} SELECT CASE WHEN ValidRegression THEN 'True' WHEN NOT ValidRegression THEN 'False' ELSE 'Missing' END AS valid_regression, count(*) AS n FROM results GROUP BY 1",
    "qa_distinct_keys": f"WITH {_RESULTS} SELECT count(*) AS n_keys FROM (SELECT DISTINCT track_id, ClusterSize, bias_tolerance, gt_family FROM results)",
    "resume_antijoin": f"WITH {_RESULTS} SELECT DISTINCT ClusterSize, bias_tolerance, gt_family FROM results WHERE gt_family <> 'gt1'",
    "upsert_keep_last": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {r6('CASE WHEN cluster_id % 3 <> 1 THEN NSM + 1 ELSE NSM END')} AS NSM FROM results",
    "union_by_name": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {r6('NSM')} AS NSM, NULL::DOUBLE AS SCE FROM results WHERE gt_family = 'gt1' UNION ALL SELECT gt_family, cluster_id, NULL, {r6('SCE')} FROM results WHERE gt_family = 'gt2'",
    "map_subset": f"WITH {_RESULTS} SELECT gt_family, cluster_id, {_each(['NSM', 'LRR'])} FROM results WHERE ClusterSize = 18 AND bias_tolerance = 0.75 AND results.LRR BETWEEN -20 AND 20",
    "advancing": f"WITH {_FIT}, moved AS (SELECT *, bluff_x - lag(bluff_x) OVER (PARTITION BY gt_family, cluster_id ORDER BY acq_date) AS dx FROM dated) SELECT gt_family, cluster_id, acq_date, {_each(['bluff_x'])} FROM moved WHERE dx IS NULL OR dx >= 0",
    "set_ops": f"""WITH {_RESULTS}, a AS (SELECT cluster_id FROM results WHERE angle_deg >= 30), b AS (SELECT cluster_id FROM results WHERE ClusterSize <= 24)
        SELECT cluster_id, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT cluster_id, 'first' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
}
