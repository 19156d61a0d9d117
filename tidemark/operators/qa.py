"""Quality checks of result tables: profile, health, rules, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import regression_flag
from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources.staging import staged

METRICS = ("NSM", "SCE", "EPR", "LRR")


def profile(table: DataFrame) -> DataFrame:
    """column, dtype, non_null, nulls, null_pct (4 digits) and n_unique of every column; one pass over the table."""
    own = lambda c: F.col(f"`{c}`")
    counts = table.agg(F.count(F.lit(1)).alias("n"), *[F.count(own(c)).alias(f"c{k}") for k, c in enumerate(table.columns)], *[F.count_distinct(own(c)).alias(f"u{k}") for k, c in enumerate(table.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"c{k}").alias("non_null"), F.col(f"u{k}").alias("n_unique")) for k, (c, t) in enumerate(table.dtypes)]))
    out = counts.select("n", rows.alias("r")).select("r.column", "r.dtype", "r.non_null", (F.col("n") - F.col("r.non_null")).alias("nulls"), "n", "r.n_unique")
    return out.select("column", "dtype", "non_null", "nulls", (F.floor(F.col("nulls") / F.col("n") * 10000 + 0.5) / 10000).alias("null_pct"), "n_unique")


def health(table: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, n, nulls, infinite, min, p01, median, p99, max of each metric."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("x.*")
    middle = exact_quantiles(table, {m: F.col(m) for m in metrics}, (0.01, 0.5, 0.99))
    known = lambda k: F.create_map(*[x for m in metrics for x in (F.lit(m), F.lit(middle[m][k]).cast("double"))])[F.col("metric")]
    counts = long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(F.abs("value") == float("inf")).alias("infinite"),
        F.min("value").alias("least"), F.max("value").alias("most"),
    )
    return counts.select("metric", "n", "nulls", "infinite", "least", known(0).alias("p01"), known(1).alias("median"), known(2).alias("p99"), "most")


def extremes(table: DataFrame, metric: str, keys: list[str], n: int = 15, top: bool = True) -> DataFrame:
    """The ``n`` rows with the largest or smallest values; nulls come last either way, ties by key."""
    order = F.desc_nulls_last(metric) if top else F.asc_nulls_last(metric)
    return table.orderBy(order, *keys).limit(n).select(*keys, metric)


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def suspicious_simple(table: DataFrame) -> DataFrame:
    """``table`` with ``suspicious`` by the nine rules on envelope, span and magnitudes."""
    short = F.col("TemporalSpan_days") < 365
    rules = [
        F.col("SCE") > 0, F.col("TemporalSpan_days") <= 0, F.col("ClusterTemporalSpanYears") <= 0,
        short & (F.abs("EPR") > 50), short & (F.abs("LRR") > 50),
        F.abs("NSM") > 200, F.abs("SCE") > 200, F.abs("EPR") > 50, F.abs("LRR") > 50,
    ]
    found = F.lit(False)
    for rule in rules:
        found = found | _true(rule)
    return table.withColumn("suspicious", found)


def rules() -> dict[str, Column]:
    """The named rules, in the order in which their names are joined."""
    infinite = F.lit(False)
    for m in METRICS:
        infinite = infinite | _true(F.abs(m) == float("inf"))
    return {
        "TemporalSpan_days <= 0 or missing": F.col("TemporalSpan_days").isNull() | (F.col("TemporalSpan_days") <= 0),
        "ClusterTemporalSpanYears <= 0 or missing": F.col("ClusterTemporalSpanYears").isNull() | (F.col("ClusterTemporalSpanYears") <= 0),
        "NSM missing": F.col("NSM").isNull(),
        "NSM >= 0 (should be negative)": F.col("NSM") >= 0,
        "angle_deg missing": F.col("angle_deg").isNull(),
        "angle_deg < 60": F.col("angle_deg") < 60,
        "|NSM| > 200": F.abs("NSM") > 200,
        "|SCE| > 200": F.abs("SCE") > 200,
        "|EPR| > 50": F.abs("EPR") > 50,
        "|LRR| > 50": F.abs("LRR") > 50,
        "Has inf": infinite,
    }


def suspicious(table: DataFrame) -> DataFrame:
    """``table`` with ``suspicious`` and ``suspicious_reason``, the names of the rules that a row breaks."""
    named = F.array_join(F.filter(F.array(*[F.when(_true(rule), F.lit(name)) for name, rule in rules().items()]), lambda x: x.isNotNull()), ", ")
    return table.withColumn("suspicious_reason", named).withColumn("suspicious", F.col("suspicious_reason") != "")


def iqr_outliers(table: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows with all metrics, and a flag for each one beyond 1.5 quartile ranges (and for any)."""
    base = staged(table.dropna(subset=list(metrics)))
    fences, any_one, held = exact_quantiles(base, {m: F.col(m) for m in metrics}, (0.25, 0.75)), F.lit(False), base
    for m in metrics:
        a, b = (F.lit(x).cast("double") for x in fences[m])
        flag = (F.col(m) < a - 1.5 * (b - a)) | (F.col(m) > b + 1.5 * (b - a))
        held, any_one = held.withColumn(f"iqr_{m}", flag), any_one | flag
    return held.withColumn("iqr_any", any_one)


def robust_z(table: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows with all metrics, a robust z of each (null where the deviation is 0), ``mad_any`` (beyond 3.5) and ``outlier_score``."""
    held = staged(table.dropna(subset=list(metrics)))
    middle = {m: F.lit(v[0]).cast("double") for m, v in exact_quantiles(held, {m: F.col(m) for m in metrics}, (0.5,)).items()}
    spread = exact_quantiles(held, {m: F.abs(F.col(m) - middle[m]) for m in metrics}, (0.5,))
    z = {f"z_{m}": F.lit(0.6745) * (F.col(m) - middle[m]) / F.nullif(F.lit(spread[m][0]).cast("double"), F.lit(0.0)) for m in metrics}
    score = F.greatest(*[F.abs(c) for c in z.values()])
    return held.withColumns(z).withColumn("outlier_score", score).withColumn("mad_any", _true(score > 3.5))


def top_outliers(table: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    scored = robust_z(table).where("mad_any")
    return scored.orderBy(F.desc("outlier_score"), *keys).limit(n).select(*keys, "outlier_score")


def most_negative(table: DataFrame, keys: list[str], metric: str = "LRR", n: int = 50) -> DataFrame:
    """The ``n`` rows with the least known ``metric``."""
    return table.where(F.col(metric).isNotNull()).orderBy(F.asc(metric), *keys).limit(n).select(*keys, metric)


def possible(table: DataFrame, least: float = -30.0) -> DataFrame:
    """Rows without an impossible regression rate; a missing rate is no reason to go."""
    return table.where(~_true(F.col("LRR") < least))


def setup_rows(table: DataFrame, size: int, tolerance: float, least: float, most: float) -> DataFrame:
    """Rows of one setup whose regression rate is known and in range."""
    return table.where((F.col("ClusterSize") == size) & (F.col("bias_tolerance") == tolerance) & F.col("LRR").between(least, most))


def regression_breakdown(table: DataFrame) -> DataFrame:
    return table.groupBy(regression_flag(F.col("ValidRegression")).alias("valid_regression")).agg(F.count(F.lit(1)).alias("n"))


def distinct_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct complete keys there are."""
    return table.select(*keys).dropna().distinct().agg(F.count(F.lit(1)).alias("n_keys"))


def export_columns(table: DataFrame) -> DataFrame:
    """``table`` without its date columns, which some formats cannot hold."""
    return table.select(*[c for c, t in table.dtypes if not t.startswith(("date", "timestamp"))])
