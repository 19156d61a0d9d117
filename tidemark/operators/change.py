"""Change statistics of dated edge positions: one aggregation for any number of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import elapsed_days, finite, year_fraction
from tidemark.operators import student
from tidemark.params import Params, pick

METRICS = ("NSM", "SCE", "EPR", "LRR", "LR2", "LSE", "LCI")


def collapsed(positions: DataFrame, keys: list[str]) -> DataFrame:
    """One mean position for each date of a cluster; rows without date or position go."""
    rows = positions.select(*keys, "acq_date", finite(F.col("bluff_x")).alias("bluff_x")).where("acq_date IS NOT NULL AND bluff_x IS NOT NULL")
    return rows.groupBy(*keys, "acq_date").agg(F.avg("bluff_x").alias("bluff_x"))


def statistics(positions: DataFrame, keys: list[str], params: Params | None = None, min_span_days: int | None = None, confidence: float | None = None) -> DataFrame:
    """NSM, SCE, EPR, LRR, LR2, LSE, LCI, span and validity of each cluster.

    Positions fall with retreat: the net movement is first minus last and the
    envelope least minus greatest.  Rates need a span of ``min_span_days``,
    the regression three dates as well; what is not defined is null.  Values
    are not rounded.
    """
    span = pick(min_span_days, params, "min_span_days")
    level = pick(confidence, params, "confidence")
    t = year_fraction(F.col("acq_date"))
    fits = {k: getattr(F, f"regr_{k}")("bluff_x", t).alias(k) for k in ("slope", "r2", "sxx", "syy", "sxy")}
    each = collapsed(positions, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"),
        F.min_by("bluff_x", "acq_date").alias("x_first"), F.max_by("bluff_x", "acq_date").alias("x_last"),
        F.min("bluff_x").alias("least"), F.max("bluff_x").alias("most"), *fits.values(),
    )
    two = F.col("n") >= 2
    each = each.withColumn("TemporalSpan_days", F.when(two, elapsed_days(F.col("first_date"), F.col("last_date"))))
    long = F.col("TemporalSpan_days") >= span
    fitted = two & long & (F.col("n") >= 3)
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.nullif("sxx", F.lit(0.0)), F.lit(0.0))
    each = each.withColumn("dof", F.col("n") - 2).withColumn("LSE", F.when(fitted, F.sqrt(rest / F.col("dof"))))
    tcrit = student.tcrit(level, F.col("dof"))
    return each.select(
        *keys,
        F.when(two, F.col("x_first") - F.col("x_last")).alias("NSM"),
        F.when(two, F.col("least") - F.col("most")).alias("SCE"),
        F.when(long & (F.col("TemporalSpan_days") > 0), (F.col("x_first") - F.col("x_last")) / (F.col("TemporalSpan_days") / F.lit(365.25))).alias("EPR"),
        F.when(fitted, -F.col("slope")).alias("LRR"),
        F.when(fitted, F.col("r2")).alias("LR2"),
        "LSE",
        F.when(fitted, tcrit * F.col("LSE") / F.sqrt("sxx")).alias("LCI"),
        "TemporalSpan_days",
        F.coalesce(fitted & F.col("slope").isNotNull(), F.lit(False)).alias("ValidRegression"),
        "first_date", "last_date",
    )
