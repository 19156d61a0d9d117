"""The quality gate: sparse, implausible and isolated passes go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keys import scoped
from tidemark.operators.spatial import nearest_other
from tidemark.params import Params, pick
from tidemark.sources.staging import staged

STATUSES = ("elev_trash", "few_points", "too_far", "loaded")


def beam_flags(points: DataFrame, params: Params | None = None, min_points_pct: float | None = None, elev_trash: float | None = None, too_far_beam: float | None = None) -> DataFrame:
    """One line per family and beam: its flags, the distance to the nearest other beam of the family, and its status."""
    share, trash, far = (pick(v, params, k) for v, k in ((min_points_pct, "min_points_pct"), (elev_trash, "elev_trash"), (too_far_beam, "too_far_beam")))
    family = scoped(points, "gt_family")
    beam = [*family, "beam_id"]
    each = staged(points.groupBy(*beam).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.abs("h_li") > trash), F.lit(False)).alias("elev_trash"), F.median("x").alias("x"), F.median("y").alias("y")
    ))
    means = each.groupBy(*family).agg(F.avg("n").alias("mean"))
    near = nearest_other(each.select(*beam, "x", "y"), family, "beam_id")
    flags = each.join(means, family).join(near, beam, "left")
    flags = flags.withColumns({"few_points": F.col("n") / F.col("mean") < share, "too_far": F.coalesce(F.col("nearest_dist") > far, F.lit(False))})
    status = F.when(F.col("elev_trash"), "elev_trash").when(F.col("few_points"), "few_points").when(F.col("too_far"), "too_far").otherwise("loaded")
    return flags.select(*beam, "few_points", "elev_trash", "too_far", "nearest_dist", status.alias("status"))


def summary(flags: DataFrame, params: Params | None = None, ideal_case: int | None = None) -> DataFrame:
    """Counts of each status by family, against the number of passes that there should be."""
    ideal = pick(ideal_case, params, "ideal_case")
    family = scoped(flags, "gt_family")
    counted = flags.groupBy(*family).agg(F.count_distinct("beam_id").alias("files_found"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return counted.select(*family, F.lit(ideal).cast("long").alias("ideal_case"), "files_found", (F.lit(ideal) - F.col("files_found")).alias("missing"), *STATUSES)


def gate(points: DataFrame, params: Params | None = None, **thresholds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept points, summary, flagged): beams that are loaded in some family stay; isolated ones are listed with their distance."""
    flags = staged(beam_flags(points, params, **thresholds))
    beam = scoped(flags, "beam_id")
    kept = points.join(flags.where("status = 'loaded'").select(*beam).distinct(), beam, "left_semi")
    return kept, summary(flags, params), flags.where("too_far").select(*scoped(flags, "gt_family", "beam_id"), "nearest_dist")
