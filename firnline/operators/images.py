"""Quality metrics of acquisitions, ranking and the choice of the best one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions import spectral
from firnline.tables import require_columns

METRICS = ("cloud_p", "ndsi", "albedo")


def _share(flag: Column) -> Column:
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def quality_metrics(
    cells: DataFrame,
    keys: list[str],
    bands: dict[str, str],
    nok: Column,
    roi: dict[str, Column],
    scale: float = spectral.REFLECTANCE_SCALE,
) -> DataFrame:
    """Coverage, cloud share, mean NDSI and mean albedo per acquisition in one pass.

    ``bands`` maps ``B, G, R, SWIR`` to columns; ``roi`` gives one region predicate per
    metric. Missing cells count as cloud. A metric with no clear cell is NULL.
    """
    band = {k: F.col(c) for k, c in bands.items()}
    valid = F.lit(True)
    for c in band.values():
        valid = valid & c.isNotNull()
    clear = ~nok

    def over(metric: str, value: Column) -> Column:
        return F.avg(F.when(clear & roi[metric], value))

    ok = F.when(roi["cloud_p"], F.when(clear & valid, F.lit(0.0)).otherwise(F.lit(1.0)))
    return cells.groupBy(*keys).agg(
        _share(valid).alias("coverage"),
        F.avg(ok).alias("cloud_p"),
        over("ndsi", spectral.ndsi(band["G"], band["SWIR"])).alias("ndsi"),
        over("albedo", spectral.albedo(band["B"], band["G"], band["R"], scale)).alias("albedo"),
    )


def keep_usable(images: DataFrame, min_coverage: float = 0.0, max_cloud_p: float = 1.0) -> DataFrame:
    """Thresholds apply only where they restrict something."""
    if min_coverage > 0:
        images = images.where(F.col("coverage") >= min_coverage)
    if max_cloud_p < 1:
        images = images.where(F.col("cloud_p") <= max_cloud_p)
    return images


def score(
    images: DataFrame, sort_by: list[str], weights: list[float] | None = None, key: str = "entry_id"
) -> DataFrame:
    """Weighted sum of min-max scores within an entry; higher is better.

    The window holds the acquisitions of one entry: at most one per day of the
    archive, so it is bounded by the calendar and not by the number of cells.
    """
    require_columns(images, sort_by)
    weights = weights or [1.0] * len(sort_by)
    total = float(sum(weights))
    w = Window.partitionBy(key)
    parts = {}
    for m in sort_by:
        low, high = F.min(m).over(w), F.max(m).over(w)
        parts[f"score_{m}"] = F.lit(1.0) - (F.col(m) - low) / spectral.nonzero(high - low)
    scored = images.withColumns(parts)
    terms = [F.col(f"score_{m}") * (x / total) for m, x in zip(sort_by, weights)]
    value = terms[0]
    for t in terms[1:]:
        value = value + t
    return scored.withColumn("score", value)


def rank(images: DataFrame, key: str = "entry_id", tie: str = "date") -> DataFrame:
    """Position by descending score; a missing score goes last, ties go to the earlier date."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), F.col(tie).asc())
    return images.withColumn("rank", F.row_number().over(w))


def rank_usable(
    images: DataFrame,
    sort_by: list[str],
    weights: list[float] | None = None,
    min_coverage: float = 0.9,
    max_cloud_p: float = 0.3,
) -> DataFrame:
    """Filter, score and rank. An entry with no usable image is absent."""
    return rank(score(keep_usable(images, min_coverage, max_cloud_p), sort_by, weights))


def best_per_entry(ranked: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` best images per entry, or all of them where there are fewer."""
    return ranked.where(F.col("rank") <= k)


def assign(images: DataFrame, entries: DataFrame) -> DataFrame:
    """One image per entry: on the given date, else the one with the highest score.

    ``entries`` has a nullable ``date_acq``. A given date without an image leaves the
    entry out. A sole image needs no score.
    """
    offered = images.join(entries.select("entry_id", "date_acq"), "entry_id")
    fits = offered.where(F.col("date_acq").isNull() | (F.col("date") == F.col("date_acq")))
    w = Window.partitionBy("entry_id").orderBy(F.col("score").desc_nulls_last(), F.col("date").asc())
    return fits.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "date_acq")


def without_image(entries: DataFrame, images: DataFrame) -> DataFrame:
    """Entries for which no image exists at all."""
    return entries.join(images.select("entry_id"), "entry_id", "left_anti")


def best_run(runs: DataFrame, group: list[str], metric: str, mode: str = "min") -> DataFrame:
    """Best checkpoint per group by the metric written in its name; the last name wins ties."""
    if mode not in ("min", "max"):
        raise ValueError("mode must be 'min' or 'max'")
    value = F.regexp_extract("name", re.escape(metric) + r"=(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)", 1)
    named = runs.where(value != "").withColumn(metric, value.cast("double"))
    goal = F.col(metric) if mode == "max" else -F.col(metric)
    best = F.max(F.struct(goal.alias("goal"), F.col("name").alias("name"), F.col(metric).alias("value"))).alias("_b")
    return named.groupBy(*group).agg(best).select(*group, F.col("_b.name").alias("name"), F.col("_b.value").alias(metric))


def latest_run(runs: DataFrame, group: list[str]) -> DataFrame:
    """Run with the greatest name per group."""
    return runs.groupBy(*group).agg(F.max("name").alias("name"))
