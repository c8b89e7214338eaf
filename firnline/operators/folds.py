"""Spatial cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.operators.ordering import running_totals

# Fixed value: the last limit is opened by this much, so the last entry falls inside.
LAST_LIMIT_SLACK = 1e-4

FOLDS = ["train", "val", "test"]


def assign_folds(entries: DataFrame, num_folds: int, fold: int, val_fraction: float) -> DataFrame:
    """Train, validation and test by cumulative area along an axis.

    Entries are ordered by ``bound_lim`` from high to low. The test fold is the slice
    of cumulative area ``[(fold-1)/n, fold/n)``; validation is a band next to it.
    """
    if not 1 <= fold <= num_folds:
        raise ValueError(f"fold must be between 1 and {num_folds}")
    slack = LAST_LIMIT_SLACK if fold == num_folds else 0.0
    low, high = (fold - 1) / num_folds, fold / num_folds + slack
    if fold == 1:
        outer = (low, high + val_fraction)
    elif fold == num_folds:
        outer = (low - val_fraction, high)
    else:
        outer = (low - val_fraction / 2, high + val_fraction / 2)
    placed = running_totals(
        entries.select("entry_id", "area_km2", "bound_lim"), [], [F.col("bound_lim").desc(), F.col("entry_id").asc()],
        {"_cum": F.col("area_km2")}, {"_all": "_cum"},
    )
    share = F.col("_cum") / F.col("_all")
    label = (
        F.when((share >= low) & (share < high), F.lit("test"))
        .when((share >= outer[0]) & (share < outer[1]), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return placed.select("entry_id", "area_km2", "bound_lim", label.alias("fold"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Count and area of each fold, and their shares."""
    per = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("area_km2").alias("area_km2"))
    all_folds = per.agg(F.sum("n").alias("_n"), F.sum("area_km2").alias("_a")).first()
    n, a = (all_folds["_n"] or 0), (all_folds["_a"] or 0.0)
    return per.select(
        "fold", "n", F.try_divide(F.col("n"), F.lit(float(n))).alias("n_share"),
        "area_km2", F.try_divide(F.col("area_km2"), F.lit(float(a))).alias("area_share"),
    )


def patches_per_fold(patches: DataFrame, folds: DataFrame) -> DataFrame:
    """Number of patches and its spread over entries, per fold."""
    per_entry = patches.groupBy("entry_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_entry.join(folds.select("entry_id", "fold"), "entry_id").groupBy("fold").agg(
        F.sum("_n").alias("n_patches"), F.count(F.lit(1)).alias("n_entries"), F.min("_n").alias("min_per_entry"),
        F.max("_n").alias("max_per_entry"), F.avg("_n").alias("mean_per_entry"),
    )


def wide_splits(long: DataFrame, splits: list[str]) -> DataFrame:
    """One column per split holding the fold of each entry."""
    return long.groupBy("entry_id").pivot("split", splits).agg(F.first("fold"))


def audit(files: DataFrame, folds: DataFrame) -> DataFrame:
    """Files per fold, with the files of unassigned entries counted under NULL."""
    return files.join(folds.select("entry_id", "fold"), "entry_id", "left").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_distinct("entry_id").alias("n_entries")
    )


def assert_disjoint(folds: DataFrame) -> DataFrame:
    """Return ``folds``, or fail if an entry sits in two folds."""
    per = folds.groupBy("entry_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").limit(10).collect()
    if per:
        raise ValueError(f"entries in several folds: {sorted(str(r[0]) for r in per)}")
    return folds


def assert_no_empty_fold(folds: DataFrame) -> DataFrame:
    """Return ``folds``, or fail if one of the three folds has no entry."""
    present = {r[0] for r in folds.select("fold").distinct().limit(len(FOLDS) + 1).collect()}
    if not present.issuperset(FOLDS):
        raise ValueError(f"empty folds: {sorted(set(FOLDS) - present)}")
    return folds
