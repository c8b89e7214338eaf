"""Ensembles: members per cell, and statistics over seeds and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.inventory import assert_subset

# Fixed value: sub-class share at or below which its recall is not reported.
MIN_SUB_SHARE = 0.01


def union_members(members: dict[int | str, DataFrame], seed: str = "seed") -> DataFrame:
    """All members in one table, tagged with their seed."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(seed, F.lit(s)) for s, df in members.items()])


def require_all_members(members: DataFrame, n: int, key: str = "entry_id", seed: str = "seed") -> DataFrame:
    """Return ``members``, or fail where an entry lacks a member."""
    short = members.groupBy(key).agg(F.count_distinct(seed).alias("_n")).where(F.col("_n") != n).limit(10).collect()
    if short:
        raise ValueError(f"predictions missing for: {', '.join(sorted(str(r[0]) for r in short))}")
    return members


def aggregate_members(members: DataFrame, seeds: list[int], p: str = "p", keys: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, vote and one-sigma extents of every cell.

    Fails where an entry lacks a member or a cell has a seed twice. A cell with a missing
    value keeps its row, with NULL for everything but the members. Members are stacked in
    seed order with conditional maxima, so everything is combined before the shuffle.
    """
    keys = keys or ["entry_id", "y", "x"]
    used = members.where(F.col("seed").isin(seeds))
    require_all_members(used, len(seeds), keys[0])
    stack = F.array(*[F.max(F.when(F.col("seed") == s, F.col(p))) for s in seeds])
    most = F.greatest(F.lit(0), *[F.count(F.when(F.col("seed") == s, 1)) for s in seeds])
    agg = used.groupBy(*keys).agg(
        F.avg(p).alias("pred"), F.stddev_pop(p).alias("pred_std"), stack.alias("pred_all"), F.count(p).alias("_n"), most.alias("_most")
    )
    once = F.when(F.col("_most") > 1, F.raise_error(F.lit("a seed occurs twice in a cell")).cast("boolean")).otherwise(F.col("_n") == len(seeds))
    agg = agg.withColumn("_complete", once).withColumns({c: F.when(F.col("_complete"), F.col(c)) for c in ("pred", "pred_std")})
    return agg.drop("_n", "_most", "_complete").withColumns({
        "pred_b": F.col("pred") >= 0.5,
        "pred_low_b": F.col("pred") - F.col("pred_std") >= 0.5,
        "pred_high_b": F.col("pred") + F.col("pred_std") >= 0.5,
    })


def assemble_stats(
    stats: DataFrame, inventory: DataFrame, buffer_pred: int = 20, buffer_fp: int = 50, bounds: bool = False
) -> DataFrame:
    """Areas and rates of every entry, seed and fold from its raw area columns.

    The inventory area replaces the rasterised one. With ``bounds`` the ``_low`` and
    ``_high`` versions are derived as well.
    """
    assert_subset(stats, inventory)
    s = stats.drop("area_inv").join(inventory.select("entry_id", "area_inv", "year_inv"), "entry_id")
    for suffix in ("", "_low", "_high") if bounds else ("",):
        for c in (f"area_non_g_pred{suffix}_b0", "area_non_g_b0"):
            if c not in s.columns:
                s = s.withColumn(c, F.lit(0.0))
    ring = f"b{buffer_pred}_{buffer_fp}"
    s = s.withColumns({
        "area_nok_p": F.try_divide("area_nok", "area_inv"), "area_debris_p": F.try_divide("area_debris", "area_inv"),
        f"area_non_g_{ring}": F.col(f"area_non_g_b{buffer_fp}") - F.col(f"area_non_g_b{buffer_pred}"),
        "is_inv_year": F.col("year") == F.col("year_inv"),
    })
    for x in ("", "_low", "_high") if bounds else ("",):
        recalled, debris = F.col(f"area_pred{x}_b0"), F.col(f"area_debris_pred{x}_b0")
        ring_pred = F.col(f"area_non_g_pred{x}_b{buffer_fp}") - F.col(f"area_non_g_pred{x}_b{buffer_pred}")
        s = s.withColumns({
            f"area_recalled{x}": recalled, f"recall{x}": F.try_divide(recalled, F.col("area_inv")),
            f"area_debris_recalled{x}": F.when(F.col("area_debris_p") > MIN_SUB_SHARE, debris),
            f"area_non_g_pred{x}_{ring}": ring_pred,
            f"fp_rate{x}": F.try_divide(ring_pred, F.col(f"area_non_g_{ring}")),
            f"area_pred{x}": recalled + F.col(f"area_non_g_pred{x}_b{buffer_pred}"),
        })
        s = s.withColumn(f"recall_debris{x}", F.try_divide(F.col(f"area_debris_recalled{x}"), F.col("area_debris")))
    return s


def predicted_columns(df: DataFrame) -> list[str]:
    """Numeric columns that depend on predictions and have an uncertainty."""
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short")}
    fixed = ("recall", "area_recalled", "area_debris_recalled")
    return [
        c for c in df.columns
        if c in numeric and (c in fixed or ("pred" in c and "low" not in c and "high" not in c))
    ]


def deviation_from_bounds(stats: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Half the distance of the bounds as ``<column>_std``, right after its column."""
    columns = columns or predicted_columns(stats)

    def bound(c: str, side: str) -> Column:
        return F.col(c.replace("pred", f"pred_{side}") if "pred" in c else f"{c}_{side}")

    out = []
    for c in stats.columns:
        out.append(F.col(c))
        if c in columns:
            out.append(((bound(c, "high") - bound(c, "low")) * 0.5).alias(f"{c}_std"))
    return stats.select(*out)


def deviation_over_seeds(stats: DataFrame, columns: list[str] | None = None, seed: str = "seed") -> DataFrame:
    """Mean and sample deviation over the seeds of an entry; other columns take their first known value."""
    columns = columns or predicted_columns(stats)
    keys = ["entry_id", "is_inv_year"]
    rest = [c for c in stats.columns if c not in columns and c not in keys]
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seed))).alias(c) for c in rest if c != seed]
    aggs = [*first, F.min(seed).alias(seed)]
    for c in columns:
        aggs += [F.avg(c).alias(c), F.stddev_samp(c).alias(f"{c}_std")]
    return stats.groupBy(*keys).agg(*aggs)
