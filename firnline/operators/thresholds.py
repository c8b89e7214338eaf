"""Threshold sweeps as histograms and running sums.

Sweeping ``n`` thresholds over the pixels would visit every pixel ``n`` times. Here a
pixel is counted once, in the bucket of the last threshold it passes; running sums over
the buckets, whose number is fixed by the sweep, give the counts of all thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.session import materialise

# Sweep settings and the share of a normal law within one sigma.
RATIO_SWEEP = (0.5, 5.5, 0.1)
BLUE_SWEEP = (0.0, 1500.0, 25.0)
BOUND_SWEEP = (0.0, 0.5, 0.001)
ONE_SIGMA_SHARE = 0.6826894921370859

def steps(sweep: tuple[float, float, float]) -> int:
    """Number of thresholds of ``(start, stop, step)``, both ends included."""
    start, stop, step = sweep
    return int(round((stop - start) / step)) + 1


def last_passed(value: Column, sweep: tuple[float, float, float]) -> Column:
    """Index of the last threshold ``t`` with ``value >= t``; -1 if there is none or no value.

    The quotient only says where to look; the comparison with that threshold and the next decides.
    """
    start, _, step = sweep
    value = F.when(~F.isnan(value), value.cast("double"))
    i = F.floor((F.least(F.greatest(value, F.lit(start - 2 * step)), F.lit(start + (steps(sweep) + 1) * step)) - start) / step)
    i = F.when(value >= threshold(i + 1, sweep), i + 1).when(value < threshold(i, sweep), i - 1).otherwise(i)
    return F.greatest(F.least(F.coalesce(i, F.lit(-1)), F.lit(steps(sweep) - 1)), F.lit(-1)).cast("int")


def threshold(i: Column, sweep: tuple[float, float, float]) -> Column:
    return F.lit(float(sweep[0])) + i * F.lit(float(sweep[2]))


def _grid(n: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def sweep_iou(
    pixels: DataFrame, keys: list[str], truth: Column, first: Column, first_sweep: tuple[float, float, float],
    second: Column | None = None, second_sweep: tuple[float, float, float] | None = None,
) -> DataFrame:
    """Confusion counts and IoU for every threshold, or pair of thresholds, per key."""
    if second is None:
        second, second_sweep = F.lit(0.0), (0.0, 0.0, 1.0)
    n1, n2 = steps(first_sweep), steps(second_sweep)
    hit = F.when(truth, F.lit(1)).otherwise(F.lit(0))
    hist = pixels.select(
        *keys, last_passed(first, first_sweep).alias("i"), last_passed(second, second_sweep).alias("j"), hit.alias("_t")
    ).groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("_n"), F.sum("_t").alias("_tp"))
    hist = materialise(hist)  # read twice; the cells are not
    totals = hist.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.sum("_tp").alias("_pos"))
    grid = totals.select(*keys, "_all", "_pos", _grid(n1, "i")).select("*", _grid(n2, "j"))
    dense = grid.join(hist.where("i >= 0 and j >= 0"), [*keys, "i", "j"], "left").fillna(0, ["_n", "_tp"])
    along_j = Window.partitionBy(*keys, "i").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    along_i = Window.partitionBy(*keys, "j").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for w in (along_j, along_i):
        dense = dense.withColumns({"_n": F.sum("_n").over(w), "_tp": F.sum("_tp").over(w)})
    tp, pred, pos = F.col("_tp"), F.col("_n"), F.col("_pos")
    return dense.select(
        *keys,
        (F.lit(float(first_sweep[0])) + F.col("i") * F.lit(float(first_sweep[2]))).alias("thr_1"),
        (F.lit(float(second_sweep[0])) + F.col("j") * F.lit(float(second_sweep[2]))).alias("thr_2"),
        tp.alias("tp"), (pred - tp).alias("fp"), (pos - tp).alias("fn"), (F.col("_all") - pos - pred + tp).alias("tn"),
        F.try_divide(tp, pos + pred - tp).alias("iou"),
    )


def best_regional(sweep: DataFrame, areas: DataFrame, group: list[str] | None = None, key: str = "entry_id") -> DataFrame:
    """The pair of thresholds with the best mean IoU, entries weighted by area.

    Weights are scaled to a mean of one. ``group`` gives one result per fold. Ties go
    to the lower thresholds.
    """
    group = group or []
    per = sweep.join(areas.select(key, *group, "area"), key)
    scale = areas.groupBy(*group).agg(
        F.try_divide(F.count(F.lit(1)), F.sum("area")).alias("_scale"), F.count(F.lit(1)).alias("_m")
    )
    means = per.groupBy(*group, "thr_1", "thr_2").agg(
        F.avg("iou").alias("iou"), F.sum(F.col("iou") * F.col("area")).alias("_wi"), F.count("iou").alias("_k")
    )
    joined = means.join(scale, group) if group else means.withColumns(
        dict(zip(("_scale", "_m"), [F.lit(v) for v in scale.first()]))
    )
    weighted = joined.withColumn("w_iou", F.try_divide(F.col("_wi") * F.col("_scale"), F.col("_k")))
    # equal thresholds must not be told apart by the order in which doubles were added
    goal = F.struct(F.round("w_iou", 12).alias("g"), -F.col("thr_1"), -F.col("thr_2"))
    top = F.max_by(F.struct("thr_1", "thr_2", "iou", "w_iou"), goal)
    return weighted.groupBy(*group).agg(top.alias("_b")).select(*group, "_b.*")


def best_per_entry(sweep: DataFrame, key: str = "entry_id") -> DataFrame:
    """Thresholds with the highest IoU of each entry; ties go to the lower thresholds."""
    known = sweep.where(F.col("iou").isNotNull())
    top = F.max_by(F.struct("thr_1", "thr_2", "iou"), F.struct("iou", -F.col("thr_1"), -F.col("thr_2")))
    return known.groupBy(key).agg(top.alias("_b")).select(key, "_b.*")


def area_bounds(
    cells: DataFrame, keys: list[str], mean: Column, std: Column, truth: Column, gsd: float,
    sweep: tuple[float, float, float] = BOUND_SWEEP,
) -> DataFrame:
    """Predicted, true, lower and upper area (km2) of every key at every threshold.

    The upper area counts ``mean + std >= t`` and the lower ``mean - std >= 1 - t``.
    """
    start, _, step = sweep
    n, px = steps(sweep), gsd * gsd / 1e6
    low = mean - std
    from_step = F.ceil((1 - low - start) / step)
    from_step = F.when(low >= 1 - threshold(from_step - 1, sweep), from_step - 1).when(
        low < 1 - threshold(from_step, sweep), from_step + 1).otherwise(from_step)
    from_step = F.greatest(F.least(F.coalesce(from_step, F.lit(n)), F.lit(n)), F.lit(0)).cast("int")
    counted = cells.select(*keys, last_passed(mean + std, sweep).alias("_u"), from_step.alias("_l"),
                           (mean >= 0.5).cast("int").alias("_p"), truth.cast("int").alias("_t"))
    both = F.inline(F.array(
        F.struct(F.lit(1).alias("_up"), F.col("_u").alias("i"), F.col("_p").alias("_pc"), F.col("_t").alias("_tc")),
        F.struct(F.lit(0).alias("_up"), F.col("_l").alias("i"), F.lit(0).alias("_pc"), F.lit(0).alias("_tc")),
    ))
    is_up = F.col("_up") == 1
    hist = counted.select(*keys, both).groupBy(*keys, "i").agg(
        F.sum(F.when(is_up, 1).otherwise(0)).alias("_nu"), F.sum(F.when(~is_up, 1).otherwise(0)).alias("_nl"),
        F.sum("_pc").alias("_np"), F.sum("_tc").alias("_nt"),
    )
    hist = materialise(hist)  # read twice; the cells are not
    totals = hist.groupBy(*keys).agg(F.sum("_np").alias("_np"), F.sum("_nt").alias("_nt"))
    dense = totals.select("*", _grid(n, "i")).join(hist.select(*keys, "i", "_nu", "_nl"), [*keys, "i"], "left")
    dense = dense.fillna(0, ["_nu", "_nl"])
    down = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(
        *keys, F.round(F.lit(float(start)) + F.col("i") * F.lit(float(step)), 9).alias("thr"),
        (F.col("_np") * px).alias("area_pred"), (F.col("_nt") * px).alias("area_true"),
        (F.sum("_nl").over(up) * px).alias("area_lb"), (F.sum("_nu").over(down) * px).alias("area_ub"),
    )


def with_area_errors(bounds: DataFrame) -> DataFrame:
    """Error columns, and whether the truth lies inside the bounds."""
    error = F.col("area_pred") - F.col("area_true")
    estimate = (F.col("area_ub") - F.col("area_lb")) / 2
    return bounds.withColumns({
        "area_pred_error": error, "area_pred_error_abs": F.abs(error), "area_pred_error_est": estimate,
        "est_err_vs_actual_err": F.abs(estimate - F.abs(error)),
        "pred_is_within_bounds": (F.col("area_lb") <= F.col("area_true")) & (F.col("area_true") <= F.col("area_ub")),
    })


def calibrated_bound(errors: DataFrame, target: float = ONE_SIGMA_SHARE) -> DataFrame:
    """The threshold whose hit rate is closest to the target; ties go to the lower one."""
    rate = errors.groupBy("thr").agg(F.avg(F.col("pred_is_within_bounds").cast("double")).alias("p_best"))
    best = F.min(F.struct(F.round(F.abs(F.col("p_best") - target), 12).alias("gap"), F.col("thr"), F.col("p_best")))
    return rate.agg(best.alias("_b")).select(
        F.col("_b.thr").alias("thr_best"), F.lit(target).alias("p_target"), F.col("_b.p_best").alias("p_best")
    )
