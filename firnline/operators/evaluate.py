"""Areas, rates and pixel metrics against a truth, all from cell flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import probability
from firnline.operators.ordering import exact_quantiles
from firnline.tables import join_null_safe, unbroadcast

# Decision threshold, smallest sub-class area (km2) and smallest sub-class share that give a recall.
DECISION = 0.5
MIN_SUB_AREA_KM2 = 1e-5
MIN_SUB_SHARE = 0.01

METRICS = ["accuracy", "jaccard", "precision", "recall", "f1"]


def _n(flag: Column) -> Column:
    return F.sum(F.when(flag, F.lit(1)).otherwise(F.lit(0)))


def overlay_intersection(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Cells of both layers, with the attributes of both."""
    return left.join(unbroadcast(right), on, "inner")


def overlay_difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(unbroadcast(right.select(*on)), on, "left_anti")


def clip_layer(layer: DataFrame, by: DataFrame, on: list[str]) -> DataFrame:
    return layer.join(unbroadcast(by.select(*on)), on, "left_semi")


def dissolve(layer: DataFrame, on: list[str]) -> DataFrame:
    """Union of all shapes of a layer as a cell set."""
    return layer.select(*on).distinct()


def majority(sources: list[DataFrame], on: list[str], at_least: int = 2) -> DataFrame:
    """Cells covered by at least ``at_least`` of the sources."""
    tagged = [s.select(*on, F.lit(i).alias("_src")) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    n = reduce(lambda a, b: a + b, [F.max(F.when(F.col("_src") == i, 1).otherwise(0)) for i in range(len(sources))])
    return every.groupBy(*on).agg(n.alias("_n")).where(F.col("_n") >= at_least).select(*on)


def confusion_areas(
    cells: DataFrame, truth: Column, negative: Column, infer: Column, prediction: Column, gsd: float,
    key: str = "entry_id", sub: Column | None = None,
) -> DataFrame:
    """Areas (km2) and rates per entry in one pass over the cells.

    Predictions count only inside the inference and false-positive regions; a missing one
    is negative. With ``sub``
    the columns of a sub-class of the truth are added.
    """
    px = gsd * gsd / 1e6
    pred = F.coalesce(prediction, F.lit(False)) & (infer | negative)
    aggs = {
        "P": truth, "TP": truth & pred, "FN": truth & ~pred, "N": negative, "FP": pred & negative, "infer": pred & infer,
    }
    if sub is not None:
        aggs["area_debris"] = truth & sub
        aggs["TP_debris"] = truth & sub & pred
    out = cells.groupBy(key).agg(*[(_n(f) * px).alias(k) for k, f in aggs.items()])
    out = with_rates(out)
    return with_sub_class_rates(out) if sub is not None else out


def with_rates(areas: DataFrame) -> DataFrame:
    return areas.withColumns({
        "pred": F.col("TP") + F.col("FP"),
        "TPR": F.try_divide("TP", "P"), "FNR": F.try_divide("FN", "P"), "FPR": F.try_divide("FP", "N"),
    })


def with_sub_class_rates(areas: DataFrame) -> DataFrame:
    share = F.try_divide("area_debris", "P")
    recall = F.when(F.col("area_debris") > MIN_SUB_AREA_KM2, F.try_divide("TP_debris", "area_debris"))
    return areas.withColumns({"debris_coverage_f": share, "TPR_debris": recall})


def layer_totals(areas: DataFrame, layers: list[str], digits: int = 2) -> DataFrame:
    """Total area of each layer over all entries."""
    wide = areas.agg(*[F.round(F.sum(c), digits).alias(c) for c in layers])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("area_km2")) for c in layers])))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per key."""
    v = F.col(value)
    moments = df.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    quartiles = exact_quantiles(df, keys, v, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    joined = join_null_safe(moments, quartiles, keys, "left") if keys else moments.join(quartiles, how="left")
    return joined.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def sample_metrics(
    pixels: DataFrame, keys: list[str], p: Column, y: Column, mask: Column, threshold: float = DECISION, sub: Column | None = None
) -> DataFrame:
    """Accuracy, Jaccard, precision, recall and F1 over the masked pixels of a sample.

    A ratio without a denominator is 0. A sample whose mask is empty has NULL metrics.
    With ``sub``, ``recall_debris`` is added where the sub-class makes up enough of the truth.
    """
    pos, hit = y == 1, F.coalesce(p > threshold, F.lit(False))
    aggs = [
        _n(mask).alias("_n"), _n(mask & pos & hit).alias("_tp"), _n(mask & ~pos & hit).alias("_fp"),
        _n(mask & pos & ~hit).alias("_fn"), _n(mask & ~pos & ~hit).alias("_tn"),
    ]
    if sub is not None:
        minor = (sub == 1) & pos
        aggs += [_n(pos).alias("_p"), _n(minor).alias("_s"), _n(mask & minor).alias("_sm"), _n(mask & minor & hit).alias("_st")]
    c = pixels.groupBy(*keys).agg(*aggs)
    tp, fp, fn, tn = (F.col(f"_{k}") for k in ("tp", "fp", "fn", "tn"))
    some = F.col("_n") > 0

    def ratio(a: Column, b: Column) -> Column:
        return F.when(some, F.coalesce(F.try_divide(a, b), F.lit(0.0)))

    out = {
        "accuracy": ratio(tp + tn, F.col("_n")), "jaccard": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }
    if sub is not None:
        enough = F.try_divide("_s", "_p") >= MIN_SUB_SHARE
        out["recall_debris"] = F.when(enough, ratio(F.col("_st"), F.col("_sm")))
    return c.select(*keys, *[v.alias(k) for k, v in out.items()])


def entry_means(samples: DataFrame, metrics: list[str], key: str = "entry_id", area: str | None = None) -> DataFrame:
    """Mean of the sample metrics per entry."""
    extra = [F.first(area).alias(area)] if area else []
    return samples.groupBy(key).agg(*[F.avg(m).alias(m) for m in metrics], *extra)


def two_level_means(samples: DataFrame, metrics: list[str], area: str, key: str = "entry_id") -> DataFrame:
    """One row: plain means over samples, and entry means weighted by area share (``w_``)."""
    sums = []
    for m in metrics:
        sums += [F.sum(m).alias(f"_s_{m}"), F.count(m).alias(f"_c_{m}")]
    per = samples.groupBy(key).agg(*sums, F.first(area).alias("_a"))
    out = []
    for m in metrics:
        mean = F.try_divide(F.col(f"_s_{m}"), F.col(f"_c_{m}"))
        out.append(F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_c_{m}")).alias(m))
        out.append(F.try_divide(F.sum(mean * F.col("_a")), F.sum("_a")).alias(f"w_{m}"))
    return per.agg(*out)


def masked_losses(pixels: DataFrame, keys: list[str], p: Column, y: Column, mask: Column) -> DataFrame:
    """L2, L1, cross-entropy and focal loss over the mask, and soft dice over all pixels.

    Without ``keys`` the result is one row for the whole table.
    """
    y = y.cast("double")
    terms = {
        "L2": (p - y) * (p - y), "L1": F.abs(p - y),
        "BCE": probability.binary_cross_entropy(p, y), "focal": probability.focal(p, y),
    }
    size = _n(mask)
    eps = F.lit(probability.DICE_EPS)
    dice = 1 - (2 * F.sum(p * y) + eps) / (F.sum(p) + F.sum(y) + eps)
    aggs = [F.try_divide(F.sum(F.when(mask, t)), size).alias(k) for k, t in terms.items()]
    return pixels.groupBy(*keys).agg(*aggs, dice.alias("dice"))
