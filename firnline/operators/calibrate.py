"""Reliability, temperature scaling and calibrated bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import probability as pr
from firnline.operators.inventory import with_parameters
from firnline.session import materialise

# Search limits of the temperature and number of reliability bins.
TEMPERATURE_LIMITS = (0.5, 5.0)
BINS = 40


def sample_columns(samples: DataFrame, p: str = "p", y: str = "y_true", std: str | None = None) -> DataFrame:
    """Confidence, half entropy, decision and correctness of every sample."""
    conf = pr.confidence(F.col(p))
    ok = (F.col(p) >= 0.5).cast("int") == F.col(y).cast("int")
    out = {
        "conf": conf, "shannon": pr.half_entropy(F.col(p)), "y_pred_b": F.col(p) >= 0.5, "pred_ok": ok, "pred_nok": ~ok,
    }
    if std is not None:
        out["conf_minus_std"] = conf - F.col(std)
    return samples.withColumns(out)


def reliability_bins(samples: DataFrame, keys: list[str], conf: Column, correct: Column, bins: int = BINS) -> DataFrame:
    """Accuracy and confidence per bin ``(k/n, (k+1)/n]``; a confidence of 0 is in no bin."""
    b = F.ceil(conf * bins)
    return samples.withColumn("bin", b.cast("int")).where("bin >= 1").groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(conf).alias("confidence")
    )


def calibration_errors(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and maximum calibration error, and overall accuracy and confidence."""
    gap, n = F.abs(F.col("accuracy") - F.col("confidence")), F.sum("n")
    return bins.groupBy(*keys).agg(
        (F.sum(gap * F.col("n")) / n).alias("ece"), F.max(gap).alias("mce"),
        (F.sum(F.col("accuracy") * F.col("n")) / n).alias("avg_accuracy"),
        (F.sum(F.col("confidence") * F.col("n")) / n).alias("avg_confidence"), n.alias("n"),
    )


def temperature_losses(samples: DataFrame, keys: list[str], p: Column, y: Column, temperatures: Column) -> DataFrame:
    """Mean log-loss per key and temperature in one pass.

    ``temperatures`` is a short array, the same or one per row; losses are combined
    before the shuffle, so only one row per key and temperature leaves a task.
    """
    spread = samples.select(*keys, pr.logit(p).alias("_logit"), y.alias("_y"), F.explode(temperatures).alias("t"))
    loss = pr.logit_loss(F.col("_logit") / F.col("t"), F.col("_y"))
    return spread.groupBy(*keys, "t").agg(F.avg(loss).alias("nll"))


def best_temperature(
    samples: DataFrame, key: str, p: str, y: str, limits: tuple[float, float] = TEMPERATURE_LIMITS, points: int = 31, tolerance: float = 1e-4
) -> DataFrame:
    """Temperature with the least log-loss per member.

    The loss is convex in ``1 / t``, so a grid over the limits brackets the minimum and
    each further pass searches the two neighbouring intervals on a grid of the same size.
    """
    samples = materialise(samples.select(key, p, y))  # read once per pass
    low, high = (float(x) for x in limits)
    # the first bracket is the same for all; later ones come from a written table of one row per member
    bounded = samples.withColumns({"_a": F.lit(low), "_z": F.lit(high)})
    width = (high - low) / (points - 1)
    while True:
        grid = F.transform(
            F.sequence(F.lit(0), F.lit(points - 1)),
            lambda i: F.col("_a") + i * (F.col("_z") - F.col("_a")) / (points - 1),
        )
        losses = temperature_losses(bounded, [key], F.col(p), F.col(y), grid)
        best = materialise(losses.groupBy(key).agg(F.min(F.struct("nll", "t")).alias("_b")).select(
            key, F.col("_b.t").alias("best_t"), F.col("_b.nll").alias("nll")
        ))
        if width <= tolerance:
            return best
        bounded = samples.join(best.select(
            key, F.greatest(F.col("best_t") - width, F.lit(low)).alias("_a"), F.least(F.col("best_t") + width, F.lit(high)).alias("_z")
        ), key)
        width = 2 * width / (points - 1)


def scale_members(members: DataFrame, temperatures: DataFrame, seed: str = "seed", p: str = "p") -> DataFrame:
    """Probabilities of every member scaled by its own temperature."""
    joined = with_parameters(members, temperatures.select(seed, "best_t"), [seed])
    return joined.withColumn(p, pr.temperature_scale(F.col(p), F.col("best_t"))).select(*members.columns)


def bound_flags(predictions: DataFrame, thr: float, mean: str = "pred", std: str = "pred_std") -> DataFrame:
    """Lower and upper extent with the calibrated threshold."""
    return predictions.withColumns({
        "pred_low_b": F.col(mean) - F.col(std) >= F.lit(1.0 - thr), "pred_high_b": F.col(mean) + F.col(std) >= F.lit(thr),
    })
