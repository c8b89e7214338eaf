"""Probabilities, temperature scaling and pixel losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clipping bounds, loss parameters, share of a normal law within one sigma.
TEMPERATURE_CLIP = 1e-6
ENTROPY_CLIP = 1e-5
FOCAL_GAMMA = 2.0
FOCAL_ALPHA = 0.25
DICE_EPS = 1e-6
LOG_FLOOR = -100.0
ONE_SIGMA_SHARE = 0.6826894921370859


def clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def logit(p: Column) -> Column:
    """Log-odds of a probability clipped away from 0 and 1."""
    q = clip(p, TEMPERATURE_CLIP, 1.0 - TEMPERATURE_CLIP)
    return F.log(q / (F.lit(1.0) - q))


def temperature_scale(p: Column, t) -> Column:
    """Sigmoid of the logit divided by ``t``."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(logit(p) / t)))


def confidence(p: Column) -> Column:
    return F.when(p <= 0.5, F.lit(1.0) - p).otherwise(p)


def half_entropy(p: Column) -> Column:
    """Binary entropy in nats divided by two."""
    q = clip(p, ENTROPY_CLIP, 1.0 - ENTROPY_CLIP)
    return -(q * F.log(q) + (F.lit(1.0) - q) * F.log(F.lit(1.0) - q)) / 2


def logit_loss(z: Column, y: Column) -> Column:
    """Negative log-likelihood of a 0/1 label whose log-odds are ``z``."""
    return F.log1p(F.exp(F.when(y == 1, -z).otherwise(z)))


def binary_cross_entropy(p: Column, y: Column) -> Column:
    """Cross-entropy whose logarithms never fall below a floor, so p = 0 or 1 is finite."""
    floor = F.lit(LOG_FLOOR)
    log_p = F.when(p > 0, F.greatest(F.log(p), floor)).otherwise(floor)
    log_q = F.when(p < 1, F.greatest(F.log(F.lit(1.0) - p), floor)).otherwise(floor)
    return -(y * log_p + (F.lit(1.0) - y) * log_q)


def focal(p: Column, y: Column, gamma: float = FOCAL_GAMMA, alpha: float = FOCAL_ALPHA) -> Column:
    one = F.lit(1.0)
    p_t = p * y + (one - p) * (one - y)
    loss = binary_cross_entropy(p, y) * F.pow(one - p_t, F.lit(gamma))
    if alpha >= 0:
        loss = (F.lit(alpha) * y + F.lit(1.0 - alpha) * (one - y)) * loss
    return loss


def row_mean(cols: list[Column]) -> Column:
    """Mean over member columns of a row."""
    n = F.lit(float(len(cols)))
    return F.aggregate(F.array(*cols), F.lit(0.0), lambda a, v: a + v) / n


def row_std(cols: list[Column]) -> Column:
    """Population standard deviation over member columns of a row."""
    m = row_mean(cols)
    n = F.lit(float(len(cols)))
    return F.sqrt(F.aggregate(F.array(*[(c - m) * (c - m) for c in cols]), F.lit(0.0), lambda a, v: a + v) / n)
