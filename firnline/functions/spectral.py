"""Band arithmetic."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Broadband albedo weights (Wang et al. 2016) and reflectance scale.
ALBEDO_BLUE = 0.5621
ALBEDO_GREEN = 0.1479
ALBEDO_RED = 0.2512
ALBEDO_OFFSET = 0.0015
REFLECTANCE_SCALE = 10000.0


def nonzero(den: Column) -> Column:
    """A denominator in which zero counts as one."""
    return F.when(den == 0, F.lit(1.0)).otherwise(den)


def normalised_difference(a: Column, b: Column) -> Column:
    return (a - b) / nonzero(a + b)


def ndsi(green: Column, swir: Column) -> Column:
    return normalised_difference(green, swir)


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalised_difference(green, nir)


def albedo(blue: Column, green: Column, red: Column, scale: float = REFLECTANCE_SCALE) -> Column:
    """Broadband albedo; ``scale`` turns stored reflectance into [0, 1]."""
    s = F.lit(float(scale))
    return (
        F.lit(ALBEDO_BLUE) * (blue / s)
        + F.lit(ALBEDO_GREEN) * (green / s)
        + F.lit(ALBEDO_RED) * (red / s)
        + F.lit(ALBEDO_OFFSET)
    )


def band_ratio(red: Column, swir: Column) -> Column:
    return red / F.when(swir.isNotNull(), F.greatest(swir, F.lit(1.0)))


def band_ratio_class(red: Column, swir: Column, blue: Column, ratio_thr, blue_thr) -> Column:
    return (band_ratio(red, swir) >= ratio_thr) & (blue >= blue_thr)


def flag_mask(flags: list[str]) -> Column:
    """OR of flag bands equal to 1; a leading ``~`` negates a flag. A missing flag is not 1."""
    def one(name: str) -> Column:
        hit = F.col(name.lstrip("~")).eqNullSafe(F.lit(1))
        return ~hit if name.startswith("~") else hit

    return reduce(lambda a, b: a | b, [one(f) for f in flags])


def cloud_mask(cloud_probability: Column, threshold: float, no_data: Column) -> Column:
    """Percent probability above ``threshold`` (a share), or no data."""
    return (cloud_probability > F.lit(threshold * 100)) | no_data


def clear_score_to_cloud(score: Column) -> Column:
    """Clear-sky score in [0, 1] to cloud percent."""
    return (F.lit(1.0) - score) * 100


def band_expression(text: str, bands: dict[str, str]) -> Column:
    """A textual band expression, with each variable bound to a column."""
    names = sorted(bands, key=len, reverse=True)
    variable = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b")
    return F.expr(variable.sub(lambda m: f"`{bands[m.group(1)]}`", text))
