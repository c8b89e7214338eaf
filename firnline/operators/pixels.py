"""Cell-level algebra, normalisation constants and feature rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import spectral
from firnline.functions.probability import clip
from firnline.operators.ordering import exact_quantiles, raster_row_numbers
from firnline.session import materialise
from firnline.tables import join_null_safe, require_columns, unbroadcast

CELL = ["entry_id", "y", "x"]


def select_bands(cells: DataFrame, names: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Keep and rename bands; a missing band is an error."""
    require_columns(cells, list(names))
    return cells.select(*(keep or CELL), *[F.col(old).alias(new) for old, new in names.items()])


def keep_where(cells: DataFrame, mask: Column, columns: list[str]) -> DataFrame:
    """NULL outside the mask, for the given columns."""
    return cells.withColumns({c: F.when(mask, F.col(c)) for c in columns})


def restrict_to_roi(cells: DataFrame, prediction: str, infer: Column, fp: Column) -> DataFrame:
    """A binary prediction becomes false outside the inference and false-positive regions."""
    return cells.withColumn(prediction, F.when(infer | fp, F.col(prediction)).otherwise(F.lit(False)))


def other_outline(any_outline: Column, this_outline: Column) -> Column:
    """Cells that belong to an outline, but not to the current one (or the reverse)."""
    return ~any_outline.eqNullSafe(this_outline)


def reduce_region(cells: DataFrame, region: DataFrame, keys: list[str], reducers: dict[str, Column]) -> DataFrame:
    """Aggregate the cells that fall into a region given as a cell set."""
    inside = cells.join(unbroadcast(region.select(*CELL)), CELL, "left_semi")
    return inside.groupBy(*keys).agg(*[c.alias(n) for n, c in reducers.items()])


def norm_partials(cells: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Count, sum, sum of squares, minimum and maximum per key and variable.

    Aggregated wide and unpivoted afterwards, so no cell row is duplicated.
    """
    aggs = []
    for v in variables:
        c = F.col(v).cast("double")
        aggs.append(F.struct(
            F.lit(v).alias("var_name"), F.count(c).alias("n"), F.sum(c).alias("sum_1"),
            F.sum(c * c).alias("sum_2"), F.min(c).alias("vmin"), F.max(c).alias("vmax"),
        ).alias(f"_{v}"))
    wide = cells.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*[F.col(f"_{v}") for v in variables])))


def merge_norm_stats(partials: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Mean and population deviation from sums; bounds are quantiles of the per-file extrema."""
    partials = materialise(partials)  # read twice; the cells are not
    n = F.greatest(F.sum("n"), F.lit(1))
    s1, s2 = F.sum("sum_1"), F.sum("sum_2")
    moments = partials.groupBy("var_name").agg(
        (s1 / n).alias("mu"), F.sqrt(F.greatest((s2 - s1 * s1 / n) / n, F.lit(0.0))).alias("stddev")
    )
    ends = partials.select(
        F.inline(F.array(
            F.struct(F.col("var_name"), F.lit(0).alias("side"), F.col("vmin").alias("v")),
            F.struct(F.col("var_name"), F.lit(1).alias("side"), F.col("vmax").alias("v")),
        ))
    )
    q = exact_quantiles(ends, ["var_name", "side"], F.col("v"), {"lo": low, "hi": high})
    bounds = q.groupBy("var_name").agg(
        F.max(F.when(F.col("side") == 0, F.col("lo"))).alias("vmin"),
        F.max(F.when(F.col("side") == 1, F.col("hi"))).alias("vmax"),
    )
    return moments.join(bounds, "var_name", "left").select("var_name", "mu", "stddev", "vmin", "vmax")


def training_only(partials: DataFrame, folds: DataFrame) -> DataFrame:
    """Partials of the entries in the training fold."""
    return partials.join(folds.where(F.col("fold") == "train").select("entry_id"), "entry_id", "left_semi")


def fill_with_mean(
    cells: DataFrame, keys: list[str], columns: list[str], bias_corrected: bool = False, mask: str | None = None
) -> DataFrame:
    """Replace missing values by the mean of their key.

    By default the sum is divided by all cells, valid or not; ``bias_corrected`` divides
    by the valid ones. With ``mask``, filled cells also enter that mask column.
    """
    n = (lambda c: F.count(c)) if bias_corrected else (lambda c: F.count(F.lit(1)))
    means = cells.groupBy(*keys).agg(*[
        F.try_divide(F.coalesce(F.sum(c), F.lit(0.0)), n(c)).alias(f"_m_{c}") for c in columns
    ])
    out = join_null_safe(cells, means, keys)
    if mask is not None:
        gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
        out = out.withColumn(mask, F.col(mask) | gap)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns])


def fill_with_constant(cells: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return cells.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def read_stats(stats: DataFrame, variables: list[str]) -> dict[str, dict[str, float]]:
    """Normalisation constants as driver values: exactly one row per variable."""
    rows = stats.where(F.col("var_name").isin(variables)).limit(len(variables) + 1).collect()
    found = {r["var_name"]: r.asDict() for r in rows}
    if len(rows) != len(variables) or len(found) != len(variables):
        raise ValueError(f"expected one row per variable {variables}, got {sorted(r['var_name'] for r in rows)}")
    return found


def check_one_scaling(standardise: bool, minmax: bool) -> None:
    if standardise and minmax:
        raise ValueError("choose either standardisation or min-max scaling, not both")


def standardise(
    cells: DataFrame, stats: DataFrame, bands: list[str], extra: list[str] | None = None, per_band: bool = True
) -> DataFrame:
    """``(x - mu) / sigma``; without ``per_band`` all bands share the mean constants. NULL where sigma is 0."""
    extra = extra or []
    s = read_stats(stats, bands + extra)
    mu = {v: s[v]["mu"] for v in s}
    sd = {v: s[v]["stddev"] for v in s}
    if not per_band:
        shared_mu = sum(mu[b] for b in bands) / len(bands)
        shared_sd = sum(sd[b] for b in bands) / len(bands)
        mu.update({b: shared_mu for b in bands})
        sd.update({b: shared_sd for b in bands})
    return cells.withColumns({v: F.try_divide(F.col(v) - F.lit(mu[v]), F.lit(sd[v])) for v in bands + extra})


def minmax_scale(
    cells: DataFrame, stats: DataFrame, bands: list[str], extra: list[str] | None = None, per_band: bool = True
) -> DataFrame:
    """Clip to the bounds of each band, then scale by its own or by the common bounds; NULL where those coincide."""
    extra = extra or []
    s = read_stats(stats, bands + extra)
    low, high = min(s[b]["vmin"] for b in bands), max(s[b]["vmax"] for b in bands)
    out = {}
    for v in bands + extra:
        a, z = s[v]["vmin"], s[v]["vmax"]
        clipped = clip(F.col(v), a, z)
        if v in bands and not per_band:
            a, z = low, high
        out[v] = F.try_divide(clipped - F.lit(a), F.lit(z - a))
    return cells.withColumns(out)


def scale_bands(
    cells: DataFrame, stats: DataFrame, bands: list[str], standardised: bool, minmax: bool, per_band: bool = True
) -> DataFrame:
    """The one scaling that the settings name, or the cells as they are; both at once are refused."""
    check_one_scaling(standardised, minmax)
    if standardised:
        return standardise(cells, stats, bands, per_band=per_band)
    return minmax_scale(cells, stats, bands, per_band=per_band) if minmax else cells


def contrast_stretch(cells: DataFrame, keys: list[str], bands: list[str], q: float = 0.025, scale: bool = True) -> DataFrame:
    """Clip every band to its symmetric quantiles and scale to [0, 1].

    A band whose quantiles coincide is left as it is, and so is one without values.
    """
    long = cells.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands
    ])))
    limits = exact_quantiles(long, [*keys, "band"], F.col("v"), {"lo": q, "hi": 1 - q})
    wide = limits.groupBy(*keys).agg(*[
        F.max(F.when(F.col("band") == b, F.col(side))).alias(f"_{side}_{b}") for b in bands for side in ("lo", "hi")
    ])
    out = {}
    for b in bands:
        lo, hi = F.col(f"_lo_{b}"), F.col(f"_hi_{b}")
        value = clip(F.col(b), lo, hi)
        if scale:
            value = F.least(F.try_divide(value - lo, hi - lo), F.lit(1.0))
        out[b] = F.when((lo == hi) | lo.isNull(), F.col(b)).otherwise(value)
    joined = join_null_safe(cells, wide, keys, "left")
    return joined.withColumns(out).select(*cells.columns)


def every_nth(cells: DataFrame, fraction: float, key: str = "entry_id") -> DataFrame:
    """Every ``int(1 / fraction)``-th cell of an entry in row-major order, from the first."""
    step = int(1 / fraction)
    return raster_row_numbers(cells, key, "_rn").where((F.col("_rn") - 1) % step == 0).drop("_rn")


def terrain_inputs(slope: Column, aspect: Column) -> dict[str, Column]:
    """Slope over 90 degrees, and sine and cosine of the aspect."""
    return {
        "slope": slope / 90,
        "aspect_sin": F.sin(F.radians(aspect)),
        "aspect_cos": F.cos(F.radians(aspect)),
    }


INDEX_INPUTS = {
    "NDSI": lambda b: spectral.ndsi(b["G"], b["SWIR"]),
    "NDVI": lambda b: spectral.ndvi(b["NIR"], b["R"]),
    "NDWI": lambda b: spectral.ndwi(b["G"], b["NIR"]),
}


def channel_order(
    bands: list[str], indices: list[str] | None = None, dem: bool = False, dem_features: list[str] | None = None,
    dhdt: bool = False, velocity: bool = False,
) -> list[str]:
    """Input channels in their contractual order."""
    return [
        *bands, *(indices or []), *(["dem"] if dem else []), *(dem_features or []),
        *(["dhdt"] if dhdt else []), *(["v"] if velocity else []),
    ]


def feature_rows(
    cells: DataFrame, bands: dict[str, str], indices: list[str], no_data: Column, outline: Column, any_outline: Column,
    debris: Column | None = None, terrain: dict[str, Column] | None = None, extra: list[str] | None = None,
) -> DataFrame:
    """All model inputs and masks of a cell in one projection."""
    unknown = set(indices) - set(INDEX_INPUTS)
    if unknown:
        raise ValueError(f"unknown indices: {sorted(unknown)}")
    band = {n: F.col(c) for n, c in bands.items()}
    cols = [c.alias(n) for n, c in band.items()]
    cols += [INDEX_INPUTS[i](band).alias(i) for i in indices]
    cols += [c.alias(n) for n, c in (terrain or {}).items()]
    cols += [F.col(c) for c in extra or []]
    cols += [
        no_data.alias("mask_no_data"), outline.alias("mask_crt_g"), any_outline.alias("mask_all_g"),
    ]
    if debris is not None:
        cols += [(debris & outline).alias("mask_debris_crt_g"), (debris & any_outline).alias("mask_debris_all_g")]
    return cells.select(*CELL, *cols)
