"""Patch centres, boxes, cutting, augmentation, scoring and mosaicking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.operators.inventory import grid_rows
from firnline.operators.ordering import row_numbers
from firnline.session import materialise
from firnline.tables import unbroadcast

# Fixed value: share of the patch size dropped on every side before mosaicking.
MARGIN_SHARE = 0.05


def stride_centres(cells: DataFrame, mask: Column, stride: int) -> DataFrame:
    """Masked cells whose coordinates are multiples of the stride."""
    on_grid = (F.col("x") % stride == 0) & (F.col("y") % stride == 0)
    return cells.where(mask & on_grid).select("entry_id", F.col("y").alias("y_center"), F.col("x").alias("x_center"))


def grid_centres(extents: DataFrame, radius: int, stride: int) -> DataFrame:
    """Full grid of centres per entry extent ``(nx, ny)``, with the end point appended.

    Rows of centres are placed by range before their columns open, see ``inventory.grid_rows``.
    """
    def last(n: str) -> Column:
        return F.greatest(F.ceil((F.col(n) - 2 * radius) / stride), F.lit(0))

    def centre(i: Column, n: str) -> Column:
        return F.when(i < last(n), radius + i * stride).otherwise(F.col(n) - radius).cast("bigint")

    rows = grid_rows(extents.select("entry_id", "nx", "ny"), ["entry_id"], F.lit(0), last("ny"), "_i")
    columns = F.transform(F.sequence(F.lit(0).cast("bigint"), last("nx").cast("bigint")), lambda i: centre(i, "nx"))
    return rows.select("entry_id", centre(F.col("_i"), "ny").alias("y_center"), F.explode(columns).alias("x_center"))


def extra_centres(
    cells: DataFrame, mask: Column, extremes: bool = False, centroid: bool = False, center: bool = False
) -> DataFrame:
    """Centres at the margins, the centroid and the box centre of the masked cells.

    The mean along each extreme row or column is aggregated per row and column first,
    so cells are read once and never joined back.
    """
    if not (extremes or centroid or center):
        raise ValueError("request at least one kind of centre")
    inside = cells.where(mask)
    cols = inside.groupBy("entry_id", "x").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = inside.groupBy("entry_id", "y").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    by_x = cols.groupBy("entry_id").agg(
        F.min("x").alias("minx"), F.max("x").alias("maxx"),
        F.min_by(F.floor(F.col("s") / F.col("n")), "x").alias("y_left"),
        F.max_by(F.floor(F.col("s") / F.col("n")), "x").alias("y_right"),
        F.floor(F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x_mean"),
    )
    by_y = rows.groupBy("entry_id").agg(
        F.min("y").alias("miny"), F.max("y").alias("maxy"),
        F.min_by(F.floor(F.col("s") / F.col("n")), "y").alias("x_top"),
        F.max_by(F.floor(F.col("s") / F.col("n")), "y").alias("x_bottom"),
        F.floor(F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y_mean"),
    )

    def centre(kind: str, y, x) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.col(y).alias("y_center") if isinstance(y, str) else y.alias("y_center"),
            F.col(x).alias("x_center") if isinstance(x, str) else x.alias("x_center"),
        )

    wanted = []
    if extremes:
        wanted += [
            centre("left", "y_left", "minx"), centre("top", "miny", "x_top"),
            centre("right", "y_right", "maxx"), centre("bottom", "maxy", "x_bottom"),
        ]
    if centroid:
        wanted.append(centre("centroid", "y_mean", "x_mean"))
    if center:
        wanted.append(centre(
            "center", F.floor((F.col("miny") + F.col("maxy")) / 2), F.floor((F.col("minx") + F.col("maxx")) / 2)
        ))
    return by_x.join(by_y, "entry_id").select("entry_id", F.inline(F.array(*wanted)))


def boxes(centres: DataFrame, radius: int) -> DataFrame:
    """Half-open pixel boxes of ``centre ± radius``."""
    return centres.withColumns({
        "minx": F.col("x_center") - radius, "miny": F.col("y_center") - radius,
        "maxx": F.col("x_center") + radius, "maxy": F.col("y_center") + radius,
    })


def cut(cells: DataFrame, patches: DataFrame, radius: int, whole_only: bool = True) -> DataFrame:
    """Cells of every patch.

    Patches and cells meet in square blocks as wide as a patch, so a patch touches at
    most four blocks and a large entry is spread over all of its blocks. With
    ``whole_only`` a patch that the raster does not cover completely is left out; its
    cells are counted in a window of one patch, whose partitioning a later grouping by
    patch can reuse.
    """
    side = 2 * radius
    by = F.sequence(F.floor(F.col("miny") / side), F.floor((F.col("maxy") - 1) / side))
    bx = F.sequence(F.floor(F.col("minx") / side), F.floor((F.col("maxx") - 1) / side))
    placed = patches.withColumn("_by", F.explode(by)).withColumn("_bx", F.explode(bx))
    keyed = cells.withColumns({"_by": F.floor(F.col("y") / side), "_bx": F.floor(F.col("x") / side)})
    inside = (
        (F.col("x") >= F.col("minx")) & (F.col("x") < F.col("maxx"))
        & (F.col("y") >= F.col("miny")) & (F.col("y") < F.col("maxy"))
    )
    hits = keyed.join(unbroadcast(placed), ["entry_id", "_by", "_bx"]).where(inside).drop("_by", "_bx")
    if not whole_only:
        return hits
    w = Window.partitionBy("entry_id", "y_center", "x_center")
    return hits.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") == side * side).drop("_n")


def subsample(
    patches: DataFrame, n: int, order: list[Column | str] | None = None, seed: int = 42, key: str = "entry_id"
) -> DataFrame:
    """Exactly ``n`` patches in proportion to the entries, at least one per entry.

    Rounding differences go to the entries that keep most. Too few patches: all stay.
    """
    counts = materialise(patches.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total, groups = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    if total is None or total < n:
        return patches
    fraction = (n - groups) / (total - groups) if total > groups else 0.0
    quota = counts.withColumn("_keep", (1 + F.bround((F.col("_n") - 1) * F.lit(float(fraction)), 0)).cast("bigint"))
    diff = n - quota.agg(F.sum("_keep")).first()[0]
    if diff:
        ranked = row_numbers(quota, [], [F.col("_keep").desc(), F.col(key).asc()], "_pos")
        step = 1 if diff > 0 else -1
        quota = ranked.withColumn("_keep", F.col("_keep") + F.when(F.col("_pos") <= abs(diff), step).otherwise(0))
    order = order or [F.xxhash64(F.lit(seed), *[F.col(c) for c in patches.columns])]
    placed = row_numbers(patches, [key], order, "_rn")
    return placed.join(quota.select(key, "_keep"), key).where("_rn <= _keep").drop("_rn", "_keep")


def augment(patch_cells: DataFrame, size: int, draw: Column | None = None, seed: int = 42) -> DataFrame:
    """One of the seven non-trivial symmetries of the square for about half of the patches.

    ``py`` and ``px`` are coordinates within the patch. ``draw`` is an integer per
    patch; values 0..6 pick a transform and anything else keeps the patch.
    """
    draw = draw if draw is not None else F.pmod(F.xxhash64(F.lit(seed), "patch_id"), F.lit(14))
    y, x, e = F.col("py"), F.col("px"), F.lit(size - 1)
    moves = [
        (x, e - y),      # rotate 90
        (e - y, e - x),  # rotate 180
        (e - x, y),      # rotate 270
        (y, e - x),      # flip left-right
        (e - y, x),      # flip up-down
        (x, y),          # flip along the main diagonal
        (e - x, e - y),  # flip along the counter diagonal
    ]
    new_y, new_x = y, x
    for i, (my, mx) in enumerate(moves):
        new_y, new_x = F.when(F.col("_d") == i, my).otherwise(new_y), F.when(F.col("_d") == i, mx).otherwise(new_x)
    return patch_cells.withColumn("_d", draw).withColumns({"py": new_y, "px": new_x}).drop("_d")


Scorer = Callable[[np.ndarray], np.ndarray]


def score(patch_cells: DataFrame, channels: list[str], size: int, scorer: Scorer) -> DataFrame:
    """Apply a user function ``(n, channels, size, size) -> (n, size, size)`` to whole patches.

    A patch holds ``size * size`` cells by construction, which bounds the packed row.
    Batches of patches reach the function through Arrow.
    """
    key = ["entry_id", "y_center", "x_center"]
    stack = F.array(*[F.col(c).cast("double") for c in channels])
    packed = patch_cells.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", stack.alias("v")))).alias("_cells")
    ).select(
        *key, F.col("_cells")[0]["y"].alias("miny"), F.col("_cells")[0]["x"].alias("minx"),
        F.flatten(F.transform("_cells", lambda c: c["v"])).alias("_values"),
    )
    fields = [packed.schema[c] for c in [*key, "miny", "minx"]]
    schema = T.StructType([*fields, T.StructField("p", T.ArrayType(T.DoubleType()))])
    n_channels = len(channels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            cube = np.stack(batch["_values"].to_numpy()).reshape(len(batch), size, size, n_channels)
            out = np.asarray(scorer(np.moveaxis(cube, 3, 1)), dtype="float64").reshape(len(batch), size * size)
            yield batch.drop(columns="_values").assign(p=list(out))

    scored = packed.mapInPandas(run, schema)
    return scored.select(*key, "miny", "minx", F.posexplode("p").alias("_i", "p")).select(
        *key,
        (F.col("miny") + F.floor(F.col("_i") / size)).alias("y"),
        (F.col("minx") + F.col("_i") % size).alias("x"),
        "p",
    )


def mosaic(scored: DataFrame, radius: int, margin_share: float = MARGIN_SHARE) -> DataFrame:
    """Mean of overlapping patches per cell, after dropping a margin on every side."""
    margin = int(2 * radius * margin_share)
    dy, dx = F.col("y") - F.col("y_center"), F.col("x") - F.col("x_center")
    keep = (
        (dy >= margin - radius) & (dy < radius - margin) & (dx >= margin - radius) & (dx < radius - margin)
    )
    return scored.where(keep).groupBy("entry_id", "y", "x").agg(F.avg("p").alias("pred"))


def parameters(
    patch_radius: int, stride_train: int, gsd: float, sampling_buffer: float, export_patches: bool,
    stride_val: int | None = None, stride_infer: int | None = None, cube_buffer: float | None = None,
    automated_selection: bool = True, min_coverage: float = 0.0, max_cloud_p: float = 1.0,
    sort_by: tuple[str, ...] = (), cloud_source: str | None = None,
) -> dict:
    """Operator arguments that follow from a few settings, with their consistency checks."""
    if (max_cloud_p < 1.0 or "cloud_p" in sort_by) and cloud_source is None:
        raise ValueError("cloud filtering or sorting needs a cloud source")
    if stride_val is None:
        stride_val = stride_train if export_patches else 2 * stride_train
    if stride_infer is None:
        stride_infer = stride_train // 2 if export_patches else stride_train
    if stride_infer >= int(0.9 * patch_radius):
        raise ValueError("inference stride must stay below 90 % of the patch radius")
    if not automated_selection:
        min_coverage, max_cloud_p = 0.0, 1.0
    return {
        "stride_val": stride_val,
        "stride_infer": stride_infer,
        "cube_buffer": patch_radius * gsd + sampling_buffer if cube_buffer is None else cube_buffer,
        "min_coverage": min_coverage,
        "max_cloud_p": max_cloud_p,
    }
