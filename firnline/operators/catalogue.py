"""Scene catalogue: scan, identifiers, de-duplication and daily mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions import geometry, naming
from firnline.tables import require_columns

# Fixed value: share of a region that a single tile must cover to need no mosaic.
FULL_COVERAGE = 0.98


def scan(images: DataFrame, start: Column | str, end: Column | str, bounds: Column | None = None) -> DataFrame:
    """Images inside a half-open date range whose ``box`` meets ``bounds``.

    Both predicates are plain comparisons, so a parquet scan can use them.
    """
    lo = F.lit(start).cast("date") if isinstance(start, str) else start
    hi = F.lit(end).cast("date") if isinstance(end, str) else end
    hits = images.where((F.col("date") >= lo) & (F.col("date") < hi))
    return hits if bounds is None else hits.where(geometry.boxes_meet(F.col("box"), bounds))


def parse_scene_ids(images: DataFrame, scene_id: str = "scene_id") -> DataFrame:
    """Add date, processing time and tile taken from the scene id."""
    require_columns(images, [scene_id])
    return images.withColumns(naming.scene_id_parts(F.col(scene_id)))


def latest_reprocessing(images: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The most recently processed scene per date and tile."""
    keys = keys or ["entry_id"]
    w = Window.partitionBy(*keys, "date", "tile").orderBy(F.col("processing_time").desc(), F.col("scene_id").asc())
    return images.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def full_tile_per_day(images: DataFrame, keys: list[str] | None = None, share: float = FULL_COVERAGE) -> DataFrame:
    """One scene per day among those that cover the region: latest processing, then tile."""
    keys = keys or ["entry_id"]
    w = Window.partitionBy(*keys, "date").orderBy(F.col("processing_time").desc(), F.col("tile").asc())
    return (
        images.where(F.col("coverage") >= share)
        .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    )


def scenes_needing_mosaic(images: DataFrame, full: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All scenes of the days that have no covering tile."""
    keys = [*(keys or ["entry_id"]), "date"]
    return images.join(full.select(*keys), keys, "left_anti")


def mosaic_cells(cells: DataFrame, bands: list[str], keys: list[str] | None = None, order: str = "order") -> DataFrame:
    """Stack the scenes of a day: per cell and band the valid value with the highest order wins."""
    keys = keys or ["entry_id", "date", "y", "x"]
    return cells.groupBy(*keys).agg(*[
        F.max_by(b, F.when(F.col(b).isNotNull(), F.col(order))).alias(b) for b in bands
    ])


def mosaic_metadata(scenes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Ids joined by ``-``, tile list and per-tile metadata of every daily mosaic.

    Lists are bounded by the number of tiles that overlap one region on one day.
    """
    keys = keys or ["entry_id", "date"]
    parts = F.array_sort(F.collect_list(F.struct("scene_id", "tile", "coverage", "processing_time")))
    return scenes.groupBy(*keys).agg(parts.alias("_p")).select(
        *keys,
        F.array_join(F.transform("_p", lambda p: p["scene_id"]), "-").alias("image_id"),
        F.transform("_p", lambda p: p["tile"]).alias("tiles"),
        F.map_from_arrays(
            F.transform("_p", lambda p: p["scene_id"]),
            F.transform("_p", lambda p: F.struct(
                p["tile"].alias("tile"), p["coverage"].alias("coverage"), p["processing_time"].alias("processing_time")
            )),
        ).alias("metadata_tiles"),
    )


def covered_share(cells: DataFrame, keys: list[str], ok: Column, gsd: float, roi_area: Column) -> DataFrame:
    """Area of usable cells over the area of the region."""
    n_ok = F.sum(F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0)))
    return cells.groupBy(*keys).agg(F.try_divide(n_ok * gsd * gsd, F.first(roi_area)).alias("coverage"))


def attach_companion(images: DataFrame, companions: DataFrame, columns: list[str]) -> DataFrame:
    """Attach columns of the companion scene that has exactly the same id."""
    return images.join(companions.select("scene_id", *columns), "scene_id", "inner")


def query_windows(entries: DataFrame, year: int | None, season: tuple[str, str] | None) -> DataFrame:
    """Half-open search window per entry.

    With a season, the year is the given one or that of the inventory date; without,
    the window is the single acquisition day. Entries without a date are left out.
    """
    if season is None:
        start, end = naming.single_day(F.col("date_acq"))
        return entries.where(F.col("date_acq").isNotNull()).withColumns({"start": start, "end": end})
    y = F.lit(year) if year is not None else F.year("date_inv")
    start, end = naming.season_window(y, *season)
    return entries.withColumns({"start": start, "end": end})
