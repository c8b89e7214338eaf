"""Outline inventory: derived columns, look-ups, set operations and cropping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import geometry
from firnline.operators.ordering import row_numbers
from firnline.tables import columns_first, missing_to_null, require_columns, unbroadcast

# Fixed value: objects below one 10 m pixel (km2) are dropped.
MIN_OBJECT_KM2 = 1e-4


def with_dense_ids(inventory: DataFrame, name: str = "entry_id_i") -> DataFrame:
    """Integer ids 1..n in order of ``entry_id``, unless the table already has them."""
    return inventory if name in inventory.columns else row_numbers(inventory, [], ["entry_id"], name)


def with_auxiliary_columns(inventory: DataFrame, rings: str = "rings") -> DataFrame:
    """Id, area, interior point and local UTM zone, each only where it is missing.

    Outlines in metres need ``cenlat`` and ``cenlon``. Without them the interior point is the
    centre, and coordinates that cannot be degrees are an error.
    """
    out = with_dense_ids(require_columns(inventory, ["entry_id", rings]))
    out = out.withColumn("_edges", geometry.edges(F.col(rings)))
    if "area_km2" not in out.columns:
        out = out.withColumn("area_km2", geometry.area(F.col("_edges")) / 1e6)
    if "cenlat" not in out.columns or "cenlon" not in out.columns:
        out = geometry.with_interior_point(out, "_edges", "_p")
        out = out.withColumns({"cenlat": F.col("_p.y"), "cenlon": F.col("_p.x")}).drop("_p")
        wrong = out.where((F.abs("cenlat") > 90) | (F.abs("cenlon") > 180)).select("entry_id").limit(10).collect()
        if wrong:
            raise ValueError(f"coordinates are not degrees, so cenlat and cenlon are needed: {', '.join(str(r[0]) for r in wrong)}")
    out = out.drop("_edges")
    if "utm_zone" not in out.columns or "utm_epsg" not in out.columns:
        out = out.withColumn("utm_epsg", geometry.utm_code(F.col("cenlat"), F.col("cenlon")))
        out = out.withColumn("utm_zone", geometry.utm_zone(F.col("utm_epsg")))
    return columns_first(out, ["entry_id", "entry_id_i", "area_km2"])


def with_crs(inventory: DataFrame, crs: str | None) -> DataFrame:
    """A fixed reference system, or the local zone of each outline."""
    return inventory.withColumn("crs_epsg", F.lit(crs) if crs is not None else F.col("utm_epsg"))


def at_least(inventory: DataFrame, min_area: float, column: str = "area_km2") -> DataFrame:
    return inventory.where(F.col(column) >= min_area)


def correct(inventory: DataFrame, column: str, wrong, right) -> DataFrame:
    """Replace one known wrong value."""
    value = F.col(column)
    return inventory.withColumn(column, F.when(value == F.lit(wrong), F.lit(right)).otherwise(value))


def with_attribute(left: DataFrame, right: DataFrame, attribute: str, name: str, key: str = "entry_id") -> DataFrame:
    """Look up one attribute; NULL where the key is unknown."""
    return left.join(right.select(key, F.col(attribute).alias(name)), key, "left")


def with_curated_dates(inventory: DataFrame, dates: DataFrame) -> DataFrame:
    """Acquisition date from a curated table; entries it lacks are left out."""
    return with_attribute(inventory, dates, "date", "date_acq").where(F.col("date_acq").isNotNull())


def with_default(left: DataFrame, right: DataFrame, columns: dict[str, float], key: str = "entry_id") -> DataFrame:
    """Left join in which unmatched columns take a default."""
    joined = left.join(right.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in columns.items()})


def every_inventory_row(values: DataFrame, inventory: DataFrame, key: str = "entry_id") -> DataFrame:
    """Right join: inventory rows without values stay."""
    return values.join(inventory, key, "right")


def only_known(df: DataFrame, keys: DataFrame, key: str = "entry_id") -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def only_unknown(df: DataFrame, keys: DataFrame, key: str = "entry_id") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def align(driving: DataFrame, tables: list[DataFrame], key: str = "entry_id") -> DataFrame:
    """Several keyed tables brought to the keys of a driving table."""
    return reduce(lambda acc, t: acc.join(t, key, "left"), tables, driving)


def with_parameters(df: DataFrame, parameters: DataFrame, key: list[str]) -> DataFrame:
    """Join a parameter table that must have one row per key; Spark's size rule picks the join."""
    n, distinct = parameters.agg(F.count(F.lit(1)), F.count_distinct(*key)).first()
    if n != distinct:
        raise ValueError(f"parameters are not unique on {key}")
    return df.join(parameters, key, "inner")


def keys_in_at_least(tables: list[DataFrame], n: int, key: str = "entry_id") -> DataFrame:
    """Keys that occur in at least ``n`` of the tables."""
    tagged = [t.select(key).withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    both = reduce(lambda a, b: a.unionByName(b), tagged).distinct()
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(key)


def assert_subset(df: DataFrame, keys: DataFrame, key: str = "entry_id", preview: int = 10) -> DataFrame:
    """Return ``df``, or fail with the first few keys that ``keys`` lacks."""
    unknown = [str(r[0]) for r in df.select(key).distinct().join(keys.select(key), key, "left_anti").limit(preview).collect()]
    if unknown:
        raise ValueError(f"unknown {key}: {', '.join(sorted(unknown))}")
    return df


def with_fallback(primary: DataFrame, second: DataFrame, third: DataFrame, key: str = "entry_id") -> DataFrame:
    """``primary`` and ``second``, plus what ``third`` knows about entries ``second`` lacks."""
    rest = third.join(second.select(key), key, "left_anti")
    return primary.unionByName(second).unionByName(rest)


def part_shares(parts: DataFrame, part: str, total: str, key: str = "entry_id") -> DataFrame:
    """Share of the summed part in the total that each key carries."""
    return parts.groupBy(key).agg(F.sum(part).alias(part), F.max(total).alias(total)).withColumn(
        "share", F.try_divide(F.col(part), F.col(total))
    )


def share_report(parts: DataFrame, part: str, total: str, key: str = "entry_id", min_share: float | None = None) -> DataFrame:
    """One row: number of keys, totals and overall share, optionally of keys above a share."""
    shares = part_shares(parts, part, total, key)
    if min_share is not None:
        shares = shares.where(F.col("share") >= min_share)
    return shares.agg(
        F.count(F.lit(1)).alias("n"), F.sum(total).alias(total), F.sum(part).alias(part),
        (F.try_divide(F.sum(part), F.sum(total)) * 100).alias("percent"),
    )


def cell_extents(cells: DataFrame, grow: int = 0, key: str = "entry_id") -> DataFrame:
    """Cell box of every entry, grown on all sides (inclusive bounds)."""
    return cells.groupBy(key).agg(
        (F.min("y") - grow).alias("miny"), (F.max("y") + grow).alias("maxy"),
        (F.min("x") - grow).alias("minx"), (F.max("x") + grow).alias("maxx"),
    )


#: Rows of a grid that open together.
GRID_ROWS = 64


def grid_rows(extents: DataFrame, keys: list[str], low: Column, high: Column, name: str) -> DataFrame:
    """``extents`` with a row for each whole number from ``low`` to ``high``, none where ``high`` is less.

    Ranges of rows are placed by key and range before they open, so neither the rows nor the
    columns of a large extent come out of one task. The number of partitions is stated, because
    adaptive execution would merge the small ranges into one.
    """
    n = int(extents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = extents.withColumns({"_low": low.cast("bigint"), "_high": high.cast("bigint")}).where("_low <= _high")
    ranges = ends.withColumn("_from", F.explode(F.sequence("_low", "_high", F.lit(GRID_ROWS).cast("bigint"))))
    placed = ranges.repartition(n, *keys, "_from")
    rows = F.sequence("_from", F.least(F.col("_from") + GRID_ROWS - 1, F.col("_high")))
    return placed.withColumn(name, F.explode(rows)).drop("_low", "_high", "_from")


def crop(cells: DataFrame, extents: DataFrame, pad: bool = False, key: str = "entry_id") -> DataFrame:
    """Cells inside the box of their entry; with ``pad`` missing ones appear as NULLs."""
    inside = (F.col("y").between(F.col("miny"), F.col("maxy"))) & (F.col("x").between(F.col("minx"), F.col("maxx")))
    if not pad:
        return cells.join(extents, key).where(inside).select(*cells.columns)
    rows = grid_rows(extents.select(key, "minx", "maxx", "miny", "maxy"), [key], F.col("miny"), F.col("maxy"), "y")
    grid = rows.where("minx <= maxx").select(key, "y", F.explode(F.sequence("minx", "maxx")).alias("x"))
    return grid.join(unbroadcast(cells), [key, "y", "x"], "left")


def require_covered(cells: DataFrame, extents: DataFrame, key: str = "entry_id") -> DataFrame:
    """Return ``cells``, or fail where the data does not reach the wanted box."""
    have = cell_extents(cells).select(key, *[F.col(c).alias(f"_{c}") for c in ("miny", "maxy", "minx", "maxx")])
    short = extents.join(have, key, "left").where(
        F.col("_miny").isNull() | (F.col("_miny") > F.col("miny")) | (F.col("_maxy") < F.col("maxy"))
        | (F.col("_minx") > F.col("minx")) | (F.col("_maxx") < F.col("maxx"))
    )
    names = [str(r[0]) for r in short.select(key).limit(10).collect()]
    if names:
        raise ValueError(f"data does not cover the box of: {', '.join(names)}")
    return cells


def check_regions(regions: DataFrame, parents: DataFrame, key: str = "entry_id") -> DataFrame:
    """What a region must fulfil, by key: ``one_geometry, known_crs, flat, inside, valid``.

    ``regions`` has ``rings`` and ``crs``, ``parents`` has ``rings``. A region is one row with a
    known reference system and finite x and y only, and lies inside its parent, judged by
    its edges and not by its box. A region without a parent is not inside.
    """
    finite = lambda p: missing_to_null(p["x"]).isNotNull() & missing_to_null(p["y"]).isNotNull()
    flat = F.forall(F.flatten("rings"), finite) & (F.size(F.flatten("rings")) >= 3)
    outer = parents.select(key, geometry.edges(F.col("rings")).alias("_outer"))
    met = regions.select(key, "crs", "rings", geometry.edges(F.col("rings")).alias("_inner")).join(outer, key, "left")
    inside = F.coalesce(geometry.outline_inside(F.col("_inner"), F.col("_outer")), F.lit(False))
    checked = met.groupBy(key).agg(
        (F.count(F.lit(1)) == 1).alias("one_geometry"), F.bool_and(F.col("crs").isNotNull()).alias("known_crs"),
        F.bool_and(F.coalesce(flat, F.lit(False))).alias("flat"), F.bool_and(inside).alias("inside"),
    )
    return checked.withColumn("valid", F.col("one_geometry") & F.col("known_crs") & F.col("flat") & F.col("inside"))


def in_roi(box: Column, parent: Column) -> Column:
    """A region is valid when it lies inside its parent."""
    return geometry.box_inside(box, parent)
