"""Neighbourhood operators on cells: gap filling, terrain, resampling."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.operators.ordering import rank_lookup, running_totals
from firnline.session import materialise
from firnline.tables import unbroadcast

# Number of source cells for gap filling, and the 3-point Gaussian (sigma 1, radius 1).
FILL_CELLS = 30
GAUSS_SIDE = 0.27406862
GAUSS_MID = 0.45186276

CELL = ["entry_id", "y", "x"]


#: Side of the tiles of cells that one task fills at once, and of the blocks within them that share a list of sources.
TILE = 64
SUB = 8


def nearest_fill(cells: DataFrame, value: str, to_fill: Column, ok: Column, k: int = FILL_CELLS) -> DataFrame:
    """Mean of the ``k`` nearest usable cells of the entry, ties included.

    Returns ``entry_id, y, x, filled``. A usable cell without a value is no source. Entries
    with fewer than ``k`` sources are left out. Sources deep inside solid ground are never among
    the nearest and stay behind, see ``_near_rims``. The others are counted by tile; the counts bound
    how far the ``k``-th source of a tile of gaps can be, and a tile meets only the sources within
    that bound, which follow the rim of its hole and not the area. Groups are single tiles.
    """
    base = materialise(
        cells.select(
            *CELL, F.col(value).cast("double").alias("_v"), to_fill.alias("_fill"), ok.alias("_ok"),
            F.floor(F.col("y") / TILE).alias("_by"), F.floor(F.col("x") / TILE).alias("_bx"),
        ).where(F.col("_fill") | F.col("_ok"))
    )
    usable = F.coalesce(F.col("_ok") & F.col("_v").isNotNull(), F.lit(False))
    every = base.where(usable)
    enough = every.groupBy("entry_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    gaps = base.where("_fill").select(*CELL, *_BLOCK).join(enough.select("entry_id"), "entry_id", "left_semi")
    sources = materialise(_near_rims(base, usable, k))
    counts = materialise(sources.groupBy("entry_id", *_BLOCK).agg(F.count(F.lit(1)).alias("_n")))
    near = materialise(_blocks_in_reach(gaps.select("entry_id", *_BLOCK).distinct(), counts, TILE, k))

    def beyond(c: str, block: str) -> Column:
        low = F.col(block) * TILE
        return F.greatest(low - F.col(c), F.col(c) - low - (TILE - 1), F.lit(0))

    dy, dx = beyond("y", "_by"), beyond("x", "_bx")
    held = sources.withColumnsRenamed({"_by": "_sy", "_bx": "_sx"})
    offered = held.join(unbroadcast(near), ["entry_id", "_sy", "_sx"]).where(dy * dy + dx * dx <= F.col("_reach")).select("entry_id", *_BLOCK, "y", "x", "_v")
    of = cells.schema
    schema = T.StructType([of["entry_id"], of["y"], of["x"], T.StructField("filled", T.DoubleType())])
    tile = ["entry_id", *_BLOCK]
    return gaps.groupBy(*tile).cogroup(offered.groupBy(*tile)).applyInArrow(_filled(k), schema)


def _near_rims(base: DataFrame, usable: Column, k: int) -> DataFrame:
    """The sources without those in blocks where all blocks around are full of sources and free of gaps.

    Blocks have side ``b``, and the solid ground reaches ``2 (b + 1)`` cells from such a source. From
    it to any gap, the disc of radius ``b + 1`` that touches it lies in solid ground and nearer to the gap.
    It holds ``(b + 1)^2 > k`` cells at least, so the source is not among the ``k`` nearest.
    """
    b = max(1, math.isqrt(k))
    rim = math.ceil(2 * (b + 1) / b)
    around = F.explode(F.sequence(F.lit(-rim), F.lit(rim)))
    at = base.withColumns({"_qy": F.floor(F.col("y") / b), "_qx": F.floor(F.col("x") / b)})
    block = ["entry_id", "_qy", "_qx"]
    solid = at.groupBy(*block).agg(
        F.size(F.collect_set(F.when(usable, F.struct("y", "x")))).alias("_n"), F.bool_or(F.coalesce("_fill", F.lit(False))).alias("_gap")
    ).where((F.col("_n") == b * b) & ~F.col("_gap")).select(*block)
    for c in ("_qx", "_qy"):
        solid = solid.withColumn("_d", around).withColumn(c, F.col(c) + F.col("_d")).groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2 * rim + 1).select(*block)
    return at.where(usable).join(unbroadcast(solid), block, "left_anti").select(*CELL, *_BLOCK, "_v")


def _filled(k: int):
    """Means of the ``k`` nearest sources, ties included, for the gaps of one tile.

    The distance to the ``k``-th source changes by no more than the way between two cells, so
    the middle of a block of gaps bounds which sources its cells have to look at.
    """
    def run(gaps: pa.Table, sources: pa.Table) -> pa.Table:
        def places(t: pa.Table) -> np.ndarray:
            return np.stack([t.column(c).to_numpy() for c in ("y", "x")], axis=1)

        g, s, v = places(gaps), places(sources), sources.column("_v").to_numpy()
        out = np.full(len(g), np.nan)
        blocks = np.floor_divide(g, SUB)
        _, which = np.unique(blocks, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(which.ravel()[order])) + 1) if len(g) else []:
            own = g[part]
            centre = (own.min(axis=0) + own.max(axis=0)) / 2
            span = math.sqrt(((own - centre) ** 2).sum(axis=1).max())
            far = ((s - centre) ** 2).sum(axis=1)
            reach = math.sqrt(np.partition(far, k - 1)[k - 1]) + 2 * span
            use = far <= reach * reach * (1 + 1e-9) + 1e-6
            t, w = s[use], v[use]
            d2 = (own[:, :1] - t[:, 0]) ** 2 + (own[:, 1:] - t[:, 1]) ** 2
            hit = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1:k]
            out[part] = np.where(hit, w, 0.0).sum(axis=1) / hit.sum(axis=1)
        return pa.table({"entry_id": gaps.column("entry_id"), "y": gaps.column("y"), "x": gaps.column("x"), "filled": pa.array(out, pa.float64())})

    return run


_BLOCK = ["_by", "_bx"]


def _blocks_in_reach(gap_blocks: DataFrame, counts: DataFrame, side: int, k: int) -> DataFrame:
    """Source blocks that may hold one of the ``k`` nearest sources of a cell in a gap block.

    Returns ``entry_id, _by, _bx, _sy, _sx, _reach`` with the squared distance within which
    every cell of the gap block has its ``k`` sources. The size of the tiles in which blocks
    meet doubles until three by three of them hold ``k`` sources.
    """
    def tile(c: str, size: Column) -> Column:
        return F.floor(F.col(c) / size)

    def around(c: str, size: Column, n: int) -> Column:
        return F.explode(F.sequence(tile(c, size) - n, tile(c, size) + n))

    pending, settled, size = gap_blocks, [], 1
    while True:
        s = F.lit(size)
        tiles = counts.groupBy("entry_id", tile("_by", s).alias("_ty"), tile("_bx", s).alias("_tx")).agg(F.sum("_n").alias("_n"))
        probes = pending.withColumn("_ty", around("_by", s, 1)).withColumn("_tx", around("_bx", s, 1))
        held = probes.join(tiles, ["entry_id", "_ty", "_tx"]).groupBy("entry_id", *_BLOCK).agg(F.sum("_n").alias("_n"))
        tried = materialise(pending.join(held, ["entry_id", *_BLOCK], "left"))
        settled.append((size, tried.where(F.col("_n") >= k).select("entry_id", *_BLOCK, s.alias("_size"))))
        pending = tried.where(F.col("_n").isNull() | (F.col("_n") < k)).select("entry_id", *_BLOCK)
        if pending.isEmpty():
            break
        size *= 2
    sized = reduce(lambda a, b: a.unionByName(b), [df for _, df in settled])
    sizes = F.array(*[F.lit(n) for n, _ in settled])
    tiled = counts.select("entry_id", F.col("_by").alias("_sy"), F.col("_bx").alias("_sx"), "_n", F.explode(sizes).alias("_size"))
    tiled = tiled.withColumns({"_ty": tile("_sy", F.col("_size")), "_tx": tile("_sx", F.col("_size"))})

    def met(blocks: DataFrame, n: int) -> DataFrame:
        size = F.col("_size")
        return blocks.withColumn("_ty", around("_by", size, n)).withColumn("_tx", around("_bx", size, n)).join(
            tiled, ["entry_id", "_size", "_ty", "_tx"]
        )

    down, right = F.abs(F.col("_sy") - F.col("_by")), F.abs(F.col("_sx") - F.col("_bx"))

    def squared(*cells: Column) -> Column:
        return reduce(lambda a, b: a + b, [c * c for c in cells])

    far = squared((down + 1) * side - 1, (right + 1) * side - 1)
    rank = Window.partitionBy("entry_id", *_BLOCK).orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)
    held = met(sized, 1).withColumn("_far", far).withColumn("_c", F.sum("_n").over(rank)).where(F.col("_c") >= k)
    bound = held.groupBy("entry_id", *_BLOCK, "_size").agg(F.min("_far").alias("_reach"))
    # three tiles away is further than any cell of the nine can be
    close = squared(F.greatest((down - 1) * side + 1, F.lit(0)), F.greatest((right - 1) * side + 1, F.lit(0)))
    return met(bound, 3).where(close <= F.col("_reach")).select("entry_id", *_BLOCK, "_sy", "_sx", "_reach")


def elevation_fill(cells: DataFrame, value: str, elevation: str, to_fill: Column, ok: Column, k: int = FILL_CELLS) -> DataFrame:
    """Mean over the usable cells whose elevation rank lies within ``k // 2`` of the gap's.

    Works on one row per distinct elevation: running counts and sums give ranks and
    range means as differences, so no cell is paired with another. Entries with fewer
    than ``k`` usable cells are left out.
    """
    base = cells.select(*CELL, F.col(value).cast("double").alias("_v"), F.col(elevation).alias("_h"),
                        to_fill.alias("_fill"), ok.alias("_ok"))
    used = F.col("_ok") & F.col("_h").isNotNull() & F.col("_v").isNotNull()
    levels = base.where(F.col("_fill") | used).where(F.col("_h").isNotNull()).groupBy("entry_id", "_h").agg(
        F.sum(F.when(used, 1).otherwise(0)).alias("_c"),
        F.sum(F.when(used, F.col("_v")).otherwise(0.0)).alias("_s"),
        F.max(F.col("_fill")).alias("_gap"),
    )
    ranked = running_totals(
        levels, ["entry_id"], ["_h"], {"_cc": F.col("_c"), "_cs": F.col("_s")}, {"_n": "_cc"}
    ).where(F.col("_n") >= k)
    below = F.col("_cc") - F.col("_c")
    steps = ranked.where(F.col("_c") > 0).select(
        "entry_id", below.alias("first"), (F.col("_cc") - 1).alias("last"),
        F.struct(below.alias("n0"), (F.col("_cs") - F.col("_s")).alias("s0"),
                 F.col("_cc").alias("n1"), F.col("_cs").alias("s1")).alias("payload"),
    )
    half = k // 2
    wanted = ranked.where("_gap").select("entry_id", "_h", F.inline(F.array(
        F.struct(F.lit(0).alias("end"), F.greatest(below - half, F.lit(0)).alias("rank")),
        F.struct(F.lit(1).alias("end"), F.least(below + half, F.col("_n") - 1).alias("rank")),
    )))
    ends = rank_lookup(steps, wanted, ["entry_id"])

    def pick(end: int, field: str) -> Column:
        return F.max(F.when(F.col("end") == end, F.col("payload")[field]))

    means = ends.groupBy("entry_id", "_h").agg(
        ((pick(1, "s1") - pick(0, "s0")) / (pick(1, "n1") - pick(0, "n0"))).alias("filled")
    )
    gaps = base.where("_fill").select(*CELL, "_h")
    return gaps.join(unbroadcast(means), ["entry_id", "_h"]).select(*CELL, "filled")


def fill_gaps(
    cells: DataFrame, value: str, to_fill: Column, ok: Column, method: str | None, elevation: str = "dem",
    k: int = FILL_CELLS, threshold: float = 0.5,
) -> DataFrame:
    """Fill with ``nn``, ``hypso`` or not at all; keeps the original beside the result.

    In an entry that is filled, cells that are neither usable nor gaps become NULL.
    """
    if method is None:
        return cells
    if method == "nn":
        filled = nearest_fill(cells, value, to_fill, ok, k)
    elif method == "hypso":
        filled = elevation_fill(cells, value, elevation, to_fill, ok, k)
    else:
        raise ValueError("method must be 'nn', 'hypso' or None")
    filled = materialise(filled)
    entries = filled.select("entry_id").distinct().withColumn("_touched", F.lit(True))
    joined = cells.join(unbroadcast(filled), CELL, "left").join(entries, "entry_id", "left")
    new = F.when(F.col("_touched").isNull(), F.col(value)).when(to_fill, F.col("filled")).when(ok, F.col(value))
    return joined.withColumns({f"{value}_orig": F.col(value), value: new}).withColumn(
        f"{value}_b", F.col(value) >= threshold
    ).drop("filled", "_touched")


def _lagged(c: Column, n: int, w) -> Column:
    return F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w)


def smooth(cells: DataFrame, value: str, name: str) -> DataFrame:
    """3x3 Gaussian with replicated edges, one raster line per window."""
    row = Window.partitionBy("entry_id", "y").orderBy("x")
    col = Window.partitionBy("entry_id", "x").orderBy("y")
    for w, source in ((row, value), (col, "_h")):
        c = F.col(source)
        cells = cells.withColumn(
            "_h", GAUSS_SIDE * (F.coalesce(F.lag(c).over(w), c) + F.coalesce(F.lead(c).over(w), c)) + GAUSS_MID * c
        )
    return cells.withColumnRenamed("_h", name)


def terrain(cells: DataFrame, elevation: str = "dem", gsd: float = 10.0, check: bool = True) -> DataFrame:
    """Slope, aspect, plan and profile curvature and ruggedness of the smoothed elevation.

    Slope and aspect after Horn 1981 (degrees, aspect clockwise from north, 180 on flat
    ground), curvatures after Zevenbergen and Thorne 1987, ruggedness after Riley 1999.
    The border ring repeats its inner neighbour. Windows hold single raster lines.
    """
    if check and not cells.where(F.col(elevation).isNull()).isEmpty():
        raise ValueError("fill missing elevations first")
    row = Window.partitionBy("entry_id", "y").orderBy("x")
    col = Window.partitionBy("entry_id", "x").orderBy("y")
    e = F.col(elevation).cast("double")
    c = cells.withColumn(
        "_h", GAUSS_SIDE * (F.coalesce(F.lag(e).over(row), e) + F.coalesce(F.lead(e).over(row), e)) + GAUSS_MID * e
    )
    h = F.col("_h")
    c = c.withColumns({
        "_u1": F.lag(h, 1).over(col), "_u2": F.lag(h, 2).over(col),
        "_d1": F.lead(h, 1).over(col), "_d2": F.lead(h, 2).over(col),
    })
    u1, d1 = F.coalesce("_u1", "_h"), F.coalesce("_d1", "_h")
    u2, d2 = F.coalesce("_u2", "_u1", "_h"), F.coalesce("_d2", "_d1", "_h")

    def gauss(a, b, z):
        return GAUSS_SIDE * (a + z) + GAUSS_MID * b

    inner_y = F.col("_u1").isNotNull() & F.col("_d1").isNotNull()
    c = c.withColumns({"_n": gauss(u2, u1, h), "_m": gauss(u1, h, d1), "_s": gauss(h, d1, d2), "_iy": inner_y})
    west = {f"_w{k}": F.lag(f"_{k}").over(row) for k in "nms"}
    east = {f"_e{k}": F.lead(f"_{k}").over(row) for k in "nms"}
    c = c.withColumns({**west, **east})
    a, b, cc = F.col("_wn"), F.col("_n"), F.col("_en")
    d, m, f = F.col("_wm"), F.col("_m"), F.col("_em")
    g, hh, i = F.col("_ws"), F.col("_s"), F.col("_es")
    inner = F.col("_iy") & F.col("_wm").isNotNull() & F.col("_em").isNotNull()

    dzdx = ((cc + 2 * f + i) - (a + 2 * d + g)) / (8 * gsd)
    dzdy = ((g + 2 * hh + i) - (a + 2 * b + cc)) / (8 * gsd)
    flat = (dzdx == 0) & (dzdy == 0)
    bearing = F.degrees(F.atan2(dzdy, -dzdx))
    zd = ((d + f) / 2 - m) / gsd ** 2
    ze = ((b + hh) / 2 - m) / gsd ** 2
    zf = (cc + g - a - i) / (4 * gsd ** 2)
    zg = (f - d) / (2 * gsd)
    zh = (b - hh) / (2 * gsd)
    steep = zg * zg + zh * zh
    features = {
        "slope": F.degrees(F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy))),
        "aspect": F.when(flat, F.lit(180.0)).otherwise(F.pmod(450 - bearing, F.lit(360.0))),
        "planform_curvature": F.coalesce(F.try_divide(2 * (zd * zh * zh + ze * zg * zg - zf * zg * zh), steep), F.lit(0.0)),
        "profile_curvature": F.coalesce(F.try_divide(-2 * (zd * zg * zg + ze * zh * zh + zf * zg * zh), steep), F.lit(0.0)),
        "terrain_ruggedness_index": F.sqrt(reduce(lambda s, t: s + t, [(q - m) * (q - m) for q in (a, b, cc, d, f, g, hh, i)])),
    }
    c = c.withColumns({k: F.when(inner, v) for k, v in features.items()})
    for w in (row, col):
        c = c.withColumns({k: F.coalesce(F.col(k), F.lead(k).over(w), F.lag(k).over(w)) for k in features})
    return c.select(*cells.columns, *features)


def merge_sources(cells: DataFrame, value: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """One value per source cell where rasters overlap: the valid one with the lowest order."""
    return cells.groupBy(*(keys or ["y", "x"])).agg(
        F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value)
    )


def bilinear(targets: DataFrame, source: DataFrame, value: str, y: Column, x: Column, keys: list[str] | None = None) -> DataFrame:
    """Sample a raster at fractional cell positions ``(y, x)`` of the target rows.

    Each target meets its four neighbours by an equi-join on their integer position;
    weights of missing neighbours are left out.
    """
    keys = keys or []
    t = targets.withColumns({"_ty": y.cast("double"), "_tx": x.cast("double")})
    fy, fx = F.col("_ty") - F.floor("_ty"), F.col("_tx") - F.floor("_tx")

    def corner(dy: int, dx: int) -> Column:
        weight = (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
        return F.struct(
            (F.floor("_ty") + dy).alias("_sy"), (F.floor("_tx") + dx).alias("_sx"), weight.alias("_w")
        )

    corners = F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))
    spread = t.select(*targets.columns, F.inline(corners)).where(F.col("_w") > 0)
    side = source.select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(value).cast("double").alias("_v"))
    weight = F.when(F.col("_v").isNotNull(), F.col("_w"))
    return spread.join(unbroadcast(side), [*keys, "_sy", "_sx"], "left").groupBy(*targets.columns).agg(
        F.try_divide(F.sum(F.col("_v") * weight), F.sum(weight)).alias(value)
    )
