"""Joins between outlines, points and cells.

Every join first meets on a square tile of a grid with several levels, so Spark plans
an equi-join; the exact predicate is a filter on the pairs that share a tile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions import geometry
from firnline.operators import buffers
from firnline.operators.components import connected_components
from firnline.session import materialise
from firnline.tables import missing_to_null, unbroadcast


#: Outlines of more edges are not tested whole.
WHOLE_EDGES = 64


def with_edges(outlines: DataFrame, rings: str = "rings", grow: float = 0.0) -> DataFrame:
    """Add the edge array and the (grown) box of every outline."""
    out = outlines.withColumn("edges", geometry.edges(F.col(rings)))
    return out.withColumn("box", geometry.box(F.col("edges"), grow))


def _with_level(df: DataFrame) -> DataFrame:
    """Grid level whose tile side, a power of two, is the first to reach the size of the box."""
    b = F.col("box")
    size = F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"], F.lit(1e-6))
    return df.withColumn("_level", F.ceil(F.log2(size)).cast("int"))


def _levels(df: DataFrame) -> list[int]:
    # exponents of box sizes: a few dozen values at most
    return sorted(r[0] for r in df.select("_level").distinct().collect())


def _on_tiles(df: DataFrame) -> DataFrame:
    """One row per tile of its level that a box touches: four at most on its own level."""
    side, b = F.pow(F.lit(2.0), F.col("_level")), F.col("box")

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(b[low] / side), F.floor(b[high] / side)))

    return df.withColumn("_ty", span("miny", "maxy")).withColumn("_tx", span("minx", "maxx"))


def _probing(df: DataFrame, levels: list[int], above_only: bool) -> DataFrame:
    """Repeat every box on the levels at or above its own, where it touches four tiles at most."""
    wanted = F.filter(
        F.array(*[F.lit(v) for v in levels]),
        lambda v: v > F.col("_own") if above_only else v >= F.col("_own"),
    )
    return _on_tiles(df.withColumnRenamed("_level", "_own").withColumn("_level", F.explode(wanted)))


_TILE = ["_level", "_ty", "_tx"]


def _first_common_tile(a: Column, b: Column) -> Column:
    """True in exactly one of the tiles that two meeting boxes share."""
    side = F.pow(F.lit(2.0), F.col("_level"))
    y = F.floor(F.greatest(a["miny"], b["miny"]) / side)
    x = F.floor(F.greatest(a["minx"], b["minx"]) / side)
    return (F.col("_ty") == y) & (F.col("_tx") == x)


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of rows whose boxes ``ba`` and ``bb`` meet, each once.

    The smaller box of a pair looks the larger one up on the level of the larger one.
    Tiles are as large as the boxes they hold, so a tile brings together little more
    than the pairs that really meet, wherever outlines crowd and whatever their sizes.
    """
    left, right = _with_level(left), _with_level(right)

    def pairs(probe: DataFrame, held: DataFrame, above_only: bool) -> DataFrame:
        p, h = _probing(probe, _levels(held), above_only), _on_tiles(held)
        p = p.withColumnRenamed("box", "ba" if probe is left else "bb").drop("_own")
        h = h.withColumnRenamed("box", "ba" if held is left else "bb")
        return p.join(unbroadcast(h), _TILE).where(geometry.boxes_meet(F.col("ba"), F.col("bb"))).where(
            _first_common_tile(F.col("ba"), F.col("bb"))
        ).drop(*_TILE)

    return pairs(left, right, False).unionByName(pairs(right, left, True))


def points_in_outlines(points: DataFrame, outlines: DataFrame, attributes: list[str], key: str = "entry_id") -> DataFrame:
    """Left join of points ``px, py`` with a unique ``key`` to the outlines that contain them.

    A point looks rings up in its one tile of every level in use, so it meets a ring at most
    once; it is inside an outline when it is inside an odd number of its rings. Rings far
    apart thus do not share one box. Rings of many edges do not travel whole: a ray from the
    point to the right looks up the edges of the strips it runs through, see ``_ray_hits``.
    """
    numbered = materialise(outlines.select("rings", *attributes).withColumn("_outline", F.monotonically_increasing_id()))
    single = numbered.select("_outline", F.posexplode("rings").alias("_i", "_ring")).select(
        F.struct("_outline", "_i").alias("_ring"), F.array("_ring").alias("_points"))
    areas = _with_level(with_edges(single, "_points")).drop("_points")
    large = F.size("edges") > WHOLE_EDGES
    found = areas.groupBy("_level").agg(F.max(large).alias("large")).collect()  # exponents of box sizes: a few dozen
    levels = F.array(*[F.lit(r["_level"]) for r in sorted(found)]).cast("array<int>")
    side = F.pow(F.lit(2.0), F.col("_level"))
    keyed = (
        points.select(key, "px", "py").withColumn("_level", F.explode(levels))
        .withColumns({"_ty": F.floor(F.col("py") / side), "_tx": F.floor(F.col("px") / side)})
    )
    held = _on_tiles(areas.where(~large)).select(*_TILE, "edges", "_ring")
    hits = keyed.join(unbroadcast(held), _TILE).where(geometry.contains(F.col("edges"), F.col("px"), F.col("py"))).select(key, "_ring")
    if any(r["large"] for r in found):
        hits = hits.unionByName(_ray_hits(keyed, areas.where(large), key))
    inside = hits.groupBy(key, F.col("_ring._outline").alias("_outline")).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1")
    named = inside.join(unbroadcast(numbered.select("_outline", *attributes)), "_outline").select(key, *attributes)
    return points.join(unbroadcast(named), key, "left")


def _ray_hits(keyed: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Points on tiles and the rings that contain them, by counting the edges that a ray to the right crosses.

    An edge lives in the strips of its own height that it touches, two at most, and a ray looks up
    one strip of every height in use in its ring. What is tested follows the edges at the
    height of the point and not the size of the ring, and edges of one ring are spread by strip.
    """
    b, e = F.col("box"), F.col("e")
    near = keyed.join(unbroadcast(_on_tiles(areas.select("_level", "box", "_ring"))), _TILE).where(
        (F.col("px") >= b["minx"]) & (F.col("px") <= b["maxx"]) & (F.col("py") >= b["miny"]) & (F.col("py") <= b["maxy"])
    ).select(key, "px", "py", "_ring")
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    sloped = areas.select("_ring", F.explode("edges").alias("e")).where(e["y1"] != e["y2"]).withColumn("_strip", F.ceil(F.log2(high - low)).cast("int"))
    height = F.pow(F.lit(2.0), F.col("_strip"))
    strips = sloped.withColumn("_sy", F.explode(F.sequence(F.floor(low / height), F.floor(high / height))))
    heights = sloped.groupBy("_ring").agg(F.collect_set("_strip").alias("_strips"))
    rays = near.join(unbroadcast(heights), "_ring").withColumn("_strip", F.explode("_strips")).drop("_strips").withColumn("_sy", F.floor(F.col("py") / height))
    crossed = rays.join(unbroadcast(strips), ["_ring", "_strip", "_sy"]).where(geometry.crosses_ray(e, F.col("px"), F.col("py")))
    return crossed.groupBy(key, "_ring").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(key, "_ring")


def close_pairs(outlines: DataFrame, distance: float, key: str = "entry_id") -> DataFrame:
    """Pairs ``a < b`` of outlines within ``distance`` of each other, each once."""
    half = distance / 2
    boxed = with_edges(outlines.select(key, "rings"), grow=half)
    # both boxes grow by half the distance, so the boxes of what is close meet
    edges = materialise(_with_level(boxed.select(key, F.explode("edges").alias("edge")).withColumn("box", geometry.edge_box(F.col("edge"), half))))
    # the smaller of two boxes looks the larger one up; of the same size, both look
    probing = _probing(edges.select(F.col(key).alias("a"), F.col("edge").alias("ea"), "box", "_level"), _levels(edges), False).withColumnRenamed("box", "ba")
    held = _on_tiles(edges.select(F.col(key).alias("b"), F.col("edge").alias("eb"), "box", "_level")).withColumnRenamed("box", "bb")
    met = probing.join(unbroadcast(held), _TILE).where(F.col("a") != F.col("b")).where(geometry.boxes_meet(F.col("ba"), F.col("bb")))
    close = met.where(_first_common_tile(F.col("ba"), F.col("bb"))).where(
        geometry.edges_within(F.col("ea"), F.col("eb"), distance)
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # rings that no edges bring close can still lie inside another outline, each ring by itself: a test of one vertex
    firsts = outlines.select(F.col(key).alias("_owner"), F.posexplode("rings").alias("_i", "_ring")).where(F.size("_ring") > 0)
    points = firsts.select(F.struct("_owner", "_i").alias("_vertex"), F.col("_ring")[0]["x"].alias("px"), F.col("_ring")[0]["y"].alias("py"))
    within = points_in_outlines(points, outlines.select(F.col(key).alias("_around"), "rings"), ["_around"], "_vertex")
    owner, around = F.col("_vertex._owner"), F.col("_around")
    inside = within.where(owner != around).select(F.least(owner, around).alias("a"), F.greatest(owner, around).alias("b"))
    return close.unionByName(inside).distinct()


def box_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Pairs of rows whose ``box`` columns meet, each once."""
    return _meeting(left.select(left_key, "box"), right.select(right_key, "box")).select(left_key, right_key)


def require_hits(left: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Return ``pairs``, or fail if a left row met nothing."""
    lost = [str(r[0]) for r in left.select(key).join(pairs.select(key), key, "left_anti").limit(10).collect()]
    if lost:
        raise ValueError(f"no intersection for: {', '.join(sorted(lost))}")
    return pairs


def nearest_points(left: DataFrame, right: DataFrame, start: float, left_key: str, right_key: str) -> DataFrame:
    """The nearest right point of every left point; ties go to the lower key.

    A left point whose coordinates are missing, NaN or infinite gets NULL; such right points are
    no candidates.

    Points meet in 3x3 tiles as wide as the search radius. Whoever finds a point within
    the radius is done; the others go on with twice the radius. Start with a radius that
    is small against the densest spot, since dense spots are settled first.
    """
    def finite(*names: str) -> Column:
        return reduce(lambda a, b: a & b, [missing_to_null(F.col(c).cast("double")).isNotNull() for c in names])

    candidates = materialise(
        right.where(finite("px", "py")).select(F.col("px").alias("qx"), F.col("py").alias("qy"), F.col(right_key).alias("_q"))
        .groupBy("qx", "qy").agg(F.min("_q").alias("_q"))
    )
    if candidates.isEmpty():
        raise ValueError("no candidate points")
    pending, radius, done = left.select(left_key, "px", "py").where(finite("px", "py")), float(start), []
    while True:
        def near(c: str, r=radius) -> Column:
            return F.explode(F.sequence(F.floor(F.col(c) / r) - 1, F.floor(F.col(c) / r) + 1))

        probes = pending.withColumn("_ty", near("py")).withColumn("_tx", near("px"))
        tiles = candidates.withColumns({"_ty": F.floor(F.col("qy") / radius), "_tx": F.floor(F.col("qx") / radius)})
        dy, dx = F.col("py") - F.col("qy"), F.col("px") - F.col("qx")
        best = (
            probes.join(unbroadcast(tiles), ["_ty", "_tx"])
            .select(left_key, (dx * dx + dy * dy).alias("_d2"), "_q")
            .where(F.col("_d2") <= radius * radius)
            .groupBy(left_key).agg(F.min(F.struct("_d2", "_q")).alias("_b"))
        )
        tried = materialise(pending.join(unbroadcast(best), left_key, "left"))
        done.append(tried.where(F.col("_b").isNotNull()))
        pending = tried.where(F.col("_b").isNull()).select(left_key, "px", "py")
        if pending.isEmpty():
            break
        radius *= 2
    every = reduce(lambda a, b: a.unionByName(b), done)
    found = every.select(left_key, F.col("_b._q").alias(right_key), F.sqrt("_b._d2").alias("distance"))
    return left.select(left_key).join(unbroadcast(found), left_key, "left")


def rasterise(outlines: DataFrame, gsd: float, key: str = "entry_id", keep: list[str] | None = None) -> DataFrame:
    """Cells whose centre lies inside an outline, as ``key, y, x``.

    Edges are cut at the cell rows they span; sorted crossings of a row then pair up into
    spans of columns. Work grows with the perimeter and the covered cells, and a row of
    one outline is the largest group.
    """
    keep = keep or []
    e = with_edges(outlines).select(key, *keep, F.explode("edges").alias("e"))
    g = F.lit(float(gsd))
    low = F.ceil(F.least("e.y1", "e.y2") / g - 0.5)
    high = F.ceil(F.greatest("e.y1", "e.y2") / g - 0.5) - 1
    rows = e.withColumns({"_lo": low, "_hi": high}).where("_lo <= _hi").select(
        key, *keep, "e", F.explode(F.sequence("_lo", "_hi")).alias("y")
    )
    yc = (F.col("y") + 0.5) * g
    at = F.col("e.x1") + F.try_divide((yc - F.col("e.y1")) * (F.col("e.x2") - F.col("e.x1")), F.col("e.y2") - F.col("e.y1"))
    crossings = rows.select(key, *keep, "y", at.alias("_x")).groupBy(key, *keep, "y").agg(
        F.sort_array(F.collect_list("_x")).alias("_xs")
    )
    spans = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_xs") / 2).cast("int") - 1),
        lambda i: F.struct(
            F.ceil(F.element_at("_xs", 2 * i + 1) / g - 0.5).alias("lo"),
            (F.ceil(F.element_at("_xs", 2 * i + 2) / g - 0.5) - 1).alias("hi"),
        ),
    )
    spread = crossings.where(F.size("_xs") >= 2).select(key, *keep, "y", F.explode(spans).alias("s")).where("s.lo <= s.hi")
    return spread.select(key, *keep, "y", F.explode(F.sequence("s.lo", "s.hi")).alias("x"))


def id_raster(cells: DataFrame, covered: DataFrame, order: str, value: str, no_value: int = -1) -> DataFrame:
    """Id of the outline that covers a cell; the highest order wins, ``no_value`` elsewhere."""
    top = covered.groupBy("y", "x").agg(F.max_by(value, order).alias(value))
    return cells.join(unbroadcast(top), ["y", "x"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(no_value)))


def outline_mask(cells: DataFrame, covered: DataFrame, name: str = "mask_glacier", buffer: int = 0, key: str = "entry_id") -> DataFrame:
    """True where the cell lies in its own entry's outline, or within ``buffer`` cells of it."""
    own = covered.select(key, "y", "x")
    if buffer > 0:
        grown = buffers.plain_buffer(own.withColumn("id", F.lit(0)), buffer, [key])
        own = grown.select(key, "y", "x")
    hit = own.distinct().withColumn(name, F.lit(True))
    return cells.join(unbroadcast(hit), [key, "y", "x"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def outline_components(outlines: DataFrame, distance: float, key: str = "entry_id") -> DataFrame:
    """Component of every outline in the graph of outlines within ``2 * distance + 1``."""
    pairs = close_pairs(outlines, 2 * distance + 1, key)
    labels = connected_components(pairs, outlines.select(F.col(key).alias("v")), contract=True)
    return labels.withColumnRenamed("v", key)


def buffers_by_component(outlines: DataFrame, reaches: list[int], gsd: float, key: str = "entry_id") -> DataFrame:
    """Non-overlapping buffers of several sizes; outlines compete within their component only."""
    parts = outline_components(outlines, max(reaches) * gsd, key)
    cells = rasterise(outlines.join(unbroadcast(parts), key), gsd, key, ["component"]).withColumnRenamed(key, "id")
    grown = buffers.buffers_non_overlapping(materialise(cells), reaches, ["component"])
    return grown.withColumnRenamed("id", key)


def segments(cells: DataFrame, mask: Column, gsd: float, min_km2: float = 0.0, connectivity: int = 8) -> DataFrame:
    """Connected components of a binary mask: ``entry_id, segment, y, x, area_km2``.

    Horizontal runs are the vertices of the graph, so it is far smaller than the mask:
    a run starts where its left neighbour is missing. Runs of adjacent rows are linked
    through an equi-join of their cells. A segment is named after its smallest run.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    on = cells.where(mask).select("entry_id", "y", "x")
    line = Window.partitionBy("entry_id", "y").orderBy("x")
    starts = F.when(F.coalesce(F.col("x") - F.lag("x").over(line), F.lit(2)) > 1, F.col("x"))
    run_x = F.last("_s", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    runs = on.withColumn("_s", starts).withColumn("run", F.struct("entry_id", "y", run_x.alias("x"))).drop("_s")
    runs = materialise(runs)

    reach = 1 if connectivity == 8 else 0
    up = runs.select(
        "entry_id", (F.col("y") + 1).alias("y"), F.explode(F.sequence(F.col("x") - reach, F.col("x") + reach)).alias("x"),
        F.col("run").alias("a"),
    )
    links = up.join(unbroadcast(runs.select("entry_id", "y", "x", F.col("run").alias("b"))), ["entry_id", "y", "x"]).select("a", "b").distinct()
    labels = connected_components(links, runs.select(F.col("run").alias("v")).distinct(), contract=True)
    named = materialise(labels.select(F.col("v").alias("run"), F.col("component").alias("segment")))
    # sizes are summed over runs, so the cells are joined only once
    lengths = runs.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    sizes = named.join(unbroadcast(lengths), "run").groupBy("segment").agg((F.sum("_n") * (gsd * gsd / 1e6)).alias("area_km2"))
    kept = named.join(unbroadcast(sizes.where(F.col("area_km2") >= min_km2)), "segment")
    return runs.join(unbroadcast(kept), "run").select("entry_id", "segment", "y", "x", "area_km2")
