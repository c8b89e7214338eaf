"""Outlines of raster segments as rings of vertices.

The sides of cells where a segment ends are directed so that the segment lies on the left.
Sides in a row form straight pieces, and every piece has one successor, so pieces form
cycles. A cycle is put in order by list ranking: pointers double their reach in each round
and carry the smallest piece they have passed, so rounds follow the logarithm of the longest
ring and a ring may span any number of tasks. Each hole finds the ring around it by looking
left along its row, and holes that look at other holes follow them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.functions import geometry
from firnline.session import materialise
from firnline.tables import unbroadcast

_SEGMENT = ["entry_id", "segment"]


def boundary_edges(segment_cells: DataFrame) -> DataFrame:
    """Cell sides where a segment ends, as ``entry_id, segment, y, x, side``."""
    sides = [("north", -1, 0), ("south", 1, 0), ("west", 0, -1), ("east", 0, 1)]
    around = F.array(*[
        F.struct(F.lit(n).alias("side"), (F.col("y") + dy).alias("_ny"), (F.col("x") + dx).alias("_nx")) for n, dy, dx in sides
    ])
    spread = segment_cells.select(*_SEGMENT, "y", "x", F.inline(around))
    inside = segment_cells.select(*_SEGMENT, F.col("y").alias("_ny"), F.col("x").alias("_nx"))
    return spread.join(unbroadcast(inside), [*_SEGMENT, "_ny", "_nx"], "left_anti").select(*_SEGMENT, "y", "x", "side")


def _directed(edges: DataFrame) -> DataFrame:
    """Sides as steps of a walk with the segment on the left: ``line`` they lie on, place ``at`` along it, direction ``d``.

    Directions are 0 to 3 for growing x, growing y, falling x, falling y; a turn to the left adds one.
    """
    def pick(north: Column, south: Column, west: Column, east: Column) -> Column:
        side = F.col("side")
        return F.when(side == "north", north).when(side == "south", south).when(side == "west", west).otherwise(east)

    y, x = F.col("y"), F.col("x")
    return edges.select(
        *_SEGMENT, "y", "x", pick(F.lit(0), F.lit(2), F.lit(3), F.lit(1)).alias("d"),
        pick(y, y + 1, x, x + 1).alias("line"), pick(x, x, y, y).alias("at"),
    )


def _pieces(edges: DataFrame) -> DataFrame:
    """Straight pieces ``piece``, numbered, with start ``ay, ax``, end ``by, bx`` and direction; sides with their piece come with it.

    Windows hold the sides on one line of the raster.
    """
    along = Window.partitionBy(*_SEGMENT, "d", "line").orderBy("at")
    started = F.when(F.coalesce(F.col("at") - F.lag("at").over(along), F.lit(2)) > 1, F.col("at"))
    placed = _directed(edges).withColumn("_s", started)
    placed = placed.withColumn("low", F.last("_s", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = placed.groupBy(*_SEGMENT, "d", "line", "low").agg((F.max("at") + 1).alias("high"))
    forward = F.col("d") < 2
    begin, end = F.when(forward, F.col("low")).otherwise(F.col("high")), F.when(forward, F.col("high")).otherwise(F.col("low"))
    flat = F.col("d") % 2 == 0
    return spans.select(
        *_SEGMENT, "d", "line", "low", "high", F.when(flat, F.col("line")).otherwise(begin).alias("ay"), F.when(flat, begin).otherwise(F.col("line")).alias("ax"),
        F.when(flat, F.col("line")).otherwise(end).alias("by"), F.when(flat, end).otherwise(F.col("line")).alias("bx"),
        F.monotonically_increasing_id().alias("piece"),
    )


def _successors(pieces: DataFrame) -> DataFrame:
    """The piece that follows each: at a corner where two cells touch, the walk stays with its own cell, to the left."""
    ends = pieces.select(*_SEGMENT, "piece", "d", F.col("by").alias("vy"), F.col("bx").alias("vx"))
    starts = pieces.select(*_SEGMENT, F.col("piece").alias("next"), F.col("d").alias("nd"), F.col("ay").alias("vy"), F.col("ax").alias("vx"))
    turns = ends.join(unbroadcast(starts), [*_SEGMENT, "vy", "vx"]).where((F.col("nd") - F.col("d")) % 2 != 0)
    left = F.pmod(F.col("nd") - F.col("d"), F.lit(4)) == 1
    return turns.groupBy("piece").agg(F.min_by("next", F.when(left, 0).otherwise(1)).alias("next"))


def ranked_cycles(successors: DataFrame) -> DataFrame:
    """Cycle and place in it of every element of a permutation ``piece, next``: ``piece, cycle, place``.

    ``cycle`` is the smallest element, which has place 0; the others follow in order of ``next``.
    After ``k`` rounds a pointer reaches ``2^k`` elements ahead and knows the smallest of those it
    passed. The rounds end when no pointer learns of a smaller one.
    """
    state = materialise(successors.select("piece", F.col("next").alias("to"), F.struct(F.col("piece").alias("least"), F.lit(0).cast("bigint").alias("ahead")).alias("seen")))
    reach = 1
    while True:
        beyond = state.select(
            F.col("piece").alias("to"), F.col("to").alias("_to"),
            F.struct(F.col("seen.least").alias("least"), (F.col("seen.ahead") + reach).alias("ahead")).alias("_seen"),
        )
        # of the same element, the nearer place is the smaller pair
        new = materialise(state.join(unbroadcast(beyond), "to").select(
            "piece", F.col("_to").alias("to"), F.least("seen", "_seen").alias("seen"), (F.col("_seen.least") < F.col("seen.least")).alias("learned")
        ))
        state, reach = new.drop("learned"), 2 * reach
        if new.where("learned").isEmpty():
            break
    lengths = state.groupBy(F.col("seen.least").alias("cycle")).agg((F.max("seen.ahead") + 1).alias("n"))
    found = state.select("piece", F.col("seen.least").alias("cycle"), F.col("seen.ahead").alias("ahead")).join(unbroadcast(lengths), "cycle")
    return found.select("piece", "cycle", F.pmod(F.col("n") - F.col("ahead"), F.col("n")).alias("place"))


def segment_rings(segment_cells: DataFrame, gsd: float) -> DataFrame:
    """Rings around the segments of ``segments``: ``entry_id, segment, ring, part, points, area_km2``.

    ``points`` are the corners in order, in metres, without repeating the first. Outer rings have
    a positive area and holes a negative one; ``part`` is the outer ring that a ring belongs to. Cells
    that only touch at a corner are parts of their own, so no ring touches itself from outside.
    """
    pieces = materialise(_pieces(boundary_edges(segment_cells)))
    placed = materialise(ranked_cycles(_successors(pieces)))
    corners = materialise(pieces.join(unbroadcast(placed), "piece").withColumnRenamed("cycle", "ring"))
    corner = F.struct("place", (F.col("ax") * F.lit(float(gsd))).alias("x"), (F.col("ay") * F.lit(float(gsd))).alias("y"))
    ordered = F.transform(F.sort_array(F.collect_list(corner)), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    rings = corners.groupBy(*_SEGMENT, "ring").agg(
        ordered.alias("points"),
        F.min(F.when(F.col("d") == 1, F.struct(F.col("line").alias("x"), F.col("low").alias("y")))).alias("_r"),
    )
    area = geometry.signed_area(geometry.edges(F.array("points"))) / 1e6
    rings = materialise(rings.withColumn("area_km2", area))
    return rings.join(unbroadcast(_parts(rings, corners)), "ring").select(*_SEGMENT, "ring", "part", "points", "area_km2")


def _parts(rings: DataFrame, corners: DataFrame) -> DataFrame:
    """The outer ring of every ring: ``ring, part``."""
    # the leftmost side of a hole has the segment on its left; the nearest side further left that has it on its right is
    # that of the outer ring or of another hole of the same part
    holes = rings.where("area_km2 < 0").select(*_SEGMENT, "ring", F.col("_r.x").alias("hx"), F.col("_r.y").alias("y"))
    walls = corners.where("d = 3").select(*_SEGMENT, F.col("ring").alias("wall"), F.col("line").alias("wx"), F.explode(F.sequence("low", F.col("high") - 1)).alias("y"))
    looked = holes.join(unbroadcast(walls), [*_SEGMENT, "y"]).where("wx < hx").groupBy("ring").agg(F.max_by("wall", "wx").alias("to"))
    outer = rings.where("area_km2 > 0").select("ring", F.col("ring").alias("to"))
    state = materialise(outer.unionByName(looked))
    while True:
        further = state.select(F.col("ring").alias("to"), F.col("to").alias("_to"))
        new = materialise(state.join(unbroadcast(further), "to").select("ring", F.col("_to").alias("to"), (F.col("to") != F.col("_to")).alias("moved")))
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            return state.withColumnRenamed("to", "part")


def segment_outlines(segment_cells: DataFrame, gsd: float) -> DataFrame:
    """Outlines ``entry_id, segment, part, rings``, the outer ring first, ready for the operators on outlines."""
    rings = segment_rings(segment_cells, gsd)
    parts = F.sort_array(F.collect_list(F.struct((-F.col("area_km2")).alias("order"), "ring", "points")))
    return rings.groupBy(*_SEGMENT, "part").agg(F.transform(parts, lambda r: r["points"]).alias("rings"))
