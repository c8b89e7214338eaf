"""Outlines as arrays of rings, measured with array expressions.

A ring is an open array of ``struct<x,y>``. Outer rings share one orientation and
holes have the opposite one, so signed sums over all edges handle both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _edge(a: Column, b: Column) -> Column:
    return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def edges(rings: Column) -> Column:
    """All edges of an outline as one array of ``struct<x1,y1,x2,y2>``."""
    def of_ring(ring: Column) -> Column:
        shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(ring, shifted, _edge)

    return F.flatten(F.transform(rings, of_ring))


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def signed_area(es: Column) -> Column:
    return _sum(es, _cross) / 2


def area(es: Column) -> Column:
    return F.abs(signed_area(es))


def centroid(es: Column) -> Column:
    """Area-weighted centroid as ``struct<x,y>``."""
    a6 = signed_area(es) * 6
    cx = F.try_divide(_sum(es, lambda e: (e["x1"] + e["x2"]) * _cross(e)), a6)
    cy = F.try_divide(_sum(es, lambda e: (e["y1"] + e["y2"]) * _cross(e)), a6)
    return F.struct(cx.alias("x"), cy.alias("y"))


def contains(es: Column, px: Column, py: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of edges."""
    return F.size(F.filter(es, lambda e: crosses_ray(e, px, py))) % 2 == 1


def crosses_ray(e: Column, px: Column, py: Column) -> Column:
    """True where the ray from a point to the right crosses the edge; of its ends, the lower one belongs to it."""
    at = e["x1"] + F.try_divide((py - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
    return ((e["y1"] > py) != (e["y2"] > py)) & (px < at)


def _toward(e: Column, px: Column, py: Column) -> Column:
    """The nearest point of an edge as ``struct<d2,x,y>``."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = F.try_divide((px - e["x1"]) * dx + (py - e["y1"]) * dy, dx * dx + dy * dy)
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    qx, qy = e["x1"] + t * dx, e["y1"] + t * dy
    d2 = (px - qx) * (px - qx) + (py - qy) * (py - qy)
    return F.struct(d2.alias("d2"), qx.alias("x"), qy.alias("y"))


def nearest_boundary_point(es: Column, px: Column, py: Column) -> Column:
    return F.array_min(F.transform(es, lambda e: _toward(e, px, py)))


def boundary_distance(es: Column, px: Column, py: Column) -> Column:
    return F.sqrt(nearest_boundary_point(es, px, py)["d2"])


def with_interior_point(df: DataFrame, es: str, name: str) -> DataFrame:
    """Add the centroid if it lies inside, else the nearest point of the boundary.

    The centroid becomes a column first, so the per-edge terms do not repeat it.
    """
    c = F.col("_centroid")
    near = nearest_boundary_point(F.col(es), c["x"], c["y"])
    return (
        df.withColumn("_centroid", centroid(F.col(es)))
        .withColumn("_inside", contains(F.col(es), c["x"], c["y"]))
        .withColumn(name, F.when(F.col("_inside"), c).otherwise(F.struct(near["x"].alias("x"), near["y"].alias("y"))))
        .drop("_centroid", "_inside")
    )


def box(es: Column, grow: float = 0.0) -> Column:
    """Envelope, grown by a margin, as ``struct<minx,miny,maxx,maxy>``."""
    g = F.lit(float(grow))
    xs, ys = F.transform(es, lambda e: e["x1"]), F.transform(es, lambda e: e["y1"])
    return F.struct(
        (F.array_min(xs) - g).alias("minx"), (F.array_min(ys) - g).alias("miny"),
        (F.array_max(xs) + g).alias("maxx"), (F.array_max(ys) + g).alias("maxy"),
    )


def boxes_meet(a: Column, b: Column) -> Column:
    return (
        (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])
    )


def box_inside(inner: Column, outer: Column) -> Column:
    return (
        (inner["minx"] >= outer["minx"]) & (inner["maxx"] <= outer["maxx"])
        & (inner["miny"] >= outer["miny"]) & (inner["maxy"] <= outer["maxy"])
    )


def average_coords(rings: Column) -> Column:
    """Mean of the coordinates of closed rings: the first vertex of each ring counts twice."""
    closed = F.flatten(F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1))))
    n = F.size(closed).cast("double")
    return F.struct(
        F.try_divide(_sum(closed, lambda p: p["x"]), n).alias("x"),
        F.try_divide(_sum(closed, lambda p: p["y"]), n).alias("y"),
    )


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _edges_cross(e: Column, f: Column) -> Column:
    """Proper crossing; touching ends are caught by the vertex distances."""
    t1 = _turn(e["x1"], e["y1"], e["x2"], e["y2"], f["x1"], f["y1"])
    t2 = _turn(e["x1"], e["y1"], e["x2"], e["y2"], f["x2"], f["y2"])
    t3 = _turn(f["x1"], f["y1"], f["x2"], f["y2"], e["x1"], e["y1"])
    t4 = _turn(f["x1"], f["y1"], f["x2"], f["y2"], e["x2"], e["y2"])
    return (t1 * t2 < 0) & (t3 * t4 < 0)


def edge_box(e: Column, grow: float = 0.0) -> Column:
    """Envelope of one edge, grown by a margin."""
    g = F.lit(float(grow))
    return F.struct(
        (F.least(e["x1"], e["x2"]) - g).alias("minx"), (F.least(e["y1"], e["y2"]) - g).alias("miny"),
        (F.greatest(e["x1"], e["x2"]) + g).alias("maxx"), (F.greatest(e["y1"], e["y2"]) + g).alias("maxy"),
    )


def edges_within(e: Column, f: Column, distance) -> Column:
    """True where two edges come within ``distance`` of each other."""
    d2 = F.lit(float(distance)) * F.lit(float(distance))
    ends = [(e, f["x1"], f["y1"]), (e, f["x2"], f["y2"]), (f, e["x1"], e["y1"]), (f, e["x2"], e["y2"])]
    near = [_toward(g, x, y)["d2"] <= d2 for g, x, y in ends]
    return near[0] | near[1] | near[2] | near[3] | _edges_cross(e, f)


def outline_inside(inner: Column, outer: Column) -> Column:
    """True where every vertex of an outline lies inside another one and no edges cross."""
    out = F.exists(inner, lambda e: ~contains(outer, e["x1"], e["y1"]))
    return ~out & ~F.exists(inner, lambda e: F.exists(outer, lambda f: _edges_cross(e, f)))


def utm_code(lat: Column, lon: Column) -> Column:
    """EPSG code of the local UTM zone, e.g. ``epsg:32632``."""
    # Code base north, code base south.
    base = F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700))
    zone = F.floor((lon + 180) / 6) + 1
    return F.concat(F.lit("epsg:"), (base + zone).cast("string"))


def utm_zone(code: Column) -> Column:
    return F.substring(code, -2, 2).cast("int")
