"""Connected components of an edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.session import materialise
from firnline.tables import unbroadcast


#: Vertices that a task contracts at once.
CONTRACTED = 400_000


def connected_components(edges: DataFrame, vertices: DataFrame, contract: bool = False) -> DataFrame:
    """Label every vertex with the smallest vertex of its component.

    ``edges`` has columns ``a, b``; ``vertices`` has ``v``. Alternates the two star
    operations of Kiveris et al. 2014: each round links every vertex to the smallest
    vertex it can see, first among its larger neighbours and then among its smaller
    ones. Minima are pre-aggregated, and the join side that carries them has one row
    per vertex, so a vertex with very many neighbours can be split by skew handling.
    Both halves of a round are written tables, as each is read twice; the loop ends when
    only stars are left.

    With ``contract``, every task first replaces the edges that it holds by stars with the same
    components, so the rounds see no more edges than vertices in each task, and hubs and
    chains within a task are gone before the first shuffle by vertex.
    """
    distinct = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    shrink = _contracted if contract else (lambda e: e)
    current = materialise(shrink(distinct))
    while not _only_stars(current):
        current = materialise(shrink(_small_star(materialise(_large_star(current)))))
    roots = current.select(F.col("hi").alias("v"), F.col("lo").alias("component"))
    return (
        vertices.select("v").join(unbroadcast(roots), "v", "left")
        .select("v", F.coalesce("component", "v").alias("component"))
    )


def _contracted(e: DataFrame) -> DataFrame:
    """Edges ``hi, lo`` with the same components, which are stars within every ``CONTRACTED`` vertices of a task."""
    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(v):
            root = v
            while (above := up[root]) != root:
                root = above
            while (above := up[v]) != root:
                up[v], v = root, above
            return root

        def stars(schema: pa.Schema) -> pa.RecordBatch:
            pairs = [(v, find(v)) for v in up if up[v] != v]
            kind = schema.field("hi").type
            names = [f.name for f in kind] if pa.types.is_struct(kind) else None
            sides = [[p[i] if names is None else dict(zip(names, p[i])) for p in pairs] for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x in sides], ["hi", "lo"])

        for b in batches:
            his, los = (b.column(c).to_pylist() for c in ("hi", "lo"))
            if pa.types.is_struct(b.schema.field("hi").type):
                his, los = ([tuple(v.values()) for v in x] for x in (his, los))
            for x, y in zip(his, los):
                rx, ry = find(up.setdefault(x, x)), find(up.setdefault(y, y))
                if rx < ry:
                    up[ry] = rx
                elif ry < rx:
                    up[rx] = ry
            if len(up) > CONTRACTED:
                yield stars(b.schema)
                up.clear()
        if up:
            yield stars(b.schema)

    return e.mapInArrow(contract, e.schema)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where(F.col("v") > F.col("u")).join(unbroadcast(least), "u")
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    links = F.array(
        F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    )
    return e.join(unbroadcast(least), "hi").select(F.inline(links)).where(F.col("hi") != F.col("lo")).distinct()


def _only_stars(e: DataFrame) -> bool:
    """True once every vertex is either a root or linked to exactly one root."""
    ends = e.select(F.explode(F.array(
        F.struct(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("s")).select("s.*")
    per_vertex = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_vertex.where("up > 1 or (up = 1 and down = 1)").isEmpty()
