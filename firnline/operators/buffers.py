"""Growing outlines on cells: distances, regions of interest and equal-area search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.session import materialise
from firnline.tables import unbroadcast


#: Reach up to which seeds are spread instead of swept.
SHORT_REACH = 8


def edge_cells(seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Seed cells with at least one of four neighbours outside their own outline.

    Only these can be the nearest cell of an outline seen from outside.
    """
    moves = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    around = F.array(*[
        F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in moves
    ])
    touched = seeds.select(*keys, "id", F.inline(around)).groupBy(*keys, "id", "y", "x").agg(F.count(F.lit(1)).alias("_n"))
    inner = touched.where(F.col("_n") == 4).select(*keys, "id", "y", "x")
    return seeds.join(unbroadcast(inner), [*keys, "id", "y", "x"], "left_anti")


def distances(seeds: DataFrame, reach: int, keys: list[str], per_id: bool) -> DataFrame:
    """Squared distance to the nearest seed for every position within ``reach`` cells.

    With ``per_id`` the distance is kept per outline; otherwise the nearest outline wins and ties
    go to the lower id. Both ways are exact: a short reach spreads seeds over the few places within
    it, which costs ``2 * reach + 1`` rows twice, and a long one is swept, whose rows do not grow with it.
    """
    return _spread(seeds, reach, keys, per_id) if reach <= SHORT_REACH else _swept(seeds, reach, keys, per_id)


def _spread(seeds: DataFrame, reach: int, keys: list[str], per_id: bool) -> DataFrame:
    """The minimum over a disc, along rows first and along columns second, with minima before every shuffle."""
    group = [*keys, "id"] if per_id else keys
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    along = seeds.select(*keys, "id", "y", "x", F.explode(steps).alias("_dx"))
    best = F.min(F.struct(F.abs("_dx").alias("d"), F.col("id"))).alias("_b")
    rows = along.withColumn("x", F.col("x") + F.col("_dx")).groupBy(*group, "y", "x").agg(best)
    rows = rows.select(*keys, "y", "x", F.col("_b.d").alias("_d"), F.col("_b.id").alias("id"))
    across = rows.select("*", F.explode(steps).alias("_dy")).withColumn(
        "_d2", (F.col("_d") * F.col("_d") + F.col("_dy") * F.col("_dy")).cast("bigint")
    ).where(F.col("_d2") <= reach * reach)
    nearest = F.min(F.struct(F.col("_d2").alias("d2"), F.col("id"))).alias("_b")
    out = across.withColumn("y", F.col("y") + F.col("_dy")).groupBy(*group, "y", "x").agg(nearest)
    return out.select(*keys, "y", "x", F.col("_b.d2").alias("d2"), F.col("_b.id").alias("id"))


def _swept(seeds: DataFrame, reach: int, keys: list[str], per_id: bool) -> DataFrame:
    """An exact distance transform in two passes.

    Along a line of the raster every seed holds the positions that are nearer to it than to its
    neighbours, so a position comes out once, however many seeds are within reach. Along a column
    the minimum over all lines is the lower envelope of parabolas, see ``_envelopes``.
    """
    group = [*keys, "id"] if per_id else keys
    of = seeds.schema
    points = seeds.select(*keys, "id", "y", "x").distinct() if per_id else seeds.groupBy(*keys, "y", "x").agg(F.min("id").alias("id"))
    line = Window.partitionBy(*group, "y").orderBy("x")

    def last_of_left(left: Column, left_id: Column, right: Column, right_id: Column) -> Column:
        """The last position that belongs to the left one of two neighbours; the middle goes to the lower id."""
        both = left + right
        return F.floor(both / 2) - F.when((both % 2 == 0) & (right_id < left_id), 1).otherwise(0)

    x, i = F.col("x"), F.col("id")
    before, before_id, behind, behind_id = F.lag("x").over(line), F.lag("id").over(line), F.lead("x").over(line), F.lead("id").over(line)
    first = F.coalesce(F.greatest(last_of_left(before, before_id, x, i) + 1, x - reach), x - reach)
    last = F.coalesce(F.least(last_of_left(x, i, behind, behind_id), x + reach), x + reach)
    held = points.withColumns({"_first": first.cast("bigint"), "_last": last.cast("bigint")})
    spread = held.select(*keys, "id", "y", F.col("x").alias("_from"), F.explode(F.sequence("_first", "_last")).alias("x"))
    along = spread.select(*keys, "y", F.col("x").cast(of["x"].dataType).alias("x"), "id", F.abs(F.col("x") - F.col("_from")).cast("bigint").alias("d"))

    schema = T.StructType([*[T.StructField(k, of[k].dataType) for k in keys], of["y"], of["x"], T.StructField("d2", T.LongType()), T.StructField("id", of["id"].dataType)])
    sorted_columns = along.repartition(*group, "x").sortWithinPartitions(*group, "x", "y")
    return sorted_columns.mapInArrow(_envelopes(keys, group, reach), schema)


def _envelopes(keys: list[str], group: list[str], reach: int):
    """Minimum of ``d^2 + dy^2`` over the rows of a column, for every ``y`` where it is ``reach^2`` at most.

    Of two rows, the lower one is the better up to some ``y`` and the upper one beyond it, so a
    stack holds the rows that are best somewhere and where each of them begins. A row is pushed once
    and popped once, whatever the reach.
    """
    limit = reach * reach

    def overtakes(p: tuple, q: tuple) -> int:
        """First ``y`` where ``q`` is nearer than ``p``, which lies below it, or as near with a lower id."""
        (yp, fp, ip), (yq, fq, iq) = p, q
        above, width = yq * yq + fq - yp * yp - fp, 2 * (yq - yp)
        return -(-above // width) if iq < ip else above // width + 1

    def spans(rows: list[tuple]) -> Iterator[tuple[tuple, int, int]]:
        stack: list[tuple[tuple, int | None]] = []
        for q in rows:
            start = None
            while stack:
                start = overtakes(stack[-1][0], q)
                if stack[-1][1] is None or start > stack[-1][1]:
                    break
                stack.pop()
                start = None
            stack.append((q, start))
        for (row, start), (_, end) in zip(stack, [*stack[1:], (None, None)]):
            wide = math.isqrt(limit - row[1])
            low = row[0] - wide if start is None else max(start, row[0] - wide)
            high = row[0] + wide if end is None else min(end - 1, row[0] + wide)
            if low <= high:
                yield row, low, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, rows, out, n, fields = None, [], [], 0, None

        def emit() -> pa.RecordBatch:
            sizes = np.array([high - low + 1 for *_, low, high in out])
            ends = np.cumsum(sizes)
            y = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(np.array([low for *_, low, _ in out]), sizes)
            at, f = (np.repeat(np.array([r[1][i] for r in out], np.int64), sizes) for i in (0, 1))
            which = pa.array(np.repeat(np.arange(len(out)), sizes))
            parts = {k: pa.array([r[0][k] for r in out], fields.field(k).type).take(which) for k in [*keys, "x"]}
            ids = pa.array([r[1][2] for r in out], fields.field("id").type).take(which)
            values = [*(parts[k] for k in keys), pa.array(y, fields.field("y").type), parts["x"], pa.array(f + (y - at) ** 2, pa.int64()), ids]
            return pa.RecordBatch.from_arrays(values, [*keys, "y", "x", "d2", "id"])

        for b in batches:
            fields = b.schema
            names = list(dict.fromkeys([*group, "x"]))
            place = zip(*(b.column(c).to_pylist() for c in names))
            for own, y, d, i in zip(place, *(b.column(c).to_pylist() for c in ("y", "d", "id"))):
                if own != column:
                    if rows:
                        out += [(dict(zip(names, column)), *s) for s in spans(rows)]
                        n += len(rows)
                    column, rows = own, []
                rows.append((y, d * d, i))
            if n > 50_000 and out:
                yield emit()
                out, n = [], 0
        if rows:
            out += [(dict(zip(names, column)), *s) for s in spans(rows)]
        if out:
            yield emit()

    return run


def plain_buffer(seeds: DataFrame, reach: int, keys: list[str]) -> DataFrame:
    """Cells within ``reach`` of each outline; buffers of neighbours may overlap."""
    grown = distances(edge_cells(seeds, keys), reach, keys, per_id=True).select(*keys, "id", "y", "x")
    return grown.unionByName(seeds.select(*keys, "id", "y", "x")).distinct()


def exclusive_distances(seeds: DataFrame, reach: int, keys: list[str]) -> DataFrame:
    """Nearest outline and squared distance of the cells around, but outside of, all outlines."""
    grown = distances(edge_cells(seeds, keys), reach, keys, per_id=False)
    return grown.join(unbroadcast(seeds.select(*keys, "y", "x")), [*keys, "y", "x"], "left_anti")


def buffer_non_overlapping(seeds: DataFrame, reach: int, keys: list[str]) -> DataFrame:
    """Grow all outlines by ``reach``; contested cells go to the nearest outline.

    No buffer enters another outline, and every outline keeps its own cells.
    """
    own = seeds.select(*keys, "id", "y", "x").distinct()
    if reach <= 0:
        return own
    return exclusive_distances(seeds, reach, keys).select(*keys, "id", "y", "x").unionByName(own)


def buffers_non_overlapping(seeds: DataFrame, reaches: list[int], keys: list[str]) -> DataFrame:
    """Non-overlapping buffers of several sizes, told apart by ``reach``.

    The nearest outline of a cell does not depend on the size of the buffer, so the
    distances are computed once, for the largest.
    """
    near = exclusive_distances(seeds, max(reaches), keys)
    sizes = F.array(*[F.lit(r) for r in reaches])
    grown = near.withColumn("reach", F.explode(F.filter(sizes, lambda r: r * r >= F.col("d2"))))
    own = seeds.select(*keys, "id", "y", "x").distinct().withColumn("reach", F.explode(sizes))
    columns = ["reach", *keys, "id", "y", "x"]
    return grown.select(*columns).unionByName(own.select(*columns))


def region_layers(
    seeds: DataFrame, keys: list[str], qc: int, patch_sampling: int, infer: int, fp: tuple[int, int]
) -> DataFrame:
    """The five regions of every outline as one table ``layer, keys, id, y, x``.

    Distances are in cells. The snow-index region leaves out every outline; the
    false-positive ring is the outer buffer minus the inner one. All layers are cut from
    two distance tables: one per outline, and one in which the nearest outline wins.
    """
    columns = [*keys, "id", "y", "x"]
    own = materialise(seeds.select(*columns).distinct())
    per = materialise(distances(edge_cells(own, keys), max(qc, patch_sampling), keys, per_id=True))
    near = materialise(exclusive_distances(own, max(infer, *fp), keys))

    def within(table: DataFrame, reach: int) -> DataFrame:
        return table.where(F.col("d2") <= reach * reach).select(*columns)

    def plain(reach: int) -> DataFrame:
        return within(per, reach).unionByName(own).distinct()

    layers = {
        "buffer_clouds": plain(qc),
        "buffer_ndsi": within(per, qc).join(unbroadcast(own.select(*keys, "y", "x")), [*keys, "y", "x"], "left_anti"),
        "buffer_patch_sampling": plain(patch_sampling),
        "buffer_infer": within(near, infer).unionByName(own),
        # both buffers hold the outlines themselves, so these cancel
        "buffer_fp": within(near.where(F.col("d2") > fp[0] * fp[0]), fp[1]),
    }
    tagged = [df.select(F.lit(n).alias("layer"), *columns) for n, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def equal_area_distance(
    selected: DataFrame, rest: DataFrame, keys: list[str], start: float, step: float, gsd: float,
    within: DataFrame | None = None, limit: float | None = None,
) -> DataFrame:
    """Smallest ``start + n * step`` whose ring around the selected outlines has their area.

    A cell joins the ring once the selected outlines reach it and leaves it again when
    the others do, which grow at half the rate. Both moments are whole steps, so one
    histogram of arrivals and departures and its running sum give the area at every
    step. ``keys`` name the region that is balanced as a whole (a constant column makes
    everything one region). ``within`` restricts the ring to existing cells. The reach
    doubles for the keys that have no answer yet, up to ``limit``; a key whose distance would
    be beyond the limit is NULL. A ``limit`` is required with ``within``.
    """
    if within is not None and limit is None:
        raise ValueError("a ring inside given cells may never be large enough: set a limit")
    at = [*keys, "y", "x"]
    selected = materialise(selected.select(*at).distinct().withColumn("id", F.lit(0)))
    rest = materialise(rest.select(*at).distinct().withColumn("id", F.lit(0)))
    target = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_target"))
    selected_edge, rest_edge = materialise(edge_cells(selected, keys)), materialise(edge_cells(rest, keys))
    reach = max(2, int(2 * (start + step) / gsd))
    furthest = None if limit is None else max(1, math.ceil(limit / gsd))
    answers = []
    while True:
        reach = reach if furthest is None else min(reach, furthest)
        near = distances(selected_edge, reach, keys, per_id=False)
        far = distances(rest_edge, reach, keys, per_id=False).select(*at, F.col("d2").alias("_r2"))
        taken = selected.select(*at).unionByName(rest.select(*at))
        ring = near.join(unbroadcast(far), at, "left").join(unbroadcast(taken), at, "left_anti")
        if within is not None:
            ring = ring.join(unbroadcast(within.select(*at)), at, "left_semi")
        d_sel, d_rest = F.sqrt("d2") * gsd, F.sqrt("_r2") * gsd
        joins = F.ceil(F.round((d_sel - start) / step, 9))
        leaves = F.ceil(F.round(2 * (d_rest - start) / step, 9))
        ring = ring.where(d_sel > start).where(F.col("_r2").isNull() | (d_rest > start))
        events = ring.select(*keys, F.explode(F.array(
            F.struct(joins.alias("n"), F.lit(1).alias("c")),
            F.struct(leaves.alias("n"), F.lit(-1).alias("c")),
        )).alias("_e"), joins.alias("_j"), leaves.alias("_l"))
        live = events.where(F.col("_l").isNull() | (F.col("_l") > F.col("_j"))).where(F.col("_e.n").isNotNull())
        seen_to = reach * gsd if limit is None else min(reach * gsd, limit)
        last_step = math.floor(round((seen_to - start) / step, 9))
        hist = live.groupBy(*keys, F.col("_e.n").alias("n")).agg(F.sum("_e.c").alias("_c")).where(F.col("n") <= last_step)
        w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        area = hist.withColumn("_area", F.sum("_c").over(w))
        found = area.join(target, keys).where(F.col("_area") >= F.col("_target")).groupBy(*keys).agg(
            (F.lit(float(start)) + F.min("n") * F.lit(float(step))).alias("distance")
        )
        answer = materialise(target.join(found, keys, "left").select(*keys, "distance"))
        unanswered = answer.where(F.col("distance").isNull())
        if reach == furthest or unanswered.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), [*answers, answer])
        answers.append(answer.where(F.col("distance").isNotNull()))
        # only what is still open goes on with twice the reach
        selected, rest, target, selected_edge, rest_edge = (
            t.join(unanswered.select(*keys), keys, "left_semi") for t in (selected, rest, target, selected_edge, rest_edge)
        )
        reach *= 2
