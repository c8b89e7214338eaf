"""What the findings of round 3 were about."""

import numpy as np
from pyspark.sql import functions as F

from firnline.functions import naming
from firnline.operators import buffers, inventory, neighbours, outlines, spatial
from firnline.plans import fixtures, spatial_queries


def squares(spark, n):
    ring = F.array(*[F.struct((F.col("id") * 10 + sx * 3).cast("double").alias("x"), F.lit(float(sy * 3)).alias("y")) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    return spark.range(n).select(F.col("id").alias("entry_id"), F.array(ring).alias("rings"))


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_id_raster_keeps_cells_from_the_driver(spark):
    covered = spatial.rasterise(squares(spark, 5), 1.0)
    one = covered.select(F.lit("all").alias("raster"), "y", "x")
    cells = inventory.crop(one.distinct(), inventory.cell_extents(one, key="raster"), pad=True, key="raster")
    assert broadcasts(spatial.id_raster(cells.select("y", "x"), covered, "entry_id", "entry_id")) == 0


def test_outline_mask_keeps_cells_from_the_driver(spark):
    covered = spatial.rasterise(squares(spark, 5), 1.0)
    cells = inventory.crop(covered, inventory.cell_extents(covered, 3), pad=True).select("entry_id", "y", "x")
    assert broadcasts(spatial.outline_mask(cells, covered, "m", 2)) == 0


def test_exclusive_buffers_keep_cells_from_the_driver(spark):
    seeds = spatial.rasterise(squares(spark, 5), 1.0).withColumnRenamed("entry_id", "id").withColumn("component", F.lit(0))
    assert broadcasts(buffers.buffers_non_overlapping(seeds, [1, 3], ["component"])) == 0


def test_rings_far_apart_do_not_share_a_box(spark):
    def at(x, half):
        return [{"x": float(x + sx * half), "y": float(sy * half)} for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]

    # two parts, one of them with a hole; a row of points between them
    around = spark.createDataFrame([("a", [at(0, 5), at(0, 2), at(100_000, 5)])], "entry_id string, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(i, float(x), 0.5) for i, x in enumerate((0, 4, 50_000, 100_001, 100_006))], "p int, px double, py double")
    found = spatial.points_in_outlines(points, around.withColumnRenamed("entry_id", "around"), ["around"], "p")
    assert sorted((r["p"], r["around"]) for r in found.collect()) == [(0, None), (1, "a"), (2, None), (3, "a"), (4, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_ring" in plan  # looked up by ring

def test_nearest_fill_in_a_hole_far_wider_than_its_rim(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 100, (150, 170))
    data = [(1, y, x, float(v[y, x]), 60 <= x < 165 and y >= 20) for y in range(150) for x in range(170)]
    df = spark.createDataFrame(data, "entry_id bigint, y bigint, x bigint, v double, gap boolean")
    s = np.array([(y, x, u) for _, y, x, u, gap in data if not gap])
    out = {(r["y"], r["x"]): r["filled"] for r in neighbours.nearest_fill(df, "v", F.col("gap"), ~F.col("gap")).collect()}
    assert len(out) == sum(r[4] for r in data)
    for y, x in list(out)[::97]:
        d2 = (s[:, 0] - y) ** 2 + (s[:, 1] - x) ** 2
        assert abs(out[y, x] - s[d2 <= np.sort(d2)[29], 2].mean()) < 1e-9
    # ground that no gap can look at stays behind
    base = df.select("entry_id", "y", "x", F.col("v").alias("_v"), F.col("gap").alias("_fill"), (~F.col("gap")).alias("_ok"), F.lit(0).alias("_by"), F.lit(0).alias("_bx"))
    left = neighbours._near_rims(base, F.col("_ok"), 30)
    assert left.count() < len(s) and left.where("y between 60 and 80 and x between 25 and 30").count() == 0


def test_padded_ids_are_cut_to_their_width(spark):
    ids = spark.createDataFrame([(7,), (9999,), (12345,)], "n bigint")
    assert [r[0] for r in ids.select(naming.padded_id(F.col("n"), "g_", 4, cut=True)).collect()] == ["g_0007", "g_9999", "g_1234"]
    assert [r[0] for r in ids.select(naming.padded_id(F.col("n"), "g_", 4)).collect()] == ["g_0007", "g_9999", "g_12345"]


def test_mean_of_an_acquisition_does_not_depend_on_the_order_of_rows(spark):
    values = [0.1, 0.2, 0.3, 122.79, 29.27, 56.25]
    data = [(g, v) for g, vs in (("a", values), ("b", values[::-1]), ("c", [0.3, 0.1, 122.79, 0.2, 56.25, 29.27])) for v in vs]
    means = spark.createDataFrame(data, "g string, v double").coalesce(1).groupBy("g").agg(fixtures.exact_mean(F.col("v")).alias("m"))
    assert len({r["m"] for r in means.collect()}) == 1
    odd = spark.createDataFrame([("n", None), ("x", 1e30), ("x", 3e30)], "g string, v double").groupBy("g").agg(fixtures.exact_mean(F.col("v")).alias("m"))
    assert {r["g"]: r["m"] for r in odd.collect()} == {"n": None, "x": 2e30}


def test_segments_that_share_a_number_are_joined(spark):
    cells = [(1, 9_999, 3, 9_999), (1, 10_000, 3, 9_999), (2, 0, 3, 0), (2, 5, 1, 5)]
    df = spark.createDataFrame(cells, "entry_id int, y bigint, x bigint, top bigint")
    s = df.select("entry_id", F.struct("entry_id", F.col("top").alias("y"), "x").alias("segment"), "y", "x")
    got = {(r["entry_id"], r["y"]): r["segment"] for r in spatial_queries._numbered(s).collect()}
    assert got == {(1, 9_999): 1_999_903, (1, 10_000): 1_999_903, (2, 0): 1_999_903, (2, 5): 2_000_501}


def test_boundary_edges_keep_cells_from_the_driver(spark):
    cells = spark.range(40).select(F.lit(1).alias("entry_id"), F.lit(0).alias("segment"), F.floor(F.col("id") / 8).alias("y"), (F.col("id") % 8).alias("x"))
    assert broadcasts(outlines.boundary_edges(cells)) == 0
