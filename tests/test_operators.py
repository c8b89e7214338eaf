"""Operators on small hand-made data: brute force, invariants and error cases."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline import session, tables
from firnline.functions import geometry, naming, probability, spectral
from firnline.operators import (
    buffers, calibrate, catalogue, change, components, ensemble, evaluate, folds, images, inventory, neighbours, ordering, outlines, patches, pixels, spatial, thresholds,
)
from firnline.operators.entry_functions import map_entries
from firnline.session import materialise
from firnline.sources import readers, writers


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def grid(spark, values, entry="a"):
    """A raster as ``entry_id, y, x, v``."""
    data = [(entry, y, x, float(v)) for y, line in enumerate(values) for x, v in enumerate(line)]
    return spark.createDataFrame(data, "entry_id string, y bigint, x bigint, v double")


# --- ordering with one key that holds most rows ------------------------------------------------

def hot(spark, n=3000):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 50}", rng.randrange(200), i) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, v int, id int")


def test_running_totals_match_brute_force_on_a_hot_key(spark):
    data, df = hot(spark)
    out = ordering.running_totals(df, ["k"], ["v", "id"], {"cum": F.col("v")}, {"all": "cum"})
    expected = []
    for k in {d[0] for d in data}:
        run = 0
        group = sorted((v, i) for kk, v, i in data if kk == k)
        total = sum(v for v, _ in group)
        for v, i in group:
            run += v
            expected.append((k, i, run, total))
    assert rows(out, "k", "id", "cum", "all") == sorted(expected)


def test_hot_key_is_spread_over_slices(spark):
    _, df = hot(spark)
    placed = df.repartitionByRange(4, "k", "v", "id").withColumn("s", F.spark_partition_id())
    assert placed.where("k = 'hot'").select("s").distinct().count() > 1


def test_row_number_variants_agree(spark):
    data, df = hot(spark)
    a = ordering.row_numbers(df, ["k"], ["id"])
    b = ordering.block_row_numbers(df, ["k"], "id", block=64)
    assert rows(a, "k", "id", "rn") == rows(b, "k", "id", "rn")


def test_exact_quantiles_match_numpy(spark):
    data, df = hot(spark)
    out = {r["k"]: r for r in ordering.exact_quantiles(df, ["k"], F.col("v").cast("double"), {"a": 0.01, "b": 0.5, "c": 0.99}).collect()}
    for k in out:
        v = [d[1] for d in data if d[0] == k]
        assert [out[k][n] for n in "abc"] == pytest.approx(list(np.quantile(v, [0.01, 0.5, 0.99])))


def test_quantiles_ignore_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "k string, v double")
    assert ordering.exact_quantiles(df, ["k"], F.col("v"), {"q": 0.5}).first()["q"] == 2.0


def test_raster_row_numbers_are_row_major(spark):
    df = grid(spark, np.zeros((5, 4))).where("not (y = 1 and x = 2)")
    got = rows(ordering.raster_row_numbers(df), "rn", "y", "x")
    assert [(y, x) for _, y, x in got] == sorted((y, x) for _, y, x in got) and [r[0] for r in got] == list(range(1, 20))


# --- components --------------------------------------------------------------------------------

def find_components(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return sorted(enumerate(label))


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_connected_components(spark, kind):
    rng = random.Random(7)
    n = 60
    edges = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)],
        "chain": [(i, i + 1) for i in range(n - 1)][::-1],
        "star": [(n - 1, i) for i in range(0, n - 1, 2)],
        "none": [],
    }[kind]
    e = spark.createDataFrame(edges, "a int, b int")
    v = spark.range(n).select(F.col("id").cast("int").alias("v"))
    assert rows(components.connected_components(e, v), "v", "component") == find_components(n, edges)


def test_segments_by_connectivity_and_size(spark):
    mask = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [1, 0, 0, 1]])
    df = grid(spark, mask)
    eight = spatial.segments(df, F.col("v") == 1, 10.0)
    four = spatial.segments(df, F.col("v") == 1, 10.0, connectivity=4)
    assert eight.select("segment").distinct().count() == 3
    assert four.select("segment").distinct().count() == 4
    assert spatial.segments(df, F.col("v") == 1, 10.0, min_km2=2e-4).count() == 3
    with pytest.raises(ValueError):
        spatial.segments(df, F.col("v") == 1, 10.0, connectivity=6)


# --- gap filling -------------------------------------------------------------------------------

def test_nearest_fill_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 100, (20, 17)).astype(float)
    gap = np.zeros(v.shape, bool)
    gap[3:16, 2:13] = True
    df = grid(spark, v)
    in_gap = F.col("y").between(3, 15) & F.col("x").between(2, 12)
    out = {(r["y"], r["x"]): r["filled"] for r in neighbours.nearest_fill(df, "v", in_gap, ~in_gap, 30).collect()}
    oy, ox = np.where(~gap)
    assert len(out) == gap.sum()
    for y, x in zip(*np.where(gap)):
        d = (oy - y) ** 2 + (ox - x) ** 2
        near = d <= np.quantile(d, 30 / len(d))
        assert out[(y, x)] == pytest.approx(v[oy[near], ox[near]].mean())


def test_sources_without_value_are_ignored(spark):
    df = grid(spark, np.ones((8, 8))).withColumn("v", F.when(F.col("x") > 0, F.col("v"))).withColumn("h", F.lit(1))
    gap = (F.col("y") == 4) & (F.col("x") == 4)
    assert neighbours.nearest_fill(df, "v", gap, ~gap, 55).first()["filled"] == 1.0
    assert neighbours.nearest_fill(df, "v", gap, ~gap, 56).count() == 0
    assert neighbours.elevation_fill(df, "v", "h", gap, ~gap, 10).first()["filled"] == 1.0


def test_fill_is_skipped_with_too_few_sources(spark):
    df = grid(spark, np.ones((5, 5)))
    ok = F.col("y") == 0
    assert neighbours.nearest_fill(df, "v", ~ok, ok, 30).count() == 0
    kept = neighbours.fill_gaps(df, "v", ~ok, ok, "nn")
    assert kept.where("v is null").count() == 0


def test_elevation_fill_against_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 100, (15, 12)).astype(float)
    h = rng.integers(0, 40, (15, 12))
    data = [("a", y, x, float(v[y, x]), int(h[y, x])) for y in range(15) for x in range(12)]
    df = spark.createDataFrame(data, "entry_id string, y bigint, x bigint, v double, h int")
    gap = (F.col("x") % 5) == 2
    out = {(r["y"], r["x"]): r["filled"] for r in neighbours.elevation_fill(df, "v", "h", gap, ~gap, 30).collect()}
    g = np.zeros(v.shape, bool)
    g[:, [2, 7]] = True
    ranked = np.sort(h[~g])
    for y, x in zip(*np.where(g)):
        i = np.searchsorted(ranked, h[y, x])
        lo, hi = ranked[max(0, i - 15)], ranked[min(len(ranked) - 1, i + 15)]
        assert out[(y, x)] == pytest.approx(v[~g & (lo <= h) & (h <= hi)].mean())


def test_fill_method_names(spark):
    df = grid(spark, np.ones((2, 2)))
    assert neighbours.fill_gaps(df, "v", F.lit(False), F.lit(True), None) is df
    with pytest.raises(ValueError):
        neighbours.fill_gaps(df, "v", F.lit(False), F.lit(True), "spline")


# --- terrain and resampling --------------------------------------------------------------------

def test_terrain_of_an_inclined_plane(spark):
    y, x = np.mgrid[0:9, 0:9]
    df = grid(spark, 100.0 - 10.0 * y).withColumnRenamed("v", "dem")
    inner = neighbours.terrain(df, "dem", 10.0).where("y between 3 and 5 and x between 3 and 5").collect()
    for r in inner:
        assert r["slope"] == pytest.approx(45.0, abs=1e-4)
        assert r["aspect"] == pytest.approx(180.0, abs=1e-6)
        assert r["planform_curvature"] == pytest.approx(0.0, abs=1e-9)
    flat = neighbours.terrain(grid(spark, np.full((5, 5), 7.0)).withColumnRenamed("v", "dem"), "dem").collect()
    assert {(round(r["slope"], 9), r["aspect"]) for r in flat} == {(0.0, 180.0)}


def test_terrain_rejects_gaps(spark):
    df = grid(spark, np.ones((3, 3))).withColumn("dem", F.when(F.col("x") > 0, F.col("v")))
    with pytest.raises(ValueError):
        neighbours.terrain(df, "dem")


def test_bilinear_leaves_out_missing_neighbours(spark):
    src = spark.createDataFrame([(0, 0, 10.0), (0, 1, None), (1, 0, 30.0), (1, 1, 50.0)], "y int, x int, v double")
    t = spark.createDataFrame([("p", 0.5, 0.5), ("q", 0.0, 0.0), ("r", 9.0, 9.0)], "id string, ty double, tx double")
    out = dict(rows(neighbours.bilinear(t, src, "v", F.col("ty"), F.col("tx")), "id", "v")[:2])
    assert out == {"p": 30.0, "q": 10.0}


# --- buffers -----------------------------------------------------------------------------------

def seed_table(spark, cells):
    return spark.createDataFrame([("a", i, y, x) for i, y, x in cells], "entry_id string, id int, y bigint, x bigint")


def test_buffers_never_overlap_and_keep_originals(spark):
    cells = [(1, y, x) for y in range(4) for x in range(4)] + [(2, y, x) for y in range(5, 9) for x in range(3, 8)]
    seeds = seed_table(spark, cells)
    out = rows(buffers.buffer_non_overlapping(seeds, 3, ["entry_id"]), "id", "y", "x")
    owner = {}
    for i, y, x in out:
        assert (y, x) not in owner
        owner[(y, x)] = i
    for i, y, x in cells:
        assert owner[(y, x)] == i
    for (y, x), i in owner.items():
        best = min(((y - sy) ** 2 + (x - sx) ** 2, s) for s, sy, sx in cells)
        assert best[1] == i and best[0] <= 9


def test_layers_agree_with_their_separate_buffers(spark):
    cells = [(1, y, x) for y in range(4) for x in range(4)] + [(2, y, x) for y in range(5, 9) for x in range(3, 8)]
    seeds, keys, at = seed_table(spark, cells), ["entry_id"], ["id", "y", "x"]
    layers = buffers.region_layers(seeds, keys, qc=3, patch_sampling=1, infer=1, fp=(2, 4)).cache()

    def layer(name):
        return rows(layers.where(F.col("layer") == name), *at)

    def grown(reach):
        return buffers.buffer_non_overlapping(seeds, reach, keys)

    assert layer("buffer_clouds") == rows(buffers.plain_buffer(seeds, 3, keys), *at)
    assert layer("buffer_patch_sampling") == rows(buffers.plain_buffer(seeds, 1, keys), *at)
    assert layer("buffer_infer") == rows(grown(1), *at)
    assert layer("buffer_fp") == rows(evaluate.overlay_difference(grown(4), grown(2), ["entry_id", *at]), *at)
    several = buffers.buffers_non_overlapping(seeds, [0, 2], keys)
    assert rows(several.where("reach = 2"), *at) == rows(grown(2), *at)
    assert rows(several.where("reach = 0"), *at) == rows(seeds, *at)
    layers.unpersist()


def test_plain_buffers_may_overlap(spark):
    out = rows(buffers.plain_buffer(seed_table(spark, [(1, 0, 0), (2, 0, 3)]), 2, ["entry_id"]), "id", "y", "x")
    assert (1, 0, 1) in out and (2, 0, 1) in out and len(out) == 26


def test_equal_area_distance_of_a_lone_square(spark):
    cells = [(0, y, x) for y in range(10) for x in range(10)]
    sel = seed_table(spark, cells)
    none = sel.where("id < 0")
    got = buffers.equal_area_distance(sel, none, ["entry_id"], 0.0, 10.0, 10.0).first()["distance"]

    def ring(d):
        n = 0
        for y in range(-30, 40):
            for x in range(-30, 40):
                dy, dx = max(0, -y, y - 9), max(0, -x, x - 9)
                n += 0 < math.hypot(dy, dx) <= d
        return n

    assert got == 10.0 * next(d for d in range(1, 30) if ring(d) >= 100)


def test_ring_inside_given_cells_needs_a_limit(spark):
    seeds = seed_table(spark, [(0, 0, 0)])
    with pytest.raises(ValueError):
        buffers.equal_area_distance(seeds, seeds.where("id < 0"), ["entry_id"], 0.0, 10.0, 10.0, within=seeds)


# --- geometry ----------------------------------------------------------------------------------

def outline_table(spark, shapes):
    data = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes]
    schema = T.StructType([T.StructField("entry_id", T.StringType()), tables.OUTLINES["rings"]])
    return spark.createDataFrame(data, schema)


SQUARE = [(0, 0), (100, 0), (100, 100), (0, 100)]
HOLE = [(40, 40), (40, 60), (60, 60), (60, 40)]


def test_area_centroid_and_containment_with_a_hole(spark):
    df = spatial.with_edges(outline_table(spark, [("a", [SQUARE, HOLE])]))
    r = geometry.with_interior_point(df, "edges", "p").select(
        geometry.area(F.col("edges")).alias("area"), "p",
        geometry.contains(F.col("edges"), F.lit(50.0), F.lit(50.0)).alias("in_hole"),
        geometry.contains(F.col("edges"), F.lit(10.0), F.lit(50.0)).alias("in_body")).first()
    assert r["area"] == 9600.0 and not r["in_hole"] and r["in_body"]
    assert math.hypot(r["p"]["x"] - 50, r["p"]["y"] - 50) == pytest.approx(10.0)


def test_rasterise_respects_holes(spark):
    got = rows(spatial.rasterise(outline_table(spark, [("a", [SQUARE, HOLE])]), 10.0), "y", "x")
    expected = sorted((y, x) for y in range(10) for x in range(10) if not (4 <= y <= 5 and 4 <= x <= 5))
    assert got == expected


def test_rasterise_matches_point_tests_on_a_random_polygon(spark):
    rng = random.Random(4)
    ring = [(200 + (50 + rng.random() * 120) * math.cos(a), 200 + (50 + rng.random() * 120) * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 11)[:-1]]
    o = outline_table(spark, [("a", [ring])])
    got = set(rows(spatial.rasterise(o, 10.0), "y", "x"))
    points = spark.createDataFrame([(y * 41 + x, (x + 0.5) * 10, (y + 0.5) * 10) for y in range(41) for x in range(41)], "entry_id int, px double, py double")
    inside = spatial.points_in_outlines(points, o.withColumnRenamed("entry_id", "name"), ["name"]).where("name is not null")
    assert got == {(r["entry_id"] // 41, r["entry_id"] % 41) for r in inside.collect()}


def test_close_pairs_of_very_different_sizes(spark):
    def square(cx, cy, h):
        return [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h)]

    rng = random.Random(9)
    shapes = [(f"s{i:02d}", rng.uniform(0, 500), rng.uniform(0, 500), rng.choice([1, 5, 60, 200])) for i in range(60)]
    o = outline_table(spark, [(k, [square(x, y, h)]) for k, x, y, h in shapes])
    expected = []
    for i, (a, ax, ay, ah) in enumerate(shapes):
        for b, bx, by, bh in shapes[i + 1:]:
            gap = math.hypot(max(abs(ax - bx) - ah - bh, 0), max(abs(ay - by) - ah - bh, 0))
            if gap <= 15:
                expected.append((a, b))
    assert rows(spatial.close_pairs(o, 15.0), "a", "b") == sorted(expected)


def test_nearest_points_expand_until_found(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 1000.0), (3, None, 1.0)], "l int, px double, py double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (5, -3.0, 4.0)], "r int, px double, py double")
    got = rows(spatial.nearest_points(left, right, 1.0, "l", "r"), "l", "r", "distance")
    assert got[0] == (1, 5, 5.0) and got[1][1] == 7 and got[2] == (3, None, None)


def test_empty_intersection_is_an_error(spark):
    a = spatial.with_edges(outline_table(spark, [("a", [SQUARE])]))
    b = spatial.with_edges(outline_table(spark, [("b", [[(x + 900, y) for x, y in SQUARE]])])).withColumnRenamed("entry_id", "tile")
    with pytest.raises(ValueError, match="no intersection for: a"):
        spatial.require_hits(a, spatial.box_pairs(a, b, "entry_id", "tile"), "entry_id")


# --- folds and inventory -----------------------------------------------------------------------

@pytest.mark.parametrize("k", [1, 3, 5])
def test_folds_are_disjoint_and_complete(spark, k):
    rng = random.Random(2)
    e = spark.createDataFrame([(i, rng.random() * 10, float(i % 13)) for i in range(200)], "entry_id long, area_km2 double, bound_lim double")
    f = folds.assert_no_empty_fold(folds.assert_disjoint(folds.assign_folds(e, 5, k, 0.1)))
    assert f.count() == 200
    share = {r["fold"]: r["area_share"] for r in folds.fold_summary(f).collect()}
    assert share["test"] == pytest.approx(0.2, abs=0.05) and share["val"] == pytest.approx(0.1, abs=0.05)
    with pytest.raises(ValueError):
        folds.assign_folds(e, 5, 6, 0.1)


def test_overlapping_folds_are_an_error(spark):
    with pytest.raises(ValueError):
        folds.assert_disjoint(spark.createDataFrame([(1, "train"), (1, "test")], "entry_id int, fold string"))
    with pytest.raises(ValueError):
        folds.assert_no_empty_fold(spark.createDataFrame([(1, "train"), (2, "test")], "entry_id int, fold string"))


def test_required_columns_and_subset(spark):
    df = spark.createDataFrame([(1,)], "entry_id int")
    with pytest.raises(ValueError, match="date_inv, geometry"):
        tables.require_columns(df, ["entry_id", "date_inv", "geometry"])
    with pytest.raises(ValueError, match="unknown entry_id: 1"):
        inventory.assert_subset(df, df.where("entry_id > 5"))
    with pytest.raises(ValueError):
        inventory.with_parameters(df, df.unionByName(df), ["entry_id"])


def test_uncovered_crop_is_an_error(spark):
    df = grid(spark, np.ones((4, 4)))
    inside = inventory.cell_extents(df.where("x between 1 and 2 and y between 1 and 2"), 1)
    assert inventory.require_covered(df, inside) is df
    with pytest.raises(ValueError):
        inventory.require_covered(df, inventory.cell_extents(df, 1))


def test_missing_band_is_an_error(spark):
    with pytest.raises(ValueError):
        pixels.select_bands(grid(spark, np.ones((2, 2))), {"v": "B", "B12": "SWIR"})


# --- scores, features and patches --------------------------------------------------------------

def test_missing_metric_ranks_last_and_constant_metric_scores_one(spark):
    i = spark.createDataFrame([(1, "2024-01-01", 0.5, None), (1, "2024-01-02", 0.5, 0.2), (1, "2024-01-03", 0.5, 0.6)],
                              "entry_id int, date string, cloud_p double, ndsi double")
    out = images.rank(images.score(i, ["cloud_p", "ndsi"])).orderBy("rank").collect()
    assert [r["date"] for r in out] == ["2024-01-02", "2024-01-03", "2024-01-01"]
    assert out[0]["score"] == 1.0 and out[1]["score"] == 0.5 and out[2]["score"] is None


def test_infinite_and_sentinel_values_become_null(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (-9999.0,), (None,)], "v double")
    got = [r[0] for r in df.select(tables.missing_to_null(F.col("v"), -9999.0)).collect()]
    assert got == [1.0, None, None, None, None]


def test_dates_in_names(spark):
    df = spark.createDataFrame([("a_20230815_b",), ("x123456789",), ("20231399",), ("2023-08-15",)], "n string")
    got = [str(r[0]) for r in df.select(naming.date_in_name(F.col("n"))).collect()]
    assert got == ["2023-08-15", "None", "None", "None"]


def test_symmetries_match_numpy(spark):
    a = np.arange(16).reshape(4, 4)
    expected = [a.T[:, ::-1], a[::-1, ::-1], a.T[::-1, :], a[:, ::-1], a[::-1, :], a.T, a.T[::-1, ::-1]]
    data = [(d, y, x, int(a[y, x])) for d in range(8) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(data, "patch_id long, py int, px int, v int")
    got = patches.augment(df, 4, F.col("patch_id")).collect()
    for d in range(8):
        out = np.zeros((4, 4), int)
        for r in got:
            if r["patch_id"] == d:
                out[r["py"], r["px"]] = r["v"]
        assert (out == (expected[d] if d < 7 else a)).all()


@pytest.mark.parametrize("n", [8, 17, 40])
def test_subsample_keeps_exactly_n_and_every_entry(spark, n):
    data = [(f"e{k}", y, 0) for k, size in enumerate([1, 2, 9, 60, 3, 5]) for y in range(size)]
    df = spark.createDataFrame(data, "entry_id string, y_center int, x_center int")
    out = patches.subsample(df, n)
    assert out.count() == n and out.select("entry_id").distinct().count() == 6
    assert patches.subsample(df, 1000) is df


def test_patches_outside_the_raster_are_left_out(spark):
    df = grid(spark, np.ones((8, 8)))
    centres = spark.createDataFrame([("a", 4, 4), ("a", 1, 4)], "entry_id string, y_center long, x_center long")
    boxes = patches.boxes(centres, 2)
    assert patches.cut(df, boxes, 2).count() == 16
    assert patches.cut(df, boxes, 2, whole_only=False).count() == 16 + 12
    scored = patches.score(patches.cut(df, boxes, 2), ["v"], 4, lambda c: c[:, 0] * 0.5)
    assert {r["p"] for r in scored.collect()} == {0.5} and scored.count() == 16


def test_derived_parameters():
    p = patches.parameters(128, 64, 10.0, 50.0, export_patches=True)
    assert p == {"stride_val": 64, "stride_infer": 32, "cube_buffer": 1330.0, "min_coverage": 0.0, "max_cloud_p": 1.0}
    p = patches.parameters(128, 64, 10.0, 50.0, export_patches=False)
    assert (p["stride_val"], p["stride_infer"]) == (128, 64)
    manual = patches.parameters(128, 64, 10.0, 50.0, False, automated_selection=False, min_coverage=0.9)
    assert manual["min_coverage"] == 0.0
    with pytest.raises(ValueError):
        patches.parameters(128, 120, 10.0, 50.0, export_patches=False)
    with pytest.raises(ValueError):
        patches.parameters(128, 64, 10.0, 50.0, True, max_cloud_p=0.3)


def test_only_one_scaling():
    pixels.check_one_scaling(True, False)
    with pytest.raises(ValueError):
        pixels.check_one_scaling(True, True)


def test_channel_order():
    assert pixels.channel_order(["R", "G"], ["NDVI"], True, ["slope"], True, True) == ["R", "G", "NDVI", "dem", "slope", "dhdt", "v"]


def test_mean_fill_divides_by_all_cells_unless_corrected(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", None)], "entry_id string, v double")
    filled = pixels.fill_with_mean(df, ["entry_id"], ["v"]).agg(F.min("v")).first()[0]
    assert filled == 2.0
    assert sorted(r["v"] for r in pixels.fill_with_mean(df, ["entry_id"], ["v"], bias_corrected=True).collect()) == [2.0, 3.0, 4.0]


# --- evaluation and calibration ----------------------------------------------------------------

def test_truth_splits_into_hits_and_misses(spark):
    rng = np.random.default_rng(0)
    df = grid(spark, rng.random((30, 30)))
    truth, pred = F.col("v") > 0.4, F.col("v") > 0.6
    r = evaluate.confusion_areas(df, truth, F.lit(False), truth, pred, 10.0).first()
    assert r["TP"] + r["FN"] == pytest.approx(r["P"]) and r["FPR"] is None


def test_empty_mask_gives_missing_metrics(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("b", 0.2, 0)], "k string, p double, y int")
    out = dict(rows(evaluate.sample_metrics(df, ["k"], F.col("p"), F.col("y"), F.col("k") == "b"), "k", "accuracy"))
    assert out == {"a": None, "b": 1.0}


def test_missing_predictions_are_negative(spark):
    df = grid(spark, [[1.0, 0.0], [1.0, 0.0]]).withColumn("p", F.when(F.col("y") == 0, F.col("v")))
    yes = F.lit(True)
    r = evaluate.confusion_areas(df, F.col("v") == 1, F.lit(False), yes, F.col("p") >= 0.5, 1000.0).first()
    assert (r["P"], r["TP"], r["FN"]) == (2.0, 1.0, 1.0)
    m = evaluate.sample_metrics(df, ["entry_id"], F.col("p"), F.col("v"), yes).first()
    assert m["recall"] == 0.5 and m["accuracy"] == 0.75
    s = thresholds.sweep_iou(df, ["entry_id"], F.col("v") == 1, F.col("p"), (0.0, 1.0, 0.5)).where("thr_1 = 0.5").first()
    assert (s["tp"], s["fp"], s["fn"], s["tn"]) == (1, 0, 1, 2)
    b = thresholds.area_bounds(df, ["entry_id"], F.col("p"), F.lit(0.0), F.col("v") == 1, 1000.0).where("thr = 0.5").first()
    assert (b["area_pred"], b["area_true"], b["area_lb"], b["area_ub"]) == (1.0, 2.0, 1.0, 1.0)


def test_missing_flags_and_bands(spark):
    df = spark.createDataFrame([(None, 1, 5.0, None), (1, None, 5.0, 2.0)], "cloud int, clear int, r double, swir double")
    got = df.select(spectral.flag_mask(["cloud", "~clear"]).alias("m"), spectral.band_ratio(F.col("r"), F.col("swir")).alias("q")).collect()
    assert [tuple(x) for x in got] == [(False, None), (True, 2.5)]


def test_sweep_equals_direct_counts(spark):
    rng = random.Random(3)
    data = [("a" if i % 3 else "b", rng.randrange(-5, 40) / 10, rng.randrange(0, 60) * 1.0, rng.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame(data, "k string, u double, w double, t boolean")
    out = thresholds.sweep_iou(df, ["k"], F.col("t"), F.col("u"), (0.0, 3.0, 0.5), F.col("w"), (0.0, 50.0, 10.0)).collect()
    assert len(out) == 2 * 7 * 6
    for r in out:
        hit = [(u >= r["thr_1"] and w >= r["thr_2"], t) for k, u, w, t in data if k == r["k"]]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (
            sum(h and t for h, t in hit), sum(h and not t for h, t in hit), sum(t and not h for h, t in hit), sum(not h and not t for h, t in hit))


def test_best_temperature_recovers_the_scale(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-z))
    data = [(m, float(1 / (1 + np.exp(-z[i] * m))), int(y[i])) for m in (1, 2) for i in range(4000)]
    out = {r["m"]: r["best_t"] for r in calibrate.best_temperature(spark.createDataFrame(data, "m int, p double, y int"), "m", "p", "y").collect()}
    assert out[1] == pytest.approx(1.0, abs=0.1) and out[2] == pytest.approx(2 * out[1], abs=0.01)


def test_zero_confidence_is_in_no_bin(spark):
    df = spark.createDataFrame([(0.0, True), (0.25, True), (0.26, False)], "c double, ok boolean")
    assert rows(calibrate.reliability_bins(df, [], F.col("c"), F.col("ok"), 4), "bin", "n") == [(1, 1), (2, 1)]


def test_half_entropy_is_not_in_bits(spark):
    v = spark.range(1).select(probability.half_entropy(F.lit(0.5))).first()[0]
    assert v == pytest.approx(math.log(2) / 2)


def test_incomplete_members(spark):
    schema = "entry_id string, y int, x int, seed int, p double"
    missing = [("a", 0, 0, 1, 0.2), ("a", 0, 0, 2, 0.8), ("b", 0, 0, 1, 0.2)]
    with pytest.raises(ValueError, match="b"):
        ensemble.aggregate_members(spark.createDataFrame(missing, schema), [1, 2])
    gap = spark.createDataFrame([*missing, ("b", 0, 0, 2, None)], schema)
    out = {r["entry_id"]: r for r in ensemble.aggregate_members(gap, [1, 2]).collect()}
    assert out["a"]["pred_std"] == pytest.approx(0.3) and out["a"]["pred_all"] == [0.2, 0.8]
    assert out["b"]["pred"] is None and out["b"]["pred_b"] is None and out["b"]["pred_all"] == [0.2, None]


def test_a_seed_that_occurs_twice_is_an_error(spark):
    df = spark.createDataFrame([("a", 0, 0, s, 0.2) for s in (1, 1, 2)], "entry_id string, y int, x int, seed int, p double")
    with pytest.raises(Exception, match="twice"):
        ensemble.aggregate_members(df, [1, 2]).collect()


def test_metres_are_not_taken_for_degrees(spark):
    corners = [(0.0, 5100000.0), (100.0, 5100000.0), (100.0, 5100100.0), (0.0, 5100100.0)]
    df = spark.createDataFrame([("a", [corners])], "entry_id string, rings array<array<struct<x:double,y:double>>>")
    with pytest.raises(ValueError, match="degrees"):
        inventory.with_auxiliary_columns(df)


def test_an_interrupted_first_run_is_repeated(spark, tmp_path):
    path = str(tmp_path / "partials")
    (tmp_path / "partials").mkdir()
    (tmp_path / "partials" / "part-0.parquet").write_bytes(b"half a file")
    assert readers.read_or_compute(spark, path, lambda: spark.range(3)).count() == 3
    assert readers.read_or_compute(spark, path, lambda: spark.range(0)).count() == 3


def test_a_sweep_compares_with_the_thresholds_themselves(spark):
    sweep = (0.0, 1.0, 0.1)
    values = [k * 0.1 + d for k in range(-1, 13) for d in (-1e-12, 0.0, 1e-12)] + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", thresholds.last_passed(F.col("v"), sweep).alias("i"))
    for r in df.collect():
        passed = [i for i in range(11) if r.v is not None and r.v >= 0.0 + i * 0.1]
        assert r.i == (max(passed) if passed else -1), r


def test_a_distance_beyond_the_limit_is_null(spark):
    seeds = [("a", 0, 0)] + [("b", y, x) for y in range(12) for x in range(12)]
    df = spark.createDataFrame(seeds, "entry_id string, y int, x int")
    cells = spark.createDataFrame([(e, y, x) for e in "ab" for y in range(-30, 40) for x in range(-30, 40)], "entry_id string, y int, x int")
    free = {r[0]: r[1] for r in buffers.equal_area_distance(df, df.where("false"), ["entry_id"], 0.0, 5.0, 10.0, cells, limit=400.0).collect()}
    tight = {r[0]: r[1] for r in buffers.equal_area_distance(df, df.where("false"), ["entry_id"], 0.0, 5.0, 10.0, cells, limit=15.0).collect()}
    assert free["a"] == tight["a"] and free["b"] > 15.0 and tight["b"] is None


def test_deviation_columns_follow_their_column(spark):
    df = spark.createDataFrame([(1.0, 0.5, 2.5, 0.9, 0.8, 1.0)], "area_pred double, area_pred_low double, area_pred_high double, recall double, recall_low double, recall_high double")
    out = ensemble.deviation_from_bounds(df)
    assert out.columns[:2] == ["area_pred", "area_pred_std"] and out.first()["area_pred_std"] == 1.0
    assert out.first()["recall_std"] == pytest.approx(0.1)


# --- change rates ------------------------------------------------------------------------------

def test_class_labels():
    assert change.class_labels([0.1, 0.2, 1]) == ["[0.01, 0.1)", "[0.1, 0.2)", "[0.2, 1)", ">= 1"]


def epoch(spark, data):
    return spark.createDataFrame(data, "entry_id int, area_inv double, recall double, area_pred double, area_pred_std double, year int")


def test_epochs_must_match(spark):
    a = epoch(spark, [(1, 1.0, 1.0, 1.0, 0.1, 2015)])
    b = epoch(spark, [(2, 1.0, 1.0, 1.0, 0.1, 2023)])
    with pytest.raises(ValueError):
        change.change_rates(a, b)


def test_extrapolation_follows_the_class_line(spark):
    inv = spark.createDataFrame([(i, 0.05 + 0.01 * i, 2015) for i in range(30)], "entry_id int, area_inv double, year_inv int")
    seen = inv.where("entry_id between 6 and 25").withColumn("rate", -0.02 * F.col("area_inv") - 0.001)
    a = seen.select("entry_id", "area_inv", F.lit(0.95).alias("recall"), F.col("area_inv").alias("area_pred"), F.lit(1e-4).alias("area_pred_std"), F.lit(2015).alias("year"))
    b = seen.select("entry_id", "area_inv", F.lit(0.95).alias("recall"), (F.col("area_inv") + 8 * F.col("rate")).alias("area_pred"), F.lit(1e-4).alias("area_pred_std"), F.lit(2023).alias("year"))
    rates = change.mark_noisy(change.change_rates(a, b), 1, 0.9)
    full = change.for_inventory(rates, inv)
    out = change.extrapolate(full).orderBy("entry_id").collect()
    assert len(out) == 30
    for r in out:
        if r["area_inv"] < 0.2 or r["area_rate_orig"] is not None:
            assert r["area_rate"] == pytest.approx(-0.02 * r["area_inv"] - 0.001)
    poly = change.extrapolate(full, "2d-polynomial")
    assert change.fit_quality(poly).first()["r2"] > 0.95
    with pytest.raises(ValueError):
        change.extrapolate(full, "cubic")


# --- catalogue and functions -------------------------------------------------------------------

def test_later_scene_wins_where_it_is_valid(spark):
    df = spark.createDataFrame([("a", 1, 0, 0, 1.0, 1), ("a", 1, 0, 0, None, 2), ("a", 1, 0, 1, 1.0, 1), ("a", 1, 0, 1, 5.0, 2)],
                               "entry_id string, date int, y int, x int, v double, `order` int")
    assert rows(catalogue.mosaic_cells(df, ["v"]), "x", "v") == [(0, 1.0), (1, 5.0)]


def test_lower_source_wins_in_merges(spark):
    df = spark.createDataFrame([(0, 0, None, 1), (0, 0, 3.0, 2), (0, 0, 4.0, 3)], "y int, x int, v double, o int")
    assert neighbours.merge_sources(df, "v", "o").first()["v"] == 3.0


def test_zero_denominator_counts_as_one(spark):
    assert spark.range(1).select(spectral.ndsi(F.lit(0.0), F.lit(0.0))).first()[0] == 0.0


def test_entry_function_errors(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0)], "entry_id int, v double")
    schema = T.StructType([T.StructField("inv", T.DoubleType())])

    def invert(entry_id, v):
        return {"inv": 1 / v}

    out = {r["entry_id"]: r for r in map_entries(df, invert, schema, continue_on_error=True).collect()}
    assert out[1]["inv"] == 0.5 and out[1]["error"] is None
    assert out[2]["inv"] is None and out[2]["error"].startswith("ZeroDivisionError")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        map_entries(df, invert, schema).collect()


def test_best_run_takes_the_last_of_equal_names(spark):
    runs = spark.createDataFrame([("g", "a-loss=0.5"), ("g", "b-loss=0.2"), ("g", "c-loss=0.2")], "grp string, name string")
    assert images.best_run(runs, ["grp"], "loss", "min").first()["name"] == "c-loss=0.2"
    with pytest.raises(ValueError):
        images.best_run(runs, ["grp"], "loss", "best")


def stub_session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_scratch_folder_comes_from_the_session():
    assert session.scratch_dir(stub_session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        session.scratch_dir(stub_session("yarn"))


def test_materialised_tables_have_no_lineage(spark):
    df = session.materialise(spark.range(3).withColumn("v", F.col("id") * 2))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert rows(df, "id", "v") == [(0, 0), (1, 2), (2, 4)] and "Range" not in plan and "FileScan parquet" in plan


def test_scan_pushes_filters_and_prunes_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cells = df.select(F.to_date("l_shipdate").alias("date"), "l_suppkey", "l_quantity").where("l_quantity > 40").select("l_suppkey")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_extendedprice" not in plan


def random_mask(seed, h, w, share):
    rng = random.Random(seed)
    return {(y, x) for y in range(h) for x in range(w) if rng.random() < share}


def walked_rings(cells):
    """Rings around a set of cells, walked with the cells on the left, as frozensets of unit steps."""
    steps = set()
    for y, x in cells:
        for there, a, b in (((y - 1, x), (y, x), (y, x + 1)), ((y, x + 1), (y, x + 1), (y + 1, x + 1)), ((y + 1, x), (y + 1, x + 1), (y + 1, x)), ((y, x - 1), (y + 1, x), (y, x))):
            if there not in cells:
                steps.add((a, b))

    def following(a, b):
        dy, dx = b[0] - a[0], b[1] - a[1]
        # to the left, straight on, to the right; y grows to the left of growing x
        return next((b, c) for c in ((b[0] + dx, b[1] - dy), (b[0] + dy, b[1] + dx), (b[0] - dx, b[1] + dy)) if (b, c) in steps)

    rings, left = [], set(steps)
    while left:
        ring, step = [], min(left)
        while step in left:
            left.remove(step)
            ring.append(step)
            step = following(*step)
        assert step == ring[0]
        rings.append(frozenset(ring))
    return rings


def test_rings_are_those_of_a_walk_and_holes_lie_in_their_part(spark):
    cells, expected = [], []
    for e, share in enumerate((0.3, 0.55, 0.8, 0.95, 1.0)):
        mask = random_mask(e, 14, 17, share)
        mask |= {(y, 30 + x) for y in range(9) for x in range(9) if not (1 <= y <= 7 and 1 <= x <= 7) or (2 <= y <= 6 and 2 <= x <= 6 and (y, x) != (4, 4))}
        cells += [(e, y, x, 1) for y, x in mask]
        expected += [(e, r) for r in walked_rings(mask)]
    found = materialise(outlines.segment_rings(materialise(spatial.segments(spark.createDataFrame(cells, "entry_id int, y int, x int, v int"), F.lit(True), 2.0)), 2.0)).collect()
    got, areas = [], {}
    for r in found:
        points = [(int(p.y / 2), int(p.x / 2)) for p in r.points]
        steps = []
        for (y1, x1), (y2, x2) in zip(points, points[1:] + points[:1]):
            dy, dx = (y2 > y1) - (y2 < y1), (x2 > x1) - (x2 < x1)
            assert (dy == 0) != (dx == 0)
            steps += [((y1 + k * dy, x1 + k * dx), (y1 + (k + 1) * dy, x1 + (k + 1) * dx)) for k in range(abs(y2 - y1) + abs(x2 - x1))]
        got.append((r.entry_id, frozenset(steps)))
        areas[r.ring] = r.area_km2
    assert sorted(map(hash, got)) == sorted(map(hash, expected)) and len(got) == len(set(got))
    by_ring = {r.ring: r for r in found}
    for r in found:
        outer = by_ring[r.part]
        assert outer.area_km2 > 0 and (r.area_km2 < 0 or r.part == r.ring)
        if r.area_km2 < 0:  # the cell left of the leftmost side of a hole lies inside its outer ring
            x, y = min((p.x, p.y) for p in r.points)
            ring = [(p.x, p.y) for p in outer.points]
            inside = sum((y1 > y + 1) != (y2 > y + 1) and x - 1 < x1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) % 2
            assert inside == 1 and outer.segment == r.segment
    assert sum(areas.values()) == pytest.approx(len(cells) * 4 / 1e6)


def test_rings_of_nothing(spark):
    none = spark.createDataFrame([], "entry_id int, segment int, y int, x int")
    assert outlines.segment_outlines(none, 10.0).count() == 0


def test_places_in_cycles_of_any_length(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 400)
    cycles, at = [], 0
    for n in (1, 2, 3, 64, 65, 200, 65):
        cycles.append(ids[at:at + n])
        at += n
    links = [(c[i], c[(i + 1) % len(c)]) for c in cycles for i in range(len(c))]
    found = {r.piece: (r.cycle, r.place) for r in outlines.ranked_cycles(spark.createDataFrame(links, "piece bigint, next bigint")).collect()}
    for c in cycles:
        k = c.index(min(c))
        assert [found[x] for x in c[k:] + c[:k]] == [(min(c), i) for i in range(len(c))]


def test_points_in_an_outline_of_many_vertices(spark):
    rng = random.Random(8)
    n = 20_000
    ring = [((600 + 300 * rng.random()) * math.cos(2 * math.pi * i / n), (600 + 300 * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    hole = [(-100.0, -100.0), (-100.0, 100.0), (100.0, 100.0), (100.0, -100.0)]
    square = [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)]
    o = outline_table(spark, [("star", [ring, hole]), ("square", [square])]).withColumnRenamed("entry_id", "name")
    points = [(i, rng.uniform(-950, 950), rng.uniform(-950, 950)) for i in range(300)] + [(300, 20.0, 20.0), (301, 700.0, ring[0][1]), (302, -99.0, 0.0)]
    found = spatial.points_in_outlines(spark.createDataFrame(points, "entry_id int, px double, py double"), o, ["name"]).where("name is not null")
    xy = [np.array(r) for r in (ring, hole)]

    def inside(px, py):
        crossings = 0
        for r in xy:
            (x1, y1), (x2, y2) = r.T, np.roll(r, -1, axis=0).T
            spans = (y1 > py) != (y2 > py)
            crossings += int((px < x1[spans] + (py - y1[spans]) * (x2 - x1)[spans] / (y2 - y1)[spans]).sum())
        return crossings % 2 == 1

    expected = [(i, "star") for i, x, y in points if inside(x, y)] + [(i, "square") for i, x, y in points if 0 <= x < 50 and 0 <= y < 50]
    assert sorted((r.entry_id, r["name"]) for r in found.collect()) == sorted(expected)


def test_close_pairs_of_outlines_with_parts(spark):
    def square(cx, cy, h):
        return [(cx - h, cy - h), (cx + h, cy - h), (cx + h, cy + h), (cx - h, cy + h)]

    o = outline_table(spark, [
        ("a", [square(1000, 0, 5), square(0, 0, 5)]), ("b", [square(0, 0, 100)]), ("c", [square(5000, 0, 100), square(5000, 0, 60)[::-1]]),
        ("d", [square(5000, 0, 20)]), ("e", [square(9000, 0, 1), square(5080, 0, 5)]),
    ])
    # d lies in the hole of c, e with one part inside its rim
    assert rows(spatial.close_pairs(o, 1.0), "a", "b") == [("a", "b"), ("c", "e")]


@pytest.mark.parametrize("limit", [10, 400_000])
def test_components_with_contraction_have_hubs_chains_and_structs(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "CONTRACTED", limit)
    rng = random.Random(limit)
    links = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(150)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    up = {}
    for a, b in links:
        up.setdefault(a, {a}), up.setdefault(b, {b})
        if up[a] is not up[b]:
            up[a] |= up[b]
            for v in up[b]:
                up[v] = up[a]
    vertex = lambda c: F.struct((F.col(c) % 7).alias("k"), F.col(c).alias("v"))
    edges = spark.createDataFrame(links, "a bigint, b bigint").repartition(3)
    vertices = spark.createDataFrame([(v,) for v in [*up, 9999]], "v bigint")
    found = components.connected_components(edges, vertices, contract=True)
    assert {r.v: r.component for r in found.collect()} == {v: min(s) for v, s in up.items()} | {9999: 9999}
    structs = components.connected_components(edges.select(vertex("a").alias("a"), vertex("b").alias("b")), vertices.select(vertex("v").alias("v")), contract=True)
    assert {r.v.v: (r.component.k, r.component.v) for r in structs.collect()} == {v: min((x % 7, x) for x in s) for v, s in up.items()} | {9999: (9999 % 7, 9999)}


@pytest.mark.parametrize("reach", [1, 4, 30])
def test_distances_equal_those_to_all_seeds(spark, reach):
    """Crowded, far and equal seeds of several outlines; ties go to the lower id, at negative places too."""
    rng = random.Random(reach)
    seeds = {(e, rng.choice([3, 1, 2]), rng.randrange(-9, 25), rng.randrange(-9, 25)) for e in (0, 1) for _ in range(25)} | {(2, i, 0, 0) for i in (5, 4)}
    df = spark.createDataFrame(list(seeds), "entry_id int, id int, y int, x int")
    for per_id in (False, True):
        expected = {}
        for e, i, sy, sx in seeds:
            for y in range(sy - reach, sy + reach + 1):
                for x in range(sx - reach, sx + reach + 1):
                    d2 = (y - sy) ** 2 + (x - sx) ** 2
                    if d2 <= reach * reach:
                        key = (e, i, y, x) if per_id else (e, y, x)
                        expected[key] = min(expected.get(key, (1 << 40, 0)), (d2, i))
        found = buffers.distances(df, reach, ["entry_id"], per_id)
        assert dict(found.dtypes) == {"entry_id": "int", "y": "int", "x": "int", "d2": "bigint", "id": "int"}
        got = {((r.entry_id, r.id, r.y, r.x) if per_id else (r.entry_id, r.y, r.x)): (r.d2, r.id) for r in found.collect()}
        assert got == expected and found.count() == len(expected)


def test_write_missing_goes_on_after_a_failed_round(spark, tmp_path):
    path = str(tmp_path / "out")
    inputs = spark.createDataFrame([(i,) for i in range(20)] + [(None,)], "entry_id bigint")
    calls = []

    def compute(todo):
        calls.append(sorted((r[0] for r in todo.collect()), key=lambda v: (v is None, v)))
        if len(calls) == 3:
            raise RuntimeError("killed")
        return todo.where("entry_id IS NULL OR entry_id <> 4").select("entry_id", F.lit(len(calls)).alias("run_no"))

    with pytest.raises(RuntimeError, match="killed"):
        writers.write_missing(inputs, path, compute, rounds=4)
    first, lost = calls[0] + calls[1], calls[2]
    rows = writers.write_missing(inputs, path, compute, rounds=4).collect()
    # every entry is there once, NULL too; the one without rows is missing, and only the lost and open rounds ran again
    assert sorted((r.entry_id for r in rows), key=lambda v: (v is None, v)) == [*[i for i in range(20) if i != 4], None]
    again = [e for c in calls[3:] for e in c]
    assert set(lost) <= set(again) and not set(first) & set(again)
    seen = len(calls)
    assert writers.write_missing(inputs, path, compute, rounds=4).count() == 20 and len(calls) == seen
    nothing = writers.write_missing(inputs.limit(0), str(tmp_path / "none"), lambda t: t.withColumn("v", F.lit(1)))
    assert nothing.columns == ["entry_id", "v"] and nothing.count() == 0


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (9, 23), (200, 131)])
def test_grid_centres_equal_a_plain_grid(spark, size):
    nx, ny = size
    def axis(n):
        return [*range(4, n - 4, 3), n - 4]
    got = patches.grid_centres(spark.createDataFrame([(1, nx, ny)], "entry_id bigint, nx bigint, ny bigint"), 4, 3)
    assert sorted((r.y_center, r.x_center) for r in got.collect()) == sorted((y, x) for y in axis(ny) for x in axis(nx))


def test_grid_rows_come_from_several_tasks(spark):
    rows = inventory.grid_rows(
        spark.createDataFrame([(1, 0, 4999), (2, 3, 2), (3, -1, -1)], "entry_id bigint, lo bigint, hi bigint"), ["entry_id"], F.col("lo"), F.col("hi"), "y")
    got = rows.select("entry_id", "y", F.spark_partition_id().alias("p")).collect()
    assert sorted((r.entry_id, r.y) for r in got) == [(1, y) for y in range(5000)] + [(3, -1)]
    assert len({r.p for r in got}) > 1


def test_one_scaling_at_most(spark):
    cells = spark.createDataFrame([(1, 2.0), (1, 4.0)], "entry_id bigint, b double")
    stats = spark.createDataFrame([("b", 3.0, 1.0, 2.0, 4.0)], "var_name string, mu double, stddev double, vmin double, vmax double")
    assert [r.b for r in pixels.scale_bands(cells, stats, ["b"], False, False).orderBy("b").collect()] == [2.0, 4.0]
    assert [r.b for r in pixels.scale_bands(cells, stats, ["b"], True, False).orderBy("b").collect()] == [-1.0, 1.0]
    assert [r.b for r in pixels.scale_bands(cells, stats, ["b"], False, True).orderBy("b").collect()] == [0.0, 1.0]
    with pytest.raises(ValueError):
        pixels.scale_bands(cells, stats, ["b"], True, True)
