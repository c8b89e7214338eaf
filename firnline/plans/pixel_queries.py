"""Cell-algebra, normalisation, feature and patch queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from firnline.functions import spectral
from firnline.operators import folds, inventory, patches, pixels
from firnline.plans import fixtures as fx
from firnline.plans.registry import query, rounded

CELL = ["entry_id", "y", "x"]
BANDS = ["b", "g", "r", "swir"]


@query("p7_band_subset", "P7 S4", "px", 'select entry_id, y, x, b as "B", r as "R" from px')
def band_subset(spark, sf):
    return pixels.select_bands(fx.px(spark, sf), {"b": "B", "r": "R"})


@query("p8_flag_mask", "P8", "px", """
select entry_id, y, x, (b < 4500 or not (g >= 4600) or swir < 4200) as mask_nok from px""")
def flag_mask(spark, sf):
    flags = fx.px(spark, sf).select(
        *CELL, (F.col("b") < 4500).cast("int").alias("cloud"), (F.col("g") >= 4600).cast("int").alias("clear"),
        (F.col("swir") < 4200).cast("int").alias("shadow"))
    return flags.select(*CELL, spectral.flag_mask(["cloud", "~clear", "shadow"]).alias("mask_nok"))


@query("p9_cloud_binarised", "P9 P10", "px", """
select entry_id, y, x, ((1 - b / 10000) * 100 > 50 or r < 4000) as cloud_mask from px""")
def cloud_binarised(spark, sf):
    percent = spectral.clear_score_to_cloud(F.col("b") / 10000)
    return fx.px(spark, sf).select(*CELL, spectral.cloud_mask(percent, 0.5, F.col("r") < 4000).alias("cloud_mask"))


@query("p13_keep_by_mask", "P13", "px", """
select entry_id, y, x, case when swir >= 4200 then b end as b, case when swir >= 4200 then g end as g from px""")
def keep_by_mask(spark, sf):
    return pixels.keep_where(fx.px(spark, sf), F.col("swir") >= 4200, ["b", "g"]).select(*CELL, "b", "g")


@query("p14_region_restriction", "P14", "px", """
select entry_id, y, x, case when b + g >= 10000 or g >= 5500 then r / greatest(swir, 1) >= 1 else false end as pred_b from px""")
def region_restriction(spark, sf):
    c = fx.px(spark, sf).withColumn("pred_b", spectral.band_ratio(F.col("r"), F.col("swir")) >= 1)
    return pixels.restrict_to_roi(c, "pred_b", F.col("b") + F.col("g") >= 10000, F.col("g") >= 5500).select(*CELL, "pred_b")


@query("p15_other_outlines", "P15", "px", """
select entry_id, y, x, ((b >= 5000) <> (b + g >= 10000)) as mask_other from px""")
def other_outlines(spark, sf):
    return fx.px(spark, sf).select(
        *CELL, pixels.other_outline(F.col("b") >= 5000, F.col("b") + F.col("g") >= 10000).alias("mask_other"))


@query("p21_band_ratio_class", "P21", "px", """
select entry_id, y, x, round(r / greatest(swir, 1), 6) as ratio, (r / greatest(swir, 1) >= 1.05 and b >= 4800) as pred_b from px""")
def band_ratio_class(spark, sf):
    r, s, b = F.col("r"), F.col("swir"), F.col("b")
    return rounded(fx.px(spark, sf).select(
        *CELL, spectral.band_ratio(r, s).alias("ratio"), spectral.band_ratio_class(r, s, b, 1.05, 4800).alias("pred_b")))


@query("x4_indices", "X4", "px", """
with z as (select *, case when y % 7 = 0 then cast(0 as double) else g end as g0, case when y % 7 = 0 then cast(0 as double) else swir end as s0 from px)
select entry_id, y, x, (g0 - s0) / (case when g0 + s0 = 0 then 1 else g0 + s0 end) as ndsi,
 (b - r) / (case when b + r = 0 then 1 else b + r end) as ndvi,
 (g0 - b) / (case when g0 + b = 0 then 1 else g0 + b end) as ndwi from z""")
def indices(spark, sf):
    zero = F.col("y") % 7 == 0
    g = F.when(zero, F.lit(0.0)).otherwise(F.col("g"))
    s = F.when(zero, F.lit(0.0)).otherwise(F.col("swir"))
    return fx.px(spark, sf).select(
        *CELL, spectral.ndsi(g, s).alias("ndsi"), spectral.ndvi(F.col("b"), F.col("r")).alias("ndvi"),
        spectral.ndwi(g, F.col("b")).alias("ndwi"))


@query("x5_terrain_inputs", "X5", "px", """
select entry_id, y, x, round((b % 90) / 90, 6) as slope, round(sin(radians(g % 360)), 6) as aspect_sin,
  round(cos(radians(g % 360)), 6) as aspect_cos from px""")
def terrain_inputs(spark, sf):
    t = pixels.terrain_inputs(F.col("b") % 90, F.col("g") % 360)
    return rounded(fx.px(spark, sf).select(*CELL, *[c.alias(n) for n, c in t.items()]))


def _gappy(spark, sf):
    return fx.px(spark, sf).select(
        *CELL, F.when(F.col("r") >= 4500, F.col("b")).alias("b"), F.when(F.col("g") >= 4400, F.col("g")).alias("g"),
        F.when(F.col("b") >= 4300, F.col("dem")).alias("dem"), F.when(F.col("b") >= 5000, F.col("r")).alias("dhdt"),
        (F.col("swir") < 4200).alias("mask_nok"))


GAPPY_SQL = """
with c as (select entry_id, y, x, case when r >= 4500 then b end as b, case when g >= 4400 then g end as g,
  case when b >= 4300 then dem end as dem, case when b >= 5000 then r end as dhdt, swir < 4200 as mask_nok from px)
"""


@query("x6_null_filling", "X6", "px", GAPPY_SQL + """
, m as (select entry_id, sum(b) / count(*) mb, sum(g) / count(*) mg, avg(dem) md from c group by entry_id)
select entry_id, y, x, round(coalesce(b, mb), 6) as b, round(coalesce(g, mg), 6) as g, round(coalesce(dem, md), 6) as dem,
  coalesce(dhdt, 0) as dhdt, (mask_nok or b is null or g is null) as mask_nok from c join m using (entry_id)""")
def null_filling(spark, sf):
    c = pixels.fill_with_mean(_gappy(spark, sf), ["entry_id"], ["b", "g"], mask="mask_nok")
    c = pixels.fill_with_mean(c, ["entry_id"], ["dem"], bias_corrected=True)
    return rounded(pixels.fill_with_constant(c, ["dhdt"]).select(*CELL, "b", "g", "dem", "dhdt", "mask_nok"))


PARTIAL_SQL = """
with u as (select entry_id, y, x, 'b' as var_name, b as v from px union all select entry_id, y, x, 'g', g from px
  union all select entry_id, y, x, 'r', r from px union all select entry_id, y, x, 'swir', swir from px),
p as (select entry_id, var_name, count(v) as n, sum(v) as sum_1, sum(v * v) as sum_2, min(v) as vmin, max(v) as vmax from u group by entry_id, var_name),
st as (select var_name, sum(sum_1) / sum(n) as mu, sqrt((sum(sum_2) - sum(sum_1) * sum(sum_1) / sum(n)) / sum(n)) as stddev,
  quantile_cont(vmin, 0.01) as vmin, quantile_cont(vmax, 0.99) as vmax from p group by var_name)
"""


def _partials(spark, sf):
    return pixels.norm_partials(fx.px(spark, sf), ["entry_id"], BANDS)


@query("a1_norm_partials", "A1", "px", PARTIAL_SQL + "select * from p")
def norm_partials(spark, sf):
    return _partials(spark, sf)


@query("a2_norm_stats", "A2", "px", PARTIAL_SQL + """
select var_name, round(mu, 6) as mu, round(stddev, 6) as stddev, round(vmin, 6) as vmin, round(vmax, 6) as vmax from st""")
def norm_stats(spark, sf):
    return rounded(pixels.merge_norm_stats(_partials(spark, sf)))


LINE_SQL = """
with l as (select l_suppkey as entry_id, l_linenumber as file_no, l_quantity, l_extendedprice, l_discount, l_tax from lineitem),
u as (select entry_id, file_no, 'l_quantity' as var_name, l_quantity as v from l union all select entry_id, file_no, 'l_extendedprice', l_extendedprice from l
  union all select entry_id, file_no, 'l_discount', l_discount from l union all select entry_id, file_no, 'l_tax', l_tax from l),
p as (select entry_id, file_no, var_name, count(v) as n, sum(v) as sum_1, sum(v * v) as sum_2, min(v) as vmin, max(v) as vmax from u group by all)
select var_name, round(sum(sum_1) / sum(n), 4) as mu, round(sqrt((sum(sum_2) - sum(sum_1) * sum(sum_1) / sum(n)) / sum(n)), 4) as stddev,
  round(quantile_cont(vmin, 0.01), 4) as vmin, round(quantile_cont(vmax, 0.99), 4) as vmax from p group by var_name
"""


@query("a2_norm_stats_large", "A1 A2", "", LINE_SQL)
def norm_stats_large(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entry_id"), F.col("l_linenumber").alias("file_no"), *columns)
    return rounded(pixels.merge_norm_stats(pixels.norm_partials(li, ["entry_id", "file_no"], columns)), 4)


@query("a3_training_stats", "A3 J5", "px inv", """
with f as (select entry_id, bound_lim, sum(area_km2) over (order by bound_lim desc, entry_id) / sum(area_km2) over () as c
   from inv where entry_id in (select entry_id from px)),
t as (select entry_id from f where not (c >= 0.2 - 0.05 and c < 0.4 + 0.05)),
u as (select entry_id, 'b' as var_name, b as v from px union all select entry_id, 'swir', swir from px),
p as (select entry_id, var_name, count(v) as n, sum(v) as sum_1, sum(v * v) as sum_2, min(v) as vmin, max(v) as vmax
   from u where entry_id in (select entry_id from t) group by entry_id, var_name)
select var_name, round(sum(sum_1) / sum(n), 6) as mu, round(sqrt((sum(sum_2) - sum(sum_1) * sum(sum_1) / sum(n)) / sum(n)), 6) as stddev,
  round(quantile_cont(vmin, 0.01), 6) as vmin, round(quantile_cont(vmax, 0.99), 6) as vmax from p group by var_name""")
def training_stats(spark, sf):
    # the raster has ten entries, so the inventory is reduced to the same keys
    keys = fx.px(spark, sf).select("entry_id").distinct()
    split = folds.assign_folds(fx.inv(spark, sf).join(keys, "entry_id", "left_semi"), 5, 2, 0.1)
    p = pixels.norm_partials(fx.px(spark, sf), ["entry_id"], ["b", "swir"])
    return rounded(pixels.merge_norm_stats(pixels.training_only(p, split)))


@query("x7_standardised", "X7", "px", PARTIAL_SQL + """
select entry_id, y, x, round((b - (select mu from st where var_name = 'b')) / (select stddev from st where var_name = 'b'), 6) as b,
  round((g - (select mu from st where var_name = 'g')) / (select stddev from st where var_name = 'g'), 6) as g from px""")
def standardised(spark, sf):
    stats = pixels.merge_norm_stats(_partials(spark, sf))
    return rounded(pixels.standardise(fx.px(spark, sf), stats, ["b", "g"]).select(*CELL, "b", "g"))


@query("x7_standardised_shared", "X7", "px", PARTIAL_SQL + """
, s as (select avg(mu) as mu, avg(stddev) as stddev from st where var_name in ('b', 'g', 'r'))
select entry_id, y, x, round((b - mu) / stddev, 6) as b, round((g - mu) / stddev, 6) as g, round((r - mu) / stddev, 6) as r from px, s""")
def standardised_shared(spark, sf):
    stats = pixels.merge_norm_stats(_partials(spark, sf))
    return rounded(pixels.standardise(fx.px(spark, sf), stats, ["b", "g", "r"], per_band=False).select(*CELL, "b", "g", "r"))


@query("x8_minmax_scaled", "X8", "px", PARTIAL_SQL + """
, o as (select max(case when var_name = 'b' then vmin end) b0, max(case when var_name = 'b' then vmax end) b1,
   max(case when var_name = 'r' then vmin end) r0, max(case when var_name = 'r' then vmax end) r1 from st)
select entry_id, y, x, round((least(greatest(b, b0), b1) - least(b0, r0)) / (greatest(b1, r1) - least(b0, r0)), 6) as b,
  round((least(greatest(r, r0), r1) - least(b0, r0)) / (greatest(b1, r1) - least(b0, r0)), 6) as r from px, o""")
def minmax_scaled(spark, sf):
    stats = pixels.merge_norm_stats(_partials(spark, sf))
    return rounded(pixels.minmax_scale(fx.px(spark, sf), stats, ["b", "r"], per_band=False).select(*CELL, "b", "r"))


@query("x8_minmax_per_band", "X8", "px", PARTIAL_SQL + """
, o as (select max(case when var_name = 'b' then vmin end) b0, max(case when var_name = 'b' then vmax end) b1,
   max(case when var_name = 'r' then vmin end) r0, max(case when var_name = 'r' then vmax end) r1 from st)
select entry_id, y, x, round((least(greatest(b, b0), b1) - b0) / (b1 - b0), 6) as b,
  round((least(greatest(r, r0), r1) - r0) / (r1 - r0), 6) as r from px, o""")
def minmax_per_band(spark, sf):
    stats = pixels.merge_norm_stats(_partials(spark, sf))
    return rounded(pixels.minmax_scale(fx.px(spark, sf), stats, ["b", "r"]).select(*CELL, "b", "r"))


@query("a44_contrast_stretch", "A44", "px", """
with q as (select entry_id, quantile_cont(b, 0.025) b0, quantile_cont(b, 0.975) b1, quantile_cont(g, 0.025) g0, quantile_cont(g, 0.975) g1 from px group by entry_id)
select entry_id, y, x, round((least(greatest(b, b0), b1) - b0) / (b1 - b0), 6) as b, round((least(greatest(g, g0), g1) - g0) / (g1 - g0), 6) as g
from px join q using (entry_id)""")
def contrast_stretch(spark, sf):
    return rounded(pixels.contrast_stretch(fx.px(spark, sf), ["entry_id"], ["b", "g"]).select(*CELL, "b", "g"))


@query("w10_every_tenth_cell", "W10", "px", """
select entry_id, y, x, b from (select *, row_number() over (partition by entry_id order by y, x) as rn from px where swir >= 4200) t
where (rn - 1) % 10 = 0""")
def every_tenth(spark, sf):
    return pixels.every_nth(fx.px(spark, sf).where(F.col("swir") >= 4200), 0.1).select(*CELL, "b")


@query("w10_large_raster_sample", "W10", "lpx", """
select entry_id, y, x, b from (select *, row_number() over (partition by entry_id order by y, x) as rn from lpx) t where (rn - 1) % 20 = 0""")
def large_raster_sample(spark, sf):
    return pixels.every_nth(fx.lpx(spark, sf), 0.05).select(*CELL, "b")


@query("x10_feature_rows", "X10 X5 X4", "px", """
select entry_id, y, x, r as "R", g as "G", b as "NIR", swir as "SWIR",
  round((g - swir) / (case when g + swir = 0 then 1 else g + swir end), 6) as "NDSI",
  round((b - r) / (case when b + r = 0 then 1 else b + r end), 6) as "NDVI", round((b % 90) / 90, 6) as slope,
  round(sin(radians(g % 360)), 6) as aspect_sin, round(cos(radians(g % 360)), 6) as aspect_cos, dem,
  swir < 4200 as mask_no_data, b + g >= 10000 as mask_crt_g, b >= 5000 as mask_all_g,
  (r >= 5200 and b + g >= 10000) as mask_debris_crt_g, (r >= 5200 and b >= 5000) as mask_debris_all_g from px""")
def feature_rows(spark, sf):
    f = pixels.feature_rows(
        fx.px(spark, sf), {"R": "r", "G": "g", "NIR": "b", "SWIR": "swir"}, ["NDSI", "NDVI"], F.col("swir") < 4200,
        F.col("b") + F.col("g") >= 10000, F.col("b") >= 5000, F.col("r") >= 5200,
        pixels.terrain_inputs(F.col("b") % 90, F.col("g") % 360), ["dem"])
    return rounded(f)


@query("d3_channel_stack", "D3", "px", """
select entry_id, y, x, r as c0, b as c1, round((g - swir) / (case when g + swir = 0 then 1 else g + swir end), 6) as c2, dem as c3, 4 as n_channels from px""")
def channel_stack(spark, sf):
    c = fx.px(spark, sf).withColumn("NDSI", spectral.ndsi(F.col("g"), F.col("swir")))
    order = pixels.channel_order(["r", "b"], ["NDSI"], dem=True)
    stack = c.select(*CELL, F.array(*order).alias("s"))
    return rounded(stack.select(*CELL, *[F.col("s")[i].alias(f"c{i}") for i in range(4)], F.size("s").alias("n_channels")))


RADIUS, STRIDE = 4, 3
MASK = "b + g >= 10000"


@query("w19_stride_centres", "W19", "px", """
select entry_id, y as y_center, x as x_center from px where b + g >= 10000 and x % 3 = 0 and y % 3 = 0""")
def stride_centres(spark, sf):
    return patches.stride_centres(fx.px(spark, sf), F.expr(MASK), STRIDE)


GRID_SQL = """
with e as (select entry_id, max(x) + 1 as nx, max(y) + 1 as ny from px group by entry_id),
c as (select entry_id, cast(xc as bigint) as x_center, cast(yc as bigint) as y_center from e,
   unnest(list_append(range(4, nx - 4, 3), nx - 4)) as a(xc), unnest(list_append(range(4, ny - 4, 3), ny - 4)) as b(yc))
"""


def _grid(spark, sf):
    e = fx.px(spark, sf).groupBy("entry_id").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"))
    return patches.boxes(patches.grid_centres(e, RADIUS, STRIDE), RADIUS)


@query("w19_grid_centres", "W19", "px", GRID_SQL + "select * from c")
def grid_centres(spark, sf):
    return _grid(spark, sf).select("entry_id", "x_center", "y_center")


@query("w20_extra_centres", "W20", "px", """
with m as (select entry_id, y, x from px where b + g >= 10000),
e as (select entry_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1, cast(floor(avg(x)) as bigint) mx, cast(floor(avg(y)) as bigint) my from m group by entry_id)
select e.entry_id, 'left' as kind, cast(floor(avg(y)) as bigint) as y_center, x0 as x_center from m join e on m.entry_id = e.entry_id and x = x0 group by e.entry_id, x0
union all select e.entry_id, 'right', cast(floor(avg(y)) as bigint), x1 from m join e on m.entry_id = e.entry_id and x = x1 group by e.entry_id, x1
union all select e.entry_id, 'top', y0, cast(floor(avg(x)) as bigint) from m join e on m.entry_id = e.entry_id and y = y0 group by e.entry_id, y0
union all select e.entry_id, 'bottom', y1, cast(floor(avg(x)) as bigint) from m join e on m.entry_id = e.entry_id and y = y1 group by e.entry_id, y1
union all select entry_id, 'centroid', my, mx from e
union all select entry_id, 'center', cast(floor((y0 + y1) / 2) as bigint), cast(floor((x0 + x1) / 2) as bigint) from e""")
def extra_centres(spark, sf):
    return patches.extra_centres(fx.px(spark, sf), F.expr(MASK), True, True, True)


@query("w21_patch_cells", "W21", "px", GRID_SQL + """
select c.entry_id, y_center, x_center, count(*) as n, sum(b) as total from c join px on c.entry_id = px.entry_id
  and x >= x_center - 4 and x < x_center + 4 and y >= y_center - 4 and y < y_center + 4
group by c.entry_id, y_center, x_center having count(*) = 64""")
def patch_cells(spark, sf):
    cut = patches.cut(fx.px(spark, sf), _grid(spark, sf), RADIUS)
    return cut.groupBy("entry_id", "y_center", "x_center").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("total"))


def logistic_scorer(cube: np.ndarray) -> np.ndarray:
    """Example scorer: logistic response of the first channel around its patch mean."""
    first = cube[:, 0]
    centred = first - first.mean(axis=(1, 2), keepdims=True)
    return 1.0 / (1.0 + np.exp(-centred / 500.0))


SCORED_SQL = GRID_SQL + """
, pc as (select c.entry_id, y_center, x_center, y, x, b from c join px on c.entry_id = px.entry_id
  and x >= x_center - 4 and x < x_center + 4 and y >= y_center - 4 and y < y_center + 4),
s as (select *, 1 / (1 + exp(-(b - avg(b) over (partition by entry_id, y_center, x_center)) / 500)) as p from pc)
"""


def scored_patches(spark, sf):
    cut = patches.cut(fx.px(spark, sf), _grid(spark, sf), RADIUS)
    return patches.score(cut, ["b"], 2 * RADIUS, logistic_scorer)


@query("d2_patch_scores", "D2", "px", SCORED_SQL + """
select entry_id, y_center, x_center, y, x, round(p, 6) as p from s""")
def patch_scores(spark, sf):
    return rounded(scored_patches(spark, sf))


@query("a38_patch_mosaic", "A38 D2", "px", SCORED_SQL + """
select entry_id, y, x, round(avg(p), 6) as pred from s where y - y_center >= -3 and y - y_center < 3 and x - x_center >= -3 and x - x_center < 3
group by entry_id, y, x""")
def patch_mosaic(spark, sf):
    return rounded(patches.mosaic(scored_patches(spark, sf), RADIUS, 0.125))


@query("w11_proportional_subsample", "W11", "px", """
with p as (select entry_id, y as y_center, x as x_center from px where b + g >= 10000 and x % 3 = 0 and y % 3 = 0),
n as (select entry_id, count(*) as n from p group by entry_id),
k as (select entry_id, n, cast(1 + round_even((n - 1) * ((200 - (select count(*) from n)) / ((select sum(n) from n) - (select count(*) from n))), 0) as bigint) as keep from n),
d as (select 200 - sum(keep) as d from k),
q as (select entry_id, keep + case when row_number() over (order by keep desc, entry_id) <= abs(d) then sign(d) else 0 end as keep from k, d),
o as (select *, row_number() over (partition by entry_id order by (y_center * 7919 + x_center * 104729) % 1009, y_center, x_center) as rn from p)
select entry_id, y_center, x_center from o join q using (entry_id) where rn <= keep""")
def proportional_subsample(spark, sf):
    c = patches.stride_centres(fx.px(spark, sf), F.expr(MASK), STRIDE)
    order = [(F.col("y_center") * 7919 + F.col("x_center") * 104729) % 1009, "y_center", "x_center"]
    return patches.subsample(c, 200, order)


@query("x11_augmented_patches", "X11", "px", """
with c as (select entry_id * 100000 + (y // 8) * 10 + x // 8 as patch_id, y % 8 as py, x % 8 as px_, b from px),
d as (select *, patch_id * 31 % 14 as d from c)
select patch_id, case d when 0 then px_ when 1 then 7 - py when 2 then 7 - px_ when 3 then py when 4 then 7 - py when 5 then px_ when 6 then 7 - px_ else py end as py,
  case d when 0 then 7 - py when 1 then 7 - px_ when 2 then py when 3 then 7 - px_ when 4 then px_ when 5 then py when 6 then 7 - py else px_ end as px, b from d""")
def augmented(spark, sf):
    c = fx.px(spark, sf).select(
        (F.col("entry_id") * F.lit(100000).cast("bigint") + F.floor(F.col("y") / 8) * 10 + F.floor(F.col("x") / 8)).alias("patch_id"),
        (F.col("y") % 8).alias("py"), (F.col("x") % 8).alias("px"), "b")
    return patches.augment(c, 8, (F.col("patch_id") * 31) % 14)


@query("p11_cropped_padded", "P11", "px", """
with k as (select entry_id, min(y) - 2 y0, max(y) + 2 y1, min(x) - 2 x0, max(x) + 2 x1 from px where b + g >= 11000 group by entry_id),
grid as (select entry_id, yy as y, xx as x from k, unnest(range(y0, y1 + 1)) as a(yy), unnest(range(x0, x1 + 1)) as b(xx))
select grid.entry_id, grid.y, grid.x, px.b from grid left join px on px.entry_id = grid.entry_id and px.y = grid.y and px.x = grid.x""")
def cropped_padded(spark, sf):
    c = fx.px(spark, sf)
    extent = inventory.cell_extents(c.where(F.expr("b + g >= 11000")), 2)
    return inventory.crop(c, extent, pad=True).select(*CELL, "b")


@query("p11_cropped", "P11", "px", """
with k as (select entry_id, min(y) - 2 y0, max(y) + 2 y1, min(x) - 2 x0, max(x) + 2 x1 from px where b + g >= 11000 group by entry_id)
select px.entry_id, y, x, b from px join k using (entry_id) where y between y0 and y1 and x between x0 and x1""")
def cropped(spark, sf):
    c = fx.px(spark, sf)
    return inventory.crop(c, inventory.cell_extents(c.where(F.expr("b + g >= 11000")), 2)).select(*CELL, "b")
