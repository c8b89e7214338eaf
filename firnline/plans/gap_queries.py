"""Queries over incomplete, constant and malformed input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from firnline.functions import naming
from firnline.operators import catalogue, evaluate, images, inventory, patches, pixels, spatial
from firnline.plans import fixtures as fx
from firnline.plans.registry import query, rounded

CELL = ["entry_id", "y", "x"]


def _constant(spark, sf):
    return fx.px(spark, sf).withColumn("k", F.lit(7.0))


def _stats(spark, sf):
    return pixels.merge_norm_stats(pixels.norm_partials(_constant(spark, sf), ["entry_id"], ["b", "k"]))


CONSTANT_SQL = """
with p as (select entry_id, count(b) as n, sum(b) as s1, sum(b * b) as s2, min(b) as lo, max(b) as hi from px group by entry_id),
st as (select sum(s1) / sum(n) as mu, sqrt((sum(s2) - sum(s1) * sum(s1) / sum(n)) / sum(n)) as sd, quantile_cont(lo, 0.01) as b0, quantile_cont(hi, 0.99) as b1 from p)
"""


@query("x7_constant_band", "X7 X9", "px", CONSTANT_SQL + """
select entry_id, y, x, round((b - mu) / sd, 6) as b, cast(null as double) as k from px, st""")
def standardised_constant(spark, sf):
    pixels.check_one_scaling(True, False)
    return rounded(pixels.standardise(_constant(spark, sf), _stats(spark, sf), ["b", "k"]).select(*CELL, "b", "k"))


@query("x8_constant_band", "X8 X9", "px", CONSTANT_SQL + """
select entry_id, y, x, round((least(greatest(b, b0), b1) - b0) / (b1 - b0), 6) as b, cast(null as double) as k from px, st""")
def scaled_constant(spark, sf):
    pixels.check_one_scaling(False, True)
    return rounded(pixels.minmax_scale(_constant(spark, sf), _stats(spark, sf), ["b", "k"]).select(*CELL, "b", "k"))


@query("x9_scaling_settings", "X9 X7 X8", "px", CONSTANT_SQL + """
select entry_id, false as standardised, false as minmax, false as refused, count(*) as n, round(avg(b), 6) as b from px, st group by entry_id
union all select entry_id, true, false, false, count(*), round(avg((b - mu) / sd), 6) from px, st group by entry_id
union all select entry_id, false, true, false, count(*), round(avg((least(greatest(b, b0), b1) - b0) / (b1 - b0)), 6) from px, st group by entry_id
union all select entry_id, true, true, true, count(*), cast(null as double) from px, st group by entry_id""")
def scaling_settings(spark, sf):
    """Every pair of settings over all cells; the pair that asks for both scalings is refused and gives no value."""
    cells, stats, rows = _constant(spark, sf), _stats(spark, sf), []
    for standardised, minmax in ((False, False), (True, False), (False, True), (True, True)):
        try:
            scaled, refused = pixels.scale_bands(cells, stats, ["b", "k"], standardised, minmax), False
        except ValueError:
            scaled, refused = cells.withColumn("b", F.lit(None).cast("double")), True
        rows.append(scaled.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.avg("b").alias("b")).select(
            "entry_id", F.lit(standardised).alias("standardised"), F.lit(minmax).alias("minmax"), F.lit(refused).alias("refused"), "n", "b"))
    return rounded(reduce(lambda a, b: a.unionByName(b), rows))


def _keyless(spark, sf):
    """Cells of which some belong to no entry, and one entry without any value."""
    c = fx.px(spark, sf)
    return c.select(
        F.when(F.col("entry_id") % 5 != 0, F.col("entry_id")).alias("entry_id"), "y", "x", F.col("entry_id").alias("source"),
        F.when(F.col("entry_id") % 5 != 1, F.col("b")).alias("b"), "g",
    )


KEYLESS_SQL = """
with c as (select case when entry_id % 5 <> 0 then entry_id end as entry_id, y, x, entry_id as source, case when entry_id % 5 <> 1 then b end as b, g from px),
"""


@query("x6_null_keys", "X6", "px", KEYLESS_SQL + """
m as (select entry_id, coalesce(sum(b), 0) / count(*) as m from c group by entry_id)
select c.entry_id, source, y, x, round(coalesce(b, m), 6) as b from c join m on c.entry_id is not distinct from m.entry_id""")
def filled_null_keys(spark, sf):
    return rounded(pixels.fill_with_mean(_keyless(spark, sf), ["entry_id"], ["b"]).select("entry_id", "source", "y", "x", "b"))


@query("a44_empty_band", "A44", "px", KEYLESS_SQL + """
q as (select entry_id, quantile_cont(b, 0.025) b0, quantile_cont(b, 0.975) b1, quantile_cont(g, 0.025) g0, quantile_cont(g, 0.975) g1 from c group by entry_id)
select c.entry_id, source, y, x, round((least(greatest(b, b0), b1) - b0) / (b1 - b0), 6) as b, round((least(greatest(g, g0), g1) - g0) / (g1 - g0), 6) as g
from c join q on c.entry_id is not distinct from q.entry_id""")
def stretched_empty_band(spark, sf):
    return rounded(pixels.contrast_stretch(_keyless(spark, sf), ["entry_id"], ["b", "g"]).select("entry_id", "source", "y", "x", "b", "g"))


@query("a14_null_keys", "A14", "px", KEYLESS_SQL + """
o as (select 1)
select entry_id, count(b) as count, round(avg(b), 4) as mean, round(stddev_samp(b), 4) as std, min(b) as min,
 round(quantile_cont(b, 0.25), 4) as q25, round(quantile_cont(b, 0.5), 4) as q50, round(quantile_cont(b, 0.75), 4) as q75, max(b) as max from c group by entry_id""")
def summary_null_keys(spark, sf):
    return rounded(evaluate.describe(_keyless(spark, sf), ["entry_id"], "b"), 4)


@query("w22_exponent_metric", "W22", "", """
with runs as (select o_custkey as grp, 'loss=' || case o_orderkey % 4 when 0 then '1e-05' when 1 then '2.5E+3' when 2 then '0.5' else 'none' end || '_' || o_orderkey as name,
  case o_orderkey % 4 when 0 then 1e-5 when 1 then 2500.0 when 2 then 0.5 end as loss from orders)
select grp, name, cast(loss as double) as loss from (select *, row_number() over (partition by grp order by loss, name desc) as rn from runs where loss is not null) where rn = 1""")
def exponent_metric(spark, sf):
    value = F.element_at(F.array(*map(F.lit, ("1e-05", "2.5E+3", "0.5", "none"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("loss="), value, F.lit("_"), F.col("o_orderkey").cast("string")).alias("name")
    return images.best_run(fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), name), ["grp"], "loss", "min")


@query("x17_short_paths", "X17 S3", "", """
select o_orderkey, case when o_orderkey % 3 = 0 then 'a' end as year, case when o_orderkey % 3 <> 1 then 'b' end as entry_id, 'c' || o_orderkey as file from orders""")
def short_paths(spark, sf):
    o = fx.table(spark, sf, "orders")
    name = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    path = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("a/b/"), name)).when(F.col("o_orderkey") % 3 == 1, name).otherwise(F.concat(F.lit("b/"), name))
    return o.select("o_orderkey", *[c.alias(n) for n, c in naming.path_parts(path).items()])


@query("s6_malformed_ids", "S6", "", """
select event_id, case when event_id % 3 <> 1 then cast(ts as date) end as date, case when event_id % 3 = 0 then 'p' end as processing_time,
  cast(null as varchar) as tile from events""")
def malformed_ids(spark, sf):
    day = F.date_format("ts", "yyyyMMdd")
    scene = F.when(F.col("event_id") % 3 == 0, F.concat(day, F.lit("_p"))).when(F.col("event_id") % 3 == 1, F.lit("no date")).otherwise(day)
    e = fx.table(spark, sf, "events").select("event_id", scene.alias("scene_id"), "ts")
    return catalogue.parse_scene_ids(e).select("event_id", "date", "processing_time", "tile")


@query("j14_missing_points", "J14", "poly", """
with c as (select c_custkey, case when c_custkey % 4 > 1 then c_acctbal / 4 end as px, (c_custkey % 100) * 31 as py from customer),
p as (select * from poly where entry_id % 7 <> 0)
select c_custkey, entry_id, round(distance, 6) as distance from (
  select c_custkey, case when px is not null then entry_id end as entry_id, sqrt(pow(px - cx, 2) + pow(py - cy, 2)) as distance,
    row_number() over (partition by c_custkey order by pow(px - cx, 2) + pow(py - cy, 2), entry_id) as rn from c, p) where rn = 1""")
def missing_points(spark, sf):
    x = F.when(F.col("c_custkey") % 4 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("c_acctbal") / 4)
    c = fx.table(spark, sf, "customer").select("c_custkey", x.alias("px"), ((F.col("c_custkey") % 100) * 31).cast("double").alias("py"))
    p = fx.poly(spark, sf).select("entry_id", F.when(F.col("entry_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("cx")).alias("px"), F.col("cy").alias("py"))
    return rounded(spatial.nearest_points(c, p, 250.0, "c_custkey", "entry_id"))


@query("p22_patches_of_settings", "P22 W19", "px", """
with e as (select entry_id, max(y) as maxy from px group by entry_id)
select entry_id, maxy + 1 as n_rows, (maxy + 1) // 2 as n_strides from e""")
def patches_of_settings(spark, sf):
    settings = patches.parameters(4, 4, 10.0, 100.0, True)
    rows = fx.px(spark, sf).groupBy("entry_id").agg((F.max("y") + 1).alias("n_rows"))
    return rows.withColumn("n_strides", F.expr(f"n_rows div {settings['stride_infer']}"))


@query("l5_subset_assertion", "L5 U5", "img", "select entry_id, n from img where entry_id in (select c_custkey from customer)")
def subset_assertion(spark, sf):
    i = fx.img(spark, sf).select("entry_id", "n")
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"))
    return inventory.assert_subset(i.join(c, "entry_id", "left_semi"), c)


@query("x21_region_checks", "X21", "poly", """
select entry_id, entry_id % 7 <> 0 as one_geometry, entry_id % 5 <> 0 as known_crs, entry_id % 3 <> 0 as flat, entry_id % 3 <> 0 and entry_id % 4 <> 0 as inside,
 entry_id % 7 <> 0 and entry_id % 5 <> 0 and entry_id % 3 <> 0 and entry_id % 4 <> 0 as valid from poly""")
def region_checks(spark, sf):
    p = fx.poly(spark, sf)
    e = F.col("entry_id")
    # a square turned by 45 degrees; moved by 1.2 half sides its box still meets the parent, but a corner is out
    reach, shift = F.col("half") * 0.9, F.when(e % 4 == 0, F.col("half") * 1.2).otherwise(F.lit(0.0))
    corner = lambda dx, dy: F.struct(
        F.when((e % 3 == 0) & F.lit(dx == 1), F.lit(float("nan"))).otherwise(F.col("cx") + shift + dx * reach).alias("x"), (F.col("cy") + dy * reach).alias("y"))
    regions = p.select(
        "entry_id", F.when(e % 5 != 0, F.lit("epsg:32632")).alias("crs"),
        F.array(F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1))).alias("rings"))
    twice = regions.unionByName(regions.where("entry_id % 7 = 0"))
    return inventory.check_regions(twice, p)
