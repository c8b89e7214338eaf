"""Whole stages in a row, each on the output of the one before."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.operators import calibrate, change, ensemble, evaluate, folds, images, neighbours, patches, pixels, spatial
from firnline.plans import fixtures as fx
from firnline.plans.pixel_queries import RADIUS, SCORED_SQL, scored_patches
from firnline.plans.registry import query, rounded
from firnline.session import materialise
from firnline.tables import unbroadcast

CELL = ["entry_id", "y", "x"]

SEGMENTED_SQL = "with recursive " + SCORED_SQL.strip().removeprefix("with ") + """
, mo as materialized (select entry_id, y, x, avg(p) as pred from s where y - y_center >= -3 and y - y_center < 3 and x - x_center >= -3 and x - x_center < 3 group by entry_id, y, x),
mg as materialized (select px.entry_id, px.y, px.x, pred, swir < 4200 as gap, b + g >= 10000 as truth from px left join mo on px.entry_id = mo.entry_id and px.y = mo.y and px.x = mo.x),
so as (select * from mg where not gap and pred is not null),
en as (select entry_id from so group by entry_id having count(*) >= 30),
dd as (select t.entry_id, t.y, t.x, pow(t.y - o.y, 2) + pow(t.x - o.x, 2) as d2, o.pred from mg t join en on t.entry_id = en.entry_id join so o on t.entry_id = o.entry_id where t.gap),
dq as (select *, row_number() over (partition by entry_id, y, x order by d2) as rn from dd),
dr as (select entry_id, y, x, min(case when rn = 30 then d2 end) as r2 from dq group by entry_id, y, x),
fi as (select dd.entry_id, dd.y, dd.x, avg(dd.pred) as filled from dd join dr on dd.entry_id = dr.entry_id and dd.y = dr.y and dd.x = dr.x where d2 <= r2 group by dd.entry_id, dd.y, dd.x),
fu as materialized (select mg.entry_id, mg.y, mg.x, truth, case when gap then filled else pred end as pred from mg left join fi on mg.entry_id = fi.entry_id and mg.y = fi.y and mg.x = fi.x),
id as materialized (select *, entry_id * 1000000 + y * 100 + x as v from fu where pred >= 0.5),
ed as materialized (select a.v as a, b.v as b from id a join id b on a.entry_id = b.entry_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.v <> b.v),
reach(v, r) as (select v, v from id union select reach.v, ed.b from reach join ed on reach.r = ed.a),
la as (select v, min(r) as root from reach group by v),
sg as (select id.*, root, count(*) over (partition by root) as n from id join la using (v))
"""


@query("pipeline_scores_to_areas", "D2 A38 W8 D6 W18 P18 A9", "px", SEGMENTED_SQL + """
, ks as (select * from sg where n * 100 / 1e6 >= 0.00015)
select fu.entry_id, count(distinct root) as segments, round(count(root) * 100 / 1e6, 6) as area_km2, round(count(*) filter (where fu.truth) * 100 / 1e6, 6) as area_true,
 round(count(*) filter (where fu.truth and root is not null) * 100 / 1e6, 6) as area_hit from fu left join ks on fu.entry_id = ks.entry_id and fu.y = ks.y and fu.x = ks.x group by fu.entry_id""")
def scores_to_areas(spark, sf):
    """Score patches, mosaic them, fill what clouds cover, cut segments and measure them against the truth."""
    cells = fx.px(spark, sf)
    mosaic = patches.mosaic(scored_patches(spark, sf), RADIUS, 0.125)
    seen = cells.join(unbroadcast(mosaic), CELL, "left").select(
        *CELL, "pred", (F.col("swir") < 4200).alias("gap"), (F.col("b") + F.col("g") >= 10000).alias("truth"))
    filled = neighbours.nearest_fill(seen, "pred", F.col("gap"), ~F.col("gap"))
    full = seen.join(unbroadcast(filled), CELL, "left").withColumn("pred", F.when(F.col("gap"), F.col("filled")).otherwise(F.col("pred")))
    kept = spatial.segments(full, F.col("pred") >= evaluate.DECISION, 10.0, 0.00015).select(*CELL, "segment")
    both = full.join(unbroadcast(kept), CELL, "left").groupBy("entry_id").agg(
        F.count_distinct("segment").alias("segments"), *[
            (F.count(F.when(c, 1)) * 100 / 1e6).alias(n) for n, c in (
                ("area_km2", F.col("segment").isNotNull()), ("area_true", F.col("truth")), ("area_hit", F.col("truth") & F.col("segment").isNotNull()))])
    return rounded(both)


@query("pipeline_images_to_normalised", "P12 W2 L2 J5 W6 A1 A2 A3 X7 A42", "img inv lpx", """
with im as (select distinct entry_id from img where coverage >= 0.3 and cloud_p <= 0.3),
f as (select entry_id, area_km2, sum(area_km2) over (order by bound_lim desc, entry_id) / sum(area_km2) over () as c from inv where entry_id in (select entry_id from im)),
fo as materialized (select entry_id, case when c >= 0.2 and c < 0.4 then 'test' when c >= 0.15 and c < 0.45 then 'val' else 'train' end as fold from f),
u as (select entry_id, 'b' as v, b as x from lpx union all select entry_id, 'swir', swir from lpx),
p as (select u.entry_id, v, count(x) as n, sum(x) as s1, sum(x * x) as s2 from u join fo on u.entry_id = fo.entry_id where fold = 'train' group by u.entry_id, v),
st as (select v, sum(s1) / sum(n) as mu, sqrt((sum(s2) - sum(s1) * sum(s1) / sum(n)) / sum(n)) as sd from p group by v),
z as (select fold, fo.entry_id, v, (x - mu) / sd as x from u join fo on u.entry_id = fo.entry_id join st using (v))
select fold, count(distinct entry_id) as n_entries, count(*) filter (where v = 'b') as n_cells, round(avg(case when v = 'b' then x end), 6) as b_mean,
 round(stddev_pop(case when v = 'b' then x end), 6) as b_std, round(avg(case when v = 'swir' then x end), 6) as swir_mean from z group by fold""")
def images_to_normalised(spark, sf):
    """Entries with a usable image, split into folds; constants of the training fold standardise the cells of all."""
    best = images.best_per_entry(images.rank_usable(fx.img(spark, sf), ["cloud_p", "ndsi"], min_coverage=0.3, max_cloud_p=0.3))
    split = folds.assert_disjoint(folds.assign_folds(fx.inv(spark, sf).join(best.select("entry_id"), "entry_id", "left_semi"), 5, 2, 0.1))
    cells = fx.lpx(spark, sf).join(split.select("entry_id", "fold"), "entry_id")
    partials = pixels.norm_partials(cells, ["entry_id"], ["b", "swir"])
    stats = pixels.merge_norm_stats(pixels.training_only(partials, split))
    scaled = pixels.scale_bands(cells, stats, ["b", "swir"], standardised=True, minmax=False)
    per_entry = scaled.groupBy("fold", "entry_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("b1"), F.sum(F.col("b") * F.col("b")).alias("b2"), F.sum("swir").alias("s1"))
    n = F.sum("n")
    mean = F.sum("b1") / n
    return rounded(per_entry.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_entries"), n.alias("n_cells"), mean.alias("b_mean"),
        F.sqrt(F.sum("b2") / n - mean * mean).alias("b_std"), (F.sum("s1") / n).alias("swir_mean")))


#: The members of the second epoch see less.
LATER = 0.9


@query("pipeline_members_to_rates", "X12 J17 A17 A19 A31 J21", "ens px", """
with m as (select entry_id, y, x, seed, 2016 as year, p from ens union all select entry_id, y, x, seed, 2023, p * 0.9 from ens),
q as (select entry_id, y, x, year, seed, 1 / (1 + exp(-ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) / (1 + seed * 0.25))) as q from m),
c as (select entry_id, y, x, year, avg(q) as pred, stddev_pop(q) as sd from q group by entry_id, y, x, year),
a as (select entry_id, year, count(*) filter (where pred >= 0.5) * 100 / 1e6 as area,
  (count(*) filter (where pred + sd >= 0.5) - count(*) filter (where pred - sd >= 0.5)) * 100 / 1e6 * 0.5 as dev from c group by entry_id, year)
select s.entry_id, round(s.area, 6) as area_t0, round(t.area, 6) as area_t1, round((t.area - s.area) / 7, 8) as area_rate,
 round(sqrt(s.dev * s.dev + t.dev * t.dev) / 7, 8) as area_rate_std from a s join a t on s.entry_id = t.entry_id where s.year = 2016 and t.year = 2023""")
def members_to_rates(spark, sf):
    """Members of two epochs, each scaled by its temperature, averaged, bounded, measured and set against each other."""
    temperatures = fx.table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("seed")).withColumn("best_t", 1 + F.col("seed") * 0.25)
    truth = (F.col("b") + F.col("g") >= 10000).alias("truth")

    def epoch(year: int, share: float):
        members = fx.ens(spark, sf).withColumn("p", F.col("p") * share)
        cells = ensemble.aggregate_members(calibrate.scale_members(members, temperatures), [1, 2, 3, 4]).select(*CELL, "pred", "pred_std")
        seen = cells.join(unbroadcast(fx.px(spark, sf).select(*CELL, truth)), CELL)
        hit = F.col("pred") >= evaluate.DECISION
        measured = seen.groupBy("entry_id").agg(
            *[(F.count(F.when(c, 1)) * 100 / 1e6).alias(n) for n, c in (
                ("area_inv", F.col("truth")), ("area_pred", hit), ("area_pred_low", F.col("pred") - F.col("pred_std") >= evaluate.DECISION),
                ("area_pred_high", F.col("pred") + F.col("pred_std") >= evaluate.DECISION))],
            F.try_divide(F.count(F.when(hit & F.col("truth"), 1)), F.count(F.when(F.col("truth"), 1))).alias("recall"))
        return ensemble.deviation_from_bounds(measured, ["area_pred"]).withColumn("year", F.lit(year))

    rates = change.change_rates(materialise(epoch(2016, 1.0)), materialise(epoch(2023, LATER)))
    return rounded(rates.select("entry_id", "area_t0", "area_t1", "area_rate", "area_rate_std"), area_rate=8, area_rate_std=8)
