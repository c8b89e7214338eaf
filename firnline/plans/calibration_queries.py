"""Threshold, calibration and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.functions import probability as pr
from firnline.functions import spectral
from firnline.operators import calibrate, ensemble, inventory, thresholds
from firnline.plans import fixtures as fx
from firnline.plans.registry import query, rounded

CELL = ["entry_id", "y", "x"]
SEEDS = [1, 2, 3, 4]
UNIT = (0.0, 1.0, 0.01)


@query("a22_threshold_sweep", "A22 J16", "prob", """
with t as (select unnest(range(101)) as i), k as (select i, count(*) filter (where p >= cast(i as double) * cast(0.01 as double) and y_true = 1) as tp,
  count(*) filter (where p >= cast(i as double) * cast(0.01 as double) and y_true = 0) as fp, count(*) filter (where p < cast(i as double) * cast(0.01 as double) and y_true = 1) as fn,
  count(*) filter (where p < cast(i as double) * cast(0.01 as double) and y_true = 0) as tn from prob, t group by i)
select round(cast(i as double) * 0.01, 6) as thr, tp, fp, fn, tn, round(tp / nullif(tp + fp + fn, 0), 6) as iou from k""")
def threshold_sweep(spark, sf):
    s = thresholds.sweep_iou(fx.prob(spark, sf).withColumn("all", F.lit(1)), ["all"], F.col("y_true") == 1, F.col("p"), UNIT)
    return rounded(s.select(F.col("thr_1").alias("thr"), "tp", "fp", "fn", "tn", "iou"))


RATIO, BLUE = (0.5, 1.5, 0.1), (4000.0, 6000.0, 250.0)
SWEEP_SQL = """
with t1 as (select unnest(range(11)) as i), t2 as (select unnest(range(9)) as j),
h as (select cast(0.5 as double) + cast(i as double) * cast(0.1 as double) as thr_1, 4000 + cast(j as double) * 250 as thr_2 from t1, t2),
v as (select entry_id, b + g >= 10000 as truth, r / greatest(swir, 1) as ratio, b from px where swir >= 4200),
s as materialized (select entry_id, thr_1, thr_2, count(*) filter (where truth and ratio >= thr_1 and b >= thr_2) as tp,
  count(*) filter (where not truth and ratio >= thr_1 and b >= thr_2) as fp, count(*) filter (where truth and not (ratio >= thr_1 and b >= thr_2)) as fn from v, h group by all),
u as materialized (select *, tp / nullif(tp + fp + fn, 0) as iou from s)
"""


def _sweep(spark, sf):
    c = fx.px(spark, sf).where("swir >= 4200")
    return thresholds.sweep_iou(
        c, ["entry_id"], F.col("b") + F.col("g") >= 10000, spectral.band_ratio(F.col("r"), F.col("swir")), RATIO, F.col("b"), BLUE)


@query("a22_two_threshold_sweep", "A22 J16", "px", SWEEP_SQL + """
select entry_id, round(thr_1, 6) as thr_1, round(thr_2, 6) as thr_2, tp, fp, fn, round(iou, 6) as iou from u""")
def two_threshold_sweep(spark, sf):
    return rounded(_sweep(spark, sf).drop("tn"))


def _areas(spark, sf):
    return fx.px(spark, sf).groupBy("entry_id").agg(F.count(F.when(F.col("b") >= 5000, 1)).cast("double").alias("area"))


REGIONAL_SQL = SWEEP_SQL + """
, a as (select entry_id, cast(count(*) filter (where b >= 5000) as double) as area, entry_id % 2 as fold from px group by entry_id),
w as (select u.*, fold, area / sum(area) over (partition by {part} thr_1, thr_2) * count(*) over (partition by {part} thr_1, thr_2) as w from u join a using (entry_id)),
m as (select {fold} thr_1, thr_2, avg(iou) as iou, avg(iou * w) as w_iou from w group by all)
select {fold} round(thr_1, 6) as thr_1, round(thr_2, 6) as thr_2, round(iou, 6) as iou, round(w_iou, 6) as w_iou from
  (select *, row_number() over ({over} order by round(w_iou, 12) desc, thr_1, thr_2) as rn from m) t where rn = 1
"""


@query("a23_regional_thresholds", "A23", "px", REGIONAL_SQL.format(part="", fold="", over=""))
def regional_thresholds(spark, sf):
    return rounded(thresholds.best_regional(_sweep(spark, sf), _areas(spark, sf)))


@query("a23_regional_thresholds_per_fold", "A23", "px", REGIONAL_SQL.format(part="fold,", fold="fold,", over="partition by fold"))
def regional_thresholds_per_fold(spark, sf):
    areas = _areas(spark, sf).withColumn("fold", F.col("entry_id") % 2)
    return rounded(thresholds.best_regional(_sweep(spark, sf), areas, ["fold"]))


@query("a24_entry_thresholds", "A24 W23", "px", SWEEP_SQL + """
select entry_id, round(thr_1, 6) as thr_1, round(thr_2, 6) as thr_2, round(iou, 6) as iou from
 (select *, row_number() over (partition by entry_id order by iou desc, thr_1, thr_2) as rn from u where iou is not null) t where rn = 1""")
def entry_thresholds(spark, sf):
    return rounded(thresholds.best_per_entry(_sweep(spark, sf)))


# --- ensembles ---------------------------------------------------------------------------------

AGG_SQL = """
with a as (select entry_id, y, x, avg(p) as pred, stddev_pop(p) as pred_std, list(p order by seed) as pred_all from ens group by entry_id, y, x having count(*) = 4)
"""


def _aggregated(spark, sf):
    return ensemble.aggregate_members(fx.ens(spark, sf), SEEDS)


@query("a17_ensemble_cells", "A17", "ens", """
with n as (select entry_id, y, x, seed, case when (y + x + seed) % 29 <> 0 then p end as p from ens),
a as (select entry_id, y, x, case when count(p) = 4 then avg(p) end as pred, case when count(p) = 4 then stddev_pop(p) end as pred_std, list(p order by seed) as pred_all from n group by entry_id, y, x)
select entry_id, y, x, round(pred, 6) as pred, round(pred_std, 6) as pred_std, pred >= 0.5 as pred_b, pred - pred_std >= 0.5 as pred_low_b,
  pred + pred_std >= 0.5 as pred_high_b, round(pred_all[1], 6) as m1, round(pred_all[4], 6) as m4 from a""")
def ensemble_cells(spark, sf):
    gappy = fx.ens(spark, sf).withColumn("p", F.when((F.col("y") + F.col("x") + F.col("seed")) % 29 != 0, F.col("p")))
    a = ensemble.aggregate_members(gappy, SEEDS)
    return rounded(a.select(
        *CELL, "pred", "pred_std", "pred_b", "pred_low_b", "pred_high_b", F.col("pred_all")[0].alias("m1"), F.col("pred_all")[3].alias("m4")))


@query("u6_member_union", "U6", "px", """
select entry_id, y, x, b as p, 1 as seed from px union all select entry_id, y, x, g, 2 from px union all select entry_id, y, x, r, 3 from px""")
def member_union(spark, sf):
    c = fx.px(spark, sf)
    members = {i + 1: c.select(*CELL, F.col(b).alias("p")) for i, b in enumerate(("b", "g", "r"))}
    return ensemble.require_all_members(ensemble.union_members(members), 3)


STATS_SQL = """
with st as (select l_suppkey as entry_id, l_linenumber % 3 as seed, 1996 as year, sum(l_quantity) as area_nok, sum(case when l_returnflag = 'R' then l_quantity / 20 else 0 end) as area_debris,
   sum(l_extendedprice / 1000) as area_pred_b0, sum(l_extendedprice / 1100) as area_pred_low_b0, sum(l_extendedprice / 900) as area_pred_high_b0,
   sum(l_tax * 10) as area_debris_pred_b0, sum(l_tax * 9) as area_debris_pred_low_b0, sum(l_tax * 11) as area_debris_pred_high_b0,
   sum(l_discount * 50) as area_non_g_b20, sum(l_discount * 150) as area_non_g_b50,
   sum(l_discount * 20) as area_non_g_pred_b20, sum(l_discount * 18) as area_non_g_pred_low_b20, sum(l_discount * 22) as area_non_g_pred_high_b20,
   sum(l_discount * 60) as area_non_g_pred_b50, sum(l_discount * 50) as area_non_g_pred_low_b50, sum(l_discount * 70) as area_non_g_pred_high_b50
   from lineitem group by 1, 2),
al as (select st.*, area_inv, area_nok / area_inv as area_nok_p, area_debris / area_inv as area_debris_p, area_non_g_b50 - area_non_g_b20 as area_non_g_b20_50,
   area_pred_b0 as area_recalled, area_pred_b0 / area_inv as recall, case when area_debris / area_inv > 0.01 then area_debris_pred_b0 end as area_debris_recalled,
   area_non_g_pred_b50 - area_non_g_pred_b20 as area_non_g_pred_b20_50, (area_non_g_pred_b50 - area_non_g_pred_b20) / (area_non_g_b50 - area_non_g_b20) as fp_rate,
   area_pred_b0 + area_non_g_pred_b20 as area_pred, (area_pred_high_b0 + area_non_g_pred_high_b20 - area_pred_low_b0 - area_non_g_pred_low_b20) * 0.5 as area_pred_std,
   (area_pred_high_b0 - area_pred_low_b0) / area_inv * 0.5 as recall_std, 1996 = year_inv as is_inv_year
   from st join (select entry_id, area_km2 as area_inv, cast(1995 + entry_id % 2 as integer) as year_inv from inv) i using (entry_id))
"""
RAW = {
    "area_nok": "l_quantity", "area_debris": "CASE WHEN l_returnflag = 'R' THEN l_quantity / 20 ELSE 0D END",
    "area_pred_b0": "l_extendedprice / 1000", "area_pred_low_b0": "l_extendedprice / 1100", "area_pred_high_b0": "l_extendedprice / 900",
    "area_debris_pred_b0": "l_tax * 10", "area_debris_pred_low_b0": "l_tax * 9", "area_debris_pred_high_b0": "l_tax * 11",
    "area_non_g_b20": "l_discount * 50", "area_non_g_b50": "l_discount * 150", "area_non_g_pred_b20": "l_discount * 20",
    "area_non_g_pred_low_b20": "l_discount * 18", "area_non_g_pred_high_b20": "l_discount * 22", "area_non_g_pred_b50": "l_discount * 60",
    "area_non_g_pred_low_b50": "l_discount * 50", "area_non_g_pred_high_b50": "l_discount * 70",
}


def stats_table(spark, sf):
    raw = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entry_id"), (F.col("l_linenumber") % 3).alias("seed")).agg(
        *[F.sum(F.expr(e)).alias(k) for k, e in RAW.items()])
    i = fx.inv(spark, sf).select(
        "entry_id", F.col("area_km2").alias("area_inv"), (F.lit(1995) + F.col("entry_id") % 2).cast("int").alias("year_inv"))
    return ensemble.assemble_stats(raw.withColumn("year", F.lit(1996)), i, bounds=True)


@query("a20_assembled_stats", "A20 L3", "inv", STATS_SQL + """
select entry_id, seed, round(area_nok_p, 6) as area_nok_p, round(area_debris_p, 6) as area_debris_p, round(area_recalled, 6) as area_recalled, round(recall, 6) as recall,
  round(area_debris_recalled, 6) as area_debris_recalled, round(area_non_g_pred_b20_50, 6) as area_non_g_pred_b20_50, round(fp_rate, 6) as fp_rate, round(area_pred, 6) as area_pred, is_inv_year
from al order by entry_id, seed""")
def assembled_stats(spark, sf):
    s = stats_table(spark, sf).select(
        "entry_id", "seed", "area_nok_p", "area_debris_p", "area_recalled", "recall", "area_debris_recalled",
        "area_non_g_pred_b20_50", "fp_rate", "area_pred", "is_inv_year")
    return rounded(s).orderBy("entry_id", "seed")


@query("a19_deviation_from_bounds", "A19", "inv", STATS_SQL + """
select entry_id, seed, round(area_pred, 6) as area_pred, round(area_pred_std, 6) as area_pred_std, round(recall_std, 6) as recall_std from al""")
def deviation_from_bounds(spark, sf):
    s = ensemble.deviation_from_bounds(stats_table(spark, sf), ["area_pred", "recall"])
    return rounded(s.select("entry_id", "seed", "area_pred", "area_pred_std", "recall_std"))


@query("a18_deviation_over_seeds", "A18", "inv", STATS_SQL + """
select entry_id, is_inv_year, round(arg_min(area_nok, seed), 7) as area_nok, round(avg(area_pred), 7) as area_pred, round(stddev_samp(area_pred), 7) as area_pred_std,
  round(avg(recall), 7) as recall, round(stddev_samp(recall), 7) as recall_std from al group by entry_id, is_inv_year""")
def deviation_over_seeds(spark, sf):
    s = ensemble.deviation_over_seeds(stats_table(spark, sf), ["area_pred", "recall"])
    return rounded(s.select("entry_id", "is_inv_year", "area_nok", "area_pred", "area_pred_std", "recall", "recall_std"), 7)


# --- calibration -------------------------------------------------------------------------------

BIN_SQL = """
with s as (select greatest(p, 1 - p) as conf, (p >= 0.5) = (y_true = 1) as ok from prob),
b as (select cast(ceil(conf * 40) as integer) as bin, count(*) as n, avg(case when ok then 1.0 else 0.0 end) as accuracy, avg(conf) as confidence from s where conf > 0 group by 1)
"""


def _bins(spark, sf):
    s = calibrate.sample_columns(fx.prob(spark, sf)).withColumn("member", F.lit("ensemble"))
    return calibrate.reliability_bins(s, ["member"], F.col("conf"), F.col("pred_ok"))


@query("a27_reliability_bins", "A27", "prob", BIN_SQL + "select bin, n, round(accuracy, 6) as accuracy, round(confidence, 6) as confidence from b")
def reliability_bins(spark, sf):
    return rounded(_bins(spark, sf).drop("member"))


@query("a27_calibration_errors", "A27", "prob", BIN_SQL + """
select round(sum(abs(accuracy - confidence) * n) / sum(n), 6) as ece, round(max(abs(accuracy - confidence)), 6) as mce,
  round(sum(accuracy * n) / sum(n), 6) as avg_accuracy, round(sum(confidence * n) / sum(n), 6) as avg_confidence, cast(sum(n) as bigint) as n from b""")
def calibration_errors(spark, sf):
    return rounded(calibrate.calibration_errors(_bins(spark, sf), ["member"]).drop("member"))


@query("a28_temperature_losses", "A28 X12", "prob", """
with t as (select cast(unnest(range(91)) as double) * 0.05 + 0.5 as t), c as (select y_true, greatest(least(p, 1 - 1e-6), 1e-6) as p from prob),
s as (select t, y_true, 1 / (1 + exp(-ln(p / (1 - p)) / t)) as q from c, t)
select round(t, 2) as t, round(avg(case when y_true = 1 then -ln(q) else -ln(1 - q) end), 6) as nll from s group by t""")
def temperature_losses(spark, sf):
    grid = F.transform(F.sequence(F.lit(0), F.lit(90)), lambda i: F.round(0.5 + i * 0.05, 2))
    losses = calibrate.temperature_losses(fx.prob(spark, sf), [], F.col("p"), F.col("y_true"), grid)
    return rounded(losses)


@query("a28_best_temperature", "A28", "ens", """
with g as (select seed, entry_id * 100000 + y * 100 + x as k, greatest(least(p, 1 - 1e-6), 1e-6) as p, (entry_id + y + x) % 3 = 0 as flip from ens),
y as (select seed, p, case when flip then p < 0.5 else p >= 0.5 end as y from g), t as (select cast(unnest(range(451)) as double) * 0.01 + 0.5 as t),
s as (select seed, t, avg(case when y then -ln(1 / (1 + exp(-ln(p / (1 - p)) / t))) else -ln(1 - 1 / (1 + exp(-ln(p / (1 - p)) / t))) end) as nll from y, t group by seed, t)
select seed, round(arg_min(t, nll), 1) as best_t, round(min(nll), 5) as nll from s group by seed""")
def best_temperature(spark, sf):
    flip = (F.col("entry_id") + F.col("y") + F.col("x")) % 3 == 0
    e = fx.ens(spark, sf).withColumn("label", F.when(flip, F.col("p") < 0.5).otherwise(F.col("p") >= 0.5).cast("int"))
    best = calibrate.best_temperature(e, "seed", "p", "label")
    return rounded(best, 5, best_t=1)


@query("x12_calibrated_ensemble", "X12 X14 J17", "ens", """
with c as (select entry_id, y, x, seed, greatest(least(p, 1 - 1e-6), 1e-6) as p, 1 + seed * 0.25 as t from ens),
s as (select *, 1 / (1 + exp(-ln(p / (1 - p)) / t)) as q from c)
select entry_id, y, x, round(avg(q), 6) as pred, round(stddev_pop(q), 6) as pred_std from s group by entry_id, y, x""")
def calibrated_ensemble(spark, sf):
    e = fx.ens(spark, sf)
    temps = fx.table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("seed")).select(
        "seed", (1 + F.col("seed") * 0.25).alias("best_t"))
    return rounded(ensemble.aggregate_members(calibrate.scale_members(e, temps), SEEDS).select(*CELL, "pred", "pred_std"))


@query("x13_sample_columns", "X13", "prob", """
select doc_id, round(case when p <= 0.5 then 1 - p else p end, 6) as conf, round((case when p <= 0.5 then 1 - p else p end) - p / 10, 6) as conf_minus_std,
 round(-(q * ln(q) + (1 - q) * ln(1 - q)) / 2, 6) as shannon, p >= 0.5 as y_pred_b, (p >= 0.5) = (y_true = 1) as pred_ok, (p >= 0.5) <> (y_true = 1) as pred_nok
from (select *, greatest(least(p, 1 - 1e-5), 1e-5) as q from prob) t""")
def sample_columns(spark, sf):
    s = calibrate.sample_columns(fx.prob(spark, sf).withColumn("std", F.col("p") / 10), std="std")
    return rounded(s.select("doc_id", "conf", "conf_minus_std", "shannon", "y_pred_b", "pred_ok", "pred_nok"))


@query("x14_member_columns", "X14", "px", """
select entry_id, y, x, round((b + g + r + swir) / 4, 6) as mean,
  round(sqrt((pow(b - (b+g+r+swir)/4, 2) + pow(g - (b+g+r+swir)/4, 2) + pow(r - (b+g+r+swir)/4, 2) + pow(swir - (b+g+r+swir)/4, 2)) / 4), 6) as std from px""")
def member_columns(spark, sf):
    cols = [F.col(c) for c in fx.MEMBERS]
    return rounded(fx.px(spark, sf).select(*CELL, pr.row_mean(cols).alias("mean"), pr.row_std(cols).alias("std")))


@query("x15_calibrated_bounds", "X15", "ens", AGG_SQL + """
select entry_id, y, x, pred - pred_std >= 0.7 as pred_low_b, pred + pred_std >= 0.3 as pred_high_b from a""")
def calibrated_bounds(spark, sf):
    return calibrate.bound_flags(_aggregated(spark, sf), 0.3).select(*CELL, "pred_low_b", "pred_high_b")


BOUND_SQL = AGG_SQL + """
, t as (select unnest(range(501)) as i),
v as (select a.entry_id, pred, b + g >= 10000 as truth, pred + pred_std as u, pred - pred_std as l from a join px using (entry_id, y, x)),
ar as materialized (select entry_id, round(cast(i as double) * 0.001, 9) as thr, count(*) filter (where pred >= 0.5) * 1e-4 as area_pred, count(*) filter (where truth) * 1e-4 as area_true,
  count(*) filter (where l >= 1 - cast(i as double) * cast(0.001 as double)) * 1e-4 as area_lb, count(*) filter (where u >= cast(i as double) * cast(0.001 as double)) * 1e-4 as area_ub from v, t group by entry_id, i)
"""


def _bounds(spark, sf):
    truth = fx.px(spark, sf).select(*CELL, (F.col("b") + F.col("g") >= 10000).alias("truth"))
    cells = _aggregated(spark, sf).join(truth, CELL)
    return thresholds.area_bounds(cells, ["entry_id"], F.col("pred"), F.col("pred_std"), F.col("truth"), 10.0)


@query("a29_area_bounds", "A29 P15", "ens", BOUND_SQL + """
select entry_id, thr, round(area_pred, 6) as area_pred, round(area_true, 6) as area_true, round(area_lb, 6) as area_lb, round(area_ub, 6) as area_ub from ar""")
def area_bounds(spark, sf):
    return rounded(_bounds(spark, sf), thr=9)


@query("x16_area_errors", "X16", "ens", BOUND_SQL + """
select entry_id, thr, round(area_pred - area_true, 6) as area_pred_error, round(abs(area_pred - area_true), 6) as area_pred_error_abs,
 round((area_ub - area_lb) / 2, 6) as area_pred_error_est, round(abs((area_ub - area_lb) / 2 - abs(area_pred - area_true)), 6) as est_err_vs_actual_err,
 (area_lb <= area_true and area_true <= area_ub) as pred_is_within_bounds from ar""")
def area_errors(spark, sf):
    e = thresholds.with_area_errors(_bounds(spark, sf))
    return rounded(e.drop("area_pred", "area_true", "area_lb", "area_ub"), thr=9)


@query("a30_calibrated_threshold", "A30", "ens", BOUND_SQL + """
, h as (select thr, avg(case when area_lb <= area_true and area_true <= area_ub then 1.0 else 0.0 end) as p from ar group by thr)
select thr as thr_best, cast(0.6826894921370859 as double) as p_target, round(p, 6) as p_best from h order by round(abs(p - 0.6826894921370859), 12), thr limit 1""")
def calibrated_threshold(spark, sf):
    return rounded(thresholds.calibrated_bound(thresholds.with_area_errors(_bounds(spark, sf))), thr_best=9, p_target=16)
