"""Evaluation, overlay, metric and loss queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.operators import evaluate, inventory
from firnline.plans import fixtures as fx
from firnline.plans.registry import query, rounded

CELL = ["entry_id", "y", "x"]

AREA_SQL = """
with f as (select *, b + g >= 10000 as truth, g >= 5500 and b + g < 10000 as neg, b >= 5200 or b + g >= 10000 as infer,
   r / greatest(swir, 1) >= 1 as pr, r >= 5200 as sub from px),
c as (select *, pr and (infer or neg) as pred from f),
a as (select entry_id, count(*) filter (where truth) * 1e-4 as "P", count(*) filter (where truth and pred) * 1e-4 as "TP",
  count(*) filter (where truth and not pred) * 1e-4 as "FN", count(*) filter (where neg) * 1e-4 as "N",
  count(*) filter (where neg and pred) * 1e-4 as "FP", count(*) filter (where pred and infer) * 1e-4 as infer,
  count(*) filter (where truth and sub) * 1e-4 as area_debris, count(*) filter (where truth and sub and pred) * 1e-4 as "TP_debris" from c group by entry_id)
"""


def _areas(spark, sf, sub=False):
    truth = F.col("b") + F.col("g") >= 10000
    neg = (F.col("g") >= 5500) & ~truth
    infer = (F.col("b") >= 5200) | truth
    pred = F.col("r") / F.greatest(F.col("swir"), F.lit(1.0)) >= 1
    return evaluate.confusion_areas(
        fx.px(spark, sf), truth, neg, infer, pred, 10.0, sub=F.col("r") >= 5200 if sub else None)


@query("a9_confusion_areas", "A9", "px", AREA_SQL + """
select entry_id, round("P", 6) as "P", round("TP", 6) as "TP", round("FN", 6) as "FN", round("N", 6) as "N", round("FP", 6) as "FP", round(infer, 6) as infer from a""")
def confusion_areas(spark, sf):
    return rounded(_areas(spark, sf).select("entry_id", "P", "TP", "FN", "N", "FP", "infer"))


@query("a10_rates", "A10", "px", AREA_SQL + """
select entry_id, round("TP" + "FP", 6) as pred, round("TP" / "P", 6) as "TPR", round("FN" / "P", 6) as "FNR", round("FP" / "N", 6) as "FPR" from a""")
def rates(spark, sf):
    return rounded(_areas(spark, sf).select("entry_id", "pred", "TPR", "FNR", "FPR"))


@query("a11_sub_class_areas", "A11", "px", AREA_SQL + """
select entry_id, round(area_debris, 6) as area_debris, round(area_debris / "P", 6) as debris_coverage_f, round("TP_debris", 6) as "TP_debris",
  round(case when area_debris > 1e-5 then "TP_debris" / area_debris end, 6) as "TPR_debris" from a""")
def sub_class_areas(spark, sf):
    return rounded(_areas(spark, sf, True).select("entry_id", "area_debris", "debris_coverage_f", "TP_debris", "TPR_debris"))


@query("a13_layer_totals", "A13", "px", AREA_SQL + """
select 'P' as layer, round(sum("P"), 2) as area_km2 from a union all select 'TP', round(sum("TP"), 2) from a union all select 'FP', round(sum("FP"), 2) from a""")
def layer_totals(spark, sf):
    return evaluate.layer_totals(_areas(spark, sf), ["P", "TP", "FP"])


def _layer(spark, sf, condition, *attributes):
    return fx.px(spark, sf).where(condition).select(*CELL, *attributes)


@query("j11_overlay_intersection", "J11", "px", """
select entry_id, y, x, b, r from px where b >= 5000 and r >= 5200""")
def overlay_intersection(spark, sf):
    return evaluate.overlay_intersection(_layer(spark, sf, "b >= 5000", "b"), _layer(spark, sf, "r >= 5200", "r"), CELL)


@query("j12_overlay_difference", "J12", "px", "select entry_id, y, x, b from px where b >= 5000 and not r >= 5200")
def overlay_difference(spark, sf):
    return evaluate.overlay_difference(_layer(spark, sf, "b >= 5000", "b"), _layer(spark, sf, "r >= 5200"), CELL)


@query("j13_clipped_layer", "J13", "px", "select entry_id, y, x, b from px where b >= 5000 and r >= 5200")
def clipped_layer(spark, sf):
    return evaluate.clip_layer(_layer(spark, sf, "b >= 5000", "b"), _layer(spark, sf, "r >= 5200"), CELL)


@query("j22_source_fallback", "J22 U1", "px", """
with a as (select 'a' as source, entry_id, y, x from px where entry_id % 2 = 0 and b >= 5600),
b as (select 'b' as source, entry_id, y, x from px where entry_id % 2 = 1 and g >= 6400),
c as (select 'c' as source, entry_id, y, x from px where entry_id % 2 = 1 and r >= 5600)
select * from a union all select * from b union all select * from c where entry_id not in (select entry_id from b)""")
def source_fallback(spark, sf):
    def layer(name, rest, condition):
        return fx.px(spark, sf).where(F.col("entry_id") % 2 == rest).where(condition).select(F.lit(name).alias("source"), *CELL)

    return inventory.with_fallback(layer("a", 0, "b >= 5600"), layer("b", 1, "g >= 6400"), layer("c", 1, "r >= 5600"))


@query("a37_dissolved_cells", "A37", "px", """
select y, x from px where b >= 5600 union select y, x from px where r >= 5600""")
def dissolved(spark, sf):
    both = _layer(spark, sf, "b >= 5600").unionByName(_layer(spark, sf, "r >= 5600"))
    return evaluate.dissolve(both, ["y", "x"])


@query("a39_majority_of_three", "A39 U4", "px", """
select entry_id, y, x from px where cast(b >= 5000 as int) + cast(g >= 5000 as int) + cast(r >= 5000 as int) >= 2""")
def majority(spark, sf):
    return evaluate.majority([_layer(spark, sf, f"{c} >= 5000") for c in ("b", "g", "r")], CELL)


@query("p18_small_objects", "P18", "", """
select l_suppkey as entry_id, l_partkey as object, round(sum(l_quantity) / 1e6, 8) as area_km2 from lineitem group by 1, 2 having sum(l_quantity) / 1e6 >= 1e-4""")
def small_objects(spark, sf):
    areas = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entry_id"), F.col("l_partkey").alias("object")).agg(
        (F.sum("l_quantity") / 1e6).alias("area_km2"))
    return rounded(inventory.at_least(areas, inventory.MIN_OBJECT_KM2), 8)


@query("a14_summary", "A14", "", """
select o_orderpriority as key, count(o_totalprice) as count, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, min(o_totalprice) as min,
 round(quantile_cont(o_totalprice, 0.25), 4) as q25, round(quantile_cont(o_totalprice, 0.5), 4) as q50, round(quantile_cont(o_totalprice, 0.75), 4) as q75, max(o_totalprice) as max
from orders group by o_orderpriority""")
def summary(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"), "o_totalprice")
    return rounded(evaluate.describe(o, ["key"], "o_totalprice"), 4)


METRIC_SQL = """
with s as (select *, doc_id % 20 as sample, doc_id % 7 <> 0 as mask from prob),
k as (select entry_id, sample, count(*) filter (where mask) as n, count(*) filter (where mask and y_true = 1 and p > 0.5) as tp,
  count(*) filter (where mask and y_true = 0 and p > 0.5) as fp, count(*) filter (where mask and y_true = 1 and not p > 0.5) as fn,
  count(*) filter (where mask and y_true = 0 and not p > 0.5) as tn, count(*) filter (where y_true = 1) as pos,
  count(*) filter (where y_true = 1 and is_sub = 1) as sub, count(*) filter (where mask and y_true = 1 and is_sub = 1) as sm,
  count(*) filter (where mask and y_true = 1 and is_sub = 1 and p > 0.5) as st, sum(p) as area from s group by entry_id, sample),
m as (select entry_id, sample, case when n > 0 then (tp + tn) / n end as accuracy,
  case when n > 0 then coalesce(tp / nullif(tp + fp + fn, 0), 0) end as jaccard, case when n > 0 then coalesce(tp / nullif(tp + fp, 0), 0) end as "precision",
  case when n > 0 then coalesce(tp / nullif(tp + fn, 0), 0) end as recall, case when n > 0 then coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) end as f1,
  case when n > 0 and sub / nullif(pos, 0) >= 0.01 then coalesce(st / nullif(sm, 0), 0) end as recall_debris from k)
"""


def _samples(spark, sf, sub=False):
    s = fx.prob(spark, sf).withColumn("sample", F.col("doc_id") % 20)
    mask = F.col("doc_id") % 7 != 0
    return evaluate.sample_metrics(
        s, ["entry_id", "sample"], F.col("p"), F.col("y_true"), mask, sub=F.col("is_sub") if sub else None)


@query("a21_sample_metrics", "A21", "prob", METRIC_SQL + """
select entry_id, sample, round(accuracy, 6) as accuracy, round(jaccard, 6) as jaccard, round("precision", 6) as "precision", round(recall, 6) as recall, round(f1, 6) as f1 from m""")
def sample_metrics(spark, sf):
    return rounded(_samples(spark, sf))


@query("a26_sub_class_recall", "A26", "prob", METRIC_SQL + "select entry_id, sample, round(recall_debris, 6) as recall_debris from m")
def sub_class_recall(spark, sf):
    return rounded(_samples(spark, sf, True).select("entry_id", "sample", "recall_debris"))


@query("a25_entry_means", "A25", "prob", METRIC_SQL + """
select entry_id, round(avg(accuracy), 6) as accuracy, round(avg(f1), 6) as f1 from m group by entry_id""")
def entry_means(spark, sf):
    return rounded(evaluate.entry_means(_samples(spark, sf), ["accuracy", "f1"]))


@query("a25_two_level_means", "A25", "prob", METRIC_SQL + """
, a as (select entry_id, sum(p) as area from prob group by entry_id), e as (select entry_id, avg(accuracy) as accuracy, avg(f1) as f1 from m group by entry_id)
select (select round(avg(accuracy), 6) from m) as accuracy, (select round(avg(f1), 6) from m) as f1,
  round(sum(accuracy * area) / sum(area), 6) as w_accuracy, round(sum(f1 * area) / sum(area), 6) as w_f1 from e join a using (entry_id)""")
def two_level_means(spark, sf):
    areas = fx.prob(spark, sf).groupBy("entry_id").agg(F.sum("p").alias("area"))
    return rounded(evaluate.two_level_means(_samples(spark, sf).join(areas, "entry_id"), ["accuracy", "f1"], "area"))


LOSS_SQL = """
with s as (select *, doc_id % 7 <> 0 as mask, cast(y_true as double) as y from prob),
t as (select *, pow(p - y, 2) as l2, abs(p - y) as l1, -(y * ln(p) + (1 - y) * ln(1 - p)) as bce, p * y + (1 - p) * (1 - y) as pt from s)
select {key} round(sum(l2) filter (where mask) / count(*) filter (where mask), 6) as "L2", round(sum(l1) filter (where mask) / count(*) filter (where mask), 6) as "L1",
 round(sum(bce) filter (where mask) / count(*) filter (where mask), 6) as "BCE",
 round(sum((0.25 * y + 0.75 * (1 - y)) * bce * pow(1 - pt, 2)) filter (where mask) / count(*) filter (where mask), 6) as focal,
 round(1 - (2 * sum(p * y) + 1e-6) / (sum(p) + sum(y) + 1e-6), 6) as dice from t {group}
"""


@query("a43_losses_per_sample", "A43", "prob", LOSS_SQL.format(key="entry_id,", group="group by entry_id"))
def losses_per_sample(spark, sf):
    s = fx.prob(spark, sf)
    return rounded(evaluate.masked_losses(s, ["entry_id"], F.col("p"), F.col("y_true"), F.col("doc_id") % 7 != 0))


@query("a43_losses_global", "A43", "prob", LOSS_SQL.format(key="", group=""))
def losses_global(spark, sf):
    return rounded(evaluate.masked_losses(fx.prob(spark, sf), [], F.col("p"), F.col("y_true"), F.col("doc_id") % 7 != 0))
