"""Regional statistics and change-rate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.operators import change, ensemble
from firnline.plans import fixtures as fx
from firnline.plans.calibration_queries import STATS_SQL, stats_table
from firnline.plans.registry import query, rounded

LIMITS = [500, 1000, 2000, 4000, 8000]


@query("p17_area_classes", "P17", "epochs", """
select entry_id, case when area_inv < 500 then '[0.01, 500)' when area_inv < 1000 then '[500, 1000)' when area_inv < 2000 then '[1000, 2000)'
 when area_inv < 4000 then '[2000, 4000)' when area_inv < 8000 then '[4000, 8000)' else '>= 8000' end as area_class from epochs""")
def area_classes(spark, sf):
    return change.with_area_class(fx.epochs(spark, sf), "area_inv", LIMITS).select("entry_id", "area_class")


@query("a15_regional_areas", "A15", "inv", STATS_SQL + """
select count(*) as n, round(sum(area_inv), 2) as area_inv, round(sum(area_nok), 2) as area_nok, round(sum(area_recalled), 2) as area_recalled,
 round(sum((area_pred_high_b0 - area_pred_low_b0) * 0.5), 2) as area_recalled_std, round(sum(area_pred), 2) as area_pred, round(sum(area_pred_std), 2) as area_pred_std,
 round(sum(area_recalled) / sum(area_inv) * 100, 4) as recall_prc, round(sum(area_non_g_pred_b20_50) / sum(area_non_g_b20_50) * 100, 4) as fp_prc,
 round(sum(area_debris) / sum(area_inv) * 100, 4) as debris_prc, round(sum(area_debris_recalled) / sum(area_debris) * 100, 4) as recall_debris_prc from al""")
def regional_areas(spark, sf):
    s = stats_table(spark, sf).withColumn("area_ok", F.col("area_inv") - F.col("area_nok"))
    columns = ["area_recalled", "area_pred", "area_debris_recalled", "area_non_g_pred_b20_50"]
    r = change.regional_areas(ensemble.deviation_from_bounds(s, columns), "b20_50", uncertainties=True)
    r = r.select("n", "area_inv", "area_nok", "area_recalled", "area_recalled_std", "area_pred", "area_pred_std",
                 "recall_prc", "fp_prc", "debris_prc", "recall_debris_prc")
    return rounded(r, 2, recall_prc=4, fp_prc=4, debris_prc=4, recall_debris_prc=4)


RATES_SQL = """
with e as (select *, cast(0.75 + (entry_id % 4) * 0.0625 as double) as recall from epochs where area_t0 is not null and area_t1 is not null),
r as (select *, 4 as num_years, (area_t1 - area_t0) / 4 as area_rate, (area_t1 - area_t0) / 4 / area_t0 as area_rate_prc,
  sqrt(area_t0_std * area_t0_std + area_t1_std * area_t1_std) / 4 as area_rate_std from e),
f as (select *, case when area_rate_std is not null then abs(area_rate) / greatest(area_rate_std, 1e-9) end as snr from r),
n as (select *, not coalesce(snr >= 0.5, false) as filtered_by_unc, not coalesce(recall >= 0.8, false) as filtered_by_recall,
  not (coalesce(snr >= 0.5, false) and coalesce(recall >= 0.8, false)) as filtered from f)
"""


def _epochs(spark, sf):
    e = fx.epochs(spark, sf).where("area_t0 is not null and area_t1 is not null")
    return e.withColumn("recall", 0.75 + (F.col("entry_id") % 4) * 0.0625)


def _rates(spark, sf):
    e = _epochs(spark, sf)
    t0 = e.select("entry_id", "area_inv", "recall", F.col("area_t0").alias("area_pred"),
                  F.col("area_t0_std").alias("area_pred_std"), F.col("year_t0").alias("year"))
    t1 = e.select("entry_id", F.col("area_t1").alias("area_pred"), F.col("area_t1_std").alias("area_pred_std"), F.col("year_t1").alias("year"))
    return change.change_rates(t0, t1)


@query("a31_change_rates", "A31 J21", "epochs", RATES_SQL + """
select entry_id, num_years, round(area_rate, 6) as area_rate, round(area_rate_prc, 6) as area_rate_prc, round(area_rate_std, 6) as area_rate_std from r""")
def change_rates(spark, sf):
    return rounded(_rates(spark, sf).select("entry_id", "num_years", "area_rate", "area_rate_prc", "area_rate_std"))


def _marked(spark, sf):
    return change.mark_noisy(_rates(spark, sf), 0.5, 0.8)


@query("a32_noise_flags", "A32", "epochs", RATES_SQL + """
select entry_id, round(snr, 6) as snr, filtered_by_unc, filtered_by_recall, filtered from n""")
def noise_flags(spark, sf):
    return rounded(_marked(spark, sf).select("entry_id", "snr", "filtered_by_unc", "filtered_by_recall", "filtered"))


@query("a32_noise_report", "A32", "epochs", RATES_SQL + """
, t as (select sum(c_acctbal) as a from customer)
select 'all' as filter, count(*) as n, round(sum(area_t0), 2) as area_t0, round(sum(area_inv) / (select a from t) * 100, 4) as coverage_prc from n
union all select 'snr', count(*), round(sum(area_t0), 2), round(sum(area_inv) / (select a from t) * 100, 4) from n where not filtered_by_unc
union all select 'recall', count(*), round(sum(area_t0), 2), round(sum(area_inv) / (select a from t) * 100, 4) from n where not filtered_by_recall
union all select 'both', count(*), round(sum(area_t0), 2), round(sum(area_inv) / (select a from t) * 100, 4) from n where not filtered""")
def noise_report(spark, sf):
    total = fx.table(spark, sf, "customer").agg(F.sum("c_acctbal")).first()[0]
    return rounded(change.noise_report(_marked(spark, sf), total), 2, coverage_prc=4)


@query("a16_regional_change", "A16", "epochs", RATES_SQL + """
select count(*) as n, round(sum(area_t0), 2) as area_t0, round(sum(area_t0_std), 2) as area_t0_std, round(sum(area_t1), 2) as area_t1, round(sum(area_t1_std), 2) as area_t1_std,
 round(sum(area_t1) - sum(area_t0), 2) as area_change, round(sqrt(pow(sum(area_t0_std), 2) + pow(sum(area_t1_std), 2)), 2) as area_change_std,
 round(sum(area_rate), 2) as area_rate, round(sum(area_rate_std), 2) as area_rate_std, round(sum(area_rate) / sum(area_t0) * 100, 6) as area_rate_prc from n where not filtered""")
def regional_change(spark, sf):
    r = change.regional_change(_marked(spark, sf).where(~F.col("filtered")))
    return rounded(r.drop("area_inv", "area_rate_std_prc"), 2, area_rate_prc=6)


INVENTORY_SQL = RATES_SQL + """
, a as (select c_custkey as entry_id, c_acctbal as area_inv, 1995 + c_custkey % 3 as year_t0 from customer),
al as (select a.entry_id, a.area_inv, a.year_t0, 2000 as year_t1, 2000 - a.year_t0 as num_years, area_t0, area_t0_std, area_t1, area_t1_std, area_rate, area_rate_std, area_rate_prc,
  coalesce(not filtered, false) as ok, case when a.area_inv >= 8000 then 5 when a.area_inv >= 4000 then 4 when a.area_inv >= 2000 then 3 when a.area_inv >= 1000 then 2 when a.area_inv >= 500 then 1 else 0 end as k
  from a left join n using (entry_id)),
m as (select k, count(*) as n, count(*) filter (where ok) as m, regr_slope(area_rate, area_inv) filter (where ok) as s, regr_intercept(area_rate, area_inv) filter (where ok) as i,
  sqrt(avg(area_rate_std * area_rate_std) filter (where ok)) as rs, sqrt(avg(area_t0_std * area_t0_std) filter (where ok)) as s0, sqrt(avg(area_t1_std * area_t1_std) filter (where ok)) as s1 from al where k >= 1 group by k),
mm as (select * from m where n > m), md as (select * from mm union all select 0, n, m, s, i, rs, s0, s1 from mm where k = 1)
"""


def _for_inventory(spark, sf):
    c = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("entry_id"), F.col("c_acctbal").alias("area_inv"), (1995 + F.col("c_custkey") % 3).alias("year_inv"))
    return change.for_inventory(_marked(spark, sf), c)


@query("a33_piecewise_extrapolation", "A33 A35 J4", "epochs", INVENTORY_SQL + """
select al.entry_id, round(s * area_inv + i, 5) as area_rate_pred, round(case when ok then area_rate else s * area_inv + i end, 5) as area_rate, round(area_rate, 5) as area_rate_orig,
  round(case when ok then area_rate_std else rs end, 5) as area_rate_std, round(case when ok then area_t0 else area_inv end, 5) as area_t0, round(case when ok then area_t0_std else s0 end, 5) as area_t0_std,
  round(case when ok then area_t1 else area_inv + (s * area_inv + i) * num_years end, 5) as area_t1, round(case when ok then area_t1_std else s1 end, 5) as area_t1_std
from al left join md on al.k = md.k""")
def piecewise_extrapolation(spark, sf):
    e = change.extrapolate(_for_inventory(spark, sf), "piecewise-linear", LIMITS)
    return rounded(e.select("entry_id", "area_rate_pred", "area_rate", "area_rate_orig", "area_rate_std", "area_t0", "area_t0_std", "area_t1", "area_t1_std"), 5)


@query("a36_fit_quality", "A36", "epochs", INVENTORY_SQL + """
select count(*) as n, round(1 - sum(pow(area_rate - (s * area_inv + i), 2)) / (count(*) * var_pop(area_rate)), 6) as r2 from al join md on al.k = md.k where ok and s is not null and not isnan(s)""")
def fit_quality(spark, sf):
    return rounded(change.fit_quality(change.extrapolate(_for_inventory(spark, sf), "piecewise-linear", LIMITS)))


@query("a34_quadratic_extrapolation", "A34 A35", "epochs", INVENTORY_SQL + """
, d as (select log10(area_inv) as x, area_rate_prc * 100 as y from al where ok and area_inv > 0 and area_rate_prc is not null),
q as (select cast(count(*) as double) n, sum(x) s1, sum(x*x) s2, sum(x*x*x) s3, sum(x*x*x*x) s4, sum(y) t0, sum(x*y) t1, sum(x*x*y) t2 from d),
z as (select *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) as dt from q),
c as (select (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / dt as a, (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / dt as b,
  (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / dt as c from z),
w as (select al.*, (a + b * log10(case when area_inv > 0 then area_inv end) + c * pow(log10(case when area_inv > 0 then area_inv end), 2)) / 100 as prc from al, c)
select entry_id, round(prc, 4) as area_rate_prc_pred, round(prc * area_inv, 4) as area_rate_pred, round(case when ok then area_rate else prc * area_inv end, 4) as area_rate from w""")
def quadratic_extrapolation(spark, sf):
    e = change.extrapolate(_for_inventory(spark, sf), "2d-polynomial", LIMITS)
    return rounded(e.select("entry_id", "area_rate_prc_pred", "area_rate_pred", "area_rate"), 4)


@query("a14_summary_by_class", "A14 P17", "epochs", """
with k as (select '[0.01, 500)' as area_class, 0 as i union all select '[500, 1000)', 1 union all select '[1000, 2000)', 2 union all select '[2000, 4000)', 3
  union all select '[4000, 8000)', 4 union all select '[8000, 20000)', 5 union all select '>= 20000', 6),
e as (select case when area_inv >= 20000 then 6 when area_inv >= 8000 then 5 when area_inv >= 4000 then 4 when area_inv >= 2000 then 3 when area_inv >= 1000 then 2 when area_inv >= 500 then 1 else 0 end as i, area_t0 from epochs)
select area_class, count(area_t0) as count, round(avg(area_t0), 4) as mean, round(stddev_samp(area_t0), 4) as std, round(min(area_t0), 4) as min,
 round(quantile_cont(area_t0, 0.25), 4) as q25, round(quantile_cont(area_t0, 0.5), 4) as q50, round(quantile_cont(area_t0, 0.75), 4) as q75, round(max(area_t0), 4) as max
from k left join e using (i) group by area_class""")
def summary_by_class(spark, sf):
    return rounded(change.describe_by_class(fx.epochs(spark, sf), "area_t0", [*LIMITS, 20000]), 4)
