"""Regional roll-ups, change rates, their noise flags and extrapolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.evaluate import describe
from firnline.operators.inventory import every_inventory_row

# Area classes (km2, after Paul et al. 2020), the lower label, and the floor of a rate's deviation.
AREA_CLASSES = [0.1, 0.2, 0.5, 1, 2, 5, 10, 20]
LOWEST_AREA = 0.01
MIN_RATE_STD = 1e-9


def class_labels(limits: list[float] | None = None) -> list[str]:
    """Labels of the low class, the half-open classes and the open last one."""
    limits = limits or AREA_CLASSES
    inner = [f"[{a}, {b})" for a, b in zip(limits, limits[1:])]
    return [f"[{LOWEST_AREA}, {limits[0]})", *inner, f">= {limits[-1]}"]


def class_index(area: Column, limits: list[float] | None = None) -> Column:
    """Number of limits at or below the area: 0 is the low class."""
    limits = limits or AREA_CLASSES
    out = F.lit(0)
    for i, t in enumerate(limits):
        out = F.when(area >= F.lit(float(t)), F.lit(i + 1)).otherwise(out)
    return F.when(area.isNotNull(), out)


def with_area_class(df: DataFrame, area: str = "area_inv", limits: list[float] | None = None) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in class_labels(limits)])
    return df.withColumn("area_class", F.get(labels, class_index(F.col(area), limits)))


def regional_areas(stats: DataFrame, ring: str = "b20_50", uncertainties: bool = False) -> DataFrame:
    """One row of totals; percentages are ratios of sums, errors add up linearly."""
    total = {
        "area_ok": "area_ok", "area_nok": "area_nok", "area_inv": "area_inv", "area_recalled": "area_recalled",
        "area_pred": "area_pred", "area_fp": f"area_non_g_{ring}", "area_fp_pred": f"area_non_g_pred_{ring}",
        "area_debris": "area_debris", "area_debris_recalled": "area_debris_recalled",
    }
    errors = {k: f"{total[k]}_std" for k in ("area_recalled", "area_pred", "area_fp_pred", "area_debris_recalled")}
    sums = [F.sum(c).alias(k) for k, c in total.items()]
    sums += [(F.sum(c) if uncertainties else F.lit(None).cast("double")).alias(f"{k}_std") for k, c in errors.items()]
    t = stats.agg(F.count(F.lit(1)).alias("n"), *sums)

    def percent(a: str, b: str) -> Column:
        return F.try_divide(F.col(a), F.col(b)) * 100

    return t.withColumns({
        "ok_prc": percent("area_ok", "area_inv"), "recall_prc": percent("area_recalled", "area_inv"),
        "recall_std_prc": percent("area_recalled_std", "area_inv"), "fp_prc": percent("area_fp_pred", "area_fp"),
        "fp_std_prc": percent("area_fp_pred_std", "area_fp"), "debris_prc": percent("area_debris", "area_inv"),
        "recall_debris_prc": percent("area_debris_recalled", "area_debris"),
        "recall_debris_std_prc": percent("area_debris_recalled_std", "area_debris"),
    })


def change_rates(t0: DataFrame, t1: DataFrame, check: bool = True) -> DataFrame:
    """Annual rate of every entry between two epochs, with its uncertainty.

    Both epochs must hold the same entries; errors of the epochs are independent.
    """
    a = t0.select("entry_id", "area_inv", "recall", F.col("area_pred").alias("area_t0"),
                  F.col("area_pred_std").alias("area_t0_std"), F.col("year").alias("year_t0"))
    b = t1.select("entry_id", F.col("area_pred").alias("area_t1"), F.col("area_pred_std").alias("area_t1_std"),
                  F.col("year").alias("year_t1"))
    if check:
        seen = a.select("entry_id", F.lit(1).alias("e")).unionByName(b.select("entry_id", F.lit(2).alias("e")))
        per = seen.groupBy("entry_id").agg(F.sum("e").alias("s"), F.count(F.lit(1)).alias("n"))
        if not per.where("s <> 3 or n <> 2").isEmpty():
            raise ValueError("the two epochs hold different entries")
    return with_rates(a.join(b, "entry_id"))


def with_rates(epochs: DataFrame) -> DataFrame:
    years = F.col("year_t1") - F.col("year_t0")
    rate = F.try_divide(F.col("area_t1") - F.col("area_t0"), F.col("num_years"))
    std = F.sqrt(F.col("area_t0_std") * F.col("area_t0_std") + F.col("area_t1_std") * F.col("area_t1_std"))
    return epochs.withColumn("num_years", years).withColumns({
        "area_rate": rate, "area_rate_prc": F.try_divide(rate, F.col("area_t0")), "area_rate_std": F.try_divide(std, F.col("num_years")),
    })


def regional_change(rates: DataFrame, check: bool = True) -> DataFrame:
    """Totals of both epochs and of the rates.

    Errors add up linearly within an epoch and in quadrature across the two.
    """
    r = rates.agg(
        F.count(F.lit(1)).alias("n"), F.sum("area_inv").alias("area_inv"),
        F.sum("area_t0").alias("area_t0"), F.sum("area_t0_std").alias("area_t0_std"),
        F.sum("area_t1").alias("area_t1"), F.sum("area_t1_std").alias("area_t1_std"),
        F.sum("area_rate").alias("area_rate"), F.sum("area_rate_std").alias("area_rate_std"),
        F.sum(F.col("area_rate") * F.col("num_years")).alias("_check"),
    ).withColumns({
        "area_change": F.col("area_t1") - F.col("area_t0"),
        "area_change_std": F.sqrt(F.col("area_t0_std") * F.col("area_t0_std") + F.col("area_t1_std") * F.col("area_t1_std")),
        "area_rate_prc": F.try_divide("area_rate", "area_t0") * 100,
        "area_rate_std_prc": F.try_divide("area_rate_std", "area_t0") * 100,
    })
    if check:
        row = r.select("_check", "area_change").first()
        if row[0] is not None and abs(row[0] - row[1]) > 1e-8 + 1e-5 * abs(row[1]):
            raise ValueError("rates do not add up to the change of area")
    return r.drop("_check")


def mark_noisy(rates: DataFrame, min_snr: float = 1.0, recall_thr: float = 0.8) -> DataFrame:
    """Signal-to-noise ratio and the flags of rates that fail it, the recall, or either."""
    snr = F.abs("area_rate") / F.greatest(F.col("area_rate_std"), F.lit(MIN_RATE_STD))
    by_unc = ~F.coalesce(F.col("snr") >= min_snr, F.lit(False))
    by_recall = ~F.coalesce(F.col("recall") >= recall_thr, F.lit(False))
    return rates.withColumn("snr", F.when(F.col("area_rate_std").isNotNull(), snr)).withColumns({
        "filtered_by_unc": by_unc, "filtered_by_recall": by_recall, "filtered": by_unc | by_recall,
    })


def noise_report(marked: DataFrame, inventory_area: float) -> DataFrame:
    """Count, area and area coverage of the rates that pass each filter."""
    tests = {"all": F.lit(True), "snr": ~F.col("filtered_by_unc"), "recall": ~F.col("filtered_by_recall"), "both": ~F.col("filtered")}
    aggs = []
    for k, ok in tests.items():
        aggs.append(F.struct(
            F.lit(k).alias("filter"), F.count(F.when(ok, 1)).alias("n"), F.sum(F.when(ok, F.col("area_t0"))).alias("area_t0"),
            (F.try_divide(F.sum(F.when(ok, F.col("area_inv"))), F.lit(float(inventory_area))) * 100).alias("coverage_prc"),
        ).alias(k))
    return marked.agg(*aggs).select(F.inline(F.array(*tests)))


def for_inventory(rates: DataFrame, inventory: DataFrame, year_t1: int | None = None) -> DataFrame:
    """Rates of all inventory entries, NULL where there is none; years from the inventory.

    Without ``year_t1`` all rates must share one second year.
    """
    if year_t1 is None:
        years = [r[0] for r in rates.select("year_t1").distinct().limit(2).collect()]
        if len(years) != 1:
            raise ValueError("more than one second year")
        year_t1 = years[0]
    inv = inventory.select("entry_id", "area_inv", F.col("year_inv").alias("year_t0"))
    out = every_inventory_row(rates.drop("area_inv", "year_t0", "year_t1", "num_years"), inv)
    return out.withColumn("year_t1", F.lit(year_t1)).withColumn("num_years", F.col("year_t1") - F.col("year_t0"))


def _ok() -> Column:
    return F.coalesce(~F.col("filtered"), F.lit(False))


def class_models(rates: DataFrame, limits: list[float] | None = None, linear: bool = True) -> DataFrame:
    """Line ``rate ~ area`` and mean-square deviations of every class.

    A class whose entries are all covered gets no model. The low class borrows the model
    of the class above it. At most one row per class.
    """
    ok, n = _ok(), F.col("_n")
    x, y = F.when(ok, F.col("area_inv")), F.when(ok, F.col("area_rate"))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)

    def rms(c: str) -> Column:
        return F.sqrt(F.avg(F.when(ok, F.col(c) * F.col(c))))

    per = rates.withColumn("_class", class_index(F.col("area_inv"), limits)).where(F.col("_class") >= 1).groupBy("_class").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(ok.cast("int")).alias("_k"),
        (F.regr_slope(y, x) if linear else F.lit(None).cast("double")).alias("slope"),
        (F.regr_intercept(y, x) if linear else F.lit(None).cast("double")).alias("intercept"),
        rms("area_rate_std").alias("area_rate_pred_std"), rms("area_t0_std").alias("area_t0_pred_std"),
        rms("area_t1_std").alias("area_t1_pred_std"),
    ).where(n > F.col("_k"))
    used = F.when(F.col("_class") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array("_class"))
    return per.withColumn("_class", F.explode(used)).drop("_n", "_k")


def quadratic_model(rates: DataFrame) -> tuple[float, float, float] | None:
    """Least squares of the percent rate on 1, log10(area) and its square.

    One pass of moment sums; the 3x3 normal equations are solved from one row.
    """
    keep = _ok() & (F.col("area_inv") > 0) & F.col("area_rate_prc").isNotNull()
    x = F.log10(F.when(F.col("area_inv") > 0, F.col("area_inv")))
    d = rates.where(keep).select(x.alias("x"), (F.col("area_rate_prc") * 100).alias("y"))
    m = d.agg(
        F.count(F.lit(1)).cast("double"), *[F.sum(F.pow("x", F.lit(float(k)))) for k in (1, 2, 3, 4)],
        *[F.sum(F.col("y") * F.pow("x", F.lit(float(k)))) for k in (0, 1, 2)],
    ).first()
    if not m[0]:
        return None
    n, s1, s2, s3, s4, t0, t1, t2 = m

    def det(a, b, c, d_, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d_ * i - f * g) + c * (d_ * h - e * g)

    base = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    if base == 0:
        return None
    return (
        det(t0, s1, s2, t1, s2, s3, t2, s3, s4) / base,
        det(n, t0, s2, s1, t1, s3, s2, t2, s4) / base,
        det(n, s1, t0, s1, s2, t1, s2, s3, t2) / base,
    )


def extrapolate(rates: DataFrame, model: str = "piecewise-linear", limits: list[float] | None = None) -> DataFrame:
    """Predict the rates of all entries and fill in those that are missing or filtered.

    ``rates`` holds every inventory entry (see ``for_inventory``). Originals stay in
    ``*_orig`` columns.
    """
    if model not in ("piecewise-linear", "2d-polynomial"):
        raise ValueError("model must be 'piecewise-linear' or '2d-polynomial'")
    linear = model == "piecewise-linear"
    models = class_models(rates, limits, linear)
    placed = with_area_class(rates, "area_inv", limits).withColumn("_class", class_index(F.col("area_inv"), limits))
    out = placed.join(F.broadcast(models), "_class", "left")
    if linear:
        out = out.withColumn("area_rate_pred", F.col("intercept") + F.col("slope") * F.col("area_inv"))
        out = out.withColumn("area_rate_prc_pred", F.try_divide("area_rate_pred", "area_inv"))
    else:
        c = quadratic_model(rates)
        x = F.log10(F.when(F.col("area_inv") > 0, F.col("area_inv")))
        prc = (F.lit(c[0]) + F.lit(c[1]) * x + F.lit(c[2]) * x * x) / 100 if c else F.lit(None).cast("double")
        out = out.withColumn("area_rate_prc_pred", prc)
        out = out.withColumn("area_rate_pred", F.col("area_rate_prc_pred") * F.col("area_inv"))
    filled = ["area_t0", "area_t0_std", "area_t1", "area_t1_std", "area_rate", "area_rate_std"]
    out = out.withColumns({f"{k}_orig": F.col(k) for k in filled})
    gap = ~_ok()

    def fill(column: str, value: Column) -> Column:
        return F.when(gap, value).otherwise(F.col(column))

    out = out.withColumns({
        "area_rate": fill("area_rate", F.col("area_rate_pred")),
        "area_rate_std": fill("area_rate_std", F.col("area_rate_pred_std")),
        "area_t0": fill("area_t0", F.col("area_inv")), "area_t0_std": fill("area_t0_std", F.col("area_t0_pred_std")),
        "area_t1_std": fill("area_t1_std", F.col("area_t1_pred_std")),
    })
    out = out.withColumn("area_t1", fill("area_t1", F.col("area_t0") + F.col("area_rate") * F.col("num_years")))
    return out.drop("_class", "slope", "intercept")


def fit_quality(extrapolated: DataFrame) -> DataFrame:
    """R squared over the rows the model was fitted on."""
    y, p = F.col("area_rate"), F.col("area_rate_pred")
    used = extrapolated.where(_ok() & p.isNotNull() & y.isNotNull())
    rss = F.sum((y - p) * (y - p))
    return used.agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(rss, F.count(F.lit(1)) * F.var_pop(y))).alias("r2"))


def describe_by_class(rates: DataFrame, value: str = "area_rate_prc", limits: list[float] | None = None) -> DataFrame:
    """Summary of a column per area class; classes without entries appear with count 0."""
    spark = rates.sparkSession
    classes = spark.createDataFrame([(x,) for x in class_labels(limits)], "area_class string")
    d = describe(with_area_class(rates, "area_inv", limits), ["area_class"], value)
    return d.join(F.broadcast(classes), "area_class", "right").withColumn("count", F.coalesce("count", F.lit(0)))
