"""Views over the test tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.operators.ordering import block_row_numbers, row_numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster: one entry per label, one raster row per vector, 16 columns, four bands and elevation."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("entry_id"), "vec_id", "embedding")
    e = block_row_numbers(e, ["entry_id"], "vec_id").withColumn("y", F.col("rn") - 1)
    cells = e.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15))))

    def band(k: int):
        value = F.col("embedding")[F.col("x") + 16 * k].cast("double")
        return F.floor(value * 5000 + 5000).cast("double")

    return cells.select(
        "entry_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"),
        band(0).alias("b"), band(1).alias("g"), band(2).alias("r"), band(3).alias("swir"),
        (2000 + 10 * F.col("y") + F.col("x")).cast("double").alias("dem"),
    )


def exact_mean(value: Column) -> Column:
    """Mean whose sum is exact, so equal scores tie whatever the order of rows; where decimals do not hold a value, that of doubles."""
    exact = value.try_cast("decimal(38,12)")
    mean = F.try_divide(F.try_sum(exact).cast("double"), F.count(value))
    held = F.bool_and(F.coalesce(exact.cast("double") == value, value.isNull()))
    return F.when(held, F.coalesce(mean, F.avg(value))).otherwise(F.avg(value))


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One acquisition per entry and day with its quality metrics."""
    err = F.col("event_type") == "error"
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("entry_id"), F.to_date("ts").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.when(err, F.lit(1.0)).otherwise(F.lit(0.0))).alias("cloud_p"),
            exact_mean(F.when(~err, F.col("value"))).alias("ndsi"),
        )
        .withColumn("coverage", F.least(F.lit(1.0), F.col("n").cast("double") / 3))
    )


def inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory: area and a position along an axis."""
    s = table(spark, sf_dir, "supplier")
    areas = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("area_km2"))
    return s.join(areas, s.s_suppkey == areas.l_suppkey).select(
        F.col("s_suppkey").alias("entry_id"), F.col("s_nationkey").alias("zone"),
        F.col("s_acctbal").alias("bound_lim"), "area_km2",
    )


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary truth with a pseudo-probability."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        "doc_id", F.col("lang").alias("entry_id"), F.col("quality").alias("y_true"), F.col("toxic").alias("is_sub"),
        (F.col("n_chars").cast("double") / (F.col("n_chars") + 500)).alias("p"),
    )


MEMBERS = ["b", "g", "r", "swir"]


def ens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ensemble members per cell."""
    cells = px(spark, sf_dir)
    members = F.array(*[
        F.struct(F.lit(i + 1).alias("seed"), (F.lit(1.0) / (1 + F.exp(-(F.col(b) - 5000) / 500))).alias("p"))
        for i, b in enumerate(MEMBERS)
    ])
    return cells.select("entry_id", "y", "x", F.inline(members))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs per entry with uncertainty; means are whole cents, so no sum of doubles decides a last digit."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    early = F.year("o_orderdate") <= 1997

    def mean(of):
        cents = F.sum(F.when(of, F.round(F.col("o_totalprice") * 100).cast("bigint")))
        return F.call_function("div", cents, F.nullif(F.count(F.when(of, 1)), F.lit(0))) / 100

    per = o.groupBy("o_custkey").agg(
        mean(early).alias("area_t0"),
        F.stddev_samp(F.when(early, F.col("o_totalprice"))).alias("area_t0_std"),
        mean(~early).alias("area_t1"),
        F.stddev_samp(F.when(~early, F.col("o_totalprice"))).alias("area_t1_std"),
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return per.join(c, per.o_custkey == c.c_custkey).select(
        F.col("o_custkey").alias("entry_id"), F.col("c_acctbal").alias("area_inv"),
        "area_t0", "area_t0_std", "area_t1", "area_t1_std",
        F.lit(1996).alias("year_t0"), F.lit(2000).alias("year_t1"),
    )


def poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square outlines with closed-form area, overlap and containment."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("entry_id"),
        ((F.col("s_suppkey") % 10) * 300).cast("double").alias("cx"),
        (F.floor(F.col("s_suppkey") / 10) * 300).cast("double").alias("cy"),
        (100 + (F.col("s_nationkey") % 5) * 20).cast("double").alias("half"),
    )
    return s.withColumn("rings", square_rings())


def square_rings():
    """One square ring around (cx, cy) with half side ``half``."""
    def corner(sx: int, sy: int):
        return F.struct(
            (F.col("cx") + sx * F.col("half")).alias("x"), (F.col("cy") + sy * F.col("half")).alias("y")
        )

    return F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))


def lpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large raster for timing: order lines of a supplier laid out 32 cells wide."""
    order = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", *order)
    rn = F.col("rn")
    return row_numbers(li, ["l_suppkey"], order).select(
        F.col("l_suppkey").alias("entry_id"),
        F.floor((rn - 1) / 32).cast("bigint").alias("y"), ((rn - 1) % 32).cast("bigint").alias("x"),
        F.floor(F.col("l_extendedprice") / 10).cast("double").alias("b"),
        (F.col("l_quantity") * 200).alias("g"), (F.col("l_discount") * 100000).alias("r"),
        (F.col("l_tax") * 100000).alias("swir"),
    )


SQL = {
    "px": """
    select entry_id, cast(y as bigint) as y, cast(x as bigint) as x,
           floor(cast(embedding[x + 1] as double) * 5000 + 5000) as b,
           floor(cast(embedding[x + 17] as double) * 5000 + 5000) as g,
           floor(cast(embedding[x + 33] as double) * 5000 + 5000) as r,
           floor(cast(embedding[x + 49] as double) * 5000 + 5000) as swir,
           cast(2000 + 10 * y + x as double) as dem
    from (select label as entry_id, embedding, row_number() over (partition by label order by vec_id) - 1 as y
          from embeddings) e
    cross join (select unnest(range(16)) as x) g""",
    "img": """
    select user_id as entry_id, cast(ts as date) as date, count(*) as n,
           avg(case when event_type = 'error' then cast(1 as double) else cast(0 as double) end) as cloud_p,
           avg(case when event_type <> 'error' then value end) as ndsi,
           least(cast(1 as double), cast(count(*) as double) / 3) as coverage
    from events group by user_id, cast(ts as date)""",
    "inv": """
    select s_suppkey as entry_id, s_nationkey as zone, s_acctbal as bound_lim, sum(l_quantity) as area_km2
    from supplier join lineitem on s_suppkey = l_suppkey
    group by s_suppkey, s_nationkey, s_acctbal""",
    "prob": """
    select l.doc_id, d.lang as entry_id, l.quality as y_true, l.toxic as is_sub,
           cast(d.n_chars as double) / (d.n_chars + 500) as p
    from labels l join documents d on l.doc_id = d.doc_id""",
    "ens": """
    select entry_id, y, x, 1 as seed, cast(1 as double) / (1 + exp(-(b - 5000) / 500)) as p from px
    union all select entry_id, y, x, 2, cast(1 as double) / (1 + exp(-(g - 5000) / 500)) from px
    union all select entry_id, y, x, 3, cast(1 as double) / (1 + exp(-(r - 5000) / 500)) from px
    union all select entry_id, y, x, 4, cast(1 as double) / (1 + exp(-(swir - 5000) / 500)) from px""",
    "epochs": """
    select o_custkey as entry_id, c_acctbal as area_inv,
           cast(sum(case when year(o_orderdate) <= 1997 then cast(round(o_totalprice * 100) as bigint) end) // nullif(count(case when year(o_orderdate) <= 1997 then 1 end), 0) as double) / 100 as area_t0,
           stddev_samp(case when year(o_orderdate) <= 1997 then o_totalprice end) as area_t0_std,
           cast(sum(case when year(o_orderdate) > 1997 then cast(round(o_totalprice * 100) as bigint) end) // nullif(count(case when year(o_orderdate) > 1997 then 1 end), 0) as double) / 100 as area_t1,
           stddev_samp(case when year(o_orderdate) > 1997 then o_totalprice end) as area_t1_std,
           1996 as year_t0, 2000 as year_t1
    from orders join customer on o_custkey = c_custkey
    group by o_custkey, c_acctbal""",
    "poly": """
    select s_suppkey as entry_id,
           cast((s_suppkey % 10) * 300 as double) as cx,
           cast(floor(s_suppkey / 10) * 300 as double) as cy,
           cast(100 + (s_nationkey % 5) * 20 as double) as half
    from supplier""",
    "lpx": """
    select entry_id, cast(floor((rn - 1) / 32) as bigint) as y, cast((rn - 1) % 32 as bigint) as x,
           cast(floor(l_extendedprice / 10) as double) as b, l_quantity * 200 as g,
           l_discount * 100000 as r, l_tax * 100000 as swir
    from (select l_suppkey as entry_id, l_extendedprice, l_quantity, l_discount, l_tax,
                 row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber,
                                    l_quantity, l_extendedprice, l_discount, l_tax) as rn
          from lineitem) t""",
}
NEEDS = {"ens": ["px"]}


def with_views(views: list[str], body: str, recursive: bool = False) -> str:
    """Prefix a statement with the views it uses; a body may open its own ``with``."""
    ordered: list[str] = []
    for v in views:
        for n in [*NEEDS.get(v, []), v]:
            if n not in ordered:
                ordered.append(n)
    ctes = [f"{v} as materialized ({SQL[v]}\n)" for v in ordered]
    body = body.strip()
    if body.lower().startswith("with recursive "):
        recursive, body = True, body[len("with recursive "):]
        tail = ",\n" + body if ctes else body
    elif body.lower().startswith("with "):
        body = body[len("with "):]
        tail = ",\n" + body if ctes else body
    else:
        if not ctes:
            return body
        tail = "\n" + body
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(ctes) + tail
