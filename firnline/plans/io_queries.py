"""Source, sink and entry-function queries; tables go through the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.operators import pixels
from firnline.operators.entry_functions import map_entries
from firnline.plans import fixtures as fx
from firnline.plans.registry import query, rounded
from firnline.session import scratch_dir
from firnline.sources import readers, writers

CELL = ["entry_id", "y", "x"]


def _path(spark) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def _layers(spark, sf):
    c = fx.px(spark, sf)
    one = c.where("b >= 5400").select(F.lit("glacier_sel").alias("layer"), *CELL)
    return one.unionByName(c.where("g >= 5400").select(F.lit("buffer_fp").alias("layer"), *CELL))


@query("s1_layer_scan", "S1 S10", "px", "select entry_id, y, x from px where g >= 5400")
def layer_scan(spark, sf):
    path = _path(spark)
    writers.write_layers(_layers(spark, sf), path)
    return readers.read_layer(spark, path, "buffer_fp")


@query("s10_layered_table", "S10", "px", """
select 'glacier_sel' as layer, entry_id, count(*) as n from px where b >= 5400 group by entry_id
union all select 'buffer_fp', entry_id, count(*) from px where g >= 5400 group by entry_id""")
def layered_table(spark, sf):
    path = _path(spark)
    writers.write_layers(_layers(spark, sf), path)
    return spark.read.parquet(path).groupBy("layer", "entry_id").agg(F.count(F.lit(1)).alias("n"))


@query("s2_keyed_csv", "S2 S11", "inv", "select entry_id, area_km2, bound_lim from inv")
def keyed_csv(spark, sf):
    path = _path(spark)
    writers.write_csv(fx.inv(spark, sf).select("entry_id", "area_km2", "bound_lim"), path)
    schema = T.StructType([
        T.StructField("entry_id", T.LongType()), T.StructField("area_km2", T.DoubleType()), T.StructField("bound_lim", T.DoubleType())])
    return readers.read_keyed_csv(spark, path, schema)


@query("s11_json_result", "S11 X24", "inv", "select entry_id, area_km2, zone from inv")
def json_result(spark, sf):
    path = _path(spark)
    writers.write_json(fx.inv(spark, sf).select("entry_id", "area_km2", "zone"), path)
    return spark.read.schema("entry_id bigint, area_km2 double, zone int").json(path)


@query("x24_json_text", "X24", "", """
select s_suppkey as entry_id, '{"zone":' || s_nationkey || ',"name":"' || s_name || '"}' as stats from supplier""")
def json_text(spark, sf):
    s = fx.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("entry_id"), F.to_json(F.struct(
        F.col("s_nationkey").alias("zone"), F.col("s_name").alias("name"))).alias("stats"))


@query("s3_file_discovery", "S3", "", """
select distinct 'year=' || year(o_orderdate) as year, 'entry=' || o_orderstatus as entry_id from orders""")
def file_discovery(spark, sf):
    path = _path(spark)
    o = fx.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("entry"), "o_orderkey")
    o.write.partitionBy("year", "entry").parquet(path)
    return readers.discover_files(spark, path, "*.parquet").where("length > 0").select("year", "entry_id").distinct()


@query("s4_cell_scan", "S4", "px", "select entry_id, sum(b) as total from px where entry_id in (select distinct label from embeddings where vec_id % 50 = 7) group by entry_id")
def cell_scan(spark, sf):
    path = _path(spark)
    writers.write_cells(fx.px(spark, sf).withColumn("year", F.lit(2023)), path)
    wanted = fx.table(spark, sf, "embeddings").where("vec_id % 50 = 7").select(F.col("label").alias("entry_id")).distinct()
    return readers.read_cells(spark, path, [*CELL, "b"], wanted).groupBy("entry_id").agg(F.sum("b").alias("total"))


@query("s7_existing_output", "S7", "inv", "select entry_id, area_km2 from inv")
def existing_output(spark, sf):
    path = _path(spark)
    i = fx.inv(spark, sf).select("entry_id", "area_km2")
    writers.write_table(i.withColumn("area_km2", F.lit(0.0)), path, "error")
    writers.write_table(i, path, "overwrite")
    writers.write_table(i.withColumn("area_km2", F.lit(-1.0)), path, "skip")
    return spark.read.parquet(path)


@query("s7_resumed_entries", "S7 A1", "px", """
select entry_id, count(*) as n, sum(b) as total, case when avg(b) >= 5000 then 'first' else 'second' end as computed from px group by entry_id""")
def resumed_entries(spark, sf):
    """A first run over part of the entries, one killed before its manifest, and one over all."""
    path, cells = _path(spark), fx.px(spark, sf)

    def totals(name):
        return lambda todo: cells.join(todo, "entry_id", "left_semi").groupBy("entry_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("b").alias("total")).withColumn("computed", F.lit(name))

    bright = cells.groupBy("entry_id").agg(F.avg("b").alias("mean"))
    writers.write_missing(bright.where("mean >= 5000").select("entry_id"), path, totals("first"))
    totals("killed")(bright.select("entry_id")).write.parquet(f"{path}/rows/run=killed")
    return writers.write_missing(bright.select("entry_id"), path, totals("second"), rounds=2)


@query("s8_cached_partials", "S8 A1", "px", """
select entry_id, 'b' as var_name, count(b) as n, sum(b) as sum_1, sum(b * b) as sum_2, min(b) as vmin, max(b) as vmax from px group by entry_id""")
def cached_partials(spark, sf):
    path = _path(spark)

    def compute():
        return pixels.norm_partials(fx.px(spark, sf), ["entry_id"], ["b"])

    readers.read_or_compute(spark, path, compute)
    return readers.read_or_compute(spark, path, lambda: compute().limit(0))


@query("s9_partitioned_cells", "S9", "px", """
select cast(2015 + entry_id % 3 as integer) as year, entry_id, y, x, b from px""")
def partitioned_cells(spark, sf):
    path = _path(spark)
    writers.write_cells(fx.px(spark, sf).select(*CELL, "b", (2015 + F.col("entry_id") % 3).cast("int").alias("year")), path)
    return spark.read.parquet(path).select("year", *CELL, "b")


def describe_entry(entry_id: int, zone: int, area_km2: float, scale: float) -> dict:
    """Example of a user function with a broadcast constant; fails for one zone."""
    if zone == 3:
        raise ValueError("no data")
    return {"scaled": area_km2 * scale}


@query("d1_entry_function", "D1", "inv", """
select entry_id, case when zone <> 3 then round(area_km2 * 0.5, 6) end as scaled, case when zone = 3 then 'ValueError: no data' end as error from inv""")
def entry_function(spark, sf):
    args = fx.inv(spark, sf).select("entry_id", "zone", "area_km2")
    schema = T.StructType([T.StructField("scaled", T.DoubleType())])
    return rounded(map_entries(args, describe_entry, schema, constants={"scale": 0.5}, continue_on_error=True))


@query("l4_sorted_entries", "L4", "", "select c_custkey as entry_id, c_mktsegment from customer order by c_custkey")
def sorted_entries(spark, sf):
    return fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), "c_mktsegment").orderBy("entry_id")


@query("l5_preview_of_missing", "L5", "img", """
select c_custkey as entry_id from customer where c_custkey not in (select entry_id from img) order by c_custkey limit 10""")
def preview_of_missing(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"))
    return c.join(fx.img(spark, sf).select("entry_id"), "entry_id", "left_anti").orderBy("entry_id").limit(10)
