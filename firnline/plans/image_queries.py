"""Catalogue and image-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.functions import naming, spectral
from firnline.operators import catalogue, images, pixels
from firnline.plans import fixtures as fx
from firnline.plans.registry import query, rounded
from firnline.tables import missing_to_null

RANKED_SQL = """
with f as (select * from img where coverage >= 0.3 and cloud_p <= 0.5),
m as (select entry_id, min(cloud_p) c0, max(cloud_p) c1, min(ndsi) n0, max(ndsi) n1 from f group by entry_id),
s as (select f.*, 1 - (cloud_p - c0) / (case when c1 - c0 = 0 then 1 else c1 - c0 end) as score_cloud_p,
             1 - (ndsi - n0) / (case when n1 - n0 = 0 then 1 else n1 - n0 end) as score_ndsi
      from f join m using (entry_id)),
q as (select *, 0.5 * score_cloud_p + 0.5 * score_ndsi as score from s),
ranked as (select *, row_number() over (partition by entry_id order by score desc nulls last, date) as rank from q)
"""


def _ranked(spark, sf):
    return images.rank_usable(fx.img(spark, sf), ["cloud_p", "ndsi"], None, 0.3, 0.5)


@query("best_image_per_entry", "A5 A6 P12 W1 W2 L1 L2 S1", "img", RANKED_SQL + """
select entry_id, date, round(coverage, 6) as coverage, round(cloud_p, 6) as cloud_p, round(ndsi, 6) as ndsi,
       round(score, 6) as score from ranked where rank = 1""")
def best_image(spark, sf):
    top = images.best_per_entry(_ranked(spark, sf))
    return rounded(top.select("entry_id", "date", "coverage", "cloud_p", "ndsi", "score"))


@query("w1_image_scores", "W1 P12", "img", RANKED_SQL + """
select entry_id, date, round(score_cloud_p, 6) as score_cloud_p, round(score_ndsi, 6) as score_ndsi,
       round(score, 6) as score from q""")
def image_scores(spark, sf):
    usable = images.keep_usable(fx.img(spark, sf), 0.3, 0.5)
    s = images.score(usable, ["cloud_p", "ndsi"])
    return rounded(s.select("entry_id", "date", "score_cloud_p", "score_ndsi", "score"))


@query("w2_ranked_images", "W2", "img", RANKED_SQL + """
select entry_id, date, cast(rank as integer) as rank, round(score, 6) as score from ranked""")
def ranked_images(spark, sf):
    return rounded(_ranked(spark, sf).select("entry_id", "date", "rank", "score"))


@query("w1_weighted_scores", "W1", "img", """
with m as (select entry_id, min(cloud_p) c0, max(cloud_p) c1, min(coverage) v0, max(coverage) v1 from img group by entry_id)
select entry_id, date,
       round(0.75 * (1 - (cloud_p - c0) / (case when c1 - c0 = 0 then 1 else c1 - c0 end))
           + 0.25 * (1 - (coverage - v0) / (case when v1 - v0 = 0 then 1 else v1 - v0 end)), 6) as score
from img join m using (entry_id)""")
def weighted_scores(spark, sf):
    s = images.score(fx.img(spark, sf), ["cloud_p", "coverage"], [3, 1])
    return rounded(s.select("entry_id", "date", "score"))


@query("l1_three_best_days", "L1 L2", "img", RANKED_SQL + """
select entry_id, date, cast(rank as integer) as rank from ranked where rank <= 3""")
def three_best(spark, sf):
    return images.best_per_entry(_ranked(spark, sf), 3).select("entry_id", "date", "rank")


def _entry_dates(spark, sf):
    i = fx.img(spark, sf).select("entry_id").distinct()
    given = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("entry_id") % 40).cast("int"))
    return i.withColumn("date_acq", F.when(F.col("entry_id") % 3 != 0, given))


@query("w7_assigned_images", "W7 J2", "img", """
with d as (select distinct entry_id, case when entry_id % 3 <> 0
                  then cast('2024-01-01' as date) + cast(entry_id % 40 as integer) end as date_acq from img),
m as (select entry_id, min(cloud_p) c0, max(cloud_p) c1 from img group by entry_id),
s as (select img.*, 1 - (cloud_p - c0) / (case when c1 - c0 = 0 then 1 else c1 - c0 end) as score from img join m using (entry_id)),
r as (select s.*, row_number() over (partition by entry_id order by score desc nulls last, date) as rn
      from s join d using (entry_id) where d.date_acq is null or s.date = d.date_acq)
select entry_id, date, round(score, 6) as score from r where rn = 1""")
def assigned_images(spark, sf):
    scored = images.score(fx.img(spark, sf), ["cloud_p"])
    return rounded(images.assign(scored, _entry_dates(spark, sf)).select("entry_id", "date", "score"))


@query("s5_catalogue_scan", "S5", "img", """
select entry_id, date, n from img where date >= date '2024-01-05' and date < date '2024-01-12'
 and (entry_id % 10) * 100 <= 500 and (entry_id % 10) * 100 + 150 >= 300""")
def catalogue_scan(spark, sf):
    x0 = ((F.col("entry_id") % 10) * 100).cast("double")
    box = F.struct(x0.alias("minx"), F.lit(0.0).alias("miny"), (x0 + 150).alias("maxx"), F.lit(1.0).alias("maxy"))
    bounds = F.struct(
        F.lit(300.0).alias("minx"), F.lit(0.0).alias("miny"), F.lit(500.0).alias("maxx"), F.lit(1.0).alias("maxy")
    )
    found = catalogue.scan(fx.img(spark, sf).withColumn("box", box), "2024-01-05", "2024-01-12", bounds)
    return found.select("entry_id", "date", "n")


SCENES_SQL = """
with raw as (select user_id as entry_id, strftime(ts, '%Y%m%d') || 'T1_' || lpad(cast(event_id as varchar), 12, '0') || '_' || event_type as scene_id,
               least(cast(1 as double), value / 40) as coverage, event_id % 4 as cell, value from events),
scenes as (select *, cast(strptime(substr(scene_id, 1, 8), '%Y%m%d') as date) as date,
                  split_part(scene_id, '_', 2) as processing_time, split_part(scene_id, '_', 3) as tile from raw),
latest as (select * from (select *, row_number() over (partition by entry_id, date, tile order by processing_time desc, scene_id) as rn
           from scenes) where rn = 1),
full_tiles as (select * from (select *, row_number() over (partition by entry_id, date order by processing_time desc, tile) as rn2
           from latest where coverage >= 0.98) where rn2 = 1),
partial_tiles as (select l.* from latest l left join full_tiles f on l.entry_id = f.entry_id and l.date = f.date where f.date is null)
"""


def _scenes(spark, sf):
    e = fx.table(spark, sf, "events")
    scene = F.concat_ws(
        "_", F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("T1")),
        F.lpad(F.col("event_id").cast("string"), 12, "0"), "event_type",
    )
    raw = e.select(
        F.col("user_id").alias("entry_id"), scene.alias("scene_id"),
        F.least(F.lit(1.0), F.col("value") / 40).alias("coverage"), (F.col("event_id") % 4).alias("cell"), "value",
    )
    return catalogue.parse_scene_ids(raw)


@query("s6_scene_ids", "S6 X17", "", SCENES_SQL + "select scene_id, date, processing_time, tile from scenes")
def scene_ids(spark, sf):
    return _scenes(spark, sf).select("scene_id", "date", "processing_time", "tile")


@query("w3_latest_reprocessing", "W3", "", SCENES_SQL + "select entry_id, date, tile, scene_id from latest")
def latest(spark, sf):
    return catalogue.latest_reprocessing(_scenes(spark, sf)).select("entry_id", "date", "tile", "scene_id")


@query("w4_full_tile_per_day", "W4", "", SCENES_SQL + "select entry_id, date, tile, scene_id from full_tiles")
def full_tile(spark, sf):
    return catalogue.full_tile_per_day(catalogue.latest_reprocessing(_scenes(spark, sf))).select(
        "entry_id", "date", "tile", "scene_id"
    )


def _partial(spark, sf):
    recent = catalogue.latest_reprocessing(_scenes(spark, sf))
    return catalogue.scenes_needing_mosaic(recent, catalogue.full_tile_per_day(recent))


@query("w5_day_mosaics", "W5 U3", "", SCENES_SQL + """
select entry_id, date, cell, arg_max(value, processing_time) as value from partial_tiles group by entry_id, date, cell""")
def day_mosaics(spark, sf):
    return catalogue.mosaic_cells(_partial(spark, sf), ["value"], ["entry_id", "date", "cell"], "processing_time")


@query("w5_mosaic_coverage", "W5 A8", "", SCENES_SQL + """
, m as (select entry_id, date, cell, arg_max(value, processing_time) as value from partial_tiles group by entry_id, date, cell)
select entry_id, date, round(sum(case when value >= 5 then 1.0 else 0.0 end) * 100 / 400, 6) as coverage from m group by entry_id, date""")
def mosaic_coverage(spark, sf):
    m = catalogue.mosaic_cells(_partial(spark, sf), ["value"], ["entry_id", "date", "cell"], "processing_time")
    return rounded(catalogue.covered_share(m, ["entry_id", "date"], F.col("value") >= 5, 10.0, F.lit(400.0)))


@query("x22_mosaic_metadata", "X22 W5", "", SCENES_SQL + """
select entry_id, date, string_agg(scene_id, '-' order by scene_id) as image_id, string_agg(tile, ',' order by scene_id) as tiles,
       round(list(coverage order by scene_id)[1], 6) as first_coverage, count(*) as n_tiles
from partial_tiles group by entry_id, date""")
def mosaic_metadata(spark, sf):
    m = catalogue.mosaic_metadata(_partial(spark, sf))
    first = F.element_at("metadata_tiles", F.element_at(F.array_sort(F.map_keys("metadata_tiles")), 1))["coverage"]
    return rounded(m.select(
        "entry_id", "date", "image_id", F.array_join("tiles", ",").alias("tiles"), first.alias("first_coverage"),
        F.size("tiles").cast("bigint").alias("n_tiles"),
    ))


@query("u1_one_image_per_day", "U1 W5", "", SCENES_SQL + """
select entry_id, date, scene_id as image_id from full_tiles
union all select entry_id, date, string_agg(scene_id, '-' order by scene_id) from partial_tiles group by entry_id, date""")
def one_image_per_day(spark, sf):
    full = catalogue.full_tile_per_day(catalogue.latest_reprocessing(_scenes(spark, sf)))
    mosaics = catalogue.mosaic_metadata(_partial(spark, sf)).select("entry_id", "date", "image_id")
    return full.select("entry_id", "date", F.col("scene_id").alias("image_id")).unionByName(mosaics)


@query("j15_companion_masks", "J15", "", """
select event_id as scene_id, user_id as entry_id, round(value / 5, 6) as cloud_probability
from events where value < 450 and event_type in ('view', 'error')""")
def companion_masks(spark, sf):
    e = fx.table(spark, sf, "events")
    scenes = e.where(F.col("event_type").isin("view", "error")).select(
        F.col("event_id").alias("scene_id"), F.col("user_id").alias("entry_id"))
    masks = e.where(F.col("value") < 450).select(
        F.col("event_id").alias("scene_id"), (F.col("value") / 5).alias("cloud_probability"))
    return rounded(catalogue.attach_companion(scenes, masks, ["cloud_probability"]))


@query("p16_season_windows", "P16", "", """
select o_orderkey as entry_id, cast(year(o_orderdate) || '-08-01' as date) as start, cast(year(o_orderdate) || '-10-15' as date) as "end"
from orders""")
def season_windows(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.to_date("o_orderdate").alias("date_inv"))
    return catalogue.query_windows(o, None, ("08-01", "10-15")).select("entry_id", "start", "end")


@query("p16_single_days", "P16 J2", "", """
select o_orderkey as entry_id, cast(o_orderdate as date) as start, cast(o_orderdate as date) + 1 as "end"
from orders where o_orderstatus <> 'P'""")
def single_days(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("entry_id"),
        F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("date_acq"))
    return catalogue.query_windows(o, None, None).select("entry_id", "start", "end")


@query("x1_date_in_name", "X1", "", """
with n as (select o_orderkey, 'S2_' || strftime(o_orderdate, '%Y%m%d') || case when o_orderkey % 3 = 0 then '7' else '' end || '_' || o_orderpriority as name from orders)
select o_orderkey, case when o_orderkey % 3 <> 0 then cast(strptime(substr(name, 4, 8), '%Y%m%d') as date) end as date from n""")
def date_in_name(spark, sf):
    o = fx.table(spark, sf, "orders")
    tail = F.when(F.col("o_orderkey") % 3 == 0, F.lit("7")).otherwise(F.lit(""))
    name = F.concat(F.lit("S2_"), F.date_format("o_orderdate", "yyyyMMdd"), tail, F.lit("_"), F.col("o_orderpriority"))
    return o.select("o_orderkey", naming.date_in_name(name).alias("date"))


@query("x17_path_parts", "X17 S3", "", """
select o_orderkey, cast(year(o_orderdate) as varchar) as year, 'e' || o_custkey as entry_id,
       strftime(o_orderdate, '%Y-%m-%d') || '.tif' as file from orders""")
def path_parts(spark, sf):
    o = fx.table(spark, sf, "orders")
    path = F.concat_ws(
        "/", F.lit("file:/data"), F.year("o_orderdate").cast("string"), F.concat(F.lit("e"), F.col("o_custkey").cast("string")),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".tif")))
    return o.select("o_orderkey", *[c.alias(n) for n, c in naming.path_parts(path).items()])


@query("x23_infinite_metric", "X23", "img", """
select entry_id, date, round(ndsi, 6) as ndsi from img""")
def infinite_metric(spark, sf):
    stored = F.coalesce(F.col("ndsi"), F.lit(float("inf")))
    i = fx.img(spark, sf).withColumn("ndsi", stored)
    return rounded(i.select("entry_id", "date", missing_to_null(F.col("ndsi")).alias("ndsi")))


@query("a41_images_per_entry", "A41", "img", """
select c_custkey as entry_id, count(img.date) as n_images from customer left join img on c_custkey = entry_id group by c_custkey""")
def images_per_entry(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"))
    counts = fx.img(spark, sf).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_images"))
    return c.join(counts, "entry_id", "left").select("entry_id", F.coalesce("n_images", F.lit(0)).alias("n_images"))


@query("a41_entries_without_image", "A41 J6", "img", """
select c_custkey as entry_id from customer where c_custkey not in (select entry_id from img)""")
def entries_without_image(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"))
    return images.without_image(c, fx.img(spark, sf))


RUNS_SQL = """
with runs as (select o_custkey as grp, 'run=' || strftime(o_orderdate, '%Y%m%d') || '_jobnum=' || o_orderkey || '_loss=' ||
   cast(cast(floor(o_totalprice / 1000) as bigint) as varchar) as name, floor(o_totalprice / 1000) as loss from orders)
"""


def _runs(spark, sf):
    loss = F.floor(F.col("o_totalprice") / 1000).cast("string")
    return fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("grp"),
        F.concat(F.lit("run="), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_jobnum="),
                 F.col("o_orderkey").cast("string"), F.lit("_loss="), loss).alias("name"))


@query("w22_best_checkpoint", "W22", "", RUNS_SQL + """
select grp, name, loss from (select *, row_number() over (partition by grp order by loss, name desc) as rn from runs) where rn = 1""")
def best_checkpoint(spark, sf):
    return images.best_run(_runs(spark, sf), ["grp"], "loss", "min")


@query("w22_latest_run", "W22", "", RUNS_SQL + "select grp, max(name) as name from runs group by grp")
def latest_run(spark, sf):
    return images.latest_run(_runs(spark, sf), ["grp"])


QC_SQL = """
with c as (select entry_id, cast(floor(x / 4) as bigint) as image_id, case when r < 4000 then null else b end as b, g, r, swir,
   swir < 4200 as nok, b + g >= 10000 as roi from px)
"""


def _qc_cells(spark, sf):
    return fx.px(spark, sf).select(
        "entry_id", F.floor(F.col("x") / 4).alias("image_id"),
        F.when(F.col("r") >= 4000, F.col("b")).alias("b"), "g", "r", "swir",
        (F.col("swir") < 4200).alias("nok"), (F.col("b") + F.col("g") >= 10000).alias("roi"))


@query("a4_quality_metrics", "A4 A5 A6 A7", "px", QC_SQL + """
select entry_id, image_id, round(avg(case when b is not null then 1.0 else 0.0 end), 6) as coverage,
  round(avg(case when roi then case when not nok and b is not null then 0.0 else 1.0 end end), 6) as cloud_p,
  round(avg(case when not nok and not roi then (g - swir) / (case when g + swir = 0 then 1 else g + swir end) end), 6) as ndsi,
  round(avg(case when not nok and roi then 0.5621 * b / 10000 + 0.1479 * g / 10000 + 0.2512 * r / 10000 + 0.0015 end), 6) as albedo
from c group by entry_id, image_id""")
def quality_metrics(spark, sf):
    m = images.quality_metrics(
        _qc_cells(spark, sf), ["entry_id", "image_id"], {"B": "b", "G": "g", "R": "r", "SWIR": "swir"}, F.col("nok"),
        {"cloud_p": F.col("roi"), "ndsi": ~F.col("roi"), "albedo": F.col("roi")})
    return rounded(m)


@query("a8_covered_area", "A8 D5", "px", QC_SQL + """
select entry_id, image_id, round(sum(case when b is not null then 1.0 else 0.0 end) * 100 / 20000, 6) as coverage
from c group by entry_id, image_id""")
def covered_area(spark, sf):
    return rounded(catalogue.covered_share(
        _qc_cells(spark, sf), ["entry_id", "image_id"], F.col("b").isNotNull(), 10.0, F.lit(20000.0)))


@query("d4_band_expression", "D4 A7", "px", """
select entry_id, y, x, round(0.5621 * b + 0.1479 * g + 0.2512 * r + 0.0015, 6) as albedo from px""")
def band_expression(spark, sf):
    text = "0.5621D * B + 0.1479D * G + 0.2512D * R + 0.0015D"
    value = spectral.band_expression(text, {"B": "b", "G": "g", "R": "r"})
    return rounded(fx.px(spark, sf).select("entry_id", "y", "x", value.alias("albedo")))


@query("d5_region_reducers", "D5", "px", """
select entry_id, sum(b) as total, round(avg(b), 6) as mean, min(b) as low from px where b + g >= 10000 group by entry_id""")
def region_reducers(spark, sf):
    cells = fx.px(spark, sf)
    region = cells.where(F.col("b") + F.col("g") >= 10000).select("entry_id", "y", "x")
    return rounded(pixels.reduce_region(cells, region, ["entry_id"], {
        "total": F.sum("b"), "mean": F.avg("b"), "low": F.min("b")}))
