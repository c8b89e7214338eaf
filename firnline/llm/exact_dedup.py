"""Exact duplicates by stateful streaming.

Every row is reduced to a digest, its identifier and a locator of its content. These
records stream through keyed state that never expires and lives on disk (the RocksDB
state store, with its checkpoints in the shared folder): the state of a digest is the
row that stays, its locator and the size of the group. Every hit, that is every digest
that came more than once, is then checked on the full bytes, and digests whose texts
differ are grouped anew by the texts themselves.

The plan has DataFrame operations only. A group is combined before each shuffle, so a
group that holds a third of all rows is as cheap as any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.columns import read_table, text_or_empty
from firnline.llm.rows import one_row_each, repeated_rows, without_rows
from firnline.session import materialise, scratch_dir

QUERY = "op4_exact_dedup"

#: State on disk; files grow with what they hold instead of being laid out in advance.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without ASCII white space, which is what equality looks at."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _rank() -> Column:
    """Smallest for the row that stays: most code points, then smallest id; a missing id comes last."""
    return F.struct(
        (-F.col("n_chars")).alias("order"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
        F.col("locator").alias("locator"),
    )


def keyed_state(records_path: str, schema, files_per_batch: int, spark: SparkSession) -> DataFrame:
    """Stream the records at ``records_path`` through the keyed state; one row for each digest."""
    work = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    classes = f"{work}/classes"
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(records_path)
        .groupBy("digest").agg(F.min(_rank()).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    )

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{classes}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        (
            stream.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    read = spark.read.option("basePath", classes).schema(stream.schema.add("batch", "integer"))
    return read.parquet(f"{classes}/batch=*").groupBy("digest").agg(
        F.max_by(F.struct("stays", "group_size"), "batch").alias("c")
    ).select("digest", "c.*")


def exact_duplicates(docs: DataFrame, digest=sha256, files_per_batch: int = 10_000) -> DataFrame:
    """Group the rows of ``docs`` (``doc_id``, ``text``) whose normalised texts are equal.

    Returns one row for each input row: ``doc_id, keep_id, group_size, kept, digest``.
    ``digest`` maps the normalised text to a key; it may collide, the result is the same.

    NULL text counts as empty, and all empty texts are one group. A NULL ``doc_id`` is an
    id of its own that loses every tie. ``doc_id`` names a row: rows that repeat both id
    and text count in ``group_size`` and share the decision. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    texts = texts.select("doc_id", normalised(F.col("text")).alias("body"), F.char_length("text").alias("n_chars"))
    texts = texts.withColumn("digest", digest(F.col("body")))
    records = materialise(texts.select("doc_id", "digest", "n_chars", F.input_file_name().alias("locator")))
    if records.isEmpty():
        path = None
        classes = records.groupBy("digest").agg(F.min(_rank()).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    else:
        path = records.inputFiles()[0].rpartition("/")[0]
        classes = materialise(keyed_state(path, records.schema, files_per_batch, spark))

    # every hit is compared on its full bytes: a group is sound if its smallest and largest text are the same
    hits = classes.where("group_size > 1").select(F.xxhash64("digest").alias("hit")).distinct()
    bodies = texts.withColumn("hit", F.xxhash64("digest")).join(materialise(hits), "hit", "left_semi")
    unsound = materialise(
        bodies.groupBy("digest").agg(F.min("body").alias("first"), F.max("body").alias("last"))
        .where(F.col("first") != F.col("last")).select("digest")
    )
    same = records.join(classes, "digest").select(
        "doc_id", "digest", F.col("stays.id").alias("keep_id"), "group_size"
    )
    if not unsound.isEmpty():
        split = texts.withColumn("locator", F.lit("")).join(unsound, "digest", "left_semi")
        by_text = split.groupBy("digest", "body").agg(
            F.min(_rank()).alias("stays"), F.count(F.lit(1)).alias("group_size")
        )
        regrouped = split.select("doc_id", "digest", "body").join(by_text, ["digest", "body"]).select(
            "doc_id", "digest", F.col("stays.id").alias("keep_id"), "group_size"
        )
        same = same.join(unsound, "digest", "left_anti").unionByName(regrouped)
    return same.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay. See ``exact_duplicates``.

    Rows go by id and text together, so other texts of an id stay; of rows that share the id and the text
    that stays, the longest, then greatest text is kept.
    """
    rows = materialise(exact_duplicates(docs).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_key"), "kept"))
    losers = rows.where(~F.col("kept")).select("_id", "_key").distinct()
    key = lambda: sha256(normalised(text_or_empty()))
    return one_row_each(without_rows(docs, materialise(losers), key), repeated_rows(rows.where("kept")), key)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), k AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM k
"""
