"""Rows of tables whose ids may repeat, and memory of workers that later stages use again."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.session import materialise


def without_rows(docs: DataFrame, losers: DataFrame, key: Callable[[], Column]) -> DataFrame:
    """``docs`` without the rows whose id and key are in ``losers`` (``_id``, ``_key``).

    ``key`` is computed for rows with an id in ``losers`` only. A NULL id is an id like any other.
    """
    ids = losers.select("_id").distinct()
    suspect = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").withColumn("_own_key", key())
    rest = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_anti")
    kept = suspect.join(losers, suspect["doc_id"].eqNullSafe(losers["_id"]) & (suspect["_own_key"] == losers["_key"]), "left_anti")
    return rest.unionByName(kept.select(*docs.columns))


def one_row_each(docs: DataFrame, repeated: DataFrame, key: Callable[[], Column]) -> DataFrame:
    """``docs`` with one row, that of the longest and then greatest text, of those that share an id and key in ``repeated``."""
    if repeated.isEmpty():
        return docs
    keyed = docs.withColumn("_own_key", key())
    same = keyed["doc_id"].eqNullSafe(repeated["_id"]) & (keyed["_own_key"] == repeated["_key"])
    text = F.struct(F.char_length("text").alias("n"), F.col("text").alias("t"))
    chosen = keyed.join(repeated, same, "left_semi").groupBy("doc_id", "_own_key").agg(
        F.max_by(F.struct(*docs.columns), text).alias("row")
    )
    return keyed.join(repeated, same, "left_anti").select(*docs.columns).unionByName(chosen.select("row.*"))


def repeated_rows(rows: DataFrame) -> DataFrame:
    """Ids and keys (``_id``, ``_key``) that several of ``rows`` have."""
    return materialise(rows.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("_id", "_key"))


def releasing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over batches that gives its freed memory back to the system once it ends."""
    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # a system without it keeps the memory for the next task
        pass
