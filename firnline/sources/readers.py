"""Readers for outlines, keyed tables, files and cell tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.functions import naming
from firnline.tables import require_columns


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """One layer of a layered table; the layer is a directory, so only it is listed and read."""
    return spark.read.parquet(path).where(F.col("layer") == layer).drop("layer")


def read_keyed_csv(spark: SparkSession, path: str, schema: T.StructType, key: str = "entry_id") -> DataFrame:
    """A CSV table with a declared schema and a key column."""
    return require_columns(spark.read.schema(schema).csv(path, header=True), [key])


def discover_files(spark: SparkSession, root: str, pattern: str = "*.tif") -> DataFrame:
    """Files below ``root`` as ``path, length`` with the parts of their path; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(root).select("path", "length")
    )
    return files.withColumns(naming.path_parts(F.col("path")))


def read_cells(spark: SparkSession, path: str, columns: list[str] | None = None, entries: DataFrame | None = None, preload: bool = False) -> DataFrame:
    """The cell table, pruned to some columns and entries.

    ``preload`` keeps it in executor memory (spilling to disk) for repeated use.
    """
    cells = spark.read.parquet(path)
    if columns:
        cells = cells.select(*require_columns(cells, columns).select(*columns).columns)
    if entries is not None:
        cells = cells.join(entries.select("entry_id"), "entry_id", "left_semi")
    return cells.persist() if preload else cells


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A saved table if it was written to its end, else compute it, save it and read it back."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
