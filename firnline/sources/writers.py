"""Writers with an explicit policy for existing output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What to do when the output exists.
UNSORTED = ("map", "array", "struct", "variant", "binary")
POLICIES = {"skip": "ignore", "overwrite": "overwrite", "error": "errorifexists"}


def _mode(policy: str) -> str:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {sorted(POLICIES)}")
    return POLICIES[policy]


def write_table(df: DataFrame, path: str, policy: str = "error") -> None:
    df.write.mode(_mode(policy)).parquet(path)


def write_cells(cells: DataFrame, path: str, policy: str = "error", order: tuple[str, ...] = ("entry_id", "y", "x")) -> None:
    """Cells by year, sorted so that an entry's cells sit together and files prune by entry.

    Rows are placed by range, so a large entry is written by many tasks.
    """
    placed = cells.repartitionByRange("year", *order).sortWithinPartitions("year", *order)
    placed.write.mode(_mode(policy)).partitionBy("year").parquet(path)


def write_layers(layers: DataFrame, path: str, policy: str = "error") -> None:
    """A table with a ``layer`` column, one directory per layer.

    Rows are placed by range over all columns, so the tasks of a layer follow its size.
    """
    order = ["layer", *[f.name for f in layers.schema.fields if f.name != "layer" and f.dataType.typeName() not in UNSORTED]]
    layers.repartitionByRange(*order).write.mode(_mode(policy)).partitionBy("layer").parquet(path)


def write_csv(df: DataFrame, path: str, policy: str = "error") -> None:
    df.write.mode(_mode(policy)).option("header", "true").csv(path)


def write_json(df: DataFrame, path: str, policy: str = "error") -> None:
    df.write.mode(_mode(policy)).json(path)


def write_missing(
    inputs: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "entry_id", rounds: int = 1
) -> DataFrame:
    """Compute and append only entries that ``path`` lacks; return the rows of all committed entries.

    Every round writes its rows into a folder of its own and then lists its entries in a manifest.
    Rows count only once their manifest is written, so a killed run loses at most its open round, and
    the next run computes that round again. Entries without any row are listed too and are not
    tried twice. NULL is an entry like any other. ``rounds`` deals the entries by hash.
    """
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    spark = inputs.sparkSession
    for number in range(rounds):
        todo = inputs if rounds == 1 else inputs.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == number)
        if _exists(spark, f"{path}/done"):
            done = spark.read.parquet(f"{path}/done").select(F.col(key).alias("_done"))
            todo = todo.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
        if todo.isEmpty():
            continue
        run = uuid.uuid4().hex
        compute(todo).write.parquet(f"{path}/rows/run={run}")
        todo.select(key).distinct().write.parquet(f"{path}/done/run={run}")
    return committed_rows(spark, path) if _exists(spark, f"{path}/done") else compute(inputs).limit(0)


def committed_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that ``write_missing`` wrote to their end; folders without a manifest are not read."""
    runs = spark.read.parquet(f"{path}/done").select("run").distinct()
    return spark.read.parquet(f"{path}/rows").join(runs, "run", "left_semi").drop("run")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
