"""Order-dependent results without a single-task sort.

A window over ``partitionBy(entry_id)`` sorts a whole entry in one task, which
fails when one entry holds a third of all rows. The operators here place rows by
range on ``(keys, order)`` instead, so a large key spans many tasks; totals per
slice are tiny and are carried over with a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.session import materialise
from firnline.tables import join_null_safe

_SLICE = "_slice"


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    totals: dict[str, Column],
    grand: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running totals per key.

    ``totals`` maps new column names to the value to add up; ``grand`` maps new
    column names to a key of ``totals`` whose per-key grand total to attach.
    ``order`` should be unique within a key, as ties share no defined order.
    """
    names = list(totals)
    placed = df.select("*", *[totals[n].alias(f"_v_{n}") for n in names])
    placed = placed.repartitionByRange(*[F.col(k) for k in keys], *order)
    # the slice number is written down, so every later branch sees the same one
    placed = materialise(placed.withColumn(_SLICE, F.spark_partition_id()))

    slices = placed.groupBy(*keys, _SLICE).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(
        *keys,
        _SLICE,
        *[F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in names],
        *[F.sum(f"_s_{n}").over(whole).alias(g) for g, n in (grand or {}).items()],
    )
    local = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_r_{n}") for n in names])
    return join_null_safe(running, carried, [*keys, _SLICE]).select(
        *df.columns,
        *[_carry(f"_o_{n}", f"_r_{n}").alias(n) for n in names],
        *(grand or {}),
    )


def _carry(offset: str, local: str) -> Column:
    return F.when(F.col(offset).isNull(), F.col(local)).otherwise(F.col(offset) + F.col(local))


def row_numbers(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    """1-based position of every row within its key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})


def block_row_numbers(
    df: DataFrame, keys: list[str], order: str, block: int = 1 << 16, name: str = "rn"
) -> DataFrame:
    """Row numbers for a unique integer order column, with blocks of it as the slices.

    Needs no written table: the slice is a function of the data.
    """
    sliced = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = sliced.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    return (
        sliced.withColumn("_l", local)
        .join(offsets, [*keys, "_block"])
        .select(*df.columns, (F.col("_o") + F.col("_l")).alias(name))
    )


def raster_row_numbers(df: DataFrame, key: str = "entry_id", name: str = "rn") -> DataFrame:
    """Row-major position of cells within their entry, with raster rows as the slices."""
    per_row = df.groupBy(key, "y").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_row.select(key, "y", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy(key, "y").orderBy("x"))
    return (
        df.withColumn("_l", local)
        .join(offsets, [key, "y"])
        .select(*df.columns, (F.col("_o") + F.col("_l")).alias(name))
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key.

    Equal values are counted before the shuffle; the two order statistics around
    each position are then picked from running counts.
    """
    counts = (
        df.select(*keys, value.alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, keys, ["_v"], {"_cum": F.col("_n")}, {"_total": "_cum"})

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_cum") - F.col("_n")) & (rank < F.col("_cum")), F.col("_v")))

    picks = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            at(F.floor(pos)).alias(f"_lo_{name}"),
            at(F.ceil(pos)).alias(f"_hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"_f_{name}"),
        ]
    picked = ranked.groupBy(*keys).agg(*picks)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def rank_lookup(
    steps: DataFrame, wanted: DataFrame, keys: list[str], block: int = 1 << 14
) -> DataFrame:
    """Find, for each wanted 0-based rank, the step whose rank interval holds it.

    ``steps`` has ``first``, ``last`` (inclusive ranks) and a struct ``payload``;
    ``wanted`` has ``rank`` and any other columns. Both sides meet in blocks of ranks,
    where one ordered pass carries the latest step forward.
    """
    others = [c for c in wanted.columns if c not in keys]
    spread = steps.withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block)))
    )
    left = spread.select(
        *keys, "_block", F.greatest(F.col("first"), F.col("_block") * block).alias("_pos"),
        F.lit(0).alias("_kind"), F.col("payload"),
        F.lit(None).cast(wanted.select(F.struct(*others)).schema[0].dataType).alias("_q"),
    )
    right = wanted.select(
        *keys, F.floor(F.col("rank") / block).alias("_block"), F.col("rank").alias("_pos"),
        F.lit(1).alias("_kind"), F.lit(None).cast(steps.schema["payload"].dataType).alias("payload"),
        F.struct(*others).alias("_q"),
    )
    w = Window.partitionBy(*keys, "_block").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("payload", F.last("payload", ignorenulls=True).over(w))
    return both.where(F.col("_kind") == 1).select(*keys, "_q.*", "payload")
