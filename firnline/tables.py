"""Declared schemas, schema checks and the one encoding of "missing"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

OUTLINES = T.StructType([
    T.StructField("entry_id", T.StringType(), False),
    T.StructField("date_inv", T.DateType()),
    T.StructField("rings", T.ArrayType(T.ArrayType(POINT))),
])

DATES = T.StructType([T.StructField("entry_id", T.StringType()), T.StructField("date", T.DateType())])

FOLDS = T.StructType([
    T.StructField("entry_id", T.LongType()),
    T.StructField("area_km2", T.DoubleType()),
    T.StructField("bound_lim", T.DoubleType()),
    T.StructField("fold", T.StringType()),
])

NORM_STATS = T.StructType([
    T.StructField("var_name", T.StringType()),
    T.StructField("mu", T.DoubleType()),
    T.StructField("stddev", T.DoubleType()),
    T.StructField("vmin", T.DoubleType()),
    T.StructField("vmax", T.DoubleType()),
])


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Return ``df`` unchanged, or fail with the list of columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL; the keys of ``left`` stay."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(named[f"_right_{k}"]) for k in keys]
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` marked for a join in which both sides are shuffled.

    Rows that open inside a plan and columns that compress well look far smaller than they are
    in memory, so Spark's size rule would send such a table to the driver and to every executor.
    """
    return df.hint("merge")


def columns_first(df: DataFrame, first: list[str]) -> DataFrame:
    """Reorder columns so that ``first`` lead."""
    require_columns(df, first)
    return df.select(*first, *[c for c in df.columns if c not in first])


def columns_matching(df: DataFrame, *parts: str) -> list[str]:
    """Names that contain any of ``parts``, in table order."""
    return [c for c in df.columns if any(p in c for p in parts)]


def missing_to_null(value: Column, sentinel: float | None = None) -> Column:
    """NaN, infinities and a numeric sentinel all become NULL."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    if sentinel is not None:
        bad = bad | (value == F.lit(sentinel))
    return F.when(~bad, value)
