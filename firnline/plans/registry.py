"""The registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.plans.fixtures import with_views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, views: str = "", sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory ids it shows."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        text = None if sql is None else with_views(views.split(), sql)
        QUERIES[name] = Query(name, fn, text, tuple(covers.split()))
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, **others: int) -> DataFrame:
    """Round every double column, as the SQL side does."""
    def one(field) -> Column:
        if field.dataType.typeName() != "double":
            return F.col(field.name)
        return F.round(F.col(field.name), others.get(field.name, digits)).alias(field.name)

    return df.select(*[one(f) for f in df.schema.fields])
