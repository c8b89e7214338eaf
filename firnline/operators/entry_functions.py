"""User functions applied once per entry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_entries(
    arguments: DataFrame, fn: Callable[..., dict], schema: T.StructType, key: str = "entry_id",
    constants: dict | None = None, continue_on_error: bool = False,
) -> DataFrame:
    """Call ``fn(**arguments, **constants)`` for every row and collect its values.

    One row per entry holds the arguments, so Spark spreads the calls freely and no
    group is formed. With ``continue_on_error`` a failed call yields NULLs and its
    message in ``error``; otherwise the job fails.
    """
    constants = dict(constants or {})
    names = [f.name for f in schema.fields]
    out = T.StructType([arguments.schema[key], *schema.fields, T.StructField("error", T.StringType())])

    def call(row: dict) -> dict:
        try:
            return {**fn(**row, **constants), "error": None}
        except Exception as e:  # noqa: BLE001 - the caller asked to go on
            if not continue_on_error:
                raise
            return {**dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{key: r[key], **call(r)} for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[f.name for f in out.fields])

    return arguments.mapInPandas(run, out)
