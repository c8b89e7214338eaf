"""Column expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: digits, small ASCII letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the built-in, which then does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Array of the words of ``text`` in order, ASCII letters lower-cased."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def crc_mod(column: str, n: int) -> Column:
    """``crc32`` of the value as text, modulo ``n``; NULL stays NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
