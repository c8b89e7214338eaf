"""Dates, identifiers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a run of exactly eight digits.
DATE_PATTERN = r"(?<!\d)(\d{8})(?!\d)"


def date_in_name(name: Column) -> Column:
    """The first standalone YYYYMMDD run of a name as a date, else NULL."""
    digits = F.regexp_extract(name, DATE_PATTERN, 1)
    return F.when(digits != "", F.try_to_date(digits, "yyyyMMdd"))


def scene_id_parts(scene_id: Column) -> dict[str, Column]:
    """``<acquired>_<processed>_<tile>`` split into its parts; NULL for what an id lacks."""
    parts = F.split(scene_id, "_")
    return {
        "date": F.try_to_date(F.substring(F.get(parts, F.lit(0)), 1, 8), "yyyyMMdd"),
        "processing_time": F.get(parts, F.lit(1)),
        "tile": F.get(parts, F.lit(2)),
    }


def padded_id(number: Column, prefix: str, width: int, cut: bool = False) -> Column:
    """Prefix and number with leading zeros. A longer number stays whole, or with ``cut`` keeps its first ``width`` digits."""
    if cut:
        return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))
    return F.format_string(f"{prefix}%0{width}d", number)


def path_parts(path: Column) -> dict[str, Column]:
    """``…/<year>/<entry_id>/<file>`` split into its parts; NULL for what a short path lacks."""
    parts = F.split(path, "/")
    return {
        "year": F.try_element_at(parts, F.lit(-3)),
        "entry_id": F.try_element_at(parts, F.lit(-2)),
        "file": F.try_element_at(parts, F.lit(-1)),
    }


def season_window(year: Column, start: str, end: str) -> tuple[Column, Column]:
    """``MM-DD`` bounds of a year as dates."""
    y = year.cast("string")
    return F.to_date(F.concat_ws("-", y, F.lit(start))), F.to_date(F.concat_ws("-", y, F.lit(end)))


def single_day(date: Column) -> tuple[Column, Column]:
    """The half-open window of one day."""
    return date, F.date_add(date, 1)
