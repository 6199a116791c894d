"""Text helpers: padded ids, time labels, file-name parts, lenient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_id(region: Column, width: int = 4) -> Column:
    """Zero-padded id; ids longer than ``width`` are kept whole."""
    text = region.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def slot_label(hour: Column, quarter: Column) -> Column:
    """``HH:MM`` label of a 15-minute slot."""
    return F.format_string("%02d:%02d", hour.cast("int"), (quarter * 15).cast("int"))


def lenient_number(text: Column) -> Column:
    """Numeric cast where unreadable text becomes NULL."""
    return text.try_cast("double")


def digits_of(text: Column) -> Column:
    """Drop everything but digits, the decimal point and a minus sign."""
    return F.regexp_replace(text, r"[^0-9.\-]+", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_year(path: Column) -> Column:
    """Year in a name that ends in ``yyyy-MM.csv`` or ``yyyy-MM.csv.gz``."""
    return F.regexp_extract(path, r"(\d{4})-(\d{2})\.csv(?:\.gz)?$", 1).try_cast("int")


def file_month(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d{4})-(\d{2})\.csv(?:\.gz)?$", 2).try_cast("int")


def region_in_path(path: Column, leaf: str = "net") -> Column:
    """Region id from ``…/<id>/<leaf>``; NULL when the path has none."""
    return F.regexp_extract(path, rf"/(\d+)/{leaf}", 1).try_cast("int")


def day_in_url(url: Column) -> dict[str, Column]:
    """Year, month and day from a ``/yyyy/m/d/`` address."""
    pattern = r"/(\d{4})/(\d{1,2})/(\d{1,2})/"
    return {
        name: F.regexp_extract(url, pattern, group).try_cast("int")
        for group, name in enumerate(("year", "month", "day"), start=1)
    }
