"""Weather readings from stored day pages or from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.text import day_in_url, digits_of

READING_SCHEMA = (
    "year int, month int, day int, time string, "
    "temperature string, precipitation string, windspeed string"
)

# The table's id and the places of the cells that are used.
OBSERVATION_TABLE = "obsTable"
TIME_CELL, TEMPERATURE_CELL, WIND_CELL, RAIN_CELL = 0, 1, 8, 10


def _element(tag: str, attributes: str = "[^>]*") -> str:
    """Pattern of an element with its content as group 1.

    The content is matched in runs of plain text between tags, without the
    back-tracking of a lazy ``.*?``.
    """
    return rf"(?i)<{tag}\b{attributes}>([^<]*+(?:<(?!/{tag}\b)[^<]*+)*+)</{tag}\b"


def _elements(html: Column, tag: str) -> Column:
    return F.regexp_extract_all(html, F.lit(_element(tag)), F.lit(1))


def _text(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, r"(?s)<[^>]*>", ""))


def readings_from_pages(pages: DataFrame) -> DataFrame:
    """One row per observation of stored pages ``(url, html)``.

    Takes the body rows of the observation table, four cells of each, and the
    date from the address. Numbers keep their sign; cells a short row lacks are
    NULL.
    """
    named = rf"""[^>]*\bid=["']?{OBSERVATION_TABLE}\b[^>]*"""
    table = F.regexp_extract("html", _element("table", named), 1)
    body = F.regexp_extract(F.col("table"), _element("tbody"), 1)
    date = day_in_url(F.col("url"))

    def cell(place: int) -> Column:
        return _text(F.get(F.col("cells"), F.lit(place)))

    return (
        pages.select(*[part.alias(name) for name, part in date.items()], table.alias("table"))
        .select("year", "month", "day", F.posexplode(_elements(body, "tr")).alias("seq", "row"))
        .where(F.col("row").rlike(r"(?i)<td\b"))
        .select("year", "month", "day", "seq", _elements(F.col("row"), "td").alias("cells"))
        .select(
            "year",
            "month",
            "day",
            F.concat_ws(
                " ", F.format_string("%04d-%02d-%02d", "year", "month", "day"), cell(TIME_CELL)
            ).alias("time"),
            digits_of(cell(TEMPERATURE_CELL)).alias("temperature"),
            digits_of(cell(RAIN_CELL)).alias("precipitation"),
            digits_of(cell(WIND_CELL)).alias("windspeed"),
        )
    )


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Stored readings, one CSV file per day, as one table."""
    return spark.read.schema(READING_SCHEMA).option("header", True).csv(path)
