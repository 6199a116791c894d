"""Weather readings to one row per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.aggregates import Mean
from curbflow.functions.text import lenient_number
from curbflow.functions.timeparts import weather_clock
from curbflow.operators.joins import broadcast_if_small

HOUR_KEYS = ("year", "month", "day", "hour")


def clean_readings(raw: DataFrame) -> DataFrame:
    """Numbers from text, the hour from the 12-hour time, missing rain as 0."""
    clock = weather_clock(F.col("time"))
    return raw.withColumns(
        {
            "temperature": lenient_number(F.col("temperature")),
            "precipitation": F.coalesce(lenient_number(F.col("precipitation")), F.lit(0.0)),
            "windspeed": lenient_number(F.col("windspeed")),
            "datetime": clock,
            "hour": F.hour(clock),
        }
    )


def hourly_weather(readings: DataFrame, *, mean: Mean = F.avg) -> DataFrame:
    """Mean temperature and wind and the highest rain of each hour."""
    return readings.groupBy(*HOUR_KEYS).agg(
        mean(F.col("temperature")).alias("temperature"),
        F.max("precipitation").alias("precipitation"),
        mean(F.col("windspeed")).alias("windspeed"),
    )


def cross_with_cells(weather: DataFrame, n_cells: int) -> DataFrame:
    """Repeat each hour for cells 1 to ``n_cells``; rows are generated in place."""
    cells = F.explode(F.sequence(F.lit(1), F.lit(n_cells))).alias("pickup_cell")
    return weather.select("*", cells)


def rides_with_weather(rides: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather on binned rides. Weather does not vary by cell, so no cross is needed."""
    hours = weather.withColumnsRenamed({"day": "pickup_day", "hour": "pickup_hour"})
    joined = rides.join(
        broadcast_if_small(hours), ["year", "month", "pickup_day", "pickup_hour"], "left"
    )
    return joined.fillna(0.0, subset=["precipitation"])
