"""Column pruning, validity of trips, and null recoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.functions.timeparts import add_time_features

# Raw columns not used by the analysis.
UNUSED_COLUMNS = (
    "vendor_id",
    "store_and_fwd_flag",
    "surcharge",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
)

# Columns of the tagged trip tables.
TRACT_TRIP_COLUMNS = (
    "pickup_tract_id",
    "pickup_datetime",
    "pickup_latitude",
    "pickup_longitude",
    "dropoff_tract_id",
    "dropoff_datetime",
    "dropoff_latitude",
    "dropoff_longitude",
    "pickup_year",
    "pickup_month",
    "weekday",
    "passenger_count",
    "fare_rev_per_hour",
    "fare_amount",
    "total_amount",
    "trip_time",
    "trip_distance",
)
GRID_TRIP_COLUMNS = (
    "pickup_grid",
    "pickup_datetime",
    "pickup_latitude",
    "pickup_longitude",
    "dropoff_grid",
    "dropoff_datetime",
    "dropoff_latitude",
    "dropoff_longitude",
    "passenger_count",
    "fare_rev_per_hour",
    "fare_amount",
    "total_amount",
    "trip_time",
    "trip_distance",
)

# Limits of the validity rule (miles, dollars, degrees, hours).
MAX_DISTANCE = 100.0
FARE_PER_MILE = (1.0, 20.0)
LONGITUDE_RANGE = (-75.0, -72.0)
LATITUDE_RANGE = (40.0, 41.5)
MIN_TRIP_TIME = 1 / 60
MAX_FARE_RATE = 1000.0
LONGEST_TRIP = 2.0

# The band of fare rates used by the fare analysis.
FARE_RATE_BAND = (29.0, 201.0)


def drop_unused(df: DataFrame, columns: Sequence[str] = UNUSED_COLUMNS) -> DataFrame:
    """Drop columns; those a file generation never had are ignored."""
    return df.drop(*columns)


def drop_row_numbers(df: DataFrame) -> DataFrame:
    """Drop the unnamed row-number column some exports carry."""
    return df.drop("V1", "_c0")


def _between(value: Column, limits: tuple[float, float]) -> Column:
    low, high = limits
    return (value > F.lit(low)) & (value < F.lit(high))


def _known(condition: Column, otherwise: bool) -> Column:
    return F.coalesce(condition, F.lit(otherwise))


def validity() -> Column:
    """Is the trip plausible?

    An unknown in the distance, price or place test makes a trip invalid; an
    unknown in the duration and fare-rate test leaves it as it is.
    """
    fare_per_mile = F.try_divide(F.col("fare_amount"), F.col("trip_distance"))
    plausible = (
        (F.col("trip_distance") < F.lit(MAX_DISTANCE))
        & _between(fare_per_mile, FARE_PER_MILE)
        & _between(F.col("pickup_longitude"), LONGITUDE_RANGE)
        & _between(F.col("pickup_latitude"), LATITUDE_RANGE)
    )
    steady = (F.col("trip_time") > F.lit(MIN_TRIP_TIME)) & (
        F.col("fare_rev_per_hour") < F.lit(MAX_FARE_RATE)
    )
    return _known(plausible, False) & _known(steady, True)


def flag_clean(df: DataFrame) -> DataFrame:
    return df.withColumn("clean", validity())


def clean_trips(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Valid trips only, projected to ``columns`` when given."""
    kept = df.where(validity())
    return kept.select(*columns) if columns else kept


def prepare(df: DataFrame, **time_options) -> DataFrame:
    """Prune columns, append time features, flag validity."""
    return (
        df.transform(drop_unused)
        .transform(lambda d: add_time_features(d, **time_options))
        .transform(flag_clean)
    )


def reject_counts(df: DataFrame) -> DataFrame:
    """One row: how many trips fail each rule (a trip may fail several)."""
    fare_per_mile = F.try_divide(F.col("fare_amount"), F.col("trip_distance"))

    def fails(test: Column, when_unknown: bool) -> Column:
        return F.count_if(~_known(test, when_unknown))

    return df.agg(
        F.count(F.lit(1)).alias("trips"),
        fails(F.col("trip_distance") < F.lit(MAX_DISTANCE), False).alias("bad_distance"),
        fails(_between(fare_per_mile, FARE_PER_MILE), False).alias("bad_fare_per_mile"),
        fails(_between(F.col("pickup_longitude"), LONGITUDE_RANGE), False).alias("bad_longitude"),
        fails(_between(F.col("pickup_latitude"), LATITUDE_RANGE), False).alias("bad_latitude"),
        fails(F.col("trip_time") > F.lit(MIN_TRIP_TIME), True).alias("bad_trip_time"),
        fails(F.col("fare_rev_per_hour") < F.lit(MAX_FARE_RATE), True).alias("bad_fare_rate"),
        F.count_if(validity()).alias("clean"),
    )


def null_to_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Recode missing regions, precipitation or trip counts as 0."""
    return df.fillna(0, subset=list(columns))


def fare_rate_trips(df: DataFrame, weekday: int | None = None) -> DataFrame:
    """Valid trips with a usual fare rate, optionally on one weekday (Sunday = 1)."""
    kept = df.where(
        validity()
        & (F.col("trip_time") > F.lit(MIN_TRIP_TIME))
        & _between(F.col("fare_rev_per_hour"), FARE_RATE_BAND)
    )
    return kept if weekday is None else kept.where(F.col("weekday") == weekday)


def short_trips(df: DataFrame, hours: float = LONGEST_TRIP) -> DataFrame:
    return df.where(F.col("trip_time") < F.lit(hours))
