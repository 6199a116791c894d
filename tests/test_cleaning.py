"""Null rules of the validity flag, column pruning and recoding."""

import pytest
from pyspark.sql import functions as F

from curbflow.functions.timeparts import add_time_features, hours_between, wall_clock
from curbflow.operators import cleaning

COLUMNS = (
    "case string, trip_distance double, fare_amount double, pickup_longitude double, "
    "pickup_latitude double, trip_time double, fare_rev_per_hour double"
)
OK = (2.0, 10.0, -73.9, 40.7, 0.25, 40.0)


def row(case, **changes):
    names = [c.split()[0] for c in COLUMNS.split(", ")][1:]
    values = dict(zip(names, OK), **changes)
    return (case, *values.values())


CASES = [
    (row("ok"), True),
    (row("no distance", trip_distance=None), False),
    (row("no place", pickup_latitude=None), False),
    (row("zero distance", trip_distance=0.0), False),
    (row("too far", trip_distance=100.0, fare_amount=500.0), False),
    (row("cheap", fare_amount=2.0), False),
    (row("dear", fare_amount=40.0), False),
    (row("west", pickup_longitude=-75.0), False),
    (row("east", pickup_longitude=-72.0), False),
    (row("south", pickup_latitude=40.0), False),
    (row("north", pickup_latitude=41.5), False),
    (row("one minute", trip_time=1 / 60), False),
    (row("negative time", trip_time=-0.5, fare_rev_per_hour=-20.0), False),
    (row("fast money", fare_rev_per_hour=1000.0), False),
    (row("zero time, no rate", trip_time=0.0, fare_rev_per_hour=None), False),
    (row("time and rate unknown", trip_time=None, fare_rev_per_hour=None), True),
]


def test_validity_and_nulls(spark):
    df = spark.createDataFrame([r for r, _ in CASES], COLUMNS)
    got = {r["case"]: r["clean"] for r in cleaning.flag_clean(df).collect()}
    assert got == {r[0]: expected for r, expected in CASES}


def test_reject_counts_add_up(spark):
    df = spark.createDataFrame([r for r, _ in CASES], COLUMNS)
    counts = cleaning.reject_counts(df).first().asDict()
    assert counts["trips"] == len(CASES)
    assert counts["clean"] == sum(expected for _, expected in CASES)
    assert counts["bad_trip_time"] == 3


def test_unreadable_datetime_stays_clean(spark):
    raw = spark.createDataFrame(
        [("2015-01-01 00:00:00", "soon", 10.0, 2.0, -73.9, 40.7)],
        "pickup_datetime string, dropoff_datetime string, fare_amount double, trip_distance double, "
        "pickup_longitude double, pickup_latitude double",
    )
    out = cleaning.prepare(raw, parts=()).first()
    assert out["trip_time"] is None and out["fare_rev_per_hour"] is None
    assert out["clean"]


def test_drop_tolerates_missing_columns(spark):
    df = spark.createDataFrame([(1, "x", 2)], "vendor_id int, V1 string, keep int")
    assert cleaning.drop_row_numbers(cleaning.drop_unused(df)).columns == ["keep"]


def test_fare_rate_band_and_cap(spark):
    df = spark.createDataFrame([r for r, _ in CASES], COLUMNS).withColumn("weekday", F.lit(2))
    assert [r["case"] for r in cleaning.fare_rate_trips(df, weekday=2).collect()] == ["ok"]
    assert cleaning.fare_rate_trips(df, weekday=3).count() == 0
    assert cleaning.short_trips(df, 0.2).count() == 3


def test_null_to_zero(spark):
    df = spark.createDataFrame([(None, 5)], "a int, b int")
    assert cleaning.null_to_zero(df, ["a"]).first() == (0, 5)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_duration_ignores_the_session_zone(spark, zone):
    """A night when clocks change still counts wall-clock hours."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2015-03-08 01:30:00", "2015-03-08 03:30:30")], "a string, b string")
        out = df.select(hours_between(wall_clock(F.col("a")), wall_clock(F.col("b"))).alias("h"))
        assert out.first()["h"] == pytest.approx(2 + 30 / 3600, abs=1e-15)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_time_feature_variants(spark):
    raw = spark.createDataFrame(
        [("2015-01-05 06:47:00", "2015-01-05 07:02:00", 12.0)],
        "pickup_datetime string, dropoff_datetime string, fare_amount double",
    )
    full = add_time_features(raw, drop_raw=True).first().asDict()
    assert full["trip_time"] == 0.25 and full["fare_rev_per_hour"] == 48.0
    assert full["weekday"] == 2 and full["pickup_quarter_hour"] == 3
    assert full["dropoff_hour"] == 7 and "pickup_datetime" not in full
    stamp = add_time_features(raw, ends=("pickup",), parts=("year", "month"))
    assert stamp.columns[3:] == ["trip_time", "fare_rev_per_hour", "weekday", "pickup_year", "pickup_month"]
    simple = add_time_features(raw, parts=(), weekday=False)
    assert simple.columns[3:] == ["trip_time", "fare_rev_per_hour"]
    both = add_time_features(raw, parts=("weekday",), rates=False, weekday=False)
    assert both.columns[3:] == ["pickup_weekday", "dropoff_weekday"]
