"""Clock arithmetic on wall-clock (zone-free) timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_MINUTES = 15
SLOTS_PER_HOUR = 60 // SLOT_MINUTES
SLOTS_PER_DAY = 24 * SLOTS_PER_HOUR

SLOT_PARTS = ("year", "month", "day", "weekday", "hour", "quarter_hour")
ALL_PARTS = ("year", "month", "day", "weekday", "hour", "min", "quarter_hour")


def wall_clock(text: Column) -> Column:
    """Parse ``yyyy-MM-dd HH:mm:ss`` text; unreadable text becomes NULL."""
    return text.try_cast("timestamp_ntz")


def weather_clock(text: Column) -> Column:
    """Parse 12-hour readings such as ``2015-01-01 1:51 AM``."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd h:mm a")).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Hours as a double. The interval is taken on the wall clock, without a zone."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)").cast("double")
    return seconds / F.lit(3600.0)


def quarter_hour(ts: Column) -> Column:
    return F.floor(F.minute(ts) / SLOT_MINUTES).cast("int")


def clock_part(ts: Column, part: str) -> Column:
    """One calendar part; weekdays count from Sunday = 1."""
    parts = {
        "year": F.year,
        "month": F.month,
        "day": F.dayofmonth,
        "weekday": F.dayofweek,
        "hour": F.hour,
        "min": F.minute,
        "quarter_hour": quarter_hour,
    }
    return parts[part](ts)


def slot_index(ts: Column) -> Column:
    """15-minute slots since 1970-01-01 00:00 on the wall clock.

    One number stands for all calendar parts, so rows are grouped by it and the
    parts are worked out once per group (``slot_parts``, ``week_slot_parts``).
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (ts - epoch).cast("interval second").cast("bigint")
    return F.floor(seconds / F.lit(float(SLOT_MINUTES * 60)))


def _in_day(slot: Column) -> dict[str, Column]:
    of_day = F.pmod(slot, F.lit(SLOTS_PER_DAY))
    return {
        "hour": F.floor(of_day / SLOTS_PER_HOUR).cast("int"),
        "quarter_hour": (of_day % SLOTS_PER_HOUR).cast("int"),
    }


def slot_parts(slot: Column) -> dict[str, Column]:
    """Calendar parts of a slot index."""
    date = F.date_from_unix_date(F.floor(slot / SLOTS_PER_DAY).cast("int"))
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day": F.dayofmonth(date),
        "weekday": F.dayofweek(date),
        **_in_day(slot),
    }


def week_slot(ts: Column) -> Column:
    """Slot of the week, 0..671, from Sunday 00:00. 1970-01-01 was a Thursday."""
    return F.pmod(slot_index(ts) + 4 * SLOTS_PER_DAY, F.lit(7 * SLOTS_PER_DAY))


def week_slot_parts(slot: Column) -> dict[str, Column]:
    """Weekday (Sunday = 1), hour and quarter of a week slot."""
    return {"weekday": (F.floor(slot / SLOTS_PER_DAY) + 1).cast("int"), **_in_day(slot)}


def fractional_hour(hour: Column, minute: Column) -> Column:
    return hour + minute / F.lit(60.0)


def slot_hour(hour: Column, quarter: Column) -> Column:
    return hour + quarter / F.lit(float(SLOTS_PER_HOUR))


def mid_hour(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Timestamp at half past the given hour."""
    return F.make_timestamp_ntz(year, month, day, hour, F.lit(30), F.lit(0))


def mid_day(year: Column, month: Column, day: Column) -> Column:
    return mid_hour(year, month, day, F.lit(12))


def add_time_features(
    df: DataFrame,
    *,
    ends: Sequence[str] = ("pickup", "dropoff"),
    parts: Sequence[str] = ("year", "month", "day", "hour", "min", "quarter_hour"),
    rates: bool = True,
    weekday: bool = True,
    drop_raw: bool = False,
) -> DataFrame:
    """Append trip duration, fare rate and calendar parts.

    ``rates`` adds ``trip_time`` (hours) and ``fare_rev_per_hour``; ``weekday``
    adds the pickup weekday; ``parts`` are added for each of ``ends`` with the
    end as prefix; ``drop_raw`` removes the two datetime columns at the end.
    """
    clocks = {end: wall_clock(F.col(f"{end}_datetime")) for end in ("pickup", "dropoff")}
    added: dict[str, Column] = {}
    if rates:
        trip_time = hours_between(clocks["pickup"], clocks["dropoff"])
        added["trip_time"] = trip_time
        added["fare_rev_per_hour"] = F.try_divide(F.col("fare_amount"), trip_time)
    if weekday:
        added["weekday"] = F.dayofweek(clocks["pickup"])
    for part in parts:
        for end in ends:
            added[f"{end}_{part}"] = clock_part(clocks[end], part)
    out = df.withColumns(added)
    return out.drop("pickup_datetime", "dropoff_datetime") if drop_raw else out
