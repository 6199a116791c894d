"""Weather and area attributes on net flow, roll-ups, typical weeks, map frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbflow.functions.aggregates import Mean, clip
from curbflow.functions.text import slot_label
from curbflow.functions.timeparts import SLOT_PARTS, SLOTS_PER_DAY, SLOTS_PER_HOUR
from curbflow.operators.joins import broadcast_if_small, one_row_each

TRIP_MEASURES = ("trips_out", "trips_in", "net_trips_in")
WEATHER_MEASURES = ("temperature", "precipitation", "windspeed")
WEEK_KEYS = ("weekday", "hour", "quarter_hour")

# Colour limits of the two map series, and Monday.
TRACT_CLIP = 10.0
BOROUGH_CLIP = 320.0
MONDAY = 2


def attach_weather(
    net: DataFrame, weather: DataFrame, *, at_most_hours: int | None = None
) -> DataFrame:
    """Hourly weather on every net-flow row; rows without a reading are kept.

    Without a known bound the weather table is counted, so pass a stored one.
    """
    side = broadcast_if_small(weather, at_most_rows=at_most_hours)
    return net.join(side, ["year", "month", "day", "hour"], "left")


def attach_codes(
    net: DataFrame,
    codes: DataFrame,
    region: str = "region_id",
    *,
    at_most_regions: int | None = None,
) -> DataFrame:
    """Area attributes on every row; regions missing from the codes are kept, and a region
    listed twice is an error. For codes that change over time see ``attach_dated_codes``."""
    single = one_row_each(codes, [region])
    return net.join(broadcast_if_small(single, at_most_rows=at_most_regions), region, "left")


def overlapping_codes(codes: DataFrame, region: str = "region_id") -> DataFrame:
    """Rows of a dated code table that begin before an earlier row of the region ends, or
    that end before they begin."""
    until = F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    earlier = F.max(until).over(
        Window.partitionBy(region).orderBy("valid_from", until).rowsBetween(Window.unboundedPreceding, -1)
    )
    return codes.withColumn("_earlier", earlier).where((F.col("valid_from") < F.col("_earlier")) | (F.col("valid_from") >= until)).drop("_earlier")


def attach_dated_codes(net: DataFrame, codes: DataFrame, region: str = "region_id") -> DataFrame:
    """Area attributes as they were on the day of each row.

    ``codes`` has ``valid_from`` and ``valid_to`` (dates, the latter excluded and NULL for
    open) beside the region and its attributes. That no two rows of a region overlap is
    checked once, before the join. A code row is laid out by the months that it covers
    among those of ``net``, and meets the rows of its region and month, so the join has
    equal keys and no row meets more than the few versions of a month. Rows of days
    that no version covers are kept, with NULLs.
    """
    bad = overlapping_codes(codes, region).limit(1).collect()
    if bad:
        raise ValueError(f"codes overlap: {bad[0].asDict()}")
    day = F.make_date("year", "month", "day")
    bucket = F.year(F.col("_day")) * 12 + F.month(F.col("_day"))
    dated = net.withColumn("_day", day).withColumn("_bucket", bucket)
    span = dated.agg(F.min("_bucket"), F.max("_bucket")).first()
    attributes = [c for c in codes.columns if c not in (region, "valid_from", "valid_to")]
    if span[0] is None:
        span = (0, 0)
    first = F.greatest(F.year("valid_from") * 12 + F.month("valid_from"), F.lit(span[0]))
    last_day = F.date_sub(F.coalesce("valid_to", F.lit("9999-12-31").cast("date")), 1)
    last = F.least(F.year(last_day) * 12 + F.month(last_day), F.lit(span[1]))
    laid = codes.withColumns({"_first": first, "_last": last}).where("_first <= _last").select(
        F.col(region).alias("_region"),
        F.explode(F.sequence("_first", "_last")).alias("_month"),
        "valid_from",
        "valid_to",
        *attributes,
    )
    within = (F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    same = (F.col(region) == F.col("_region")) & (F.col("_bucket") == F.col("_month"))
    joined = dated.join(broadcast_if_small(laid), same & within, "left")
    return joined.select(*net.columns, *attributes)


def roll_up(
    net: DataFrame, areas: Sequence[str], *, mean: Mean = F.avg, weather: bool = True
) -> DataFrame:
    """Sum trips and average weather over the regions of each area, per slot."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TRIP_MEASURES]
    means = [mean(F.col(c)).alias(c) for c in WEATHER_MEASURES] if weather else []
    return net.groupBy(*areas, *SLOT_PARTS).agg(*sums, *means)


def roll_up_levels(net: DataFrame, levels: Sequence[Sequence[str]]) -> DataFrame:
    """Trip sums for several area levels in one pass (grouping sets).

    ``level`` is the number of area columns that a row is grouped by; the other
    area columns are NULL.
    """
    areas = list(dict.fromkeys(column for level in levels for column in level))
    keys = [*areas, *SLOT_PARTS]
    sets = [[F.col(c) for c in (*level, *SLOT_PARTS)] for level in levels]
    present = sum((F.lit(1) - F.grouping(c).cast("int") for c in areas), F.lit(0))
    return net.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        present.alias("level"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TRIP_MEASURES],
    )


def typical_week(
    df: DataFrame,
    areas: Sequence[str],
    *,
    measures: Sequence[str] = (*TRIP_MEASURES, *WEATHER_MEASURES),
    mean: Mean = F.avg,
) -> DataFrame:
    """Mean of each measure by area and weekday slot, over the slots that exist."""
    return df.groupBy(*areas, *WEEK_KEYS).agg(*[mean(F.col(m)).alias(m) for m in measures])


def flow_patterns(
    df: DataFrame, *, measures: Sequence[str] = TRIP_MEASURES, mean: Mean = F.avg
) -> DataFrame:
    """Daily, monthly and yearly mean patterns in one pass.

    ``pattern`` names the grain: daily (weekday, hour, quarter), monthly (month,
    day) or yearly (year, month).
    """
    grains = [("weekday", "hour", "quarter_hour"), ("month", "day"), ("year", "month")]
    keys = list(dict.fromkeys(k for grain in grains for k in grain))
    pattern = (
        F.when(F.grouping("weekday") == 0, "daily")
        .when(F.grouping("day") == 0, "monthly")
        .otherwise("yearly")
    )
    return df.groupingSets(
        [[F.col(k) for k in grain] for grain in grains], *[F.col(k) for k in keys]
    ).agg(pattern.alias("pattern"), *[mean(F.col(m)).alias(m) for m in measures])


def densify(
    values: DataFrame, domain: DataFrame, keys: Sequence[str], fill: float | None = None
) -> DataFrame:
    """Every key of ``domain``; keys without a value are NULL, or ``fill``.

    Aggregate first and densify only the slice that is shown: all regions squared
    by all slots of a week are billions of rows.
    """
    out = domain.join(values, list(keys), "left")
    if fill is None:
        return out
    return out.fillna(fill, subset=[c for c in values.columns if c not in keys])


def id_domain(spark: SparkSession, last: int, key: str = "region_id") -> DataFrame:
    """Ids 1 to ``last``."""
    return spark.range(1, last + 1).withColumnRenamed("id", key)


def _frames(regions: DataFrame) -> DataFrame:
    """Regions × the 96 slots of a day, as rows."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS_PER_DAY - 1))).alias("slot")
    return regions.select("*", slots).select(
        *regions.columns,
        F.floor(F.col("slot") / SLOTS_PER_HOUR).cast("int").alias("hour"),
        (F.col("slot") % SLOTS_PER_HOUR).cast("int").alias("quarter_hour"),
    )


def map_frames(
    week: DataFrame,
    regions: DataFrame,
    *,
    area: str,
    limit: float,
    weekday: int = MONDAY,
    value: str = "net_trips_in",
) -> DataFrame:
    """One value per map region and slot of a weekday, clipped to ``±limit``.

    ``week`` is a typical week by ``area``; ``regions`` lists the shapes of the
    map with their ``area``, so a borough value spreads over its tracts.
    """
    label: Column = slot_label(F.col("hour"), F.col("quarter_hour"))
    slice_ = week.where(F.col("weekday") == weekday).select(
        area, "hour", "quarter_hour", F.col(value).alias("value")
    )
    return (
        _frames(regions)
        .join(slice_, [area, "hour", "quarter_hour"], "left")
        .withColumns({"label": label, "value": clip(F.col("value"), limit)})
    )
