"""Trips out of, into and between regions per 15-minute slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.functions.aggregates import Mean
from curbflow.functions.timeparts import (
    SLOT_PARTS,
    slot_index,
    slot_parts,
    wall_clock,
    week_slot,
    week_slot_parts,
)
from curbflow.operators.joins import broadcast_if_small, one_row_each

NO_REGION = 0


def _end(end: str, region: str) -> tuple[Column, Column]:
    return F.col(f"{end}_{region}"), slot_index(wall_clock(F.col(f"{end}_datetime")))


def _spread_slot(counts: DataFrame, *columns: str) -> DataFrame:
    """Replace the slot index by its calendar parts."""
    parts = slot_parts(F.col("slot"))
    return counts.select("region_id", *[parts[p].alias(p) for p in SLOT_PARTS], *columns)


def _by_slot(trips: DataFrame, end: str, region: str) -> DataFrame:
    place, slot = _end(end, region)
    return trips.select(place.alias("region_id"), slot.alias("slot"), "*").where(
        F.col("region_id") != NO_REGION
    )


def trips_out(trips: DataFrame, region: str, mean_rate: Mean | None = None) -> DataFrame:
    """Departures per region and slot, with the mean fare rate when asked."""
    sums = [F.count(F.lit(1)).alias("trips_out")]
    if mean_rate is not None:
        sums.append(mean_rate(F.col("fare_rev_per_hour")).alias("mean_fare_rev_per_hour"))
    counts = _by_slot(trips, "pickup", region).groupBy("region_id", "slot").agg(*sums)
    return _spread_slot(counts, *counts.columns[2:])


def trips_in(trips: DataFrame, region: str) -> DataFrame:
    """Arrivals per region and slot."""
    counts = (
        _by_slot(trips, "dropoff", region)
        .groupBy("region_id", "slot")
        .agg(F.count(F.lit(1)).alias("trips_in"))
    )
    return _spread_slot(counts, "trips_in")


def merge_flows(out: DataFrame, into: DataFrame) -> DataFrame:
    """Net flow from two separate count tables: keep both sides, fill with 0."""
    keys = ["region_id", *SLOT_PARTS]
    arrivals = into.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    extra = [c for c in out.columns if c not in (*keys, "trips_out")]
    filled_out = F.coalesce("trips_out", F.lit(0))
    filled_in = F.coalesce("trips_in", F.lit(0))
    return out.join(arrivals, same, "full").select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys],
        filled_out.alias("trips_out"),
        filled_in.alias("trips_in"),
        (filled_in - filled_out).alias("net_trips_in"),
        *extra,
    )


def net_flow(
    trips: DataFrame,
    region: str,
    *,
    mean_rate: Mean | None = None,
    exclude_internal: bool = False,
) -> DataFrame:
    """Departures, arrivals and their difference per region and slot.

    ``region`` is the column suffix (``pickup_<region>``, ``dropoff_<region>``).
    Each trip is read once and split into its two ends, so one aggregation
    replaces two counts and a full join. The grouping key is (region, slot): a
    busy region spreads over its slots and is counted before the shuffle. Slots without trips have no row. ``exclude_internal`` leaves out
    trips that start and end in the same region.
    """
    out_place, out_slot = _end("pickup", region)
    in_place, in_slot = _end("dropoff", region)
    unknown = F.lit(None).cast("double")
    rate = F.col("fare_rev_per_hour") if mean_rate is not None else unknown

    def leg(place: Column, slot: Column, leaving: bool, fare_rate: Column) -> Column:
        return F.struct(
            place.alias("region_id"),
            slot.alias("slot"),
            F.lit(leaving).alias("leaving"),
            fare_rate.alias("rate"),
        )

    if exclude_internal:
        trips = trips.where(~out_place.eqNullSafe(in_place))
    legs = trips.select(
        F.inline(
            F.array(
                leg(out_place, out_slot, True, rate),
                leg(in_place, in_slot, False, unknown),
            )
        )
    ).where(F.col("region_id") != NO_REGION)
    sums = [
        F.count_if(F.col("leaving")).alias("trips_out"),
        F.count_if(~F.col("leaving")).alias("trips_in"),
    ]
    if mean_rate is not None:
        sums.append(mean_rate(F.col("rate")).alias("mean_fare_rev_per_hour"))
    counts = legs.groupBy("region_id", "slot").agg(*sums)
    counts = counts.withColumn("net_trips_in", F.col("trips_in") - F.col("trips_out"))
    extra = ["mean_fare_rev_per_hour"] if mean_rate is not None else []
    return _spread_slot(counts, "trips_out", "trips_in", "net_trips_in", *extra)


def _week_slot_counts(trips: DataFrame, region: str, clock: str, count: str) -> DataFrame:
    ts = wall_clock(F.col(f"{clock}_datetime"))
    ends = [f"pickup_{region}", f"dropoff_{region}"]
    counts = (
        trips.select(*ends, week_slot(ts).alias("slot"))
        .groupBy(*ends, "slot")
        .agg(F.count(F.lit(1)).alias(count))
    )
    parts = week_slot_parts(F.col("slot"))
    return counts.select(*ends, *[part.alias(name) for name, part in parts.items()], count)


def transfers_out(trips: DataFrame, region: str) -> DataFrame:
    """Trips leaving each region, by destination and weekday slot (pickup clock)."""
    return _week_slot_counts(trips, region, "pickup", "trips").where(
        F.col(f"pickup_{region}") != NO_REGION
    )


def transfers_into(trips: DataFrame, region: str) -> DataFrame:
    """Trips entering each region, by origin and weekday slot (dropoff clock)."""
    return _week_slot_counts(trips, region, "dropoff", "trips").where(
        F.col(f"dropoff_{region}") != NO_REGION
    )


def od_matrix(trips: DataFrame, region: str) -> DataFrame:
    """Sparse origin × destination × weekday slot counts.

    The unknown region is dropped as an origin but kept as a destination.
    """
    return transfers_out(trips, region).withColumnRenamed("trips", "n")


def od_share(matrix: DataFrame, region: str) -> DataFrame:
    """Share of each destination among the departures of one origin and slot.

    Runs on the aggregated matrix; a window group holds one row per destination.
    """
    departures = Window.partitionBy(f"pickup_{region}", "weekday", "hour", "quarter_hour")
    return matrix.withColumn("share", F.col("n") / F.sum("n").over(departures))


def region_parity(trips: DataFrame, region: str) -> DataFrame:
    """Regions that occur only as an origin or only as a destination."""
    ends = trips.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.col(f"{end}_{region}").alias("region_id"),
                        F.lit(end == "pickup").alias("is_origin"),
                    )
                    for end in ("pickup", "dropoff")
                ]
            )
        )
    )
    return (
        ends.where(F.col("region_id").isNotNull())
        .groupBy("region_id")
        .agg(
            F.bool_or("is_origin").alias("has_pickups"),
            F.bool_or(~F.col("is_origin")).alias("has_dropoffs"),
        )
        .where(F.col("has_pickups") != F.col("has_dropoffs"))
    )


def at_level(
    trips: DataFrame, codes: DataFrame, region: str, level: str, *, at_most_regions: int | None = None
) -> DataFrame:
    """Attach ``pickup_<level>`` and ``dropoff_<level>`` from a region code table.

    ``codes`` holds one row per region with the columns ``region`` and ``level``; a region
    listed twice is an error. Unlisted regions become 0.
    """
    out = trips
    codes = broadcast_if_small(one_row_each(codes.select(region, level), [region]), at_most_rows=at_most_regions)
    for end in ("pickup", "dropoff"):
        side = codes.select(
            F.col(region).alias(f"{end}_{region}"), F.col(level).alias(f"{end}_{level}")
        )
        out = out.join(side, f"{end}_{region}", "left")
    return out.fillna(0, subset=[f"pickup_{level}", f"dropoff_{level}"])
