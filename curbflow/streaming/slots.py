"""15-minute slot counts on a stream of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.timeparts import SLOT_MINUTES, SLOT_PARTS, clock_part
from curbflow.operators.flows import NO_REGION


def stream_net_flow(trips: DataFrame, region: str, *, lateness: str) -> DataFrame:
    """Net flow per region and slot, emitted once a slot can no longer change.

    Both ends of a trip are events of their own time. ``lateness`` must cover the
    longest trip, since a pickup is only known once the trip has been recorded: the
    pickup of a longer trip is discarded, and its dropoff still counts. Spark reports
    the discarded rows as ``numRowsDroppedByWatermark`` in the query's progress.
    Works on a batch DataFrame too, where the watermark has no effect.
    """

    def leg(end: str, leaving: bool):
        return F.struct(
            F.col(f"{end}_{region}").alias("region_id"),
            F.col(f"{end}_datetime").cast("timestamp").alias("event_time"),
            F.lit(leaving).alias("leaving"),
        )

    legs = (
        trips.select(F.inline(F.array(leg("pickup", True), leg("dropoff", False))))
        .where(F.col("region_id") != NO_REGION)
        .withWatermark("event_time", lateness)
    )
    counts = legs.groupBy("region_id", F.window("event_time", f"{SLOT_MINUTES} minutes")).agg(
        F.count_if("leaving").alias("trips_out"), F.count_if(~F.col("leaving")).alias("trips_in")
    )
    start = F.col("window.start")
    return counts.select(
        "region_id",
        *[clock_part(start, p).alias(p) for p in SLOT_PARTS],
        "trips_out",
        "trips_in",
        (F.col("trips_in") - F.col("trips_out")).alias("net_trips_in"),
    )
