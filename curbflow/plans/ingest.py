"""Raw trips to tagged, valid trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.raster import Raster
from curbflow.functions.timeparts import add_time_features
from curbflow.operators.cleaning import (
    GRID_TRIP_COLUMNS,
    TRACT_TRIP_COLUMNS,
    drop_row_numbers,
    drop_unused,
    null_to_zero,
    validity,
)
from curbflow.operators.spatial import assign_regions


def tag_tracts(raw: DataFrame, index: DataFrame, raster: Raster) -> DataFrame:
    """Valid trips with the tract of both ends; unmatched ends are 0.

    Validity does not depend on the tract, so it filters first and the spatial
    step sees valid trips only. Nothing is shuffled while the index is broadcast.
    """
    trips = (
        raw.transform(drop_row_numbers)
        .transform(drop_unused)
        .transform(lambda d: add_time_features(d, ends=("pickup",), parts=("year", "month")))
        .where(validity())
    )
    for end in ("pickup", "dropoff"):
        trips = assign_regions(
            trips, index, raster, f"{end}_longitude", f"{end}_latitude", f"{end}_tract_id"
        )
    return null_to_zero(trips, ["pickup_tract_id", "dropoff_tract_id"]).select(*TRACT_TRIP_COLUMNS)


def tag_cells(raw: DataFrame, raster: Raster) -> DataFrame:
    """Valid trips with the raster cell of both ends; ends outside are 0."""
    trips = (
        raw.transform(drop_row_numbers)
        .transform(drop_unused)
        .transform(lambda d: add_time_features(d, parts=(), weekday=False))
        .where(validity())
    )
    cells = {
        f"{end}_grid": F.coalesce(
            raster.cell_of(F.col(f"{end}_longitude"), F.col(f"{end}_latitude")),
            F.lit(0).cast("bigint"),
        )
        for end in ("pickup", "dropoff")
    }
    return trips.withColumns(cells).select(*GRID_TRIP_COLUMNS)
