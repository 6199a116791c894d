"""Tagged trips to net flow, weather, area roll-ups, typical weeks and map frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.functions.aggregates import Mean
from curbflow.operators.flows import net_flow
from curbflow.operators.rollup import attach_codes, attach_weather, roll_up, typical_week


@dataclass(frozen=True)
class AreaWeeks:
    """Typical weeks at the three area levels."""

    region: DataFrame
    neighborhood: DataFrame
    borough: DataFrame


def net_with_areas(
    trips: DataFrame,
    weather: DataFrame,
    codes: DataFrame,
    region: str,
    *,
    at_most_regions: int | None = None,
) -> DataFrame:
    """Net flow per region and slot, with hourly weather and area codes."""
    net = attach_weather(net_flow(trips, region), weather)
    return attach_codes(net, codes, at_most_regions=at_most_regions)


def area_weeks(
    net: DataFrame,
    *,
    borough: str = "borough_code",
    neighborhood: str = "neighborhood_code",
    mean: Mean = F.avg,
) -> AreaWeeks:
    """Typical weeks of regions, neighbourhoods and boroughs from one net table."""
    areas = [borough, neighborhood]
    return AreaWeeks(
        region=typical_week(net, [*areas, "region_id"], mean=mean),
        neighborhood=typical_week(roll_up(net, areas, mean=mean), areas, mean=mean),
        borough=typical_week(roll_up(net, [borough], mean=mean), [borough], mean=mean),
    )
