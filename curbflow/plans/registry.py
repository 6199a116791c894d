"""The queries over the test tables, one per operator or chain of operators.

Means are taken over whole millionths, so that the results can be compared bit by
bit with another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.aggregates import scaled_mean
from curbflow.functions.projection import LONG_ISLAND_ZONE, NEW_JERSEY_ZONE
from curbflow.functions.raster import Raster
from curbflow.functions.text import padded_id, slot_label
from curbflow.functions.timeparts import ALL_PARTS, add_time_features, fractional_hour, slot_hour
from curbflow.operators import cleaning, dissolve, flows, graph, models, raster, rollup, spatial, stats
from curbflow.operators import weather as readings_ops
from curbflow.operators.joins import broadcast_if_small
from curbflow.plans import standins
from curbflow.plans.ingest import tag_cells
from curbflow.plans.mobility import area_weeks, net_with_areas
from curbflow.plans.standins import COARSE, GRID
from curbflow.plans.transport import transport_graph
from curbflow.session import enable_checkpoints, shared_dir
from curbflow.sources import raw, tables, versions
from curbflow.sources.layers import reproject
from curbflow.sources.weather import readings_from_pages

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

MEAN = scaled_mean(1_000_000)
RTL = Raster(800, left_to_right=False)
RIDE_GRID = raster.FineGrid(lon_min=-74.05, lon_max=-73.75, lat_min=40.6)
DENSITY = {"bandwidth": 2.0, "low": 0.0, "high": 205.0, "points": 512}
SMOOTH = {"bins": 99, "reach": 3, "sigma": 1.5}
DIFFUSION_STEPS = 99
CROSS_CELLS = 400
SAMPLE_SIZE = 500
RERUN_TRACTS = 32
ONE_TRACT = 5
CODES_CHANGE = "2024-01-16"
NETWORK_STEPS = 40
FIRST_LAYER = 2
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- time features, validity ----------------------------------------------------


@query
def trip_time_features(spark, sf_dir):
    out = add_time_features(standins.trips(spark, sf_dir), parts=ALL_PARTS)
    parts = [f"{end}_{part}" for part in ALL_PARTS for end in ("pickup", "dropoff")]
    return out.select(
        "trip_id",
        "trip_time",
        "fare_rev_per_hour",
        "weekday",
        *parts,
        fractional_hour(F.col("pickup_hour"), F.col("pickup_min")).alias("pickup_time"),
        slot_hour(F.col("pickup_hour"), F.col("pickup_quarter_hour")).alias("pickup_slot_hour"),
    )


def _timed(spark, sf_dir):
    return add_time_features(standins.trips(spark, sf_dir), parts=())


@query
def clean_trips(spark, sf_dir):
    columns = ["trip_id", "trip_distance", "fare_amount", "trip_time", "fare_rev_per_hour"]
    return cleaning.clean_trips(_timed(spark, sf_dir), columns)


@query
def clean_flags(spark, sf_dir):
    out = cleaning.prepare(standins.trips(spark, sf_dir), parts=())
    return out.select("trip_id", "clean")


@query
def clean_reject_counts(spark, sf_dir):
    return cleaning.reject_counts(_timed(spark, sf_dir))


# --- raster -----------------------------------------------------------------------


def _cell(raster_: Raster, end: str):
    return raster_.cell_of(F.col(f"{end}_longitude"), F.col(f"{end}_latitude"))


@query
def point_to_cell_ltr(spark, sf_dir):
    return standins.trips(spark, sf_dir).select(
        "trip_id", *[_cell(GRID, end).alias(f"{end}_grid") for end in ("pickup", "dropoff")]
    )


@query
def point_to_cell_rtl(spark, sf_dir):
    return standins.trips(spark, sf_dir).select(
        "trip_id", *[_cell(RTL, end).alias(f"{end}_grid") for end in ("pickup", "dropoff")]
    )


@query
def cell_flip(spark, sf_dir):
    cells = standins.trips(spark, sf_dir).select("trip_id", _cell(RTL, "pickup").alias("cell"))
    return cells.withColumn("flipped", RTL.flip(F.col("cell")))


@query
def cell_reduce(spark, sf_dir):
    cells = standins.trips(spark, sf_dir).select("trip_id", _cell(GRID, "pickup").alias("cell"))
    return cells.withColumn("coarse", GRID.coarsen(F.col("cell"), 25))


def _used_cells(spark, sf_dir, raster_: Raster = GRID):
    """Cells with a valid pickup, and the number of pickups."""
    return (
        standins.cell_trips(spark, sf_dir, raster_)
        .where(F.col("pickup_grid") != 0)
        .groupBy(F.col("pickup_grid").alias("cell_id"))
        .agg(F.count(F.lit(1)).alias("pickups"))
    )


@query
def cell_centroids(spark, sf_dir):
    cell = F.col("cell_id")
    return _used_cells(spark, sf_dir).withColumns(
        {"lon": GRID.center_lon(cell), "lat": GRID.center_lat(cell)}
    )


@query
def cell_polygons(spark, sf_dir):
    outlines = spatial.cell_outlines(_used_cells(spark, sf_dir), GRID)
    vertices = outlines.select("cell_id", F.posexplode("ring").alias("seq", "vertex"))
    return vertices.select("cell_id", "seq", "vertex.lon", "vertex.lat")


# --- flows ------------------------------------------------------------------------


@query
def net_flow_by_cell(spark, sf_dir):
    return flows.net_flow(standins.cell_trips(spark, sf_dir, COARSE), "grid")


@query
def net_flow_by_join(spark, sf_dir):
    trips = standins.cell_trips(spark, sf_dir, COARSE)
    return flows.merge_flows(flows.trips_out(trips, "grid", MEAN), flows.trips_in(trips, "grid"))


@query
def net_flow_fare_rate(spark, sf_dir):
    return flows.net_flow(standins.cell_trips(spark, sf_dir, COARSE), "grid", mean_rate=MEAN)


@query
def net_flow_by_tract(spark, sf_dir):
    return flows.net_flow(standins.tract_trips(spark, sf_dir), "tract_id")


@query
def transfer_out(spark, sf_dir):
    return flows.transfers_out(standins.tract_trips(spark, sf_dir), "tract_id")


@query
def transfer_into(spark, sf_dir):
    return flows.transfers_into(standins.tract_trips(spark, sf_dir), "tract_id")


@query
def od_matrix(spark, sf_dir):
    return flows.od_matrix(standins.tract_trips(spark, sf_dir), "tract_id")


@query
def od_share(spark, sf_dir):
    matrix = flows.od_matrix(standins.cell_trips(spark, sf_dir, COARSE), "grid")
    return flows.od_share(matrix, "grid")


@query
def region_parity(spark, sf_dir):
    return flows.region_parity(standins.cell_trips(spark, sf_dir), "grid")


@query
def od_slice_dense(spark, sf_dir):
    """One weekday slot of the matrix with a row for every pair of tracts."""
    eight = (F.col("weekday") == rollup.MONDAY) & (F.col("hour") == 8) & (F.col("quarter_hour") == 0)
    matrix = flows.od_matrix(standins.tract_trips(spark, sf_dir), "tract_id").where(eight)
    counts = matrix.select("pickup_tract_id", "dropoff_tract_id", "n")
    pairs = rollup.id_domain(spark, standins.N_TRACTS, "pickup_tract_id").select(
        F.col("pickup_tract_id").cast("int").alias("pickup_tract_id"),
        F.explode(F.sequence(F.lit(1), F.lit(standins.N_TRACTS))).alias("dropoff_tract_id"),
    )
    return rollup.densify(counts, pairs, ["pickup_tract_id", "dropoff_tract_id"], fill=0)


@query
def unused_cells(spark, sf_dir):
    return stats.missing_ids(GRID.cells(spark), _used_cells(spark, sf_dir), "cell_id")


# --- tracts -----------------------------------------------------------------------


@query
def tract_quick_assign(spark, sf_dir):
    points = standins.trips(spark, sf_dir)
    out = spatial.assign_quick(
        points,
        standins.tract_index(spark),
        GRID,
        "pickup_longitude",
        "pickup_latitude",
        "quick_tract_id",
    )
    return out.select("trip_id", "quick_tract_id")


def _assigned(spark, sf_dir, exact):
    index = standins.tract_index(spark)
    out = standins.trips(spark, sf_dir)
    for end in ("pickup", "dropoff"):
        out = spatial.assign_regions(
            out,
            index,
            GRID,
            f"{end}_longitude",
            f"{end}_latitude",
            f"{end}_tract_id",
            exact=exact,
        )
    return out.select("trip_id", "pickup_tract_id", "dropoff_tract_id")


@query
def tract_assign(spark, sf_dir):
    return _assigned(spark, sf_dir, exact=False)


@query
def tract_assign_exact(spark, sf_dir):
    return _assigned(spark, sf_dir, exact=True)


@query
def tagged_trips(spark, sf_dir):
    return standins.tract_trips(spark, sf_dir)


@query
def used_cell_candidates(spark, sf_dir):
    """Candidate tracts of the cells in use."""
    index = spatial.candidate_ids(standins.tract_index(spark))
    return (
        _used_cells(spark, sf_dir)
        .join(index, "cell_id", "left")
        .select("cell_id", "pickups", F.explode_outer("region_ids").alias("region_id"))
    )


@query
def tracts_of_used_cells(spark, sf_dir):
    return spatial.regions_of_cells(standins.tract_index(spark), _used_cells(spark, sf_dir))


@query
def vertices_with_pickups(spark, sf_dir):
    """Tract outlines as vertex rows, each with its tract's pickups."""
    pickups = (
        standins.tract_trips(spark, sf_dir)
        .groupBy(F.col("pickup_tract_id").alias("region_id"))
        .agg(F.count(F.lit(1)).alias("pickups"))
    )
    return spatial.vertices_of(standins.tract_rings(spark)).join(pickups, "region_id")


@query
def reprojected_points(spark, sf_dir):
    """Plane coordinates made from events, in both zones, back to degrees."""
    event = F.col("event_id")
    plane = standins.table(spark, sf_dir, "events").select(
        "event_id",
        (F.lit(913000.0) + ((event * 7919) % 154321).cast("double")).alias("x"),
        (F.lit(120000.0) + ((event * 6101) % 152345).cast("double")).alias("y"),
        (F.lit(400000.0) + ((event * 3571) % 254321).cast("double")).alias("x2"),
        (F.lit(500000.0) + ((event * 4409) % 252345).cast("double")).alias("y2"),
    )
    east = reproject(plane, LONG_ISLAND_ZONE)
    both = reproject(
        east.withColumnsRenamed({"lon": "east_lon", "lat": "east_lat"}), NEW_JERSEY_ZONE, "x2", "y2"
    )
    return both.select(
        "event_id",
        *[F.round(c, 6).alias(c) for c in ("east_lon", "east_lat")],
        F.round("lon", 6).alias("west_lon"),
        F.round("lat", 6).alias("west_lat"),
    )


# --- weather, roll-ups, weeks -------------------------------------------------------


def _hourly(spark, sf_dir):
    clean = readings_ops.clean_readings(standins.readings(spark, sf_dir))
    return readings_ops.hourly_weather(clean, mean=MEAN)


def _stored_hourly(spark, sf_dir):
    """Hourly weather as a stored table: read twice, to size it and to join it."""
    enable_checkpoints(spark)
    return _hourly(spark, sf_dir).checkpoint()


@query
def hourly_weather(spark, sf_dir):
    return _hourly(spark, sf_dir)


@query
def net_with_weather(spark, sf_dir):
    net = flows.net_flow(standins.cell_trips(spark, sf_dir, COARSE), "grid")
    return rollup.attach_weather(net, _stored_hourly(spark, sf_dir))


def _areas_net(spark, sf_dir):
    return net_with_areas(
        standins.tract_trips(spark, sf_dir),
        _stored_hourly(spark, sf_dir),
        standins.tract_codes(spark, sf_dir),
        "tract_id",
        at_most_regions=standins.N_TRACTS,
    )


AREAS = ["borough_code", "neighborhood_code"]


@query
def net_with_codes(spark, sf_dir):
    return _areas_net(spark, sf_dir)


@query
def net_with_dated_codes(spark, sf_dir):
    """Neighbourhoods as they were on the day: every tract moves to the next one once."""
    codes = standins.tract_codes(spark, sf_dir).select("region_id", "neighborhood_code")
    moved = (F.col("neighborhood_code") + 1) % standins.N_NEIGHBORHOODS
    day, never = F.lit(CODES_CHANGE).cast("date"), F.lit(None).cast("date")
    dated = codes.withColumns({"valid_from": F.lit("2000-01-01").cast("date"), "valid_to": day}).unionByName(
        codes.withColumns({"neighborhood_code": moved.cast("int"), "valid_from": day, "valid_to": never})
    )
    net = flows.net_flow(standins.tract_trips(spark, sf_dir), "tract_id")
    return rollup.roll_up(rollup.attach_dated_codes(net, dated), AREAS[1:], weather=False)


@query
def rollup_neighborhood(spark, sf_dir):
    return rollup.roll_up(_areas_net(spark, sf_dir), AREAS, mean=MEAN)


@query
def rollup_borough(spark, sf_dir):
    return rollup.roll_up(_areas_net(spark, sf_dir), AREAS[:1], mean=MEAN)


@query
def rollup_all_levels(spark, sf_dir):
    levels = [AREAS[:1], AREAS, [*AREAS, "region_id"]]
    net = rollup.attach_codes(
        flows.net_flow(standins.tract_trips(spark, sf_dir), "tract_id"),
        standins.tract_codes(spark, sf_dir),
        at_most_regions=standins.N_TRACTS,
    )
    return rollup.roll_up_levels(net, levels)


@query
def net_flow_between_boroughs(spark, sf_dir):
    """Net flow counted at borough level, trips within a borough left out."""
    codes = standins.tract_codes(spark, sf_dir).withColumnRenamed("region_id", "tract_id")
    trips = flows.at_level(
        standins.tract_trips(spark, sf_dir), codes, "tract_id", "borough_code", at_most_regions=standins.N_TRACTS
    )
    return flows.net_flow(trips, "borough_code", exclude_internal=True)


@query
def typical_week_tract(spark, sf_dir):
    return area_weeks(_areas_net(spark, sf_dir), mean=MEAN).region


@query
def typical_week_neighborhood(spark, sf_dir):
    return area_weeks(_areas_net(spark, sf_dir), mean=MEAN).neighborhood


@query
def typical_week_borough(spark, sf_dir):
    return area_weeks(_areas_net(spark, sf_dir), mean=MEAN).borough


@query
def flow_patterns(spark, sf_dir):
    net = flows.net_flow(standins.cell_trips(spark, sf_dir, COARSE), "grid")
    return rollup.flow_patterns(net, mean=MEAN)


def _net_week(spark, sf_dir, areas):
    net = rollup.attach_codes(
        flows.net_flow(standins.tract_trips(spark, sf_dir), "tract_id"),
        standins.tract_codes(spark, sf_dir),
        at_most_regions=standins.N_TRACTS,
    )
    if areas != ["region_id"]:
        net = rollup.roll_up(net, areas, weather=False)
    return rollup.typical_week(net, areas, measures=rollup.TRIP_MEASURES, mean=MEAN)


@query
def map_frames_tract(spark, sf_dir):
    regions = rollup.id_domain(spark, standins.N_TRACTS)
    return rollup.map_frames(
        _net_week(spark, sf_dir, ["region_id"]), regions, area="region_id", limit=1.0
    )


@query
def map_frames_borough(spark, sf_dir):
    regions = standins.tract_codes(spark, sf_dir).select("region_id", "borough_code")
    return rollup.map_frames(
        _net_week(spark, sf_dir, ["borough_code"]), regions, area="borough_code", limit=2.0
    )


@query
def dense_tract_totals(spark, sf_dir):
    net = flows.net_flow(standins.tract_trips(spark, sf_dir), "tract_id")
    totals = net.groupBy("region_id").agg(F.sum("net_trips_in").alias("net_trips_in"))
    dense = rollup.densify(
        totals, rollup.id_domain(spark, standins.N_TRACTS + 6), ["region_id"], fill=0
    )
    return dense.withColumn("region_label", padded_id(F.col("region_id")))


@query
def net_bounds(spark, sf_dir):
    week = _net_week(spark, sf_dir, ["region_id"]).where(F.col("weekday") == rollup.MONDAY)
    return stats.value_range(week, "net_trips_in")


@query
def net_quantiles(spark, sf_dir):
    week = _net_week(spark, sf_dir, ["region_id"]).where(F.col("weekday") == rollup.MONDAY)
    return stats.exact_quantiles(week, "net_trips_in", {"q01": 0.01, "q99": 0.99})


@query
def fare_rate_quantiles(spark, sf_dir):
    """Quantiles of a continuous value over all valid trips."""
    trips = cleaning.clean_trips(_timed(spark, sf_dir))
    return stats.exact_quantiles(trips, "fare_rev_per_hour", {**QUARTILES, "q01": 0.01, "q99": 0.99})


@query
def fare_rate_quantiles_by_weekday(spark, sf_dir):
    trips = cleaning.clean_trips(_timed(spark, sf_dir))
    return stats.exact_quantiles(trips, "fare_rev_per_hour", QUARTILES, ["weekday"])


# --- rasters, rates, densities --------------------------------------------------------


def _fare_trips(spark, sf_dir, parts=("year", "month", "day", "weekday", "hour")):
    return add_time_features(standins.trips(spark, sf_dir), ends=("pickup",), parts=parts)


def _binned(spark, sf_dir):
    trips = _fare_trips(spark, sf_dir).withColumnsRenamed(
        {"pickup_year": "year", "pickup_month": "month"}
    )
    cell = RIDE_GRID.cell_of(F.col("pickup_longitude"), F.col("pickup_latitude"))
    return raster.binned_rides(trips, cell, mean=MEAN)


@query
def raster_hour_bins(spark, sf_dir):
    return _binned(spark, sf_dir)


def _fare_map(spark, sf_dir, summary):
    monday = cleaning.fare_rate_trips(_fare_trips(spark, sf_dir), weekday=rollup.MONDAY)
    return raster.binned_2d(
        monday,
        F.col("pickup_longitude"),
        F.col("pickup_latitude"),
        summary,
        keys=("pickup_hour",),
    )


@query
def fare_rate_grid(spark, sf_dir):
    return _fare_map(spark, sf_dir, MEAN(F.col("fare_rev_per_hour")).alias("fare_rev_per_hour"))


@query
def passenger_grid(spark, sf_dir):
    return _fare_map(spark, sf_dir, F.sum("passenger_count").alias("passenger_count"))


@query
def fare_rate_weekly(spark, sf_dir):
    return stats.fare_rate_pattern(
        _fare_trips(spark, sf_dir), ["pickup_weekday", "pickup_hour"], mean=MEAN
    )


@query
def fare_rate_monthly(spark, sf_dir):
    return stats.fare_rate_pattern(
        _fare_trips(spark, sf_dir), ["pickup_month", "pickup_hour"], mean=MEAN
    )


@query
def fare_rate_density(spark, sf_dir):
    usual = cleaning.fare_rate_trips(_fare_trips(spark, sf_dir))
    return raster.kernel_density(usual, F.col("fare_rev_per_hour"), **DENSITY)


def _rounded_density(density):
    return density.select("point", *[F.round(c, 8).alias(c) for c in ("x", "density")])


@query
def log_fare_rate_density(spark, sf_dir):
    """Density of the logarithm of the fare rate, with a bandwidth from the data."""
    trips = cleaning.clean_trips(_timed(spark, sf_dir)).where("fare_rev_per_hour > 0")
    return _rounded_density(raster.fitted_density(trips, F.log("fare_rev_per_hour")))


@query
def passenger_density(spark, sf_dir):
    trips = cleaning.clean_trips(_timed(spark, sf_dir))
    return _rounded_density(raster.fitted_density(trips, F.col("passenger_count")))


@query
def point_density_2d(spark, sf_dir):
    counts = raster.binned_2d(
        cleaning.clean_trips(_timed(spark, sf_dir)),
        F.col("pickup_longitude"),
        F.col("pickup_latitude"),
        F.count(F.lit(1)).alias("n"),
        breaks=SMOOTH["bins"] + 1,
    )
    return raster.smooth_2d(counts, **SMOOTH)


@query
def trip_time_distribution(spark, sf_dir):
    return stats.exact_quantiles(
        standins.tract_trips(spark, sf_dir),
        "trip_time",
        QUARTILES,
        ["pickup_tract_id"],
        bucket_width=1 / 60,
    )


@query
def fare_distribution(spark, sf_dir):
    return stats.exact_quantiles(
        standins.tract_trips(spark, sf_dir),
        "fare_amount",
        QUARTILES,
        ["pickup_tract_id"],
        bucket_width=0.5,
    )


@query
def fare_by_region_and_rain(spark, sf_dir):
    """Mean fare and trip time by pickup tract and whether it rained in that hour."""
    trips = standins.tract_trips(spark, sf_dir).withColumns(
        {
            "year": F.col("pickup_year"),
            "month": F.col("pickup_month"),
            "day": F.dayofmonth("pickup_datetime"),
            "hour": F.hour("pickup_datetime"),
        }
    )
    joined = rollup.attach_weather(trips, _stored_hourly(spark, sf_dir))
    wet = joined.withColumn("wet", F.col("precipitation") > 1)
    return stats.means_by(wet, ["pickup_tract_id", "wet"], ["fare_amount", "trip_time"], mean=MEAN)


# --- duplicates, extremes, samples, keys ---------------------------------------------


def _with_copies(spark, sf_dir):
    df = standins.trips(spark, sf_dir)
    return df.unionByName(df.where(F.col("trip_id") % 97 == 0))


@query
def duplicate_trips(spark, sf_dir):
    df = _with_copies(spark, sf_dir)
    return stats.duplicate_rows(df, df.columns).select("trip_id", "fare_amount", "copies")


@query
def unique_key_check(spark, sf_dir):
    return tables.key_violations(_with_copies(spark, sf_dir), ["trip_id"])


@query
def busiest_region(spark, sf_dir):
    trips = standins.cell_trips(spark, sf_dir, COARSE)
    return stats.busiest(trips.where(F.col("pickup_grid") != 0), "pickup_grid")


@query
def sample_trips(spark, sf_dir):
    low = F.pmod(F.col("trip_id"), F.lit(2147483648))  # so that the product stays a bigint
    rank = F.pmod(low * 2654435761 + 12345, F.lit(4294967296))
    out = stats.sample_rows(_timed(spark, sf_dir), SAMPLE_SIZE, rank, "trip_id")
    return out.select("trip_id", "trip_time", "fare_amount")


@query
def cells_in_one_direction(spark, sf_dir):
    trips = standins.cell_trips(spark, sf_dir)
    pickups = trips.select(F.col("pickup_grid").alias("cell_id"))
    dropoffs = trips.select(F.col("dropoff_grid").alias("cell_id"))
    return stats.only_in_one(pickups, dropoffs, "cell_id")


# --- weather × cells, models -----------------------------------------------------------


@query
def weather_cross_cells(spark, sf_dir):
    return readings_ops.cross_with_cells(_hourly(spark, sf_dir), CROSS_CELLS)


@query
def rides_with_weather(spark, sf_dir):
    return readings_ops.rides_with_weather(_binned(spark, sf_dir), _stored_hourly(spark, sf_dir))


def _coarse_rides(spark, sf_dir):
    trips = _fare_trips(spark, sf_dir).withColumnsRenamed(
        {"pickup_year": "year", "pickup_month": "month"}
    )
    rides = raster.binned_rides(trips, _cell(COARSE, "pickup"))
    enable_checkpoints(spark)
    return readings_ops.rides_with_weather(rides, _stored_hourly(spark, sf_dir)).checkpoint()


RIDE_KEYS = ["pickup_cell", "year", "month", "pickup_day", "pickup_hour"]


def _scored(out, label="rides"):
    fits = [F.round(c, 5).alias(c) for c in (f"{label}_hat", f"{label}_resid")]
    return out.select(*RIDE_KEYS, label, *fits)


@query
def ride_regression(spark, sf_dir):
    return _scored(models.ride_regression(_coarse_rides(spark, sf_dir)))


@query
def ride_regression_dependent(spark, sf_dir):
    """A column that never varies and one that follows from another change nothing."""
    rides = _coarse_rides(spark, sf_dir).withColumns(
        {"one": F.lit(1.0), "warmth": F.col("temperature") * 2 - F.col("precipitation") + 7}
    )
    covariates = ("one", "warmth", *models.RIDE_COVARIATES)
    return _scored(models.ride_regression(rides, covariates=covariates))


@query
def log_ride_regression(spark, sf_dir):
    return _scored(models.log_ride_regression(_coarse_rides(spark, sf_dir)))


@query
def ride_regression_totals(spark, sf_dir):
    """The normal equations of the full fit: over every level of a category, and weighted
    by every covariate, the estimates add up to the rides."""
    fitted = models.ride_regression(_coarse_rides(spark, sf_dir)).where("rides_hat IS NOT NULL")
    whole, one = F.lit(None).cast("bigint"), F.lit(1.0)
    terms = [(f, F.col(f).cast("bigint"), one) for f in models.RIDE_FACTORS]
    terms += [(c, whole, F.col(c)) for c in models.RIDE_COVARIATES]
    term = F.array(*[F.struct(F.lit(n).alias("input"), v.alias("level"), x.alias("x")) for n, v, x in terms])
    return (
        fitted.select("rides_hat", F.explode(term).alias("term"))
        .groupBy(F.col("term.input").alias("input"), F.col("term.level").alias("level"))
        .agg(
            F.round(F.sum(F.col("rides_hat") * F.col("term.x")), 2).alias("rides_hat"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@query
def ride_regression_on_hour(spark, sf_dir):
    """With one category the fitted values are its means."""
    out = models.ride_regression(
        _coarse_rides(spark, sf_dir), factors=("pickup_hour",), covariates=()
    )
    fitted = F.round("rides_hat", 6).alias("rides_hat")
    return out.select("pickup_cell", "pickup_day", "pickup_hour", "rides", fitted)


@query
def ride_regression_on_wind(spark, sf_dir):
    """With one covariate the fit is a straight line."""
    out = models.ride_regression(
        _coarse_rides(spark, sf_dir), factors=(), covariates=("windspeed",)
    )
    fitted = F.round("rides_hat", 6).alias("rides_hat")
    return out.select("pickup_cell", "pickup_day", "pickup_hour", "rides", fitted)


def _residuals(spark, sf_dir, grain):
    scored = models.ride_regression(_coarse_rides(spark, sf_dir))
    means = models.spatial_means(scored, grain, mean=MEAN)
    return means.withColumns({c: F.round(c, 4) for c in ("rides_hat", "rides_resid", "residual")})


@query
def regression_residuals_daily(spark, sf_dir):
    return _residuals(spark, sf_dir, "day")


@query
def regression_residuals_hourly(spark, sf_dir):
    return _residuals(spark, sf_dir, "hour")


@query
def trip_time_model(spark, sf_dir):
    parts = ("weekday", "hour", "min")
    trips = models.time_of_day(_fare_trips(spark, sf_dir, parts))
    model = models.trip_time_model(trips)
    return models.with_trip_time_hat(trips, model).select(
        "trip_id", "pickup_time", "pickup_weekday", "trip_time", "trip_time_hat"
    )


@query
def trip_time_network(spark, sf_dir):
    """What must hold for the network's estimates: one for every trip with a clock, an error
    below the spread of the trip times and never rising from step to step."""
    parts = ("weekday", "hour", "min")
    trips = models.time_of_day(_fare_trips(spark, sf_dir, parts))
    network = models.trip_time_network(trips, steps=NETWORK_STEPS)
    scored = models.with_network_hat(trips, network)
    off = F.col("trip_time") - F.col("trip_time_hat")
    falling = all(b <= a for a, b in zip(network.errors, network.errors[1:])) and network.errors[-1] < network.errors[0]
    return scored.agg(
        F.count(F.lit(1)).alias("trips"),
        F.count("trip_time_hat").alias("estimates"),
        (F.avg(off * off) <= F.var_pop("trip_time")).alias("below_variance"),
        F.lit(falling).alias("falling"),
    )


# --- graph, diffusion --------------------------------------------------------------------


def _transport(spark, sf_dir):
    cells = _used_cells(spark, sf_dir).select("cell_id")
    return transport_graph(
        cells, GRID, [standins.tract_index(spark)], standins.crossings(spark)
    )


@query
def grid_graph(spark, sf_dir):
    return graph.grid_graph(_used_cells(spark, sf_dir).select("cell_id"), GRID)


@query
def land_graph(spark, sf_dir):
    edges = graph.grid_graph(_used_cells(spark, sf_dir).select("cell_id"), GRID)
    return graph.restrict(edges, spatial.land_cells(standins.tract_index(spark), GRID), GRID)


def _dissolved(spark, sf_dir):
    """The lattice's tracts, merged by borough."""
    return dissolve.dissolve(_tracts_by_borough(spark, sf_dir), "borough_code")


def _tracts_by_borough(spark, sf_dir):
    codes = standins.tract_codes(spark, sf_dir).select("region_id", "borough_code")
    return standins.tract_rings(spark).join(codes, "region_id")


@query
def dissolved_boroughs(spark, sf_dir):
    """Area and length of the outline of every borough."""
    area = dissolve.layer_area(_dissolved(spark, sf_dir))
    sides = dissolve.outline_segments(_tracts_by_borough(spark, sf_dir), "borough_code")
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    outline = sides.groupBy(F.col("borough_code").alias("region_id")).agg(
        F.count(F.lit(1)).alias("sides"), F.sum(length).alias("outline")
    )
    return area.join(outline, "region_id").select(
        "region_id", F.round("area", 9).alias("area"), "sides", F.round("outline", 9).alias("outline")
    )


@query
def borough_assign(spark, sf_dir):
    """The borough of every pickup, from the dissolved outlines."""
    index = spatial.sized_index(spatial.region_index(spatial.region_layer(_dissolved(spark, sf_dir)), GRID))
    out = spatial.assign_regions(
        standins.trips(spark, sf_dir), index, GRID, "pickup_longitude", "pickup_latitude", "pickup_borough", exact=True
    )
    return out.select("trip_id", "pickup_borough")


@query
def two_layer_land_graph(spark, sf_dir):
    """Land as either of two dissolved layers has it: the first boroughs, and the others."""
    enable_checkpoints(spark)
    boroughs = _dissolved(spark, sf_dir).checkpoint()
    first = F.col("region_id") <= FIRST_LAYER
    layers = [spatial.region_index(spatial.region_layer(boroughs.where(c)), GRID) for c in (first, ~first)]
    cells = _used_cells(spark, sf_dir).select("cell_id")
    return transport_graph(cells, GRID, layers, standins.crossings(spark).limit(0))


@query
def bridged_graph(spark, sf_dir):
    return _transport(spark, sf_dir)


@query
def graph_degree(spark, sf_dir):
    return graph.degrees(_transport(spark, sf_dir))


@query
def edge_segments(spark, sf_dir):
    return graph.segments(_transport(spark, sf_dir), GRID)


@query
def split_field(spark, sf_dir):
    return graph.split_field(_used_cells(spark, sf_dir), GRID)


def _diffused(spark, sf_dir):
    field = _used_cells(spark, sf_dir).select(
        "cell_id", F.col("pickups").cast("double").alias("value")
    )
    return graph.diffusion(
        field, _transport(spark, sf_dir), DIFFUSION_STEPS, delta=0.25, keep_all=True
    )


@query
def diffusion_steps(spark, sf_dir):
    """Pickups per cell spread over the transport graph, every state kept."""
    return _diffused(spark, sf_dir).select("step", "cell_id", F.round("value", 6).alias("value"))


@query
def diffusion_convergence(spark, sf_dir):
    """How much each step still changes the field."""
    change = graph.convergence(_diffused(spark, sf_dir))
    return change.select("step", *[F.round(c, 8).alias(c) for c in ("largest", "mean")])


# --- raw input, sinks, SQL -------------------------------------------------------------------

RAW_OUTPUT = [
    "vendor_id",
    "pickup_datetime",
    "passenger_count",
    "trip_distance",
    "dropoff_longitude",
    "fare_amount",
    "tip_amount",
    "total_amount",
]


@query
def repair_lines(spark, sf_dir):
    lines = raw.drop_blank_lines(standins.raw_lines(spark, sf_dir))
    lines = raw.keep_field_count(lines, standins.RAW_WIDTH)
    rows = raw.parse_lines(lines, standins.NARROW_HEADER)
    aliases = raw.alias_sets([standins.NARROW_HEADER])
    return raw.typed(raw.rename_canonical(rows, aliases)).select(*RAW_OUTPUT)


@query
def rejected_line_counts(spark, sf_dir):
    rejected = raw.rejected_lines(standins.raw_lines(spark, sf_dir), standins.RAW_WIDTH)
    return rejected.groupBy(raw.field_count(F.col("value")).alias("fields")).agg(
        F.count(F.lit(1)).alias("lines")
    )


@query
def canonical_headers(spark, sf_dir):
    generations = standins.header_generations(spark, sf_dir)
    aliases = raw.alias_sets(tuple(g.columns) for g in generations)
    out = None
    for generation in generations:
        rows = raw.typed(raw.rename_canonical(generation, aliases)).select(*RAW_OUTPUT)
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def header_survey(spark, sf_dir):
    """Generations of the raw files on disk: width, first names and months."""
    survey = raw.survey_headers(spark, standins.raw_files(spark, sf_dir))
    month = F.regexp_extract("path", r"month=(\d{4}-\d{2})", 1)
    return survey.groupBy(F.size("header").alias("width"), F.array_join(F.slice("header", 1, 2), " ").alias("names")).agg(
        F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count_distinct(month).alias("months")
    )


@query
def raw_files_net_flow(spark, sf_dir):
    """From text files of drifting headers to net flow per cell and slot."""
    trips = raw.read_trips(spark, standins.raw_files(spark, sf_dir), exact_width=True)
    return flows.net_flow(tag_cells(trips, COARSE), "grid")


@query
def manifest_parts(spark, sf_dir):
    """Monthly file addresses for the months that have orders."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    url = F.concat(
        F.lit("https://example.org/data/"),
        F.year("o_orderdate"),
        F.lit("/tripdata_"),
        month,
        F.lit(".csv"),
    )
    return raw.manifest_parts(
        standins.table(spark, sf_dir, "orders").select(url.alias("url")).distinct()
    )


@query
def weather_from_pages(spark, sf_dir):
    return readings_ops.clean_readings(
        readings_from_pages(standins.weather_pages(spark, sf_dir))
    ).drop("datetime")


@query
def partitioned_round_trip(spark, sf_dir):
    """Write trips led by each end, read them back, count per region and month."""
    root = f"{shared_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    tables.write_both_ends(standins.tract_trips(spark, sf_dir), root, region="tract_id")
    out = None
    for end in ("pickup", "dropoff"):
        counts = (
            spark.read.parquet(f"{root}/{end}")
            .groupBy(F.col(f"{end}_tract_id").alias("region_id"), "pickup_year", "pickup_month")
            .agg(F.count(F.lit(1)).alias("trips"))
            .withColumn("led_by", F.lit(end))
        )
        out = counts if out is None else out.unionByName(counts)
    return out


def _monthly_tree(spark, sf_dir):
    """All months of trips, then a month written again with the trips of fewer regions."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    trips = standins.tract_trips(spark, sf_dir)
    versions.commit_months(trips, root, region="tract_id", region_folders=True)
    month = trips.agg(F.min(F.struct("pickup_year", "pickup_month"))).first()[0]
    again = trips.where((F.col("pickup_year") == month[0]) & (F.col("pickup_month") == month[1]))
    fewer = again.where(F.col("pickup_tract_id").between(1, RERUN_TRACTS))
    versions.commit_months(fewer, root, region="tract_id", region_folders=True)
    return root


@query
def monthly_tree(spark, sf_dir):
    """Both copies of the newest commit, counted per region and month."""
    root = _monthly_tree(spark, sf_dir)
    out = None
    for end in versions.ENDS:
        counts = (
            versions.read_end(spark, root, end)
            .groupBy(F.col(f"{end}_tract_id").alias("region_id"), "pickup_year", "pickup_month")
            .agg(F.count(F.lit(1)).alias("trips"), F.sum("passenger_count").alias("passengers"))
            .withColumn("led_by", F.lit(end))
        )
        out = counts if out is None else out.unionByName(counts)
    return out


@query
def trips_of_region(spark, sf_dir):
    """All trips that start or end in one region, from the two copies."""
    rows = versions.read_region_of(spark, _monthly_tree(spark, sf_dir), "tract_id", [ONE_TRACT])
    return rows.select(
        "led_by", "pickup_tract_id", "dropoff_tract_id", "pickup_datetime", "dropoff_datetime", "fare_amount"
    )


@query
def csv_results(spark, sf_dir):
    """Net flow stored as CSV with a header and read back by its schema."""
    net = flows.net_flow(standins.cell_trips(spark, sf_dir, COARSE), "grid")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.save(net, path, "csv")
    return spark.read.schema(net.schema).option("header", True).csv(path)


@query
def sql_filter(spark, sf_dir):
    net = flows.net_flow(standins.cell_trips(spark, sf_dir, COARSE), "grid")
    return tables.run_sql(spark, "SELECT * FROM {net} WHERE weekday = 1", net=net)


@query
def slot_labels(spark, sf_dir):
    net = flows.net_flow(standins.cell_trips(spark, sf_dir, COARSE), "grid")
    return net.groupBy(
        slot_label(F.col("hour"), F.col("quarter_hour")).alias("label"),
        padded_id(F.col("region_id"), 5).alias("region_label"),
    ).agg(F.sum("trips_out").alias("trips_out"))
