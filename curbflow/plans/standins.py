"""Trips, tracts, weather and other inputs derived from the driver's tables.

The test tables hold no trips, so these are made from ``events`` with arithmetic
that any SQL engine repeats exactly. All of them read their whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.raster import Raster
from curbflow.operators.spatial import region_index, region_layer, sized_index
from curbflow.plans.ingest import tag_cells, tag_tracts
from curbflow.session import shared_dir
from curbflow.sources.tables import save

# Grid of the trip tables, as in the transport graph; and a coarse one that
# leaves several trips per cell and slot.
GRID = Raster(100)
COARSE = Raster(10)

LATTICE_SIDE = 8
N_TRACTS = LATTICE_SIDE * LATTICE_SIDE
N_NEIGHBORHOODS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(start: float, width: float, a: int, b: int, prime: int) -> Column:
    step = (F.col("event_id") * a + F.col("user_id") * b) % prime
    return F.lit(start) + step * F.lit(width) / F.lit(float(prime))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw trip per event, datetimes as timestamps."""
    seconds = (F.col("event_id") * 131) % 5400 - 60
    distance = ((F.col("event_id") * 17) % 1000) / F.lit(100.0)
    fare = F.when(F.col("event_id") % 50 == 0, F.lit(0.01)).otherwise(
        F.lit(2.5) + F.lit(2.0) * distance + F.col("value") / F.lit(20.0)
    )
    pickup = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trip_id"),
        pickup.alias("pickup_datetime"),
        F.timestamp_add("SECOND", seconds, pickup).alias("dropoff_datetime"),
        (F.lit(1) + F.col("event_id") % 6).alias("passenger_count"),
        distance.alias("trip_distance"),
        _spread(-74.30, 0.70, 7919, 104729, 10007).alias("pickup_longitude"),
        _spread(40.45, 0.50, 6101, 15485863, 10009).alias("pickup_latitude"),
        _spread(-74.30, 0.70, 3571, 7001, 9973).alias("dropoff_longitude"),
        _spread(40.45, 0.50, 4409, 9001, 9967).alias("dropoff_latitude"),
        fare.alias("fare_amount"),
        fare.alias("total_amount"),
    )


def tract_rings(spark: SparkSession) -> DataFrame:
    """An 8 × 8 slanted lattice of quadrilaterals, ids 1 to 64."""
    i = F.floor((F.col("id") - 1) / LATTICE_SIDE)
    j = (F.col("id") - 1) % LATTICE_SIDE

    def corner(di: int, dj: int) -> Column:
        a, b = i + di, j + dj
        lon = F.lit(-74.25) + a * F.lit(0.0675) + ((a * 7 + b * 3) % 5) * F.lit(0.004)
        lat = F.lit(40.50) + b * F.lit(0.05) + ((a * 5 + b * 2) % 7) * F.lit(0.003)
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return spark.range(1, N_TRACTS + 1).select(
        F.col("id").cast("int").alias("region_id"), F.array(ring).alias("rings")
    )


_saved_indexes: dict[tuple[str, Raster], str] = {}


def tract_index(spark: SparkSession, raster: Raster = GRID) -> DataFrame:
    """The cell index of the lattice: built once per application, saved, read back."""
    app = spark.sparkContext.applicationId
    if (app, raster) not in _saved_indexes:
        path = f"{shared_dir(spark)}/tract-index-{app}-{raster.n}"
        save(region_index(region_layer(tract_rings(spark)), raster), path)
        _saved_indexes[app, raster] = path
    return sized_index(spark.read.parquet(_saved_indexes[app, raster]))


def tract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhood (a nation) and borough (its region, from 1) of every tract."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("neighborhood_code"),
        (F.col("n_regionkey") + 1).alias("borough_code"),
    )
    tracts = spark.range(1, N_TRACTS + 1).select(
        F.col("id").cast("int").alias("region_id"),
        (F.col("id") % N_NEIGHBORHOODS).cast("int").alias("neighborhood_code"),
    )
    return tracts.join(nation, "neighborhood_code").select(
        "region_id", "neighborhood_code", "borough_code"
    )


def tract_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid trips with the tract of both ends."""
    return tag_tracts(trips(spark, sf_dir), tract_index(spark), GRID)


def cell_trips(spark: SparkSession, sf_dir: str, raster: Raster = GRID) -> DataFrame:
    """Valid trips with the raster cell of both ends."""
    return tag_cells(trips(spark, sf_dir), raster)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw weather readings as text, several per hour, some empty."""
    ts, value, kind = F.col("ts"), F.col("value"), F.col("event_type")
    empty = F.lit("")
    return table(spark, sf_dir, "events").select(
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.date_format(ts, "yyyy-MM-dd h:mm a").alias("time"),
        F.when(kind == "error", empty).otherwise(value.cast("string")).alias("temperature"),
        F.when(kind == "click", empty)
        .otherwise((value / F.lit(100.0)).cast("string"))
        .alias("precipitation"),
        (value / F.lit(10.0)).cast("string").alias("windspeed"),
    )


# --- raw text ----------------------------------------------------------------

RAW_WIDTH = 18
NARROW_HEADER = tuple(f"g1_col{i:02d}" for i in range(1, RAW_WIDTH + 1))


def raw_fields(df: DataFrame) -> list[Column]:
    """The 18 text fields of a raw trip; the vendor field carries the trip id."""
    fixed = F.lit("1")
    return [
        F.col("trip_id").cast("string"),
        F.col("pickup_datetime").cast("string"),
        F.col("dropoff_datetime").cast("string"),
        F.col("passenger_count").cast("string"),
        F.col("trip_distance").cast("string"),
        F.col("pickup_longitude").cast("string"),
        F.col("pickup_latitude").cast("string"),
        fixed,
        F.lit("N"),
        F.col("dropoff_longitude").cast("string"),
        F.col("dropoff_latitude").cast("string"),
        F.lit("CASH"),
        F.col("fare_amount").cast("string"),
        F.lit("0.5"),
        F.lit("0.5"),
        (F.col("trip_id") % 7).cast("string"),
        F.lit("0"),
        F.col("total_amount").cast("string"),
    ]


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of all trips; some are blank, headers, too short or too long."""
    df = trips(spark, sf_dir)
    fields = raw_fields(df)
    trip = F.col("trip_id")
    line = (
        F.when(trip % 53 == 0, F.lit("   "))
        .when(trip % 59 == 0, F.concat_ws(",", *fields[:-1]))
        .when(trip % 61 == 0, F.concat_ws(",", *fields, F.lit("x")))
        .when(trip % 67 == 0, F.lit(",".join(NARROW_HEADER)))
        .otherwise(F.concat_ws(",", *fields))
    )
    return df.select(line.alias("value"))


def header_generations(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Every trip in one of three tables with differing names and widths."""
    df = trips(spark, sf_dir)
    out = []
    for generation in (1, 2, 3):
        fields = raw_fields(df)
        if generation == 3:
            fields = [*fields[:-1], F.lit("0.3"), fields[-1]]
        names = [f"g{generation}_col{i:02d}" for i in range(1, len(fields) + 1)]
        rows = df.where(F.col("trip_id") % 3 == generation - 1)
        out.append(rows.select(*[f.alias(n) for f, n in zip(fields, names)]))
    return out


FILE_ROWS = 1_000_000


def raw_files(spark: SparkSession, sf_dir: str) -> str:
    """Every trip in text files of three generations, by month, in a new folder.

    The first generation has blanks after the commas of its header and blank lines in
    front, the second a column of row numbers, the third one field more and is gzipped.
    Every file also has a second header, a blank line and a line that is too short.
    """
    df = trips(spark, sf_dir)
    trip, month = F.col("trip_id"), F.date_format("pickup_datetime", "yyyy-MM")
    generation = F.pmod(trip, F.lit(3)) + 1
    fields = raw_fields(df)
    wide = [*fields[:-1], F.lit("0.3"), fields[-1]]
    line = (
        F.when(generation == 1, F.concat_ws(",", *fields))
        .when(generation == 2, F.concat_ws(",", (trip + 1).cast("string"), *fields))
        .otherwise(F.concat_ws(",", *wide))
    )
    files = max(1, table(spark, sf_dir, "events").count() // FILE_ROWS)  # of one generation and month
    keys = ["generation", "month", "part"]
    lines = df.select(
        generation.cast("int").alias("generation"),
        month.alias("month"),
        F.pmod(F.xxhash64("trip_id"), F.lit(files)).cast("int").alias("part"),
        F.lit(2).alias("place"),
        line.alias("value"),
    )
    names = {g: [f"g{g}_col{i:02d}" for i in range(1, RAW_WIDTH + 1 + (g == 3))] for g in (1, 2, 3)}
    headers = {1: " , ".join(names[1]), 2: ",".join(["", *names[2]]), 3: ",".join(f'"{n}"' for n in names[3])}
    header = F.when(F.col("generation") == 1, headers[1]).when(F.col("generation") == 2, headers[2]).otherwise(headers[3])
    noise = [(0, F.lit("  ")), (1, header), (3, header), (4, F.lit("")), (5, F.lit("1,2,3"))]
    added = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), v.alias("value")) for k, v in noise]))
    others = lines.select(*keys).distinct().select(*keys, added.alias("line")).select(*keys, "line.*")
    files_of = lines.unionByName(others).repartition(*keys).sortWithinPartitions(*keys, "place").drop("place")
    root = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    for name, chosen, packed in (("plain", F.col("generation") < 3, "none"), ("packed", F.col("generation") == 3, "gzip")):
        files_of.where(chosen).write.partitionBy(*keys).option("compression", packed).text(f"{root}/{name}")
    return root


OBSERVATIONS_PER_PAGE = 3


def weather_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored page per event, each with a table of three observations."""
    ts, value = F.col("ts"), F.col("value")

    def row(k: int) -> Column:
        used = {
            0: F.format_string("%d:%02d AM", F.lit(k + 1), F.minute(ts)),
            1: F.concat(F.lit("<span>"), (value - 50 * k).cast("string"), F.lit("</span> &deg;F")),
            8: F.lit("Calm") if k == 0 else F.concat((value / 10).cast("string"), F.lit(" mph")),
            10: F.lit("N/A") if k == 1 else F.concat(value.cast("string"), F.lit(" in")),
        }
        cells = [
            F.concat(F.lit('<td class="c">'), used.get(i, F.lit("-")), F.lit("</td>"))
            for i in range(12)
        ]
        return F.concat(F.lit("<tr>\n"), *cells, F.lit("</tr>"))

    head = (
        "<html><table id='other'><tbody><tr><td>9</td></tr></tbody></table>"
        '<table class="obs" id="obsTable"><thead><tr><th>Time</th></tr></thead><tbody>'
    )
    url = F.concat(
        F.lit("https://example.org/history/station/"),
        F.concat_ws("/", F.year(ts), F.month(ts), F.dayofmonth(ts)),
        F.lit("/DailyHistory.html"),
    )
    rows = [row(k) for k in range(OBSERVATIONS_PER_PAGE)]
    html = F.concat(F.lit(head), *rows, F.lit("</tbody></table></html>"))
    return table(spark, sf_dir, "events").select(url.alias("url"), html.alias("html"))


# --- bridges -------------------------------------------------------------------

# Five crossings between cells, one within a cell, one with an end off the grid.
CROSSINGS = (
    (40.70, -74.02, 40.69, -73.98, "a"),
    (40.71, -74.01, 40.72, -73.95, "b"),
    (40.76, -73.99, 40.75, -73.93, "c"),
    (40.80, -73.98, 40.80, -73.90, "d"),
    (40.85, -73.96, 40.84, -73.85, "e"),
    (40.6000, -73.9970, 40.5995, -73.9980, "same cell"),
    (40.60, -74.00, 41.50, -74.00, "off the grid"),
)


def crossings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(CROSSINGS), "w_lat double, w_lon double, e_lat double, e_lon double, name string"
    )
