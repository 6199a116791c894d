"""Polygon layers, the cell → region index, and point-in-region assignment.

A *layer* has one row per region: ``region_id`` and ``edges``, an array of edge
structs. An *index* has one row per raster cell that any region meets:
``cell_id``, ``quick_id`` and ``candidates``. Both are map data, bounded by the
map and not by the number of trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.functions.geometry import inside, matters_in_box, ring_edges, touches_box
from curbflow.functions.raster import Raster
from curbflow.operators.joins import broadcast_if_small

# Slack, in degrees, by which cells are grown when looking for regions they meet.
TOUCH_SLACK = 1e-9

# Bytes of one edge struct and one candidate in a broadcast index.
_EDGE_BYTES = 48
_CANDIDATE_BYTES = 64


def rings_from_vertices(vertices: DataFrame) -> DataFrame:
    """Vertex rows (region_id, ring, seq, lon, lat) to one array of rings per region."""
    vertex = F.struct("seq", "lon", "lat")
    ring = F.transform(
        F.array_sort(F.collect_list(vertex)),
        lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")),
    )
    return (
        vertices.groupBy("region_id", "ring")
        .agg(ring.alias("points"))
        .groupBy("region_id")
        .agg(F.collect_list("points").alias("rings"))
    )


def vertices_of(rings: DataFrame) -> DataFrame:
    """One row per vertex, numbered by ring and by place in the ring."""
    return (
        rings.select("region_id", F.posexplode("rings").alias("ring", "points"))
        .select("region_id", "ring", F.posexplode("points").alias("seq", "vertex"))
        .select("region_id", "ring", "seq", "vertex.lon", "vertex.lat")
    )


def region_layer(rings: DataFrame) -> DataFrame:
    """Edges of every region; open rings are closed, holes come out by parity."""

    def closed(ring: Column) -> Column:
        first, last = F.element_at(ring, 1), F.element_at(ring, -1)
        return F.when(first == last, ring).otherwise(F.concat(ring, F.array(first)))

    edges = F.flatten(F.transform("rings", lambda ring: ring_edges(closed(ring))))
    return rings.select("region_id", edges.alias("edges"))


def _bounds(edges: str) -> dict[str, Column]:
    return {
        "x_min": F.array_min(F.transform(edges, lambda e: F.least(e["x1"], e["x2"]))),
        "x_max": F.array_max(F.transform(edges, lambda e: F.greatest(e["x1"], e["x2"]))),
        "y_min": F.array_min(F.transform(edges, lambda e: e["y1"])),
        "y_max": F.array_max(F.transform(edges, lambda e: e["y2"])),
    }


def cell_candidates(layer: DataFrame, raster: Raster) -> DataFrame:
    """Cell × region pairs that meet, with the region's edges that matter there.

    The cells of a region's bounding box are generated by arithmetic, first its
    rows and then the columns of each row; no join looks at all pairs. A cell
    meets a region if an outline segment touches it or its centre is inside.
    Kept edges are those an eastward ray from within the cell can cross.
    """
    half_x, half_y = raster.lon_width / 2 + TOUCH_SLACK, raster.lat_width / 2 + TOUCH_SLACK
    last = F.lit(raster.n - 1).cast("bigint")

    def clamp(index: Column) -> Column:
        return F.greatest(F.least(index, last), F.lit(0).cast("bigint"))

    def column_at(lon: Column) -> Column:
        return clamp(F.floor((lon - F.lit(raster.lon_min)) / F.lit(raster.lon_width)))

    def row_at(lat: Column) -> Column:
        return clamp(F.floor((F.lit(raster.lat_max) - lat) / F.lit(raster.lat_width)))

    slack = F.lit(TOUCH_SLACK)
    boxed = layer.withColumns(_bounds("edges")).where(
        (F.col("x_max") >= F.lit(raster.lon_min))
        & (F.col("x_min") <= F.lit(raster.lon_max))
        & (F.col("y_max") >= F.lit(raster.lat_min))
        & (F.col("y_min") <= F.lit(raster.lat_max))
    )
    first_row, last_row = row_at(F.col("y_max") + slack), row_at(F.col("y_min") - slack)
    first_col, last_col = column_at(F.col("x_min") - slack), column_at(F.col("x_max") + slack)
    cy = F.lit(raster.lat_max) - (F.col("row") + F.lit(0.5)) * F.lit(raster.lat_width)
    cx = F.lit(raster.lon_min) + (F.col("col") + F.lit(0.5)) * F.lit(raster.lon_width)

    def in_band(e: Column) -> Column:
        return (e["y1"] <= F.col("cy") + F.lit(half_y)) & (e["y2"] >= F.col("cy") - F.lit(half_y))

    bands = (
        boxed.withColumns({"first_col": first_col, "last_col": last_col})
        .select("*", F.explode(F.sequence(first_row, last_row)).alias("row"))
        .withColumn("cy", cy)
        .withColumn("edges", F.filter("edges", in_band))
    )
    pairs = bands.select(
        "region_id",
        "edges",
        "row",
        "cy",
        F.explode(F.sequence("first_col", "last_col")).alias("col"),
    ).withColumn("cx", cx)
    in_id_order = F.col("col") if raster.left_to_right else F.lit(raster.n - 1) - F.col("col")
    x, y = F.col("cx"), F.col("cy")
    meets = F.exists("edges", lambda e: touches_box(e, x, y, half_x, half_y)) | inside(
        F.col("edges"), x, y
    )
    return pairs.where(meets).select(
        (F.col("row") * raster.n + in_id_order + 1).alias("cell_id"),
        "region_id",
        F.filter("edges", lambda e: matters_in_box(e, x, y, half_x, half_y)).alias("edges"),
    )


def region_index(layer: DataFrame, raster: Raster) -> DataFrame:
    """One row per cell: its candidate regions and the id that needs no test.

    ``quick_id`` is the region of a cell that meets only one, and 0 for a cell
    where points must be tested. Build once, save, and read back for each run.
    """
    candidates = F.array_sort(F.collect_list(F.struct("region_id", "edges")))
    return (
        cell_candidates(layer, raster)
        .groupBy("cell_id")
        .agg(candidates.alias("candidates"))
        .select("cell_id", quick_id(F.col("candidates")).alias("quick_id"), "candidates")
    )


def quick_id(candidates: Column) -> Column:
    """NULL for no candidate, its id for one, 0 for several."""
    return F.when(F.size(candidates) == 1, F.get(candidates, F.lit(0))["region_id"]).when(
        F.size(candidates) > 1, F.lit(0)
    )


def candidate_ids(index: DataFrame) -> DataFrame:
    """The index as plain id lists: cell → sorted region ids."""
    return index.select("cell_id", F.col("candidates.region_id").alias("region_ids"))


def regions_of_cells(index: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct regions met by a set of cells."""
    return (
        index.join(cells.select("cell_id"), "cell_id", "left_semi")
        .select(F.explode("candidates.region_id").alias("region_id"))
        .distinct()
    )


def _matching(candidates: Column, lon: Column, lat: Column) -> Column:
    """Lowest id among the candidates that contain the point; NULL for none."""
    hits = F.filter(candidates, lambda c: inside(c["edges"], lon, lat))
    return F.array_min(F.transform(hits, lambda c: c["region_id"]))


def sized_index(index: DataFrame) -> DataFrame:
    """The index with a broadcast hint if its edge lists fit."""
    per_candidate = F.transform(
        "candidates", lambda c: F.size(c["edges"]) * _EDGE_BYTES + _CANDIDATE_BYTES
    )
    weight = F.aggregate(per_candidate, F.lit(64), lambda total, b: total + b)
    return broadcast_if_small(index, row_weight=weight)


def assign_quick(
    points: DataFrame, index: DataFrame, raster: Raster, lon: str, lat: str, out: str
) -> DataFrame:
    """First phase only: the cell's single region, 0 if it has several."""
    side = index.select(F.col("cell_id").alias("_cell"), F.col("quick_id").alias(out))
    cell = raster.cell_of(F.col(lon), F.col(lat))
    return points.withColumn("_cell", cell).join(side, "_cell", "left").drop("_cell")


def assign_regions(
    points: DataFrame,
    index: DataFrame,
    raster: Raster,
    lon: str,
    lat: str,
    out: str,
    *,
    exact: bool = False,
) -> DataFrame:
    """Region of every point: a cell lookup, then an outline test where needed.

    The index carries each cell's candidate edges, so the test runs in the row
    that holds the point: no pairs are emitted and nothing is shuffled while the
    index is broadcast (see ``sized_index``). Points that no region contains get
    NULL. ``exact`` tests the outline in cells with a single region too.
    """
    x, y = F.col(lon), F.col(lat)
    refined = _matching(F.col("_candidates"), x, y)
    if exact:
        region = refined
    else:
        region = F.when(F.col("_quick") != 0, F.col("_quick")).otherwise(refined)
    side = index.select(
        F.col("cell_id").alias("_cell"),
        F.col("quick_id").alias("_quick"),
        F.col("candidates").alias("_candidates"),
    )
    return (
        points.withColumn("_cell", raster.cell_of(x, y))
        .join(side, "_cell", "left")
        .withColumn(out, region)
        .drop("_cell", "_quick", "_candidates")
    )


def land_cells(index: DataFrame, raster: Raster) -> DataFrame:
    """Cells whose centre lies in any region of the index."""
    lon, lat = raster.center_lon(F.col("cell_id")), raster.center_lat(F.col("cell_id"))
    on_land = F.exists("candidates", lambda c: inside(c["edges"], lon, lat))
    return index.where(on_land).select("cell_id")


def cell_outlines(cells: DataFrame, raster: Raster) -> DataFrame:
    """Closed outline and centre of every cell."""
    cell = F.col("cell_id")
    return cells.select(
        "cell_id",
        raster.center_lon(cell).alias("lon"),
        raster.center_lat(cell).alias("lat"),
        raster.ring(cell).alias("ring"),
    )
