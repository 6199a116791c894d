"""Raster, map layers and crossings to the transport graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from curbflow.functions.raster import Raster
from curbflow.operators.graph import connect, crossing_links, grid_graph, restrict
from curbflow.operators.spatial import land_cells


def transport_graph(
    cells: DataFrame, raster: Raster, layers: list[DataFrame], crossings: DataFrame
) -> DataFrame:
    """Edges between neighbouring land cells plus bridges and tunnels.

    ``layers`` are region indexes on ``raster``; a cell is land if its centre is
    in a region of any of them.
    """
    land = land_cells(layers[0], raster)
    for layer in layers[1:]:
        land = land.unionByName(land_cells(layer, raster))
    dry = restrict(grid_graph(cells, raster), land.distinct(), raster)
    return connect(dry, crossing_links(crossings, raster))
