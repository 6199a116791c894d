"""Raster grid arithmetic: points, cell ids, centres and rectangles.

A grid has ``n`` × ``n`` cells over a fixed extent. Ids run from 1 to n², row by
row from the top; within a row from left to right unless the grid was made with
``left_to_right=False``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extent:
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float


# The extent of the city's census tract map.
CITY_EXTENT = Extent(lon_min=-74.25559, lon_max=-73.70001, lat_min=40.49612, lat_max=40.9153)

# Fixed value: the margin added below and left of the extent.
EDGE_OFFSET = 0.00001


@dataclass(frozen=True)
class Raster:
    n: int = 100
    extent: Extent = CITY_EXTENT
    offset: float = EDGE_OFFSET
    left_to_right: bool = True

    @property
    def lon_min(self) -> float:
        return self.extent.lon_min - self.offset

    @property
    def lon_max(self) -> float:
        return self.extent.lon_max

    @property
    def lat_min(self) -> float:
        return self.extent.lat_min - self.offset

    @property
    def lat_max(self) -> float:
        return self.extent.lat_max

    @property
    def lon_width(self) -> float:
        return (self.lon_max - self.lon_min) / self.n

    @property
    def lat_width(self) -> float:
        return (self.lat_max - self.lat_min) / self.n

    @property
    def n_cells(self) -> int:
        return self.n * self.n

    def column_of(self, lon: Column) -> Column:
        """Zero-based column in id order; the far edge belongs to the last one."""
        gap = lon - F.lit(self.lon_min) if self.left_to_right else F.lit(self.lon_max) - lon
        return F.least(F.floor(gap / F.lit(self.lon_width)), F.lit(self.n - 1).cast("bigint"))

    def row_of(self, lat: Column) -> Column:
        gap = F.lit(self.lat_max) - lat
        return F.least(F.floor(gap / F.lit(self.lat_width)), F.lit(self.n - 1).cast("bigint"))

    def contains(self, lon: Column, lat: Column) -> Column:
        return lon.between(self.lon_min, self.lon_max) & lat.between(self.lat_min, self.lat_max)

    def cell_of(self, lon: Column, lat: Column) -> Column:
        """Cell id of a point; NULL outside the extent or without coordinates."""
        cell = self.row_of(lat) * self.n + self.column_of(lon) + 1
        return F.when(self.contains(lon, lat), cell)

    def column(self, cell: Column) -> Column:
        """Zero-based column counted in id order."""
        return F.pmod(cell - 1, F.lit(self.n))

    def row(self, cell: Column) -> Column:
        return F.floor((cell - 1) / F.lit(self.n))

    def west_column(self, cell: Column) -> Column:
        """Zero-based column counted from the west, whatever the id order."""
        return self.column(cell) if self.left_to_right else F.lit(self.n - 1) - self.column(cell)

    def west(self, cell: Column) -> Column:
        return F.lit(self.lon_min) + self.west_column(cell) * F.lit(self.lon_width)

    def north(self, cell: Column) -> Column:
        return F.lit(self.lat_max) - self.row(cell) * F.lit(self.lat_width)

    def center_lon(self, cell: Column) -> Column:
        return F.lit(self.lon_min) + (self.west_column(cell) + F.lit(0.5)) * F.lit(self.lon_width)

    def center_lat(self, cell: Column) -> Column:
        return F.lit(self.lat_max) - (self.row(cell) + F.lit(0.5)) * F.lit(self.lat_width)

    def ring(self, cell: Column) -> Column:
        """Closed five-vertex outline, starting at the corner where ids start."""
        west, north = self.west(cell), self.north(cell)
        east, south = west + F.lit(self.lon_width), north - F.lit(self.lat_width)
        near, far = (west, east) if self.left_to_right else (east, west)
        corners = [(near, north), (near, south), (far, south), (far, north), (near, north)]
        return F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners])

    def flip(self, cell: Column) -> Column:
        """The id of the same place when columns are counted the other way."""
        return cell + F.lit(self.n - 1) - 2 * self.column(cell)

    def coarser(self, smaller_n: int) -> Raster:
        if self.n % smaller_n:
            raise ValueError(f"{self.n} is not an integer multiple of {smaller_n}")
        return replace(self, n=smaller_n)

    def coarsen(self, cell: Column, smaller_n: int) -> Column:
        """The id of the enclosing cell on a ``smaller_n`` × ``smaller_n`` grid."""
        factor = F.lit(self.n // self.coarser(smaller_n).n)
        column = F.floor(self.column(cell) / factor)
        row = F.floor(self.row(cell) / factor)
        return column + row * smaller_n + 1

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cell ids, 1 to n²."""
        return spark.range(1, self.n_cells + 1).withColumnRenamed("id", "cell_id")
