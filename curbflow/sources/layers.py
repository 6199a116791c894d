"""Polygon layers from GeoJSON features or vertex tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.projection import LambertConic, TransverseMercator

_POLYGON = "array<array<array<double>>>"
_MULTIPOLYGON = f"array<{_POLYGON}>"


def _points(rings: Column) -> Column:
    return F.transform(
        rings,
        lambda ring: F.transform(
            ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
        ),
    )


def read_features(spark: SparkSession, path: str, attributes: str) -> DataFrame:
    """Line-delimited GeoJSON features: attributes plus ``rings``.

    ``attributes`` is the schema of the wanted properties, e.g. ``"region_id int,
    borough string"``. Polygons and multipolygons are accepted.
    """
    schema = f"properties struct<{_as_fields(attributes)}>, geometry struct<type:string,coordinates:string>"
    features = spark.read.schema(schema).json(path)
    single = F.from_json("geometry.coordinates", _POLYGON)
    multiple = F.flatten(F.from_json("geometry.coordinates", _MULTIPOLYGON))
    rings = F.when(F.col("geometry.type") == "MultiPolygon", _points(multiple)).otherwise(
        _points(single)
    )
    return features.select("properties.*", rings.alias("rings"))


def _as_fields(ddl: str) -> str:
    fields = (field.split(None, 1) for field in ddl.split(","))
    return ",".join(f"{name}:{kind}" for name, kind in fields)


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """A stored vertex table (region_id, ring, seq, lon, lat)."""
    return spark.read.parquet(path).select("region_id", "ring", "seq", "lon", "lat")


def reproject(
    vertices: DataFrame, zone: LambertConic | TransverseMercator, x: str = "x", y: str = "y"
) -> DataFrame:
    """Replace plane coordinates by longitude and latitude."""
    lon, lat = zone.to_degrees(F.col(x), F.col(y))
    return vertices.withColumns({"lon": lon, "lat": lat}).drop(x, y)


def region_codes(features: DataFrame, *columns: str) -> DataFrame:
    """Distinct attribute rows of a layer, e.g. region, neighbourhood and borough codes."""
    return features.select(*columns).distinct()


def attach_attributes(vertices: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attributes on every vertex of the regions that have them."""
    return vertices.join(attributes, "region_id")
