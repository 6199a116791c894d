"""Point-in-region assignment against brute force, layers and projections."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from curbflow.functions import projection
from curbflow.functions.projection import LONG_ISLAND_ZONE, NEW_JERSEY_ZONE
from curbflow.functions.raster import Raster
from curbflow.operators import spatial
from curbflow.sources import layers

# region 1: a square with a hole; 2: fills the hole; 3: a triangle beside it,
# sharing a border; 4: two far apart squares
SHAPES = {
    1: [
        [(-74.1, 40.6), (-73.9, 40.6), (-73.9, 40.8), (-74.1, 40.8), (-74.1, 40.6)],
        [(-74.05, 40.65), (-74.05, 40.75), (-73.95, 40.75), (-73.95, 40.65), (-74.05, 40.65)],
    ],
    2: [[(-74.05, 40.65), (-74.05, 40.75), (-73.95, 40.75), (-73.95, 40.65)]],
    3: [[(-73.9, 40.6), (-73.8, 40.7), (-73.9, 40.8)]],
    4: [
        [(-74.2, 40.5), (-74.15, 40.5), (-74.15, 40.55), (-74.2, 40.55)],
        [(-73.75, 40.85), (-73.71, 40.85), (-73.71, 40.9), (-73.75, 40.9)],
    ],
}


def contains(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def brute(x, y):
    hits = [region for region, rings in SHAPES.items() if contains(rings, x, y)]
    return min(hits) if hits else None


@pytest.fixture(scope="module")
def rings(spark):
    data = [(k, [[{"lon": x, "lat": y} for x, y in ring] for ring in rs]) for k, rs in SHAPES.items()]
    return spark.createDataFrame(data, "region_id int, rings array<array<struct<lon:double,lat:double>>>")


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    data = [(i, rng.uniform(-74.25, -73.71), rng.uniform(40.5, 40.91)) for i in range(3000)]
    return spark.createDataFrame(data, "id int, x double, y double").cache()


@pytest.mark.parametrize("raster", [Raster(7), Raster(40), Raster(40, left_to_right=False), Raster(200)])
def test_exact_assignment_equals_brute_force(rings, points, raster):
    index = spatial.region_index(spatial.region_layer(rings), raster)
    out = spatial.assign_regions(points, index, raster, "x", "y", "region", exact=True)
    bad = [r for r in out.collect() if r["region"] != brute(r["x"], r["y"])]
    assert bad == []


def test_two_phases_differ_only_in_single_region_cells(rings, points):
    raster = Raster(60)
    index = spatial.sized_index(spatial.region_index(spatial.region_layer(rings), raster))
    out = spatial.assign_quick(points, index, raster, "x", "y", "quick")
    out = spatial.assign_regions(out, index, raster, "x", "y", "region")
    for r in out.collect():
        if r["quick"] is None:
            assert r["region"] is None and brute(r["x"], r["y"]) is None
        elif r["quick"] != 0:
            assert r["region"] == r["quick"]
            assert brute(r["x"], r["y"]) in (r["quick"], None)
        else:
            assert r["region"] == brute(r["x"], r["y"])


def test_shared_border_belongs_to_one_side(spark, rings):
    raster = Raster(50)
    index = spatial.region_index(spatial.region_layer(rings), raster)
    on_border = spark.range(1, 400).select(F.lit(-73.9).alias("x"), (F.lit(40.6) + F.col("id") * 0.0005).alias("y"))
    out = spatial.assign_regions(on_border, index, raster, "x", "y", "region", exact=True)
    inside = out.where("y > 40.601 AND y < 40.799")
    assert [r[0] for r in inside.select("region").distinct().collect()] in ([1], [3])


def test_vertices_round_trip(rings):
    again = spatial.rings_from_vertices(spatial.vertices_of(rings))
    edges = spatial.region_layer(rings).select("region_id", F.explode("edges").alias("e"))
    same = spatial.region_layer(again).select("region_id", F.explode("edges").alias("e"))
    assert edges.exceptAll(same).count() == 0 and same.exceptAll(edges).count() == 0


def test_plan_does_not_shuffle_points(spark, rings, points, folder):
    raster = Raster(60)
    spatial.region_index(spatial.region_layer(rings), raster).write.parquet(f"{folder}/index")
    index = spatial.sized_index(spark.read.parquet(f"{folder}/index"))
    out = spatial.assign_regions(points, index, raster, "x", "y", "region")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_without_broadcast_the_result_is_the_same(rings, points, monkeypatch):
    raster = Raster(30)
    index = spatial.region_index(spatial.region_layer(rings), raster)
    monkeypatch.setattr(spatial.broadcast_if_small, "__kwdefaults__", {**spatial.broadcast_if_small.__kwdefaults__, "limit_bytes": 1})
    shuffled = spatial.assign_regions(points, spatial.sized_index(index).hint("merge"), raster, "x", "y", "region")
    plain = spatial.assign_regions(points, index, raster, "x", "y", "region")
    assert shuffled.exceptAll(plain).count() == 0 and shuffled.count() == points.count()


def test_land_cells(rings):
    raster = Raster(40)
    index = spatial.region_index(spatial.region_layer(rings), raster)
    got = {r[0] for r in spatial.land_cells(index, raster).collect()}
    expected = set()
    for cell in range(1, raster.n_cells + 1):
        x = raster.lon_min + ((cell - 1) % 40 + 0.5) * raster.lon_width
        y = raster.lat_max - ((cell - 1) // 40 + 0.5) * raster.lat_width
        if brute(x, y) is not None:
            expected.add(cell)
    assert got == expected


def test_geojson_features(spark, folder):
    lines = []
    for region, rs in SHAPES.items():
        closed = [[list(p) for p in ring] + [list(ring[0])] for ring in rs]
        multi = region == 4
        geometry = {"type": "MultiPolygon" if multi else "Polygon", "coordinates": [[r] for r in closed] if multi else closed}
        lines.append(json.dumps({"type": "Feature", "properties": {"region_id": region, "borough": f"b{region}"}, "geometry": geometry}))
    path = f"{folder}/layer.json"
    with open(path, "w") as file:
        file.write("\n".join(lines))
    features = layers.read_features(spark, path, "region_id int, borough string")
    sizes = {r["region_id"]: r["n"] for r in features.select("region_id", F.size("rings").alias("n")).collect()}
    assert sizes == {1: 2, 2: 1, 3: 1, 4: 2}
    vertices = spatial.vertices_of(features.select("region_id", "rings"))
    codes = layers.region_codes(features, "region_id", "borough")
    assert layers.attach_attributes(vertices, codes).where("region_id = 3").count() == 4
    vertices.write.parquet(f"{folder}/vertices")
    assert layers.read_vertices(spark, f"{folder}/vertices").count() == vertices.count()


def forward_conic(lon, lat, z):
    cone, scale, rho_0 = z.constants()
    e = projection.E1
    phi, lam = math.radians(lat), math.radians(lon - z.central_meridian)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    rho = projection.SEMI_MAJOR * scale * t**cone
    return (
        rho * math.sin(cone * lam) / z.unit + z.false_easting,
        (rho_0 - rho * math.cos(cone * lam)) / z.unit + z.false_northing,
    )


def forward_mercator(lon, lat, z):
    phi, lam = math.radians(lat), math.radians(lon - z.central_meridian)
    e2 = projection.E2
    second = e2 / (1 - e2)
    across = projection.SEMI_MAJOR / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, a = math.tan(phi) ** 2, second * math.cos(phi) ** 2, lam * math.cos(phi)
    x = z.scale_factor * across * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * second) * a**5 / 120)
    y = z.scale_factor * (
        z.meridian_arc(phi)
        - z.meridian_arc(math.radians(z.latitude_of_origin))
        + across * math.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * second) * a**6 / 720)
    )
    return x / z.unit + z.false_easting, y / z.unit + z.false_northing


@pytest.mark.parametrize(
    "zone, forward", [(LONG_ISLAND_ZONE, forward_conic), (NEW_JERSEY_ZONE, forward_mercator)]
)
def test_projection_inverts_the_forward_formulas(spark, zone, forward):
    rng = random.Random(11)
    degrees = [(rng.uniform(-74.9, -73.5), rng.uniform(40.2, 41.2)) for _ in range(200)]
    data = [(lon, lat, *forward(lon, lat, zone)) for lon, lat in degrees]
    df = spark.createDataFrame(data, "true_lon double, true_lat double, x double, y double")
    out = layers.reproject(df, zone)
    off = out.agg(F.max(F.abs(F.col("lon") - F.col("true_lon"))), F.max(F.abs(F.col("lat") - F.col("true_lat")))).first()
    assert max(off) < 1e-9


def test_projection_origin(spark):
    z = LONG_ISLAND_ZONE
    df = spark.createDataFrame([(z.false_easting, z.false_northing)], "x double, y double")
    out = layers.reproject(df, z).first()
    assert out["lon"] == pytest.approx(z.central_meridian, abs=1e-9)
    assert out["lat"] == pytest.approx(z.latitude_of_origin, abs=1e-9)
