"""Regions merged into areas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curbflow.operators import dissolve, spatial
from curbflow.operators.dissolve import layer_area

SCHEMA = "region_id int, area string, rings array<array<struct<lon:double,lat:double>>>"


def square(x, y, size=1.0, turned=False):
    ring = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return ring[::-1] if turned else ring


def layer(spark, regions):
    return spark.createDataFrame([(i, a, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, a, rings in regions], SCHEMA)


def rings_of(df):
    return {r["region_id"]: [[(p["lon"], p["lat"]) for p in ring] for ring in r["rings"]] for r in df.collect()}


def twice_area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))


def test_two_squares_make_one_ring(spark):
    df = layer(spark, [(1, "a", [square(0, 0)]), (2, "a", [square(1, 0, turned=True)]), (3, "b", [square(2, 0)]), (4, None, [square(9, 9)])])
    got = rings_of(dissolve.dissolve(df, "area"))
    assert set(got) == {"a", "b"}
    [ring] = got["a"]
    assert set(ring) == {(0, 0), (1, 0), (2, 0), (2, 1), (1, 1), (0, 1)} and len(ring) == 6
    assert twice_area(ring) == 4
    assert got["b"][0] and twice_area(got["b"][0]) == 2


def test_holes_islands_and_touching_corners(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    regions = [(i, "hole", [square(x, y, turned=i % 2 == 0)]) for i, (x, y) in enumerate(ring)]
    regions += [(20, "apart", [square(10, 0)]), (21, "apart", [square(12, 0)])]
    regions += [(30, "corner", [square(20, 0)]), (31, "corner", [square(21, 1)])]
    regions += [(40, "filled", [square(30, 0, 3), square(31, 1)]), (41, "filled", [square(31, 1)])]
    df = layer(spark, regions)
    merged = dissolve.dissolve(df, "area")
    got = rings_of(merged)
    outer, inner = got["hole"]
    assert twice_area(outer) == 18 and twice_area(inner) == -2 and len(inner) == 4
    assert sorted(map(twice_area, got["apart"])) == [2, 2]
    assert sorted(map(twice_area, got["corner"])) == [2, 2] and all(len(r) == 4 for r in got["corner"])
    assert [twice_area(r) for r in got["filled"]] == [18]
    areas = {r["region_id"]: r["area"] for r in layer_area(merged).collect()}
    assert areas == {"hole": 8, "apart": 2, "corner": 2, "filled": 9}


def test_long_rings(spark):
    """A strip of many cells, and a random patchwork: areas and points equal those of the parts."""
    rng = random.Random(2)
    n = 14
    place = {(i, j): (i + rng.uniform(-0.3, 0.3), j + rng.uniform(-0.3, 0.3)) for i in range(n + 1) for j in range(n + 1)}
    regions = []
    for i in range(n):
        for j in range(n):
            ring = [place[i, j], place[i + 1, j], place[i + 1, j + 1], place[i, j + 1]]
            k = rng.randrange(4)
            ring = ring[k:] + ring[:k]
            regions.append((i * n + j, rng.choice("pqr"), [ring[::-1] if rng.random() < 0.5 else ring]))
    regions += [(1000 + i, "strip", [square(50 + i, 0)]) for i in range(90)]
    df = layer(spark, regions)
    merged = dissolve.dissolve(df, "area").cache()
    parts = {}
    for _, a, rings in regions:
        parts[a] = parts.get(a, 0.0) + abs(twice_area(rings[0])) / 2
    got = {r["region_id"]: r["area"] for r in layer_area(merged).collect()}
    assert got == pytest.approx(parts)
    assert max(len(r) for r in rings_of(merged)["strip"]) == 182
    # even-odd test of random points against the parts
    edges = spatial.region_layer(merged)
    points = spark.createDataFrame([(k, rng.uniform(-1, n + 1), rng.uniform(-1, n + 1)) for k in range(150)], "k int, x double, y double")
    inside = spatial.inside(F.col("edges"), F.col("x"), F.col("y"))
    hits = {(r["k"], r["region_id"]) for r in points.crossJoin(edges).where(inside).collect()}
    own = spatial.region_layer(df.select("region_id", "rings")).join(df.select("region_id", "area"), "region_id")
    want = {(r["k"], r["area"]) for r in points.crossJoin(own).where(inside).collect()}
    assert hits == want and len(hits) > 50


def test_nothing_to_merge(spark):
    assert dissolve.dissolve(layer(spark, []), "area").count() == 0
    flat = layer(spark, [(1, "a", [[(0, 0), (1, 1)]])])
    assert dissolve.dissolve(flat, "area").count() == 0
    assert math.isclose(layer_area(layer(spark, [(1, "a", [square(0, 0, 2)])])).first()["area"], 4)
