"""Cell ids, flips, coarsening, centres and outlines."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curbflow.functions.raster import CITY_EXTENT, Raster
from curbflow.operators import raster as raster_ops
from curbflow.operators.raster import FineGrid, binned_2d


def cells(spark, raster, points):
    df = spark.createDataFrame(points, "lon double, lat double")
    return [r[0] for r in df.select(raster.cell_of(F.col("lon"), F.col("lat"))).collect()]


@pytest.mark.parametrize("n", [3, 20, 100])
def test_corners(spark, n):
    e = CITY_EXTENT
    corners = [
        (e.lon_min, e.lat_max),
        (e.lon_max, e.lat_max),
        (e.lon_min, e.lat_min),
        (e.lon_max, e.lat_min),
    ]
    assert cells(spark, Raster(n), corners) == [1, n, n * (n - 1) + 1, n * n]
    rtl = Raster(n, left_to_right=False)
    assert cells(spark, rtl, corners) == [n, 1, n * n, n * (n - 1) + 1]


def test_outside_and_unknown(spark):
    e = CITY_EXTENT
    points = [
        (e.lon_max + 1e-6, 40.7),
        (e.lon_min - 1e-4, 40.7),
        (-73.9, e.lat_max + 1e-6),
        (-73.9, e.lat_min - 1e-4),
        (None, 40.7),
        (-73.9, None),
    ]
    assert cells(spark, Raster(10), points) == [None] * 6


@pytest.mark.parametrize("n", [3, 4])
def test_flip_reverses_rows_and_undoes_itself(spark, n):
    raster = Raster(n)
    rows = (
        raster.cells(spark)
        .select("cell_id", raster.flip(F.col("cell_id")).alias("f"))
        .withColumn("back", raster.flip(F.col("f")))
        .orderBy("cell_id")
        .collect()
    )
    expected = [r * n + c for r in range(n) for c in range(n, 0, -1)]
    assert [r["f"] for r in rows] == expected
    assert all(r["back"] == r["cell_id"] for r in rows)


def test_flip_converts_between_orders(spark):
    ltr, rtl = Raster(37), Raster(37, left_to_right=False)
    df = spark.range(2000).select(
        (F.lit(-74.25) + F.col("id") * 0.00027).alias("lon"), (F.lit(40.5) + F.col("id") * 0.0002).alias("lat")
    )
    out = df.select(
        ltr.cell_of(F.col("lon"), F.col("lat")).alias("a"), rtl.flip(rtl.cell_of(F.col("lon"), F.col("lat"))).alias("b")
    )
    assert out.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_coarsen(spark):
    raster = Raster(6)
    got = [r[0] for r in raster.cells(spark).orderBy("cell_id").select(raster.coarsen(F.col("cell_id"), 3)).collect()]
    expected = [(i // 6 // 2) * 3 + (i % 6) // 2 + 1 for i in range(36)]
    assert got == expected
    same = raster.cells(spark).where(raster.coarsen(F.col("cell_id"), 6) != F.col("cell_id"))
    assert same.count() == 0
    with pytest.raises(ValueError):
        raster.coarsen(F.col("cell_id"), 4)


@pytest.mark.parametrize("ltr", [True, False])
def test_centre_is_in_its_cell_and_ring(spark, ltr):
    raster = Raster(23, left_to_right=ltr)
    cell = F.col("cell_id")
    out = raster.cells(spark).select(
        "cell_id",
        raster.cell_of(raster.center_lon(cell), raster.center_lat(cell)).alias("back"),
        raster.ring(cell).alias("ring"),
        raster.center_lon(cell).alias("lon"),
    )
    assert out.where("cell_id <> back").count() == 0
    assert out.where("size(ring) <> 5 OR ring[0] <> ring[4]").count() == 0
    assert out.where("lon <= least(ring[0].lon, ring[2].lon) OR lon >= greatest(ring[0].lon, ring[2].lon)").count() == 0


@settings(max_examples=25, deadline=None)
@given(
    st.lists(
        st.tuples(st.floats(-74.4, -73.6), st.floats(40.4, 41.0)), min_size=1, max_size=20
    )
)
def test_cell_matches_plain_arithmetic(spark, points):
    raster = Raster(100)

    def expected(lon, lat):
        if not (raster.lon_min <= lon <= raster.lon_max and raster.lat_min <= lat <= raster.lat_max):
            return None
        column = min(int((lon - raster.lon_min) / raster.lon_width), 99)
        row = min(int((raster.lat_max - lat) / raster.lat_width), 99)
        return row * 100 + column + 1

    assert cells(spark, raster, points) == [expected(*p) for p in points]


def test_fine_grid_has_no_aliases(spark):
    grid = FineGrid(lon_min=-73.98, lon_max=-73.96, lat_min=40.75)
    assert grid.ncol == 20
    points = [(-73.979, 40.75), (-73.96, 40.75), (-73.979, 40.751), (-73.98, 40.751), (-73.95, 40.75), (-73.96, 40.769), (-73.97, 40.77)]
    df = spark.createDataFrame(points, "lon double, lat double")
    got = [r[0] for r in df.select(grid.cell_of(F.col("lon"), F.col("lat"))).collect()]
    assert got == [1, 20, 21, None, None, 400, None]


def test_bins_cover_the_limits(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.49, 0.5), (1.01, 0.5), (None, 0.1)], "x double, y double")
    out = binned_2d(
        df, F.col("x"), F.col("y"), F.count(F.lit(1)).alias("n"), x_limits=(0.0, 1.0), y_limits=(0.0, 1.0), breaks=3
    )
    assert {(r["bx"], r["by"]): r["n"] for r in out.collect()} == {(0, 0): 1, (1, 1): 1, (0, 1): 1}


def test_density_integrates_to_one(spark):
    df = spark.range(500).select((F.col("id") % 37 + F.rand(3)).alias("v"))
    out = raster_ops.kernel_density(df, F.col("v"), bandwidth=1.5, low=-15.0, high=55.0, points=400)
    rows = out.orderBy("point").collect()
    step = rows[1]["x"] - rows[0]["x"]
    assert sum(r["density"] for r in rows) * step == pytest.approx(1.0, abs=1e-4)


def test_density_matches_brute_force(spark):
    import numpy as np

    values = np.array([0.5, 1.5, 1.5, 9.5])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = raster_ops.kernel_density(
        df, F.col("v"), bandwidth=2.0, low=-6.0, high=16.0, points=23, bin_width=1.0
    ).orderBy("point")
    for r in out.collect():
        u = (r["x"] - values) / 2.0
        expected = np.mean(np.exp(-0.5 * u * u)) / (2.0 * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(expected, abs=1e-8)


def test_smoothing_keeps_interior_mass(spark):
    counts = spark.createDataFrame([(10, 10, 3)], "bx long, by long, n long")
    out = raster_ops.smooth_2d(counts, bins=21, reach=3, sigma=1.5)
    weights = raster_ops.kernel_weights(3, 1.5)
    assert out.count() == 49
    assert out.agg(F.sum("mass")).first()[0] == 3 * sum(weights) ** 2


def test_counts_beyond_bigint_products(spark):
    counts = spark.createDataFrame([(5, 5, 10**14)], "bx long, by long, n long")
    out = raster_ops.smooth_2d(counts, bins=11, reach=2, sigma=1.0)
    assert out.where("bx = 5 AND by = 5").first()["mass"] == 1e20


def test_fitted_density(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.normal(3, 1, 400), rng.normal(9, 0.5, 100), [3.0] * 20])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    out = sorted(map(tuple, raster_ops.fitted_density(df, F.col("v"), points=256).collect()))
    low, high = np.quantile(values, [0.25, 0.75])
    bandwidth = 0.9 * min(values.std(ddof=1), (high - low) / 1.34) * len(values) ** -0.2
    x = np.linspace(values.min() - 3 * bandwidth, values.max() + 3 * bandwidth, 256)
    assert [r[0] for r in out] == list(range(256))
    assert np.allclose([r[1] for r in out], x, atol=1e-9)
    exact = np.exp(-0.5 * ((x[:, None] - values) / bandwidth) ** 2).sum(1) / (len(values) * bandwidth * math.sqrt(2 * math.pi))
    density = np.array([r[2] for r in out])
    assert np.abs(density - exact).max() < 0.003 * exact.max()  # what sharing out between points costs
    assert (density * (x[1] - x[0])).sum() == pytest.approx(1, abs=5e-3)


def test_fitted_density_of_little(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert raster_ops.fitted_density(none, F.col("v")).count() == 0
    same = spark.createDataFrame([(4.0,)] * 3, "v double")
    density = raster_ops.fitted_density(same, F.col("v"), points=65)
    top = density.orderBy(F.desc("density")).first()
    assert top["point"] == 32 and top["x"] == pytest.approx(4.0)
    assert raster_ops.rule_of_thumb(1, None, 0.0, 0.0) == pytest.approx(0.9)
