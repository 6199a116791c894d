"""Grid graph, crossings and diffusion against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.functions.raster import Raster
from curbflow.operators import graph


def adjacency(n, present):
    a = np.zeros((n * n, n * n), dtype=int)
    for i in range(n * n):
        for j in range(n * n):
            rows, columns = abs(i // n - j // n), abs(i % n - j % n)
            if rows + columns == 1 and i + 1 in present and j + 1 in present:
                a[i, j] = 1
    return a


def pairs(a):
    return {(i + 1, j + 1) for i, j in zip(*np.nonzero(a))}


def edges(df):
    rows = [tuple(r) for r in df.select("src", "dst").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_cells(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "cell_id long")


@pytest.mark.parametrize("n, missing", [(1, set()), (2, set()), (3, {5}), (5, {1, 7, 8, 25})])
def test_grid_graph_equals_pairwise_test(spark, n, missing):
    present = set(range(1, n * n + 1)) - missing
    got = edges(graph.grid_graph(some_cells(spark, present), Raster(n)))
    assert got == pairs(adjacency(n, present))


def test_restrict_and_degrees(spark):
    raster = Raster(5)
    land = set(range(1, 26)) - {13}
    dry = graph.restrict(graph.grid_graph(raster.cells(spark), raster), some_cells(spark, land), raster)
    a = adjacency(5, land)
    assert edges(dry) == pairs(a)
    degree = {r["cell_id"]: r["degree"] for r in graph.degrees(dry).collect()}
    assert degree == {i + 1: int(d) for i, d in enumerate(a.sum(axis=0)) if d}
    assert max(degree.values()) <= 4


def test_connect_is_idempotent_and_symmetric(spark):
    raster = Raster(3)
    base = graph.grid_graph(raster.cells(spark), raster)
    links = spark.createDataFrame([(1, 9), (1, 2)], "src long, dst long")
    once = graph.connect(base, links)
    assert edges(once) == edges(base) | {(1, 9), (9, 1)}
    assert edges(graph.connect(once, links)) == edges(once)


def test_crossings_within_a_cell_or_off_the_grid_are_dropped(spark):
    raster = Raster(100)
    rows = [
        (40.70, -74.02, 40.69, -73.98, "kept"),
        (40.6000, -73.9970, 40.5995, -73.9980, "same cell"),
        (40.60, -74.00, 41.50, -74.00, "outside"),
    ]
    df = spark.createDataFrame(rows, "w_lat double, w_lon double, e_lat double, e_lon double, name string")
    assert graph.crossing_links(df, raster).count() == 1


def test_segments_show_each_edge_once(spark):
    raster = Raster(4)
    base = graph.grid_graph(raster.cells(spark), raster)
    lines = graph.segments(base, raster)
    assert lines.count() * 2 == base.count()
    assert lines.where("p1_lon = p2_lon AND p1_lat = p2_lat").count() == 0


def dense_diffusion(a, v, steps, delta):
    degree = a.sum(axis=0)
    for _ in range(steps):
        mean = np.divide(a.T @ v, degree, out=np.zeros_like(v), where=degree > 0)
        v = mean + delta
    return v


@pytest.mark.parametrize("steps, delta", [(1, 0.0), (25, 0.125)])
def test_diffusion_equals_matrix_form(spark, steps, delta):
    n, missing = 6, {8, 9}
    raster = Raster(n)
    present = set(range(1, n * n + 1)) - missing
    net = graph.grid_graph(some_cells(spark, present), raster)
    field = graph.split_field(raster.cells(spark), raster)
    v0 = np.array([10.0 if i % n < n / 2 else -10.0 for i in range(n * n)])
    out = graph.diffusion(field, net, steps, delta=delta)
    got = {r["cell_id"]: r["value"] for r in out.collect()}
    expected = dense_diffusion(adjacency(n, present), v0, steps, delta)
    assert len(got) == n * n
    assert [got[i + 1] for i in range(n * n)] == pytest.approx(list(expected), abs=1e-9)
    assert got[8] == pytest.approx(delta)  # a cell without neighbours


def test_one_step_and_kept_states(spark):
    raster = Raster(4)
    net = graph.grid_graph(raster.cells(spark), raster)
    field = graph.split_field(raster.cells(spark), raster, level=1.0)
    states = graph.diffusion(field, net, 3, keep_all=True)
    assert {r[0]: r[1] for r in states.groupBy("step").count().collect()} == {0: 16, 1: 16, 2: 16, 3: 16}
    one = graph.diffuse(field, net)
    kept = states.where("step = 1").select("cell_id", "value")
    assert one.exceptAll(kept).count() == 0


def test_split_field_sign(spark):
    raster = Raster(100)
    field = graph.split_field(raster.cells(spark), raster)
    assert field.where("(cell_id - 1) % 100 < 50 AND value <> 10").count() == 0
    assert field.agg(F.sum("value")).first()[0] == 0


def test_convergence(spark):
    states = spark.createDataFrame(
        [(0, 1, 5.0), (1, 1, 3.0), (2, 1, 3.5), (1, 2, 8.0), (2, 2, 4.0)], "step int, cell_id int, value double"
    )
    got = {r["step"]: (r["largest"], r["mean"]) for r in graph.convergence(states).collect()}
    assert got == {1: (2.0, 2.0), 2: (4.0, 2.25)}


@pytest.mark.parametrize("every", [1, 3, 50])
def test_states_do_not_depend_on_checkpoints(spark, every):
    """A chain that grows into cells the field did not have."""
    field = spark.createDataFrame([(1, 8.0), (40, 2.0)], "cell_id int, value double")
    edges = [(i, i + 1) for i in range(1, 9)]
    net = spark.createDataFrame([*edges, *((b, a) for a, b in edges)], "src int, dst int")
    states = graph.diffusion(field, net, 7, delta=0.5, keep_all=True, checkpoint_every=every)
    got = {(r["step"], r["cell_id"]): r["value"] for r in states.collect()}
    now, want = {1: 8.0, 40: 2.0}, {(0, 1): 8.0, (0, 40): 2.0}
    for step in range(1, 8):
        near = {c: [now[a] for a, b in [*edges, *((y, x) for x, y in edges)] if b == c and a in now] for c in range(1, 10)}
        now = {c: (sum(v) / len(v) if v else 0.0) + 0.5 for c, v in {**near, **{40: []}}.items() if v or c in now}
        want |= {(step, c): v for c, v in now.items()}
    assert got == pytest.approx(want)
    last = graph.diffusion(field, net, 7, delta=0.5, checkpoint_every=every)
    assert {r["cell_id"]: r["value"] for r in last.collect()} == pytest.approx(now)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
