"""The transport graph on the raster and diffusion over it.

A graph is a sparse table of directed edges ``(src, dst)``; an undirected edge
is present in both directions. A field is a table ``(cell_id, value)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbflow.functions.raster import Raster
from curbflow.operators.joins import broadcast_if_small
from curbflow.session import enable_checkpoints

# A cell id and its row overhead in a broadcast hash table, roughly.
_CELL_BYTES = 32
_EDGES_PER_PART = 250_000


def restrict(graph: DataFrame, cells: DataFrame, raster: Raster) -> DataFrame:
    """Edges whose two ends are both among ``cells`` (at most n² ids)."""
    side = broadcast_if_small(
        cells.select("cell_id"), at_most_rows=raster.n_cells, row_bytes=_CELL_BYTES
    )
    for end in ("src", "dst"):
        graph = graph.join(side, F.col(end) == F.col("cell_id"), "left_semi")
    return graph


def neighbours(cell: Column, raster: Raster) -> Column:
    """Ids left, right, above and below a cell; none across the edges of the grid."""
    column, row, last = raster.column(cell), raster.row(cell), raster.n - 1
    around = F.array(
        F.when(column > 0, cell - 1),
        F.when(column < last, cell + 1),
        F.when(row > 0, cell - raster.n),
        F.when(row < last, cell + raster.n),
    )
    return F.filter(around, lambda c: c.isNotNull())


def grid_graph(cells: DataFrame, raster: Raster) -> DataFrame:
    """4-neighbour edges between the given cells, generated by arithmetic."""
    src = cells.select(F.col("cell_id").alias("src")).distinct()
    edges = src.select("src", F.explode(neighbours(F.col("src"), raster)).alias("dst"))
    present = broadcast_if_small(
        src.withColumnRenamed("src", "cell_id"), at_most_rows=raster.n_cells, row_bytes=_CELL_BYTES
    )
    return edges.join(present, F.col("dst") == F.col("cell_id"), "left_semi")


def connect(graph: DataFrame, links: DataFrame) -> DataFrame:
    """Add undirected edges; adding one that exists changes nothing."""
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.unionByName(links.select("src", "dst")).unionByName(back).distinct()


def crossing_links(crossings: DataFrame, raster: Raster) -> DataFrame:
    """Cells joined by bridges and tunnels ``(w_lat, w_lon, e_lat, e_lon, name)``.

    A crossing with both ends in one cell, or an end outside the grid, is dropped.
    """
    west = raster.cell_of(F.col("w_lon"), F.col("w_lat"))
    east = raster.cell_of(F.col("e_lon"), F.col("e_lat"))
    return crossings.select(east.alias("src"), west.alias("dst")).where(F.col("src") != F.col("dst"))


def degrees(graph: DataFrame) -> DataFrame:
    """Number of cells connected to each cell that has any."""
    return graph.groupBy(F.col("dst").alias("cell_id")).agg(F.count(F.lit(1)).alias("degree"))


def segments(graph: DataFrame, raster: Raster) -> DataFrame:
    """Each undirected edge once, as a line between cell centres."""
    out = graph.where(F.col("src") < F.col("dst"))
    return out.select(
        "src",
        "dst",
        raster.center_lon(F.col("src")).alias("p1_lon"),
        raster.center_lat(F.col("src")).alias("p1_lat"),
        raster.center_lon(F.col("dst")).alias("p2_lon"),
        raster.center_lat(F.col("dst")).alias("p2_lat"),
    )


def split_field(cells: DataFrame, raster: Raster, level: float = 10.0) -> DataFrame:
    """``+level`` on the west half of the grid and ``-level`` on the east half."""
    west = raster.west_column(F.col("cell_id")) < raster.n / 2
    return cells.select("cell_id", F.when(west, F.lit(level)).otherwise(F.lit(-level)).alias("value"))


def _spokes(graph: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges plus one marker per cell, so that cells without edges stay in the field."""
    ends = cells.select("cell_id").unionByName(graph.select(F.col("dst").alias("cell_id"))).distinct()
    markers = ends.select(
        F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(True).alias("marker")
    )
    return graph.select("src", "dst", F.lit(False).alias("marker")).unionByName(markers)


def _step(field: DataFrame, spokes: DataFrame, delta: float, keep: Sequence[str] = ()) -> DataFrame:
    """The next state; a cell's marker carries the columns to ``keep`` along."""
    inflow = F.avg(F.when(~F.col("marker"), F.col("value")))
    kept = [F.max(F.when(F.col("marker"), F.col(c))).alias(c) for c in keep]
    return (
        spokes.join(field, F.col("src") == F.col("cell_id"))
        .groupBy(F.col("dst").alias("next_id"))
        .agg((F.coalesce(inflow, F.lit(0.0)) + F.lit(delta)).alias("value"), *kept)
        .withColumnRenamed("next_id", "cell_id")
    )


def diffuse(field: DataFrame, graph: DataFrame, delta: float = 0.0) -> DataFrame:
    """One step: every cell takes the mean of its neighbours, plus ``delta``.

    A cell without neighbours becomes ``delta``.
    """
    return _step(field, _spokes(graph, field), delta)


@contextmanager
def _plans_as_written(spark: SparkSession, parts: int) -> Iterator[None]:
    """Shuffles into ``parts`` partitions that keep their layout: adaptive execution would
    merge them, and the next step would have to lay them out again. Cells have few
    neighbours, so no partition grows hot."""
    wanted = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(parts),
    }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def diffusion(
    field: DataFrame,
    graph: DataFrame,
    steps: int,
    *,
    delta: float = 0.0,
    keep_all: bool = False,
    checkpoint_every: int = 4,
) -> DataFrame:
    """The field after ``steps`` steps, or with ``keep_all`` every state by ``step``.

    Each step is one join and one aggregation. Edges and field are laid out alike, by the
    hash of the cell, so no step moves the edges or the field: all that is shuffled is one
    partial mean per cell and task. Every few states one is checkpointed to the shared folder,
    so the plan stays short and a lost executor costs only those. The states in between
    travel with their cell until then: keeping all of them takes no job for each.
    """
    spark = field.sparkSession
    enable_checkpoints(spark)
    state = field.select("cell_id", F.col("value").cast("double").alias("value")).checkpoint()
    spokes = _spokes(graph, state).checkpoint()
    parts = max(1, min(-(-spokes.count() // _EDGES_PER_PART), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    states = [state.withColumn("step", F.lit(0))]
    with _plans_as_written(spark, parts):
        spokes = spokes.repartition(parts, "src").checkpoint()
        kept: list[int] = []  # steps since the last checkpoint, in columns of their own
        for step in range(1, steps + 1):
            columns = [f"at_{k}" for k in range(len(kept))]
            state = _step(state.hint("shuffle_hash"), spokes, delta, columns)
            if step % checkpoint_every and step < steps:
                if keep_all:
                    state = state.withColumn(f"at_{len(kept)}", F.col("value"))
                    kept.append(step)
                continue
            state = state.checkpoint()
            if keep_all:
                then = [F.struct(F.lit(s).alias("step"), F.col(c).alias("value")) for s, c in zip(kept, columns)]
                then.append(F.struct(F.lit(step).alias("step"), F.col("value").alias("value")))
                rows = state.select("cell_id", F.explode(F.array(*then)).alias("then"))
                # a cell that a step reached first has no value before
                states.append(rows.select("cell_id", "then.value", "then.step").where("value is not null"))
                state, kept = state.select("cell_id", "value"), []
    if not keep_all:
        return state
    out = states[0]
    for later in states[1:]:
        out = out.unionByName(later)
    return out


def convergence(states: DataFrame) -> DataFrame:
    """Largest and mean absolute change of the cells in each step. A cell that a step adds
    to the field does not count in that step."""
    before = F.lag("value").over(Window.partitionBy("cell_id").orderBy("step"))
    change = states.withColumn("change", F.abs(F.col("value") - before)).where("change is not null")
    return change.groupBy("step").agg(F.max("change").alias("largest"), F.avg("change").alias("mean"))
