"""Planar predicates on edge arrays.

An edge is a struct ``(x1, y1, x2, y2)`` stored with ``y1 <= y2``. Two regions
that share a border then hold the very same edge, so a point next to the border
is judged with the same arithmetic for both and falls in exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"


def edge(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """An edge struct, lower end first."""
    upward = (y1 < y2) | ((y1 == y2) & (x1 <= x2))

    def pick(first: Column, second: Column) -> Column:
        return F.when(upward, first).otherwise(second)

    return F.struct(
        pick(x1, x2).alias("x1"),
        pick(y1, y2).alias("y1"),
        pick(x2, x1).alias("x2"),
        pick(y2, y1).alias("y2"),
    )


def ring_edges(ring: Column) -> Column:
    """Edges between consecutive vertices ``(lon, lat)`` of a closed ring."""

    def between(vertex: Column, index: Column) -> Column:
        after = F.get(ring, index + 1)
        return edge(vertex["lon"], vertex["lat"], after["lon"], after["lat"])

    return F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), between)


def inside(edges: Column, lon: Column, lat: Column) -> Column:
    """Even–odd test: does a ray to the east cross the outline an odd number of times?"""

    def crossed(e: Column) -> Column:
        spans = (e["y1"] <= lat) & (lat < e["y2"])
        west_of = (lon - e["x1"]) * (e["y2"] - e["y1"]) < (e["x2"] - e["x1"]) * (lat - e["y1"])
        return spans & west_of

    crossings = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crossed(e), 1).otherwise(0))
    return crossings % 2 == 1


def touches_box(e: Column, cx: Column, cy: Column, half_x: float, half_y: float) -> Column:
    """Does a segment meet the closed box around (cx, cy)? Separating-axis test."""
    hx, hy = F.lit(half_x), F.lit(half_y)
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    offset = F.abs(dx * (cy - e["y1"]) - dy * (cx - e["x1"]))
    return (
        (F.least(e["x1"], e["x2"]) <= cx + hx)
        & (F.greatest(e["x1"], e["x2"]) >= cx - hx)
        & (e["y1"] <= cy + hy)
        & (e["y2"] >= cy - hy)
        & (offset <= F.abs(dx) * hy + F.abs(dy) * hx)
    )


def matters_in_box(e: Column, cx: Column, cy: Column, half_x: float, half_y: float) -> Column:
    """Can an eastward ray from a point in the box cross this segment?"""
    return (
        (e["y1"] < e["y2"])
        & (e["y1"] <= cy + F.lit(half_y))
        & (e["y2"] >= cy - F.lit(half_y))
        & (F.greatest(e["x1"], e["x2"]) >= cx - F.lit(half_x))
    )
