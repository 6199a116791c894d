"""Regions merged into areas: shared borders vanish, what is left is put together to rings.

Two regions of an area that share a border have the same segment in their outlines. All
outlines are turned the same way round, so the two run along it in opposite directions and
cancel. The segments left over are the outline of the area. Each points to the one that goes
on from its end; rings are found on that table by doubling: after k rounds a segment knows
what lies 2^k segments ahead, so a ring of any length takes a logarithmic number of
joins, and no ring is followed step by step or gathered before it is complete.

Borders must be made of the same vertices on both sides, as in layers that come from one
survey. Places where an area touches itself in one point are parted by the sharpest turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.session import enable_checkpoints


def ring_area(points: Column) -> Column:
    """Twice the area of an open or closed ring, positive if it runs counter-clockwise."""
    size = F.size(points)
    return F.aggregate(
        F.sequence(F.lit(0), size - 1),
        F.lit(0.0),
        lambda total, i: total
        + F.get(points, i)["lon"] * F.get(points, (i + 1) % size)["lat"]
        - F.get(points, (i + 1) % size)["lon"] * F.get(points, i)["lat"],
    )


def layer_area(rings: DataFrame) -> DataFrame:
    """Area of each region in squared degrees: outer rings less their holes, where these
    run the other way round."""
    twice = F.aggregate("rings", F.lit(0.0), lambda total, ring: total + ring_area(ring))
    return rings.select("region_id", (F.abs(twice) / 2).alias("area"))


def directed_segments(rings: DataFrame, area: str) -> DataFrame:
    """``area, x1, y1, x2, y2``: the outlines of all regions, first rings counter-clockwise and
    the others, which are holes, clockwise; segments without length go."""
    ring = rings.where(F.col(area).isNotNull()).select(area, F.posexplode("rings").alias("place", "points"))
    outer = F.col("place") == 0
    turned = F.when((ring_area(F.col("points")) > 0) == outer, F.col("points")).otherwise(F.reverse("points"))
    size = F.size("turned")
    sides = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.get("turned", i)["lon"].alias("x1"),
            F.get("turned", i)["lat"].alias("y1"),
            F.get("turned", (i + 1) % size)["lon"].alias("x2"),
            F.get("turned", (i + 1) % size)["lat"].alias("y2"),
        ),
    )
    kept = ring.withColumn("turned", turned).where(size > 2)
    return kept.select(area, F.inline(sides)).where("x1 <> x2 or y1 <> y2")


def outline_segments(rings: DataFrame, area: str) -> DataFrame:
    """The segments of ``directed_segments`` that no opposite one of their area cancels.

    Each meets its opposite under one key, the segment without its direction, and only
    the difference of their numbers is counted, so nothing is joined.
    """
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    low = F.when(forward, F.struct("x1", "y1")).otherwise(F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1")))
    high = F.when(forward, F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"))).otherwise(F.struct("x1", "y1"))
    counted = (
        directed_segments(rings, area)
        .select(area, low.alias("low"), high.alias("high"), F.when(forward, 1).otherwise(-1).alias("way"))
        .groupBy(area, "low", "high")
        .agg(F.sum("way").alias("way"))
        .where("way <> 0")
    )
    ahead = F.col("way") > 0
    start, end = F.when(ahead, F.col("low")).otherwise(F.col("high")), F.when(ahead, F.col("high")).otherwise(F.col("low"))
    return counted.select(
        area, start["x1"].alias("x1"), start["y1"].alias("y1"), end["x1"].alias("x2"), end["y1"].alias("y2")
    )


def _successors(segments: DataFrame, area: str) -> DataFrame:
    """``id, next``: where several segments go on from one point, the one that turns most to
    the left, where the interior lies, so that rings which touch stay apart."""
    arriving = segments.select("id", area, F.col("x2").alias("x"), F.col("y2").alias("y"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("into"))
    leaving = segments.select(
        F.col("id").alias("next"), F.col(area).alias("_area"), F.col("x1").alias("_x"), F.col("y1").alias("_y"),
        F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("out"),
    )
    met = arriving.join(leaving, (F.col(area) == F.col("_area")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")))
    # from straight back (0) over right and straight on to the left
    turn = F.pmod(F.col("out") - F.col("into") + F.pi(), 2 * F.pi())
    return met.groupBy("id").agg(F.max_by("next", turn).alias("next"))


def dissolve(rings: DataFrame, area: str) -> DataFrame:
    """The rings of each area: ``region_id`` (the area) and ``rings``, outer rings
    counter-clockwise and holes clockwise, each without a repeated end point.

    ``rings`` has the area of every region in a column beside its ``rings``; regions without
    an area are left out.
    """
    spark = rings.sparkSession
    enable_checkpoints(spark)
    segments = outline_segments(rings, area).withColumn("id", F.monotonically_increasing_id()).checkpoint()
    # least: the smallest id seen so far, which in the end names the ring
    state = _successors(segments, area).select("id", "next", F.least("id", "next").alias("least")).checkpoint()
    while True:
        there = state.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("least").alias("theirs"))
        step = state.join(there, "next").select(
            "id", F.col("beyond").alias("next"), F.least("least", "theirs").alias("now"), "least"
        )
        step = step.checkpoint()
        settled = step.where("now <> least").isEmpty()
        state = step.select("id", "next", F.col("now").alias("least"))
        if settled:
            break
    named = state.select("id", F.col("least").alias("ring"))
    # places: how many segments lie between one and the end of its ring, counted by doubling
    ahead = _successors(segments, area).join(named, "id")
    ahead = ahead.select(
        "id", "ring", F.when(F.col("next") == F.col("ring"), F.lit(None)).otherwise(F.col("next")).alias("next"), F.lit(1).cast("bigint").alias("left")
    ).checkpoint()
    while not ahead.where("next is not null").isEmpty():
        there = ahead.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("left").alias("more"))
        ahead = ahead.join(there, "next", "left").select(
            "id", "ring", F.col("beyond").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")
        )
        ahead = ahead.checkpoint()
    point = F.struct((-F.col("left")).alias("place"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    ordered = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    whole = segments.join(ahead.select("id", "ring", "left"), "id").groupBy(area, "ring").agg(ordered.alias("points"))
    # the largest ring first, which is an outer one
    sized = F.struct((-F.abs(ring_area(F.col("points")))).alias("size"), F.col("ring"), F.col("points"))
    collected = whole.groupBy(F.col(area).alias("region_id")).agg(F.array_sort(F.collect_list(sized)).alias("of"))
    return collected.select("region_id", F.transform("of", lambda r: r["points"]).alias("rings"))
