"""Raster summaries: fine cells, 2-D bins, densities."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.functions.aggregates import Mean
from curbflow.operators.cleaning import validity
from curbflow.operators.stats import weighted_quantiles
from curbflow.session import enable_checkpoints

RIDE_KEYS = ("pickup_cell", "year", "month", "weekday", "pickup_day", "pickup_hour")


@dataclass(frozen=True)
class FineGrid:
    """Cells of 0.001° counted from a south-west corner; ids 1 to ncol²."""

    lon_min: float
    lon_max: float
    lat_min: float

    @property
    def ncol(self) -> int:
        return round(self.lon_max * 1000) - round(self.lon_min * 1000)

    def cell_of(self, lon: Column, lat: Column) -> Column:
        """Cell id, NULL outside the box.

        Coordinates are rounded to 0.001° first. The box is cut before the id is
        computed, so that points beside it do not land in cells of other rows.
        """

        def thousandths(value: Column, start: float) -> Column:
            units = F.floor(value * F.lit(1000.0) + F.lit(0.5)).cast("bigint")
            return units - F.lit(round(start * 1000)).cast("bigint")

        dx, dy = thousandths(lon, self.lon_min), thousandths(lat, self.lat_min)
        within = dx.between(1, self.ncol) & dy.between(0, self.ncol - 1)
        return F.when(within, dx + dy * self.ncol)


# The park and midtown window, and the window of the fare maps.
FARE_MAP_LON = (-74.05, -73.75)
FARE_MAP_LAT = (40.6, 40.9)
FARE_MAP_BREAKS = 800


def binned_rides(trips: DataFrame, cell: Column, *, mean: Mean = F.avg) -> DataFrame:
    """Rides, passengers and mean fares of valid trips per cell and hour."""
    return (
        trips.where(validity())
        .withColumn("pickup_cell", cell)
        .where(F.col("pickup_cell").isNotNull())
        .groupBy(*RIDE_KEYS)
        .agg(
            F.count(F.lit(1)).alias("rides"),
            F.coalesce(F.sum("passenger_count"), F.lit(0)).alias("passenger_count"),
            mean(F.col("fare_amount")).alias("fare_amount"),
            mean(F.col("fare_rev_per_hour")).alias("fare_rev_per_hour"),
            mean(F.col("trip_distance")).alias("trip_distance"),
        )
    )


def _bin(value: Column, limits: tuple[float, float], n_bins: int) -> Column:
    """Zero-based bin of equal width; the upper limit belongs to the last bin."""
    low, high = limits
    position = F.floor((value - F.lit(low)) / F.lit((high - low) / n_bins))
    return F.when(
        value.between(low, high), F.least(position, F.lit(n_bins - 1).cast("bigint"))
    )


def binned_2d(
    df: DataFrame,
    x: Column,
    y: Column,
    summary: Column,
    *,
    keys: tuple[str, ...] = (),
    x_limits: tuple[float, float] = FARE_MAP_LON,
    y_limits: tuple[float, float] = FARE_MAP_LAT,
    breaks: int = FARE_MAP_BREAKS,
) -> DataFrame:
    """One summary per 2-D bin (``breaks`` per axis, one bin fewer) and key."""
    return (
        df.withColumns({"bx": _bin(x, x_limits, breaks - 1), "by": _bin(y, y_limits, breaks - 1)})
        .where(F.col("bx").isNotNull() & F.col("by").isNotNull())
        .groupBy(*keys, "bx", "by")
        .agg(summary)
    )


# exp(-u²/2) is zero in double precision beyond this many bandwidths.
_KERNEL_REACH = 39.0

# Kernel weights are summed as whole numbers of this unit, so that the result
# does not depend on the order of the rows.
KERNEL_UNIT = 1_000_000_000


def kernel_density(
    df: DataFrame,
    value: Column,
    *,
    bandwidth: float,
    low: float,
    high: float,
    points: int = 512,
    bin_width: float | None = None,
) -> DataFrame:
    """Gaussian kernel density at ``points`` positions from ``low`` to ``high``.

    Values are counted per narrow bin first, so the kernel runs over bins and
    not over rows. Each bin meets only the positions its kernel reaches. The bin
    counts are stored, since their total is needed as well.
    """
    enable_checkpoints(df.sparkSession)
    width = bin_width or bandwidth / 8
    step = (high - low) / (points - 1)
    bins = (
        df.select(F.floor(value / F.lit(width)).alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .checkpoint()
    )
    center = (F.col("bin") + F.lit(0.5)) * F.lit(width)
    reach = F.lit(_KERNEL_REACH * bandwidth)
    first = F.greatest(F.ceil((center - reach - F.lit(low)) / F.lit(step)), F.lit(0))
    last = F.least(F.floor((center + reach - F.lit(low)) / F.lit(step)), F.lit(points - 1))
    reached = (
        bins.withColumns({"center": center, "first": first, "last": last})
        .where(F.col("first") <= F.col("last"))
        .select("center", "n", F.explode(F.sequence("first", "last")).alias("point"))
    )
    x = F.lit(low) + F.col("point") * F.lit(step)
    u = (x - F.col("center")) / F.lit(bandwidth)
    weight = F.floor(F.exp(F.lit(-0.5) * u * u) * F.lit(float(KERNEL_UNIT)))
    # a weight times the rows of a bin outgrows bigint from 1e10 rows on
    weight = weight.cast("decimal(10,0)") * F.col("n").cast("decimal(18,0)")
    total = bins.agg(F.sum("n")).scalar()
    scale = F.lit(1.0 / (bandwidth * math.sqrt(2 * math.pi) * KERNEL_UNIT))
    return (
        reached.groupBy("point")
        .agg(F.sum(weight).alias("mass"))
        .select("point", x.alias("x"), (F.col("mass").cast("double") * scale / total).alias("density"))
    )


def rule_of_thumb(n: int, deviation: float | None, q25: float, q75: float) -> float:
    """Bandwidth from the spread: 0.9 times the smaller of the standard deviation and the
    interquartile range / 1.34, times n^(-1/5). Where that is zero the other measure
    counts, then the size of the value itself, then one."""
    deviation = deviation or 0.0
    narrow = min(deviation, (q75 - q25) / 1.34)
    return 0.9 * (narrow or deviation or abs(q25) or 1.0) * n ** -0.2


def fitted_density(df: DataFrame, value: Column, *, points: int = 512, cut: float = 3.0, adjust: float = 1.0) -> DataFrame:
    """Gaussian kernel density of a value with a bandwidth of its own.

    The bandwidth follows from the exact deviation and quartiles (``rule_of_thumb``), the
    range reaches ``cut`` bandwidths beyond the extremes. Every value is shared out between
    the two grid points next to it, in proportion to its nearness, so the kernel runs over
    ``points`` sums and never over rows; each sum spreads to the points its kernel reaches.
    Columns ``point, x, density``. NULL, NaN and infinite values are left out; without any
    other the result is empty.
    """
    enable_checkpoints(df.sparkSession)
    x = value.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    values = df.where(finite).select(x.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    # the deviation in two passes over the counted values: sums of squares would cancel
    n, mean = values.agg(F.sum("n"), F.sum(F.col("x") * F.col("n")) / F.sum("n")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    off = F.col("x") - F.lit(mean)
    squares, low, high = values.agg(F.sum(off * off * F.col("n")), F.min("x"), F.max("x")).first()
    quartiles = weighted_quantiles(values, "x", "n", {"q25": 0.25, "q75": 0.75}).first()
    bandwidth = adjust * rule_of_thumb(n, math.sqrt(squares / (n - 1)) if n > 1 else None, quartiles["q25"], quartiles["q75"])
    start, end = low - cut * bandwidth, high + cut * bandwidth
    step = (end - start) / (points - 1)
    place = (F.col("x") - F.lit(start)) / F.lit(step)
    left = F.least(F.greatest(F.floor(place), F.lit(0)), F.lit(points - 2)).cast("int")
    # shares as whole numbers, so that sums do not depend on the order of the rows
    right = F.floor((place - left) * F.lit(float(KERNEL_UNIT)) + F.lit(0.5)).cast("decimal(18,0)")
    rows = F.col("n").cast("decimal(18,0)")
    shares = F.array(
        F.struct(left.alias("bin"), ((F.lit(KERNEL_UNIT).cast("decimal(18,0)") - right) * rows).alias("mass")),
        F.struct((left + 1).alias("bin"), (right * rows).alias("mass")),
    )
    bins = values.select(F.explode(shares).alias("share")).groupBy("share.bin").agg(F.sum("share.mass").alias("mass"))
    reach = math.ceil(_KERNEL_REACH * bandwidth / step)
    near = F.explode(F.sequence(F.greatest(F.col("bin") - reach, F.lit(0)), F.least(F.col("bin") + reach, F.lit(points - 1))))
    spread = bins.select("bin", F.col("mass").cast("double").alias("mass"), near.alias("point"))
    u = (F.col("point") - F.col("bin")) * F.lit(step / bandwidth)
    scale = F.lit(1.0 / (n * KERNEL_UNIT * bandwidth * math.sqrt(2 * math.pi)))
    return (
        spread.groupBy("point")
        .agg(F.sum(F.col("mass") * F.exp(F.lit(-0.5) * u * u)).alias("mass"))
        .select("point", (F.lit(start) + F.col("point") * F.lit(step)).alias("x"), (F.col("mass") * scale).alias("density"))
    )


def kernel_weights(reach: int, sigma: float, unit: int = 1000) -> list[int]:
    """Whole-number Gaussian weights for offsets ``-reach .. reach``."""
    return [round(unit * math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-reach, reach + 1)]


def smooth_2d(counts: DataFrame, *, bins: int, reach: int, sigma: float) -> DataFrame:
    """Smooth 2-D bin counts ``(bx, by, n)`` with a separable Gaussian.

    One pass per axis: every count spreads to its ``2 reach + 1`` neighbours. The mass
    is added up in whole numbers of 38 digits and given as a double.
    """
    weights = F.array(*[F.lit(w).cast("decimal(10,0)") for w in kernel_weights(reach, sigma)])
    out = counts.select("bx", "by", F.col("n").cast("decimal(18,0)").alias("mass"))
    for axis, other in (("bx", "by"), ("by", "bx")):
        out = (
            out.select("bx", "by", "mass", F.posexplode(weights).alias("k", "w"))
            .select(
                (F.col(axis) + F.col("k") - reach).alias(axis),
                other,
                (F.col("mass").cast("decimal(27,0)") * F.col("w")).alias("mass"),
            )
            .where(F.col(axis).between(0, bins - 1))
            .groupBy("bx", "by")
            .agg(F.sum("mass").alias("mass"))
        )
    return out.withColumn("mass", F.col("mass").cast("double"))
