"""Means that do not depend on the order in which rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Mean = Callable[[Column], Column]


def scaled(value: Column, scale: int) -> Column:
    """The value as a whole number of ``1/scale`` units."""
    return F.floor(value * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")


def scaled_mean(scale: int) -> Mean:
    """Mean over whole ``1/scale`` units: one exact integer sum, one division.

    A plain ``avg`` of doubles may differ in the last digit between two runs;
    this one cannot. Use it where results are compared bit by bit.
    """

    def mean(value: Column) -> Column:
        return F.sum(scaled(value, scale)) / F.count(value) / F.lit(float(scale))

    return mean


def clip(value: Column, limit: float) -> Column:
    """Clip to ``-limit .. limit``; NULL stays NULL."""
    low, high = F.lit(-limit), F.lit(limit)
    return F.when(value < low, low).when(value > high, high).otherwise(value)
