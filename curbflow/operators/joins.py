"""Choosing between a broadcast and a shuffled join by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

# A side is broadcast only up to this many bytes.
BROADCAST_BYTES = 256 * 1024 * 1024

_ROW_BYTES = 48  # what a row takes in memory besides its values
_VALUE_BYTES = 16


def row_size(side: DataFrame) -> tuple[int, Column | None]:
    """Bytes that every row takes, and an expression for what varies by row: the
    lengths of texts, and of nested values as JSON. None where nothing varies."""
    varying = []
    for field in side.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            varying.append(F.octet_length(column))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType)):
            varying.append(F.octet_length(F.to_json(F.struct(column))))
    fixed = _ROW_BYTES + _VALUE_BYTES * len(side.columns)
    if not varying:
        return fixed, None
    return fixed, sum((F.coalesce(v, F.lit(0)).cast("bigint") for v in varying), F.lit(fixed).cast("bigint"))


def broadcast_if_small(
    side: DataFrame,
    *,
    at_most_rows: int | None = None,
    row_bytes: int | None = None,
    row_weight: Column | None = None,
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Hint a broadcast only for a side whose size is known or measured.

    ``at_most_rows`` is a bound that follows from parameters (such as n² cells).
    It decides alone only where rows have a fixed width, given as ``row_bytes`` or
    by the schema. Otherwise the side is measured: its rows are counted, or their
    bytes summed where it holds texts or nested values (``row_weight`` replaces that
    estimate). Beyond ``limit_bytes``
    the side comes back without a hint: Spark then joins by shuffle, and its
    adaptive skew join splits the partitions of hot keys.
    """
    fixed, varying = row_size(side)
    if row_bytes is not None:
        fixed, varying = row_bytes, None
    elif row_weight is None:
        row_weight = varying
    if at_most_rows is not None and varying is None:
        size = at_most_rows * fixed
    elif row_weight is not None:
        size = side.agg(F.coalesce(F.sum(row_weight), F.lit(0))).first()[0]
    else:
        size = side.count() * fixed
    return F.broadcast(side) if size <= limit_bytes else side


def one_row_each(side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``side`` as it is, but a query that reads a key listed twice fails and names it:
    joined, such a key would double its partners. Costs no job of its own."""
    rest = [c for c in side.columns if c not in keys]
    counted = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    name = F.to_json(F.struct(*keys))
    single = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("listed twice: "), name)).cast(counted.schema["_row"].dataType)
    )
    return counted.select(*keys, single.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
