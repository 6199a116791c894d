"""Process each raw file once, as it arrives, and append to a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from curbflow.sources.raw import (
    Header,
    alias_sets,
    drop_blank_lines,
    keep_field_count,
    parse_lines,
    rename_canonical,
    typed,
)


def stream_trips(
    spark: SparkSession,
    folder: str,
    header: Header,
    *,
    pattern: str = "*.csv",
    files_per_trigger: int = 64,
    exact_width: bool = False,
) -> DataFrame:
    """Raw files of one header generation as a stream of canonical rows."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern)
        .text(folder)
    )
    lines = drop_blank_lines(lines)
    if exact_width:
        lines = keep_field_count(lines, len(header))
    return typed(rename_canonical(parse_lines(lines, header), alias_sets([header])))


def append_new_files(
    trips: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    *,
    partitions: tuple[str, ...] = ("pickup_year", "pickup_month"),
) -> StreamingQuery:
    """Transform all files not seen before, append them, and stop.

    The checkpoint folder remembers finished files, so a rerun after a failure
    neither skips nor repeats one.
    """
    return (
        transform(trips)
        .writeStream.format("parquet")
        .partitionBy(*partitions)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
