"""Table sinks and reads: regional layout, catalogue, keys, SQL."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.functions.text import region_in_path
from curbflow.session import shared_dir

MONTH_PARTITIONS = ("pickup_year", "pickup_month")


def sort_keys(first: str, second: str, region: str) -> list[str]:
    """The eight sort columns, led by one end of the trip."""
    return [
        column
        for end in (first, second)
        for column in (f"{end}_{region}", f"{end}_datetime", f"{end}_latitude", f"{end}_longitude")
    ]


def write_regional(
    trips: DataFrame,
    path: str,
    *,
    end: str,
    region: str,
    partitions: Sequence[str] = MONTH_PARTITIONS,
    region_folders: bool = False,
    n_groups: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write trips by month, sorted by the region of one end inside each file.

    The rebalance hint groups rows by month and region and splits groups that
    are too large for one task, so a hot region becomes several files. Files are
    sorted on the eight keys; Parquet min/max statistics then skip to a region.
    ``region_folders`` makes the region a folder level instead. ``n_groups`` is
    the number of shuffle partitions before splitting, by default the session's.
    ``overwrite`` replaces the folders that ``trips`` has rows for and leaves the
    others, so a month may be written again.
    """
    other = "dropoff" if end == "pickup" else "pickup"
    folders = [*partitions, f"{end}_{region}"] if region_folders else [*partitions]
    keys = [k for k in sort_keys(end, other, region) if k not in folders]
    order = [F.col(c).asc_nulls_first() for c in (*folders, *keys)]
    groups = list(dict.fromkeys([*partitions, f"{end}_{region}"]))
    target = groups if n_groups is None else [n_groups, *groups]
    (
        trips.hint("rebalance", *target)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


def write_both_ends(trips: DataFrame, root: str, *, region: str, **options) -> None:
    """The table twice: led by pickup region and led by dropoff region.

    Both copies are made from one stored set of rows, so that cleaning and the
    spatial step behind ``trips`` run once. Months already in the tree stay, and
    a month that is written again is replaced in both copies.
    """
    spark = trips.sparkSession
    staged = f"{shared_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    trips.write.parquet(staged)
    rows = spark.read.schema(trips.schema).parquet(staged)
    for end in ("pickup", "dropoff"):
        write_regional(rows, f"{root}/{end}", end=end, region=region, **options)


def read_region(spark: SparkSession, path: str, column: str, region_id: int) -> DataFrame:
    """The rows of one region; folders and row groups of others are skipped."""
    return spark.read.parquet(path).where(F.col(column) == region_id)


def read_with_region(reader, paths: str | Sequence[str], leaf: str = "net") -> DataFrame:
    """Many per-region files as one table, the region id taken from each path.

    ``reader`` is a configured ``spark.read``. Files without an id are left out.
    """
    rows = reader.load(paths if isinstance(paths, str) else list(paths))
    region = region_in_path(F.col("_metadata.file_path"), leaf)
    return rows.select("*", region.alias("region_id")).where(F.col("region_id").isNotNull())


def save(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Store an intermediate or a result; ``fmt="csv"`` writes a header line."""
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def append_table(df: DataFrame, table: str) -> None:
    """Append to a managed table, creating it on first use."""
    df.write.mode("append").saveAsTable(table)


# Column types of the trip table in an external database.
JDBC_TYPES = (
    "pickup_tract_id SMALLINT, dropoff_tract_id SMALLINT, "
    "pickup_year SMALLINT, pickup_month SMALLINT, weekday SMALLINT, passenger_count SMALLINT, "
    "fare_rev_per_hour REAL, fare_amount REAL, total_amount REAL, trip_time REAL, trip_distance REAL"
)


def append_jdbc(
    df: DataFrame, url: str, table: str, properties: Mapping[str, str], connections: int = 16
) -> None:
    """Append to a database table; needs the user's JDBC driver on the class path."""
    (
        df.write.option("createTableColumnTypes", JDBC_TYPES)
        .option("numPartitions", connections)
        .option("batchsize", 10_000)
        .jdbc(url, table, mode="append", properties=dict(properties))
    )


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that are not unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df`` unchanged, or raise with an example if a key repeats."""
    example = key_violations(df, keys).limit(1).collect()
    if example:
        raise ValueError(f"key {list(keys)} is not unique: {example[0].asDict()}")
    return df


def run_sql(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over DataFrames named in the query as ``{name}``."""
    return spark.sql(query, **tables)


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def list_tables(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables() if not t.isTemporary]


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def describe(df: DataFrame) -> DataFrame:
    """Column names and types as a table."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
