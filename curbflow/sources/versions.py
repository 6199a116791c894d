"""A regional tree whose months are replaced whole, in both copies at once.

Every commit writes its months to a folder of its own and then a new manifest: which month
is in which version. Readers take the newest manifest, which is one file that appears whole,
so they see both copies of a month from before a commit or both from after it, never a
mixture, and nothing of a month that has been written again. Files of older versions stay
for readers that still hold them.

Layout: ``data/version=…/end=pickup|dropoff/pickup_year=…/pickup_month=…/`` and
``manifest/commit=…/``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbflow.session import shared_dir
from curbflow.sources.tables import MONTH_PARTITIONS, write_regional

ENDS = ("pickup", "dropoff")
_MANIFEST = "pickup_year int, pickup_month int, version int"


def commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the commits, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    numbers = [int(name.partition("=")[2]) for name in names if name.startswith("commit=")]
    # a manifest without its success mark is still being written
    done = [n for n in numbers if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/commit={n}/_SUCCESS"))]
    return sorted(done)


def manifest(spark: SparkSession, root: str, commit: int | None = None) -> DataFrame:
    """``pickup_year, pickup_month, version`` of a commit, by default the newest."""
    known = commits(spark, root)
    if commit is None and not known:
        return spark.createDataFrame([], _MANIFEST)
    if commit is not None and commit not in known:
        raise ValueError(f"no commit {commit} in {root}")
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/commit={known[-1] if commit is None else commit}")


def commit_months(trips: DataFrame, root: str, *, region: str, **options) -> int:
    """Write the months of ``trips`` in both copies and put them in place of what the tree
    held of these months; other months stay. Returns the number of the commit.

    The rows behind ``trips`` are worked out once. Two commits at a time do not mix: the
    later one to finish fails, since the number it took is there already.
    """
    spark = trips.sparkSession
    number = max(commits(spark, root), default=0) + 1
    before = manifest(spark, root)
    staged = f"{shared_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    trips.write.parquet(staged)
    rows = spark.read.schema(trips.schema).parquet(staged)
    for end in ENDS:
        write_regional(rows, f"{root}/data/version={number}/end={end}", end=end, region=region, mode="errorifexists", **options)
    months = rows.select(*MONTH_PARTITIONS).distinct()
    new = months.select(*MONTH_PARTITIONS, F.lit(number).alias("version"))
    old = before.join(F.broadcast(months), list(MONTH_PARTITIONS), "left_anti")  # a row per month
    merged = old.unionByName(new).coalesce(1)
    merged.write.mode("errorifexists").parquet(f"{root}/manifest/commit={number}")
    return number


def read_end(spark: SparkSession, root: str, end: str, commit: int | None = None) -> DataFrame:
    """The copy led by one end, as of a commit, by default the newest.

    Only the folders that the manifest names are listed, one per month.
    """
    if end not in ENDS:
        raise ValueError("end must be 'pickup' or 'dropoff'")
    places = sorted((r["pickup_year"], r["pickup_month"], r["version"]) for r in manifest(spark, root, commit).collect())
    if not places:
        raise ValueError(f"no month in {root}")
    paths = [f"{root}/data/version={v}/end={end}/pickup_year={y}/pickup_month={m}" for y, m, v in places]
    rows = spark.read.option("basePath", f"{root}/data").option("mergeSchema", "false").parquet(*paths)
    return rows.drop("end", "version")


def read_region_of(
    spark: SparkSession, root: str, region: str, region_ids: Sequence[int], commit: int | None = None
) -> DataFrame:
    """Trips that start or end in some regions: those of the pickup copy that start there and
    those of the dropoff copy that only end there. ``led_by`` names the copy. Files
    are sorted by the region that leads them, so most row groups are skipped."""
    starts = F.col(f"pickup_{region}").isin(*region_ids)
    ends = F.col(f"dropoff_{region}").isin(*region_ids)
    left = read_end(spark, root, "pickup", commit).where(starts).withColumn("led_by", F.lit("pickup"))
    right = read_end(spark, root, "dropoff", commit).where(ends & ~starts).withColumn("led_by", F.lit("dropoff"))
    return left.unionByName(right)


def unused_versions(spark: SparkSession, root: str, keep_commits: int = 1) -> list[int]:
    """Versions that the last ``keep_commits`` manifests do not name; their folders may be
    deleted once no reader uses them."""
    known = commits(spark, root)
    used: set[int] = set()
    for commit in known[-keep_commits:]:
        used |= {r["version"] for r in manifest(spark, root, commit).select("version").distinct().collect()}
    return [n for n in known if n not in used]
