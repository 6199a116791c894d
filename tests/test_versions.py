"""Months replaced whole, in both copies at once."""

import pytest
from pyspark.sql import functions as F

from curbflow.operators.cleaning import TRACT_TRIP_COLUMNS
from curbflow.sources import versions


def trips(spark, rows):
    """``(pickup tract, dropoff tract, month, passengers)``."""
    known = ["pickup_tract_id", "dropoff_tract_id", "pickup_month", "passenger_count"]
    df = spark.createDataFrame(rows, "pickup_tract_id int, dropoff_tract_id int, pickup_month int, passenger_count int")
    df = df.withColumns(
        {
            "pickup_year": F.lit(2015),
            **{f"{e}_datetime": F.make_timestamp_ntz(F.lit(2015), "pickup_month", F.lit(1), F.lit(8), F.lit(0), F.lit(0)) for e in versions.ENDS},
        }
    )
    rest = [c for c in TRACT_TRIP_COLUMNS if c not in {*known, "pickup_year", "pickup_datetime", "dropoff_datetime"}]
    return df.withColumns({c: F.lit(1.0) for c in rest}).select(*TRACT_TRIP_COLUMNS)


def held(df):
    return sorted(tuple(r) for r in df.select("pickup_month", "pickup_tract_id", "dropoff_tract_id", "passenger_count").collect())


@pytest.mark.parametrize("region_folders", [False, True])
def test_months_are_replaced_whole(spark, folder, region_folders):
    first = [(1, 2, 1, 1), (2, 3, 1, 1), (3, 1, 1, 1), (1, 1, 2, 1), (4, 4, 3, 1)]
    options = {"region": "tract_id", "region_folders": region_folders}
    assert versions.commit_months(trips(spark, first), folder, **options) == 1
    old = versions.read_end(spark, folder, "dropoff")
    # the month again with fewer regions, and a new one
    assert versions.commit_months(trips(spark, [(2, 3, 1, 9), (7, 7, 4, 9)]), folder, **options) == 2
    want = sorted([(1, 2, 3, 9), (2, 1, 1, 1), (3, 4, 4, 1), (4, 7, 7, 9)])
    for end in versions.ENDS:
        assert held(versions.read_end(spark, folder, end)) == want
        assert held(versions.read_end(spark, folder, end, commit=1)) == sorted((m, p, q, n) for p, q, m, n in first)
    assert held(old) == sorted((m, p, q, n) for p, q, m, n in first)  # a reader from before
    assert versions.read_end(spark, folder, "pickup").columns.count("pickup_month") == 1
    one = versions.read_region_of(spark, folder, "tract_id", [3, 4])
    assert sorted(tuple(r) for r in one.select("led_by", "pickup_tract_id", "passenger_count").collect()) == [
        ("dropoff", 2, 9), ("pickup", 4, 1),
    ]
    assert versions.unused_versions(spark, folder) == []
    versions.commit_months(trips(spark, [(5, 5, m, 3) for m in (1, 2, 3)]), folder, **options)
    assert versions.unused_versions(spark, folder) == [1]
    assert versions.unused_versions(spark, folder, keep_commits=3) == []


def test_unfinished_commits_are_not_seen(spark, folder):
    options = {"region": "tract_id"}
    with pytest.raises(ValueError, match="no month"):
        versions.read_end(spark, folder, "pickup")
    versions.commit_months(trips(spark, [(1, 2, 1, 1)]), folder, **options)
    # a commit that stopped after its data, and one within its manifest
    trips(spark, [(9, 9, 1, 9)]).write.parquet(f"{folder}/data/version=7/end=pickup/pickup_year=2015/pickup_month=1")
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/manifest/commit=8")
    assert versions.commits(spark, folder) == [1]
    assert held(versions.read_end(spark, folder, "pickup")) == [(1, 1, 2, 1)]
    with pytest.raises(ValueError, match="no commit"):
        versions.manifest(spark, folder, 8)


def test_two_commits_at_a_time_do_not_mix(spark, folder, monkeypatch):
    versions.commit_months(trips(spark, [(1, 2, 1, 1)]), folder, region="tract_id")
    before = versions.commits(spark, folder)
    versions.commit_months(trips(spark, [(3, 3, 2, 3)]), folder, region="tract_id")
    monkeypatch.setattr(versions, "commits", lambda spark, root: before)  # what a slower writer saw
    with pytest.raises(Exception, match="(?i)exist"):
        versions.commit_months(trips(spark, [(4, 4, 3, 4)]), folder, region="tract_id")
    monkeypatch.undo()
    assert held(versions.read_end(spark, folder, "pickup")) == [(1, 1, 2, 1), (2, 3, 3, 3)]


def test_wrong_end(spark, folder):
    with pytest.raises(ValueError, match="end must be"):
        versions.read_end(spark, folder, "middle")
