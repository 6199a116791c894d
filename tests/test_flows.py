"""Flow counts against plain Python, and their invariants."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from curbflow.functions.aggregates import scaled_mean
from curbflow.operators import flows, rollup

START = datetime(2015, 1, 5, 23, 40)


def make_trips(n=400):
    rows = []
    for i in range(n):
        origin = 1 if i % 3 else (i * 7) % 5  # one region starts most trips
        destination = (i * 11) % 6
        pickup = START + timedelta(minutes=(i * 37) % 3000)
        rows.append((origin, destination, pickup, pickup + timedelta(minutes=3 + i % 50), float(i % 90)))
    return rows


@pytest.fixture(scope="module")
def trips(spark):
    schema = (
        "pickup_zone int, dropoff_zone int, pickup_datetime timestamp_ntz, "
        "dropoff_datetime timestamp_ntz, fare_rev_per_hour double"
    )
    return spark.createDataFrame(make_trips(), schema).repartition(5).cache()


def slot(ts):
    return (ts.year, ts.month, ts.day, ts.isoweekday() % 7 + 1, ts.hour, ts.minute // 15)


def test_net_flow_counts(trips):
    out, into = Counter(), Counter()
    for origin, destination, pickup, dropoff, _ in make_trips():
        out[origin, *slot(pickup)] += 1
        into[destination, *slot(dropoff)] += 1
    expected = {k: (out[k], into[k], into[k] - out[k]) for k in out | into if k[0] != 0}
    got = {tuple(r[:7]): tuple(r[7:]) for r in flows.net_flow(trips, "zone").collect()}
    assert got == expected


def test_join_form_agrees(trips):
    one = flows.net_flow(trips, "zone", mean_rate=scaled_mean(1000))
    two = flows.merge_flows(flows.trips_out(trips, "zone", scaled_mean(1000)), flows.trips_in(trips, "zone"))
    assert one.columns == two.select(one.columns).columns
    assert one.exceptAll(two.select(one.columns)).count() == 0
    assert two.select(one.columns).exceptAll(one).count() == 0


def test_net_flow_sums_to_zero_over_all_regions(trips):
    shifted = trips.withColumns({"pickup_zone": F.col("pickup_zone") + 1, "dropoff_zone": F.col("dropoff_zone") + 1})
    assert flows.net_flow(shifted, "zone").agg(F.sum("net_trips_in")).first()[0] == 0


def test_unknown_time_keeps_its_trips(spark):
    df = spark.createDataFrame(
        [(1, 2, None, None), (1, 2, START, START)],
        "pickup_zone int, dropoff_zone int, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz",
    )
    out = flows.net_flow(df, "zone")
    assert out.count() == 4
    assert out.where("year IS NULL").agg(F.sum("trips_out")).first()[0] == 1
    merged = flows.merge_flows(flows.trips_out(df, "zone"), flows.trips_in(df, "zone"))
    assert merged.count() == 4


def test_internal_trips_can_be_left_out(trips):
    crossing = sum(a != b for a, b, *_ in make_trips() if a != 0)
    out = flows.net_flow(trips, "zone", exclude_internal=True)
    assert out.agg(F.sum("trips_out")).first()[0] == crossing


def test_matrix_keeps_unknown_destination(trips):
    matrix = flows.od_matrix(trips, "zone")
    expected = Counter((a, b) for a, b, *_ in make_trips() if a != 0)
    got = {
        (r[0], r[1]): r[2]
        for r in matrix.groupBy("pickup_zone", "dropoff_zone").agg(F.sum("n")).collect()
    }
    assert got == dict(expected)
    assert any(b == 0 for _, b in got)


def test_shares_sum_to_one(trips):
    share = flows.od_share(flows.od_matrix(trips, "zone"), "zone")
    sums = share.groupBy("pickup_zone", "weekday", "hour", "quarter_hour").agg(F.sum("share").alias("s"))
    assert sums.where("abs(s - 1) > 1e-12").count() == 0


def test_region_parity(trips):
    got = {r["region_id"]: (r["has_pickups"], r["has_dropoffs"]) for r in flows.region_parity(trips, "zone").collect()}
    origins, destinations = {a for a, *_ in make_trips()}, {b for _, b, *_ in make_trips()}
    assert got == {r: (r in origins, r in destinations) for r in origins ^ destinations}


def test_roll_up_and_typical_week(spark, trips):
    codes = spark.createDataFrame([(1, 10, 1), (2, 10, 1), (3, 20, 1), (4, 30, 2)], "region_id int, neighborhood_code int, borough_code int")
    net = rollup.attach_codes(flows.net_flow(trips, "zone"), codes)
    assert net.count() == flows.net_flow(trips, "zone").count()
    areas = ["borough_code", "neighborhood_code"]
    up = rollup.roll_up(net, areas, weather=False)
    assert up.agg(F.sum("trips_out")).first() == net.agg(F.sum("trips_out")).first()
    levels = rollup.roll_up_levels(net, [areas[:1], areas])
    two = levels.where("level = 2").select(up.columns)
    assert up.exceptAll(two).count() == 0 and two.exceptAll(up).count() == 0
    week = rollup.typical_week(up, areas, measures=["trips_out"])
    slots = up.groupBy(*areas, "weekday", "hour", "quarter_hour").agg(F.sum("trips_out").alias("s"), F.count("*").alias("n"))
    joined = week.join(slots, [*areas, "weekday", "hour", "quarter_hour"])
    assert joined.where("abs(trips_out - s / n) > 1e-12").count() == 0


def test_map_frames_are_dense_and_clipped(spark):
    week = spark.createDataFrame(
        [(1, 2, 0, 0, 50.0), (2, 2, 23, 3, -50.0), (1, 3, 0, 0, 7.0), (9, 2, 0, 0, 1.0)],
        "region_id int, weekday int, hour int, quarter_hour int, net_trips_in double",
    )
    frames = rollup.map_frames(week, rollup.id_domain(spark, 3), area="region_id", limit=10.0)
    assert frames.count() == 3 * 96
    known = {(r["region_id"], r["label"]): r["value"] for r in frames.where("value IS NOT NULL").collect()}
    assert known == {(1, "00:00"): 10.0, (2, "23:45"): -10.0}


def test_weather_join_keeps_rows_without_a_reading(spark, trips):
    net = flows.net_flow(trips, "zone")
    weather = spark.createDataFrame([(2015, 1, 6, 1, 30.0, 0.0, 5.0)], "year int, month int, day int, hour int, temperature double, precipitation double, windspeed double")
    out = rollup.attach_weather(net, weather)
    assert out.count() == net.count()
    assert out.where("temperature IS NOT NULL").count() == net.where("day = 6 AND hour = 1").count()


def test_region_listed_twice_is_an_error(spark):
    net = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "region_id int, trips int")
    codes = spark.createDataFrame([(1, 10), (2, 20)], "region_id int, borough_code int")
    joined = rollup.attach_codes(net, codes)
    assert sorted(tuple(r) for r in joined.fillna(0).collect()) == [(1, 5, 10), (2, 6, 20), (3, 7, 0)]
    twice = codes.unionByName(codes.limit(1))
    with pytest.raises(Exception, match="listed twice"):
        rollup.attach_codes(net, twice).collect()
    trips = spark.createDataFrame([(1, 2)], "pickup_tract_id int, dropoff_tract_id int")
    with pytest.raises(Exception, match="listed twice"):
        flows.at_level(trips, twice.withColumnRenamed("region_id", "tract_id"), "tract_id", "borough_code").collect()


def test_dated_codes(spark):
    days = [(1, 2015, 1, 31), (1, 2015, 2, 1), (1, 2016, 7, 1), (1, 2014, 12, 31), (2, 2015, 3, 3), (9, 2015, 1, 1)]
    net = spark.createDataFrame(days, "region_id int, year int, month int, day int")
    rows = [(1, "2015-01-01", "2015-02-01", "a"), (1, "2015-02-01", "2016-01-01", "b"), (1, "2016-07-01", None, "c"), (2, "2000-01-01", None, "d")]
    codes = spark.createDataFrame(rows, "region_id int, f string, t string, area string").select(
        "region_id", F.col("f").cast("date").alias("valid_from"), F.col("t").cast("date").alias("valid_to"), "area"
    )
    got = {(r["region_id"], r["year"], r["month"], r["day"]): r["area"] for r in rollup.attach_dated_codes(net, codes).collect()}
    assert got == dict(zip(days, ["a", "b", "c", None, "d", None]))
    assert rollup.attach_dated_codes(net.where("false"), codes).count() == 0
    clash = codes.unionByName(codes.where("area = 'b'").withColumn("area", F.lit("x")))
    with pytest.raises(ValueError, match="overlap"):
        rollup.attach_dated_codes(net, clash)
    backward = codes.where("area = 'a'").withColumn("valid_to", F.col("valid_from"))
    assert rollup.overlapping_codes(backward).count() == 1
