"""Incremental ingest and slot counts on a stream."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from curbflow.functions.timeparts import SLOT_PARTS, add_time_features
from curbflow.operators.cleaning import clean_trips
from curbflow.operators.flows import net_flow
from curbflow.streaming.ingest import append_new_files, stream_trips
from curbflow.streaming.slots import stream_net_flow
from test_sources import NARROW, line

SCHEMA = "pickup_zone int, dropoff_zone int, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz"


def rows(start, n):
    out = []
    for i in range(n):
        pickup = start + timedelta(minutes=i * 3)
        out.append((i % 4, (i * 3) % 5, pickup, pickup + timedelta(minutes=20)))
    return out


def test_new_files_are_appended_once(spark, folder):
    def run():
        def transform(df):
            timed = add_time_features(df, ends=("pickup",), parts=("year", "month"))
            return clean_trips(timed, ["vendor_id", "tip_amount", "pickup_year", "pickup_month"])

        trips = stream_trips(spark, f"{folder}/in", NARROW, exact_width=True)
        append_new_files(trips, transform, f"{folder}/out", f"{folder}/state").awaitTermination(120)
        return sorted(r[0] for r in spark.read.parquet(f"{folder}/out").select("tip_amount").collect())

    import os

    os.makedirs(f"{folder}/in")
    for month, numbers in ((1, (1, 2)), (2, (3, 4, 5))):
        with open(f"{folder}/in/trips_2015-0{month}.csv", "w") as file:
            file.write("\n".join([",".join(NARROW), "", *[line(k) for k in numbers], line(9) + ",x"]) + "\n")
        expected = [float(k) for k in range(1, numbers[-1] + 1)]
        assert run() == expected
        assert run() == expected  # nothing new


def test_stream_slots_equal_batch_slots(spark, folder):
    start = datetime(2015, 1, 5, 0, 0)
    data = rows(start, 200)
    spark.createDataFrame(data[:150], SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    spark.createDataFrame(data[150:], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (
        stream_net_flow(stream, "zone", lateness="1 hour")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(180)
    got = spark.read.parquet(f"{folder}/out")
    batch = net_flow(spark.createDataFrame(data, SCHEMA), "zone")
    # slots that end before the newest event minus the allowed lateness are final
    closed = data[-1][3] - timedelta(hours=1)
    slot_end = F.make_timestamp_ntz("year", "month", "day", "hour", (F.col("quarter_hour") * 15).cast("int"), F.lit(0)) + F.expr("INTERVAL 15 MINUTES")
    final = batch.where(slot_end <= F.lit(closed))
    columns = ["region_id", *SLOT_PARTS, "trips_out", "trips_in", "net_trips_in"]
    assert got.count() > 50
    assert got.select(columns).exceptAll(final.select(columns)).count() == 0
    assert final.select(columns).exceptAll(got.select(columns)).count() == 0


def test_slots_work_on_a_batch(spark):
    df = spark.createDataFrame(rows(datetime(2015, 1, 5), 60), SCHEMA)
    columns = ["region_id", *SLOT_PARTS, "trips_out", "trips_in", "net_trips_in"]
    one, two = stream_net_flow(df, "zone", lateness="3 hours").select(columns), net_flow(df, "zone").select(columns)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
