"""Raw files, weather pages, sinks and reads."""

import os

import pytest
from pyspark.sql import functions as F

from curbflow.functions.text import digits_of, file_month, file_year, padded_id
from curbflow.operators import weather as weather_ops
from curbflow.operators.cleaning import TRACT_TRIP_COLUMNS
from curbflow.sources import raw, tables
from curbflow.sources import weather as weather_source

NARROW = tuple(f"g1_col{i:02d}" for i in range(1, 19))
RENAMED = tuple(f"g2_col{i:02d}" for i in range(1, 19))
WIDE = tuple(f"g3_col{i:02d}" for i in range(1, 20))


def line(k, width=18):
    fields = [
        "CMT", f"2015-01-0{1 + k % 9} 10:00:00", f"2015-01-0{1 + k % 9} 10:15:00", "2", "1.5", "-73.9", "40.7", "1", "N",
        "-73.8", "40.8", "CASH", "10.5", "0.5", "0.5", str(k), "0", "12.5",
    ]
    if width == 19:
        fields.insert(17, "0.3")
    return ",".join(fields)


@pytest.fixture
def raw_folder(folder):
    files = {
        "trips_2009-01.csv": [",".join(NARROW), "", "   ", line(1), line(2)],
        "trips_2010-02.csv": ["", ",".join(RENAMED), line(3), line(4) + ",x", line(5).rsplit(",", 1)[0]],
        "trips_2015-03.csv": [",".join(WIDE), line(6, 19), line(7, 19).replace("1.5", "far"), ""],
        "notes.txt": ["not trips"],
    }
    for name, lines in files.items():
        with open(os.path.join(folder, name), "w") as file:
            file.write("\n".join(lines) + "\n")
    return folder


def test_list_files_by_pattern(spark, raw_folder):
    files = raw.list_files(spark, raw_folder)
    got = sorted((r["file_name"], r["year"], r["month"]) for r in files.collect())
    assert got == [("trips_2009-01.csv", 2009, 1), ("trips_2010-02.csv", 2010, 2), ("trips_2015-03.csv", 2015, 3)]
    assert raw.list_files(spark, raw_folder, "*2015*.csv").count() == 1


def test_header_survey_and_aliases(spark, raw_folder):
    paths = [r["path"] for r in raw.list_files(spark, raw_folder).collect()]
    survey = raw.survey_headers(spark, paths)
    by_name = {r["path"].rsplit("/", 1)[1]: tuple(r["header"]) for r in survey.collect()}
    assert by_name == {"trips_2009-01.csv": NARROW, "trips_2010-02.csv": RENAMED, "trips_2015-03.csv": WIDE}
    assert set(raw.distinct_headers(survey)) == {NARROW, RENAMED, WIDE}
    aliases = raw.alias_sets([NARROW, RENAMED, WIDE, NARROW])
    assert len(aliases) == 17
    assert aliases["pickup_datetime"] == ["g1_col02", "g2_col02", "g3_col02"]
    assert aliases["total_amount"] == ["g1_col18", "g2_col18", "g3_col19"]
    assert not any("g1_col14" in raws for raws in aliases.values())


def test_read_trips_with_repair(spark, raw_folder):
    paths = sorted(r["path"] for r in raw.list_files(spark, raw_folder).collect())
    df = raw.read_trips(spark, paths, exact_width=True)
    rows = {r["tip_amount"]: r for r in df.select("tip_amount", "trip_distance", "total_amount", "fare_amount", "pickup_datetime").collect()}
    # tip_amount sits in column 16 and carries the line number
    assert sorted(rows) == [1.0, 2.0, 3.0, 6.0, 7.0]
    assert all(r["total_amount"] == 12.5 and r["fare_amount"] == 10.5 for r in rows.values())
    assert sum(r["trip_distance"] is None for r in rows.values()) == 1
    loose = raw.read_trips(spark, paths)
    assert loose.count() == 7
    assert "g1_col14" in loose.columns and "g3_col18" in loose.columns


def test_survey_takes_one_job(spark, folder):
    """Many small files, blocks of one file apart, blank starts, quotes, gzip, no lines at all."""
    import gzip

    for i in range(60):
        with open(f"{folder}/t_{i:02d}.csv", "w") as file:
            file.write("\n \n" * (i % 3) + ('"a", b ,"c"' if i % 2 else ",x,y") + "\n" + f"{i},2,3\n" * 40)
    with gzip.open(f"{folder}/t_60.csv.gz", "wt") as file:
        file.write("\n" + ",".join(WIDE) + "\n" + line(1, 19) + "\n")
    open(f"{folder}/t_61.csv", "w").close()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        spark.sparkContext.setJobGroup("survey", "survey")
        survey = raw.survey_headers(spark, folder, pathGlobFilter="t_*").collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("survey")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # adaptive execution runs the two stages of one query as two jobs
    assert len(jobs) <= 2
    found = {int(r["path"].split("t_")[1][:2]): r["header"] for r in survey}
    assert set(found) == set(range(61))
    assert all(found[i] == (["a", "b", "c"] if i % 2 else ["V1", "x", "y"]) for i in range(60))
    assert found[60] == list(WIDE)


def test_too_many_headers(spark, folder, monkeypatch):
    monkeypatch.setattr(raw, "MOST_HEADERS", 2)
    for i in range(3):
        with open(f"{folder}/t{i}.csv", "w") as file:
            file.write(f"a{i},b\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        raw.read_trips(spark, folder)
    with pytest.raises(ValueError, match="no file"):
        raw.read_trips(spark, folder, pathGlobFilter="*.none")


def test_row_numbers_do_not_shift_columns(spark, folder):
    with open(f"{folder}/a.csv", "w") as file:
        file.write(" ," + " , ".join(NARROW) + "\n" + "1," + line(1) + "\n" + "," + ",".join(NARROW) + "\n2, " + line(2) + "\n")
    with open(f"{folder}/b.csv", "w") as file:
        file.write(",".join(WIDE) + "\n" + line(3, 19) + "\n")
    df = raw.read_trips(spark, folder)
    rows = sorted(tuple(r) for r in df.select("V1", "tip_amount", "total_amount", "vendor_id").fillna("none").collect())
    assert rows == [("1", 1.0, 12.5, "CMT"), ("2", 2.0, 12.5, "CMT"), ("none", 3.0, 12.5, "CMT")]
    assert dict(df.dtypes)["pickup_datetime"] == "timestamp_ntz"
    assert df.where("pickup_datetime is null").count() == 0


def test_rejected_lines_are_kept_apart(spark, raw_folder):
    lines = spark.read.text(f"{raw_folder}/trips_2010-02.csv")
    assert raw.rejected_lines(lines, 18).count() == 2
    assert raw.keep_field_count(raw.drop_blank_lines(lines), 18).count() == 2
    assert raw.drop_blank_lines(lines).count() == 4


def test_manifest(spark, folder):
    with open(f"{folder}/urls.csv", "w") as file:
        file.write("https://example.org/a/2009/tripdata_2009-01.csv\nhttps://example.org/a/readme.html\n")
    rows = [tuple(r) for r in raw.read_manifest(spark, f"{folder}/urls.csv").select("file_name", "year", "month").collect()]
    assert rows == [("tripdata_2009-01.csv", 2009, 1), ("readme.html", None, None)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("-3.5 °F", 7, "x/t_2015-12.csv")], "t string, i int, p string")
    out = df.select(digits_of(F.col("t")), padded_id(F.col("i")), padded_id(F.lit(12345), 4), file_year(F.col("p")), file_month(F.col("p")))
    assert tuple(out.first()) == ("-3.5", "0007", "12345", 2015, 12)


PAGE = """<html><table id="x"><tbody><tr><td>no</td></tr></tbody></table>
<table class='o' id='obsTable'><thead><tr><th>Time</th></tr></thead><tbody>
<tr class="a"><td>1:51 AM</td><td><span>-3.9</span>&nbsp;F</td><td></td><td></td><td></td><td></td><td></td><td></td>
<td>Calm</td><td></td><td>N/A</td><td>x</td></tr>
<TR><TD>12:51 PM</TD><TD>30.0 F</TD><TD>2</TD><TD>3</TD><TD>4</TD><TD>5</TD><TD>6</TD><TD>7</TD><TD>5.8 mph</TD><TD>9</TD><TD>0.02 in</TD></TR>
<tr><td>2:00 PM</td><td>31 F</td></tr>
<tr></tr></tbody></table></html>"""


def test_weather_pages(spark):
    url = "http://example.org/history/airport/X/2015/1/7/DailyHistory.html?q=1"
    pages = spark.createDataFrame([(url, PAGE), (url, "<html>no table</html>")], "url string, html string")
    readings = weather_source.readings_from_pages(pages)
    rows = sorted(tuple(r) for r in readings.fillna("null").collect())
    assert rows == [
        (2015, 1, 7, "2015-01-07 12:51 PM", "30.0", "0.02", "5.8"),
        (2015, 1, 7, "2015-01-07 1:51 AM", "-3.9", "", ""),
        (2015, 1, 7, "2015-01-07 2:00 PM", "31", "null", "null"),
    ]
    clean = weather_ops.clean_readings(readings)
    got = sorted((r["hour"], r["temperature"], r["precipitation"], r["windspeed"]) for r in clean.fillna(-1).collect())
    assert got == [(1, -3.9, 0.0, -1.0), (12, 30.0, 0.02, 5.8), (14, 31.0, 0.0, -1.0)]


def test_weather_files_to_hours(spark, folder):
    for day, rows in {1: ["1:05 AM,30,0.1,5", "1:51 AM,,x,7", "11:51 PM,20,,1"], 2: ["1:05 AM,10,,"]}.items():
        with open(f"{folder}/day{day}.csv", "w") as file:
            file.write("year,month,day,time,temperature,precipitation,windspeed\n")
            file.writelines(f"2015,1,{day},2015-01-0{day} {row}\n" for row in rows)
    hourly = weather_ops.hourly_weather(weather_ops.clean_readings(weather_source.read_readings(spark, folder)))
    got = {(r["day"], r["hour"]): (r["temperature"], r["precipitation"], r["windspeed"]) for r in hourly.collect()}
    assert got == {(1, 1): (30.0, 0.1, 6.0), (1, 23): (20.0, 0.0, 1.0), (2, 1): (10.0, 0.0, None)}
    assert weather_ops.cross_with_cells(hourly, 4).count() == 12


def tagged(spark, n=300):
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).cast("int").alias("pickup_tract_id"),
        (F.col("id") % 5).cast("int").alias("dropoff_tract_id"),
        F.timestamp_add("HOUR", F.col("id"), F.lit("2015-01-25 00:00:00").cast("timestamp_ntz")).alias("pickup_datetime"),
    )
    out = df.withColumns(
        {
            "dropoff_datetime": F.col("pickup_datetime"),
            "pickup_year": F.year("pickup_datetime"),
            "pickup_month": F.month("pickup_datetime"),
            "weekday": F.dayofweek("pickup_datetime"),
            "passenger_count": F.lit(1),
        }
    )
    rest = [c for c in TRACT_TRIP_COLUMNS if c not in out.columns]
    return out.withColumns({c: F.rand(1) for c in rest}).select(*TRACT_TRIP_COLUMNS)


def test_regional_layout_round_trip(spark, folder):
    df = tagged(spark).cache()
    tables.write_both_ends(df, folder, region="tract_id")
    for end in ("pickup", "dropoff"):
        back = spark.read.parquet(f"{folder}/{end}").select(*df.columns)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
        one = tables.read_region(spark, f"{folder}/{end}", f"{end}_tract_id", 1)
        assert one.count() == df.where(F.col(f"{end}_tract_id") == 1).count()
    assert sorted(os.listdir(f"{folder}/pickup/pickup_year=2015")) == ["pickup_month=1", "pickup_month=2"]


def test_files_are_sorted_by_region(spark, folder):
    tables.write_regional(tagged(spark), folder, end="pickup", region="tract_id", n_groups=3)
    rows = (
        spark.read.parquet(folder)
        .select("pickup_tract_id", "_metadata.file_path", F.monotonically_increasing_id().alias("i"))
        .collect()
    )
    by_file = {}
    for r in sorted(rows, key=lambda r: r["i"]):
        by_file.setdefault(r["file_path"], []).append(r["pickup_tract_id"])
    assert all(ids == sorted(ids) for ids in by_file.values())


def test_region_folders_and_ids_from_paths(spark, folder):
    tables.write_regional(tagged(spark), f"{folder}/by", end="pickup", region="tract_id", region_folders=True)
    one = tables.read_region(spark, f"{folder}/by", "pickup_tract_id", 7)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pickup_tract_id" in plan
    for region in (3, 29, 12345):
        os.makedirs(f"{folder}/net/{region:04d}")
        with open(f"{folder}/net/{region:04d}/net.csv", "w") as file:
            file.write(f"trips\n{region}\n")
    reader = spark.read.format("csv").option("header", True).schema("trips int")
    rows = tables.read_with_region(reader, f"{folder}/net/*/net.csv").collect()
    assert sorted(r["region_id"] for r in rows) == [3, 29, 12345]
    assert all(r["region_id"] == r["trips"] for r in rows)


def test_tables_keys_and_sql(spark, folder):
    df = tagged(spark, 40)
    tables.drop_table(spark, "trips_kept")
    tables.append_table(df, "trips_kept")
    tables.append_table(df, "trips_kept")
    assert tables.table_exists(spark, "trips_kept") and "trips_kept" in tables.list_tables(spark)
    kept = spark.table("trips_kept")
    assert kept.count() == 80
    with pytest.raises(ValueError, match="not unique"):
        tables.assert_unique_key(kept, ["pickup_datetime"])
    assert tables.assert_unique_key(df, ["pickup_datetime"]) is df
    assert tables.run_sql(spark, "SELECT * FROM {t} WHERE weekday = 1", t=df).count() == df.where("weekday = 1").count()
    tables.drop_table(spark, "trips_kept")
    assert not tables.table_exists(spark, "trips_kept")
    tables.save(df, f"{folder}/out", fmt="csv")
    assert spark.read.option("header", True).csv(f"{folder}/out").columns == df.columns
    assert {r["column"]: r["type"] for r in tables.describe(df).collect()}["weekday"] == "int"


def test_monthly_runs_replace_their_month_only(spark, folder):
    """Three months in three calls, one of them twice: no month doubles or goes."""
    df = tagged(spark).cache()
    months = [r[0] for r in df.select("pickup_month").distinct().collect()]
    for month in [*months, months[0]]:
        tables.write_both_ends(df.where(F.col("pickup_month") == month), folder, region="tract_id")
    for end in ("pickup", "dropoff"):
        back = spark.read.parquet(f"{folder}/{end}").select(*df.columns)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_header_with_blanks_is_not_a_row(spark):
    lines = spark.createDataFrame([("a, b ,c",), ("1,2,3",), ("x,y,z",)], "value string")
    rows = raw.parse_lines(lines, ("a", "b", "c"))
    assert sorted(r["a"] for r in rows.collect()) == ["1", "x"]
