from __future__ import annotations

import csv
import glob

from farepath import jobs
from farepath.schemas import TRIPS_2024, ZONE_LOOKUP
from farepath.sinks import write_csv, write_parquet
from tests.fixtures import trips, zones


def _read_out(path):
    local = path[len("file:"):] if path.startswith("file:") else path
    (part,) = glob.glob(f"{local}/part-*.csv")
    with open(part) as fh:
        return list(csv.reader(fh))


def _trips_2024(spark):
    from pyspark.sql import functions as F

    t = trips(spark)
    return t.select(*[(F.col(f.name) if f.name in t.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in TRIPS_2024.fields])


def test_zone_pairs_job_on_csv(spark, out_dir):
    write_csv(_trips_2024(spark), out_dir + "/t")
    write_csv(zones(spark), out_dir + "/z")
    jobs.main(["zone-pairs", "--trips", out_dir + "/t", "--zones", out_dir + "/z", "--format", "csv",
               "--out", out_dir + "/o", "--single-file"], spark=spark)
    got = _read_out(out_dir + "/o")
    assert got[0] == ["Pickup Zone", "Dropoff Zone", "TotalTrips"] and got[1] == ["Midtown", "Harlem", "1"]


def test_revenue_and_ingest_jobs(spark, out_dir):
    write_csv(_trips_2024(spark), out_dir + "/t")
    write_csv(zones(spark), out_dir + "/z")
    jobs.main(["ingest", "--trips", out_dir + "/t", "--zones", out_dir + "/z", "--out", out_dir + "/pq",
               "--mode", "errorifexists"], spark=spark)
    jobs.main(["revenue", "--trips", out_dir + "/pq/trips", "--zones", out_dir + "/pq/zones",
               "--out", out_dir + "/o", "--single-file"], spark=spark)
    got = _read_out(out_dir + "/o")
    assert got[0][0] == "Borough" and [r[0] for r in got[1:]] == ["Manhattan", "Queens", "Brooklyn"]


def test_join_strategy_job_prints_plan(spark, out_dir, capsys):
    write_parquet(trips(spark), out_dir + "/t")
    write_parquet(spark.createDataFrame(zones(spark).collect(), ZONE_LOOKUP), out_dir + "/z")
    jobs.main(["join-strategy", "--trips", out_dir + "/t", "--zones", out_dir + "/z",
               "--strategy", "merge", "--sample", "3"], spark=spark)
    out = capsys.readouterr().out
    assert "SortMergeJoin" in out and "rows: 5" in out  # zones 1-3: three trips from 1, two from 3


def _trips_2015(spark):
    from pyspark.sql import functions as F

    from farepath.schemas import TRIPS_2015

    t = trips(spark)
    return t.select(*[(F.col(f.name) if f.name in t.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                      for f in TRIPS_2015.fields])


def test_hour_and_farthest_jobs_on_2015_csv(spark, out_dir):
    write_csv(_trips_2015(spark), out_dir + "/t15")
    jobs.main(["hour-means", "--trips", out_dir + "/t15", "--format", "csv", "--udf", "--out", out_dir + "/h", "--single-file"],
              spark=spark)
    assert _read_out(out_dir + "/h")[0] == ["HourofDay", "Longitude", "Latitude"]
    jobs.main(["farthest-trip", "--trips", out_dir + "/t15", "--format", "csv", "--sql", "--out", out_dir + "/f", "--single-file"],
              spark=spark)
    got = _read_out(out_dir + "/f")
    assert got[0] == ["VendorID", "Max Haversine Distance (km)", "Duration (min)"]
    assert [r[0] for r in got[1:]] == ["1", "1", "2", "3"]


def test_borough_and_night_jobs_sql(spark, out_dir):
    write_csv(_trips_2024(spark), out_dir + "/t")
    write_csv(zones(spark), out_dir + "/z")
    jobs.main(["same-borough", "--sql", "--trips", out_dir + "/t", "--zones", out_dir + "/z", "--format", "csv",
               "--out", out_dir + "/b", "--single-file"], spark=spark)
    assert _read_out(out_dir + "/b")[1:] == [["Manhattan", "2"], ["Queens", "2"], ["Brooklyn", "1"]]
    jobs.main(["night-trips", "--sql", "--trips", out_dir + "/t", "--format", "csv", "--out", out_dir + "/n", "--single-file"],
              spark=spark)
    assert _read_out(out_dir + "/n")[1:] == [["", "1"], ["1", "2"], ["3", "1"]]


def test_text_report_jobs(spark, out_dir):
    write_csv(_trips_2015(spark), out_dir + "/t15")
    jobs.main(["farthest-trip", "--report", "--trips", out_dir + "/t15", "--format", "csv",
               "--out", out_dir + "/r", "--single-file"], spark=spark)
    local = (out_dir + "/r").removeprefix("file:")
    (part,) = glob.glob(f"{local}/part-*")
    lines = open(part).read().splitlines()
    assert lines[0] == "VendorID\tMax Haversine Distance (km)\tDuration (min)" and len(lines) == 4
    assert lines[1].startswith("1\t\t\t") and lines[1].endswith("\t\t\t-5.0")
    jobs.main(["hour-means", "--report", "--trips", out_dir + "/t15", "--format", "csv",
               "--out", out_dir + "/h", "--single-file"], spark=spark)
    (part,) = glob.glob(f"{(out_dir + '/h').removeprefix('file:')}/part-*")
    assert open(part).read().splitlines()[0] == "HourOfDay\t\tLongitude\t\tLatitude"


def test_explain_flag_prints_plan(spark, out_dir, capsys):
    write_parquet(trips(spark), out_dir + "/t")
    write_parquet(spark.createDataFrame(zones(spark).collect(), ZONE_LOOKUP), out_dir + "/z")
    jobs.main(["zone-pairs", "--trips", out_dir + "/t", "--zones", out_dir + "/z", "--explain", "formatted",
               "--show", "2"], spark=spark)
    out = capsys.readouterr().out
    assert "== Physical Plan ==" in out and "BroadcastHashJoin" in out and "Midtown" in out


def test_inferred_schema_and_several_output_files(spark, out_dir):
    write_csv(_trips_2015(spark), out_dir + "/t15")
    results = []
    for extra in ([], ["--inferred"]):
        out = f"{out_dir}/h{len(extra)}"
        jobs.main(["hour-means", "--trips", out_dir + "/t15", "--format", "csv", "--out", out, *extra], spark=spark)
        results.append(sorted(map(tuple, spark.read.option("header", True).csv(out).collect())))
    assert results[0] == results[1] and results[0]
