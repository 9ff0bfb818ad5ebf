"""The trip questions on hand-written edge cases."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from farepath.plans import sql_queries as sq
from farepath.plans import trip_queries as tq
from farepath.plans.inspect import physical_plan
from farepath.functions import haversine_km
from tests.fixtures import trips, ts, zones

P, Q, FAR = (-73.98, 40.75), (-73.90, 40.77), (-73.70, 40.80)


def rows(df):
    return [tuple(r) for r in df.collect()]


def km(spark, a, b):
    df = spark.createDataFrame([(*a, *b)], "a double, b double, c double, d double")
    return round(df.select(haversine_km("a", "b", "c", "d")).first()[0], 2)


def test_farthest_trip_keeps_ties_drops_null_vendor_and_bad_coords(spark):
    got = rows(tq.farthest_trip_per_vendor(trips(spark)))
    far = km(spark, P, FAR)
    assert sorted(got) == sorted([(1, far, 5.0), (1, far, -5.0),
                                  (2, km(spark, P, (-73.80, 40.60)), 40.0), (3, km(spark, P, Q), 30.0)])
    assert [r[0] for r in got] == sorted(r[0] for r in got)


def test_farthest_trip_sql_form_agrees(spark):
    t = trips(spark)
    assert sorted(rows(sq.farthest_trip_per_vendor_sql(spark, t))) == sorted(rows(tq.farthest_trip_per_vendor(t)))


def test_farthest_trip_one_per_vendor_breaks_ties(spark):
    got = rows(tq.farthest_trip_one_per_vendor(trips(spark)))
    assert [r[0] for r in got] == [1, 2, 3]
    assert got[0][2] == -5.0


def test_farthest_report_lines(spark):
    rep = [r.value for r in tq.farthest_trip_report(tq.farthest_trip_one_per_vendor(trips(spark))).collect()]
    assert rep[0] == "VendorID\tMax Haversine Distance (km)\tDuration (min)"
    assert rep[1] == f"1\t\t\t{km(spark, P, FAR):.2f}\t\t\t-5.0"
    assert len(rep) == 4


def test_same_region_counts(spark):
    expect = [("Manhattan", 2), ("Queens", 2), ("Brooklyn", 1)]
    assert rows(tq.same_region_trip_counts(trips(spark), zones(spark))) == expect
    assert rows(sq.same_region_trip_counts_sql(spark, trips(spark), zones(spark))) == expect


def test_night_counts_edges_and_null_vendor(spark):
    expect = [(None, 1), (1, 2), (3, 1)]
    assert rows(tq.night_counts(trips(spark))) == expect
    assert rows(sq.night_counts_sql(spark, trips(spark))) == expect


def test_night_counts_plain_window(spark):
    got = dict(rows(tq.night_counts(trips(spark), start_hour=12, end_hour=14)))
    assert got == {2: 2}


def test_zone_pairs_by_name(spark):
    expect = [("Midtown", "Harlem", 1), ("Midtown", "Newark Airport", 1),
              ("Newark Airport", "Midtown", 1), ("Park Slope", "Harlem", 1)]
    assert rows(tq.zone_pair_counts(trips(spark), zones(spark))) == expect
    assert rows(tq.zone_pair_top(trips(spark), zones(spark), k=2)) == expect[:2]


def test_zone_pairs_merge_ids_sharing_a_name(spark):
    extra = spark.createDataFrame([(3, 1), (4, 1)], "PULocationID int, DOLocationID int")
    got = rows(tq.zone_pair_counts(extra, zones(spark)))
    assert got == [("Astoria", "Midtown", 2)]


def test_region_revenue(spark):
    measures = {"fare_amount": "Fare ($)", "tip_amount": "Tips ($)", "airport_fee": "Airport Fee ($)",
                "total_amount": "Total Revenue ($)"}
    got = rows(tq.region_revenue(trips(spark), zones(spark), measures=measures))
    assert got == [("Manhattan", "45.00", "4.50", None, "49.50"),
                   ("Queens", "10.00", "0.00", "1.75", "11.75"),
                   ("Brooklyn", "9.13", "1.00", None, "10.13")]
    # Without per-value cents the 0.125 fare is summed as a double and the
    # formatted total rounds half-even.
    dbl = rows(tq.region_revenue(trips(spark), zones(spark), measures=measures, exact_cents=False))
    assert dbl[2] == ("Brooklyn", "9.12", "1.00", None, "10.12")


def test_hour_means_match_pandas(spark):
    t = trips(spark)
    got = rows(tq.hour_of_day_means(t))
    pdf = pd.DataFrame(rows(t.select("tpep_pickup_datetime", "pickup_longitude", "pickup_latitude")),
                       columns=["t", "lon", "lat"])
    pdf = pdf[(pdf.lon != 0) & (pdf.lat != 0) & pdf.lon.notna() & pdf.lat.notna()]
    exp = pdf.groupby(pdf.t.dt.hour)[["lon", "lat"]].mean().reset_index()
    assert [r[0] for r in got] == list(exp.t)
    for g, (_, e) in zip(got, exp.iterrows()):
        assert g[1] == pytest.approx(e.lon) and g[2] == pytest.approx(e.lat)
    udf = rows(tq.hour_of_day_means(t, use_udf=True))
    assert [r[0] for r in udf] == [r[0] for r in got]
    assert all(a[1] == pytest.approx(b[1]) for a, b in zip(udf, got))


@pytest.mark.parametrize("strategy,node", [("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"),
                                           ("shuffle_hash", "ShuffledHashJoin"), ("auto", "BroadcastHashJoin")])
def test_join_strategies_same_rows_own_plan(spark, strategy, node):
    t, z = trips(spark), zones(spark)
    df = tq.lookup_join_counts(t, z, strategy)
    assert node in physical_plan(df, "simple")
    assert sorted(rows(df)) == sorted(rows(tq.lookup_join_counts(t, z, "planner")))


def test_lookup_sample_is_ordered_and_bounded(spark):
    got = tq.lookup_sample(trips(spark), zones(spark), n=2)
    # zones 1 and 2 are the sample; only zone 1 has pickups in the fixture
    assert {r.LocationID for r in got.collect()} == {1}
    assert got.columns[-4:] == ["LocationID", "Borough", "Zone", "service_zone"]


def test_same_rows_on_one_and_many_shuffle_partitions(spark):
    t, z = trips(spark), zones(spark)
    m = {"fare_amount": "Fare ($)", "total_amount": "Total Revenue ($)"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = rows(tq.zone_pair_counts(t, z)), rows(tq.region_revenue(t, z, measures=m))
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = rows(tq.zone_pair_counts(t, z)), rows(tq.region_revenue(t, z, measures=m))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == many


def test_native_questions_have_no_python_eval(spark):
    t, z = trips(spark), zones(spark)
    for df in (tq.farthest_trip_per_vendor(t), tq.zone_pair_counts(t, z), tq.region_revenue(t, z, measures={"fare_amount": "F"}, order_measure="fare_amount"),
               tq.hour_of_day_means(t)):
        plan = physical_plan(df, "simple")
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "ArrowEvalPython" in physical_plan(tq.hour_of_day_means(t, use_udf=True), "simple")


def test_empty_input_keeps_schema(spark):
    t = trips(spark).where(F.lit(False))
    for df in (tq.farthest_trip_per_vendor(t), tq.zone_pair_counts(t, zones(spark)),
               tq.night_counts(t), tq.region_revenue(t, zones(spark), measures={"fare_amount": "F"}, order_measure="fare_amount")):
        assert df.count() == 0 and len(df.columns) >= 2


def test_report_file_keeps_order(spark, out_dir):
    import os

    from farepath.sinks import write_text

    rep = tq.farthest_trip_report(tq.farthest_trip_one_per_vendor(trips(spark), ordered=False))
    path = write_text(rep, out_dir, single_file=True)
    local = path[len("file:"):] if path.startswith("file:") else path
    (part,) = [f for f in os.listdir(local) if f.startswith("part-")]
    with open(os.path.join(local, part)) as fh:
        lines = fh.read().splitlines()
    assert lines[0].startswith("VendorID\t") and [ln.split("\t")[0] for ln in lines[1:]] == ["1", "2", "3"]


def test_csv_and_parquet_inputs_agree(spark, out_dir):
    from farepath.schemas import ZONE_LOOKUP
    from farepath.sinks import write_csv, write_parquet
    from farepath.sources import read_csv, read_parquet

    t, z = trips(spark), zones(spark)
    write_csv(t, out_dir + "/t.csv")
    write_csv(z, out_dir + "/z.csv")
    write_parquet(t, out_dir + "/t.pq")
    tc, zc = read_csv(spark, out_dir + "/t.csv", t.schema), read_csv(spark, out_dir + "/z.csv", ZONE_LOOKUP)
    tp = read_parquet(spark, out_dir + "/t.pq")
    assert rows(tq.zone_pair_counts(tc, zc)) == rows(tq.zone_pair_counts(tp, z))
    assert rows(tq.same_region_trip_counts(tc, zc)) == rows(tq.same_region_trip_counts(tp, z))


def test_streaming_counts_equal_batch(spark, out_dir):
    from farepath.sinks import write_parquet
    from farepath.streaming import run_available, stream_files

    t, z = trips(spark), zones(spark)
    write_parquet(t.repartition(3), out_dir + "/in")
    stream = stream_files(spark, out_dir + "/in", t.schema, max_files_per_trigger=1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    snapshot = spark.read.parquet(run_available(tq.zone_pair_counts(stream, z), out_dir + "/out",
                                                out_dir + "/ckpt"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sorted(rows(snapshot)) == sorted(rows(tq.zone_pair_counts(t, z)))
    night = spark.read.parquet(run_available(tq.night_counts(stream), out_dir + "/out2", out_dir + "/ckpt2"))
    assert sorted(rows(night), key=str) == sorted(rows(tq.night_counts(t)), key=str)


def test_lookup_sample_renames_clashing_columns(spark):
    fact = spark.createDataFrame([(1, "fact")], "PULocationID int, Zone string")
    got = tq.lookup_sample(fact, zones(spark), n=3)
    assert got.columns == ["PULocationID", "Zone", "LocationID", "Borough", "Zone_lookup", "service_zone"]
    assert rows(got) == [(1, "fact", 1, "Manhattan", "Midtown", "Yellow Zone")]


def test_night_counts_on_text_times(spark):
    df = spark.createDataFrame([(1, "2024-01-15 23:00:00"), (1, "2024-01-15 06:59:59"), (1, "bad"), (2, None)],
                               "VendorID int, tpep_pickup_datetime string")
    assert rows(tq.night_counts(df)) == [(1, 2)]


def test_hour_means_report(spark):
    rep = [r.value for r in tq.hour_means_report(tq.hour_of_day_means(trips(spark))).collect()]
    assert rep[0] == "HourofDay".replace("of", "Of") + "\t\tLongitude\t\tLatitude"
    hours = [int(line.split("\t\t")[0]) for line in rep[1:]]
    assert hours == sorted(hours) and len(rep[1].split("\t\t")[1].split(".")[1]) == 6


def _with_bad_coordinates(spark):
    """Vendor 1 with a real trip, and trips with a NaN, an infinite or a NULL
    coordinate, in both file layouts."""
    from farepath.schemas import TRIPS_2015

    nan, inf = float("nan"), float("inf")
    rows = [(1, ts(9), ts(9, 30), *c, -73.90, 40.77) for c in ((-73.98, 40.75), (nan, 40.0), (inf, 40.0), (-73.0, nan), (-73.0, -inf), (None, 40.0))]
    df = spark.createDataFrame(rows, "VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, "
                                     "pickup_longitude double, pickup_latitude double, dropoff_longitude double, dropoff_latitude double")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRIPS_2015.fields])


def test_non_finite_coordinates_never_win(spark, out_dir):
    from farepath.plans.sql_queries import farthest_trip_per_vendor_sql
    from farepath.registry import TEXT_FIELDS
    from farepath.sinks import write_csv
    from farepath.sources import drop_header, parse_delimited, read_delimited, read_lines

    trips = _with_bad_coordinates(spark)
    path = write_csv(trips, out_dir)
    forms = [trips, read_delimited(spark, path, TEXT_FIELDS), parse_delimited(drop_header(read_lines(spark, path)), TEXT_FIELDS)]
    for form in forms:
        for found in (tq.farthest_trip_per_vendor(form), farthest_trip_per_vendor_sql(spark, form), tq.farthest_trip_one_per_vendor(form)):
            (row,) = found.collect()
            assert row[0] == 1 and 7 < row[1] < 8 and row[2] == 30.0


def test_both_text_paths_agree_on_bad_times(spark, out_dir):
    from farepath.sources import parse_delimited, read_delimited, read_lines
    from tests.test_functions import BAD_TIMES

    lines = spark.createDataFrame([(f"{i},{t}",) for i, t in enumerate([*BAD_TIMES, "2015-01-15 10:00:00", "2015-01-15 10:00:00.250000"])], "value string")
    lines.coalesce(1).write.text(out_dir)
    fields = [(0, "id", "int"), (1, "t", "timestamp_ntz")]
    split = sorted(map(tuple, parse_delimited(read_lines(spark, out_dir), fields).collect()))
    scanned = sorted(map(tuple, read_delimited(spark, out_dir, fields, header=False).collect()))
    assert split == scanned and sum(t is not None for _, t in split) == 2


def test_night_counts_drop_bad_text_in_both_forms(spark):
    from farepath.plans.sql_queries import night_counts_sql

    rows = [(1, "2015-01-15 23:10:00"), (1, "bad"), (2, "2015"), (2, "2015-01-15 99:00:00"), (3, "2015-01-15 03:00:00"), (3, None), (None, "2015-01-15 00:00:00")]
    df = spark.createDataFrame(rows, "VendorID int, tpep_pickup_datetime string")
    want = [(None, 1), (1, 1), (3, 1)]
    assert [tuple(r) for r in tq.night_counts(df).collect()] == want
    assert [tuple(r) for r in night_counts_sql(spark, df).collect()] == want


def test_sql_quotes_column_names(spark):
    from farepath.plans.sql_queries import farthest_trip_per_vendor_sql, night_counts_sql

    odd = "ven`dor {x}"
    t = trips(spark).withColumnRenamed("VendorID", odd)
    a = [tuple(r) for r in night_counts_sql(spark, t, key=odd).collect()]
    assert a == [tuple(r) for r in tq.night_counts(trips(spark)).collect()]
    odd = "ven dor {x}"
    t = trips(spark).withColumnRenamed("VendorID", odd)
    b = [tuple(r) for r in farthest_trip_per_vendor_sql(spark, t, vendor=odd).collect()]
    assert b == [tuple(r) for r in tq.farthest_trip_per_vendor(trips(spark)).collect()]


def test_revenue_shows_non_finite_sums(spark):
    t = trips(spark)
    nan = float("nan")
    odd = t.withColumn("fare_amount", F.when(F.col("PULocationID") == 3, F.lit(nan)).otherwise(F.col("fare_amount")))
    measures = {"fare_amount": "Fare ($)", "total_amount": "Total Revenue ($)"}
    plain = {r[0]: tuple(r) for r in tq.region_revenue(t, zones(spark), measures=measures).collect()}
    got = {r[0]: tuple(r) for r in tq.region_revenue(odd, zones(spark), measures=measures).collect()}
    assert got["Queens"] == ("Queens", "NaN", plain["Queens"][2])
    assert {k: v for k, v in got.items() if k != "Queens"} == {k: v for k, v in plain.items() if k != "Queens"}
