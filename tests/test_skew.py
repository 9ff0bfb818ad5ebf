"""One key holding a third of all rows: results stay whole and the plans
keep pre-aggregation and broadcast joins, with no per-group window."""

from __future__ import annotations

from pyspark.sql import functions as F

from farepath.operators import group_counts, rows_at_group_max, with_lookup
from farepath.plans import trip_queries as tq
from farepath.plans.inspect import physical_plan

N = 30_000


def hot_trips(spark):
    ids = spark.range(N)
    hot = F.col("id") % 3 == 0
    return ids.select(
        F.when(hot, F.lit(1)).otherwise((F.col("id") % 50 + 2).cast("int")).alias("VendorID"),
        F.when(hot, F.lit(1)).otherwise((F.col("id") % 7 + 1).cast("int")).alias("PULocationID"),
        ((F.col("id") % 5) + 1).cast("int").alias("DOLocationID"),
        ((F.col("id") * 7919) % 1000 / 1000.0 - 74).alias("pickup_longitude"),
        F.lit(40.5).alias("pickup_latitude"),
        F.lit(-73.9).alias("dropoff_longitude"),
        ((F.col("id") * 104729) % 1000 / 1000.0 + 40).alias("dropoff_latitude"),
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("tpep_pickup_datetime"),
        F.timestamp_seconds(F.col("id") * 60 + 600).cast("timestamp_ntz").alias("tpep_dropoff_datetime"),
    )


def zones(spark):
    return spark.createDataFrame([(i, f"B{i % 2}", f"Z{i}") for i in range(1, 8)],
                                 "LocationID int, Borough string, Zone string")


def test_hot_key_counts_are_whole_and_preaggregated(spark):
    t = hot_trips(spark)
    counts = dict(group_counts(t, "VendorID", "n").collect())
    assert counts[1] == N // 3 and sum(counts.values()) == N
    plan = physical_plan(tq.zone_pair_counts(t, zones(spark)), "simple")
    assert "partial_count" in plan and "BroadcastHashJoin" in plan and "Window" not in plan


def test_hot_key_arg_max_matches_brute_force(spark):
    t = tq.with_distance_duration(hot_trips(spark)).select("VendorID", "distance_km")
    got = sorted(tuple(r) for r in rows_at_group_max(t, ["VendorID"], "distance_km").collect())
    pdf = t.toPandas()
    best = pdf.groupby("VendorID").distance_km.transform("max")
    exp = sorted(tuple(r) for r in pdf[pdf.distance_km == best][["VendorID", "distance_km"]].itertuples(index=False))
    assert got == exp
    plan = physical_plan(rows_at_group_max(t, ["VendorID"], "distance_km"), "simple")
    assert "BroadcastHashJoin" in plan and "Window" not in plan


def test_forced_sort_merge_join_splits_hot_zone(spark):
    """The `merge` strategy shuffles trips by zone; AQE splits the zone that
    holds a third of them (thresholds lowered to test scale)."""
    confs = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        trips = spark.range(200_000).select(
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("int").alias("PULocationID"))
        zones_df = spark.range(1, 60).select(F.col("id").cast("int").alias("LocationID"),
                                             F.concat(F.lit("Z"), F.col("id")).alias("Zone"))
        joined = with_lookup(trips, zones_df, "PULocationID", {"LocationID": "LocationID", "Zone": "Zone"}, strategy="merge")
        df = group_counts(joined, "LocationID", "trips")
        got = {r.LocationID: r.trips for r in df.collect()}
        assert got[1] == 66_667 and sum(got.values()) == 200_000
        assert "SortMergeJoin(skew=true)" in physical_plan(df, "simple")
        # Counted before the join, the hot zone is a row a task like any other.
        counted = tq.lookup_join_counts(trips, zones_df, "merge")
        assert {r.LocationID: r.trips for r in counted.collect()} == got
        assert "skew=true" not in physical_plan(counted, "simple")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
