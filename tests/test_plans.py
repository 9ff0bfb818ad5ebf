"""Physical-plan assertions on the registered queries (driver tables)."""

from __future__ import annotations

import re

import pytest

from farepath.plans.inspect import physical_plan
from farepath.registry import QUERIES
from tests.conftest import SF_SMALL


def plan(spark, name):
    return physical_plan(QUERIES[name](spark, SF_SMALL), "simple")


def read_schemas(text):
    return re.findall(r"ReadSchema: (struct<[^>]*>)", text)


def test_same_region_prunes_and_pushes(spark):
    p = plan(spark, "same_region_trip_counts")
    assert "struct<PULocationID:int,DOLocationID:int>" in read_schemas(p)
    assert "PushedFilters: [In(Borough, [AFRICA,AMERICA,ASIA])" in p
    assert p.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in p
    assert "partial_count" in p


def test_revenue_reads_only_key_and_measures(spark):
    schemas = read_schemas(plan(spark, "region_revenue"))
    trip_schema = [s for s in schemas if "PULocationID" in s][0]
    assert "longitude" not in trip_schema and "datetime" not in trip_schema


def test_hour_means_filter_reaches_parquet(spark):
    p = plan(spark, "hour_of_day_means")
    assert "Not(EqualTo(value,0.0))" in p and "struct<ts:timestamp_ntz,user_id:bigint,value:double>" in p


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(spark, "zone_pair_top")


def test_arg_max_joins_back_by_broadcast(spark):
    p = plan(spark, "farthest_trip_per_vendor")
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and "Window" not in p
    # the final sort reads a small round-robin exchange, not the scan directly
    assert "RoundRobinPartitioning" in p


@pytest.mark.parametrize("name,node", [("join_broadcast", "BroadcastHashJoin"),
                                       ("join_sort_merge", "SortMergeJoin"),
                                       ("join_shuffle_hash", "ShuffledHashJoin")])
def test_join_strategy_plans(spark, name, node):
    assert node in plan(spark, name)


def test_no_row_at_a_time_python_anywhere(spark):
    for name in QUERIES:
        if name in ("csv_round_trip", "csv_overwrite_single_file", "parquet_ingest", "parquet_ingest_2015",
                    "parquet_ingest_zones", "parquet_ingest_files", "zone_pair_counts_streaming", "text_report"):
            continue  # these return a scan of what the query wrote
        p = plan(spark, name)
        assert "BatchEvalPython" not in p, name
        if name != "hour_of_day_means_udf":
            assert "ArrowEvalPython" not in p, name


def test_text_report_parses_in_the_csv_reader(spark):
    from farepath.plans import trip_queries as tq
    from farepath.registry import TEXT_FIELDS
    from farepath.sources import read_delimited
    from farepath.sources.tables import trips_csv_path

    parsed = read_delimited(spark, trips_csv_path(spark, SF_SMALL, "2015"), TEXT_FIELDS)
    p = physical_plan(tq.farthest_trip_report(tq.farthest_trip_one_per_vendor(parsed, ordered=False)), "simple")
    assert "FileScan csv" in p and "split(" not in p


@pytest.mark.parametrize("strategy,node", [("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"),
                                           ("broadcast", "BroadcastHashJoin")])
def test_sql_lookup_sample_hints(spark, strategy, node):
    from farepath.plans.sql_queries import lookup_sample_join_sql
    from farepath.sources.tables import prepared_lookup_path, prepared_trips

    df = lookup_sample_join_sql(spark, prepared_trips(spark, SF_SMALL), prepared_lookup_path(spark, SF_SMALL),
                                n=10, strategy=strategy)
    assert node in physical_plan(df, "simple")


@pytest.mark.parametrize("name", ["farthest_trip_one_per_vendor", "max_quantity_one_per_vendor"])
def test_one_row_arg_max_uses_hash_aggregates_only(spark, name):
    p = plan(spark, name)
    assert "HashAggregate" in p and "SortAggregate" not in p and "ObjectHashAggregate" not in p


def test_lookup_joins_meet_counts_not_trips(spark):
    for name in ("join_sort_merge", "join_shuffle_hash", "lookup_sample_join_count"):
        p = plan(spark, name)
        join = min(i for i in (p.find(n) for n in ("SortMergeJoin", "ShuffledHashJoin", "BroadcastHashJoin")) if i >= 0)
        assert "partial_count" in p[join:], name


def test_derivation_shuffles_the_line_items_twice_at_most(spark):
    from farepath.sources.tables import derive_trips

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        p = physical_plan(derive_trips(spark, SF_SMALL), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = [line for line in p.splitlines() if "Exchange hashpartitioning" in line]
    # orders and customer by customer, the ordered rows and the line items by
    # order, the joined rows and the suppliers by supplier
    assert len(above) == 6
    assert sum("l_" in line for line in above) == 2


def test_size_check_has_no_limit(spark):
    from farepath.operators import lookup

    seen = []
    agg = type(spark.range(1)).agg
    try:
        type(spark.range(1)).agg = lambda self, *a: seen.append(agg(self, *a)) or seen[-1]
        lookup.size_at_most(spark.range(10), 5)
    finally:
        type(spark.range(1)).agg = agg
    (checked,) = seen
    p = physical_plan(checked, "simple")
    assert "Limit" not in p and "partial_count" in p
