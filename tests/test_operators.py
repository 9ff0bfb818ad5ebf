from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from farepath.operators import (
    checked_broadcast,
    group_counts,
    group_means,
    group_means_udf,
    group_money_sums,
    one_row_per_group_max,
    rows_at_group_max,
    text_report,
    top_k,
    with_lookup,
)
from farepath.operators.lookup import join_roles
from farepath.plans.inspect import physical_plan


def test_rows_at_group_max_keeps_ties_and_drops_null_keys(spark):
    df = spark.createDataFrame(
        [(1, 5.0, "a"), (1, 5.0, "b"), (1, 2.0, "c"), (2, 1.0, "d"), (None, 9.0, "e"), (2, None, "f")],
        "k int, v double, p string")
    got = sorted(tuple(r) for r in rows_at_group_max(df, ["k"], "v").select("k", "v", "p").collect())
    assert got == [(1, 5.0, "a"), (1, 5.0, "b"), (2, 1.0, "d")]


def test_one_row_per_group_max_tie_break(spark):
    df = spark.createDataFrame([(1, 5.0, 3.0), (1, 5.0, -5.0), (1, 1.0, -9.0), (2, 4.0, 8.0)],
                               "k int, v double, d double")
    got = sorted(tuple(r) for r in one_row_per_group_max(
        df, ["k"], "v", payload=["d"], tie_break=[F.col("d")]).collect())
    assert got == [(1, 5.0, -5.0), (2, 4.0, 8.0)]


def test_rows_at_group_max_plan_is_broadcast_join_back(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 1.0).alias("v"))
    plan = physical_plan(rows_at_group_max(df, ["k"], "v"), "simple")
    assert "BroadcastHashJoin" in plan
    assert "Window" not in plan


def test_group_counts_keeps_null_key(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    got = {r.k: r.n for r in group_counts(df, "k", "n").collect()}
    assert got == {1: 2, None: 1}


def test_group_means_and_udf_agree(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 4.0), (1, 5.0, 6.0)], "h int, x double, y double")
    a = sorted(tuple(r) for r in group_means(df, "h", {"x": "mx", "y": "my"}).collect())
    b = sorted(tuple(r) for r in group_means_udf(df, "h", {"x": "mx", "y": "my"}).collect())
    assert a == b == [(0, 2.0, 3.0), (1, 5.0, 6.0)]


def test_group_money_sums_exact_and_null(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", None), ("a", 1234.56)], "g string, x double")
    got = {r.g: r.s for r in group_money_sums(df, "g", {"x": "s"}).collect()}
    assert got == {"a": Decimal("1234.86"), "b": None}


def test_money_sums_do_not_depend_on_partitioning(spark):
    df = spark.range(20000).select((F.col("id") % 7).alias("g"), ((F.col("id") % 1000) / 100.0 + 0.01).alias("x"))
    one = sorted(tuple(r) for r in group_money_sums(df.coalesce(1), "g", {"x": "s"}).collect())
    many = sorted(tuple(r) for r in group_money_sums(df.repartition(16), "g", {"x": "s"}).collect())
    assert one == many


def test_with_lookup_drops_unknown_and_checks_broadcast(spark):
    fact = spark.createDataFrame([(1,), (2,), (99,), (None,)], "id int")
    lk = spark.createDataFrame([(1, "x"), (2, "y")], "LocationID int, Zone string")
    out = with_lookup(fact, lk, "id", {"Zone": "z"})
    assert sorted(r.z for r in out.collect()) == ["x", "y"]
    assert "BroadcastHashJoin" in physical_plan(out, "simple")


def test_past_the_bound_every_strategy_gives_all_rows(spark):
    """No broadcast is hinted, and nothing fails, whatever was asked for."""
    fact = spark.range(100).withColumnRenamed("id", "k")
    lk = spark.range(50).select(F.col("id").alias("LocationID"), F.lit("z").alias("Zone"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert checked_broadcast(lk, max_rows=10) is lk
        for strategy in ("auto", "broadcast", "merge", "shuffle_hash", "planner"):
            out = with_lookup(fact, lk, "k", {"Zone": "z"}, max_broadcast_rows=10, strategy=strategy)
            both = join_roles(fact, lk, [("k", {"Zone": "z"})], strategy=strategy, max_broadcast_rows=10)
            assert out.count() == both.count() == 50, strategy
            assert "BroadcastHashJoin" not in physical_plan(out, "simple"), strategy
            assert "BroadcastHashJoin" not in physical_plan(both, "simple"), strategy
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_roles_measure_only_the_columns_they_need(spark):
    fact = spark.createDataFrame([(1, 2)], "a int, b int")
    wide = spark.range(1, 100).select(F.col("id").cast("int").alias("LocationID"), F.lit("z").alias("Zone"),
                                      F.repeat(F.lit("x"), 1_000_000).alias("blob"))
    out = join_roles(fact, wide, [("a", {"Zone": "za"}), ("b", {"Zone": "zb"})])
    assert "BroadcastHashJoin" in physical_plan(out, "simple") and out.count() == 1


def test_one_row_per_group_max_puts_null_tie_breaks_last(spark):
    df = spark.createDataFrame([(1, 5.0, 3.0, 30.0), (1, 5.0, None, 1.0), (1, 5.0, 1.0, 10.0), (1, 5.0, 1.0, 5.0),
                                (2, 4.0, None, 8.0), (2, 4.0, None, None)], "k int, v double, d double, p double")
    own = one_row_per_group_max(df, ["k"], "v", payload=["d"], tie_break=[F.col("d")])
    assert sorted(map(tuple, own.collect())) == [(1, 5.0, 1.0), (2, 4.0, None)]
    other = one_row_per_group_max(df, ["k"], "v", payload=["p"], tie_break=[F.col("d")])
    assert sorted(map(tuple, other.collect())) == [(1, 5.0, 5.0), (2, 4.0, 8.0)]
    wide = one_row_per_group_max(df, ["k"], "v", payload=["d", "p"], tie_break=[F.col("d"), F.col("p")])
    assert sorted(map(tuple, wide.collect())) == [(1, 5.0, 1.0, 5.0), (2, 4.0, None, 8.0)]


def test_money_sums_with_non_finite_amounts(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.25), ("a", nan), ("b", inf), ("b", 2.0), ("c", 3.5), ("d", 1e13), ("d", 0.5), ("e", None)], "g string, x double")
    got = {r.g: r.s for r in group_money_sums(df, "g", {"x": "s"}).collect()}
    assert got == {"a": None, "b": None, "c": Decimal("3.50"), "d": None, "e": None}
    both = {r.g: (r.s, r.rest) for r in group_money_sums(df, "g", {"x": "s"}, inexact={"x": "rest"}).collect()}
    assert both["b"] == (Decimal("2.00"), inf) and both["c"] == (Decimal("3.50"), None) and both["d"] == (Decimal("0.50"), 1e13)
    assert both["a"][0] == Decimal("1.25") and both["a"][1] != both["a"][1]


def test_top_k_orders_ties_by_keys(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 7), ("d", 1)], "z string, n long")
    got = [tuple(r) for r in top_k(df, 3, [F.desc("n"), F.col("z")]).collect()]
    assert got == [("c", 7), ("a", 5), ("b", 5)]
    assert "TakeOrderedAndProject" in physical_plan(top_k(df, 3, [F.desc("n"), F.col("z")]), "simple")


def test_text_report_header_first_then_ordered(spark):
    df = spark.createDataFrame([(3, 1.5), (1, 2.25), (2, 0.5)], "v int, d double")
    rep = text_report(df, "V\tD", [F.col("v"), F.format_string("%.1f", "d")], "\t", order=["v"])
    assert [r.value for r in rep.collect()] == ["V\tD", "1\t2.3", "2\t0.5", "3\t1.5"]


def test_size_bound_counts_bytes_not_only_rows(spark):
    from farepath.operators.lookup import size_at_most

    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 10_000).alias("s"))
    assert size_at_most(wide, max_rows=1000, max_bytes=10**9)[0] == 100
    assert size_at_most(wide, max_rows=1000, max_bytes=500_000) is None
    assert size_at_most(wide, max_rows=50) is None
    n, b = size_at_most(spark.range(10), max_rows=100)
    assert n == 10 and b == 10 * 16


def test_rows_at_group_max_past_the_bound_is_still_exact(spark):
    df = spark.range(3000).select((F.col("id") % 5).alias("k"), ((F.col("id") * 7) % 11 * 1.0).alias("v"))
    small = sorted(tuple(r) for r in rows_at_group_max(df, ["k"], "v").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # 5 groups > 2: no hint from us; with Spark's own threshold off too,
        # the join back is shuffled on (group, value).
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        big = rows_at_group_max(df, ["k"], "v", max_groups=2)
        assert sorted(tuple(r) for r in big.collect()) == small
        plan = physical_plan(big, "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    # shuffled on (group, value): a hot group spreads over partitions by value
    key = plan.split("hashpartitioning(k#", 1)[1].split(")), ")[0]
    assert "v#" in key


def test_size_bound_handles_nested_and_null_values(spark):
    from farepath.operators.lookup import size_at_most

    df = spark.createDataFrame([(1, ["a", "bb"], {"k": "v"}, None), (2, None, None, "x")],
                               "id int, tags array<string>, m map<string,string>, s string")
    n, b = size_at_most(df, max_rows=10)
    assert n == 2 and b > 2 * (8 + 8 * 4)
    assert size_at_most(spark.range(0), max_rows=10) == (0, 0)
