"""Operators on small tables: nulls, ties, repeats, empty tables, cycles."""

import datetime as dt
import random
from collections import Counter

import duck
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import sessions
from sparkloom.operators import closure, joins, percentiles, sketches
from sparkloom.sources import layouts

LEFT = [("a", 5, 1), ("a", 1, 2), (None, 5, 3), ("a", None, 4), ("b", 9, 5), ("a", 5, 1)]
RIGHT = [("a", 3, "x"), ("a", 5, "y"), (None, 4, "z"), ("a", None, "u"), ("a", 5, "w")]


def test_asof_join_matches_no_nulls(spark):
    left = spark.createDataFrame(LEFT, "k string, at int, n int")
    right = spark.createDataFrame(RIGHT, "k string, at int, v string")
    got = sorted((r.n, r.v) for r in joins.asof_join(left, right, ["k"], "at").collect())
    assert got == [(1, "y"), (1, "y"), (2, None), (3, None), (4, None), (5, None)]
    assert joins.asof_join(left.limit(0), right, ["k"], "at").count() == 0
    assert [r.v for r in joins.asof_join(left, right.limit(0), ["k"], "at").collect()] == [None] * 6


def test_interval_join_is_closed(spark):
    left = spark.createDataFrame([(1, -5.0, 5.0, "k"), (2, 5.0, 5.0, "k"), (3, 9.0, 1.0, "k"), (4, None, 5.0, "k"), (5, 0.0, 99.0, None)], "n int, low double, high double, k string")
    right = spark.createDataFrame([(-5.0, "k"), (5.0, "k"), (5.0, "other"), (None, "k"), (5.0, None)], "x double, k string")
    got = Counter((r.n, r.x) for r in joins.interval_join(left, right, "low", "high", "x", 3, by=["k"]).collect())
    assert got == Counter([(1, -5.0), (1, 5.0), (2, 5.0)])


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    large = spark.range(300).selectExpr("if(id < 200, 7L, id % 20) AS k", "id % 50 AS v").unionByName(spark.sql("SELECT cast(null AS long) k, 1L v"))
    small = spark.range(0, 20, 3).selectExpr("id AS k", "id * 2 AS w")
    assert Counter(map(tuple, joins.salted_join(large, small, "k", 5, how).collect())) == Counter(map(tuple, large.join(small, "k", how).collect()))


def test_percentiles_of_one_large_group_and_small_ones(spark):
    rng = random.Random(4)
    rows = [("hot", float(rng.randrange(50))) for _ in range(3000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 4.0), ("none", None)]
    got = {(r.k, r.fraction): r.percentile for r in percentiles.exact_percentiles(spark.createDataFrame(rows, "k string, x double").repartition(7), "k", "x", (0.0, 0.5, 0.9, 1.0)).collect()}
    hot = sorted(x for k, x in rows if k == "hot")
    at = lambda q: hot[int(q * 2999)] + (q * 2999 - int(q * 2999)) * (hot[min(2999, int(q * 2999) + 1)] - hot[int(q * 2999)])
    assert {q: got["hot", q] for q in (0.0, 0.5, 0.9, 1.0)} == pytest.approx({q: at(q) for q in (0.0, 0.5, 0.9, 1.0)})
    assert (got["one", 0.5], got["two", 0.5], got["two", 0.9], got[None, 1.0]) == pytest.approx((3.0, 1.5, 1.9, 4.0))
    assert not any(k == "none" for k, _ in got)


def test_closure_goes_on_to_the_end_of_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(12)] + [(20, 21), (21, 22), (22, 20), (None, 1), (5, None), (0, 1)]
    got = {(r.a, r.b) for r in closure.reachable(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {(i, j) for i in range(12) for j in range(i + 1, 13)} | {(i, j) for i in (20, 21, 22) for j in (20, 21, 22)}
    assert closure.reachable(spark.createDataFrame([], "a int, b int")).count() == 0


def test_no_table_of_the_driver_is_left_behind(spark):
    assert not spark.catalog.listTables()
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_asof_join_of_one_hot_key_over_many_ranges(spark):
    rng = random.Random(7)
    left = [("hot" if k % 5 else "b", rng.randrange(4000), k) for k in range(2000)] + [(None, 5, -1), ("c", 1, -2)]
    right = [("hot" if k % 3 else "b", rng.randrange(4000), k) for k in range(300)]
    df = joins.asof_join(spark.createDataFrame(left, "`a.k` string, at int, n int"), spark.createDataFrame(right, "`a.k` string, at int, v int"), ["a.k"], "at")
    best = lambda k, at: max(((a, v) for r, a, v in right if r == k and a <= at), default=(0, None))[1]
    assert sorted((r.n, r.v if r.v is not None else -1) for r in df.collect()) == sorted((n, v if (v := best(k, at)) is not None else -1) for k, at, n in left)


def test_asof_join_carries_over_ranges_without_right_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    left = spark.range(5000).selectExpr("'k' AS k", "cast(id AS int) AS at", "id AS n")
    right = spark.createDataFrame([("k", 3, "x"), ("k", 2600, "y")], "k string, at int, v string")
    got = {(r.v, r.lo, r.hi) for r in joins.asof_join(left, right, ["k"], "at").groupBy("v").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(None, 0, 2), ("x", 3, 2599), ("y", 2600, 4999)}


def test_interval_join_of_widths_from_points_to_the_whole_domain(spark):
    rng = random.Random(3)
    left = [(k, (a := rng.uniform(-500, 500)), a + 10 ** rng.uniform(-3, 3)) for k in range(300)] + [(900, float("-inf"), float("inf")), (901, float("nan"), 3.0), (902, 7e8, 8e8)]
    right = [(k, rng.uniform(-600, 600)) for k in range(400)] + [(500, -500.0), (501, float("nan"))]
    lefts, rights = spark.createDataFrame(left, "n int, low double, high double"), spark.createDataFrame(right, "m int, x double")
    got = Counter((r.n, r.m) for r in joins.interval_join(lefts, rights, "low", "high", "x", 0.5).collect())
    assert got == Counter((n, m) for n, a, b in left for m, x in right if a <= x <= b and n != 901)
    assert joins.interval_join(lefts, rights.limit(0), "low", "high", "x", 0.5).count() == 0
    assert joins.interval_join(lefts.limit(0), rights, "low", "high", "x", 0.5).count() == 0


def test_an_interval_over_all_bins_costs_tens_of_rows(spark):
    left = spark.createDataFrame([(1, 3, 999_990)], "n int, low long, high long")
    df = joins.interval_join(left, spark.range(0, 1_000_000, 100).withColumnRenamed("id", "x"), "low", "high", "x", 1)
    assert df.count() == 9_999
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_key_join_is_the_plain_join(spark, how):
    large = spark.range(3000).selectExpr("if(id < 1500, 'k7', concat('k', id % 400)) AS k", "id AS v").unionByName(spark.sql("SELECT cast(null AS string) k, explode(sequence(1, 500)) v"))
    small = spark.range(0, 420, 7).selectExpr("concat('k', id) AS k", "id * 2 AS w").unionByName(spark.sql("SELECT cast(null AS string) k, 1L w"))
    assert Counter(map(tuple, joins.heavy_key_join(large, small, "k", how, share=0.05).collect())) == Counter(map(tuple, large.join(small, "k", how).collect()))
    assert set(joins.heavy_keys(large, "k", 0.05)) == {"k7"}


def test_heavy_key_join_without_heavy_keys_or_rows(spark):
    flat, small = spark.range(5000).toDF("k"), spark.range(0, 5000, 9).selectExpr("id AS k", "id AS w")
    assert joins.heavy_keys(flat, "k", 0.01) == {} and joins.heavy_key_join(flat, small, "k").count() == small.count()
    assert joins.heavy_key_join(flat.limit(0), small, "k").count() == 0


def test_sketches_of_days_give_spans_within_their_error(spark):
    rows = spark.range(400_000).selectExpr("timestamp '2024-01-01' + make_dt_interval(cast(id % 20 AS int)) AS ts", "xxhash64(id) % 60000 AS user")
    daily = sketches.daily_sketches(rows.unionByName(spark.sql("SELECT timestamp '2024-01-03' ts, cast(null AS bigint) user")), "ts", "user")
    got = {(str(r.last_day), r.days): r.estimate for r in sketches.distinct_over_spans(daily, (1, 5, 20)).collect()}
    assert len(got) == 60
    days = [(f"2024-01-{d + 1:02}", d) for d in range(20)]
    exact = {d: {r.user for r in rows.filter(F.dayofmonth("ts") == d + 1).distinct().collect()} for _, d in days[:6]}
    errors = [got[name, n] / len(set().union(*(exact[x] for x in range(max(0, d - n + 1), d + 1)))) - 1 for name, d in days[:6] for n in (1, 5, 20)]
    assert max(map(abs, errors)) < 4 * 1.04 / 2 ** (sketches.PRECISION / 2)


def test_users_over_spans_are_exact_where_sketches_are_not(spark, tmp_path):
    from sparkloom.plans import layouts as plans

    at = "timestamp_ntz '2024-02-25 13:00:00' + make_dt_interval(cast(xxhash64(id, 1L) % 20 * 3 AS int), cast(id % 24 - 13 AS int))"
    many = spark.range(120_000).selectExpr(f"{at} AS ts", "pmod(xxhash64(id), 30000) AS user_id")
    odd = spark.sql("SELECT timestamp_ntz '2025-01-01 00:00:00' ts, cast(null AS bigint) user_id UNION ALL SELECT null, 7 UNION ALL SELECT timestamp_ntz '2025-01-02 23:59:59.999999', 7 UNION ALL SELECT timestamp_ntz '2025-01-02 00:00:00', null")
    many.unionByName(odd).write.parquet(f"{tmp_path}/events.parquet")
    con = duck.connection(tmp_path)
    duck.agree(plans.distinct_over_spans(spark, str(tmp_path)), plans.ORACLE["distinct_over_spans"], con)
    rows = {(str(r.last_day), r.days): r.users for r in plans.distinct_over_spans(spark, str(tmp_path)).collect()}
    assert rows["2025-01-01", 30] == 0 and rows["2025-01-02", 7] == 1 and max(rows.values()) > 15_000


def test_partitions_are_pruned_and_buckets_join_without_a_shuffle(spark):
    rows = spark.range(2000).selectExpr("id", "id % 7 AS `part`", "id * 2 AS v")
    one = layouts.partitioned(rows, "part").filter("part = 3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and one.count() == 286
    a, b = layouts.bucketed(rows, 4, ["id"]), layouts.bucketed(rows.selectExpr("id AS k", "v AS w"), 4, ["k"])
    met = a.join(b.hint("merge"), F.col("id") == F.col("k"))
    assert met.count() == 2000
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_table_function_of_nulls_ties_and_open_runs(spark):
    at = lambda m: None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(m), v, "x") for m, v in ((0, 1.0), (0, None), (30, 2.0), (61, None), (None, 9.0))] + [(None, at(5), 3.0, "y"), ("b", None, 1.0, "z")]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double, extra string").repartition(3)
    got = sorted(map(tuple, sessions.SessionsOf(df.asTable(), F.lit("k"), F.lit("t"), F.lit("v"), F.lit(1800)).collect()), key=repr)
    assert got == [("a", at(0), at(30), 3, 2.0), ("a", at(61), at(61), 1, None), (None, at(5), at(5), 1, 3.0)]
    assert sessions.SessionsOf(df.limit(0).asTable(), F.lit("k"), F.lit("t"), F.lit("v"), F.lit(1800)).count() == 0
    with pytest.raises(Exception, match="no"):
        sessions.SessionsOf(df.asTable(), F.lit("nothing"), F.lit("t"), F.lit("v"), F.lit(1800)).count()


@pytest.mark.parametrize("limits, node", [((1 << 20, 1 << 20), "BroadcastHashJoin"), ((0, 1 << 20), "ShuffledHashJoin"), ((0, 0), "SortMergeJoin")])
def test_the_measured_size_decides_how_a_join_runs(spark, limits, node):
    left = spark.createDataFrame([(k % 40 if k % 9 else None, k) for k in range(500)], "k int, a int")
    right = spark.createDataFrame([(k, f"text {k}") for k in range(10, 60)] + [(None, "none"), (12, "again")], "k int, b string")
    assert 52 * 24 < joins.size_in_memory(right) < 52 * 40
    for how in ("inner", "left", "left_semi", "left_anti", "full"):
        met, plain = joins.sized_join(left, right, ["k"], how, *limits), left.join(right, ["k"], how)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert node in plan or (how == "full" and "ShuffledHashJoin" in plan)
        assert sorted(map(repr, met.collect())) == sorted(map(repr, plain.collect()))
    assert joins.size_in_memory(right.limit(0)) == 0
