"""Relational queries over the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import closure, joins, percentiles, topk
from sparkloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL twin."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


@query("SELECT o_orderkey, o_custkey, round(o_totalprice * 1.1, 4) AS gross FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 AND year(o_orderdate) = 1995")
def filtered_projection(spark, sf_dir):
    wanted = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000) & (F.year("o_orderdate") == 1995)
    return table(spark, sf_dir, "orders").filter(wanted).select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 1.1, 4).alias("gross"))


@query("""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'EUROPE' GROUP BY n_name
""")
def orders_by_nation(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    europe = t("nation").join(t("region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    buyers = t("customer").join(europe, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    sums = t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name")
    return sums.agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey
""")
def left_join(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""
SELECT coalesce(l.source, r.source) AS source, l.n AS labelled, r.n AS unlabelled FROM
 (SELECT source, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY source) l
 FULL JOIN (SELECT source, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) WHERE lang <> 'en' GROUP BY source) r ON l.source = r.source
""")
def full_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    left = docs.filter("lang = 'en'").join(labels, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("labelled"))
    right = docs.filter("lang <> 'en'").join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("unlabelled"))
    return left.join(right, "source", "full").select("source", "labelled", "unlabelled")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""
SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types, min(p_size) AS smallest, max(p_size) AS largest,
       round(stddev_samp(p_retailprice), 6) AS spread, round(var_pop(p_retailprice), 4) AS variance, round(corr(p_size, p_retailprice), 6) AS correlation
FROM part GROUP BY p_brand
""")
def statistics_by_brand(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count("*").alias("n"),
        F.count_distinct("p_type").alias("types"),
        F.min("p_size").alias("smallest"),
        F.max("p_size").alias("largest"),
        F.round(F.stddev_samp("p_retailprice"), 6).alias("spread"),
        F.round(F.var_pop("p_retailprice"), 4).alias("variance"),
        F.round(F.corr("p_size", "p_retailprice"), 6).alias("correlation"),
    )


@query("""
SELECT l_shipmode_year AS ship_year, l_returnflag, l_linestatus, CAST(grouping(l_shipmode_year, l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n
FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipmode_year, l_returnflag, l_linestatus FROM lineitem)
GROUP BY ROLLUP (l_shipmode_year, l_returnflag, l_linestatus)
""")
def rolled_up(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("ship_year"), "l_returnflag", "l_linestatus")
    return rows.rollup("ship_year", "l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cubed(spark, sf_dir):
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf_dir):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupingSets([[status], [priority], []], status, priority).agg(F.count("*").alias("n"))


@query("""
SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS by_priority,
       CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dense, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after,
       first_value(o_orderkey) OVER w AS first_order, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def window_functions(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    by_priority = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.row_number().over(w).alias("place"),
        F.rank().over(by_priority).alias("by_priority"),
        F.dense_rank().over(by_priority).alias("dense"),
        F.lag("o_orderkey").over(w).alias("before"),
        F.lead("o_orderkey").over(w).alias("after"),
        F.first("o_orderkey").over(w).alias("first_order"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"),
    )


@query("""
SELECT user_id, event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS last_day,
       CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS quarter
FROM events
""")
def range_frames(spark, sf_dir):
    seconds = F.col("ts").cast("timestamp").cast("double")
    by_time = Window.partitionBy("user_id").orderBy(seconds)
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.count("*").over(by_time.rangeBetween(-86400, 0)).alias("last_day"),
        F.ntile(4).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("quarter"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""
SELECT c_nationkey, c_custkey, c_acctbal FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3
""")
def top_per_group(spark, sf_dir):
    return topk.top_per_group(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("SELECT o_custkey AS customer FROM orders WHERE o_totalprice > 300000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def union_distinct(spark, sf_dir):
    buyers = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("customer"))
    return buyers.union(table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey")).distinct()


@query("SELECT o_custkey AS customer FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersected(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("customer"))
    return urgent.intersectAll(orders.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE toxic = 0")
def excepted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id"))


@query("""
SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer i WHERE i.c_nationkey = c.c_nationkey)
""")
def correlated_average(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    means = customers.groupBy(F.col("c_nationkey").alias("nation")).agg((F.avg("c_acctbal") * 1.5).alias("bar"))
    return customers.join(means, (F.col("c_nationkey") == F.col("nation")) & (F.col("c_acctbal") > F.col("bar"))).select("c_custkey", "c_acctbal")


@query("""
SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS p
FROM orders GROUP BY o_orderpriority
""")
def pivoted(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return counts.select("o_orderpriority", *(F.coalesce(F.col(s), F.lit(0)).alias(s.lower()) for s in "FOP"))


@query("""
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value), 6) AS mean FROM events GROUP BY event_type
""")
def exact_percentiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = percentiles.exact_percentiles(events, "event_type", "value", (0.5, 0.9))
    of = lambda q: F.round(F.max(F.when(F.col("fraction") == q, F.col("percentile"))), 6)
    means = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return found.groupBy("event_type").agg(of(0.5).alias("median"), of(0.9).alias("p90")).join(means, "event_type")


@query("""
SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND c.c_acctbal BETWEEN s.s_acctbal - 50 AND s.s_acctbal + 50
""")
def banded_join(spark, sf_dir):
    near = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 50).alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return joins.interval_join(near, customers, "low", "high", "c_acctbal", 100, by=["nation"]).select("s_suppkey", "c_custkey")


@query("""
SELECT l.l_orderkey, l.l_linenumber, s.s_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_quantity >= 49
""")
def salted_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("supplier"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), "s_name")
    return joins.salted_join(lines, suppliers, "supplier").drop("supplier")


@query("""
SELECT c_mktsegment, r_name, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_mktsegment, r_name
""")
def sized_join(spark, sf_dir):
    """Quantities by segment and region: each side is sent to all executors, hashed or sorted by what it measures."""
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    nations = joins.sized_join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), regions, ["region"])
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), "c_mktsegment", F.col("c_nationkey").alias("nation"))
    buyers = joins.sized_join(customers, nations, ["nation"]).select("customer", "c_mktsegment", "r_name")
    orders = joins.sized_join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer")), buyers, ["customer"])
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), "l_quantity")
    met = joins.sized_join(lines, orders.select("order", "c_mktsegment", "r_name"), ["order"])
    return met.groupBy("c_mktsegment", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
SELECT e.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts
""")
def asof_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    signups = events.filter("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), "user_id", "ts")
    return joins.asof_join(events.filter("event_type = 'purchase'").drop("event_type"), signups, by=["user_id"], on="ts").select("event_id", "signup_id")


@query("""
SELECT a.event_id, b.event_id AS other_id FROM events a JOIN events b
ON b.ts BETWEEN a.ts AND a.ts + INTERVAL 10 MINUTE AND a.event_type = 'signup' AND b.event_type = 'error'
""")
def range_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "ts", "event_type")
    left = events.filter("event_type = 'signup'").select("event_id", F.col("at").alias("low"), (F.col("at") + 600).alias("high"), F.col("ts").alias("from_ts"))
    right = events.filter("event_type = 'error'").select(F.col("event_id").alias("other_id"), "at", "ts")
    met = joins.interval_join(left, right, "low", "high", "at", 600)
    return met.filter((F.col("ts") >= F.col("from_ts")) & (F.col("ts") <= F.col("from_ts") + F.expr("INTERVAL 10 MINUTES"))).select("event_id", "other_id")


@query("""
WITH RECURSIVE up(customer, above) AS (
  SELECT c_custkey, c_custkey // 10 FROM customer WHERE c_custkey >= 10
  UNION SELECT u.customer, c.c_custkey // 10 FROM up u JOIN customer c ON u.above = c.c_custkey WHERE c.c_custkey >= 10
)
SELECT customer, above FROM up
""")
def recursive_query(spark, sf_dir):
    edges = table(spark, sf_dir, "customer").filter("c_custkey >= 10").select(F.col("c_custkey").alias("a"), F.expr("c_custkey DIV 10").alias("b"))
    return closure.reachable(edges).select(F.col("a").alias("customer"), F.col("b").alias("above"))
