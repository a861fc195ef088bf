"""Queries of scalar, array and map functions, batch windows, further joins and sets, files and Python functions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.files import round_trip
from sparkloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return put


# --- scalar functions --------------------------------------------------------------------------


@query("""
SELECT doc_id, upper(lang) AS lang, CAST(length(text) AS BIGINT) AS chars, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, substring(text, 1, 12) AS opening, md5(text) AS digest,
       CAST(position('.' IN text) AS BIGINT) AS first_stop, trim(replace(source, '.', ' ')) AS site, reverse(lang) AS backwards, lpad(lang, 4, '_') AS padded
FROM documents
""")
def string_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.upper("lang").alias("lang"),
        F.length("text").cast("long").alias("chars"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.substring("text", 1, 12).alias("opening"),
        F.md5(F.col("text").cast("binary")).alias("digest"),
        F.instr("text", ".").cast("long").alias("first_stop"),
        F.trim(F.replace(F.col("source"), F.lit("."), F.lit(" "))).alias("site"),
        F.reverse("lang").alias("backwards"),
        F.lpad("lang", 4, "_").alias("padded"),
    )


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS BIGINT) AS words, regexp_extract(text, '([0-9]+)', 1) AS number,
       regexp_replace(substring(text, 1, 40), '[aeiou]', '*', 'g') AS masked, regexp_matches(text, 'https?://') AS has_link
FROM documents
""")
def regular_expressions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.regexp_count("text", F.lit("[A-Za-z]+")).cast("long").alias("words"),
        F.regexp_extract("text", "([0-9]+)", 1).alias("number"),
        F.regexp_replace(F.substring("text", 1, 40), "[aeiou]", "*").alias("masked"),
        F.rlike("text", F.lit("https?://")).alias("has_link"),
    )


@query("""
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
       CAST(isodow(o_orderdate) AS INTEGER) AS weekday, CAST(o_orderdate + INTERVAL 90 DAY AS TIMESTAMP) AS due, CAST(date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') AS INTEGER) AS age,
       strftime(o_orderdate, '%Y-%m-%d') AS shown, CAST(last_day(o_orderdate) AS DATE) AS month_end
FROM orders
""")
def date_functions(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_trunc("month", at).cast("timestamp_ntz").alias("month"),
        F.year(at).alias("year"),
        F.quarter(at).alias("quarter"),
        (F.weekday(at) + 1).alias("weekday"),
        (at + F.expr("INTERVAL 90 DAYS")).alias("due"),
        F.date_diff(F.lit("1999-01-01").cast("date"), at.cast("date")).alias("age"),
        F.date_format(at, "yyyy-MM-dd").alias("shown"),
        F.last_day(at.cast("date")).alias("month_end"),
    )


@query("""
SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2
""")
def json_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_quantity AS DECIMAL(18, 2)), 2) AS DOUBLE) AS exact,
       CAST(abs(CAST(l_discount * 100 AS INTEGER) - 5) AS INTEGER) AS off, CAST(greatest(l_tax, l_discount) AS DOUBLE) AS more, coalesce(nullif(l_returnflag, 'N'), '-') AS flag,
       CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 40 THEN 'middle' ELSE 'large' END AS class
FROM lineitem
""")
def numbers_and_cases(spark, sf_dir):
    decimal = lambda c: F.col(c).cast("decimal(18,2)")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(decimal("l_extendedprice") * decimal("l_quantity"), 2).cast("double").alias("exact"),
        F.abs(F.round(F.col("l_discount") * 100).cast("int") - 5).alias("off"),
        F.greatest("l_tax", "l_discount").alias("more"),
        F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("-")).alias("flag"),
        F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 40, "middle").otherwise("large").alias("class"),
    )


# --- arrays and maps -----------------------------------------------------------------------------


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS square, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive,
       CAST(list_max(embedding) AS DOUBLE) AS most, CAST(embedding[1] AS DOUBLE) AS first, CAST(len(list_distinct(list_transform(embedding, lambda x: CAST(floor(x * 4) AS INTEGER)))) AS BIGINT) AS cells
FROM embeddings
""")
def array_functions(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("square"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.array_max(e).cast("double").alias("most"),
        F.element_at(e, 1).cast("double").alias("first"),
        F.size(F.array_distinct(F.transform(e, lambda x: F.floor(x * 4)))).cast("long").alias("cells"),
    )


@query("""
SELECT word, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word
""")
def exploded_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''")
    # counted by document first, so that each task sums what it has before the words are dealt
    by_document = words.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return by_document.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


@query("""
SELECT user_id, CAST(coalesce(sum(1) FILTER (event_type = 'click'), 0) AS BIGINT) AS clicks, CAST(count(DISTINCT event_type) AS BIGINT) AS types,
       string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY user_id
""")
def map_functions(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # a map has at most one entry for each type
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select(
        "user_id",
        F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"),
        F.size(F.map_keys("m")).cast("long").alias("types"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"),
    )


# --- joins, sets, aggregates, windows ------------------------------------------------------------


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey AND o_totalprice > 250000")
def right_join(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 250000").select("o_orderkey", "o_custkey")
    return large.join(table(spark, sf_dir, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@query("SELECT lang AS name, source FROM documents UNION ALL SELECT event_type, CAST(user_id AS VARCHAR) FROM events")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("name"), "source").union(table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string")))


@query("SELECT o_custkey AS customer FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("customer")).exceptAll(orders.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
def approximate_distinct(spark, sf_dir):
    """Whether the estimate is within a tenth of the exact number."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.count_distinct("l_partkey").alias("exact"))
    return counts.select("l_returnflag", (F.abs(F.col("about") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("""
SELECT c_custkey, round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS reached, last_value(c_custkey) OVER f AS poorest, nth_value(c_custkey, 2) OVER f AS second
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), f AS (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def distribution_windows(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.round(F.percent_rank().over(w), 9).alias("share"),
        F.round(F.cume_dist().over(w), 9).alias("reached"),
        F.last("c_custkey").over(whole).alias("poorest"),
        F.nth_value("c_custkey", 2).over(whole).alias("second"),
    )


@query("""
SELECT event_type, start, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start FROM events) GROUP BY event_type, start
""")
def tumbling_windows(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


@query("""
SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) - to_hours(k) AS start FROM events, unnest([0, 1, 2]) AS u(k)) GROUP BY start
""")
def sliding_windows(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH marked AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM marked)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM numbered GROUP BY user_id, k
""")
def session_windows(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


# --- files -----------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "csv", header=True, escape='"')


@query("SELECT event_id, ts, user_id, props FROM events")
def json_round_trip(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "props"), "json", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@query("SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS second, label FROM embeddings")
def orc_round_trip(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "embeddings"), "orc").select("vec_id", F.element_at("embedding", 2).cast("double").alias("second"), "label")


@query("SELECT source FROM documents WHERE source <> ''")
def text_round_trip(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents").filter("source <> ''").select("source"), "text").withColumnRenamed("value", "source")


# --- Python functions ------------------------------------------------------------------------------


@query("SELECT p_partkey, round(p_retailprice * (1 + p_size / 100.0), 6) AS price FROM part")
def pandas_scalar(spark, sf_dir):
    @F.pandas_udf("double")
    def priced(price: pd.Series, size: pd.Series) -> pd.Series:
        return price * (1 + size / 100.0)

    return table(spark, sf_dir, "part").select("p_partkey", F.round(priced("p_retailprice", "p_size"), 6).alias("price"))


@query("SELECT doc_id, CAST(len(text) AS BIGINT) AS chars FROM documents")
def arrow_scalar(spark, sf_dir):
    @F.arrow_udf("long")
    def chars(text: pa.Array) -> pa.Array:
        return pc.utf8_length(text).cast(pa.int64())

    return table(spark, sf_dir, "documents").select("doc_id", chars("text").alias("chars"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def arrow_batches(spark, sf_dir):
    """Sums of each batch, added up: a task sends one row for each group and batch."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.Table.from_batches([batch]).group_by(["l_returnflag", "l_linestatus"]).aggregate([("l_quantity", "count"), ("l_quantity", "sum")])
            yield from groups.select(["l_returnflag", "l_linestatus", "l_quantity_count", "l_quantity_sum"]).to_batches()

    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    parts = lines.mapInArrow(summed, "l_returnflag string, l_linestatus string, l_quantity_count long, l_quantity_sum double")
    return parts.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity_count").alias("n"), F.round(F.sum("l_quantity_sum"), 2).alias("quantity"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events")
def grouped_pandas(spark, sf_dir):
    """A user's events are one group in a task: right for users, whose events are few, not for keys of any size."""

    def smoothed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        return pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "smooth": rows["value"].rolling(5, min_periods=1).mean().round(6)})

    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandas(smoothed, "user_id long, event_id long, smooth double")


#: Of a group, about as many rows at most go through Python at once.
PART_ROWS = 100_000


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 6) AS reach FROM customer GROUP BY c_nationkey")
def pandas_aggregate(spark, sf_dir):
    """A group goes through Python in parts of about PART_ROWS rows, and the parts' results once more: no task holds a whole group."""

    @F.pandas_udf("double")
    def highest(x: pd.Series) -> float:
        return float(x.max())

    @F.pandas_udf("double")
    def lowest(x: pd.Series) -> float:
        return float(x.min())

    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_custkey")
    parts = -(-customers.count() // PART_ROWS) or 1
    dealt = customers.withColumn("part", F.pmod(F.xxhash64("c_custkey"), F.lit(parts)))
    known = lambda c: F.when(~F.isnan(c), F.col(c))  # noqa: E731  (a part of nulls alone gives NaN)
    of_parts = dealt.groupBy("c_nationkey", "part").agg(highest("c_acctbal").alias("high"), lowest("c_acctbal").alias("low"))
    return of_parts.groupBy("c_nationkey").agg(F.round(F.max(known("high")) - F.min(known("low")), 6).alias("reach"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS line, lines[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i)")
def table_function(spark, sf_dir):
    @F.udtf(returnType="line int, text string")
    class Lines:
        def eval(self, text: str):
            yield from enumerate((text or "").split("\n"), 1)

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    return docs.lateralJoin(Lines(F.col("whole").outer())).select("doc_id", "line", "text")
