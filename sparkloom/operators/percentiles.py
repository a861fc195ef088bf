"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import written


def exact_percentiles(df: DataFrame, by: str, value: str, fractions: Sequence[float]) -> DataFrame:
    """(by, fraction, percentile): the interpolated percentiles of the non-null values of each group.

    Rows are dealt by ranges of group and value and put in order within their range. Counts of each
    range's rows tell where its ranks begin, so a rank is found where it lies, and no group meets in
    one task. An empty group has none; nulls of `by` are a group.
    """
    ranges = written(df.select(by, value).filter(F.col(value).isNotNull()).repartitionByRange(by, value).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy(by, "_range").agg(F.count("*").alias("_n"), F.min(value).alias("_least"))
    # one row for each group and range
    before = Window.partitionBy(by).orderBy("_least", "_range")
    placed = counts.withColumn("_before", F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(Window.partitionBy(by)))
    wanted = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("fraction"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("at")) for q in fractions)))
    asked = placed.select(F.col(by).alias("_by"), F.col("_range").alias("_in"), F.coalesce("_before", F.lit(0)).alias("_before"), "_n", wanted.alias("_q"))
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("_q.at"), F.ceil("_q.at")))).alias("_rank"))
    asked = asked.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
    in_range = Window.partitionBy(by, "_range").orderBy(value)
    ranked = ranges.withColumn("_row", F.row_number().over(in_range) - 1)
    met = ranked.join(asked, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_in")) & (F.col("_row") == F.col("_rank") - F.col("_before")))
    share = F.when(F.col("_rank") == F.floor("_q.at"), 1 - (F.col("_q.at") - F.floor("_q.at"))).otherwise(F.col("_q.at") - F.floor("_q.at"))
    return met.groupBy(by, F.col("_q.fraction").alias("fraction")).agg(F.sum(F.col(value) * share).alias("percentile"))
