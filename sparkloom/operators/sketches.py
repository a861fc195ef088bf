"""Distinct counts over spans of days: about, from sketches that are kept by day and merged, or exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Registers are 2 ** PRECISION; the standard error of an estimate is about 1.04 / sqrt of that.
PRECISION = 12


def daily_sketches(events: DataFrame, time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(day, *by, sketch): one HyperLogLog sketch of the values of each day; nulls don't count, days without rows have none."""
    return events.groupBy(F.to_date(time).alias("day"), *by).agg(F.hll_sketch_agg(value, F.lit(PRECISION)).alias("sketch"))


def distinct_over_spans(sketches: DataFrame, days: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(last_day, days, *by, estimate): about how many values there were in the `days` up to each day that has a sketch, for each number of days.

    A day's sketch is copied to the spans that it is in, so what is shuffled grows with days and spans
    and not with events; the merge is partial before that.
    """

    def ending(n: int):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.lit(n).alias("days"), F.date_add("day", k).alias("last_day")))

    spans = F.explode(F.flatten(F.array(*map(ending, days))))
    copied = sketches.select("sketch", *by, spans.alias("span")).select("sketch", *by, "span.days", "span.last_day")
    merged = copied.groupBy("last_day", "days", *by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    known = sketches.select(F.col("day").alias("last_day"), *by).distinct()
    return merged.join(known, ["last_day", *by], "left_semi")


def exact_over_spans(events: DataFrame, time: str, value: str, days: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(last_day, days, *by, n): exactly how many values there were in the `days` up to each day that has rows, for each number of days.

    A day on which a value was counts it from that day until the span or the value's next day ends
    that, whichever is earlier; so a value is in one such stretch at a time, and running sums of
    stretches begun less those ended are the numbers. Values are shuffled once by themselves and day,
    once by themselves, and not copied to spans before the sums by day. Nulls don't count, but their
    days have rows; rows without a time have no day.
    """
    dated = events.select(F.to_date(time).alias("day"), *by, F.col(value).alias("value")).filter(F.col("day").isNotNull()).distinct()
    following = F.lead("day").over(Window.partitionBy("value", *by).orderBy("day"))
    stretches = dated.withColumn("gap", F.when(F.col("value").isNotNull(), F.datediff(following, "day")))
    # how many values of a day come again after how many days; null if never
    gaps = stretches.groupBy("day", *by, "gap").agg(F.count("value").alias("n"))
    each = gaps.withColumn("days", F.explode(F.array(*map(F.lit, days))))
    ends = F.date_add("day", F.least("days", F.coalesce("gap", "days")))
    steps = F.explode(F.array(F.struct(F.col("day").alias("at"), F.col("n").alias("step"), F.lit(True).alias("known")), F.struct(ends.alias("at"), (-F.col("n")).alias("step"), F.lit(False).alias("known"))))
    change = each.select("days", *by, steps.alias("s")).groupBy("days", *by, F.col("s.at").alias("last_day")).agg(F.sum("s.step").alias("step"), F.max("s.known").alias("known"))
    running = F.sum("step").over(Window.partitionBy("days", *by).orderBy("last_day"))
    return change.withColumn("n", running).filter("known").select("last_day", "days", *by, "n")
