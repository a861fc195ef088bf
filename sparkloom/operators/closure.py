"""Pairs that repeated joins reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import written


def reachable(edges: DataFrame) -> DataFrame:
    """(a, b): every b that one or more edges (a, b) lead to from a.

    Each round extends the pairs found last by one edge and keeps the new ones, until there are
    none; so it ends on cycles too, and after as many rounds as the longest shortest way has edges.
    """
    steps = edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct()
    known = latest = written(steps)
    onward = known.select(F.col("a").alias("b"), F.col("b").alias("next"))
    while True:
        further = latest.join(onward, "b").select("a", F.col("next").alias("b")).distinct()
        latest = written(further.join(known, ["a", "b"], "left_anti"))
        if latest.isEmpty():
            return known
        known = known.unionByName(latest)
