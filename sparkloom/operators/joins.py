"""Joins that Spark has no keyword for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.shared import written


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str) -> DataFrame:
    """Each left row with the last right row of the same keys whose `on` isn't later; nulls if there is none.

    Both sides are stacked and put in order by ranges of key and `on`, so that a key with many rows
    is in many tasks. Within a range the last right row before a left one is the last non-null value
    of a running window; what a range begins with comes from the last right row of its key in the
    ranges before, a table of one row for each range and key in it. Rows are never multiplied. Of right
    rows with equal `on` the last by their other columns counts. As in SQL, a null matches nothing:
    left rows with a null key or `on` get nulls, right ones are left out. The output has the left
    columns, then the right ones that aren't keys.
    """
    own = [c for c in left.columns if c not in (*by, on)]
    other = [c for c in right.columns if c not in (*by, on)]
    if clash := set(own) & set(other):
        raise ValueError(f"both sides have {sorted(clash)}")
    nested = lambda names: F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(1))
    keys = [F.col(f"`{c}`") for c in by]
    at = F.col(f"`{on}`")
    known = reduce(and_, (c.isNotNull() for c in (*keys, at)))
    shown = [F.struct(*keys).alias("_key"), at.alias("_on")]
    kind = right.select(nested(other)).schema[0].dataType
    lefts = left.select(*shown, F.lit(1).alias("_side"), nested(own).alias("_own"), F.lit(None).cast(kind).alias("_other"), known.alias("_known"))
    rights = right.filter(known).select(*shown, F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_own"].dataType).alias("_own"), nested(other).alias("_other"), F.lit(True).alias("_known"))
    order = ["_key", "_on", "_side", "_other", "_tie"]
    stacked = lefts.unionByName(rights).withColumn("_tie", F.monotonically_increasing_id())
    laid = written(stacked.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # structs compare by their fields, so the largest is the last right row of the range
    lasts = laid.filter("_side = 0").groupBy("_part", "_key").agg(F.max(F.struct("_on", "_other")).alias("_last"))
    parts = laid.select("_part", "_key").distinct().join(lasts, ["_part", "_key"], "left")
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", "_key", F.last("_last", ignorenulls=True).over(before)["_other"].alias("_carried"))
    within = Window.partitionBy("_part", "_key").orderBy("_on", "_side", "_other").rowsBetween(Window.unboundedPreceding, 0)
    met = laid.join(carried, ["_part", "_key"], "left").withColumn("_met", F.coalesce(F.last("_other", ignorenulls=True).over(within), "_carried"))
    found = met.filter("_side = 1").withColumn("_met", F.when(F.col("_known"), F.col("_met")))
    return found.select(
        *(F.col("_key")[c].alias(c) for c in by), F.col("_on").alias(on),
        *(F.col("_own")[c].alias(c) for c in own), *(F.col("_met")[c].alias(c) for c in other),
    )


#: A node that holds all bins is copied so often that its points are in as many tasks.
COPIES = 32


def interval_join(left: DataFrame, right: DataFrame, low: str, high: str, point: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Left rows with the right rows of the same keys whose number `point` is in [low, high].

    Points fall into bins of `width`, bins into pairs, pairs of pairs and so on. An interval's bins
    are the union of at most two such nodes of each size, so a left row is repeated a logarithmic
    number of times whatever its width; a point is repeated for the sizes that intervals have, and
    the join is an equality of keys, size and node. Sizes of which there are few nodes are dealt out
    in copies, at most COPIES of a node. Intervals are first cut to the range of all points, so their
    bounds may be infinite. Rows with a null key, bound or point, or with NaN, match nothing. The
    largest point must be less than 2**62 widths away from the smallest.
    """
    lo, hi, at = F.col(f"`{low}`"), F.col(f"`{high}`"), F.col(f"`{point}`")
    real = lambda c, df, name: ~F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else F.lit(True)
    points = right.filter(at.isNotNull() & real(at, right, point))
    least, most = points.agg(F.min(at), F.max(at)).first()
    if least is None:
        least = most = 0
    bin_of = lambda c: F.floor((c - F.lit(least)) / width).cast("long")
    last = int((most - least) // width) + 1
    cut = left.filter((hi >= lo) & (lo <= F.lit(most)) & (hi >= F.lit(least)) & real(lo, left, low) & real(hi, left, high))
    cut = cut.withColumn("_a", bin_of(F.greatest(lo, F.lit(least)))).withColumn("_b", bin_of(F.least(hi, F.lit(most))) + 1)  # bins [_a, _b)
    ceiling, floor = lambda k: -F.call_function("shiftright", -F.col("_a"), k), lambda k: F.call_function("shiftright", F.col("_b"), k)

    def nodes(k):
        """The nodes of size 2**k in an interval's union: the first if odd, the last if even, as larger ones hold the others."""
        a, b = ceiling(k), floor(k)
        one = lambda index: F.struct(k.alias("size"), index.alias("index"))
        return F.when(a < b, F.array_compact(F.array(F.when(a % 2 == 1, one(a)), F.when(b % 2 == 1, one(b - 1))))).otherwise(F.array().cast("array<struct<size: int, index: bigint>>"))

    sizes = F.sequence(F.lit(0), F.floor(F.log2((F.col("_b") - F.col("_a")).cast("double"))).cast("int"))
    copies = F.ceil(F.lit(COPIES) / F.ceil(F.lit(last) / F.pow(F.lit(2.0), F.col("_node.size")))).cast("int")
    spread = cut.withColumn("_node", F.explode(F.flatten(F.transform(sizes, nodes)))).drop("_a", "_b")
    used = sorted(r[0] for r in spread.select("_node.size").distinct().collect())  # at most 63
    spread = spread.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    placed = points.withColumn("_size", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_node", F.struct(F.col("_size").alias("size"), F.call_function("shiftright", bin_of(at), F.col("_size")).alias("index")))
    placed = placed.withColumn("_copy", F.pmod(F.xxhash64(at, *(F.col(f"`{c}`") for c in right.columns)), copies).cast("int")).drop("_size")
    return spread.join(placed, [*by, "_node", "_copy"]).filter((at >= lo) & (at <= hi)).drop("_node", "_copy")


def heavy_keys(df: DataFrame, on: str, share: float, tracked: int = 1000) -> dict:
    """The keys that have at least `share` of the rows, each with about how many: one pass with a sketch of frequent items.

    The sketch holds `tracked` items, which is enough for every key of more than 1 / tracked of the
    rows; its counts may be too high by as much.
    """
    if share * tracked < 2:
        raise ValueError("the sketch is too small for this share")
    key = F.col(f"`{on}`")
    n, found = df.agg(F.count(key), F.expr(f"approx_top_k(`{on}`, {int(2 / share)}, {tracked})")).first()
    return {r[0]: r[1] for r in found or () if r[0] is not None and r[1] >= share * n}


def heavy_key_join(large: DataFrame, small: DataFrame, on: str, how: str = "inner", share: float = 0.01, salts: int = 64) -> DataFrame:
    """An equality join in which keys with at least `share` of the large side's rows, and they alone, are spread over tasks.

    A heavy key gets salts in proportion to its rows, `salts` if it had all of them, and only its rows
    of `small` are copied as often. A row's salt is a hash of the row, so a task that runs again deals
    its rows as before. Null keys match nothing and are spread over all salts. `small` comes without
    copies if no key is heavy. Of Spark's sketch, keys must be numbers, strings, dates or times.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep rows of the large side can be salted")
    key, total = F.col(f"`{on}`"), max(1, large.count())
    found = {k: max(2, -(-salts * n // total)) for k, n in heavy_keys(large, on, share).items()}
    kind = dict(large.dtypes)[on]
    table = F.create_map(*(F.lit(x) for pair in found.items() for x in pair)).cast(f"map<{kind}, int>") if found else None
    of_key = F.coalesce(F.try_element_at(table, key.cast(kind)), F.lit(1)) if found else F.lit(1)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in large.columns))
    spread = large.withColumn("_salt", F.pmod(row, F.when(key.isNull(), F.lit(salts)).otherwise(of_key)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), of_key - 1)))
    return spread.join(repeated, [on, "_salt"], how).drop("_salt")


def size_in_memory(df: DataFrame) -> int:
    """About how many bytes the rows take once read: one pass that sums the lengths of texts and eight bytes for any other value.

    Nested values count as their JSON text, which is longer than they are in memory for most types.
    """

    def width(field):
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary", "char", "varchar"):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
        if kind in ("array", "map", "struct"):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("long") + 16
        return F.lit(8).cast("long")

    widths = [width(f) for f in df.schema.fields]
    return int(df.agg(F.sum(sum(widths[1:], widths[0]) if widths else F.lit(0))).first()[0] or 0)


def sized_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", most_broadcast: int = 64 << 20, most_hashed: int = 256 << 20) -> DataFrame:
    """An equality join whose strategy follows from the measured size of `right`, which is read once more for it.

    Up to `most_broadcast` bytes it is sent to every executor. Beyond that both sides are shuffled:
    `right` is built into hash tables if a partition of it is `most_hashed` bytes on average at
    most, else both are sorted, which may spill and so has no limit. Joins that must put out rows of
    `right` without a partner can't send it whole and are shuffled at any size. Hash tables expect keys
    about equally frequent in `right`; for frequent ones take `heavy_key_join`. Null keys match nothing.
    """
    size = size_in_memory(right)
    if size <= most_broadcast and how not in ("right", "full", "outer", "right_outer", "full_outer"):
        strategy = "broadcast"
    elif size <= most_hashed * int(right.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        strategy = "shuffle_hash"
    else:
        strategy = "merge"
    return left.join(right.hint(strategy), list(on), how)


def salted_join(large: DataFrame, small: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equality join in which each key of `large` is spread over `salts` tasks, and `small` repeated as often.

    A row's salt is a hash of the row, so a task that runs again deals its rows as before.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep rows of the large side can be salted")
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [on, "_salt"], how).drop("_salt")
