"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document falls, by a hash, into one of its source's blocks; a source has about one block
   for each `block_words` words, so a block's documents are a random draw of the source. All sources
   have about BLOCKS of them, more where blocks would exceed MOST_BLOCK words.
2. A source's quota of words is met by whole blocks in a hashed order, first pass before second; the
   block in which the quota ends is taken up to the document, and to the word, that ends it.
3. The blocks taken are the quotas of a tree over the output shards: at every node the number that
   goes left is fixed, and how many of them come from each source is one multivariate-hypergeometric
   draw. A leaf's quotas name disjoint runs of each source's hashed block order; what the mix takes
   is what the leaves have drawn.
4. Within a shard the documents are shuffled by a hash; `laid_out` puts the rows where that says.

Work on documents never gathers a source: sums are combined before the shuffle, only block totals
are put in order, and only the blocks in which a quota ends are looked at document by document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, written


#: About how many blocks all sources have, a block's fewest and most words, and a shard's blocks.
BLOCKS, LEAST_BLOCK, MOST_BLOCK, SHARD_BLOCKS = 512, 1 << 10, 1 << 20, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, multiple: float, cap: float, weights: Sequence[int]) -> DataFrame:
    """From (source, source_size), one row each: the same with `target`.

    Sources by code point, null last, take the weights in turn. Together they get `multiple` times
    all sizes, shared by weight; no source gets over `cap` times its size, and what is cut off is
    shared again. That has one solution, min(cap * size, level * weight): with the sources by
    ascending cap * size / weight, the level follows from the first one that isn't cut.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    left = F.lit(multiple) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / share)
    level = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return level.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard's quotas: at a node with n shards and b blocks, floor(b * (n // 2) / n) blocks go left."""
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        first, n, left_to_deal = stack.pop()
        if n == 1:
            yield first, left_to_deal
            continue
        half = n // 2
        draw = np.random.default_rng([seed, first, n])
        to_left = draw.multivariate_hypergeometric(left_to_deal, int(left_to_deal.sum()) * half // n, method="marginals")
        stack.append((first + half, n - half, left_to_deal - to_left))
        stack.append((first, half, to_left))


def block_plan(sized: DataFrame, multiple: float, cap: float, weights: Sequence[int], block_words: int | None, shard_words: int | None, seed: int) -> DataFrame:
    """From (doc_id, source, size): per source and block its words, the words taken in each pass, and the shards they go to."""
    if cap > 2:
        raise ValueError("a document is taken in two passes at most")
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block_words = block_words or min(MOST_BLOCK, max(LEAST_BLOCK, int(total) // BLOCKS))
    shard_words = shard_words or SHARD_BLOCKS * block_words
    targets = source_targets(sizes, multiple, cap, weights).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    targets = written(targets)
    in_blocks = with_blocks(sized, targets, seed)
    blocks = in_blocks.groupBy("source", "block").agg(F.sum("size").alias("words"))
    facts = targets.withColumnRenamed("source", "of")
    units = (
        blocks.join(facts, F.col("source").eqNullSafe(F.col("of")))
        .drop("of")
        .withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("order", F.xxhash64("block", "pass", F.lit(seed)))
    )
    in_order = Window.partitionBy("source").orderBy("pass", "order", "block")
    done = F.coalesce(F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = units.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("words"), F.round("target").cast("long") - done)))
    units = units.withColumn("turn", F.row_number().over(in_order) - 1).drop("order")
    units = written(units)

    schema = "source string, turn int, shard int"
    quotas = units.filter("taken > 0").groupBy("source").agg(F.count("*").alias("quota"), F.sum("taken").alias("words"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        table = pd.concat(held)
        table = table.assign(none=table["source"].isna()).sort_values(["none", "source"])
        shards = max(1, -(-int(table["words"].sum()) // shard_words))
        at = np.zeros(len(table), np.int64)
        names = table["source"].to_numpy(object)
        for shard, quota in splitting_tree(table["quota"].to_numpy(), shards, seed):
            row = np.repeat(np.arange(len(table)), quota)
            turn = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(quota) - quota, quota)
            at += quota
            yield pd.DataFrame({"source": names[row], "turn": turn.astype(np.int32), "shard": np.full(len(row), shard, np.int32)})

    # One row per source goes into the tree, one row per block comes out of it.
    shards = quotas.coalesce(1).mapInPandas(deal, schema).withColumnsRenamed({"source": "of", "turn": "at"})
    # A source's taken blocks are the first ones of its order, so `turn` counts them without gaps.
    placed = units.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("turn") == F.col("at")), "left")
    # what no shard has drawn isn't in the mix
    each = F.struct("pass", F.when(F.col("shard").isNotNull(), F.col("taken")).otherwise(0).cast("long").alias("taken"), "shard")
    return placed.groupBy("source", "block", "source_size", "target", "n_blocks", "words").agg(
        F.max(F.when(F.col("pass") == 0, each)).alias("once"), F.max(F.when(F.col("pass") == 1, each)).alias("again")
    )


def with_blocks(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    facts = targets.select(F.col("source").alias("of"), "n_blocks")
    placed = sized.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return placed.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("block")), F.col("n_blocks")))


def mix(sized: DataFrame, multiple: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2), block_words: int | None = None, shard_words: int | None = None, seed: int = 17) -> DataFrame:
    """All rows of `sized` (doc_id, source, size and more, of any names) with source_size, target and `takes`, which replace columns of these names.

    `takes` has an entry for each pass in which the mix takes words of the document: struct<pass,
    shard, words>. The words of a source's takes sum to its rounded target. A document of no words
    is in no take; a null source is a source of its own; rows that repeat a doc_id are taken
    together, each on its own; an empty table gives an empty one. Reruns give the same rows.
    """
    return mix_onto(sized, sized, multiple, cap, weights, block_words, shard_words, seed)


def mix_onto(sized: DataFrame, slim: DataFrame, multiple: float = 1.5, cap: float = 2.0, weights: Sequence[int] = (3, 1, 2), block_words: int | None = None, shard_words: int | None = None, seed: int = 17) -> DataFrame:
    """`mix` with the plan made from `slim`, the same documents' doc_id, source and size alone."""
    own, added = ("doc_id", "source", "size"), ("source_size", "target", "takes")
    carried = [c for c in sized.columns if c not in (*own, *added)]
    order = [c for c in sized.columns if c not in added]
    sized = sized.select(*own, F.struct(*(F.col(f"`{c}`") for c in carried) if carried else (F.lit(0).alias("_"),)).alias("_carried"))
    plan = written(block_plan(slim.select("doc_id", "source", "size"), multiple, cap, weights, block_words, shard_words, seed))
    targets = plan.select("source", "n_blocks").distinct()
    facts = plan.select(F.col("source").alias("of"), F.col("block").alias("at"), "source_size", "target", "words", "once", "again")
    rows = with_blocks(sized, targets, seed).join(facts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at", "n_blocks")
    cut = (F.col("once.taken") % F.greatest("words", F.lit(1)) != 0) | (F.col("again.taken") % F.greatest("words", F.lit(1)) != 0)
    in_block = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed), F.lit("cut")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.filter(~cut).withColumn("done", F.lit(0).cast("long"))
    ending = rows.filter(cut).withColumn("done", F.coalesce(F.sum("size").over(in_block), F.lit(0)))

    def take(unit: str) -> Column:
        some = F.greatest(F.lit(0), F.least(F.col("size"), F.col(f"{unit}.taken") - F.col("done")))
        words = F.when(F.col(f"{unit}.taken") == F.col("words"), F.col("size")).when(F.col(f"{unit}.taken") == 0, F.lit(0)).otherwise(some)
        return F.struct(F.col(f"{unit}.pass").alias("pass"), F.col(f"{unit}.shard").alias("shard"), words.cast("long").alias("words"))

    both = whole.unionByName(ending)
    taken = both.withColumn("takes", F.filter(F.array(take("once"), take("again")), lambda t: t["words"] > 0))
    return taken.select(*((F.col(c) if c in own else F.col("_carried")[c]).alias(c) for c in order), *added)


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), written down, so that texts are counted once."""
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: the columns of `docs`, one row for each take, with `shard` and `place`.

    A take that ends within a document keeps its first words, joined by one space. `place` is a
    hash; ordering a shard by it shuffles the shard.
    """
    columns = [c for c in docs.columns if c not in {"shard", "place"}]
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    # The plan is made from the three slim columns; the texts themselves only meet the block plan.
    slim = written(packed.select("doc_id", "source", "size"))
    rows = mix_onto(packed, slim, seed=seed, **options)
    rows = rows.withColumn("take", F.explode("takes"))
    text = F.when(F.col("take.words") < F.col("size"), F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), 0), 1, F.col("take.words").cast("int")), " ")).otherwise(F.col("row.text"))
    out = {c: F.col("row")[c] for c in columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return rows.select(*(v.alias(c) for c, v in out.items()), F.col("take.shard").alias("shard"), F.xxhash64("doc_id", "take.pass", F.lit(seed), F.lit("place")).alias("place"))


def laid_out(taken: DataFrame, slices: int = 16) -> DataFrame:
    """The rows of `mixed_documents`, partitioned by shard and slice of places, each partition in order of shard and place.

    A shard is cut by the hashed place into `slices` equal parts, so no task gets a whole one.
    """
    cut = F.pmod(F.shiftright("place", 32), F.lit(slices))
    return taken.repartition(F.col("shard"), cut).sortWithinPartitions("shard", "place")
