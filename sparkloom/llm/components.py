"""Connected components by minimum labels with pointer jumping, as joins that Spark deals out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkloom.llm.common import written


def _labels(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes 0, 1, ... reaches by the pairs."""
    label = np.arange(nodes)
    while True:
        nearer = label.copy()
        np.minimum.at(nearer, a, label[b])
        np.minimum.at(nearer, b, label[a])
        nearer = nearer[nearer]
        if (nearer == label).all():
            return label
        label = nearer


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components from fewer pairs: every node with the smallest one it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _labels(len(nodes), at[: len(a)], at[len(a) :])
    arm = label != np.arange(len(nodes))
    return nodes[arm], nodes[label[arm]]


def reached(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the `nodes` (different ones) reaches by pairs of them."""
    order = np.argsort(nodes)
    inside = nodes[order]
    out = np.empty(len(nodes), np.int64)
    out[order] = inside[_labels(len(nodes), np.searchsorted(inside, a), np.searchsorted(inside, b))]
    return out


def _both_ways(batches: Iterator[pa.RecordBatch], most_pairs: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Of each million pairs the stars, each pair in both directions."""
    held: list[pa.RecordBatch] = []

    def made() -> pa.RecordBatch:
        a, b = stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= most_pairs:
            yield made()
    if held:
        yield made()


def connected(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node that it reaches.

    Pairs that meet in a task are first reduced to stars. A round then gives each node the least
    label among its neighbours' and its label's own, so rounds grow with the logarithm of what is
    left of a component's diameter. Null ends, and nodes tied to themselves alone, are dropped.
    `files` bounds the files of each round's labels.
    """
    # most tasks tie a node to the same smallest one
    both = written(edges.select("a", "b").filter("a <> b").mapInArrow(_both_ways, "a long, b long").distinct(), files)
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).select(F.col("a").alias("node"), "component")
    while True:
        hops = both.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        seen = labels.select(F.col("node").alias("b"), "component")
        around = hops.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("component"), F.max("component").alias("most"))
        unsettled = Observation()
        around = written(around.observe(unsettled, F.count_if(F.col("component") != F.col("most")).alias("n")), files)
        labels = around.select("node", "component")
        if not unsettled.get["n"]:
            return labels
