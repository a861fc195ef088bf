"""Embedding whitening by exact integer covariances, counted in bit slices.

Vectors become integers. Of a block of rows, every dimension's shifted numbers are cut into bit
planes and each plane is packed across the rows into 64-bit words; the AND of two planes' words has
as many bits set as rows with both, so popcounts weighted by powers of two are the exact sums of
products. Tasks send these sums in limbs that Spark adds up. The covariance is centred as integers of
any size and becomes floating point only then, for one `eigh` of a matrix of the dimension's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sparkloom.llm.common import written

#: Sums of products are sent in limbs of so many bits.
LIMB = 24


@dataclass(frozen=True)
class Scale:
    """Entries become floor(times * c) + plus."""

    times: int = 1024
    plus: int = 100_000


def integers(vector: Column, scale: Scale) -> Column:
    """The vector's integers, null where it is null or holds a null, a non-finite entry or one whose integer isn't below 2**62."""
    entry = vector.cast("array<double>")
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**62 / scale.times - 2.0 * scale.plus)
    made = F.transform(entry, lambda c: F.floor(F.lit(float(scale.times)) * c).cast("long") + F.lit(scale.plus).cast("long"))
    return F.when(F.forall(entry, sound), made)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, rows: int, column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield _matrix(batch.column(column).slice(at, rows), size)


def packed_planes(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit planes of the non-negative numbers in each column of `y`, 64 rows to a word; each plane's column and its bit."""
    column = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if len(bits) else np.zeros(0, np.int64)
    words = -(-len(y) // 64)
    planes = np.zeros((len(column), words), np.uint64)
    for p, (d, k) in enumerate(zip(column, bit, strict=True)):
        own = np.packbits(((y[:, d] >> np.uint64(k)) & np.uint64(1)).astype(np.uint8), bitorder="little")
        planes[p].view(np.uint8)[: len(own)] = own
    return planes, column, bit


def plane_products(y: np.ndarray, bits: np.ndarray, limbs: int) -> np.ndarray:
    """Sums of y_i * y_j over the rows for i <= j, by AND and popcount: one matrix for each limb of 2**(LIMB * k)."""
    planes, column, bit = packed_planes(y, bits)
    out = np.zeros((limbs, len(bits), len(bits)), np.int64)
    first = np.searchsorted(column, np.arange(len(bits)))
    for p, (i, k) in enumerate(zip(column, bit, strict=True)):
        both = np.bitwise_count(planes[p] & planes[first[i] :]).sum(axis=1, dtype=np.int64)
        power = k + bit[first[i] :]
        np.add.at(out, (power // LIMB, i, column[first[i] :]), both << (power % LIMB))
    return out


def scatter(rows: DataFrame, low: np.ndarray, bits: np.ndarray, block_rows: int) -> DataFrame:
    """(i, j, limb, total decimal): what the sums of (x_i - low_i) * (x_j - low_j) over all `x` have in each limb, for i <= j."""
    size, limbs = len(bits), int(2 * bits.max()) // LIMB + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((limbs, size, size), np.int64), 0

        def sums() -> pa.RecordBatch:
            limb, i, j = np.nonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(a) for a in (i.astype(np.int32), j.astype(np.int32), limb.astype(np.int32), total[limb, i, j])], ["i", "j", "limb", "part"])

        for x in _blocks(batches, size, block_rows):
            total += plane_products((x - low).astype(np.uint64), bits, limbs)
            held += 1
            if held == 1 << 10:  # far from the limits of 64 bits
                yield sums()
                total[:], held = 0, 0
        if held:
            yield sums()

    parts = rows.select("x").mapInArrow(count, "i int, j int, limb int, part long")
    return parts.groupBy("i", "j", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))


def ranges(rows: DataFrame, size: int) -> DataFrame:
    """(pos, low, high, total): each dimension's smallest and largest integer and their sum."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), size)
                high, low = x >> 31, x & 0x7FFFFFFF  # two sums, as one of many large numbers may not fit
                each = (np.arange(size, dtype=np.int32), x.min(axis=0), x.max(axis=0), high.sum(axis=0), low.sum(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in each], ["pos", "low", "high", "upper", "lower"])

    parts = rows.select("x").mapInArrow(told, "pos int, low long, high long, upper long, lower long")
    total = F.sum(F.col("upper").cast("decimal(20,0)")) * F.lit(2**31).cast("decimal(10,0)") + F.sum(F.col("lower").cast("decimal(20,0)"))
    return parts.groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high"), total.alias("total"))


@dataclass(frozen=True)
class Whitener:
    """What a fit gives: of n vectors the sums S, the components as columns, their eigenvalues and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float


def _eigen(n: int, sums: list[int], products: list[list[int]], most: int) -> Whitener:
    """From the exact sums and sums of products; n * products - sums * sums are n * n times the covariances, as integers."""
    size = len(sums)
    covariance = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    trace = sum((n * products[i][i] - sums[i] * sums[i]) for i in range(size)) / (n * n)
    # beyond what double precision tells from zero there is no variance to divide by
    values = np.where(values > trace * size * np.finfo(float).eps, values, 0.0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitener(n, tuple(sums), np.ascontiguousarray(vectors * signs), values, trace)


def fit(rows: DataFrame, size: int, n: int, most: int, block_rows: int = 4096) -> Whitener:
    """The whitener of all rows' `x` of that size. What reaches the driver has the size of the covariance matrix."""
    told = {r.pos: r for r in ranges(rows, size).collect()}
    low = np.array([told[d].low for d in range(size)])
    bits = np.array([(told[d].high - told[d].low).bit_length() for d in range(size)])
    sums = [int(told[d].total) for d in range(size)]
    shifted = [s - n * int(b) for s, b in zip(sums, low, strict=True)]
    products = [[0] * size for _ in range(size)]
    if bits.any():
        for r in scatter(rows, low, bits, block_rows).collect():
            products[r.i][r.j] += int(r.total) << (LIMB * r.limb)
    for i in range(size):
        for j in range(i):
            products[i][j] = products[j][i]
    made = _eigen(n, shifted, products, most)  # covariances don't depend on the shift
    return Whitener(n, tuple(sums), made.components, made.values, made.trace)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, list[int]]:
    """(x - S / n) as doubles, each rounded once or twice, and the exact sum of the squares of n * x - S of each row."""
    most = max(abs(n * int(m) - s) for at, s in zip((x.min(axis=0), x.max(axis=0)), (sums, sums), strict=True) for m, s in zip(at, s, strict=True))
    if most < 2**31 and most * most * len(sums) < 2**63 and n * int(np.abs(x).max()) < 2**63:
        exact = n * x - np.array(sums, np.int64)
        return exact / n, (exact * exact).sum(axis=1).tolist()
    exact = n * x.astype(object) - np.array(sums, object)
    return (exact / n).astype(float), (exact * exact).sum(axis=1).tolist()


def whitened_rows(rows: DataFrame, key: str, w: Whitener, block_rows: int = 4096) -> DataFrame:
    """(key, deviation decimal, z): each row's whitened components, null where a component has no variance."""
    size, schema = len(w.sums), rows.select(key).schema
    divisors = np.sqrt(np.where(w.values > 0, w.values, np.nan))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                centred, deviation = _centred(_matrix(part.column(1), size), w.n, w.sums)
                z = centred @ w.components / divisors
                flat = pa.array(z.reshape(-1), from_pandas=True)  # NaN becomes null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(d) for d in deviation]), lists], [key, "deviation", "z"])

    made = rows.select(key, "x").mapInArrow(turn, schema.add("deviation", "string").add("z", ArrayType(DoubleType())))
    return made.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def identity_error(rows: DataFrame, components: int) -> float | None:
    """The largest absolute entry of z's covariance minus the identity, over the components that have variance; null if none has."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = rows.agg(*(F.covar_pop(F.col("z")[i], F.col("z")[j]) for i, j in pairs)).first()
    errors = [abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True) if v is not None]
    return max(errors, default=None)


SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 8, scale: Scale = Scale()) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every vector and its first `most` components.

    Vectors that are null or empty, hold a null or non-finite entry or one whose integer isn't below
    2**62 take no part; nor do those of another size than most vectors have (of equally many, the
    larger size). The fit is over all others: n of them, with sums S and the covariance (divisor n) of
    their integers x. Components are its unit eigenvectors, numbered from 1 by falling eigenvalue,
    their largest entry positive. `deviation` is the exact sum of (n * x - S)**2 over the dimensions (null beyond 38 digits),
    `whitened` is x - S / n projected on the component over the root of its eigenvalue, `explained` the
    eigenvalue's share of the trace, `identity_error` one value for all rows. Where a component has no
    variance `whitened` is null and it doesn't count for `identity_error`; without any variance
    `explained` is null. Repeated rows count each, null keys stay; an empty table gives no rows;
    columns not named here are not read.
    """
    spark = vectors.sparkSession
    # written, as three passes read it
    taken = written(vectors.select(F.col(f"`{key}`").alias("key"), integers(F.col(f"`{vector}`"), scale).alias("x")).filter(F.size("x") > 0))
    sizes = taken.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if not sizes:
        return spark.createDataFrame([], f"`{key}` {dict(taken.dtypes)['key']}, {SCHEMA}")
    rows = taken.filter(F.size("x") == sizes["size"])
    w = fit(rows, sizes["size"], sizes["n"], most)
    made = written(whitened_rows(rows, "key", w))
    error = identity_error(made, len(w.values))
    shares = F.array(*(F.lit(float(v / w.trace) if w.trace else None).cast("double") for v in w.values))
    each = made.select("key", "deviation", F.posexplode("z").alias("pos", "whitened"))
    return each.select(
        F.col("key").alias(key),
        (F.col("pos") + 1).cast("int").alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("pos")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
