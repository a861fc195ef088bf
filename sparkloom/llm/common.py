"""What the corpus operators share: sizes, Arrow batches, word hashes, byte planes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import written

#: Java's and Python's pattern of a word: anything but space, tab, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


# --- memory --------------------------------------------------------------------------------------


def give_back() -> None:
    """Large arrays are mapped one by one from now on, and unmapped when they go.

    A Python worker runs many tasks; without this the allocators keep what the largest took. It costs
    some time for each array, so it is for modules whose tasks hold much. Where there is no such
    setting nothing changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD; a fixed one doesn't grow with what was freed


# --- sizes -------------------------------------------------------------------------------------


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)


def groups_of(spark: SparkSession, total_bytes: int, target_bytes: int) -> int:
    """How many groups of about `target_bytes` the bytes make, at least one for each shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // target_bytes))


def groups_for(docs: DataFrame, target_bytes: int, text: str = "text") -> int:
    return groups_of(docs.sparkSession, text_bytes(docs, text), target_bytes)


def files_of(spark: SparkSession, total_bytes: int, target_bytes: int) -> int:
    """In how many files to write what is made from so many bytes: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-total_bytes // target_bytes))


# --- Arrow batches -----------------------------------------------------------------------------


def no_nulls(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `max_bytes` of text each; a longer text makes its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def joined(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes, each text followed by \\n, and eight zero bytes; where each text ends (its \\n)."""
    texts = pc.binary_join_element_wise(no_nulls(texts), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())) if len(texts) else pa.array([], pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    buf = np.zeros(len(raw) + 8, np.uint8)
    buf[: len(raw)] = _LOWER[raw] if lower else raw
    return buf, offsets[1:] - offsets[0] - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[list(SPACES)] = True


# --- words -------------------------------------------------------------------------------------


def word_spans(buf: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's first byte and length, and how many words each text has (from `joined`)."""
    n = len(buf) - 8
    blank = np.ones(n + 2, bool)
    np.take(_BLANK, buf[:n], out=blank[1:-1])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    upto = np.searchsorted(starts, text_ends)
    return starts, ends - starts, np.diff(upto, prepend=0)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_words(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time over all words at once."""
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, rest, which = starts, lens, None
    for _ in range(8):
        part = lanes[at] & _MASK[np.minimum(rest, 8)]
        if which is None:
            h = mix(h ^ part)
        else:
            h[which] = mix(h[which] ^ part)
        more = np.flatnonzero(rest > 8)
        if not more.size:
            return h
        which = more if which is None else which[more]
        at, rest = at[more] + 8, rest[more] - 8
    for i in which:  # words of more than 64 bytes
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : starts[i] + lens[i]].tobytes())
    return h


#: An odd multiplier and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
_INVERSE = pow(BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))[:n]


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of each k consecutive word hashes: polynomial in BASE modulo 2**64, finalised."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    if k <= 4:
        h = words[: n - k + 1].copy()
        for j in range(1, k):
            h = h * np.uint64(BASE) + words[j : n - k + 1 + j]
        return mix(h)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(_INVERSE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(BASE, n - k + 1))


# --- byte planes: arrays of numbers as compact binary cells ---------------------------------------


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on; compresses well if sorted or small."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() if len(x) else b""


def from_planes(raw: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def deltas(x: np.ndarray) -> bytes:
    """`planes` of the differences, for sorted numbers."""
    return planes(np.diff(x.astype(np.int64), prepend=np.int64(0)))


def from_deltas(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<i8")) if raw else np.zeros(0, np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
