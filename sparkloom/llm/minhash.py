"""Document fingerprints by MinHash, and near copies by joined signature bands.

Of a text's shingles (hashes of word runs) every one of many universal hash functions keeps the
smallest value; the share of functions that agree on two texts estimates the Jaccard coefficient of
their shingle sets. The functions run in numpy over all shingles of a chunk of texts at once.

`edited_fingerprints` lays documents out in order by ranges, so that a text and the one after it
meet in one task. `near_duplicates` joins documents on bands of their signatures and verifies the
Jaccard coefficient of the pairs on the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import chunks, from_planes, hash_words, joined, mix, planes, rolling, word_spans, written
from sparkloom.llm.components import connected


@dataclass(frozen=True)
class MinHash:
    """`functions` hash functions over shingles of `words` lower-cased words; each keeps the low 16 bits of its smallest 32-bit value."""

    functions: int = 128
    words: int = 5
    seed: int = 1

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd a and any b of the multiply-add-shift functions (a * x + b mod 2**64) >> 32."""
        a, b = np.random.default_rng(self.seed).integers(0, 2**64, (2, self.functions), np.uint64)
        return a | np.uint64(1), b

    def shingles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' shingle hashes with repeats, text by text, and how many each text has.

        A text of fewer words than a shingle has one of all its words, one without words none.
        """
        buf, ends = joined(texts, lower=True)
        starts, lens, counts = word_spans(buf, ends)
        words = hash_words(buf, starts, lens)
        first = np.cumsum(counts) - counts
        runs = rolling(words, self.words)
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = doc[: len(runs)] == doc[self.words - 1 :][: len(runs)] if len(runs) else np.zeros(0, bool)
        few = np.flatnonzero((counts > 0) & (counts < self.words))
        short = np.array([xxhash.xxh3_64_intdigest(words[first[d] : first[d] + counts[d]].tobytes()) for d in few.tolist()], np.uint64)
        of, h = np.concatenate([doc[: len(runs)][inside], few]), np.concatenate([runs[inside], mix(short)])
        if len(few):
            order = np.argsort(of, kind="stable")
            of, h = of[order], h[order]
        return h, np.bincount(of, minlength=len(counts))

    def signatures(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row of `functions` numbers for each text; of a text without shingles all are 65535."""
        out = np.full((len(counts), self.functions), 0xFFFF, np.uint16)
        some = np.flatnonzero(counts)
        if some.size:
            starts = (np.cumsum(counts) - counts)[some]
            for k, (a, b) in enumerate(zip(*self.multipliers(), strict=True)):
                out[some, k] = np.minimum.reduceat((h * a + b) >> np.uint64(32), starts).astype(np.uint16)
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        return self.signatures(*self.shingles(pa.array(texts, pa.large_string())))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal numbers, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, after: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many of `after`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


# --- texts and the ones after them -----------------------------------------------------------------

_OUT = [("kind", pa.int8()), ("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.large_string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = "kind byte, part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_WHOLE, _FIRST, _LAST = 0, 1, 2


def _told(made: MinHash, ids: list, texts: list[str], prints: np.ndarray) -> pa.RecordBatch:
    """Rows of all texts but the last, each with the text after it; `prints` are the signatures of all."""
    new = [edited(t, after) for t, after in zip(texts, texts[1:], strict=False)]
    changed, n = made.of(new), len(new)
    own, after = prints[:-1], prints[1:]
    columns = {
        "kind": [_WHOLE] * n, "part": [None] * n, "doc_id": ids[:-1], "text": [None] * n, "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": [x.tobytes() for x in own], "edited_fingerprint": [x.tobytes() for x in changed],
        "near_edited": likeness(own, changed), "near_next": likeness(own, after),
    }
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) for name, kind in _OUT], [name for name, _ in _OUT])


def _end(kind: int, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    values = {"kind": kind, "part": part, "doc_id": doc_id, "text": text}
    return pa.RecordBatch.from_arrays([pa.array([values.get(name)], t) for name, t in _OUT], [name for name, _ in _OUT])


def edited_fingerprints(docs: DataFrame, made: MinHash = MinHash(), chunk_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint binary, near_edited, near_next) for every document.

    A fingerprint is the signature's 16-bit numbers, little-endian. The edited text is the text with
    its last half replaced by the first as many code points of the next document by doc_id (null
    first, ties in the texts' order); after the last comes the first, which for a lone document is
    itself. `near_*` is the share of numbers that two fingerprints have in common. A null text is empty; texts
    without words have one fingerprint of their own; repeated rows are documents each; an empty
    table gives no rows; other columns aren't read.

    Texts move once, to be in order. A range's task doesn't see the text after its last one, so it
    puts out its first and its last text, and these meet in a join over the ranges.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc(), F.col("_tie").asc()]
    ties = [by[0], by[1], by[3]]  # ranges of equal texts split by their places
    laid = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*ties).sortWithinPartitions(*by)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, prints, part = [], [], np.zeros((0, made.functions), np.uint16), None
        for chunk in chunks(batches, chunk_bytes):
            new = chunk.column(1).to_pylist()
            if part is None:
                part = chunk.column(2)[0].as_py()
                yield _end(_FIRST, part, chunk.column(0)[0].as_py(), new[0])
            ids, texts, prints = ids + chunk.column(0).to_pylist(), texts + new, np.concatenate([prints, made.of(new)])
            if len(texts) > 1:
                yield _told(made, ids, texts, prints)
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if texts:
            yield _end(_LAST, part, ids[0], texts[0])

    found = written(laid.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(along, _SCHEMA))
    in_order = Window.orderBy("part")  # a row for each range
    firsts = found.filter(F.col("kind") == _FIRST)
    around = firsts.select("part", F.lead("part").over(in_order).alias("_lead"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("_least"))
    nexts = around.select("part", F.coalesce("_lead", "_least").alias("_next"))
    lasts = found.filter(F.col("kind") == _LAST).select("part", "doc_id", "text")
    pairs = lasts.join(nexts, "part").join(firsts.select(F.col("part").alias("_next"), F.col("text").alias("after")), "_next")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _told(made, [doc_id, None], [text, after], made.of([text, after]))

    met = pairs.select("doc_id", "text", "after").mapInArrow(alone, _SCHEMA)
    return found.filter(F.col("kind") == _WHOLE).unionByName(met).drop("kind", "part", "text")


# --- near copies -------------------------------------------------------------------------------------


def _sets(docs: DataFrame, made: MinHash, bands: int, chunk_bytes: int) -> DataFrame:
    """(doc_id, same, bands, members): a hash of the text's shingle set, one of each band of its signature, and the set; texts without words are left out."""
    rows = made.functions // bands

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, chunk_bytes):
            h, counts = made.shingles(chunk.column(1))
            keys = made.signatures(h, counts)[:, : rows * bands].reshape(len(counts), bands, rows)
            out, at = [], 0
            for d, (doc_id, n) in enumerate(zip(chunk.column(0).to_pylist(), counts.tolist(), strict=True)):
                own = np.unique(h[at : at + n])
                at += n
                if n:
                    hashed = [xxhash.xxh3_64_intdigest(keys[d, b].tobytes(), b) - 2**63 for b in range(bands)]
                    out.append({"doc_id": doc_id, "same": hashlib.md5(own.tobytes()).digest(), "bands": hashed, "members": planes(own)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64())), ("members", pa.binary())]))

    return docs.mapInArrow(cut, "doc_id long, same binary, bands array<long>, members binary")


def near_duplicates(docs: DataFrame, percent: int = 80, made: MinHash = MinHash(), bands: int = 32, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that a document reaches by links of at least `percent` over shingle sets.

    Documents of equal sets become one, that of the smallest id. Its signature is cut into bands; in
    each band the documents of equal values are compared with two of them, of the smallest and the
    largest id, so that pairs stay in proportion to the documents, and pairs whose sets verify link.
    Of two documents at exactly 80 % all but one in 10**7 share one of 32 bands of four; those that
    share it but reach neither end of it link only through other bands or documents. Texts
    without words link with nothing; rows without a doc_id are left out, rows that repeat one are one document.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sets = written(_sets(rows, made, bands, chunk_bytes))
    leaders = sets.groupBy("same").agg(F.min("doc_id").alias("leader"))
    copies = sets.select("doc_id", "same").join(leaders, "same").filter("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    alone = written(sets.join(leaders, "same").filter("doc_id = leader").dropDuplicates(["same"]).select("doc_id", "bands", "members"))
    placed = alone.select("doc_id", F.posexplode("bands").alias("band", "key"))
    ends = placed.groupBy("band", "key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    tied = placed.join(ends, ["band", "key"]).select("doc_id", F.explode(F.array("low", "high")).alias("end")).filter("doc_id <> end")
    pairs = tied.select(F.least("doc_id", "end").alias("a"), F.greatest("doc_id", "end").alias("b")).distinct()
    of = lambda side, name: alone.select(F.col("doc_id").alias(side), F.col("members").alias(name))
    both = pairs.join(of("a", "mine"), "a").join(of("b", "theirs"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for mine, theirs in zip(batch.column(2), batch.column(3), strict=True):
                x, y = from_planes(mine.as_py(), "<u8"), from_planes(theirs.as_py(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = both.select("a", "b", "mine", "theirs").mapInArrow(verify, "a long, b long")
    found = connected(copies.unionByName(links))
    ids = rows.select("doc_id").distinct()
    return ids.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
