"""Removal of repeated substrings by Rabin-Karp hashes of every fixed-length word window.

Texts are read in chunks. A chunk rolls a Rabin-Karp hash over its words, one for every window, and
settles its own repeats at once: of equal windows only the earliest goes on, so that no window is
sent more than once by a chunk, however often it occurs. What goes on is dealt by ranges of the
hash; a range's group brings equal windows of all chunks together and keeps the earliest. All other
windows' places return to their documents, where they merge into maximal intervals that are cut.

Hashes have 64 bits and stand for the windows; among n windows about n * n / 2**65 pairs are taken
for equal that aren't.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from sparkloom.llm.common import WORD, bucket_of, chunks, deltas, from_deltas, from_planes, give_back, groups_for, hash_words, joined, planes, rolling, word_spans

give_back()

_ROWS = "bucket int, part int, docs binary, starts binary, hashes binary"


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Per chunk and bucket one row of windows in hash order; and per chunk and part one of settled removals, which have a `part`."""
    for chunk in chunks(batches, chunk_bytes):
        ids = chunk.column(0).to_numpy(zero_copy_only=False)
        part = chunk.column(2).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        ids, part = ids[order], part[order]
        buf, ends = joined(chunk.column(1).take(pa.array(order)))
        starts, lens, counts = word_spans(buf, ends)
        words = hash_words(buf, starts, lens)
        del buf, starts, lens
        h = rolling(words, window)
        del words
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        inside = np.flatnonzero(doc[: len(h)] == doc[window - 1 :][: len(h)]).astype(np.int32) if len(h) else np.zeros(0, np.int32)
        first_word = (np.cumsum(counts) - counts).astype(np.int32)
        h, doc = h[inside], doc[inside]
        place = inside - first_word[doc]
        del inside
        by_hash = np.argsort(h, kind="stable").astype(np.int32)  # within equal windows: by doc_id, then start
        h, doc, place = h[by_hash], doc[by_hash], place[by_hash]
        del by_hash
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        earliest = np.flatnonzero(head)[np.cumsum(head, dtype=np.int32) - 1].astype(np.int32) if len(h) else np.zeros(0, np.int32)
        later = (ids[doc] != ids[doc[earliest]]) | (place != place[earliest])
        del head, earliest
        out: list[tuple] = []
        if later.any():
            d, p = doc[later], place[later]
            to = part[d]
            for k in np.unique(to):
                own = to == k
                out.append((int(k) % buckets, int(k), *_pairs(ids[d[own]], p[own]), None))
        h, doc, place = h[~later], doc[~later], place[~later]
        dealt = bucket_of(h, buckets)
        begin = np.flatnonzero(np.diff(dealt, prepend=-1))  # of the buckets that the chunk has windows of
        for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(h)], strict=True) if len(h) else ():
            used, which = np.unique(doc[lo:hi], return_inverse=True)
            listed = deltas(ids[used])
            index = planes(which.astype("<u2" if len(used) <= 65536 else "<u4"))
            out.append((int(dealt[lo]), -1, len(used).to_bytes(4, "little") + listed + index, planes(place[lo:hi].astype("<u4")), planes(h[lo:hi].byteswap())))
        yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "part", "docs", "starts", "hashes"), r, strict=True)) for r in out], schema=_ARROW_ROWS)


_ARROW_ROWS = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("hashes", pa.binary())])
_ARROW_REMOVALS = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary())])


def _pairs(ids: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes]:
    """Removals in the order of doc_id and start, the ids as differences."""
    order = np.lexsort((places, ids))
    return deltas(ids[order]), planes(places[order].astype("<u4"))


def _later_windows(rows: pa.Table, part_of: int) -> pa.Table:
    """Of each window in one bucket all places but the earliest, by part; settled removals pass through."""
    hashes, ids, places, out = [], [], [], []
    for r in rows.to_pylist():
        if r["part"] >= 0:
            out.append({"part": r["part"], "docs": r["docs"], "starts": r["starts"]})
            continue
        h = from_planes(r["hashes"], "<u8").byteswap()
        n = int.from_bytes(r["docs"][:4], "little")
        listed = from_deltas(r["docs"][4 : 4 + 8 * n])
        hashes.append(h)
        ids.append(listed[from_planes(r["docs"][4 + 8 * n :], "<u2" if n <= 65536 else "<u4")])
        places.append(from_planes(r["starts"], "<u4"))
    if hashes:
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        met = np.zeros(len(h), bool)
        met[1:] = same
        met[:-1] |= same
        order = order[met]  # only windows of at least two chunks
        h, d, p = h[order], np.concatenate(ids)[order], np.concatenate(places)[order].astype(np.int64)
        order = np.lexsort((p, d, h))
        h, d, p = h[order], d[order], p[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        earliest = np.flatnonzero(head)[np.cumsum(head) - 1] if len(h) else np.zeros(0, np.int64)
        later = (d != d[earliest]) | (p != p[earliest])
        d, p = d[later], p[later]
        to = part_of_ids(d, part_of)
        for k in np.unique(to):
            docs, starts = _pairs(d[to == k], p[to == k])
            out.append({"part": int(k), "docs": docs, "starts": starts})
    return pa.Table.from_pylist(out, schema=_ARROW_REMOVALS)


def part_of_ids(ids: np.ndarray, parts: int) -> np.ndarray:
    """crc32 of the ids as text, modulo `parts`; Spark deals documents by the same number."""
    different, which = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % i) % parts for i in different.tolist()], np.int64)[which]


def removed_windows(docs: DataFrame, window: int, buckets: int, parts: int, chunk_bytes: int) -> DataFrame:
    """(part, docs, starts): the windows that also start earlier, as packed (doc_id, start) pairs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _window_rows(batches, window, buckets, chunk_bytes)

    def settle(rows: pa.Table) -> pa.Table:
        return _later_windows(rows, parts)

    return docs.select("doc_id", "text", "part").mapInArrow(cut, _ROWS).groupBy("bucket").applyInArrow(settle, "part int, docs binary, starts binary")


def _kept(raw: bytes, places: np.ndarray, window: int, source_layout: bool) -> tuple[bytes, int, int, list[dict]]:
    """What is left of a text without the windows at `places`: text, words, words removed, word spans removed."""
    if not places.size:
        words = raw.split()
        return raw if source_layout else b" ".join(words), len(words), 0, []
    if source_layout:
        at = [m.span() for m in re.finditer(WORD.encode(), raw)]
        words = [raw[a:b] for a, b in at]
    else:
        words = raw.split()
    places = np.unique(places)
    breaks = np.flatnonzero(np.diff(places) > window) + 1
    spans = [(int(x[0]), int(x[-1]) + window) for x in np.split(places, breaks)]
    removed, upto, kept = 0, 0, []
    for a, b in [*spans, (len(words), len(words))]:
        if source_layout:
            # from after the last cut word to the first cut one, with the white space before the latter
            begin = at[upto - 1][1] if upto else 0
            kept.append(raw[begin : at[a][0] if a < len(at) else len(raw)])
        else:
            kept.extend(words[upto:a])
        removed += b - a
        upto = b
    return b"".join(kept) if source_layout else b" ".join(kept), len(words), removed, [{"start": a, "stop": b} for a, b in spans]


def dedup_substrings(docs: DataFrame, window: int = 20, source_layout: bool = False, group_bytes: int = 8 << 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """All columns of `docs`, then kept_text, n_words, n_removed and removed_spans (word places, array<struct<start, stop>>).

    A word goes if a window of `window` consecutive words covers it whose word sequence also starts
    earlier: in a document of smaller doc_id, or earlier in the same document. Windows are judged on
    the input. kept_text joins the kept words by one space; with `source_layout`, removed intervals
    are cut out of the text as it is. A null text has no words; texts of fewer than `window` words
    lose nothing; rows that repeat a doc_id count as one document, in which equal places don't
    precede each other (if their texts differ, removals found in one apply to all of them); a null
    doc_id sorts before all others. The added names replace columns of the same name.
    """
    added = ("kept_text", "n_words", "n_removed", "removed_spans")
    carried = [c for c in docs.columns if c not in added]
    beside = [c for c in carried if c != "text"]
    text = F.col("text").cast("string")
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.struct(F.struct(*(F.col(f"`{c}`") for c in beside)).alias("own") if beside else F.lit(None).alias("own"), text.isNull().alias("none")).alias("row"),
    )
    groups = groups_for(docs, group_bytes)
    dealt = keyed.withColumn("part", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % groups).cast("int"))
    removals = removed_windows(dealt, window, groups, groups, chunk_bytes)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    out_schema = StructType([*keyed.select("row").schema.fields]).add("text", "string").add("kept_text", "string").add("n_words", "long").add("n_removed", "long").add("removed_spans", ArrayType(StructType().add("start", "long").add("stop", "long")))

    def cut(texts: pa.Table, removals: pa.Table) -> pa.Table:
        found = [(from_deltas(r["docs"]), from_planes(r["starts"], "<u4").astype(np.int64)) for r in removals.to_pylist()]
        ids = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        places = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(ids, kind="stable")
        ids, places = ids[order], places[order]
        own = texts.column("doc_id").to_numpy()
        lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
        kept, n, gone, spans = [], [], [], []
        for raw, a, b in zip(texts.column("text"), lo, hi, strict=True):  # one text at a time as a Python object
            left = _kept(raw.cast(pa.binary()).as_py(), places[a:b], window, source_layout)
            for to, x in zip((kept, n, gone, spans), left, strict=True):
                to.append(x)
        return pa.table({"row": texts.column("row"), "text": texts.column("text"), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed_spans": pa.array(spans, spans_type)})

    done = dealt.groupBy("part").cogroup(removals.groupBy("part")).applyInArrow(cut, out_schema)
    shown = F.when(~F.col("row.none"), F.col("text"))
    return done.select(*((shown if c == "text" else F.col("row.own")[c]).alias(c) for c in carried), *added)
