"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Each Spark partition packs its own documents, group by group, so nothing is shuffled: a group is as
many tokens as `windows` sequences hold. A document is cut only where it is longer than a window,
which its pieces then fill but for the last, or where a group is full. Within a group, every piece starts as a partial partition (one loaded
window, the others empty); the two partial partitions of the greatest imbalance are merged, the
heaviest windows of one onto the lightest of the other, until one partition is left. Its windows
are nearly equal; if the fullest exceeds the capacity, the group is partitioned again into one more.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkloom.llm.common import SPACES, chunks, hash_words, joined

END_ID = 1


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """An encoder for a byte-level BPE file of `tokenizers`.

    Its vocabulary and merge order are handed to tiktoken, which gives the same ids several times
    faster; tests hold both against each other.
    """
    import public_tokenizers
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> np.ndarray:
    """Each id's length in bytes."""
    by_id = {i: len(token) for token, i in byte_bpe(path)._mergeable_ranks.items()}
    return np.array([by_id.get(i, 0) for i in range(max(by_id) + 1)], np.int64)


#: White space outside ASCII, as UTF-8: first byte, then the bytes that may follow (None: any).
_WIDE_SPACES = ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)))
_WIDE_FIRST = np.zeros(256, bool)
_WIDE_FIRST[[x for x, _ in _WIDE_SPACES]] = True
_BREAKS_AFTER = np.zeros(256, bool)
_BREAKS_AFTER[0x21:0x7F] = True
_BREAKS_AFTER[0x80:] = True
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


class BatchEncoder:
    """Ids of many texts at once, each text's followed by END_ID.

    The pre-tokeniser always breaks between a visible character and the white space after it, so a
    text falls into pieces (white space, then visible characters) that are encoded on their own.
    Every different piece of a batch is encoded once. Texts with white space outside ASCII, next to
    which that isn't certain, stay whole, and so do texts that hold an added token's string. As
    `tokenizers` does by itself, such a string gives the added token; with `added_as_text`, its ids
    are those of any other text. Pieces are told apart by their 64-bit hash and length.
    """

    def __init__(self, path: str, added_as_text: bool = False):
        self.path, self.added_as_text = path, added_as_text

    def _added(self, buf: np.ndarray) -> list[int]:
        """Where a string of an added token begins."""
        if self.added_as_text:
            return []
        found = [re.escape(token.encode()) for token in byte_bpe(self.path).special_tokens_set]
        return [m.start() for m in re.finditer(b"|".join(found), buf)] if found else []

    def _encoded(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one after another, and how many each has.

        Pieces from a space to a visible character are encoded as one text, and cut by their bytes;
        those `apart` hold added tokens and are encoded each.
        """
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        bpe, sizes = byte_bpe(self.path), _token_bytes(self.path)
        plain = _IS_SPACE[buf[starts]] & _BREAKS_AFTER[buf[stops - 1]] & ~apart
        step = np.zeros(len(buf) + 1, np.int8)
        step[starts[plain]] += 1
        step[stops[plain]] -= 1
        text = buf[np.cumsum(step, dtype=np.int8)[:-1].astype(bool)].tobytes().decode()
        ids = bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        upto = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum((stops - starts)[plain])) + 1
        lens = np.zeros(len(starts), np.int64)
        lens[plain] = np.diff(upto, prepend=0)
        of = lambda k: buf[starts[k] : stops[k]].tobytes().decode()
        odd = {k: bpe.encode(of(k), allowed_special="all") if apart[k] else bpe.encode_ordinary(of(k)) for k in np.flatnonzero(~plain).tolist()}
        lens[list(odd)] = [len(x) for x in odd.values()]
        out, own = np.empty(int(lens.sum()), "<u4"), np.repeat(plain, lens)
        out[own] = ids
        out[~own] = np.fromiter((i for x in odd.values() for i in x), "<u4")
        return out, lens

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        buf, ends = joined(texts)
        n, first = len(buf) - 8, np.concatenate([[0], ends[:-1] + 1])
        size = ends - first
        split, whole = np.zeros(n, bool), np.zeros(len(ends), bool)
        if n:
            split[1:] = _IS_SPACE[buf[1:n]] & _BREAKS_AFTER[buf[: n - 1]]
            wide = np.flatnonzero(_WIDE_FIRST[buf[:n]])
            if wide.size:
                hit = np.zeros(len(wide), bool)
                for lead, follow in _WIDE_SPACES:
                    hit |= (buf[wide] == lead) & np.isin(buf[wide + 1], follow)
                for k in np.unique(np.searchsorted(ends, wide[hit])):
                    split[first[k] : ends[k]] = False
            whole[np.searchsorted(ends, self._added(buf))] = True
            for k in np.flatnonzero(whole):
                split[first[k] : ends[k]] = False
            split[ends] = False
            split[first[size > 0]] = True
        starts = np.flatnonzero(split)
        upto = np.searchsorted(starts, ends)
        stops = np.empty(len(starts), np.int64)
        stops[:-1] = starts[1:]
        filled = size > 0
        stops[upto[filled] - 1] = ends[filled]
        _, at, which = np.unique(hash_words(buf, starts, stops - starts), return_index=True, return_inverse=True)
        place = np.argsort(np.argsort(at))  # different pieces in the order of their first occurrence
        at.sort()
        flat, lens = self._encoded(buf, starts[at], stops[at], whole[np.searchsorted(ends, starts[at])])
        which = place[which]
        counts = lens[which]
        done = np.cumsum(counts)
        total = int(done[-1]) if len(done) else 0
        ids = flat[np.repeat((np.cumsum(lens) - lens)[which] - (done - counts), counts) + np.arange(total)]
        cuts = np.concatenate([[0], done])[upto]
        out = np.insert(ids, cuts, np.uint32(END_ID))
        return np.split(out, (cuts + np.arange(1, len(cuts) + 1))[:-1])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of `sizes` in at most k near-equal sets.

    A partial partition lists its loaded windows only, heaviest first, up to k of them; the windows
    that it doesn't list are empty. Loads are kept as differences from the lightest window.
    """
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - k)  # windows loaded in both: the lightest of each meet
        low_a, low_b = len(a) - shared, len(b) - shared
        merged = a[:low_a] + b[:low_b]
        merged += [(x + y, (s, t)) for (x, s), (y, t) in zip(a[low_a:], reversed(b[low_b:]), strict=True)]
        merged.sort(key=_load, reverse=True)
        least = merged[-1][0] if len(merged) == k else 0
        if least:
            merged = [(x - least, s) for x, s in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    return [list(_flat(s)) for _, s in heap[0][2]]


def _load(window: tuple) -> int:
    return window[0]


def _flat(members: tuple) -> Iterator[int]:
    """The indices in nested pairs; a pair of pairs is a merge, a single number a piece."""
    stack = [members]
    while stack:
        for x in stack.pop():
            if isinstance(x, tuple):
                stack.append(x)
            else:
                yield x


def partitioned(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing fills without exceeding `capacity`."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in x) <= capacity for x in sets):
            return [x for x in sets if x]
        k += 1


def pack(docs: DataFrame, encode: Callable[[pa.Array], list[np.ndarray]], capacity: int = 2048, windows: int = 128, fill: float = 0.99, with_ids: bool = True) -> DataFrame:
    """Rows per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (array<int>, if asked for).

    `encode` gives the ids, with their end mark, of each text of an Arrow array (null: empty). `start` counts the document's ids before the
    piece; `offset` is the piece's place in its sequence, gapless from 0. A null or empty text makes
    one piece of its end mark. Rows that repeat a doc_id are packed each on their own; a null doc_id
    stays null. sequence_id holds the partition's number above the sequence's: recomputed partitions
    give the same rows, and no two partitions share one. An empty table gives no rows.
    """

    def windows_of(pieces: list[tuple]) -> Iterator[tuple]:
        for window in partitioned([len(p[2]) for p in pieces], capacity):
            offset = 0
            for i in sorted(window):
                doc, start, ids, total = pieces[i]
                yield doc, start, len(ids), zlib.crc32(ids), total, offset, ids
                offset += len(ids)
            yield None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 33, 0
        batch_rows = 4000 if with_ids else 20_000
        room = limit = int(windows * capacity * fill)
        group: list[tuple] = []
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal serial, group, room
            for row in windows_of(group):
                if row is None:
                    serial += 1
                else:
                    rows.append((*row, base + serial))
            group, room = [], limit

        def made() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            doc, start, length, crc, total, offset, ids, seq = cols
            arrays = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, total, seq, offset)]
            if with_ids:
                flat = np.concatenate(ids) if rows else np.zeros(0, "<u4")
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in fields])

        for chunk in chunks(batches, 4 << 20):
            for doc, ids in zip(chunk.column(0).to_pylist(), encode(chunk.column(1)), strict=True):
                start, total = 0, len(ids)
                while start < total:
                    n = min(capacity, total - start)
                    if n == capacity:  # nothing is left to balance in a full window
                        rows.extend((*row, base + serial) for row in windows_of([(doc, start, ids[start : start + n], total)]) if row)
                        serial += 1
                    else:
                        n = min(n, room)
                        group.append((doc, start, ids[start : start + n], total))
                        room -= n
                        if not room:
                            flush()
                    start += n
                    if len(rows) >= batch_rows:
                        yield made()
        if group:
            flush()
        if rows:
            yield made()

    fields = ["doc_id long", "start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long", *(["ids array<int>"] if with_ids else [])]
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ", ".join(fields))
