"""N-gram Jaccard join with prefix trees, and the components of its links.

A document's set holds the hashes of its distinct word shingles. The hash order is cut into about
twice as many ranges as two similar sets can differ in elements, so that similar sets agree in at
least half of them. A set's elements in one range, in order, are a root-to-leaf path of that range's
prefix tree; paths travel as their hashes. All paths have one global order, the rarest first, by a
table of fixed size that counts the shingles of all documents by slots (any order gives the same
links; this one gives few candidates: the inverse frequencies of a path's shingles are added, so
paths that lie in passages that many documents share come last). Similar sets share a path among
their first halves. Documents that share such a path become candidates: each is tied to the smallest
document of the path, never to all. Sets that are equal as a whole are tied for good and represented
by their smallest document.

Tied documents form blocks. Each block's sets meet once: in the order of falling frequency in the
block they are stored in a prefix tree, so that similar sets share their upper part; one traversal
joins the tree with itself, overlaps with shared parts are counted once, and a subtree is left when
the lengths that remain can't reach the threshold, or when all its sets are in the component already.
A block beyond `block_docs` is split: each part meets a few leaders of the block, those that share
the most paths. What doesn't reach the main leader then meets the documents that it shares a path
with, path by path, or all parts, where that copies less text. No link between different sets is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bucket_of, chunks, deltas, files_of, from_deltas, from_planes, give_back, groups_of, hash_words, joined, mix, planes, rolling, text_bytes, word_spans, written
from sparkloom.llm.components import connected, reached, stars

give_back()

_PATH, _EQUAL, _TIED, _SAME, _SIZE, _SHARES = range(6)
_ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("docs", pa.binary()), ("index", pa.binary()), ("hashes", pa.binary())])
_GROWTH = 1.5
_PAIRS = pa.schema([("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary())])
#: Slots of the table that orders shingles by frequency, and the slices in which it is summed.
TABLE, _SLICES = 1 << 22, 64
#: By level, about the inverse of a frequency; whole numbers, so that sums don't depend on their order.
_RARITY = (2.0 ** (40 - np.arange(256) / 8)).astype(np.int64)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets one after another, each sorted by hash; and each set's size. A-Z count as a-z."""
    buf, ends = joined(texts, lower=True)
    starts, lens, counts = word_spans(buf, ends)
    words = hash_words(buf, starts, lens)
    doc = np.repeat(np.arange(len(counts)), counts)
    h = rolling(words, n)
    inside = doc[: len(h)] == doc[n - 1 :][: len(h)] if len(h) else np.zeros(0, bool)
    h, of = h[inside], doc[: len(inside)][inside]
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if short.size:  # the whole sequence as one
        whole = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            whole[has] = mix(whole[has] ^ words[first[short][has] + k]) + np.uint64(k + 1)
        h, of = np.concatenate([h, whole]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(counts))


def frequency_levels(texts: DataFrame, n: int, chunk_bytes: int, spread: int) -> np.ndarray:
    """How common the shingles of each of TABLE slots are, as a logarithmic level from 0 to 255, over all texts (doc_id, text).

    Tasks count into tables of the same fixed size, which are summed slice by slice in two steps, `spread` groups in the first, so
    neither a group nor what comes to the driver (TABLE bytes) grows with the input.
    """
    width = TABLE // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.uint32)
        for chunk in chunks(batches, chunk_bytes):
            slots, times = np.unique((shingle_sets(chunk.column(1), n)[0] & np.uint64(TABLE - 1)).astype(np.uint32), return_counts=True)
            total[slots] += times.astype(np.uint32)
        for k in range(_SLICES if total.any() else 0):  # one by one, for memory's sake
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([planes(total[k * width : (k + 1) * width])], pa.binary())], ["slice", "counts"])

    def added(table: pa.Table, kind: str) -> np.ndarray:
        total = np.zeros(width, np.uint64)
        for raw in table.column("counts"):
            total += from_planes(raw.as_py(), kind)
        return total

    def summed(table: pa.Table) -> pa.Table:
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([planes(added(table, "<u4"))], pa.binary())})

    def levelled(table: pa.Table) -> pa.Table:
        level = np.minimum(255, 8 * np.log2(1.0 + added(table, "<u8"))).astype(np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "levels": pa.array([level.tobytes()], pa.binary())})

    counted = texts.mapInArrow(count, "slice int, counts binary").withColumn("some", F.pmod(F.spark_partition_id(), F.lit(spread)))
    halfway = counted.groupBy("slice", "some").applyInArrow(summed, "slice int, counts binary")
    levels = np.zeros(TABLE, np.uint8)
    for k, raw in halfway.groupBy("slice").applyInArrow(levelled, "slice int, levels binary").collect():
        levels[k * width : (k + 1) * width] = np.frombuffer(raw, np.uint8)
    return levels


def size_levels(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Each size level's first size, and the most elements by which two similar sets differ whose larger one has that level."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, int(edges[-1] * _GROWTH)))
    most = np.array([b - 1 for b in edges[1:]], np.int64)
    return np.array(edges[:-1], np.int64), 2 * most * (100 - percent) // (100 + percent)


def path_hashes(sets: np.ndarray, sizes: np.ndarray, percent: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each set's prefix of paths, in which every similar set has one of its own.

    Two sets of which the larger has m elements meet at m's level, so a set walks its own level and
    those up to its largest partner's. Where similar sets differ in at most d elements, 2 d + 1
    ranges leave d + 1 in which they agree; so of all ranges, rarest path first, the first d + 1 of
    both hold a common one. A path's rarity is the sum of its shingles' inverse frequencies: one
    rare shingle meets fewer documents than several common ones. Empty ranges come last.
    Where d is 0, only equal sets are similar.
    """
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges, differ = size_levels(percent, int(sizes.max()) * 100 // percent + 1)
    own = np.searchsorted(edges, sizes, side="right") - 1
    last = np.searchsorted(edges, sizes * 100 // percent, side="right") - 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    mixed, top = mix(sets ^ np.uint64(0xA0761D6478BD642F)), sets >> np.uint64(32)
    rarity = _RARITY[levels[(sets & np.uint64(TABLE - 1)).astype(np.int64)]]
    found, of = [], []
    for step in range(int((last - own)[sizes > 0].max()) + 1):
        level = own + step
        d = np.where((sizes > 0) & (level <= last), differ[np.clip(level, 0, len(differ) - 1)], 0)
        takes = d[doc] > 0
        if not takes.any():
            continue
        to = doc[takes]
        at = (top[takes] * (2 * d[to] + 1).astype(np.uint64)) >> np.uint64(32)
        new = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (at[1:] != at[:-1])]))
        range_of, path_of = at[new], to[new]
        paths = mix(np.add.reduceat(mixed[takes], new) + mix((level[path_of].astype(np.uint64) << np.uint64(40)) + range_of))
        order = np.lexsort((paths, -np.add.reduceat(rarity[takes], new), path_of))
        filled = np.bincount(path_of, minlength=len(sizes))
        place = np.arange(len(order)) - np.repeat(np.cumsum(filled) - filled, filled)
        first = order[place <= d[path_of]]  # path_of is in order before and after
        found.append(paths[first])
        of.append(path_of[first])
        for i in np.flatnonzero((d > 0) & (filled <= d)):
            empty = np.setdiff1d(np.arange(2 * d[i] + 1), range_of[path_of == i].astype(np.int64))[: d[i] + 1 - filled[i]].astype(np.uint64)
            found.append(mix(mix((np.uint64(level[i]) << np.uint64(40)) + empty)))
            of.append(np.full(len(empty), i))
    return (np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _leaders(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, leader, first): by hash and id; each entry's smallest id of the same hash; whether it is the first of it."""
    order = np.lexsort((ids, h))
    hs = h[order]
    head = np.ones(len(h), bool)
    head[1:] = hs[1:] != hs[:-1]
    leader = ids[order][np.flatnonzero(head)[np.cumsum(head) - 1]] if len(h) else np.zeros(0, np.int64)
    return order, leader, head


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = a != b
    pairs = np.unique(np.stack([a[keep], b[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _path_rows(batches: Iterator[pa.RecordBatch], n: int, percent: int, levels: np.ndarray, buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Per chunk: paths and equal sets by bucket, one document for each hash; ties settled within the chunk; sizes."""
    for serial, chunk in enumerate(chunks(batches, chunk_bytes)):
        known = chunk.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = chunk.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        sets, sizes = shingle_sets(chunk.column(1), n)
        to = (int(ids[0]) * 31 + serial) % buckets
        out = [(to, _SIZE, planes(ids), planes(np.where(known, sizes, -1 - sizes)), None)]
        linked = known & (sizes > 0)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        whole = np.zeros(len(sizes), np.uint64)
        np.add.at(whole, doc, mix(sets))
        whole = mix(whole + sizes.astype(np.uint64))
        paths, of = path_hashes(sets, sizes, percent, levels)
        for kind, tie, h, d in ((_EQUAL, _SAME, whole[linked], np.flatnonzero(linked)), (_PATH, _TIED, paths[linked[of]], of[linked[of]])):
            order, leader, head = _leaders(h, ids[d])
            a, b = _distinct_pairs(ids[d[order]], leader)
            if len(a):
                out.append((to, tie, planes(a), planes(b), None))
            h, d = h[order][head], d[order][head]
            cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
            for k in range(buckets):
                lo, hi = cuts[k], cuts[k + 1]
                if lo < hi:
                    used, which = np.unique(ids[d[lo:hi]], return_inverse=True)
                    out.append((k, kind, deltas(used), planes(which.astype("<u4")), planes(h[lo:hi].byteswap())))
        yield pa.RecordBatch.from_pylist([dict(zip(_ROWS.names, r, strict=True)) for r in out], schema=_ROWS)


def _tied(rows: pa.Table) -> pa.Table:
    """(kind, a, b) of one bucket, each kind's pairs in a row: _SAME, _SIZE pass through, and equal sets are _SAME as the smallest.

    _TIED: documents of one path are tied, and each with the smallest one that it reaches in the
    bucket. _SHARES: in how many of the bucket's paths a document meets others.
    """
    out: list[tuple] = []
    met: dict[int, list] = {_PATH: [], _EQUAL: []}
    ties: list[tuple[np.ndarray, np.ndarray]] = []
    for r in rows.to_pylist():
        if r["kind"] in met:
            met[r["kind"]].append((from_planes(r["hashes"], "<u8").byteswap(), from_deltas(r["docs"])[from_planes(r["index"], "<u4")]))
        else:
            own = from_planes(r["docs"], "<i8"), from_planes(r["index"], "<i8")
            ties.append(own) if r["kind"] == _TIED else out.append((r["kind"], *own))
    for kind in (_PATH, _EQUAL):
        if met[kind]:
            h, ids = (np.concatenate(x) for x in zip(*met[kind], strict=True))
            by = np.argsort(h, kind="stable")
            same = h[by[1:]] == h[by[:-1]]
            several = np.zeros(len(h), bool)
            several[1:] = same
            several[:-1] |= same
            h, ids = h[by[several]], ids[by[several]]
            order, leader, _ = _leaders(h, ids)
            pairs = _distinct_pairs(ids[order], leader)
            if kind == _EQUAL:
                out.append((_SAME, *pairs))
            else:
                ties.append(pairs)
                doc, shares = np.unique(ids, return_counts=True)
                out.append((_SHARES, doc, shares))
    if ties:
        out.append((_TIED, *stars(*(np.concatenate(x) for x in zip(*ties, strict=True)))))
    return pa.Table.from_pylist([{"kind": kind, "a": planes(a), "b": planes(b)} for kind, a, b in out if len(a)], schema=_PAIRS)


def _unpacked(batches: Iterator[pa.RecordBatch], reduced: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The pairs in rows of `_tied` (a, b), about `most` at a time, `reduced`."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        a, b = reduced(a, b) if reduced else (a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1), strict=True):
            held.append((from_planes(a.as_py(), "<i8"), from_planes(b.as_py(), "<i8")))
            if sum(len(x) for x, _ in held) >= most:
                yield made()
    if held:
        yield made()


def _unpacked_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _unpacked(batches, stars)


def _unpacked_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sums(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, at = np.unique(a, return_inverse=True)
        return doc, np.bincount(at, weights=b, minlength=len(doc)).astype(np.int64)

    return _unpacked(batches, sums)


# --- the prefix tree ---------------------------------------------------------------------------


class PrefixTree:
    """The sets of one block in a prefix tree, and their join with themselves in one traversal of it.

    Items are numbered by falling frequency in the block and sets are put in lexicographic order, so
    a subtree is a run of sets and an edge is what the run's sets share beyond their parent. A node
    is visited with all sets that can still be similar to one below it, and with how much each of
    them shares with the path from the root: an edge is counted once for all of them. They leave
    when the lengths that remain can't reach the threshold, or when they are in the one component of
    all sets below. The first set, which holds the most frequent items, is met first by all others.
    """

    def __init__(self, sets: Sequence[np.ndarray], percent: int):
        self.percent = percent
        flat = np.concatenate(sets)
        items, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(items), np.int32)
        rank[np.lexsort((items, -counts))] = np.arange(len(items), dtype=np.int32)
        ordered = [np.sort(x) for x in np.split(rank[which], np.cumsum([len(s) for s in sets])[:-1])]
        self.order = sorted(range(len(sets)), key=lambda i: ordered[i].astype(">i4").tobytes())
        self.sets = [ordered[i] for i in self.order]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.items = np.concatenate(self.sets).astype(np.int64)
        self.vocabulary = len(items)
        # where an item occurs
        of = np.repeat(np.arange(len(sets)), self.sizes)
        self.holders = of[np.argsort(self.items, kind="stable")]
        self.held = np.bincount(self.items, minlength=len(items))
        self.first_holder = np.cumsum(self.held) - self.held
        self.keys = of * self.vocabulary + self.items
        self.shared = np.array([0, *(_common(a, b) for a, b in zip(self.sets, self.sets[1:], strict=False))], np.int64)

    def overlaps(self, edge: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """How many of the edge's items each of the sets `alive` holds."""
        held = self.held[edge]
        if held.sum() <= 4 * self.sizes[alive].sum():
            at = np.repeat(self.first_holder[edge] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            return np.bincount(self.holders[at], minlength=len(self.sets))[alive]
        mine = np.zeros(self.vocabulary, bool)
        mine[edge] = True
        sizes = self.sizes[alive]
        at = np.repeat(self.starts[alive] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.add.reduceat(mine[self.items[at]].astype(np.int64), np.cumsum(sizes) - sizes)

    def links(self, component: np.ndarray | None = None, probing: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join the similar sets into their components (only those that join something).

        Sets of one number in `component` are known to be in one; with `probing`, only pairs with at
        least one such set are looked at.
        """
        n, p, size = len(self.sets), self.percent, self.sizes
        comp = np.arange(n) if component is None else np.unique(component[self.order], return_inverse=True)[1]
        asks = np.ones(n, bool) if probing is None else probing[self.order]
        asked = np.concatenate([[0], np.cumsum(asks)])
        found: list[tuple[int, int]] = []
        stack = [(0, n, 0, np.arange(1, n), np.zeros(n - 1, np.int64))]
        while stack:
            lo, hi, depth, alive, overlap = stack.pop()
            keep = alive > lo  # a pair is met at its first set
            least, most, own = size[lo:hi].min(), size[lo:hi].max(), comp[lo:hi]
            if (own == own[0]).all():
                keep &= comp[alive] != own[0]
            if asked[lo] == asked[hi]:
                keep &= asks[alive]
            # the most that any set below can share, against the least that the smallest partner needs
            need = p * (size[alive] + np.maximum(least, -(-size[alive] * p // 100)))
            keep &= (100 + p) * np.minimum(size[alive], overlap + most - depth) >= need
            if not keep.any():
                continue
            alive, overlap, need = alive[keep], overlap[keep], need[keep]
            end = int(self.shared[lo + 1 : hi].min()) if hi - lo > 1 else int(size[lo])
            edge = self.items[self.starts[lo] + depth : self.starts[lo] + end]
            if len(edge):
                overlap = overlap + self.overlaps(edge, alive)
                # what a set has beyond the edge's last item is all that it can still share
                beyond = self.starts[alive] + size[alive] - np.searchsorted(self.keys, alive * self.vocabulary + edge[-1], side="right")
                keep = (100 + p) * (overlap + np.minimum(beyond, most - end)) >= need
                if not keep.any():
                    continue
                alive, overlap = alive[keep], overlap[keep]
            at = lo
            while at < hi and size[at] == end:  # the sets that end here
                similar = alive[(alive > at) & (100 * overlap >= p * (size[alive] + size[at] - overlap)) & (comp[alive] != comp[at])]
                if not asks[at]:
                    similar = similar[asks[similar]]
                if len(similar):
                    other, first = np.unique(comp[similar], return_index=True)
                    found += [(self.order[at], self.order[j]) for j in similar[first].tolist()]
                    merged = np.zeros(n, bool)
                    merged[other] = True
                    comp[merged[comp]] = comp[at]
                at += 1
            if at < hi:
                cuts = [at, *(at + 1 + np.flatnonzero(self.shared[at + 1 : hi] <= end)).tolist(), hi]
                stack.extend((x, y, end, alive, overlap) for x, y in reversed(list(zip(cuts, cuts[1:], strict=False))))
        return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common beginning."""
    m = min(len(a), len(b))
    unlike = a[:m] != b[:m]
    return int(unlike.argmax()) if unlike.any() else m


def block_links(sets: list[np.ndarray], percent: int, component: np.ndarray | None = None, probing: np.ndarray | None = None) -> list[tuple[int, int]]:
    return PrefixTree(sets, percent).links(component, probing)


# --- the join ----------------------------------------------------------------------------------


#: What a meeting of sets gives: _LINK (a, b); of split blocks also _REACHED: set a's place in its part's components, a bit for each leader in it, and the block.
_LINK, _REACHED = range(2)
_MET = "kind byte, a long, b long, block long"
_MET_ROWS = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("block", pa.int64())])
#: A split block's leaders, at most as many as bits are free in a long.
LEADERS = 16
#: The label of the sets that reach the main leader; others have a leader's bit, or none.
_MAIN = -1


def _meet(table: pa.Table, n: int, percent: int) -> pa.Table:
    """The links within each block of a shard. `leader` (if given) numbers the leaders of a split block from 1; `probe` (if given) marks the sets to look at; those it leaves out are known to be in one component."""
    sets, sizes = shingle_sets(table.column("text").combine_chunks(), n)
    parts = np.split(sets, np.cumsum(sizes)[:-1])
    ids, block = table.column("doc_id").to_numpy(), table.column("block").to_numpy()
    staged = "probe" in table.column_names
    probe = table.column("probe").to_numpy(zero_copy_only=False) if staged else None
    component = np.where(probe, np.arange(1, len(probe) + 1), 0) if staged else None
    leader = None if staged else table.column("leader").to_numpy()
    split = None if staged else table.column("split").to_numpy(zero_copy_only=False)
    out: list[tuple] = []
    order = np.lexsort((ids, block))
    for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        own = own[sizes[own] > 0]
        if not len(own):
            continue
        mine = [parts[i] for i in own]
        links = np.array(block_links(mine, percent, component[own], probe[own]) if staged else block_links(mine, percent), np.int64).reshape(-1, 2)
        a, b = ids[own[links[:, 0]]], ids[own[links[:, 1]]]
        out.append((_LINK, a, b, block[own[0]]))
        if not staged and split[own[0]]:
            root, at = np.unique(reached(ids[own], a, b), return_inverse=True)
            bits = np.zeros(len(root), np.int64)
            np.bitwise_or.at(bits, at, np.where(leader[own] > 0, 1 << np.maximum(leader[own] - 1, 0), 0))
            out.append((_REACHED, ids[own][leader[own] == 0], bits[at][leader[own] == 0], block[own[0]]))
    count = [len(x[1]) for x in out]
    cols = [np.repeat(np.array([x[0] for x in out], np.int8), count), *(np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in (1, 2)), np.repeat(np.array([x[3] for x in out], np.int64), count)]
    return pa.table([pa.array(c, t) for c, t in zip(cols, _MET_ROWS.types, strict=True)], schema=_MET_ROWS)


_PLACED = "doc_id long, block long, label long, bytes long, whole boolean, path long"


def _places(batches: Iterator[pa.RecordBatch], n: int, percent: int, levels: np.ndarray, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Where a document (doc_id, text, block, label) may meet others: in its block as a whole, and at each of its paths."""
    for chunk in chunks(batches, chunk_bytes):
        sets, sizes = shingle_sets(chunk.column(1), n)
        paths, of = path_hashes(sets, sizes, percent, levels)
        own = [chunk.column(0), chunk.column(2), chunk.column(3), pc.binary_length(chunk.column(1)).cast(pa.int64())]
        for whole, path, at in ((True, np.zeros(len(sizes), np.uint64), np.arange(len(sizes))), (False, paths, of)):
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at, pa.int64())) for x in own), pa.array(np.full(len(at), whole)), pa.array(path.view(np.int64))], ["doc_id", "block", "label", "bytes", "whole", "path"])


def _parts(block_docs: int, shard_bytes: int) -> Column:
    """Into how many parts so many `docs` of so many `bytes` are split; a part has several times as many sets as there are leaders."""
    return F.ceil(F.greatest(F.lit(1), F.least(F.col("docs") / (4 * LEADERS), F.greatest(F.col("docs") / block_docs, F.col("bytes") / shard_bytes)))).cast("int")


def _meetings(known: DataFrame, n: int, percent: int, levels: Broadcast, block_docs: int, chunk_bytes: int, shard_bytes: int, files: int) -> DataFrame:
    """(place, parts, slices, doc_id): where the documents of split blocks (doc_id, text, block, label, probe) meet again.

    Similar sets share a path, so it is enough that those of one path meet. Paths with the same
    documents are one place, and those whose documents are known to be in one component, by their
    `label`, are none. Where a block's paths together hold more text than its parts would meet, the
    whole block is the place; so a long text isn't copied for each of its paths.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _places(batches, n, percent, levels.value, chunk_bytes)

    at = written(known.select("doc_id", "text", "block", "label").mapInArrow(placed, _PLACED))
    probe = F.coalesce(F.col("label") != _MAIN, F.lit(True))
    met = at.groupBy("block", "whole", "path").agg(
        F.count("*").alias("docs"), F.count_if(probe).alias("probes"), F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(probe, F.col("bytes"))), F.lit(0)).alias("asking"),
        F.bit_xor(F.xxhash64("doc_id")).alias("some"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("other"), F.count("label").alias("labelled"), F.min("label").alias("least"), F.max("label").alias("most"),
    )
    met = met.filter("docs > 1 AND (labelled < docs OR least <> most)")
    once = met.groupBy("block", "whole", "docs", "probes", "bytes", "asking", "some", "other").agg(F.min("path").alias("path"))
    sized = once.withColumn("parts", _parts(block_docs, shard_bytes)).withColumn("slices", F.ceil(F.col("probes") / block_docs).cast("int"))
    sent = F.when(F.col("parts") == 1, F.col("bytes") * F.col("slices")).otherwise(F.col("bytes") * F.col("slices") + F.col("asking") * F.col("parts"))
    sized = written(sized.select("block", "whole", "path", "parts", "slices", sent.alias("sent")), files)
    cost = sized.groupBy(F.col("block").alias("of")).agg(F.sum(F.when(F.col("whole"), F.col("sent"))).alias("together"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("sent"))), F.lit(0)).alias("by_path"))
    chosen = sized.join(cost.select("of", (F.col("by_path") > F.col("together")).alias("as_one")), F.col("block") == F.col("of")).filter("whole = as_one").drop("of", "as_one", "sent")
    return at.join(chosen, ["block", "whole", "path"]).select(F.xxhash64("block", "whole", "path").alias("place"), "parts", "slices", F.col("doc_id").alias("of"))


def similar_links(texts: DataFrame, members: DataFrame, shares: DataFrame, levels: Broadcast, n: int, percent: int, block_docs: int, chunk_bytes: int, shard_bytes: int, files: int) -> DataFrame:
    """Links (a, b) among the texts (doc_id, text) of the members (doc_id, block).

    A block of more than `block_docs` documents or `shard_bytes` of text is split into parts. Its
    leaders, the documents that share the most paths (doc_id, shares), go to all of them; a set that
    doesn't reach the leader that most sets reach then meets those of its paths, or all parts.
    """
    # members grow with the texts, so they are merged at every size
    held = written(texts.join(members.hint("merge"), "doc_id"), 4 * files)
    sizes = held.groupBy(F.col("block").alias("of")).agg(F.count("*").alias("docs"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).filter("docs > 1")
    counted = written(sizes.select("of", _parts(block_docs, shard_bytes).alias("parts"), "bytes"), files)
    in_blocks, most = counted.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("parts"), F.lit(0))).first()
    shards = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-in_blocks // shard_bytes))
    placed = held.join(counted.drop("bytes"), F.col("block") == F.col("of")).drop("of")

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table, n, percent)

    whole = placed.filter("parts = 1").select("doc_id", "text", "block", F.lit(0).cast("long").alias("leader"), F.lit(False).alias("split"), F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard"))
    if most <= 1:
        return written(whole.groupBy("shard").applyInArrow(meet, _MET)).select("a", "b")
    split = written(placed.filter("parts > 1").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")), 4 * files)
    by_share = Window.partitionBy("block").orderBy(F.desc("shares"), "doc_id")
    ranked = split.select("doc_id", "block").join(shares, "doc_id", "left").withColumn("leader", F.row_number().over(by_share).cast("long"))
    leaders = ranked.filter(F.col("leader") <= LEADERS).select(F.col("doc_id").alias("_led"), "leader")
    marked = split.join(leaders, F.col("doc_id") == F.col("_led"), "left").withColumn("leader", F.coalesce("leader", F.lit(0).cast("long")))
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = marked.withColumn("part", F.explode(F.when(F.col("leader") > 0, everywhere).otherwise(F.array("part"))))
    apart = lambda *of: F.lit(shards) + F.abs(F.xxhash64("block", *of) % (1 << 40))
    of_parts = dealt.select("doc_id", "text", "block", "leader", F.lit(True).alias("split"), apart("part").alias("shard"))
    first = written(whole.unionByName(of_parts).groupBy("shard").applyInArrow(meet, _MET))
    # The leader that most sets reach, and the sets that don't.
    arrived = first.filter(F.col("kind") == _REACHED).select(F.col("a").alias("of"), F.col("b").alias("bits"), F.col("block").alias("in"))
    votes = arrived.select("in", "bits", F.explode(F.sequence(F.lit(0), F.lit(LEADERS - 1))).alias("bit")).filter(F.getbit("bits", "bit") == 1).groupBy("in", "bit").count()
    main = votes.groupBy("in").agg(F.max_by("bit", F.struct("count", "bit")).alias("main")).withColumnRenamed("in", "at")
    # sets of one label are in one component
    label = F.when(F.getbit("bits", "main") == 1, F.lit(_MAIN)).when(F.col("bits") != 0, F.col("bits").bitwiseAND(-F.col("bits"))).cast("long")
    labels = arrived.join(main, F.col("in") == F.col("at"), "left").select("of", label.alias("label"))
    # Leaders have met all. A set that didn't reach the main one meets others again; the rest are known to be in one component.
    known = split.join(leaders, F.col("doc_id") == F.col("_led"), "left_anti").join(labels, F.col("doc_id") == F.col("of"), "left")
    known = written(known.select("doc_id", "text", "block", "label", F.coalesce(F.col("label") != _MAIN, F.lit(True)).alias("probe")), 4 * files)
    places = written(_meetings(known, n, percent, levels, block_docs, chunk_bytes, shard_bytes, files), 4 * files)
    both = known.drop("block", "label").join(places.hint("merge"), F.col("doc_id") == F.col("of")).drop("of")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    cell = lambda slice, part: F.struct(slice.cast("int").alias("slice"), part.cast("int").alias("part"))
    own = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: cell(s, part))
    across = F.transform(everywhere, lambda p: cell(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("slices")), p))
    again = both.withColumn("cell", F.explode(F.when(F.col("probe"), F.array_union(own, across)).otherwise(own)))
    shard = F.when((F.col("parts") == 1) & (F.col("slices") == 1), F.pmod(F.xxhash64("place"), F.lit(shards))).otherwise(F.lit(shards) + F.abs(F.xxhash64("place", "cell") % (1 << 40)))
    second = again.select("doc_id", "text", F.col("place").alias("block"), "probe", shard.alias("shard")).groupBy("shard").applyInArrow(meet, _MET)
    return first.filter(F.col("kind") == _LINK).select("a", "b").unionByName(written(second).select("a", "b"))


def similarity_components(docs: DataFrame, n: int = 5, percent: int = 80, block_docs: int = 1024, chunk_bytes: int = 4 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs` (doc_id, text).

    Documents link if 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id that
    links reach. A text of fewer than n words has its whole sequence as its one shingle; a null text,
    or one without words, has none and links with nothing. Rows that repeat a doc_id count as one
    document and are returned each; a null doc_id links with nothing and keeps a null component. An
    empty table gives an empty one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = text_bytes(texts)
    buckets, files = groups_of(texts.sparkSession, total, 4 * chunk_bytes), files_of(texts.sparkSession, total, 64 << 20)
    levels = texts.sparkSession.sparkContext.broadcast(frequency_levels(texts, n, chunk_bytes, max(4, math.isqrt(buckets))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _path_rows(batches, n, percent, levels.value, buckets, chunk_bytes)

    pairs = written(texts.mapInArrow(cut, "bucket int, kind byte, docs binary, index binary, hashes binary").groupBy("bucket").applyInArrow(_tied, "kind byte, a binary, b binary"))
    of = lambda *kinds: pairs.filter(F.col("kind").isin(*kinds)).select("a", "b")
    same = of(_SAME).mapInArrow(_unpacked, "a long, b long")
    shares = of(_SHARES).mapInArrow(_unpacked_sums, "a long, b long").groupBy(F.col("a").alias("doc_id")).agg(F.sum("b").alias("shares"))
    blocks = connected(of(_TIED, _SAME).mapInArrow(_unpacked_stars, "a long, b long"), files)
    # Of equal sets only the smallest document meets others.
    members = blocks.join(same.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
    links = similar_links(texts, members, shares, levels, n, percent, block_docs, chunk_bytes, shard_bytes, files)
    labels = connected(links.unionByName(same), files)
    # A size below zero marks a row without doc_id.
    rows = of(_SIZE).mapInArrow(_unpacked, "a long, b long").select(F.when(F.col("b") >= 0, F.col("a")).alias("doc_id"), F.when(F.col("b") >= 0, F.col("b")).otherwise(-1 - F.col("b")).alias("n_shingles"))
    return rows.join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
