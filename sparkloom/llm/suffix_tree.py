"""Language-model scores from a probabilistic suffix tree over words.

A text is its lower-cased (A-Z) words, then one end symbol. The tree's states are the contexts, the
last 1 to `depth` words of a text, that divergence tests retain. It is grown level by level: only
below a state are longer contexts looked at, and one stays that occurs `min_count` times in training
texts and whose next-symbol distribution gains over `min_gain` nats on its suffix's, summed over the
training symbols that follow it. The distribution of a context seen n times is smoothed towards its suffix's with the weight
n ** SMOOTH / (n + n ** SMOOTH), as the different words after it grow with their number; the
uppermost towards a unigram that leaves a share to unknown words. Each symbol is scored in the
longest suffix that is a state.

Texts are read once and kept as chunks of word numbers. What a chunk has to know about the corpus it
asks for in rounds: of each of its different words, the training count; then, for each level, of
each different (context, symbol) below a state, the training count, the context's, and whether it
stays. Contexts are dealt by their hash, those too frequent for one bucket by their symbols too; the
parts of such a context's gain are added up where its hash is dealt, which tells the chunks that
hold it. A chunk sends each key once at most, so no group grows with a word's frequency and nobody
holds the model whole. Counts cover all training texts. The driver sees three totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bucket_of, chunks, files_of, from_planes, groups_of, hash_words, joined, mix, planes, text_bytes, word_spans, written

DEPTH = 2
SMOOTH = 0.75
#: The end symbol among word hashes.
_END = np.uint64(0xE17D5EED)

#: Rows of chunks and their messages. _STATE: words by their numbers in the chunk, doc ids, each number's place among
#: the answers, and four times each text's symbols, plus 1 in training, plus 2 without an id. _WORDS, _FOLLOWED, _SPLIT
#: (of contexts dealt by their symbols too): keys' first numbers, training counts, second numbers, the suffix's
#: probability (at level 1 the symbol's training count, which tells it), and for _SPLIT each context's count. Answers, of the same kinds: for each key, and for each run of keys
#: of one first number. _JUDGED: the _SPLIT contexts of a chunk, and whether they stay. _GAIN: contexts and their gains
#: in one bucket. _SUMS: a bucket's symbols, different ones and highest number.
_STATE, _WORDS, _FOLLOWED, _SPLIT, _JUDGED, _GAIN, _SUMS = range(7)
_ROWS = pa.schema([("kind", pa.int8()), ("part", pa.int64()), ("level", pa.int8()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
_ROWS_SQL = "kind byte, part long, level byte, bucket int, a binary, b binary, c binary, d binary, e binary"
#: The part of rows that are for no chunk.
_NONE = -1


def _squeezed(x: np.ndarray) -> bytes:
    """The numbers in planes of as few bytes as they need, compressed; negative ones only in eight."""
    kind = "<i8" if x.size and x.min() < 0 else next(k for k, most in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if not x.size or int(x.max()) < most)
    return kind.encode() + zstandard.ZstdCompressor(level=7).compress(planes(x.astype(kind)))


def _opened(raw: bytes) -> np.ndarray:
    kind = raw[:3].decode()
    x = from_planes(zstandard.ZstdDecompressor().decompress(raw[3:]), kind)
    return x if kind == "<u8" else x.astype(np.int64)


def _row(kind: int, part: int, level: int, bucket: int, *cells: bytes | None) -> dict:
    return dict(zip(_ROWS.names, (kind, part, level, bucket, *cells, *[None] * (5 - len(cells))), strict=True))


class _Keys:
    """Different keys in order, each of two numbers: a context's and a symbol's, or a word's and none; `which` is each place's key.

    A key is dealt by its first number, so that keys of one context meet and travel in few bytes,
    but by both if `split`, for contexts more frequent than a bucket should hold.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray, buckets: int, split: bool = False):
        order = np.lexsort((second, first)) if second.any() else np.argsort(first, kind="stable")
        p, o = first[order], second[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
        self.which = np.empty(len(p), np.int64)
        self.which[order] = np.cumsum(new) - 1
        #: a place of each key
        self.at = order[new]
        p, o = p[new], o[new]
        bucket = bucket_of(mix(p ^ mix(o + np.uint64(1)) if split else p), buckets)
        #: from the order in which they are dealt, by bucket and key, to the order of the keys
        self.order = np.argsort(bucket, kind="stable")
        self.first, self.second = p[self.order], o[self.order]
        dealt = bucket[self.order]
        self.buckets, begin = np.unique(dealt, return_index=True)
        self.bounds = [*begin.tolist(), len(p)]
        #: each run of keys of one first number in a bucket
        run = np.ones(len(p), bool)
        run[1:] = (self.first[1:] != self.first[:-1]) | (dealt[1:] != dealt[:-1])
        self.run = np.cumsum(run) - 1

    def __len__(self) -> int:
        return len(self.order)

    def asked(self, kind: int, part: int, level: int, seen: np.ndarray | None = None, suffix: np.ndarray | None = None, total: np.ndarray | None = None) -> list[dict]:
        """A row for each bucket: what is known of each key here, and of each run the `total`."""
        seen, suffix, total = (None if x is None else x[self.order] for x in (seen, suffix, total))
        out = []
        for k, i, j in zip(self.buckets.tolist(), self.bounds, self.bounds[1:], strict=False):
            out.append(_row(
                kind, part, level, k, _squeezed(np.diff(self.first[i:j], prepend=np.uint64(0))),
                None if seen is None else _squeezed(seen[i:j]),
                None if suffix is None else _squeezed(_steps(self.second[i:j], _begins(self.run[i:j]))),
                None if suffix is None else _squeezed(suffix[i:j] if suffix.dtype.kind == "i" else suffix[i:j].astype("<f4").view("<u4")),
                None if total is None else _squeezed(total[i:j][_begins(self.run[i:j])]),
            ))
        return out

    def answers(self, told: dict[tuple, dict], kind: int, level: int, of_runs: bool = False) -> np.ndarray:
        """What was answered for each place's key, or for its run."""
        if not len(self):
            return np.zeros(0, np.int64)
        x = np.concatenate([_opened(told[kind, level, k]["b" if of_runs else "a"]) for k in self.buckets.tolist()])
        out = np.empty(len(self), np.int64)
        out[self.order] = x[self.run] if of_runs else x
        return out[self.which]


def _begins(run: np.ndarray) -> np.ndarray:
    """Where another number than the one before stands."""
    return np.concatenate([[True], run[1:] != run[:-1]])


def _steps(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Differences inside runs of rising numbers; each run's first number as it is."""
    return np.where(begins, x, np.diff(x, prepend=np.uint64(0)))


def _climbed(steps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The numbers of which `_steps` gave the differences."""
    sums = np.cumsum(steps, dtype=np.uint64)
    return sums - (sums - steps)[begins][np.cumsum(begins) - 1]


def _unigram(count: np.ndarray, train_tokens: int, vocabulary: int) -> np.ndarray:
    return (count + 0.1) / (train_tokens + 0.1 * (vocabulary + 1))


def _added_up(rows: list[dict]) -> tuple[_Keys, np.ndarray, list[np.ndarray]]:
    """(keys, summed counts, each row's places in the keys) of the rows of one kind, level and bucket."""
    first = [np.cumsum(_opened(r["a"]).astype(np.uint64), dtype=np.uint64) for r in rows]
    second = [_climbed(_opened(r["c"]).astype(np.uint64), _begins(p)) if r["c"] else np.zeros(len(p), np.uint64) for r, p in zip(rows, first, strict=True)]
    lens = [len(p) for p in first]
    keys = _Keys(np.concatenate(first), np.concatenate(second), 1)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, keys.which, np.concatenate([_opened(r["b"]) for r in rows]))
    return keys, sums, np.split(keys.which, np.cumsum(lens)[:-1])


# --- what a chunk does ---------------------------------------------------------------------------


def _read(batches: Iterator[pa.RecordBatch], buckets: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's state, and its different words with their training counts."""
    base, serial = TaskContext.get().partitionId() << 32, 0
    for chunk in chunks(batches, chunk_bytes):
        buf, ends = joined(chunk.column(1), lower=True)
        starts, lens, counts = word_spans(buf, ends)
        symbols = np.insert(hash_words(buf, starts, lens), np.cumsum(counts), _END)
        train = chunk.column(2).to_numpy(zero_copy_only=False)
        ids = chunk.column(0)
        words = _Keys(symbols, np.zeros(len(symbols), np.uint64), buckets)
        seen = np.bincount(words.which, weights=np.repeat(train, counts + 1), minlength=len(words)).astype(np.int64)
        # words are numbered by their frequency, which takes the fewest bytes; the answers come in the order of asking
        by_count = np.argsort(-np.bincount(words.which, minlength=len(words)), kind="stable")
        number, told = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        number[by_count] = told[words.order] = np.arange(len(words))
        sizes = (counts + 1) * 4 + train + 2 * ids.is_null().to_numpy(zero_copy_only=False)
        state = _row(_STATE, base + serial, 0, 0, _squeezed(number[words.which]), _squeezed(ids.fill_null(0).to_numpy(zero_copy_only=False)), _squeezed(told[by_count]), _squeezed(sizes))
        yield pa.RecordBatch.from_pylist([state, *words.asked(_WORDS, base + serial, 0, seen)], schema=_ROWS)
        serial += 1


class _Chunk:
    """A chunk with what it has been told so far."""

    def __init__(self, state: dict, told: list[dict], buckets: int, depth: int, bits: int, train_tokens: int, vocabulary: int):
        self.part, self.buckets, self.depth, self.made = state["part"], buckets, depth, {}
        sizes = _opened(state["d"])
        self.ids, self.sizes, self.train, self.unnamed = _opened(state["b"]), sizes // 4, sizes % 2 == 1, sizes % 4 >= 2
        self.told = {(r["kind"], r["level"], r["bucket"]): r for r in told}
        which = _opened(state["c"])[_opened(state["a"])]
        words = [self.told[k] for k in sorted(k for k in self.told if k[0] == _WORDS)]
        known, number = (np.concatenate([_opened(r[cell]) for r in words]) for cell in ("a", "b"))
        self.count, number = known[which], number[which].astype(np.uint64)
        self.learns = np.repeat(self.train, self.sizes)
        self.place = np.arange(len(which)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.unigram = _unigram(self.count, train_tokens, vocabulary)
        self.number, self.bits, self.share = number, bits, train_tokens // buckets

    def contexts(self, at: np.ndarray, k: int) -> np.ndarray:
        """The numbers of the k words before the places: put together if that fits, else a hash."""
        out = self.number[at - 1]
        for j in range(2, k + 1):
            word = self.number[at - j]
            out = out + (word << np.uint64((j - 1) * self.bits)) if k * self.bits <= 64 else mix(out ^ mix(word + np.uint64(j)))
        return out

    def grown(self, level: int, min_count: int) -> tuple[np.ndarray, list[dict]]:
        """(each symbol's P in the tree of the levels before `level`, what is asked for at `level`)."""
        p, ended = self.unigram, self.count
        open_ = np.ones(len(p), bool)
        for k in range(1, self.depth + 1):
            at = np.flatnonzero(open_ & (self.place >= k))
            # A context occurs as often as its last word after the others; -1 if that wasn't asked for, 0 if it is rare.
            n, counted = ended[at - 1], np.full(len(p), -1)
            counted[at] = 0
            candidate = (n < 0) | (n >= min_count)
            at, n = at[candidate], n[candidate]
            context, symbol, heavy = self.contexts(at, k), self.number[at], n > self.share
            few = _Keys(context[~heavy], symbol[~heavy], self.buckets)
            many = _Keys(context[heavy], symbol[heavy], self.buckets, split=True)
            judged = _Keys(context[heavy], np.zeros(np.count_nonzero(heavy), np.uint64), self.buckets)
            if k == level:
                seen = lambda keys, at: np.bincount(keys.which, weights=self.learns[at], minlength=len(keys)).astype(np.int64)
                suffix = self.count if k == 1 else p
                asked = few.asked(_FOLLOWED, self.part, k, seen(few, at[~heavy]), suffix[at[~heavy]][few.at])
                asked += many.asked(_SPLIT, self.part, k, seen(many, at[heavy]), suffix[at[heavy]][many.at], n[heavy][many.at])
                return p, asked + judged.asked(_JUDGED, self.part, k)
            count, total = np.empty((2, len(at)), np.int64)
            count[~heavy], total[~heavy] = (few.answers(self.told, _FOLLOWED, k, of_runs) for of_runs in (False, True))
            count[heavy], total[heavy] = many.answers(self.told, _SPLIT, k), n[heavy] * judged.answers(self.told, _JUDGED, k)
            counted[at] = count
            ended = counted
            stays = total > 0
            at, count, total = at[stays], count[stays], total[stays]
            p = p.copy()
            p[at] = _smoothed(count, total, p[at])
            open_ = np.zeros(len(p), bool)
            open_[at] = True
        return p, []

    def scores(self, min_count: int) -> pa.Table:
        p, _ = self.grown(self.depth + 1, min_count)
        first = np.cumsum(self.sizes) - self.sizes
        sums = lambda x: np.add.reduceat(x, first) if len(first) else x
        cols = [pa.array(self.ids, mask=self.unnamed), pa.array(self.train), pa.array(self.sizes), pa.array(sums((self.count > 0).astype(np.int64))), pa.array(sums(np.log10(self.unigram))), pa.array(sums(np.log10(p)))]
        return pa.table(cols, schema=_SCORES)


def _smoothed(count: np.ndarray, total: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    weight = total.astype(float) ** SMOOTH
    return (count + weight * suffix) / (total + weight)


_SCORES = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


# --- what ranges of keys do ----------------------------------------------------------------------


def _count_words(table: pa.Table, buckets: int) -> pa.Table:
    """Each asked word's training count and number; frequent words have small numbers. One row has the bucket's symbols, different ones and highest number."""
    rows = table.to_pylist()
    keys, counts, places = _added_up(rows)
    bucket = rows[0]["bucket"]
    number = np.empty(len(keys), np.int64)
    number[np.lexsort((keys.first, -counts))] = np.arange(len(keys)) * buckets + bucket
    out = [_row(_WORDS, r["part"], 0, bucket, _squeezed(counts[p]), _squeezed(number[p])) for r, p in zip(rows, places, strict=True)]
    out.append(_row(_SUMS, _NONE, 0, bucket, b"%d %d %d" % (counts.sum(), np.count_nonzero(counts), number.max())))
    return pa.Table.from_pylist(out, schema=_ROWS)


def _gain(keys: _Keys, count: np.ndarray, total: np.ndarray, rows: list[dict], begin: np.ndarray, sums: tuple[int, int]) -> np.ndarray:
    """What each run of keys gains on its suffix; `total` is that of each key's context, `sums` are training tokens and different ones."""
    told = np.concatenate([_opened(r["d"]) for r in rows])[keys.at]
    suffix = _unigram(told, *sums) if rows[0]["level"] == 1 else told.astype("<u4").view("<f4").astype(float)
    return np.add.reduceat(count * np.log(_smoothed(count, np.maximum(total, 1), suffix) / suffix), begin)


def _test_contexts(table: pa.Table, min_gain: float, min_count: int, sums: tuple[int, int]) -> pa.Table:
    """Each asked key's training count, and each whole context's if it stays, else 0."""
    out = []
    for kind in (_FOLLOWED, _SPLIT):
        if not (rows := [r for r in table.to_pylist() if r["kind"] == kind]):
            continue
        keys, count, places = _added_up(rows)
        begin = np.flatnonzero(_begins(keys.run))
        total = np.add.reduceat(count, begin)
        if kind == _FOLLOWED:
            total[(_gain(keys, count, total[keys.run], rows, begin, sums) <= min_gain) | (total < min_count)] = 0
        for r, p in zip(rows, places, strict=True):
            run = keys.run[p]
            out.append(_row(kind, r["part"], r["level"], r["bucket"], _squeezed(count[p]), _squeezed(total[run[_begins(run)]]) if kind == _FOLLOWED else None))
    return pa.Table.from_pylist(out, schema=_ROWS)


def _split_gains(table: pa.Table, buckets: int, sums: tuple[int, int]) -> pa.Table:
    """The gains that the bucket's keys of split contexts make, dealt by the contexts; questions about such contexts as they are."""
    out, rows = ([r for r in table.to_pylist() if r["kind"] == kind] for kind in (_JUDGED, _SPLIT))
    if rows:
        keys, count, places = _added_up(rows)
        begin = np.flatnonzero(_begins(keys.run))
        total = np.concatenate([_opened(r["e"])[np.cumsum(_begins(keys.run[p])) - 1] for r, p in zip(rows, places, strict=True)])[keys.at]
        context, gain = keys.first[begin], _gain(keys, count, total, rows, begin, sums)
        bucket = bucket_of(mix(context), buckets)
        for k in np.unique(bucket).tolist():
            out.append(_row(_GAIN, _NONE, rows[0]["level"], k, context[bucket == k].tobytes(), gain[bucket == k].tobytes()))
    return pa.Table.from_pylist(out, schema=_ROWS)


def _judge(table: pa.Table, min_gain: float) -> pa.Table:
    """For each asked context 1 if the gains of all its parts come to more than `min_gain`, else 0."""
    asked, parts = ([r for r in table.to_pylist() if r["kind"] == kind] for kind in (_JUDGED, _GAIN))
    if not asked:
        return _ROWS.empty_table()
    context, which = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in parts]), return_inverse=True)
    stays = (np.bincount(which, weights=np.concatenate([np.frombuffer(r["b"], float) for r in parts])) > min_gain).astype(np.int64)
    out = []
    for r in asked:
        own = np.cumsum(_opened(r["a"]).astype(np.uint64), dtype=np.uint64)
        out.append(_row(_JUDGED, r["part"], r["level"], r["bucket"], _squeezed(stays[np.searchsorted(context, own)])))
    return pa.Table.from_pylist(out, schema=_ROWS)


def suffix_tree_scores(docs: DataFrame, train: Column, depth: int = DEPTH, min_gain: float = 3.0, min_count: int = 4, chunk_bytes: int = 8 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, text).

    `train` marks the rows to learn from. `score` is the tree's log10 probability of the text;
    `base_score` that of a smoothed unigram model. n_tokens counts the words and one end, n_known
    those that occur in training texts. A null text has no words; a null doc_id stays null (a null
    `train` is false); rows that repeat a doc_id are scored each, and so are rows of equal texts; an
    empty table gives an empty one; without training rows every symbol has the probability 1.
    Words are told apart by 64-bit hashes, contexts whose numbers don't fit 64 bits by 64-bit ones.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    total = text_bytes(marked)
    buckets, files = groups_of(spark, total, bucket_bytes), files_of(spark, total, 64 << 20)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read(batches, buckets, chunk_bytes)

    def count_words(table: pa.Table) -> pa.Table:
        return _count_words(table, buckets)

    def test_contexts(table: pa.Table) -> pa.Table:
        return _test_contexts(table, min_gain, min_count, (n, v))

    def split_gains(table: pa.Table) -> pa.Table:
        return _split_gains(table, buckets, (n, v))

    def judge(table: pa.Table) -> pa.Table:
        return _judge(table, min_gain)

    made = written(marked.mapInArrow(read, _ROWS_SQL))
    # Every table for the chunks is dealt by them once; a union of tables dealt alike isn't dealt again
    # (unless one is filtered by `part`, which makes that column another kind, never null).
    dealt = lambda told: told.repartition(buckets, "part")
    states = dealt(made.filter(F.col("kind") == _STATE))
    words = written(made.filter(F.col("kind") == _WORDS).groupBy("bucket").applyInArrow(count_words, _ROWS_SQL), files)
    sums = F.split(F.col("a").cast("string"), " ")
    n, v, highest = words.filter(F.col("kind") == _SUMS).agg(*(F.coalesce(f(sums[k].cast("long")), F.lit(0)) for k, f in enumerate((F.sum, F.sum, F.max)))).first()
    bits = max(1, int(highest).bit_length())

    def chunk(state: pa.Table, told: pa.Table) -> _Chunk:
        return _Chunk(state.to_pylist()[0], told.to_pylist(), buckets, depth, bits, n, v)

    def asks(level: int):
        def ask(state: pa.Table, told: pa.Table) -> pa.Table:
            return pa.Table.from_pylist(chunk(state, told).grown(level, min_count)[1] if state.num_rows else [], schema=_ROWS)

        return ask

    def score(state: pa.Table, told: pa.Table) -> pa.Table:
        return chunk(state, told).scores(min_count) if state.num_rows else _SCORES.empty_table()

    def with_chunks(told: DataFrame):
        return states.groupBy("part").cogroup(told.groupBy("part"))

    told = dealt(words.filter(F.col("kind") == _WORDS))
    for level in range(1, depth + 1):
        asked = with_chunks(told).applyInArrow(asks(level), _ROWS_SQL).groupBy("bucket")
        parts = asked.applyInArrow(split_gains, _ROWS_SQL).groupBy("bucket")
        told = told.unionByName(dealt(asked.applyInArrow(test_contexts, _ROWS_SQL).unionByName(parts.applyInArrow(judge, _ROWS_SQL))))
    scored = with_chunks(told).applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
