"""Blocks of documents that are tied by lines that many have, without being similar."""

import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import jaccard
from test_brute_force import components


def template_rows(count, own=14):
    """Texts of four lines that about a hundred have, and `own` words of their own."""
    rng = random.Random(count)
    lines = [" ".join(f"c{i}x{k}" for k in range(10)) for i in range(count // 25)]
    return [(i, " ".join([*rng.sample(lines, 4), *(f"u{i}x{k}" for k in range(own))])) for i in range(count)]


def test_ties_without_likeness_copy_no_text_to_all_parts(spark, monkeypatch):
    docs = {n: spark.createDataFrame(template_rows(n), "doc_id long, text string").coalesce(4) for n in (300, 1200)}
    met, group_by = [], type(docs[300]).groupBy

    def counted(self, *cols):
        met.extend([self.count()] if all(isinstance(c, str) and c == "shard" for c in cols) else [])
        return group_by(self, *cols)

    monkeypatch.setattr(type(docs[300]), "groupBy", counted)
    # one level for all shingles: nothing but the places where texts meet keeps their copies few
    monkeypatch.setattr(jaccard, "frequency_levels", lambda *_: np.full(jaccard.TABLE, 66, np.uint8))
    copies = {}
    for n, frame in docs.items():
        met.clear()
        got = jaccard.similarity_components(frame, 5, 80, block_docs=128).collect()
        copies[n] = sum(met)
        if n == 300:
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(template_rows(n), 5, 80)
    assert copies[1200] < 6 * copies[300], copies


def test_paths_of_a_rare_shingle_come_before_those_of_common_ones():
    rows = template_rows(1000, 60)
    sets, sizes = jaccard.shingle_sets(pa.array([t for _, t in rows]), 5)
    slots, times = np.unique((sets & np.uint64(jaccard.TABLE - 1)).astype(np.int64), return_counts=True)
    levels = np.zeros(jaccard.TABLE, np.uint8)
    levels[slots] = np.minimum(255, 8 * np.log2(1.0 + times)).astype(np.uint8)
    paths, _ = jaccard.path_hashes(sets, sizes, 80, levels)
    _, which, count = np.unique(paths, return_inverse=True, return_counts=True)
    assert (count[which] > 1).mean() < 0.01
