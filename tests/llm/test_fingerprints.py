"""Fingerprints against exact Jaccard coefficients, near copies against all pairs."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparkloom.llm import minhash
from sparkloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def texts(rng, n):
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünïcode", "日本語", "😀", "WORD", "a b"]
    made = [None, "", "\t\n", "one", "one", "Two words", "x " * 40_000]
    while len(made) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))]
        made += [" ".join(base), "  ".join(base)]
        for _ in range(rng.randrange(3)):
            base[rng.randrange(len(base))] = "changed"
            made.append(" ".join(base))
    rng.shuffle(made)
    return made[:n]


@pytest.mark.parametrize("ids", ["different", "one", "ties and nulls"])
def test_edited_fingerprints(spark, tmp_path, ids):
    rng = random.Random(6)
    made = texts(rng, 1 if ids == "one" else 150)
    key = {"different": lambda k: k * 3 - 50, "one": lambda k: 4, "ties and nulls": lambda k: None if k % 3 == 0 else k // 10}[ids]
    rows = [(key(k), t, "en", "s", None if t is None else len(t)) for k, t in enumerate(made)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS kind", "3 AS `a.b`").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.n_chars) for r in got) == sorted((repr(d), len(t or "")) for d, t, *_ in rows)
    prints = {}
    for r in got:
        assert len(r.fingerprint) == 512 == len(r.edited_fingerprint) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    if ids == "ties and nulls":
        assert len({r.fingerprint for r in got}) <= len({frozenset(shingles(t)) for t in made})
        return
    order = sorted(rows)
    for (d, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        (r,) = (r for r in got if r.doc_id == d)
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(t, new)) < 0.2 and abs(r.near_next - jaccard(t, after)) < 0.2
        assert prints.setdefault(frozenset(shingles(t)), r.fingerprint) == r.fingerprint
        assert prints.setdefault(frozenset(shingles(new)), r.edited_fingerprint) == r.edited_fingerprint


def test_estimates_are_unbiased():
    rng, errors = random.Random(8), []
    made = minhash.MinHash()
    for _ in range(60):
        a = [f"w{rng.randrange(9999)}" for _ in range(200)]
        b = list(a)
        for _ in range(rng.randrange(12)):
            b[rng.randrange(200)] = "other"
        a, b = " ".join(a), " ".join(b)
        x, y = made.of([a, b])
        errors.append((x == y).mean() - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    made = texts(rng, 250)
    ids = [k * 7 for k in range(len(made))]
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(made):
        for k in range(i):
            if shingles(a) and shingles(made[k]) and jaccard(a, made[k]) >= 0.8:
                x, y = root(ids[i]), root(ids[k])
                parent[max(x, y)] = min(x, y)
    rows = [(d, t, "en", "s", 0) for d, t in zip(ids, made, strict=True)]
    got = minhash.near_duplicates(spark.createDataFrame([*rows, rows[0], (None, made[0], None, None, 0)], SCHEMA).repartition(5)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, root(d)) for d in ids} and len(got) == len(ids)
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
