"""Merkle manifests against a recursive computation, on odd rows and trees of every height."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle
from sparkloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def grown(digests):
    """The root, and each leaf's steps as (left, right) pairs."""
    steps, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[k : k + 16] for k in range(0, len(digests), 16)]
        for leaf, place in enumerate(at):
            run, pos = runs[place // 16], place % 16
            steps[leaf].append(("".join(run[:pos]), "".join(run[pos + 1 :])))
            at[leaf] = place // 16
        digests = [sha("".join(r)) for r in runs]
    return digests[0], steps


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, *grown([leaf_of(r) for r in own])))
    root, above = grown([t[1] for t in trees])
    out = []
    for (own, subroot, steps), upper in zip(trees, above, strict=True):
        for row, lower in zip(own, steps, strict=True):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                changed = (row[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            folded = leaf_of(changed)
            for left, right in lower + upper:
                folded = sha(left + folded + right)
            out.append((row[0], leaf_of(row), subroot, root, sha("".join(a + b for a, b in lower + upper)), folded, folded == root))
    return out


def tables():
    rng = random.Random(3)
    text = lambda: rng.choice([None, "", "Abc É", "plain", "x" * 50_000, "ZZ top"]) or rng.choice([None, "", "Q"])
    row = lambda k, source: (k, text(), rng.choice([None, "en", "日本"]), source, rng.choice([None, 7]))
    yield "one", [(5, "Only", None, None, 4)]
    yield "one of each of many", [row(k, f"s{k}") for k in range(40)]
    yield "one source", [row(k, "hot") for k in range(300)]
    yield "lone, full and short runs", [row(k, s) for s, n in ((None, 1), ("", 16), ("a", 17), ("b", 257), ("é", 273), ("Z", 2)) for k in range(n)]
    yield "ties, repeats and null ids", [row(rng.choice([None, 1, 2]), "t") for _ in range(60)] + [(9, "Same", "en", "t", 1)] * 20
    yield "more than 256 sources", [row(k, f"{k % 300}") for k in range(900)]


@pytest.mark.parametrize("name,rows", list(tables()))
def test_manifest_is_the_recursive_one(spark, tmp_path, name, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "a.b": F.lit(2), "index": F.lit(3)})
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(rows), key=repr)
    assert any(r.verified for r in got) or name == "one"


def test_ancestors_of_many_nodes_are_copied(spark, monkeypatch):
    monkeypatch.setattr(merkle, "NODES_A_COPY", 3)
    rows = [(k, "Text", "en", "hot" if k % 3 else f"s{k % 7}", k) for k in range(5000)]
    made = merkle.merkle_proofs(spark.createDataFrame(rows, SCHEMA))
    got = made.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("steps")), merkle.folded(F.col("leaf"), F.col("steps")) == F.col("root")).collect()
    assert sorted(tuple(r) for r in got) == sorted((*x[:5], True) for x in expected(rows))
