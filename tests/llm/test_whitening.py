"""Whitening against integers of any size and a plain eigendecomposition."""

import math
import random

import numpy as np
import pytest

from sparkloom.llm import whitening
from sparkloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors, most=8):
    """n, deviations, eigenvalues, vectors, trace and centred rows from Python integers."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, size = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(size)]
    dev = [[n * r[d] - s[d] for d in range(size)] for r in x]
    cov = np.array([[sum(a[i] * a[j] for a in dev) / n**3 for j in range(size)] for i in range(size)])
    e, v = np.linalg.eigh(cov)
    return n, [sum(a * a for a in r) for r in dev], e[::-1][:most], v[:, ::-1][:, :most], np.trace(cov), np.array([[a / n for a in r] for r in dev])


def check(spark, tmp_path, rows, taken):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS key", "3 AS `a.b`")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_whitening"](spark, str(tmp_path)).collect()
    n, deviation, e, v, trace, centred = exact([r[1] for r in taken])
    assert len(got) == n * len(e) and {r.n for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, {})[r.component] = r
    for (key, *_), d, c in zip(taken, deviation, centred, strict=True):
        for k in range(len(e)):
            r = by_row[key][k + 1]
            assert r.deviation == d == int(r.deviation_exact)
            assert r.explained == pytest.approx(e[k] / trace, rel=1e-9, abs=1e-12)
            if e[k] > trace * 1e-12:
                assert abs(r.whitened) == pytest.approx(abs(c @ v[:, k]) / math.sqrt(e[k]), rel=1e-6, abs=1e-6)
            else:
                assert r.whitened is None
    return got


def test_whitening_is_the_exact_one(spark, tmp_path):
    rng = random.Random(1)
    f32 = lambda c: float(np.float32(c))
    good = [(k, [f32(rng.gauss(0, 1 + d / 3)) for d in range(10)], 1) for k in range(300)]
    bad = [(900, None, 1), (901, [None] * 10, 1), (902, [float("nan")] * 10, 1), (903, [float("inf")] + [0.0] * 9, 1), (904, [1.0] * 9 + [None], 1), (905, [], 1), (906, [1.0], 1), (907, [3e38] * 10, 1)]
    got = check(spark, tmp_path, good + bad, good)
    assert max(r.identity_error for r in got) < 1e-9


def test_wide_ranges_and_few_dimensions(spark, tmp_path):
    rng = random.Random(2)
    good = [(k, [float(np.float32(10 ** rng.uniform(-3, 3))), -float(k % 7), 5.0], 1) for k in range(100)]
    got = check(spark, tmp_path, good, good)
    assert {r.component for r in got} == {1, 2, 3} and all(r.whitened is None for r in got if r.component == 3)


def test_one_vector_and_equal_vectors(spark):
    for rows in ([(None, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        assert len(got) == 2 * len(rows)
        assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)


def test_numbers_beyond_64_bits(spark):
    rows = [(k, [(-1.0) ** k * 2.0**40, float(k), 2.0**41 * (k % 3)]) for k in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, deviation, e, v, trace, centred = exact([r[1] for r in rows])
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(k, d) for k, d in enumerate(deviation)}
    assert max(deviation) > 2**90
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9) or r.component == 3


@pytest.mark.parametrize("bits", [[1, 5, 0], [30, 1, 12], [62, 62, 62]])
def test_plane_products(bits):
    rng = np.random.default_rng(0)
    y = np.stack([rng.integers(0, 2**b, 150, dtype=np.uint64) for b in bits], axis=1)
    limbs = 2 * max(bits) // whitening.LIMB + 1
    got = whitening.plane_products(y, np.array(bits), limbs)
    for i in range(3):
        for j in range(i, 3):
            assert sum(int(got[k, i, j]) << (whitening.LIMB * k) for k in range(limbs)) == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True))
