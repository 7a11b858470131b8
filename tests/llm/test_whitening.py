"""Whitening against exact rational arithmetic on small tables, with dropped, repeated and degenerate rows."""
import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm import whitening

VECTORS = "vec_id long, embedding array<float>"


def exact(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * c - s for c, s in zip(row, sums)] for row in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n ** 3) for j in range(len(sums))] for i in range(len(sums))]
    return y, sums, cov


def test_equals_exact_arithmetic(spark, table):
    random = np.random.default_rng(8)
    base = random.standard_normal((60, 40)) @ random.standard_normal((40, 40)) / 7
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 3
    rows = [*enumerate(vectors), (900, None), (901, [float("nan")] * 40), (902, [float("inf")] + [0.0] * 39), (903, [None] + [0.0] * 39), (904, []),
            (905, [1.0, 2.0]), (None, vectors[5])]
    good = vectors + [vectors[5]]
    got = whitening.whiten(table(rows, VECTORS).repartition(3)).collect()
    y, _, cov = exact(good)
    v = np.array([[float(c) for c in row] for row in cov])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 32 * len(good) and {r["n"] for r in got} == {len(good)}
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert set(by_id) == {i for i, _ in enumerate(vectors)} | {None} and all(sorted(c) == list(range(1, 33)) for c in by_id.values())
    want = (np.array(y, float) / len(good)) @ axes[:, :32] / np.sqrt(values[:32])
    signs = np.sign([by_id[0][c + 1][0]["whitened"] * want[0, c] for c in range(32)])
    for i, own in by_id.items():
        at = 5 if i is None else i
        for c in range(32):
            for r in own[c + 1]:
                assert r["deviation"] == sum(e * e for e in y[at])
                assert r["whitened"] == pytest.approx(signs[c] * want[at, c], abs=1e-7)
                assert r["explained"] == pytest.approx(values[c] / np.trace(v), rel=1e-9) and r["identity_error"] < 1e-8


def test_covariances_are_exact_for_values_of_any_size(table):
    for scale in (1.0, 1e6, 1e12):
        vectors = [[scale * c for c in (1.5, -2.25, 3.0)], [scale, 0.0, 0.5], [0.25, scale, scale], [0.0, 0.0, -scale * 7]] * 5
        w = whitening.fit(whitening.fixed_vectors(table([*enumerate(vectors)], VECTORS).select("vec_id", "embedding")))
        _, sums, cov = exact(vectors)
        assert w.sums == sums and [[Fraction(c, w.n ** 3) for c in row] for row in w.numerators] == cov


def test_squares_in_limbs():
    random = np.random.default_rng(2)
    for bits in (10, 30, 31, 45, 59, 61):
        z = random.integers(-(1 << bits), 1 << bits, (50, 3))
        assert whitening.squares(z) == [sum(int(v) ** 2 for v in c) for c in z.T]
    big = random.integers(0, 1 << 62, (9, 2)).astype(object) * 4
    assert whitening.squares(big) == [sum(v ** 2 for v in c) for c in big.T]


def test_tables_without_variance(table):
    assert whitening.whiten(table([], VECTORS)).count() == 0 and whitening.whiten(table([(1, None)], VECTORS)).count() == 0
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 4):
        out = whitening.whiten(table(rows, VECTORS)).collect()
        assert len(out) == 2 * len(rows) and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None for r in out)
    out = whitening.whiten(table([(i, [float(i), float(i), 1e30]) for i in range(5)], VECTORS)).collect()
    assert [r["whitened"] is None for r in sorted(out, key=lambda r: r["component"])] == [False] * 5 + [True] * 10
    assert {r["identity_error"] < 1e-12 for r in out} == {True}
