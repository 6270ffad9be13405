"""Triangular factors in a tree: matrices whose condition the Gram route cannot stand."""

import numpy as np
import pytest

from phasemesh.operators import linalg, qr

KIND = "session_id string, t int, re array<double>, im array<double>"


def matrix(spark, m, tasks):
    return spark.createDataFrame([(f"s{i % 3}", i, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(m)], KIND).repartition(tasks)


def conditioned(n, p, condition, seed=0):
    """A matrix whose singular values fall evenly in their logarithms."""
    rng = np.random.default_rng(seed)
    u, v = (np.linalg.qr(rng.standard_normal((s, min(n, p))) + 1j * rng.standard_normal((s, min(n, p))))[0] for s in (n, p))
    s = np.logspace(0, -np.log10(condition), min(n, p))
    return (u * s) @ v.conj().T, s, v


@pytest.mark.parametrize("n, tasks", [(400, 7), (15, 4), (8, 3)])
def test_tall(spark, n, tasks):
    m, s, v = conditioned(n, 9, 1e9)
    x = matrix(spark, m, tasks)
    got, w = qr.singular(x, 9)
    assert np.allclose(got, s, rtol=0, atol=1e-12) and got[-1] == pytest.approx(s[-1], rel=1e-6)
    want = np.linalg.svd(m, full_matrices=False)[2].conj().T
    assert np.allclose(w[:, :6], linalg.fix_phase(want)[:, :6], atol=1e-8) and np.allclose(w[:, :3], linalg.fix_phase(want)[:, :3], atol=1e-10)
    # the product with itself has lost the small values
    g, _ = linalg.gram_times(x, np.eye(9, dtype=complex))
    lost = np.sqrt(np.abs(np.linalg.eigvalsh(g)))[0]
    assert abs(lost - s[-1]) > 1e-3 * s[-1]


@pytest.mark.parametrize("width", [1024, 17])
def test_few_wide_rows(spark, width):
    m, s, v = conditioned(12, 300, 1e9)
    x = matrix(spark, m, 4)
    places = spark.createDataFrame([(f"s{i % 3}", i, i) for i in range(12)], "session_id string, t int, i long")
    got, w = qr.singular_of_few(x, places, ["session_id", "t"], 12, 5, width)
    assert np.allclose(got, s[:5], rtol=0, atol=1e-12) and np.allclose(w[:, :3], linalg.fix_phase(v)[:, :3], atol=1e-9)
    start = linalg.sample_start(x, 3, 8, seed=4)
    assert start.shape == (300, 3) and np.allclose(start.conj().T @ start, np.eye(3), atol=1e-10)
    again = linalg.sample_start(x.repartition(2), 3, 8, seed=4)
    assert np.allclose(start, again)
    assert np.allclose(linalg.mcc(linalg.sample_start(x, 3, 99), np.linalg.svd(m)[2].conj().T[:, :3]), 1)


def test_rank_and_limits(spark, monkeypatch):
    m, _, _ = conditioned(6, 40, 10)
    m[3:] = m[:3]
    x = matrix(spark, m, 2)
    places = spark.createDataFrame([(f"s{i % 3}", i, i) for i in range(6)], "session_id string, t int, i long")
    s, w = qr.singular_of_few(x, places, ["session_id", "t"], 6, 5)
    assert np.all(s[3:] < 1e-14) and np.allclose(w.conj().T @ w, np.eye(5), atol=1e-8)
    with pytest.raises(ValueError):
        qr.r_factor(x.limit(0))
    monkeypatch.setattr(qr, "WIDEST", 5)
    with pytest.raises(ValueError):
        qr.r_factor(x)
    with pytest.raises(ValueError):
        qr.singular_of_few(x, places, ["session_id", "t"], 6, 2)
