"""Solvers against planted directions, and the algebra around them."""

import numpy as np
import pytest

from phasemesh.operators import complex_stats as cs
from phasemesh.operators import linalg, packed, qr, simulate
from phasemesh.sources import synthetic


@pytest.fixture(scope="module")
def planted(spark):
    x, q = synthetic.planted(spark, 1500, 12, [6.0, 4.0, 3.0])
    x = x.repartition(4).persist()
    x.count()
    yield x, q
    x.unpersist()


def agree(w, q, least=0.99):
    assert np.all(np.abs((w.conj() * q).sum(0)) > least)
    assert np.allclose(w.conj().T @ w, np.eye(w.shape[1]), atol=1e-8)


def test_exact_and_randomised(planted):
    x, q = planted
    a, b = linalg.exact(x, 3), linalg.randomised(x, 3, over=4)
    agree(a, q)
    assert np.all(np.abs((a.conj() * b).sum(0)) > 1 - 1e-4)


def test_power_iteration(planted):
    x, q = planted
    agree(linalg.pim(x, linalg.start(12, 3), 8, 1e-3).w, q, 0.97)


@pytest.mark.parametrize("compat", [False, True])
def test_variance_reduced(planted, compat):
    x, q = planted
    fit = linalg.pimvr(x, linalg.sample_start(x, 3, 200), 2, 3, 1e-3, compat_alpha=compat, center_batches=compat, reference=linalg.exact(x, 3))
    agree(fit.w, q)
    assert fit.status == "done" and len(fit.trace) == 6


def test_oja(planted):
    x, q = planted
    agree(linalg.oja(x, linalg.sample_start(x, 3, 100), 6, linalg.log_linear(0.5, 0.05, 6), take=5).w, q, 0.9)


def test_oja_row_by_row_and_by_sessions(planted, spark):
    x, q = planted
    start = linalg.sample_start(x, 3, 100)
    fit = linalg.oja_rows(x, start, 4, linalg.log_linear(0.02, 0.002, 4), 400)
    assert np.all(linalg.mcc(q, fit.w) > 0.95) and [t["rows"] for t in fit.trace] == [400] * 4
    fit = linalg.oja_sessions(x, start, 2, [0.5, 0.1], 40)
    assert np.all(linalg.mcc(q, fit.w) > 0.95)
    assert sum(t["rows"] for t in fit.trace if t["epoch"] == 0) == x.count() == sum(t["rows"] for t in fit.trace if t["epoch"] == 1)
    # one row after the other, in the order drawn
    few = complex_rows(spark, np.array([[1, 2j, 0], [0, 1, 1j], [3, 0, 1]]), 2)
    w = np.linalg.qr(np.array([[1.0, 0], [0, 1], [1, 1]]) + 0j)[0]
    made = linalg.oja_rows(few, w, 1, 0.1, 3, seed=5)
    order = few.selectExpr("t", "re", "im", "xxhash64(session_id, t, 5, 0) h").orderBy("h").collect()
    for r in order:
        v = np.array(r.re) + 1j * np.array(r.im)
        w = np.linalg.qr(w + 0.1 * np.outer(v.conj(), v @ w))[0]
    assert np.allclose(made.w, linalg.fix_phase(linalg._rotate(few, w)))


def test_magnitude_experiment(spark, monkeypatch):
    """Ten draws against the scaled matrices one by one; passes do not grow with draws."""
    rng = np.random.default_rng(8)
    m = (rng.standard_normal((600, 9)) + 1j * rng.standard_normal((600, 9))) * np.array([5, 4, 3, 1, 1, 1, 1, 1, 1.0])
    names = np.array([f"s{i}" for i in rng.integers(0, 6, 600)])
    x = spark.createDataFrame([(str(s), i, r.real.tolist(), r.imag.tolist()) for i, (s, r) in enumerate(zip(names, m))], "session_id string, t int, re array<double>, im array<double>").repartition(4)
    draws = linalg.magnitude_draws(sorted(set(names)), 10, seed=1)
    assert len(draws) == 10 and all(1 <= len(c) <= 3 and set(c.values()) <= {2.0, 5.0, 10.0} and len(set(c.values())) == len(c) for c in draws)
    calls, fetch = [], packed.fetch
    monkeypatch.setattr(packed, "fetch", lambda *a: calls.append(1) or fetch(*a))
    for some in (draws, draws[:1]):
        calls.clear()
        got = linalg.magnitude_experiment(x, 2, some)
        assert len(calls) == 4
        for c, (w, share) in zip(some, got):
            scaled = m * np.array([c.get(s, 1.0) for s in names])[:, None]
            _, s, vh = np.linalg.svd(scaled, full_matrices=False)
            assert np.allclose(share, s[:2] ** 2 / (s**2).sum(), rtol=1e-6) and np.allclose(linalg.mcc(w, vh.conj().T[:, :2]), 1, atol=1e-4)


def test_explained_adds_up(planted):
    x, _ = planted
    share = linalg.explained(x, np.eye(12, dtype=complex))
    assert share.sum() == pytest.approx(1.0)
    w = linalg.exact(x, 3)
    r2 = linalg.explained(x, w)
    assert r2[0] > r2[1] > r2[2] > 0


def test_gram_times_equals_join(planted, spark):
    x, _ = planted
    small = x.where("t < 200")
    g, n = linalg.gram_times(small, np.eye(12, dtype=complex))
    long = cs.gram(cs.explode_obs(small)).collect()
    assert n == 200
    for r in long:
        assert g[r.i, r.j] == pytest.approx(complex(r.re, r.im), abs=1e-8)


def test_scores_and_conjugate(planted):
    x, q = planted
    row = x.where("t = 5").first()
    v = np.array(row.re) + 1j * np.array(row.im)
    for conj in (False, True):
        z = {r.pc: complex(r.re, r.im) for r in linalg.scores(x.where("t = 5"), q, conj).collect()}
        assert np.allclose([z[i] for i in range(3)], (v.conj() if conj else v) @ q)


def test_schedules():
    assert np.allclose(linalg.log_linear(1, 100, 3), [1, 10, 100])
    assert np.allclose(linalg.cosine(1, 0, 3), [1, 0.5, 0])
    assert np.allclose(linalg.log_spline([1, 10, 100], 5), np.exp(np.linspace(0, np.log(100), 5)))
    assert linalg.schedule([1, 2], 2, 3).tolist() == [[1, 1, 1], [2, 2, 2]]
    with pytest.raises(ValueError):
        linalg.schedule([1, 2, 3], 2, 2)


def test_dual_and_heavy_ball(planted):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((6, 40)) + 1j * rng.standard_normal((6, 40))
    v = np.linalg.svd(m, full_matrices=False)[2].conj().T[:, :2]
    assert np.allclose(linalg.mcc(linalg.dual_directions(m, 2), v), 1)
    x, q = planted
    rows = x.collect()
    m = np.array([np.array(r.re) + 1j * np.array(r.im) for r in rows])
    assert np.allclose(linalg.rayleigh(x, 2 * q), (np.abs(m @ q) ** 2).mean(0))
    start = linalg.start(12, 3)
    fit = linalg.heavy_ball(x, start, 20)
    agree(fit.w[:, :2], q[:, :2], 0.97)  # a centre from the sum of all quotients is high for the last direction
    assert linalg.rayleigh(x, fit.w).sum() > 2 * linalg.rayleigh(x, start).sum()
    centres = [t["beta"] for t in fit.trace]
    assert centres[0] == pytest.approx(linalg.rayleigh(x, start).sum() ** 2 / 4) and len(centres) == 3
    assert all(any(b == pytest.approx(a * f) for f in (2 / 3, 0.99, 1.01, 1.5)) for a, b in zip(centres, centres[1:]))


def test_dual_of_a_distributed_matrix(spark, planted):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((6, 40)) + 1j * rng.standard_normal((6, 40))
    x = spark.createDataFrame([("s", i, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(m)], "session_id string, t int, re array<double>, im array<double>").repartition(3)
    want = linalg.fix_phase(np.linalg.svd(m, full_matrices=False)[2].conj().T[:, :2])
    for width in (4096, 7):
        assert np.allclose(linalg.dual(x, 2, width), want)
    with pytest.raises(ValueError):
        linalg.dual(x.limit(0), 2)


def test_dual_of_many_rows(planted, monkeypatch):
    """More rows than the limit are brought to as many as there are variables; more of both raise."""
    x, _ = planted
    want = linalg.exact(x, 3)
    monkeypatch.setattr(linalg, "EXACT_VARIABLES", 100)
    assert np.allclose(linalg.dual(x, 3), want)
    monkeypatch.setattr(qr, "WIDEST", 11)
    with pytest.raises(ValueError, match="more of both"):
        linalg.dual(x, 3)


def test_bad_rows_raise(spark):
    kind = "session_id string, t int, re array<double>, im array<double>"
    for bad in ([("s", 0, [1.0] * 3, [1.0] * 3), ("s", 1, [1.0] * 5, [1.0] * 5)], [("s", 0, [1.0, None], [1.0, 2.0])], [("s", 0, None, [1.0])], [("s", 0, [1.0, 2.0], [1.0])]):
        x = spark.createDataFrame(bad, kind).coalesce(1)
        with pytest.raises(Exception, match="matrix has rows|unequal length"):
            linalg.gram_times(x, np.eye(2, dtype=complex))


def test_moments(planted):
    x, q = planted
    m = np.array([np.array(r.re) + 1j * np.array(r.im) for r in x.collect()])
    m = np.hstack([m, m @ q])
    mean, var, n = linalg.moments(x, q)
    assert n == len(m) and np.allclose(mean, m.mean(0)) and np.allclose(var, m.real.var(0, ddof=1) + m.imag.var(0, ddof=1))


def complex_rows(spark, m, tasks=5):
    return spark.createDataFrame([("s", i, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(m)], "session_id string, t int, re array<double>, im array<double>").repartition(tasks)


def test_moments_far_from_zero(spark):
    """Variances of values about 1e8, and slopes and correlations of such values."""
    rng = np.random.default_rng(3)
    m = rng.standard_normal((900, 4)) + 1j * rng.standard_normal((900, 4)) + 1e8
    x = complex_rows(spark, m, 7)
    mean, var, n = linalg.moments(x, np.zeros((4, 0)))
    away = m - m.mean(0)
    assert n == 900 and np.allclose(mean, m.mean(0), rtol=1e-14) and np.allclose(var, (np.abs(away) ** 2).sum(0) / 899, rtol=1e-9)
    cells = cs.explode_obs(x)
    z = cells.where("v = 0").selectExpr("session_id", "t", "0 AS pc", "re", "im")
    slopes = {r.v: complex(r.re, r.im) for r in cs.posthoc_slope(cells, z).collect()}
    want = (away[:, :1].conj() * away).sum(0) / (np.abs(away[:, 0]) ** 2).sum()
    assert all(slopes[v] == pytest.approx(want[v], rel=1e-9, abs=1e-9) for v in range(4))
    pairs = spark.createDataFrame([(*map(float, (a.real, a.imag, b.real, b.imag)),) for a, b in m[:, :2]], "ar double, ai double, br double, bi double")
    assert cs.complex_correlation(pairs).first().mcc == pytest.approx(linalg.mcc(m[:, :1], m[:, 1:2])[0], rel=1e-7)


def test_packed_blocks(spark, monkeypatch):
    """Sums in blocks of a few rows and groups of a few tasks; what is shuffled is one row a block and task."""
    rng = np.random.default_rng(5)
    m = rng.standard_normal((300, 23)) + 1j * rng.standard_normal((300, 23))
    w = rng.standard_normal((23, 3)) + 1j * rng.standard_normal((23, 3))
    x = complex_rows(spark, m, 9)
    for fan in (16, 2):
        monkeypatch.setattr(packed, "FAN", fan)
        g, n = linalg.gram_times(x, w)
        assert n == 300 and np.allclose(g, m.conj().T @ (m @ w))
    assert packed.rows_of(6) * 48 <= packed.BLOCK_BYTES < (packed.rows_of(6) + 1) * 48
    made = x.mapInArrow(lambda batches: packed.give(np.ones((packed.rows_of(1) * 2 + 5, 1)), sum(b.num_rows for b in batches)), packed.FIELDS)
    assert made.count() == 9 * 3
    total, n = packed.fetch(made)
    assert n == 300 and len(total) == packed.rows_of(1) * 2 + 5 and (total == 9).all()
    assert packed.fetch(made.limit(0))[1] == 0
    none = linalg.gram_times(x.limit(0), w)
    assert none[1] == 0 and not none[0].any()


def test_restarts_and_scaling(planted):
    x, _ = planted
    runs = linalg.restarts(x, lambda r: linalg.pim(x, linalg.start(12, 2, r), 2, 0.0, seed=r), 2)
    assert runs[0][2].sum() >= runs[1][2].sum()
    y = linalg.scale_sessions(x, {"s1": 10.0})
    w = linalg.randomised(y, 1, passes=1)
    assert np.array(y.where("session_id = 's1'").first().re).std() > np.array(x.where("session_id = 's0'").first().re).std()
    assert w.shape == (12, 1)


def test_restarts_share_passes(planted, monkeypatch):
    x, q = planted
    starts = [linalg.start(12, 3, j) for j in range(3)]
    passes = []
    monkeypatch.setattr(linalg.packed, "fetch", lambda *a, _fetch=packed.fetch: (passes.append(1), _fetch(*a))[1])
    found = linalg.pimvr_restarts(x, starts, 2, 3, 1e-3)
    assert len(passes) == 2 + 2 * 3 + 1 + 1  # anchors, mini-batches, rotation and variances, whatever the number of runs
    assert sorted(run for run, _, _ in found) == [0, 1, 2]
    assert [s.sum() for _, _, s in found] == sorted((s.sum() for _, _, s in found), reverse=True)
    for run, fit, share in found:
        agree(fit.w, q, 0.97)
        assert fit.status == "done" and len(fit.trace) == 6 and np.allclose(share, linalg.explained(x, fit.w))
    alone = linalg.pimvr(x, starts[0], 2, 3, 1e-3)
    assert np.allclose(dict((run, fit.w) for run, fit, _ in found)[0], alone.w, atol=1e-9)
    whole = linalg.pimvr_restarts(x, starts[:1], 1, 2, compat_alpha=True)
    assert np.allclose(whole[0][1].w, linalg.pimvr(x, starts[0], 1, 2, compat_alpha=True).w, atol=1e-9)


def test_restarts_that_stop_and_bad_starts(planted):
    x, q = planted
    flat = np.zeros((12, 3), np.complex128)
    flat[:, 0] = 1
    found = {run: fit for run, fit, _ in linalg.pimvr_restarts(x, [flat, linalg.start(12, 3)], 2, 3)}
    assert found[0].status == "stopped at epoch 0, iteration 0: the basis became singular" and not found[0].trace
    assert found[1].status == "done" and len(found[1].trace) == 6
    agree(found[1].w, q, 0.97)
    for starts in ([], [linalg.start(12, 3), linalg.start(12, 2)]):
        with pytest.raises(ValueError):
            linalg.pimvr_restarts(x, starts, 1, 1)
    with pytest.raises(ValueError):
        linalg.pimvr_restarts(x.limit(0), [linalg.start(12, 3)], 1, 1)


def test_too_many_variables(spark, monkeypatch, planted):
    monkeypatch.setattr(linalg, "EXACT_VARIABLES", 4)
    with pytest.raises(ValueError):
        linalg.exact(planted[0], 2)


def test_real_demonstrations():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 8)) * np.array([5, 3, 1, 1, 1, 1, 1, 1.0])
    w = simulate.real_oja(x, 2, linalg.log_linear(0.05, 0.001, len(x)))
    assert abs(w[0, 0]) > 0.95 and abs(w[1, 1]) > 0.95
    assert abs(simulate.shamir(x[:1500], 2, 0.005)[0]) > 0.98


def test_simulation(spark):
    rows = simulate.agreement(spark, simulate.by_oja, 2, 300, 8, [6.0, 3.0]).collect()
    assert len(rows) == 4 and all(r.mcc > 0.8 for r in rows)
