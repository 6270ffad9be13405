"""Kernels against known series, and operators against kernels."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phasemesh.operators import ordered, signal

FS = 0.5
T = np.arange(800) / FS


def test_band_keeps_and_removes():
    y = np.array([np.sin(2 * np.pi * 0.05 * T), np.sin(2 * np.pi * 0.2 * T)])
    z = signal.band_pass(y, FS)
    inner = slice(100, -100)
    assert np.corrcoef(z[0][inner], y[0][inner])[0, 1] > 0.999
    assert z[1][inner].std() < 0.05 * y[1].std()


@pytest.mark.parametrize("p, q", [(2, 1), (1, 2), (3, 2), (2, 3), (6, 4), (1, 5), (7, 3)])
def test_polyphase(p, q):
    """Against the definition; sines under both Nyquist frequencies are kept, those over the new one are 40 dB down."""
    rng = np.random.default_rng(p)
    y = rng.standard_normal((3, 61))
    h, g = signal.resampling_filter(p // np.gcd(p, q), q // np.gcd(p, q)), np.gcd(p, q)
    up = np.zeros((3, 61 * (p // g)))
    up[:, :: p // g] = y
    want = np.array([np.convolve(r, h)[len(h) // 2 :] for r in up])[:, : up.shape[1]][:, :: q // g]
    got = signal.polyphase(y, p, q)
    assert got.shape == (3, -(-61 * p // q)) and np.allclose(got, want)
    n = 4000
    t, at = np.arange(n), np.arange(-(-n * p // q)) * q / p
    low = min(1, p / q)  # the lower Nyquist frequency, in halves of the input's rate
    inner = slice(len(at) // 4, -(len(at) // 4))
    slow = signal.polyphase(np.sin(np.pi * 0.8 * low * t)[None, :], p, q)[0]
    assert np.abs(slow[inner] - np.sin(np.pi * 0.8 * low * at[inner])).max() < 0.01
    if low < 1:
        fast = signal.polyphase(np.sin(np.pi * (low + 0.15 * low) * t)[None, :], p, q)[0]
        assert np.abs(fast[inner]).max() < 0.01
    assert signal.polyphase(np.zeros((2, 0)), p, q).shape == (2, 0) or p == q


def test_resampled_by(spark):
    rows = [("a", [float(v) for v in np.sin(np.arange(50) / 5)]), ("b", [1.0]), ("c", None), ("d", [1.0, None, 2.0])]
    got = {r.session_id: r.y for r in signal.resampled_by(spark.createDataFrame(rows, "session_id string, y array<double>"), 3, 2).collect()}
    assert np.allclose(got["a"], signal.polyphase(np.array([rows[0][1]]), 3, 2)[0]) and got["b"] == [1.0] and got["c"] is got["d"] is None


def test_motion_beside_series_or_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    fields = ", ".join(f"p{i} double" for i in range(1, 7))
    motion = [(s, t, *rng.standard_normal(6).tolist()) for s in ("a", "b", "c") for t in range(30)] + [(None, 0, *[1.0] * 6)]
    motion[40] = (*motion[40][:4], None, *motion[40][5:])
    sig = [(s, "lh", v, rng.standard_normal(30).tolist()) for s in ("a", "b", "c", "none") for v in range(4)] + [("a", "lh", 9, None), ("c", "lh", 9, [None] * 30)]
    sig = spark.createDataFrame(sig, "session_id string, hemi string, vertex int, y array<double>")
    motion = spark.createDataFrame(motion, f"session_id string, t int, {fields}").repartition(3)
    found = []
    for most in (6_000_000, 10):
        monkeypatch.setattr(signal, "MOTION_NUMBERS", most)
        made = signal.nuisance(sig, motion, absolute=True)
        found.append({(r.session_id, r.vertex): r.y for r in made.collect()})
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan or "collect_list" in plan) == (most == 10)
    one, two = found
    assert one.keys() == two.keys() == {(s, v) for s in "abc" for v in range(4)} | {("a", 9), ("c", 9)}
    assert all((one[k] is None and two[k] is None) or np.allclose(one[k], two[k]) for k in one) and one["b", 0] is None and one["a", 0] is not None


def test_butterworth_design():
    order, edges = signal.band_order((0.02, 0.4), (0.004, 0.56), 3, 20)
    s = signal.butter_band(order, edges)
    f = np.array([edges[0], edges[1], 0.1])
    z = np.exp(-1j * np.pi * f)
    h = np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in s], axis=0)
    assert np.abs(h) == pytest.approx([2**-0.5, 2**-0.5, 1.0], abs=2e-3)


def test_analytic():
    y = np.cos(2 * np.pi * 0.05 * T)[None, :]
    z = signal.analytic(y, FS)
    assert np.allclose(z.real, y)
    assert np.allclose(np.abs(z[0][100:-100]), 1, atol=0.02)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=20, max_size=60))
def test_residuals_are_orthogonal(values):
    y = np.array(values)[None, :]
    x = np.column_stack([np.sin(np.arange(len(values))), np.ones(len(values))])  # a dependent regressor as well
    r = signal.residuals(y, x)
    assert abs(r.sum()) < 1e-6 and abs((r[0] * x[:, 0]).sum()) < 1e-6


def test_white_noise_spectrum():
    f, p = signal.periodogram(np.random.default_rng(0).standard_normal((300, 256)), FS)
    assert f[-1] == pytest.approx(FS / 2)
    assert p.mean() * FS == pytest.approx(1.0, abs=0.05)


def test_operators(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((120, 6))
    y = [("s", "lh", v, (rng.standard_normal(120) + m @ np.arange(6)).tolist()) for v in range(3)]
    sig = spark.createDataFrame(y, "session_id string, hemi string, vertex int, y array<double>")
    mot = spark.createDataFrame([("s", t, *map(float, r)) for t, r in enumerate(m)], "session_id string, t int, p1 double, p2 double, p3 double, p4 double, p5 double, p6 double")
    clean = {r.vertex: np.array(r.y) for r in signal.nuisance(sig, mot).collect()}
    for v in range(3):
        assert np.allclose(clean[v], signal.residuals(np.array(y[v][3])[None, :], m)[0])
    norm = signal.spectral_norm(sig, FS).first().norm
    f, p = signal.periodogram(np.array([r[3] for r in y]), FS)
    assert norm == pytest.approx(np.sqrt(p.mean(0)[f <= 0.15].sum()))
    valid = spark.createDataFrame([("lh", 0), ("lh", 2)], "hemi string, vertex int")
    steps = signal.normalise(signal.nuisance(sig.where("vertex <> 1"), mot, True), FS)
    steps = signal.analytic_signal(signal.band_passed(signal.resampled(steps, FS, 1.0), 1.0), 1.0)
    want = {r.vertex: np.array(r.re) + 1j * np.array(r.im) for r in steps.collect()}
    got = {r.vertex: np.array(r.re) + 1j * np.array(r.im) for r in signal.preprocess(sig, mot, valid, FS, 1.0, absolute=True).collect()}
    assert got.keys() == want.keys() == {0, 2} and all(np.allclose(got[v], want[v]) for v in want)
    for obs in (signal.preprocess_obs(sig, mot, valid, FS, 1.0, absolute=True), signal.to_obs(steps)):
        rows = obs.orderBy("t").collect()
        assert [r.t for r in rows] == list(range(240))
        assert np.allclose([np.array(r.re) + 1j * np.array(r.im) for r in rows], np.column_stack([want[0], want[2]]))


def test_frames_of_many_vertices_and_hemispheres(spark, monkeypatch):
    monkeypatch.setattr(signal, "TURNED", 4)
    rng = np.random.default_rng(5)
    rows = [(s, h, v, *rng.standard_normal((2, 7 if s == "a" or v % 2 else 5)).tolist()) for s in "ab" for h in ("rh", "lh") for v in rng.permutation(11).tolist()]
    obs = signal.to_obs(spark.createDataFrame(rows + [("a", "lh", 99, None, None)], "session_id string, hemi string, vertex int, re array<double>, im array<double>"))
    got = {(r.session_id, r.t): (r.re, r.im) for r in obs.collect()}
    for s in "ab":
        for t in range(7):
            here = [r for r in sorted(rows, key=lambda r: r[1:3]) if r[0] == s and t < len(r[3])]
            assert got[s, t] == ([r[3][t] for r in here], [r[4][t] for r in here])


def test_series_with_nulls_come_back_null(spark):
    good = [float(x) for x in np.sin(np.arange(40))]
    rows = [("s", "lh", 0, good), ("s", "lh", 1, None), ("s", "lh", 2, [None, *good[1:]]), ("s", "lh", 3, [1.0]), ("s", "lh", 4, [])]
    sig = spark.createDataFrame(rows, "session_id string, hemi string, vertex int, y array<double>")
    for made in (signal.band_passed(sig, FS), signal.resampled(sig, FS, 1.0)):
        got = {r.vertex: r.y for r in made.collect()}
        assert got[1] is None and got[2] is None and len(got[0]) >= 40 and got[4] == []
    z = {r.vertex: (r.re, r.im) for r in signal.analytic_signal(sig, FS).collect()}
    assert z[1] == z[2] == (None, None) and np.allclose(z[0][0], good)
    assert signal.spectral_norm(sig, FS).count() == 1
    assert signal.band_passed(sig.limit(0), FS).count() == 0
    mot = spark.createDataFrame([("s", t, *np.random.default_rng(t).standard_normal(6).tolist()) for t in range(40)], "session_id string, t int, p1 double, p2 double, p3 double, p4 double, p5 double, p6 double")
    clean = {r.vertex: r.y for r in signal.nuisance(sig.where("vertex < 3"), mot).collect()}
    assert clean[1] is None and clean[2] is None and abs(sum(clean[0])) < 1e-9
    valid = spark.createDataFrame([("lh", v) for v in range(3)], "hemi string, vertex int")
    frames = signal.preprocess_obs(sig.where("vertex < 3"), mot, valid, FS, FS).collect()
    assert len(frames) == 40 and all(len(r.re) == 1 for r in frames)


def test_periodogram_of_a_hand_made_series():
    assert [signal.fast_length(n) for n in (1, 7, 11, 97, 600, 601)] == [1, 8, 12, 100, 600, 625]
    y = np.random.default_rng(2).standard_normal((2, 97))
    freq, psd = signal.periodogram(y, 1.0, (3,), 0.0)
    x = np.concatenate([y - y.mean(1, keepdims=True), np.zeros((2, 3))], 1)
    raw = np.array([[abs(sum(v * np.exp(-2j * np.pi * k * t / 100) for t, v in enumerate(r))) ** 2 / 97 for k in range(100)] for r in x])
    raw[:, 0] = (raw[:, 1] + raw[:, -1]) / 2
    want = [[(r[(k - 1) % 100] + 2 * r[k] + r[(k + 1) % 100]) / 4 for k in range(1, 51)] for r in raw]
    assert np.allclose(psd, want) and np.allclose(freq, [0.5 * k / 49 for k in range(50)])
    assert np.allclose(signal.band_power(y, 1.0, 0.1), signal.periodogram(y, 1.0)[1][:, (freq > 0.1) & (freq <= 0.15)].sum(1))


def test_ends_are_mirrored_by_the_rate():
    y = np.random.default_rng(1).standard_normal(60)
    order, edges = signal.band_order((0.02, 0.4), (0.004, 0.56), 3, 20)
    wide = np.concatenate([y[1:8][::-1], y, y[-8:-1][::-1]])
    once = signal.filter_rows(signal.butter_band(order, edges), wide[None, :])
    twice = signal.filter_rows(signal.butter_band(order, edges), once[:, ::-1])[:, ::-1]
    assert np.allclose(signal.band_pass(y[None, :], 1.0, fs_dec=1.0, passband=(0.01, 0.2), stopband=(0.002, 0.28))[0], twice[0, 7:-7])


def test_padding_and_resampling(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "y array<double>")
    row = df.select(ordered.mirror_pad("y", 2, False).alias("a"), ordered.mirror_pad("y", 2, True).alias("b"), ordered.resample_linear("y", 1.0, 2.0).alias("c")).first()
    assert row.a == [3, 2, 1, 2, 3, 4, 3, 2] and row.b == [2, 1, 1, 2, 3, 4, 4, 3]
    assert row.c == [1, 1.5, 2, 2.5, 3, 3.5, 4, None]


def test_preprocess_shuffles_the_frames_of_a_session_once(spark, tiny, monkeypatch):
    """Series and parameters come from one shuffle by session, and valid vertices are broadcast; then series are turned."""
    from phasemesh.plans import stats_queries

    monkeypatch.setattr(signal, "MOTION_NUMBERS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = stats_queries.preprocess(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 4 and "vertex" not in "".join(shuffles)  # two of them are the same, one by block, one by frame
    read = [line.split("FileScan parquet")[1] for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(read) == 2 and len({sorted_names(r) for r in read}) == 1


def sorted_names(scan):
    """Columns that a scan reads, without their numbers."""
    return tuple(sorted(re.findall(r"l_[a-z]+", scan.split("]")[0])))
