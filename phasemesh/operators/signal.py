"""Signal processing of series: nuisance regression, spectral norm, band-pass and analytic signal.

Series are rows ``(session_id, hemi, vertex, y[])``.  The kernels work on all rows of an Arrow batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .quantiles import few

#: Band-pass design in Hz and dB, and the grid it works on (fixed values, for results that can be compared).
PASSBAND, STOPBAND, RIPPLE, LOSS, GRID_HZ = (0.005, 0.1), (0.001, 0.14), 3.0, 20.0, 0.5
#: Samples mirrored at either end before the band-pass, for each Hz of the sampling rate (fixed value).
PAD = 7
#: Spans of the spectrum's smoothing kernel, share tapered at either end, and the band of the norm (fixed values).
SPANS, TAPER, NORM_HZ = (3, 5), 0.1, 0.15

# --- kernels ----------------------------------------------------------------------------------------------------------


def basis(regressors: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the span of a constant and the regressors (frames x regressors)."""
    x = np.column_stack([np.ones(len(regressors)), regressors])
    q, r = np.linalg.qr(x)
    if np.all(np.abs(np.diag(r)) > 1e-10 * max(1e-300, np.abs(r).max())):
        return q
    u, s, _ = np.linalg.svd(x, full_matrices=False)  # dependent regressors
    return u[:, s > 1e-10 * s.max()]


def residuals(y: np.ndarray, regressors: np.ndarray) -> np.ndarray:
    """Rows of ``y`` less their least-squares fit on a constant and the regressors."""
    q = basis(regressors)
    return y - (y @ q) @ q.T


def daniell(spans: tuple[int, ...]) -> np.ndarray:
    """Convolution of modified Daniell kernels (half weight at the ends) of odd spans."""
    out = np.ones(1)
    for s in spans:
        k = np.ones(s)
        k[0] = k[-1] = 0.5
        out = np.convolve(out, k / k.sum())
    return out


def fast_length(n: int) -> int:
    """The least number from ``n`` on without prime factors over 5."""
    while True:
        rest = n
        for f in (2, 3, 5):
            while rest % f == 0 and rest:
                rest //= f
        if rest <= 1:
            return n
        n += 1


def periodogram(y: np.ndarray, fs: float, spans: tuple[int, ...] = SPANS, taper: float = TAPER) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed one-sided periodogram of the rows, demeaned, cosine-tapered at both ends and padded with zeros to a fast
    length, without its value at 0.

    The frequencies that go with it are spaced evenly from 0 to ``fs / 2``: a little off those of the transform, as
    results are compared with ones on this grid.
    """
    n = y.shape[1]
    x = y - y.mean(1, keepdims=True)
    m = int(math.floor(n * taper))
    w = np.ones(n)
    if m:
        edge = 0.5 * (1 - np.cos(np.pi * (np.arange(1, 2 * m, 2)) / (2 * m)))
        w[:m], w[n - m :] = edge, edge[::-1]
    wide = fast_length(n)
    power = np.abs(np.fft.fft(x * w, wide, axis=1)) ** 2 / (n * fs)
    kernel = daniell(spans)
    power[:, 0] = 0.5 * (power[:, 1] + power[:, -1])
    half = len(kernel) // 2
    wrapped = np.concatenate([power[:, -half:], power, power[:, :half]], 1)
    smooth = sum(k * wrapped[:, i : i + wide] for i, k in enumerate(kernel))
    top = wide // 2
    lost = 5 / 8 * taper * 2  # share of power that the taper takes
    return np.linspace(0, fs / 2, top), smooth[:, 1 : top + 1] / (1 - lost)


def band_power(y: np.ndarray, fs: float, low: float | None = None, high: float = NORM_HZ) -> np.ndarray:
    """Sum of each row's periodogram over frequencies up to ``high`` (and over ``low``, if there is one)."""
    freq, psd = periodogram(y, fs)
    return psd[:, (freq <= high) & (True if low is None else freq > low)].sum(1)


def band_order(passband: tuple[float, float], stopband: tuple[float, float], ripple: float, loss: float) -> tuple[int, tuple[float, float]]:
    """Least order of a Butterworth band-pass, and its natural edges; frequencies over the Nyquist frequency."""
    wp, ws = (np.tan(np.pi * np.asarray(x) / 2) for x in (passband, stopband))
    centre, width = wp[0] * wp[1], wp[1] - wp[0]
    selectivity = np.min(np.abs((ws**2 - centre) / (ws * width)))
    gp, gs = 10 ** (ripple / 10) - 1, 10 ** (loss / 10) - 1
    order = max(1, int(math.ceil(math.log10(gs / gp) / (2 * math.log10(selectivity)))))
    w0 = gp ** (-1 / (2 * order))
    edge = np.array([-w0, w0]) * width / 2 + np.sqrt((w0 * width) ** 2 / 4 + centre)
    low, high = sorted(np.abs(edge))
    return order, (2 / np.pi * math.atan(low), 2 / np.pi * math.atan(high))


def butter_band(order: int, edges: tuple[float, float]) -> np.ndarray:
    """Second-order sections ``b0 b1 b2 a1 a2`` of a Butterworth band-pass."""
    lo, hi = (4 * math.tan(math.pi * e / 2) for e in edges)  # bilinear transform with sampling rate 2
    bw, w0 = hi - lo, math.sqrt(lo * hi)
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + 1 + order) / (2 * order))
    half = proto * bw / 2
    root = np.sqrt(half**2 - w0**2)
    poles = np.concatenate([half + root, half - root])
    digital = (4 + poles) / (4 - poles)
    gain = np.real(bw**order * 4**order / np.prod(4 - poles))
    upper = sorted(digital[digital.imag > 1e-12], key=lambda z: (abs(z), z.real))
    real = sorted(digital[np.abs(digital.imag) <= 1e-12].real)
    pairs = [(-2 * z.real, abs(z) ** 2) for z in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    sections = np.array([[1.0, 0.0, -1.0, a1, a2] for a1, a2 in pairs])  # zeros at 1 and -1
    share = gain ** (1 / len(sections))
    sections[:, :3] *= share
    return sections


def filter_rows(sections: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sections applied to all rows, started at rest on each row's first value (a band-pass passes no constant)."""
    y = y - y[:, :1]
    for b0, b1, b2, a1, a2 in sections:
        s1, s2 = np.zeros(len(y)), np.zeros(len(y))
        out = np.empty_like(y)
        for t in range(y.shape[1]):
            x = y[:, t]
            v = b0 * x + s1
            s1 = b1 * x - a1 * v + s2
            s2 = b2 * x - a2 * v
            out[:, t] = v
        y = out
    return y


def resample(y: np.ndarray, fs: float, fs_new: float, n: int | None = None) -> np.ndarray:
    """Linear interpolation of rows on a new grid; ends are held."""
    at = np.arange(n if n is not None else int(math.floor(y.shape[1] * fs_new / fs))) / fs_new
    x = np.clip(at * fs, 0, y.shape[1] - 1)
    lo = np.minimum(x.astype(int), max(0, y.shape[1] - 2))
    w = x - lo
    return y[:, lo] * (1 - w) + y[:, np.minimum(lo + 1, y.shape[1] - 1)] * w


#: Rejection in dB and roll-off, as a share of the cut-off, of the filter of rational resampling (fixed values).
REJECTION, ROLL_OFF = 60.0, 0.1


def resampling_filter(p: int, q: int) -> np.ndarray:
    """A low-pass of odd length under a Kaiser window for resampling by p/q: it cuts at the lower of both Nyquist
    frequencies, and its taps sum to p.
    """
    cut = 1 / (2 * max(p, q))
    half = math.ceil((REJECTION - 8) / (28.714 * cut * ROLL_OFF))
    t = np.arange(-half, half + 1)
    return np.kaiser(len(t), 0.1102 * (REJECTION - 8.7)) * 2 * p * cut * np.sinc(2 * cut * t)


def polyphase(y: np.ndarray, p: int, q: int) -> np.ndarray:
    """Rows resampled by p/q: as if p - 1 zeros were put after each value, filtered, and each q-th value kept.

    A phase (the place of an output between two inputs) sees every p-th tap only, so all outputs of one phase are one
    product of windows of the rows with these taps.  Rows are 0 beyond their ends; there are ceil(n p / q) outputs.
    """
    if p < 1 or q < 1:
        raise ValueError("p and q are positive")
    p, q = p // math.gcd(p, q), q // math.gcd(p, q)
    n = y.shape[1]
    if p == q or not n:
        return y.copy()
    taps = resampling_filter(p, q)
    half = len(taps) // 2
    outputs = -(-n * p // q)
    out = np.empty((len(y), outputs))
    reach = half // p + 1  # inputs on either side that an output sees
    wide = np.pad(y, ((0, 0), (reach, reach)))
    windows = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=1)
    place = np.arange(outputs) * q  # on the grid of the input with zeros between
    for phase in range(min(p, outputs)):
        mine = np.arange(phase, outputs, p)  # q and p have no common factor: each p-th output has the same phase
        first = place[mine] // p
        at = half + place[mine[0]] - (first[0] + np.arange(-reach, reach + 1)) * p
        weight = np.where((at >= 0) & (at < len(taps)), taps[np.clip(at, 0, len(taps) - 1)], 0.0)
        inside = first < n
        out[:, mine[inside]] = windows[:, first[inside]] @ weight
        out[:, mine[~inside]] = 0.0
    return out


def _padded(y: np.ndarray, n: int, edge: bool) -> np.ndarray:
    n = min(n, y.shape[1] - (0 if edge else 1))
    if edge:
        return np.concatenate([y[:, :n][:, ::-1], y, y[:, y.shape[1] - n :][:, ::-1]], 1)
    return np.concatenate([y[:, 1 : n + 1][:, ::-1], y, y[:, -n - 1 : -1][:, ::-1]], 1)


def band_pass_rows(rows: list[np.ndarray], fs: float, fs_dec: float = GRID_HZ, passband=PASSBAND, stopband=STOPBAND, ripple: float = RIPPLE, loss: float = LOSS, pad: float = PAD) -> list[np.ndarray]:
    """Zero-phase Butterworth band-pass on a coarser grid, put back on the first one by a polyphase filter.  Frequencies in
    Hz; ``pad * fs`` samples of the coarser grid are mirrored at either end.

    Rows of any lengths are filtered side by side: a filter only looks back, so what stands after a row's end does not
    matter, and the way back runs over rows turned about their own ends.  Rows of less than two values stay as they are.
    """
    if any(len(y) < 2 for y in rows):
        done = iter(band_pass_rows([y for y in rows if len(y) > 1], fs, fs_dec, passband, stopband, ripple, loss, pad))
        return [next(done) if len(y) > 1 else y for y in rows]
    nyquist, ratio = fs_dec / 2, Fraction(fs / fs_dec).limit_denominator(1000)
    order, edges = band_order(tuple(p / nyquist for p in passband), tuple(s / nyquist for s in stopband), ripple, loss)
    sections = butter_band(order, edges)
    wide, used = [], []
    for y in rows:
        coarse = resample(y[None, :], fs, fs_dec, max(2, int(math.ceil(len(y) * fs_dec / fs))))
        w = _padded(coarse, min(int(pad * fs), coarse.shape[1] - 1), edge=False)
        wide.append(w[0])
        used.append((w.shape[1] - coarse.shape[1]) // 2)
    sizes = [len(w) for w in wide]
    matrix = np.zeros((len(rows), max(sizes, default=0)))

    def turned(parts: list[np.ndarray]) -> np.ndarray:
        for i, w in enumerate(parts):
            matrix[i, : len(w)], matrix[i, len(w) :] = w[::-1], w[0]
        return matrix

    once = filter_rows(sections, turned([w[::-1] for w in wide]))
    twice = filter_rows(sections, turned([once[i, :n] for i, n in enumerate(sizes)]))
    out = []
    for i, (y, n, u) in enumerate(zip(rows, sizes, used)):
        back = polyphase(twice[i, :n][::-1][None, u : n - u], ratio.numerator, ratio.denominator)[0, : len(y)]
        out.append(np.pad(back, (0, len(y) - len(back))))
    return out


def band_pass(y: np.ndarray, fs: float, **design) -> np.ndarray:
    """The same for the rows of a matrix."""
    return np.array(band_pass_rows(list(y), fs, **design))


def analytic(y: np.ndarray, fs: float, seconds: float = 10.0) -> np.ndarray:
    """Complex series whose real part is ``y``: negative frequencies removed after mirroring both ends."""
    pad = min(int(round(seconds * fs)), y.shape[1])
    wide = _padded(y, pad, edge=True)
    n = wide.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(wide, axis=1) * h, axis=1)[:, pad : pad + y.shape[1]]


# --- operators --------------------------------------------------------------------------------------------------------


def _lists(batch, name: str) -> list[np.ndarray | None]:
    """A list column as arrays; None for a list that is null or holds a null."""
    col = batch.column(batch.schema.get_field_index(name))
    values = col.flatten()
    flat, none = values.to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False)
    size = np.array([v or 0 for v in col.value_lengths().to_pylist()], np.int64)
    starts = np.cumsum(size) - size
    return [flat[a : a + n].astype(np.float64) if known and not none[a : a + n].any() else None for a, n, known in zip(starts, size, col.is_valid().to_pylist())]


def _column(rows: list[np.ndarray | None]):
    """Arrays as a list column; None as null."""
    import pyarrow as pa

    missing = np.array([r is None for r in rows], bool)
    held = [np.zeros(0) if r is None else r for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in held])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held) if held else np.zeros(0)), mask=pa.array(missing))


def _known(rows: list[np.ndarray | None], kernel: Callable[[list[np.ndarray]], list]) -> list:
    """The kernel on the rows that are known; None for the others."""
    out: list = [None] * len(rows)
    at = [i for i, r in enumerate(rows) if r is not None]
    for i, r in zip(at, kernel([rows[i] for i in at])):
        out[i] = r
    return out


def _by_length(rows: list[np.ndarray], kernel: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """The kernel on matrices of rows of equal length; rows of less than two values stay as they are."""
    out: list = [None] * len(rows)
    lengths = np.array([len(r) for r in rows])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i, r in zip(at, kernel(np.array([rows[i] for i in at])) if n > 1 else [rows[i] for i in at]):
            out[i] = r
    return out


def _slices(batches, rows: int = 1024):
    """Batches of bounded numbers of rows, none of them empty."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _map(df: DataFrame, kernel: Callable[[list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    """``y`` replaced by the kernel of a batch's rows; a series that is null or holds a null comes back null."""

    def run(batches):
        for b in _slices(batches):
            at = b.schema.get_field_index("y")
            yield b.set_column(at, "y", _column(_known(_lists(b, "y"), kernel)))

    return df.mapInArrow(run, df.schema)


MOTION = [f"p{i}" for i in range(1, 7)]


#: Motion parameters (frames of all sessions x 6) whose bases are broadcast; more are joined to the series.
MOTION_NUMBERS = 6_000_000


def _basis_of(x: np.ndarray, absolute: bool) -> np.ndarray:
    return basis(np.column_stack([x, np.abs(x)]) if absolute else x)


class _Fit:
    """Residuals of batches of series on their sessions' motion, whose bases are broadcast, or arrays beside each series."""

    def __init__(self, sent, absolute: bool):
        self.sent, self.absolute = sent, absolute

    def __call__(self, b) -> list[np.ndarray | None]:
        """None where the series or its session's parameters hold a null."""
        out, known = [], {} if self.sent is None else self.sent.value
        regs = [_lists(b, f"_{p}") for p in MOTION] if self.sent is None else []
        names = b.column(b.schema.get_field_index("session_id")).to_pylist()
        for i, row in enumerate(_lists(b, "y")):
            if self.sent is None and names[i] not in known:  # one basis for all of a session's series in the batch
                x = [r[i] for r in regs]
                known[names[i]] = None if any(r is None for r in x) else _basis_of(np.column_stack(x), self.absolute)
            q = known[names[i]]
            out.append(None if row is None or q is None else row - q @ (q.T @ row))
        return out


def _with_motion(signal: DataFrame, motion: DataFrame, absolute: bool) -> tuple[DataFrame, _Fit]:
    """The series of sessions with motion, and what fits them.  Rows are counted first: the bases of a few thousand
    sessions (tens of MB) are broadcast, and the series are neither moved nor widened; more are joined to every series as
    arrays in order of frames.
    """
    rows = motion.select("session_id", "t", *MOTION).where("session_id is not null")
    if rows.limit(MOTION_NUMBERS // len(MOTION) + 1).count() * len(MOTION) <= MOTION_NUMBERS:
        table = rows.toArrow().sort_by([("session_id", "ascending"), ("t", "ascending")])
        names = table.column("session_id").to_pylist()
        ends = [i for i in range(1, len(names) + 1) if i == len(names) or names[i] != names[i - 1]]
        x = np.column_stack([table.column(p).to_numpy().astype(np.float64) for p in MOTION])  # nulls are NaN
        bases, at = {}, 0
        for end in ends:
            part = x[at:end]
            bases[names[at]] = None if np.isnan(part).any() else _basis_of(part, absolute)
            at = end
        known = signal.sparkSession.createDataFrame([(n,) for n in bases], f"session_id {dict(motion.dtypes)['session_id']}")
        return signal.join(F.broadcast(known), "session_id", "left_semi").select(signal.columns), _Fit(signal.sparkSession.sparkContext.broadcast(bases), absolute)
    packed = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", *MOTION))).alias("_m"))
    joined = signal.join(packed.select("session_id", *[F.col("_m")[p].alias(f"_{p}") for p in MOTION]), "session_id")
    return joined.select(*signal.columns, *[f"_{p}" for p in MOTION]), _Fit(None, absolute)


def nuisance(signal: DataFrame, motion: DataFrame, absolute: bool = False) -> DataFrame:
    """Residuals of every series on its session's motion parameters (and, if asked for, their absolute values).

    Nothing is grouped in one task.  A series with nulls, or of a session whose parameters hold one, comes back null; one of
    a session without parameters is left out.
    """
    columns, kept = list(signal.columns), signal.schema
    series, fit = _with_motion(signal, motion, absolute)

    def run(batches):
        for b in _slices(batches):
            yield b.set_column(b.schema.get_field_index("y"), "y", _column(fit(b))).select(columns)

    return series.mapInArrow(run, kept)


def spectra(signal: DataFrame, fs: float) -> DataFrame:
    """``session_id, k, freq, psd``: mean smoothed periodogram over all series of a session, which are of one length.

    Series with nulls or of less than nine frames are left out.
    """

    def run(batches):
        import pyarrow as pa

        for b in _slices(batches):
            s = b.column(0).to_pylist()
            total: dict = {}
            for i, row in enumerate(_lists(b, "y")):
                if row is not None and len(row) > 8:
                    have = total.setdefault((s[i], len(row)), [0, 0.0, None])
                    have[2], psd = periodogram(row[None, :], fs)
                    have[0] += 1
                    have[1] = have[1] + psd[0]
            for (name, _), (count, p, freq) in total.items():
                m = len(p)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m, b.schema.field(0).type), pa.array(np.arange(m)), pa.array(freq), pa.array(p), pa.array([count] * m, pa.int64())], names=["session_id", "k", "freq", "sum", "n"])

    kind = dict(signal.dtypes)["session_id"]
    sums = signal.select("session_id", "y").mapInArrow(run, f"session_id {kind}, k long, freq double, sum double, n long")
    return sums.groupBy("session_id", "k", "freq").agg((F.sum("sum") / F.sum("n")).alias("psd"))


def spectral_norm(signal: DataFrame, fs: float, low: float | None = None, high: float = NORM_HZ) -> DataFrame:
    """``session_id, norm``: root of the power up to a frequency (and over another), one number for a session's series."""
    psd = spectra(signal, fs).where(F.col("freq") <= high)
    return (psd if low is None else psd.where(F.col("freq") > low)).groupBy("session_id").agg(F.sqrt(F.sum("psd")).alias("norm"))


def normalise(signal: DataFrame, fs: float) -> DataFrame:
    """Series divided by their session's spectral norm.  The input is evaluated twice; :func:`preprocess` does not."""
    norm = spectral_norm(signal, fs)
    return signal.join(norm, "session_id").withColumn("y", F.transform("y", lambda v: v / F.col("norm"))).select(*signal.columns)


def band_passed(signal: DataFrame, fs: float, **design) -> DataFrame:
    return _map(signal, lambda rows: band_pass_rows(rows, fs, **design))


def resampled(signal: DataFrame, fs: float, fs_new: float) -> DataFrame:
    return _map(signal, lambda rows: _by_length(rows, lambda y: resample(y, fs, fs_new)))


def resampled_by(signal: DataFrame, p: int, q: int) -> DataFrame:
    """Series resampled by p/q through :func:`polyphase`; one of less than two values stays as it is."""
    return _map(signal, lambda rows: _by_length(rows, lambda y: polyphase(y, p, q)))


def _complex(rows: list[np.ndarray | None], fs: float) -> list:
    """Real and imaginary parts of the analytic signal as two list columns."""
    z = _known(rows, lambda some: _by_length(some, lambda y: analytic(y, fs)))
    return [_column([None if v is None else part(v) for v in z]) for part in (np.real, np.imag)]


def analytic_signal(signal: DataFrame, fs: float) -> DataFrame:
    """The series as ``re[]``, ``im[]`` in place of ``y[]``; null where the series is null or holds a null."""
    import pyarrow as pa

    keys = [c for c in signal.columns if c != "y"]

    def run(batches):
        for b in _slices(batches):
            cols = [b.column(b.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, *_complex(_lists(b, "y"), fs)], names=[*keys, "re", "im"])

    fields = "".join(f"{k} {t}, " for k, t in signal.dtypes if k != "y")
    return signal.select(*keys, "y").mapInArrow(run, fields + "re array<double>, im array<double>")


def prepared(signal: DataFrame, motion: DataFrame, vertices: DataFrame, fs: float, fs_up: float, absolute: bool = False) -> DataFrame:
    """Valid vertices, nuisance regression, up-sampling, band-pass and analytic signal in one pass: ``session_id, hemi,
    vertex, re[], im[]``, not yet divided by the session's norm, and ``power``, each series' share in it.

    All steps after the norm are linear, so it can be divided out at the end: its square is the mean of ``power`` over the
    session's series.
    """
    import pyarrow as pa

    # series stay where they are: a shuffle by vertex would give a task all sessions' series of one
    kept = signal.join(few(vertices.select("hemi", "vertex")), ["hemi", "vertex"], "left_semi").select("session_id", "hemi", "vertex", "y")
    series, fit = _with_motion(kept, motion, absolute)

    def power(rows: list[np.ndarray]) -> list[float | None]:
        found = _by_length(rows, lambda y: band_power(y, fs) if y.shape[1] > 8 else y[:, 0])
        return [float(p) if len(r) > 8 else None for r, p in zip(rows, found)]

    def run(batches):
        for b in _slices(batches):
            clean = fit(b)
            up = _known(clean, lambda rows: _by_length(rows, lambda y: resample(y, fs, fs_up)))
            smooth = _known(up, lambda rows: band_pass_rows(rows, fs_up))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *_complex(smooth, fs_up), pa.array(_known(clean, power), pa.float64())], names=["session_id", "hemi", "vertex", "re", "im", "power"])

    kinds = ", ".join(f"{k} {t}" for k, t in kept.dtypes[:3])
    return series.mapInArrow(run, f"{kinds}, re array<double>, im array<double>, power double")


def preprocess(signal: DataFrame, motion: DataFrame, vertices: DataFrame, fs: float, fs_up: float, absolute: bool = False, tmp: Scratch | None = None) -> DataFrame:
    """The whole chain by series: ``session_id, hemi, vertex, re[], im[]``.

    The series are written once and read for the norm and for the result; the table goes to ``tmp``, without which it
    stays in the shared folder.  For frames rather than series use :func:`preprocess_obs`, which writes nothing.
    """
    made = (tmp or Scratch(signal.sparkSession, "preprocess")).save(prepared(signal, motion, vertices, fs, fs_up, absolute), "series")
    norm = made.groupBy("session_id").agg(F.sqrt(F.avg("power")).alias("norm"))
    scaled = [F.transform(part, lambda v: v / F.col("norm")).alias(part) for part in ("re", "im")]
    return made.join(norm, "session_id").select("session_id", "hemi", "vertex", *scaled)


#: Vertices that are turned from series to frames together.
TURNED = 512


def _turn(table):
    """A block of vertices of one session and hemisphere as one row for each frame; the block's power goes with each."""
    import pyarrow as pa

    vertex = table.column("vertex").to_numpy()
    rows = [table.slice(int(i), 1) for i in np.argsort(vertex, kind="stable")]
    parts = [[r.column(c)[0].values.to_numpy(zero_copy_only=False) for r in rows] for c in ("re", "im")]
    frames = max(len(r) for r in parts[0])
    if min(len(r) for r in parts[0]) == frames:
        columns = [_column(list(np.array(p).T)) for p in parts]
    else:
        columns = [_column([np.array([r[t] for r in p if t < len(r)]) for t in range(frames)]) for p in parts]
    power = table.column("power").drop_null().to_numpy()
    same = [table.column(c).take(pa.array(np.zeros(frames, np.int64))) for c in ("session_id", "hemi", "block")]
    return pa.table(
        [same[0], pa.array(np.arange(frames, dtype=np.int32)), *same[1:], *columns, pa.array(np.full(frames, power.sum())), pa.array(np.full(frames, len(power)))],
        names=["session_id", "t", "hemi", "block", "re", "im", "power", "n"],
    )


def _frames(series: DataFrame, scaled: bool) -> DataFrame:
    kinds = dict(series.dtypes)
    known = series.where("re is not null and im is not null and size(re) > 0").withColumn("block", F.expr(f"cast(floor(vertex / {TURNED}) as long)"))
    schema = f"session_id {kinds['session_id']}, t int, hemi {kinds['hemi']}, block long, re array<double>, im array<double>, power double, n long"
    turned = known.groupBy("session_id", "hemi", "block").applyInArrow(lambda table: _turn(table), schema)
    rows = turned.groupBy("session_id", "t").agg(F.sort_array(F.collect_list(F.struct("hemi", "block", "re", "im"))).alias("a"), F.sqrt(F.sum("power") / F.sum("n")).alias("norm"))
    flat = rows.select("session_id", "t", "norm", *[F.flatten(F.col("a")[part]).alias(part) for part in ("re", "im")])
    if scaled:
        flat = flat.select("session_id", "t", *[F.transform(part, lambda v: v / F.col("norm")).alias(part) for part in ("re", "im")])
    return flat.select("session_id", "t", "re", "im")


def to_obs(analytic_rows: DataFrame) -> DataFrame:
    """Series by vertex -> rows by frame ``(session_id, t, re[], im[])``, variables ordered by hemisphere and vertex.

    Blocks of vertices are turned first, so a frame is put together from a few arrays, not from single cells.  Null
    series are left out.
    """
    return _frames(analytic_rows.withColumn("power", F.lit(None).cast("double")), False)


def preprocess_obs(signal: DataFrame, motion: DataFrame, vertices: DataFrame, fs: float, fs_up: float, absolute: bool = False) -> DataFrame:
    """The whole chain by frame, ``(session_id, t, re[], im[])``: one pass over the series, then two shuffles that turn
    them; every frame gets the power of all of its session's blocks, so the norm needs no pass of its own.
    """
    return _frames(prepared(signal, motion, vertices, fs, fs_up, absolute), True)
