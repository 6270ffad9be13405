"""Complex principal components of distributed matrices.

A matrix is a DataFrame of rows ``(session_id, t, re[], im[])``.  Everything that touches all rows is one Arrow pass
that returns sums of ``variables x components`` numbers, packed and added in a tree (:mod:`.packed`); the small algebra is
done on the driver, whose memory holds loadings only.  No variables x variables matrix is made except by ``exact`` for few
variables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import ordered, packed, qr

#: ``exact`` makes a matrix of variables x variables on the driver; more variables need another solver.
EXACT_VARIABLES = 4000


def rows(batch) -> np.ndarray:
    """Complex matrix of a batch with columns re[], im[]; rows of unequal lengths, or with nulls, raise."""
    parts = []
    for name in ("re", "im"):
        column = batch.column(batch.schema.get_field_index(name))
        values = column.flatten()
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        if column.null_count or values.null_count or (sizes != sizes[0]).any():
            raise ValueError(f"a matrix has rows of one length without nulls; {name} does not")
        parts.append(values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1))
    if parts[0].shape != parts[1].shape:
        raise ValueError("real and imaginary parts are of unequal length")
    return parts[0] + 1j * parts[1]


class _Moments:
    """Means and centred sums of squared moduli of a task's rows and of their scores, batch after batch."""

    def __init__(self, weights):
        self.weights = weights

    def __call__(self, batches):
        w = self.weights.value
        held, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = rows(batch)
                x = np.concatenate([x, x @ w], 1)
                mean = x.mean(0)
                away = x - mean
                new = np.stack([mean.real, mean.imag, (away.real**2 + away.imag**2).sum(0)], 1)
                held = new if held is None else packed.merge_moments(n, held, len(x), new).reshape(-1, 3)
                n += len(x)
        if held is not None:
            yield from packed.give(held, n)


def moments(x: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and variances of all variables and then of the scores on ``w``, and the number of rows, in one Arrow pass.

    Centred sums are merged, so variances keep their digits however far the means are from 0.
    """
    sent = x.sparkSession.sparkContext.broadcast(np.asarray(w, np.complex128))
    flat, n = packed.fetch(x.select("re", "im").mapInArrow(_Moments(sent), packed.FIELDS), packed.merge_moments)
    found = flat.reshape(-1, 3)
    return found[:, 0] + 1j * found[:, 1], found[:, 2] / max(n - 1, 1), n


class _Pass:
    """Sums ``conj(X).T @ f(X)`` over a task's rows, with the number of rows."""

    def __init__(self, weights, mean: np.ndarray | None):
        self.weights, self.mean = weights, mean

    def __call__(self, batches):
        w = self.weights.value
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = rows(batch)
                if self.mean is not None:
                    x = x - self.mean
                part = x.conj().T @ (x @ w)
                total = part if total is None else total + part
                n += len(x)
        if total is not None:
            yield from packed.give(total, n)


def gram_times(x: DataFrame, w: np.ndarray, mean: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """``(X^H X) W`` and the number of rows, without ``X^H X``: one pass, packed sums of variables x components."""
    sent = x.sparkSession.sparkContext.broadcast(np.asarray(w, np.complex128))
    flat, n = packed.fetch(x.select("re", "im").mapInArrow(_Pass(sent, mean), packed.FIELDS))
    return (flat.view(np.complex128).reshape(w.shape) if n else np.zeros(w.shape, np.complex128)), n


class _Score:
    def __init__(self, weights, conj: bool):
        self.weights, self.conj = weights, conj

    def __call__(self, batches):
        w = self.weights.value
        for batch in batches:
            if batch.num_rows:
                x = rows(batch)[:, : len(w)]
                z = (x.conj() if self.conj else x) @ w[: x.shape[1]]
                k = z.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(len(z)), k))), batch.column(1).take(pa.array(np.repeat(np.arange(len(z)), k))), pa.array(np.tile(np.arange(k, dtype=np.int32), len(z))), pa.array(z.real.reshape(-1)), pa.array(z.imag.reshape(-1))],
                    names=["session_id", "t", "pc", "re", "im"],
                )


def scores(x: DataFrame, w: np.ndarray, conj: bool = False) -> DataFrame:
    """``session_id, t, pc, re, im``: rows times loadings; with ``conj`` the rows are conjugated first.  What either has
    more variables than the other counts as 0.
    """
    kinds = dict(x.dtypes)
    sent = x.sparkSession.sparkContext.broadcast(np.asarray(w, np.complex128))
    return x.select("session_id", "t", "re", "im").mapInArrow(_Score(sent, conj), f"session_id {kinds['session_id']}, t {kinds['t']}, pc int, re double, im double")


def loadings(spark, w: np.ndarray, run: int = 0) -> DataFrame:
    p, k = w.shape
    rows = [(run, v, c, float(w[v, c].real), float(w[v, c].imag)) for v in range(p) for c in range(k)]
    return spark.createDataFrame(rows, "run int, vertex int, pc int, re double, im double")


def fix_phase(w: np.ndarray) -> np.ndarray:
    """Each component turned so that its entry of largest modulus is real and positive."""
    top = w[np.argmax(np.abs(w), axis=0), np.arange(w.shape[1])]
    return w * (np.abs(top) / np.where(top == 0, 1, top))


def mcc(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Modulus of the complex correlation of matching columns."""
    a, b = a - a.mean(0), b - b.mean(0)
    return np.abs((a.conj() * b).sum(0)) / np.sqrt((np.abs(a) ** 2).sum(0) * (np.abs(b) ** 2).sum(0))


def _variables(x: DataFrame) -> int:
    row = x.select(F.size("re").alias("p")).first()
    if row is None:
        raise ValueError("the matrix has no rows")
    return int(row["p"])


def start(p: int, k: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.linalg.qr(rng.standard_normal((p, k)) + 1j * rng.standard_normal((p, k)))[0]


def _rotate(x: DataFrame, q: np.ndarray) -> np.ndarray:
    """Principal directions within the span of q, largest first."""
    return _turned(q, gram_times(x, q)[0])


def _turned(q: np.ndarray, gq: np.ndarray) -> np.ndarray:
    """The same, with the product of the Gram matrix and q known."""
    small = q.conj().T @ gq
    values, vectors = np.linalg.eigh((small + small.conj().T) / 2)
    return q @ vectors[:, np.argsort(-values)]


def exact(x: DataFrame, k: int) -> np.ndarray:
    """All of the Gram matrix, for few variables."""
    p = _variables(x)
    if p > EXACT_VARIABLES:
        raise ValueError(f"exact() is for up to {EXACT_VARIABLES} variables, not {p}; use randomised()")
    g, _ = gram_times(x, np.eye(p, dtype=np.complex128))
    values, vectors = np.linalg.eigh((g + g.conj().T) / 2)
    return fix_phase(vectors[:, np.argsort(-values)][:, :k])


def randomised(x: DataFrame, k: int, over: int = 10, passes: int = 2, seed: int = 0) -> np.ndarray:
    """Range finder with power passes, then the small problem within the range."""
    p = _variables(x)
    q = start(p, min(p, k + over), seed)
    for _ in range(passes + 1):
        q = np.linalg.qr(gram_times(x, q)[0])[0]
    return fix_phase(_rotate(x, q)[:, :k])


def _hash(seed: int):
    """A row's hash, which SQL engines know too."""
    return F.md5(F.concat_ws(":", F.col("session_id").cast("string"), F.col("t").cast("string"), F.lit(str(seed))))


def sample_start(x: DataFrame, k: int, size: int, seed: int = 0) -> np.ndarray:
    """Start from the singular vectors of exactly ``size`` rows, taken by hash order.

    The rows' keys reach the driver, the rows do not: they are factored by a tree over ranges of their variables.
    """
    keys = x.select("session_id", "t", _hash(seed).alias("h")).orderBy("h", "session_id", "t").limit(size).collect()
    if not keys:
        raise ValueError("the matrix has no rows")
    kinds = dict(x.dtypes)
    places = x.sparkSession.createDataFrame([(r["session_id"], r["t"], i) for i, r in enumerate(keys)], f"session_id {kinds['session_id']}, t {kinds['t']}, i long")
    return qr.singular_of_few(x, places, ["session_id", "t"], len(keys), k)[1]


# --- schedules --------------------------------------------------------------------------------------------------------


def log_linear(first: float, last: float, n: int) -> np.ndarray:
    return np.exp(np.linspace(np.log(first), np.log(last), n))


def cosine(first: float, last: float, n: int) -> np.ndarray:
    return last + (first - last) * (1 + np.cos(np.pi * np.arange(n) / max(1, n - 1))) / 2


def log_spline(knots: Sequence[float], n: int) -> np.ndarray:
    """Natural cubic spline through the logarithms of evenly spaced knots."""
    y = np.log(np.asarray(knots, float))
    m = len(y)
    a = np.zeros((m, m))
    b = np.zeros(m)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, m - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        b[i] = 6 * (y[i - 1] - 2 * y[i] + y[i + 1])
    c = np.linalg.solve(a, b)
    x = np.linspace(0, m - 1, n)
    i = np.minimum(x.astype(int), m - 2)
    u, v = i + 1 - x, x - i
    return np.exp(u * y[i] + v * y[i + 1] + ((u**3 - u) * c[i] + (v**3 - v) * c[i + 1]) / 6)


def schedule(values: float | Sequence[float], epochs: int, iterations: int) -> np.ndarray:
    """A number, one for each epoch, or one for each iteration, as epochs x iterations."""
    v = np.atleast_1d(np.asarray(values, float))
    if v.size == 1:
        return np.full((epochs, iterations), v[0])
    if v.size == epochs:
        return np.repeat(v[:, None], iterations, 1)
    if v.size == epochs * iterations:
        return v.reshape(epochs, iterations)
    raise ValueError(f"a schedule has 1, {epochs} or {epochs * iterations} values, not {v.size}")


# --- iterative solvers ------------------------------------------------------------------------------------------------


@dataclass
class Fit:
    """Loadings, and the trace of each iteration (agreement with a reference if one was given)."""

    w: np.ndarray
    trace: list[dict] = field(default_factory=list)
    status: str = "done"


def with_blocks(x: DataFrame, blocks: int, seed: int = 0) -> DataFrame:
    """Rows dealt to ``blocks`` by hash; a mini-batch is a set of blocks."""
    return x.withColumn("block", (F.conv(F.substring(_hash(seed), 1, 8), 16, 10).cast("long") % blocks).cast("int"))


def drawn(count: int, take: int, rng) -> list[int]:
    """Blocks of the next mini-batch."""
    return sorted(rng.choice(count, size=min(take, count), replace=False).tolist())


def _stacked(new: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Both brought to scale by the triangular factor of one above the other; None if that is singular."""
    r = np.linalg.qr(np.vstack([new, old]), mode="r")
    if not np.all(np.isfinite(r)) or np.min(np.abs(np.diag(r))) < 1e-12:
        return None
    inv = np.linalg.inv(r)
    return new @ inv, old @ inv


class Blocks:
    """Blocks of rows of which mini-batches are made: rows of a DataFrame, dealt by hash and cached, or the stored blocks of
    a tiled matrix (:mod:`..sources.tiles`), of which a batch opens its own files only.
    """

    def __init__(self, x, blocks: int, seed: int):
        self.tiled = None if isinstance(x, DataFrame) else x
        self.all = x if self.tiled is None else x.matrix()
        self.count = blocks if self.tiled is None else x.row_blocks
        self.dealt = with_blocks(x, blocks, seed).persist() if self.tiled is None else None

    def batch(self, take: int, rng) -> DataFrame:
        return self.of(drawn(self.count, take, rng))

    def of(self, chosen: Sequence[int]) -> DataFrame:
        """Rows of some blocks, with their ``block``."""
        if self.dealt is None:
            return self.tiled.blocks(chosen).withColumn("block", F.floor(F.col("row") / self.tiled.rows).cast("int"))
        return self.dealt.where(F.col("block").isin([int(b) for b in chosen]))

    def close(self) -> None:
        if self.dealt is not None:
            self.dealt.unpersist()


def pim(x: DataFrame, w: np.ndarray, iterations: int, beta: float | Sequence[float] = 0.0, blocks: int = 10, take: int = 5, seed: int = 0, reference: np.ndarray | None = None) -> Fit:
    """Mini-batch power iteration with momentum.  ``x``, here and below: rows, or a tiled matrix with blocks of its own."""
    blocked = Blocks(x, blocks, seed)
    x = blocked.all
    rng, old, fit, betas = np.random.default_rng(seed), np.zeros_like(w), Fit(w), schedule(beta, 1, iterations)[0]
    for i in range(iterations):
        g, n = gram_times(blocked.batch(take, rng), w)
        if not n:
            continue
        scaled = _stacked(g / n - betas[i] * old, w)
        if scaled is None:
            fit.status = f"stopped at iteration {i}: the basis became singular"
            break
        w, old = scaled
        fit.trace.append({"iteration": i, "mcc": None if reference is None else mcc(reference, w).tolist()})
    blocked.close()
    fit.w = fix_phase(_rotate(x, np.linalg.qr(w)[0]))
    return fit


def pimvr(
    x: DataFrame,
    w: np.ndarray,
    epochs: int,
    iterations: int,
    beta: float | Sequence[float] = 0.0,
    blocks: int = 10,
    take: int = 5,
    seed: int = 0,
    center_batches: bool = False,
    compat_alpha: bool = False,
    reference: np.ndarray | None = None,
) -> Fit:
    """The same with reduced variance: each epoch begins with a pass over all rows at an anchor, and mini-batches only
    estimate what differs from the anchor.  Averages are over rows; ``compat_alpha`` takes the conjugate transpose of the
    projection on the anchor; ``center_batches`` subtracts each mini-batch's mean.
    """
    blocked = Blocks(x, blocks, seed)
    x = blocked.all
    rng, old, fit, betas = np.random.default_rng(seed), np.zeros_like(w), Fit(w), schedule(beta, epochs, iterations)
    for e in range(epochs):
        anchor = np.linalg.qr(w)[0]
        full, n = gram_times(x, anchor)
        full /= n
        for i in range(iterations):
            alpha = w.conj().T @ anchor if compat_alpha else anchor.conj().T @ w
            part = blocked.batch(take, rng)
            mean = None
            if center_batches:
                mean = moments(part, np.zeros((len(w), 0)))[0]
                mean = mean if len(mean) else None
            g, m = gram_times(part, w - anchor @ alpha, mean)
            if not m:
                continue
            scaled = _stacked(g / m + full @ alpha - betas[e, i] * old, w)
            if scaled is None:
                fit.status = f"stopped at epoch {e}, iteration {i}: the basis became singular"
                break
            w, old = scaled
            fit.trace.append({"epoch": e, "iteration": i, "mcc": None if reference is None else mcc(reference, w).tolist()})
        if fit.status != "done":
            break
    blocked.close()
    fit.w = fix_phase(_rotate(x, np.linalg.qr(w)[0]))
    return fit


class _Chosen:
    """``X^H (X W)`` of several runs at once: each has its own columns of W and takes the rows of its own blocks only; below
    it, one row with the number of rows that each took.
    """

    def __init__(self, w, takes: dict, runs: int):
        self.w, self.takes, self.runs = w, takes, runs

    def __call__(self, batches):
        w, total, n = self.w.value, None, 0
        none = np.zeros(self.runs)
        for batch in batches:
            if batch.num_rows:
                x = rows(batch)
                by = np.array([self.takes.get(b, none) for b in batch.column(0).to_pylist()])
                part = x.conj().T @ ((x @ w) * np.repeat(by, w.shape[1] // self.runs, 1))
                counts = np.zeros((1, w.shape[1]), np.complex128)
                counts[0, : self.runs] = by.sum(0)
                part = np.vstack([part, counts])
                total = part if total is None else total + part
                n += len(x)
        if total is not None:
            yield from packed.give(total, n)


def gram_times_of(blocked: Blocks, ws: Sequence[np.ndarray], chosen: Sequence[Sequence[int]]) -> list[tuple[np.ndarray, int]]:
    """``(X_j^H X_j) W_j`` and the number of rows, for runs j that each take blocks of their own: one pass over all blocks
    that any of them takes.
    """
    (p, k), runs = ws[0].shape, len(ws)
    takes = {b: np.array([float(b in c) for c in chosen]) for b in sorted(set().union(*chosen))}
    x = blocked.of(list(takes)).select("block", "re", "im")
    sent = x.sparkSession.sparkContext.broadcast(np.hstack(ws))
    flat, n = packed.fetch(x.mapInArrow(_Chosen(sent, takes, runs), packed.FIELDS))
    if not n:
        return [(np.zeros((p, k), np.complex128), 0)] * runs
    whole = flat.view(np.complex128).reshape(p + 1, -1)
    return [(whole[:p, j * k : (j + 1) * k], int(whole[p, j].real)) for j in range(runs)]


def pimvr_restarts(
    x: DataFrame,
    starts: Sequence[np.ndarray],
    epochs: int,
    iterations: int,
    beta: float | Sequence[float] = 0.0,
    blocks: int = 10,
    take: int = 5,
    seed: int = 0,
    compat_alpha: bool = False,
) -> list[tuple[int, Fit, np.ndarray]]:
    """:func:`pimvr` from several starts of one shape side by side: (run, fit, explained shares), best total first.

    Run j draws its own mini-batches, with ``seed + j``; rows are dealt to blocks once.  All runs share each pass (over the
    rows for anchors, over the blocks that any run drew for mini-batches), as columns of one matrix, and so do the final
    rotations and the variances.  A run whose basis becomes singular stops, the others go on.  Where every run's mini-batch
    is empty the iteration changes nothing; without rows the matrix raises.
    """
    if len({w.shape for w in starts}) != 1:
        raise ValueError("restarts need at least one start, all of one shape")
    blocked, (p, k) = Blocks(x, blocks, seed), starts[0].shape
    x, betas = blocked.all, schedule(beta, epochs, iterations)
    rngs = [np.random.default_rng(seed + j) for j in range(len(starts))]
    fits, olds = [Fit(w) for w in starts], [np.zeros_like(w) for w in starts]

    def cut(whole: np.ndarray) -> list[np.ndarray]:
        return [whole[:, j * k : (j + 1) * k] for j in range(len(starts))]

    try:
        for e in range(epochs):
            anchors = [np.linalg.qr(f.w)[0] for f in fits]
            whole, n = gram_times(x, np.hstack(anchors))
            if not n:
                raise ValueError("the matrix has no rows")
            full = cut(whole / n)
            for i in range(iterations):
                live = [j for j, f in enumerate(fits) if f.status == "done"]
                if not live:
                    break
                alphas = {j: fits[j].w.conj().T @ anchors[j] if compat_alpha else anchors[j].conj().T @ fits[j].w for j in live}
                chosen = [drawn(blocked.count, take, rngs[j]) for j in live]
                parts = gram_times_of(blocked, [fits[j].w - anchors[j] @ alphas[j] for j in live], chosen)
                for j, (g, m) in zip(live, parts):
                    if not m:
                        continue
                    scaled = _stacked(g / m + full[j] @ alphas[j] - betas[e, i] * olds[j], fits[j].w)
                    if scaled is None:
                        fits[j].status = f"stopped at epoch {e}, iteration {i}: the basis became singular"
                        continue
                    fits[j].w, olds[j] = scaled
                    fits[j].trace.append({"epoch": e, "iteration": i, "rows": m})
    finally:
        blocked.close()
    qs = [np.linalg.qr(f.w)[0] for f in fits]
    for f, q, g in zip(fits, qs, cut(gram_times(x, np.hstack(qs))[0])):
        f.w = fix_phase(_turned(q, g))
    var = moments(x, np.hstack([f.w for f in fits]))[1]
    shares = [var[p + j * k : p + (j + 1) * k] / var[:p].sum() for j in range(len(fits))]
    return sorted(((j, f, s) for j, (f, s) in enumerate(zip(fits, shares))), key=lambda r: (-r[2].sum(), r[0]))


def rayleigh(x: DataFrame, w: np.ndarray) -> np.ndarray:
    """Mean squared modulus of the rows' scores on each direction, brought to unit length; one pass."""
    g, n = gram_times(x, w)
    return np.real((w.conj() * g).sum(0)) / (np.abs(w) ** 2).sum(0) / max(n, 1)


def heavy_ball(x: DataFrame, w: np.ndarray, iterations: int, every: int = 10, factors: Sequence[float] = (2 / 3, 0.99, 1.01, 1.5), blocks: int = 10, take: int = 5, seed: int = 0) -> Fit:
    """Power iteration that looks for its momentum: runs side by side with ``factors`` times a centre, at first the squared
    sum of Rayleigh quotients of the start over four; every so many iterations the run with the largest sum of quotients
    gives the next centre.  All runs share each pass, as columns of one matrix; the best one is returned, and ``trace``
    tells the centres.
    """
    blocked = Blocks(x, blocks, seed)
    x = blocked.all
    rng, k = np.random.default_rng(seed), w.shape[1]
    centre = float(rayleigh(x, w).sum() ** 2 / 4)
    runs = [(w, np.zeros_like(w)) for _ in factors]
    fit = Fit(w, [{"iteration": 0, "beta": centre}])
    for i in range(1, iterations + 1):
        g, n = gram_times(blocked.batch(take, rng), np.hstack([now for now, _ in runs]))
        if n:
            scaled = [_stacked(g[:, j * k : (j + 1) * k] / n - f * centre * old, now) for j, (f, (now, old)) in enumerate(zip(factors, runs))]
            runs = [made or run for made, run in zip(scaled, runs)]  # a run whose basis became singular stays where it was
        if i % every == 0 or i == iterations:
            best = int(np.argmax(rayleigh(x, np.hstack([np.linalg.qr(now)[0] for now, _ in runs])).reshape(len(runs), k).sum(1)))
            fit.w, centre = runs[best][0], factors[best] * centre
            fit.trace.append({"iteration": i, "beta": centre})
    blocked.close()
    fit.w = fix_phase(_rotate(x, np.linalg.qr(fit.w)[0]))
    return fit


def oja(x: DataFrame, w: np.ndarray, iterations: int, rate: float | Sequence[float], blocks: int = 10, take: int = 1, seed: int = 0) -> Fit:
    """Oja's rule on blocks: ``W <- Q factor of W + rate * mean of x^H (x W)``."""
    blocked = Blocks(x, blocks, seed)
    x = blocked.all
    rng, fit, rates = np.random.default_rng(seed), Fit(w), schedule(rate, 1, iterations)[0]
    for i in range(iterations):
        g, n = gram_times(blocked.batch(take, rng), w)
        if n:
            w = np.linalg.qr(w + rates[i] * g / n)[0]
        fit.trace.append({"iteration": i})
    blocked.close()
    fit.w = fix_phase(_rotate(x, w))
    return fit


class _RowByRow:
    """Oja's rule on one row after the other, in the order in which they come; the basis is what is given at the end."""

    def __init__(self, w, rate: float):
        self.w, self.rate = w, rate

    def __call__(self, batches):
        w, n = self.w.value, 0
        for batch in batches:
            for x in rows(batch) if batch.num_rows else ():
                w = np.linalg.qr(w + self.rate * np.outer(x.conj(), x @ w))[0]
                n += 1
        if n:
            yield from packed.give(w, n)


def oja_rows(x: DataFrame, w: np.ndarray, iterations: int, rate: float | Sequence[float], size: int, seed: int = 0) -> Fit:
    """Oja's rule row by row: each iteration draws ``size`` rows anew by hash and updates with each of them, in this order.

    Such updates follow one another by definition, so an iteration's rows stream through one task, which holds a batch of
    them and the basis: ``size`` bounds the work of an iteration, not the rows of ``x``.
    """
    fit, rates, p = Fit(w), schedule(rate, 1, iterations)[0], len(w)
    kinds, spark = dict(x.dtypes), x.sparkSession
    for i in range(iterations):
        order = F.xxhash64(F.col("session_id"), F.col("t"), F.lit(seed), F.lit(i))
        keys = x.select("session_id", "t", order.alias("h")).orderBy("h", "session_id", "t").limit(size).collect()
        places = spark.createDataFrame([(r["session_id"], r["t"], k) for k, r in enumerate(keys)], f"session_id {kinds['session_id']}, t {kinds['t']}, i long")
        drawn = x.join(F.broadcast(places), ["session_id", "t"]).repartition(1).sortWithinPartitions("i").select("re", "im")
        flat, n = packed.fetch(drawn.mapInArrow(_RowByRow(spark.sparkContext.broadcast(w), float(rates[i])), packed.FIELDS))
        w = flat.view(np.complex128).reshape(p, -1).copy() if n else w
        fit.trace.append({"iteration": i, "rows": n})
    fit.w = fix_phase(_rotate(x, w))
    return fit


def oja_sessions(x: DataFrame, w: np.ndarray, epochs: int, rate: float | Sequence[float], length: int, seed: int = 0) -> Fit:
    """Oja's rule on batches that hold a contiguous block of each session (:func:`.ordered.epoch_blocks`); in an epoch every
    row takes part once.  ``rate``: one for all, or one for each epoch.
    """
    spark = x.sparkSession
    with Scratch(spark, "oja") as tmp:
        at = F.row_number().over(Window.partitionBy("session_id").orderBy("t")) - 1
        known = tmp.save(x.select("session_id", "t", "re", "im", F.floor(at / length).cast("long").alias("block")), "rows")
        sizes = known.groupBy("session_id").agg(F.count("*").alias("n"))
        plan = tmp.save(ordered.epoch_blocks(sizes, length, epochs, seed), "plan")
        fit, rates = Fit(w), schedule(rate, epochs, 1)[:, 0]
        batches = {r["epoch"]: r["n"] for r in plan.groupBy("epoch").agg(F.max("batch").alias("n")).collect()}
        for e in range(epochs):
            for b in range(1, batches.get(e + 1, 0) + 1):
                chosen = plan.where((F.col("epoch") == e + 1) & (F.col("batch") == b)).select("session_id", "block")
                g, n = gram_times(known.join(F.broadcast(chosen), ["session_id", "block"], "left_semi"), w)  # a row a session
                w = np.linalg.qr(w + rates[e] * g / n)[0]
                fit.trace.append({"epoch": e, "batch": b, "rows": n})
        fit.w = fix_phase(_rotate(known, w))
    return fit


def dual_directions(m: np.ndarray, k: int) -> np.ndarray:
    """Directions of a small matrix with fewer rows than variables, through its rows x rows product."""
    values, vectors = np.linalg.eigh(m @ m.conj().T)
    top = np.argsort(-values)[:k]
    w = m.conj().T @ vectors[:, top]
    return fix_phase(w / np.linalg.norm(w, axis=0))


class _Project:
    """Sums ``X^H u`` over a task's rows, whose places in ``u`` are in column ``i``."""

    def __init__(self, u):
        self.u = u

    def __call__(self, batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                part = rows(batch).conj().T @ self.u.value[batch.column(batch.schema.get_field_index("i")).to_numpy()]
                total = part if total is None else total + part
                n += batch.num_rows
        if total is not None:
            yield from packed.give(total, n)


def ranges(batches, n: int):
    """Whole ranges of variables of n rows, of batches ``group, i, re[], im[]`` in the order of ``group``."""
    x, now = None, None
    for batch in batches:
        groups = batch.column(0).to_numpy()
        for g in np.unique(groups):
            if g != now and x is not None:
                yield x
                x = None
            now = g
            part = batch.filter(pa.array(groups == g))
            values = rows(part)
            if x is None:
                x = np.zeros((n, values.shape[1]), np.complex128)
            x[part.column(1).to_numpy()] = values
    if x is not None:
        yield x


class _PartialGram:
    """Sums, over the ranges of variables of a task, of the products of all rows with each other.  A range's rows come one
    after the other; one range and one product are held.
    """

    def __init__(self, n: int):
        self.n = n

    def __call__(self, batches):
        total = None
        for x in ranges(batches, self.n):
            part = x @ x.conj().T
            total = part if total is None else total + part
        if total is not None:
            yield from packed.give(total, self.n)


def cut_ranges(known: DataFrame, width: int) -> DataFrame:
    """``known(i, re[], im[])`` cut into ranges of ``width`` variables, the rows of a range together in one task."""
    cut = known.withColumn("group", F.explode(F.expr(f"sequence(0, (size(re) - 1) div {width})")))
    cut = cut.select("group", "i", *[F.slice(c, F.col("group") * width + 1, F.lit(width)).alias(c) for c in ("re", "im")])
    return cut.repartition(known.sparkSession.sparkContext.defaultParallelism, "group").sortWithinPartitions("group")


def project(known: DataFrame, u: np.ndarray) -> np.ndarray:
    """``X^H u`` of the rows ``known(i, re[], im[])``."""
    sent = known.sparkSession.sparkContext.broadcast(u)
    flat, _ = packed.fetch(known.select("i", "re", "im").mapInArrow(_Project(sent), packed.FIELDS))
    return flat.view(np.complex128).reshape(-1, u.shape[1]).copy()


def dual(x: DataFrame, k: int, width: int = 1024) -> np.ndarray:
    """Principal directions of few rows of very many variables, through the product of rows with rows.

    The variables are cut into ranges of ``width``, dealt out over tasks; a task adds the products of its ranges, and these
    are added in a tree.  Rows are numbered by a broadcast list of their ids.  What reaches the driver is rows x rows and
    variables x components numbers; ``exact``'s limit holds for the rows.

    More rows, of up to ``qr.WIDEST`` variables, are first brought to as many as there are variables: X = Q R has the same
    product as R but for a turn of the rows by Q, so R's few rows have the directions of all.  More rows of more variables
    raise.
    """
    spark = x.sparkSession
    with Scratch(spark, "dual") as tmp:
        known = tmp.save(x.select("re", "im").withColumn("id", F.monotonically_increasing_id()), "rows")
        ids = [r[0] for r in known.select("id").limit(EXACT_VARIABLES + 1).collect()]
        n = len(ids)
        if n > EXACT_VARIABLES:
            if (p := _variables(known)) > qr.WIDEST:
                raise ValueError(f"dual() is for up to {EXACT_VARIABLES} rows, or {qr.WIDEST} variables, not more of both; use randomised()")
            return dual_directions(qr.r_factor(known), k)
        if not n:
            raise ValueError("the matrix has no rows")
        places = spark.createDataFrame(list(zip(sorted(ids), range(n))), "id long, i long")
        known = known.join(F.broadcast(places), "id")
        flat, _ = packed.fetch(cut_ranges(known, width).mapInArrow(_PartialGram(n), packed.FIELDS))
        values, vectors = np.linalg.eigh(flat.view(np.complex128).reshape(n, n))
        w = project(known, vectors[:, np.argsort(-values)[:k]])
    return fix_phase(w / np.linalg.norm(w, axis=0))


def restarts(x: DataFrame, solve: Callable[[int], Fit], runs: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Fits from several starts: (run, loadings, explained share), best total first."""
    out = []
    for run in range(runs):
        fit = solve(run)
        out.append((run, fit.w, explained(x, fit.w)))
    return sorted(out, key=lambda r: (-r[2].sum(), r[0]))


def explained(x: DataFrame, w: np.ndarray) -> np.ndarray:
    """Share of the total variance of centred variables that each component explains; one pass over the rows."""
    p = len(w)
    var = moments(x, w)[1]
    return var[p:] / var[:p].sum() if len(var) else np.zeros(w.shape[1])


class _Weighted:
    """``X^H D X W`` for several draws at once: columns of W in as many blocks as draws, D a row's squared factor in a draw;
    below it, one row with each draw's sum of squared moduli.
    """

    def __init__(self, w, squares: dict, draws: int):
        self.w, self.squares, self.draws = w, squares, draws

    def __call__(self, batches):
        w, total, n = self.w.value, None, 0
        ones = np.ones(self.draws)
        for batch in batches:
            if batch.num_rows:
                x = rows(batch)
                by = np.array([self.squares.get(s, ones) for s in batch.column(0).to_pylist()])
                part = x.conj().T @ ((x @ w) * np.repeat(by, w.shape[1] // self.draws, 1))
                power = np.zeros((1, w.shape[1]), np.complex128)
                power[0, : self.draws] = (x.real**2 + x.imag**2).sum(1) @ by
                part = np.vstack([part, power])
                total = part if total is None else total + part
                n += len(x)
        if total is not None:
            yield from packed.give(total, n)


def magnitude_factors(draws: int = 10, sizes: Sequence[int] = (1, 2, 3), factors: Sequence[float] = (2, 5, 10), seed: int = 0) -> list[list[float]]:
    """The factors of each draw, all different."""
    rng = np.random.default_rng(seed)
    return [[float(f) for f in rng.choice(factors, min(int(rng.choice(sizes)), len(factors)), replace=False)] for _ in range(draws)]


def magnitude_draws(sessions: Sequence, draws: int = 10, sizes: Sequence[int] = (1, 2, 3), factors: Sequence[float] = (2, 5, 10), seed: int = 0) -> list[dict]:
    """Sessions to be scaled and their factors, for each draw: so many sessions, the first in the order of a hash (fewer if
    there are fewer), each with another factor.
    """
    out = []
    for i, chosen in enumerate(magnitude_factors(draws, sizes, factors, seed)):
        order = sorted(sessions, key=lambda s: (hashlib.md5(f"{seed}:{i}:{s}".encode()).hexdigest(), str(s)))
        out.append(dict(zip(order, chosen)))
    return out


def magnitude_experiment(x: DataFrame, k: int, draws: Sequence[dict], over: int = 10, passes: int = 2, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each draw, the directions of the matrix whose sessions are scaled by the draw's factors, and their shares of its
    sum of squared moduli.

    A factor multiplies a session's part of ``X^H X W`` by its square, so all draws share each pass, however many there are.
    """
    p, d = _variables(x), len(draws)
    squares: dict = {}
    for i, draw in enumerate(draws):
        for s, f in draw.items():
            squares.setdefault(s, np.ones(d))[i] = f * f
    width = min(p, k + over)

    def products(qs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        sent = x.sparkSession.sparkContext.broadcast(np.hstack(qs))
        flat, _ = packed.fetch(x.select("session_id", "re", "im").mapInArrow(_Weighted(sent, squares, d), packed.FIELDS))
        whole = flat.view(np.complex128).reshape(p + 1, -1)
        return [whole[:p, i * width : (i + 1) * width] for i in range(d)], whole[p, :d].real

    qs = [start(p, width, seed)] * d
    for _ in range(passes + 1):
        qs = [np.linalg.qr(g)[0] for g in products(qs)[0]]
    out = []
    for q, g, power in zip(qs, *products(qs)):
        small = q.conj().T @ g
        values, vectors = np.linalg.eigh((small + small.conj().T) / 2)
        top = np.argsort(-values)[:k]
        out.append((fix_phase(q @ vectors[:, top]), values[top] / power))
    return out


def scale_sessions(x: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Rows of the given sessions multiplied by a factor: for experiments on what magnitudes do to a fit."""
    f = F.lit(1.0)
    for s, v in factors.items():
        f = F.when(F.col("session_id") == s, F.lit(float(v))).otherwise(f)
    return x.withColumn("_f", f).withColumn("re", F.transform("re", lambda v: v * F.col("_f"))).withColumn("im", F.transform("im", lambda v: v * F.col("_f"))).drop("_f")
