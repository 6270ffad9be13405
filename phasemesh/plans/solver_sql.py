"""DuckDB SQL of the solvers on the matrix of embeddings.

A solver's steps are linear in its basis, and bringing the basis to scale multiplies it from the right, which changes
neither its span nor that of later steps.  So the SQL leaves the scaling out, makes the same mini-batches, and takes the
principal directions within the last span, each by squaring until one direction is left.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..operators import linalg
from .inputs import CELLS, VARIABLES

#: Squarings of a Hermitian matrix that leave its first direction.
SQUARINGS = 13
#: ``X^H X`` of all rows, with the number of rows.
GRAM = """g AS MATERIALIZED (
  SELECT a.v i, b.v j, sum(a.re * b.re + a.im * b.im) re, sum(a.re * b.im - a.im * b.re) im FROM c a JOIN c b ON a.t = b.t GROUP BY a.v, b.v)
, rows_of AS MATERIALIZED (SELECT count(DISTINCT t) n FROM c)"""


def with_tables(*tables: str) -> str:
    return "WITH " + "\n, ".join([CELLS, *tables])


def _of(by: str, table: str = "") -> str:
    """The key of many matrices in one table, as a column before others; nothing for a single matrix."""
    return (f"{table}." if table else "") + f"{by}, " if by else ""


def _same(by: str, a: str, b: str) -> str:
    return f" AND {a}.{by} = {b}.{by}" if by else ""


def product(a: str, b: str, by: str = "") -> str:
    """Cells of the product of two matrices ``i, j, re, im``, or for each key of the products of many."""
    return f"""SELECT {_of(by, "a")}a.i, b.j, sum(a.re * b.re - a.im * b.im) re, sum(a.re * b.im + a.im * b.re) im
  FROM {a} a JOIN {b} b ON a.j = b.i{_same(by, "a", "b")} GROUP BY {_of(by, "a")}a.i, b.j"""


def principal(name: str, whole: str, k: int, by: str = "") -> list[str]:
    """The first ``k`` directions of a Hermitian matrix ``whole``, as ``{name}(i, j, re, im, l)`` with components j: squared
    until one direction is left, which is then taken out of it, and so on.
    """
    out, left, key = [], whole, _of(by)
    trace = f"sum(CASE WHEN i = j THEN re ELSE 0 END) OVER ({f'PARTITION BY {by}' if by else ''})"
    for pc in range(k):
        s = f"{name}_{pc}_"
        out.append(f"{s}s0 AS MATERIALIZED (SELECT {key}i, j, re / {trace} re, im / {trace} im FROM {left})")
        for n in range(SQUARINGS):
            out.append(f"{s}t{n} AS MATERIALIZED ({product(f'{s}s{n}', f'{s}s{n}', by)})")
            out.append(f"{s}s{n + 1} AS MATERIALIZED (SELECT {key}i, j, re / {trace} re, im / {trace} im FROM {s}t{n})")
        last, once = f"{s}s{SQUARINGS}", f"JOIN {s}l ON {s}l.{by} = g.{by}" if by else f"CROSS JOIN {s}l"
        out.append(f"{s}l AS MATERIALIZED (SELECT {_of(by, 'g')}sum(g.re * p.re - g.im * p.im) l FROM {left} g JOIN {last} p ON g.j = p.i AND g.i = p.j{_same(by, 'g', 'p')}{f' GROUP BY g.{by}' if by else ''})")
        out.append(f"{s}g AS MATERIALIZED (SELECT {_of(by, 'g')}g.i, g.j, g.re - l * p.re re, g.im - l * p.im im FROM {left} g JOIN {last} p ON g.i = p.i AND g.j = p.j{_same(by, 'g', 'p')} {once})")
        left = f"{s}g"
    parts = " UNION ALL ".join(f"SELECT {key}{pc} pc, i, j, re, im, l FROM {name}_{pc}_s{SQUARINGS} " + (f"JOIN {name}_{pc}_l USING ({by})" if by else f"CROSS JOIN {name}_{pc}_l") for pc in range(k))
    out.append(f"{name}_p AS ({parts})")
    out.append(f"{name}_m AS (SELECT {key}pc, i m, re q FROM {name}_p WHERE i = j QUALIFY row_number() OVER (PARTITION BY {key}pc ORDER BY re DESC) = 1)")
    out.append(
        f"{name} AS MATERIALIZED (SELECT {_of(by, 'p')}p.i, CAST(p.pc AS INTEGER) j, p.re / sqrt(q) re, p.im / sqrt(q) im, l FROM {name}_p p JOIN {name}_m m ON m.pc = p.pc AND p.j = m.m{_same(by, 'p', 'm')})"
    )
    return out


def projector(name: str, w: str, k: int, by: str = "") -> list[str]:
    """The projection ``{name}`` on the span of the ``k`` columns of ``w``, made orthogonal one after the other."""
    out, before = [], None
    for c in range(k):
        q = f"{name}_q{c}"
        if before is None:
            rest = f"SELECT {_of(by)}i, re, im FROM {w} WHERE j = 0"
        else:
            rest = f"""SELECT {_of(by, "u")}u.i, any_value(u.re) - sum(p.re * d.re - p.im * d.im) re, any_value(u.im) - sum(p.re * d.im + p.im * d.re) im
  FROM {w} u JOIN {before} p ON p.i = u.i{_same(by, "p", "u")}
  JOIN (SELECT {_of(by, "p")}p.j, sum(p.re * u.re + p.im * u.im) re, sum(p.re * u.im - p.im * u.re) im
    FROM {before} p JOIN {w} u ON u.i = p.i AND u.j = {c}{_same(by, "p", "u")} GROUP BY {_of(by, "p")}p.j) d ON d.j = p.j{_same(by, "d", "p")}
  WHERE u.j = {c} GROUP BY {_of(by, "u")}u.i"""
        out.append(f"{q}u AS MATERIALIZED ({rest})")
        known = f"SELECT * FROM {before} UNION ALL " if before else ""
        length = f"sqrt(sum(re * re + im * im) OVER ({f'PARTITION BY {by}' if by else ''}))"
        out.append(f"{q} AS MATERIALIZED ({known}SELECT {_of(by)}i, {c} j, re / {length} re, im / {length} im FROM {q}u)")
        before = q
    out.append(f"""{name} AS MATERIALIZED (
  SELECT {_of(by, "a")}a.i, b.i j, sum(a.re * b.re + a.im * b.im) re, sum(a.im * b.re - a.re * b.im) im
  FROM {before} a JOIN {before} b ON a.j = b.j{_same(by, "a", "b")} GROUP BY {_of(by, "a")}a.i, b.i)""")
    return out


def ritz(name: str, w: str, width: int, k: int, whole: str = "g", by: str = "") -> list[str]:
    """The first ``k`` principal directions of the whole matrix within the span of ``w``."""
    n = f"{name}_in"
    inner = [f"{n}g AS MATERIALIZED ({product(whole, n, by)})", f"{n}h AS MATERIALIZED ({product(n, f'{n}g', by)})"]
    return [*projector(n, w, width, by), *inner, *principal(name, f"{n}h", k, by)]


def explained(name: str, w: str) -> str:
    """``{name}(pc, r2)``: shares of the variance of all variables."""
    return f"""{name} AS MATERIALIZED (
  SELECT j pc, (var_samp(re) + var_samp(im)) / (SELECT sum(q) FROM (SELECT var_samp(re) + var_samp(im) q FROM c GROUP BY v)) r2
  FROM (SELECT c.t, w.j, sum(c.re * w.re - c.im * w.im) re, sum(c.re * w.im + c.im * w.re) im FROM c JOIN {w} w ON c.v = w.i GROUP BY c.t, w.j) GROUP BY j)"""


def directions(w: str, *more: str) -> str:
    """The rows of the queries of directions."""
    columns = ", ".join(["w.j pc", "w.i vertex", "round(re, 6) + 0.0 re", "round(im, 6) + 0.0 im", "round(r2, 8) + 0.0 r2", *more])
    return f"\nSELECT {columns} FROM {w} w JOIN r2s ON r2s.pc = w.j"


def given(name: str, w: np.ndarray) -> str:
    """A starting basis, as a table of its numbers."""
    cells = ", ".join(f"({i}, {j}, {float(v.real)!r}, {float(v.imag)!r})" for (i, j), v in np.ndenumerate(w))
    return f"{name} AS MATERIALIZED (SELECT i, j, CAST(re AS DOUBLE) re, CAST(im AS DOUBLE) im FROM (VALUES {cells}) AS z(i, j, re, im))"


def sampled(name: str, size: int, k: int, seed: int = 0) -> list[str]:
    """The first directions of ``size`` rows, taken by hash."""
    return [
        f"{name}_t AS MATERIALIZED (SELECT vec_id t FROM embeddings ORDER BY md5(concat_ws(':', label, vec_id, {seed})), label, vec_id LIMIT {size})",
        f"""{name}_g AS MATERIALIZED (
  SELECT a.v i, b.v j, sum(a.re * b.re + a.im * b.im) re, sum(a.re * b.im - a.im * b.re) im
  FROM c a JOIN {name}_t USING (t) JOIN c b ON a.t = b.t GROUP BY a.v, b.v)""",
        *principal(name, f"{name}_g", k),
    ]


def blocks(count: int = 10, seed: int = 0) -> list[str]:
    """``X^H X`` of each block of rows, and its number of rows."""
    return [
        f"dealt{seed} AS MATERIALIZED (SELECT vec_id t, CAST(('0x' || substr(md5(concat_ws(':', label, vec_id, {seed})), 1, 8)) AS BIGINT) % {count} block FROM embeddings)",
        f"""gb{seed} AS MATERIALIZED (
  SELECT block, a.v i, b.v j, sum(a.re * b.re + a.im * b.im) re, sum(a.re * b.im - a.im * b.re) im
  FROM c a JOIN dealt{seed} USING (t) JOIN c b ON a.t = b.t GROUP BY block, a.v, b.v)""",
        f"nb{seed} AS MATERIALIZED (SELECT block, count(*) n FROM dealt{seed} GROUP BY block)",
    ]


def batch(name: str, chosen: Sequence[int], dealt: int = 0) -> str:
    """The mean product of a mini-batch."""
    among = f"block IN ({', '.join(map(str, chosen))})"
    rows = f"(SELECT sum(n) FROM nb{dealt} WHERE {among})"
    return f"{name} AS MATERIALIZED (SELECT i, j, sum(re) / {rows} re, sum(im) / {rows} im FROM gb{dealt} WHERE {among} GROUP BY i, j)"


def total(name: str, *terms: tuple[float, str]) -> str:
    """A sum of matrices with factors."""
    parts = " UNION ALL ".join(f"SELECT i, j, {f!r} * re re, {f!r} * im im FROM {t}" for f, t in terms)
    return f"{name} AS MATERIALIZED (SELECT i, j, CAST(sum(re) AS DOUBLE) re, CAST(sum(im) AS DOUBLE) im FROM ({parts}) GROUP BY i, j)"


def momentum_steps(name: str, start: str, iterations: int, beta: float, count: int = 10, take: int = 5, seed: int = 0) -> tuple[list[str], str]:
    """Power iteration on mini-batches with momentum, and the name of the last basis."""
    rng, out, now, old = np.random.default_rng(seed), [], start, None
    for i in range(iterations):
        s = f"{name}_{i}"
        out += [batch(f"{s}g", linalg.drawn(count, take, rng)), f"{s}x AS MATERIALIZED ({product(f'{s}g', now)})"]
        out.append(total(s, (1.0, f"{s}x"), *([(-beta, old)] if old else [])))
        now, old = s, now
    return out, now


def anchored_steps(name: str, start: str, k: int, epochs: int, iterations: int, beta: float, count: int = 10, take: int = 5, seed: int = 0, dealt: int = 0) -> tuple[list[str], str]:
    """The same with reduced variance: each epoch's span is projected on, and mini-batches see what lies outside it."""
    rng, out, now, old = np.random.default_rng(seed), [], start, None
    for e in range(epochs):
        anchor = f"{name}_{e}a"
        out += projector(anchor, now, k)
        for i in range(iterations):
            s = f"{name}_{e}_{i}"
            out.append(f"{s}p AS MATERIALIZED ({product(anchor, now)})")
            out.append(total(f"{s}d", (1.0, now), (-1.0, f"{s}p")))
            out += [batch(f"{s}g", linalg.drawn(count, take, rng), dealt), f"{s}x AS MATERIALIZED ({product(f'{s}g', f'{s}d')})"]
            out.append(f"{s}f AS MATERIALIZED (SELECT i, j, re / n re, im / n im FROM ({product('g', f'{s}p')}), rows_of)")
            out.append(total(s, (1.0, f"{s}x"), (1.0, f"{s}f"), *([(-beta, old)] if old else [])))
            now, old = s, now
    return out, now


def exact(k: int, singular: bool = False) -> str:
    more = ["round(sqrt(l), 7) singular"] if singular else []
    return with_tables(GRAM, *principal("w", "g", k), explained("r2s", "w")) + directions("w", *more)


def randomised(k: int, over: int = 10, passes: int = 2, seed: int = 0) -> str:
    width = min(VARIABLES, k + over)
    steps = [given("y0", linalg.start(VARIABLES, width, seed)), *[f"y{n + 1} AS MATERIALIZED ({product('g', f'y{n}')})" for n in range(passes + 1)]]
    return with_tables(GRAM, *steps, *ritz("w", f"y{passes + 1}", width, k), explained("r2s", "w")) + directions("w")


def pim(k: int, size: int, iterations: int, beta: float) -> str:
    steps, last = momentum_steps("y", "s", iterations, beta)
    return with_tables(GRAM, *sampled("s", size, k), *blocks(), *steps, *ritz("w", last, k, k), explained("r2s", "w")) + directions("w")


def pimvr(k: int, size: int, epochs: int, iterations: int, beta: float) -> str:
    steps, last = anchored_steps("y", "s", k, epochs, iterations, beta)
    return with_tables(GRAM, *sampled("s", size, k), *blocks(), *steps, *ritz("w", last, k, k), explained("r2s", "w")) + directions("w")


def restarts(k: int, size: int, epochs: int, iterations: int, beta: float, runs: int) -> str:
    """``run, pc, r2`` of several starts."""
    tables, parts = [GRAM, *blocks()], []
    for run in range(runs):
        steps, last = anchored_steps(f"y{run}", f"s{run}", k, epochs, iterations, beta, seed=run)
        tables += [*sampled(f"s{run}", size, k, run), *steps, *ritz(f"w{run}", last, k, k), explained(f"r{run}", f"w{run}")]
        parts.append(f"SELECT CAST({run} AS INTEGER) run, pc, round(r2, 8) + 0.0 r2 FROM r{run}")
    return with_tables(*tables) + "\n" + " UNION ALL ".join(parts)


def oja(k: int, rates: Sequence[float], count: int = 10, take: int = 1, seed: int = 0) -> str:
    """Oja's rule on mini-batches: each step adds the product, times the rate."""
    rng, steps, now = np.random.default_rng(seed), [given("y", linalg.start(VARIABLES, k))], "y"
    for i, rate in enumerate(rates):
        s = f"y{i}"
        steps += [batch(f"{s}g", linalg.drawn(count, take, rng)), f"{s}x AS MATERIALIZED ({product(f'{s}g', now)})", total(s, (1.0, now), (float(rate), f"{s}x"))]
        now = s
    return with_tables(GRAM, *blocks(), *steps, *ritz("w", now, k, k), explained("r2s", "w")) + directions("w")


def magnitudes(k: int, over: int = 10, passes: int = 2, seed: int = 0) -> str:
    """``draw, n_scaled, factor, pc, r2``: each draw scales the products of its sessions by the squares of their factors."""
    width, plan = min(VARIABLES, k + over), linalg.magnitude_factors(seed=seed)
    listed = ", ".join(f"({draw}, {r + 1}, {f!r})" for draw, factors in enumerate(plan) for r, f in enumerate(factors))
    tables = [
        """gs AS MATERIALIZED (
  SELECT CAST(a.ds AS VARCHAR) s, a.v i, b.v j, sum(a.re * b.re + a.im * b.im) re, sum(a.re * b.im - a.im * b.re) im FROM c a JOIN c b ON a.t = b.t GROUP BY a.ds, a.v, b.v)""",
        f"draws AS (SELECT CAST(unnest(generate_series(0, {len(plan) - 1})) AS INTEGER) draw)",
        f"""ordered AS (
  SELECT draw, s, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws(':', {seed}, draw, s)), s) r
  FROM (SELECT DISTINCT CAST(label AS VARCHAR) s FROM embeddings WHERE label IS NOT NULL), draws)""",
        f"scaled AS MATERIALIZED (SELECT draw, s, CAST(factor AS DOUBLE) factor FROM ordered JOIN (VALUES {listed}) AS f(draw, r, factor) USING (draw, r))",
        """m AS MATERIALIZED (
  SELECT draw, i, j, sum(re * coalesce(factor * factor, 1)) re, sum(im * coalesce(factor * factor, 1)) im
  FROM (SELECT * FROM gs, draws) LEFT JOIN scaled USING (draw, s) GROUP BY draw, i, j)""",
        given("y", linalg.start(VARIABLES, width, seed)),
        "y0 AS (SELECT draw, y.* FROM y, draws)",
        *[f"y{n + 1} AS MATERIALIZED ({product('m', f'y{n}', 'draw')})" for n in range(passes + 1)],
        *ritz("w", f"y{passes + 1}", width, k, "m", "draw"),
        "power AS (SELECT draw, sum(re) power FROM m WHERE i = j GROUP BY draw)",
        "chosen AS (SELECT draw, CAST(count(*) AS INTEGER) n_scaled, max(factor) factor FROM scaled GROUP BY draw)",
    ]
    return with_tables(*tables) + """
SELECT draw, n_scaled, factor, j pc, round(l / power, 8) + 0.0 r2 FROM (SELECT DISTINCT draw, j, l FROM w) JOIN power USING (draw) JOIN chosen USING (draw)"""


def simulation(k: int, size: int, iterations: int, beta: float, runs: int) -> str:
    """Counts and shares of runs whose components agree with the exact ones, by component."""
    begun, made, ended = [], [], []
    for run in range(runs):
        begun.append(f"""SELECT {run} run, v.t FROM (SELECT vec_id t FROM embeddings ORDER BY md5(concat_ws(':', label, vec_id, {run})), label, vec_id LIMIT {size}) v""")
        steps, last = anchored_steps(f"y{run}", f"s{run}", k, 1, iterations, beta, seed=run, dealt=run)
        made += [f"s{run} AS (SELECT i, j, re, im FROM s WHERE run = {run})", *blocks(seed=run), *steps]
        ended.append(f"SELECT {run} run, i, j, re, im FROM {last}")
    mean = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY run, j) {c}" for c in ("ar", "ai", "br", "bi"))
    tables = [
        GRAM,
        *principal("e", "g", k),
        f"st AS MATERIALIZED ({' UNION ALL '.join(begun)})",
        """sg AS MATERIALIZED (
  SELECT run, a.v i, b.v j, sum(a.re * b.re + a.im * b.im) re, sum(a.re * b.im - a.im * b.re) im FROM st JOIN c a USING (t) JOIN c b USING (t) GROUP BY run, a.v, b.v)""",
        *principal("s", "sg", k, "run"),
        *made,
        f"y AS MATERIALIZED ({' UNION ALL '.join(ended)})",
        f"gr AS MATERIALIZED (SELECT run, g.* FROM g, (SELECT unnest(generate_series(0, {runs - 1})) run))",
        *ritz("w", "y", k, k, "gr", "run"),
        "pairs AS (SELECT run, w.j, e.re ar, e.im ai, w.re br, w.im bi FROM w JOIN e ON e.i = w.i AND e.j = w.j)",
        f"away AS (SELECT run, j, {mean} FROM pairs)",
        """mcc AS (
  SELECT run, j pc, sqrt(power(sum(ar * br + ai * bi), 2) + power(sum(ar * bi - ai * br), 2)) / sqrt(sum(ar * ar + ai * ai) * sum(br * br + bi * bi)) m
  FROM away GROUP BY run, j)""",
    ]
    columns = ", ".join(f"count(*) FILTER (m > {x}) n_{n}, avg(CAST(CASE WHEN m > {x} THEN 1 ELSE 0 END AS DOUBLE)) share_{n}" for x, n in ((0.95, "95"), (0.975, "975")))
    return with_tables(*tables) + f"\nSELECT pc, {columns} FROM mcc GROUP BY pc"
