"""Matrices stored as tiles: windows, replaced cells, and solvers that read their own blocks."""

import numpy as np
import pytest

from phasemesh.operators import linalg
from phasemesh.sources import synthetic, tiles


def stored(spark, path, n=37, p=11, rows=8, columns=4):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((n, p)) + 1j * rng.standard_normal((n, p))
    x = spark.createDataFrame([(f"s{i // 10}", i % 10, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(m)], "session_id string, t int, re array<double>, im array<double>").repartition(3)
    return m, tiles.write(x, path, rows=rows, columns=columns)


def values(df):
    rows = df.orderBy("row").collect()
    return [r.row for r in rows], np.array([np.array(r.re) + 1j * np.array(r.im) for r in rows])


def test_windows(spark, tmp_path):
    m, t = stored(spark, str(tmp_path / "m"))
    assert (t.n, t.p, t.row_blocks, t.column_blocks) == (37, 11, 5, 3)
    for rows, columns in (((0, 37), (0, 11)), ((3, 20), (2, 9)), ((8, 16), (4, 8)), ((36, 99), (10, 11)), ((5, 6), (0, 4)), ((-3, 2), (-1, 5))):
        at, got = values(t.window(rows, columns))
        r, c = slice(max(rows[0], 0), rows[1]), slice(max(columns[0], 0), columns[1])
        assert at == list(range(37))[r] and np.array_equal(got, m[r, c])
    assert t.window((5, 5), (0, 3)).count() == 0 == t.window((40, 50), (0, 3)).count()
    assert (t.window((12, 13), (0, 11)).first().session_id, t.window((12, 13), (0, 3)).first().t) == ("s1", 2)
    again = tiles.open_tiles(spark, t.path)
    assert np.array_equal(values(again.matrix())[1], m)


def test_a_window_opens_its_tiles_only(spark, tmp_path):
    _, t = stored(spark, str(tmp_path / "m"))
    plan = t.window((8, 16), (4, 8))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Exchange" not in plan
    # all but the folders of one tile are gone, and the window is still there
    for folder in tmp_path.glob("m/tiles/row_block=*/column_block=*"):
        if folder.parts[-2:] != ("row_block=1", "column_block=1"):
            for f in folder.iterdir():
                f.write_bytes(b"not a table")
    assert values(t.window((9, 12), (5, 7)))[0] == [9, 10, 11]


def test_replaced_cells(spark, tmp_path):
    m, t = stored(spark, str(tmp_path / "m"))
    kind = "row long, re array<double>, im array<double>"
    for r0, c0, h, w in ((8, 4, 8, 4), (3, 2, 14, 7), (36, 10, 1, 1), (0, 0, 37, 11)):
        new = np.random.default_rng(h).standard_normal((h, w)) - 1j
        rows = [(i, r.real.tolist(), r.imag.tolist()) for i, r in enumerate(new)]
        if h > 10:
            rows, new = rows[::2], new[::2]  # some rows of the range
        for i, r in zip((x[0] for x in rows), new):
            m[r0 + i, c0 : c0 + w] = r
        before = {f: f.stat().st_mtime_ns for f in tmp_path.glob("m/tiles/**/*.parquet")}
        for _ in range(2):
            t.replace(r0, c0, spark.createDataFrame(rows, kind))
            assert np.array_equal(values(t.matrix())[1], m)
        if (h, w) == (8, 4):
            assert sum(f.exists() and f.stat().st_mtime_ns == at for f, at in before.items()) == len(before) - 1
    for bad in ([(0, [1.0], [1.0]), (0, [1.0], [1.0])], [(40, [1.0], [1.0])], [(0, [1.0] * 12, [1.0] * 12)], [(0, [1.0], [1.0, 2.0])]):
        with pytest.raises(ValueError):
            t.replace(0, 0, spark.createDataFrame(bad, kind))
    t.replace(0, 0, spark.createDataFrame([], kind))
    assert np.array_equal(values(t.matrix())[1], m)


def test_written_again_and_bad_rows(spark, tmp_path):
    stored(spark, str(tmp_path / "m"))
    m, t = stored(spark, str(tmp_path / "m"), n=5, p=3)
    assert np.array_equal(values(t.matrix())[1], m)
    kind = "session_id string, t int, re array<double>, im array<double>"
    for bad in ([("s", 0, [1.0], [1.0, 2.0])], [("s", 0, [1.0], [1.0]), ("s", 1, [1.0, 2.0], [1.0, 2.0])], [("s", 0, None, [1.0])]):
        with pytest.raises(ValueError):
            tiles.write(spark.createDataFrame(bad, kind), str(tmp_path / "bad"))
    none = tiles.write(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert (none.n, none.p) == (0, 0) and none.matrix().count() == 0


def test_solvers_read_their_blocks(spark, tmp_path):
    x, q = synthetic.planted(spark, 1500, 12, [6.0, 4.0, 3.0])
    t = tiles.write(x, str(tmp_path / "m"), rows=150, columns=12)
    assert t.row_blocks == 10
    blocks = linalg.Blocks(t, 99, 0)
    batch = blocks.batch(3, np.random.default_rng(1))
    chosen = np.random.default_rng(1).choice(10, size=3, replace=False).tolist()
    scan = batch._jdf.queryExecution().executedPlan().toString()
    assert "row_block" in scan and "Exchange" not in scan and batch.count() == 450
    for folder in tmp_path.glob("m/tiles/row_block=*"):
        if int(folder.name.split("=")[1]) not in chosen:
            folder.rename(tmp_path / folder.name)
    assert batch.count() == 450
    for folder in tmp_path.glob("row_block=*"):
        folder.rename(tmp_path / "m/tiles" / folder.name)
    start = linalg.start(12, 3)
    for fit in (linalg.pim(t, start, 8, 1e-3), linalg.pimvr(t, start, 3, 4, 1e-3), linalg.oja(t, start, 8, linalg.log_linear(0.5, 0.05, 8), take=5)):
        assert np.all(np.abs((fit.w.conj() * q).sum(0)) > 0.9)
    starts = [linalg.start(12, 3, j) for j in range(2)]
    for run, fit, _ in linalg.pimvr_restarts(t, starts, 1, 3, take=3):  # stored blocks are the same for all runs
        assert np.allclose(fit.w, linalg.pimvr(t, starts[run], 1, 3, take=3, seed=run).w, atol=1e-9)
