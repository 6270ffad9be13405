"""Near-duplicates of texts and vectors against all pairs compared one by one, and components."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemesh.llm import covertree, minmax, shingles
from phasemesh.operators.graph import components

UPPER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(n, links):
    root = list(range(n))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(v) for v in range(n)]


def brute_force(ids, texts, percent):
    sets = [shingle_set(t) if i is not None else set() for i, t in zip(ids, texts)]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    part = roots(len(ids), links)
    least = {}
    for k, p in enumerate(part):
        if ids[k] is not None:
            least[p] = min(least.get(p, ids[k]), ids[k])
    out = []
    for k, i in enumerate(ids):
        c = least.get(part[k]) if i is not None else None
        out.append((i, len(shingle_set(texts[k])), c, i is None or i == c))
    return sorted(out, key=str)


def corpus(seed=0, groups=6, size=40):
    """Groups of copies with more and more words changed, so that some links chain and some fall short."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(80 + 10 * g)]
        for k in range(size):
            copy = list(base)
            for _ in range(k % 5):
                copy[int(rng.integers(len(copy)))] = word()
            texts.append(" ".join(copy))
        texts += [texts[-1], texts[-1].upper(), texts[-1].replace(" ", "\n\t")]
    return texts


ODD = [None, "", " \t\n", "one", "ONE", "one two three four", "one two three four five", "a a a a a a a a", "nbsp\u00a0is a word char here", "x " * 3000]


def test_groups_equal_brute_force(spark, docs):
    texts = corpus() + ODD + ODD
    ids = [1000 - 2 * k for k in range(len(texts))]
    ids[-3], ids[-4] = None, ids[0]
    for percent, bands, rows in ((85, 32, 8), (80, 40, 6)):
        got = minmax.groups(docs(*texts, ids=ids), percent, bands, rows)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_force(ids, texts, percent)
    assert minmax.groups(docs("a").limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 3000, 1 << 25])
def test_large_buckets_are_compared_in_blocks(spark, docs, monkeypatch, size):
    monkeypatch.setattr(minmax, "BLOCK", 8)
    monkeypatch.setattr(minmax, "BLOCK_BYTES", size)
    texts = corpus(1, 2, 60)
    got = minmax.groups(docs(*texts), 85).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(list(range(len(texts))), texts, 85)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = shingles.mix(rng.integers(1, 2**63, 800).astype(np.uint64))
    b = np.concatenate([a[:600], shingles.mix(rng.integers(1, 2**63, 200).astype(np.uint64))])
    h = shingles.MinMax(64, 8)
    x, y = h.signature(a), h.signature(b)
    half = len(x) // 2
    assert abs((x == y).mean() - 0.6) < 0.08
    assert (x[:half] <= x[half:]).all()
    with pytest.raises(ValueError):
        shingles.MinMax(3, 4)


def test_no_similar_pair_is_ruled_out_by_signatures():
    rng = np.random.default_rng(6)
    lowest = {}
    for percent, bands, rows in ((85, 32, 8), (80, 40, 6)):
        h = shingles.MinMax(bands, rows)
        for n in (7, 40, 1000):
            for _ in range(300):
                a = shingles.mix(rng.integers(1, 2**63, n).astype(np.uint64))
                cut = next(k for k in range(n, 0, -1) if 100 * k < percent * (2 * n - k)) + 1  # the fewest shared
                b = np.concatenate([a[:cut], shingles.mix(rng.integers(1, 2**63, n - cut).astype(np.uint64))])
                x, y = (np.frombuffer(h.keys(s)[1], np.uint8) for s in (a, b))
                lowest[percent] = min(lowest.get(percent, 999), (x == y).sum() - minmax.least_agreement(len(x), percent))
    assert all(v > 0 for v in lowest.values()), lowest


def test_pairs_meet_once_and_in_either_order():
    rng = np.random.default_rng(7)
    bands = rng.integers(0, 3, (40, 4))
    low = np.tile(rng.integers(0, 256, 32).astype(np.uint8), (40, 1))
    side = {"rep": np.arange(40), "comp": np.arange(40) // 2, "n": np.full(40, 10), "apart": np.ones(40, np.int64), "bands": bands, "low": low}
    seen = []
    for band in range(4):
        for key in range(3):
            here = bands[:, band] == key
            part = {k: v[here] for k, v in side.items()}
            i, j = minmax._Suspects(85, 1 << 20).pairs(part, part, band)
            seen += list(zip(part["rep"][i].tolist(), part["rep"][j].tolist()))
    want = [(a, b) for a in range(40) for b in range(a) if a // 2 != b // 2 and (bands[a] == bands[b]).any()]
    assert sorted(seen) == sorted((b, a) for a, b in want)


def test_overlaps():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in sizes] for sizes in ((5, 30, 0), (10, 0, 50, 3)))
    got = minmax.overlaps(left, right)
    assert got.tolist() == [[len(set(a) & set(b)) for b in right] for a in left]
    assert minmax.overlaps(left, []).shape == (3, 0)


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(400 + k, 401 + k) for k in range(60)] + [(7, 7)]
    df = spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long")
    part = roots(500, links)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {v: p for v, p in enumerate(part) if p != v}
    assert components(df.limit(0)).count() == 0


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, None):
        centres = rng.standard_normal((12, 8))
        for k in range(120):
            c = centres[k % 12] + rng.standard_normal(8) * (0.02 if k % 3 else 0.3)
            rows.append((c * rng.uniform(0.1, 9)).astype(np.float32).tolist() + [label])
    out = [(len(rows) - k, r[:-1], r[-1]) for k, r in enumerate(rows)]
    out += [(900, out[0][1], 0), (900, out[0][1], 0), (901, [0.0] * 8, 0), (902, None, 0), (903, [1.0, None] + [0.0] * 6, 0), (904, [float("nan")] * 8, 0), (905, [float("inf")] + [0.0] * 7, 0)]
    out += [(906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [], 0), (None, out[1][1], 0), (909, out[130][1], 1)]
    return out


def test_vectors_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, VEC_ID2 int").withColumnRenamed("VEC_ID2", "LABEL2")

    def good(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(p, q):
        if p[2] is None or p[2] != q[2] or not good(p[1]) or not good(q[1]) or len(p[1]) != len(q[1]):
            return False
        a, b = np.float32(p[1]).astype(float), np.float32(q[1]).astype(float)
        return a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93

    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(rows[i], rows[j])]
    part, n = roots(len(rows), links), [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    least = {}
    for k, p in enumerate(part):
        if rows[k][0] is not None:
            least[p] = min(least.get(p, rows[k][0]), rows[k][0])
    want = sorted(((r[0], n[k], least.get(part[k]), r[0] is not None and r[0] == least.get(part[k])) for k, r in enumerate(rows)), key=str)
    for sizes in ((1024, 8, 1024), (16, 8, 4), (16, 2, 1024), (4, 2, 3)):  # one bundle, then pivots
        got = sorted(map(tuple, covertree.near_duplicates(df, 0.93, *sizes).collect()), key=str)
        assert got == want
    assert covertree.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        covertree.near_duplicates(df, -0.5)


@pytest.mark.parametrize("scale", [5e-324, 1e-310, 1e-300, 1e-170, 1e-150, 1.0, 1e150, 1e170, 1e300])
def test_vectors_of_any_magnitude(spark, scale):
    """Cosines at the threshold, of doubles so small or large that their products vanish or overflow."""
    turn = np.array([np.cos(a := np.arccos(0.93) * (1 - 1e-9)), np.sin(a), 0.0])
    over = np.array([np.cos(a := np.arccos(0.93) * (1 + 1e-9)), 0.0, np.sin(a)])
    rows = [[1.0, 0.0, 0.0], turn.tolist(), over.tolist(), [-1.0, 0.0, 0.0], (-turn).tolist()]
    if scale > 1e-300:
        rows = [[c * scale for c in r] for r in rows]
    else:  # few digits are left: whole multiples of the smallest number
        rows = [[scale, 0.0, 0.0], [scale * 3, 0.0, 0.0], [0.0, scale, 0.0], [-scale, 0.0, 0.0], [0.0, 0.0, scale]]
    rows.append([1.0, 0.0, 0.0])
    got = [tuple(r) for r in covertree.near_duplicates(spark.createDataFrame([(k, r, 0) for k, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()]
    want = [(0, 2, 0, True), (1, 2, 0, False), (2, 0, 2, True), (3, 0 if scale <= 1e-300 else 1, 3, True), (4, 0, 4, True) if scale <= 1e-300 else (4, 1, 3, False), (5, 2, 0, False)]
    assert got == want


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    raw = np.repeat(rng.standard_normal((20, 3)), 25, 0) + rng.standard_normal((500, 3)) * 0.003
    tree = covertree.Tree(np.arange(500), raw)
    for k in range(len(tree.radius)):
        lo, hi = tree.at[k]
        far = np.sqrt(((tree.points[lo:hi] - tree.points[tree.centre[k]]) ** 2).sum(1)).max()
        assert far <= tree.radius[k] + 1e-12
        kids = tree.parts(k)
        if not tree.leaf[k]:
            assert sum(tree.at[c][1] - tree.at[c][0] for c in kids) == hi - lo
            level = 2.0 ** np.floor(np.log2(tree.radius[k]))
            assert (tree.radius[kids] <= level + 1e-12).all()
    walk = covertree.Walk(tree, None, 0.9999).run()
    assert walk.pairs < 500 * 499 / 2
