"""All pairs of vectors above a cosine threshold, by dual traversal of cover trees.

Vectors of one label and dimension are dealt into blocks of bounded size, and each block becomes a cover tree: nested
levels whose radii are halving powers of two, every node with the exact radius that covers what is below it.  Two trees
(or a tree and itself) are walked together: a pair of nodes is dropped when even their nearest points must be too far
apart, taken whole when even their farthest points must be near enough, and split otherwise.  So links inside dense
groups are counted without being listed, and each task returns counts and a spanning forest.

A label of many blocks gets a level above the trees: each vector goes to the nearest of at most PIVOTS pivots, the
vectors of a pivot lie in blocks next to each other, and pivots whose balls are too far apart are pruned before anything
of their vectors moves.  Blocks meet in bundles, so a tree is sent once for each bundle that it has to meet.

Metric bounds cannot tell apart unrelated vectors of many dimensions: their distances all lie near the mean.  For such
data the walk ends at the first level, and what is left is one product of centres for each pair of blocks of a label.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, local_roots
from ..scratch import Scratch, delete_result
from . import store

#: Vectors of a block, blocks of a bundle, pivots of a label (about so many), and vectors that meet them at a time.
BLOCK, BUNDLE, PIVOTS, CHUNK = 1024, 8, 1024, 8192
#: Dimensions over which blocks hold fewer vectors, so that their bytes stay bounded.
WIDE = 128
#: Bounds on distances taken from rounded products are used with this margin; pairs within it are decided exactly.
SLACK = 1e-7


class Tree:
    """A cover tree over the rows of ``raw``; every node's points are a range of ``points``.

    ``at[k]``: range of node k in ``points``, its centre the first; ``radius[k]``: covers the range; ``below[k]``: range
    of its child nodes (none: all its points are equal).
    """

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        raw = _shifted(raw)
        unit = _unit(raw)
        order, self.at, self.radius, self.below = [], [], [], []
        # breadth first over lists of points; a node's order of points is fixed once it is split
        nodes = [np.arange(len(ids))]
        k = 0
        while k < len(nodes):
            pts = nodes[k]
            far = np.sqrt(((unit[pts] - unit[pts[0]]) ** 2).sum(1))
            radius = float(far.max())
            self.radius.append(radius)
            first = len(nodes)
            if radius > 0:
                level = 2.0 ** (math.ceil(math.log2(radius)) - 1)
                if level >= radius:
                    level /= 2
                near = far <= level
                nodes.append(pts[near])
                pts = pts[~near]
                while len(pts):
                    near = np.sqrt(((unit[pts] - unit[pts[0]]) ** 2).sum(1)) <= level
                    nodes.append(pts[near])
                    pts = pts[~near]
            self.below.append((first, len(nodes)))
            k += 1
        # ranges: depth first, so that children are parts of their parent's range
        self.at = [(0, 0)] * len(nodes)

        stack = [(0, False)]
        while stack:
            node, done = stack.pop()
            lo, hi = self.below[node]
            if done:
                self.at[node] = (self.at[node][0], len(order))
            elif lo == hi:
                start = len(order)
                order += nodes[node].tolist()
                self.at[node] = (start, len(order))
            else:
                self.at[node] = (len(order), 0)
                stack.append((node, True))
                stack += [(c, False) for c in reversed(range(lo, hi))]
        self.ids, self.raw, self.points = ids[order], raw[order], unit[order]
        self.at, self.radius, self.below = np.array(self.at), np.array(self.radius), np.array(self.below)
        self.centre = self.at[:, 0]
        self.leaf = self.below[:, 0] == self.below[:, 1]

    def parts(self, node: int) -> np.ndarray:
        lo, hi = self.below[node]
        return np.arange(lo, hi) if lo < hi else np.array([node])


class Walk:
    """Walks two trees, or one with itself, and gathers link counts and a spanning forest."""

    def __init__(self, a: Tree, b: Tree | None, cosine: float):
        self.a, self.b, self.same, self.cosine = a, b if b is not None else a, b is None, cosine
        self.theta = math.sqrt(2 - 2 * cosine)
        self.n_a = np.zeros(len(a.ids), np.int64)
        self.n_b = self.n_a if self.same else np.zeros(len(self.b.ids), np.int64)
        self.shift = 0 if self.same else len(a.ids)
        self.root = list(range(len(a.ids) + (0 if self.same else len(self.b.ids))))
        self.pairs = 0

    def find(self, v: int) -> int:
        root = self.root
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.root[y] = x

    def whole(self, p: int, q: int) -> None:
        """All points of node p (left) link with all of node q (right)."""
        (a0, a1), (b0, b1) = self.a.at[p], self.b.at[q]
        if self.same and p == q:
            self.n_a[a0:a1] += a1 - a0 - 1
            for i in range(a0 + 1, a1):
                self.join(int(a0), i)
            return
        self.n_a[a0:a1] += b1 - b0
        self.n_b[b0:b1] += a1 - a0
        for i in range(a0, a1):
            self.join(int(self.shift + b0), i)
        for j in range(b0 + 1, b1):
            self.join(int(self.shift + b0), int(self.shift + j))

    def linked(self, p: int, q: int) -> bool:
        x, y = self.a.raw[self.a.centre[p]], self.b.raw[self.b.centre[q]]
        return math.fsum(x * y) / (math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))) >= self.cosine

    def run(self) -> Walk:
        a, b, theta = self.a, self.b, self.theta
        stack = [(0, 0)]
        if not self.same and np.sqrt(((a.points[a.centre[0]] - b.points[b.centre[0]]) ** 2).sum()) > a.radius[0] + b.radius[0] + theta + SLACK:
            return self
        while stack:
            p, q = stack.pop()
            left, right = a.parts(p), b.parts(q)
            cos = a.points[a.centre[left]] @ b.points[b.centre[right]].T
            self.pairs += cos.size
            d = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
            reach = a.radius[left][:, None] + b.radius[right][None, :]
            maybe = d <= reach + theta + SLACK
            if self.same and p == q:
                maybe &= np.arange(len(left))[:, None] <= np.arange(len(right))[None, :]
            for i, j in zip(*np.nonzero(maybe)):
                x, y = int(left[i]), int(right[j])
                if d[i, j] + reach[i, j] <= theta - SLACK or a.leaf[x] and b.leaf[y] and (self.same and x == y or self.linked(x, y)):
                    self.whole(x, y)
                elif not (a.leaf[x] and b.leaf[y]):
                    stack.append((x, y))
        return self

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        """Row ids with links, their counts, and the row id of the root of each."""
        ids = self.a.ids.tolist() + ([] if self.same else self.b.ids.tolist())
        n = self.n_a.tolist() + ([] if self.same else self.n_b.tolist())
        at = [i for i, k in enumerate(n) if k]
        return [ids[i] for i in at], [n[i] for i in at], [ids[self.find(i)] for i in at]


def _rows(column) -> np.ndarray:
    """A list column as a matrix of doubles."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _shifted(raw: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest modulus to between a half and 1.  No digit of a sum of products
    changes by that, but none overflows or vanishes, however large or small the vector is.
    """
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> np.ndarray:
    scaled = raw / np.abs(raw).max(1, keepdims=True)  # squares of what is left neither vanish nor overflow
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def _grow(table):
    import pyarrow as pa

    tree = Tree(table.column("rid").to_numpy(), _rows(table.column("x")))
    keep = [table.column(c).slice(0, 1) for c in ("space", "block")]
    return pa.table([*keep, pa.array([pickle.dumps(tree, 5)], pa.binary())], names=["space", "block", "tree"])


def _nearest(table):
    """Each vector of a chunk with its nearest pivot and the distance to it; the pivots are the rows without a rid."""
    import pyarrow as pa

    rid, x = table.column("rid").to_numpy(zero_copy_only=False), _unit(_rows(table.column("x")))
    is_pivot = np.isnan(rid.astype(np.float64))
    pivots, order = x[is_pivot], table.column("pivot").to_numpy(zero_copy_only=False)[is_pivot]
    pivots, order = pivots[np.argsort(order)], np.sort(order).astype(np.int64)
    at = np.flatnonzero(~is_pivot)
    best = np.zeros(len(at), np.int64)
    for k in range(0, len(at), 1024):
        best[k : k + 1024] = (x[at[k : k + 1024]] @ pivots.T).argmax(1)
    far = np.sqrt(((x[at] - pivots[best]) ** 2).sum(1))
    which = pa.array(at)
    return pa.table({"space": table.column("space").take(which), "rid": pa.array(rid[at].astype(np.int64)), "x": table.column("x").take(which), "pivot": pa.array(order[best]), "far": pa.array(far)})


class _Layout:
    """Blocks of each pivot's vectors, near pivots next to each other, and the pairs of pivots whose balls are in reach.

    Rows with ``other`` null: ``pivot`` has the ``n_blocks`` blocks from ``first``.  Others: the two pivots' blocks must meet.
    """

    def __init__(self, cosine: float):
        self.theta = math.sqrt(2 - 2 * cosine)

    def __call__(self, table):
        import pyarrow as pa

        pivot, m, far = (table.column(c).to_numpy() for c in ("pivot", "m", "far"))
        size = int(table.column("size")[0].as_py())
        x = _unit(_rows(table.column("x")))
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T)))
        left, chain = np.ones(len(x), bool), [0]
        left[0] = False
        while left.any():  # always on to the nearest pivot that is left
            chain.append(int(np.where(left, apart[chain[-1]], np.inf).argmin()))
            left[chain[-1]] = False
        first, n_blocks, at, held = np.zeros(len(x), np.int64), np.ones(len(x), np.int64), 0, 0
        for k in chain:
            if held and held + m[k] > size:
                at, held = at + 1, 0
            first[k], n_blocks[k] = at, max(1, -(-m[k] // size))
            if n_blocks[k] > 1:
                at, held = at + n_blocks[k], 0
            else:
                held += m[k]
        near = apart <= far[:, None] + far[None, :] + self.theta + SLACK
        near[np.arange(len(x)), np.arange(len(x))] = True
        i, j = np.nonzero(np.triu(near))
        none = pa.nulls(len(x), pa.int64())
        space = table.column("space").combine_chunks()
        return pa.table(
            {
                "space": pa.concat_arrays([space, space.take(pa.array(i))]),
                "pivot": pa.array(np.concatenate([pivot, pivot[i]])),
                "other": pa.concat_arrays([none, pa.array(pivot[j])]),
                "first": pa.array(np.concatenate([first, first[i]])),
                "n_blocks": pa.array(np.concatenate([n_blocks, n_blocks[i]])),
                "other_first": pa.concat_arrays([none, pa.array(first[j])]),
                "other_blocks": pa.concat_arrays([none, pa.array(n_blocks[j])]),
            }
        )


class _Meet:
    """Walks all trees of one bundle with those of another, or of itself: counts and a spanning forest of all of them."""

    def __init__(self, cosine: float):
        self.cosine = cosine

    def __call__(self, table):
        import pyarrow as pa

        side = table.column("side").to_pylist()
        trees: list[list[Tree]] = [[], []]
        for s, column in zip(side, table.column("tree")):
            trees[s].append(pickle.loads(column.as_py()))
        count: dict[int, int] = {}
        a, b = [], []
        left, right = trees
        pairs = [(x, y) for x in left for y in right] if right else [(x, None if k == m else y) for k, x in enumerate(left) for m, y in enumerate(left) if k <= m]
        for x, y in pairs:
            for rid, n, root in zip(*Walk(x, y, self.cosine).run().rows()):
                count[rid] = count.get(rid, 0) + n
                if rid != root:
                    a.append(root)
                    b.append(rid)
        ids, code = np.unique(np.array(a + b + list(count), np.int64), return_inverse=True)
        x, y = code[: len(a)], code[len(a) : 2 * len(a)]
        root = local_roots(np.minimum(x, y), np.maximum(x, y), len(ids))
        return pa.table({"rid": pa.array(ids), "n": pa.array([count[i] for i in ids.tolist()], pa.int64()), "root": pa.array(ids[root])})


def _of_table(made):
    return lambda table: made(table)  # Spark counts the parameters of a function


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = BLOCK, bundle: int = BUNDLE, pivots: int = PIVOTS) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Two vectors link when their labels are equal and not null, their dimensions are equal and their cosine, in double
    precision, is at least ``cosine``; their magnitudes, from the smallest to the largest doubles, do not matter.  Null, empty and zero vectors and those with null or non-finite components link
    with nothing, are their own component and kept.  Rows that repeat a vec_id count as vectors of their own; null
    vec_ids take part, but a component is named by its smallest vec_id that is not null (null if there is none; such
    rows are kept).  Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = vectors.sparkSession
    rows = store.only(vectors, "vec_id", "embedding", "label")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    with Scratch(spark, "covertree") as tmp:
        made = tmp.save(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", F.when(valid, F.col("x")).alias("x")), "vectors")
        found = tmp.save(_links(tmp, made.where("x is not null").withColumn("dim", F.size("x")), cosine, block, bundle, pivots), "near")
        counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
        labels = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
        of = made.select("rid", "vec_id").join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left")
        of = of.join(counts, "rid", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "rid").alias("part"))
        names = of.groupBy("part").agg(F.min("vec_id").alias("component_id"))
        out = of.join(names, "part")
        out = out.select("vec_id", "n_links", "component_id", F.coalesce(F.expr("vec_id = component_id"), F.col("component_id").isNull()).alias("kept"))
        done = tmp.result(out)
        delete_result(labels)
        return done


def _links(tmp: Scratch, good: DataFrame, cosine: float, block: int, bundle: int, pivots: int) -> DataFrame:
    """``rid, n, root`` for every vector with links, once for each two bundles in which it has some."""
    spaces = good.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1")
    size = F.greatest(F.least(F.lit(block), F.expr(f"{block * WIDE} div dim")), F.lit(1))
    spaces = spaces.select(F.xxhash64("label", "dim").alias("space"), "label", "dim", "n", size.cast("int").alias("size"))
    spaces = tmp.save(spaces.withColumn("blocks", F.expr("cast(ceil(n / size) as int)")), "spaces")
    known = good.join(spaces, ["label", "dim"]).select("space", "n", "size", "blocks", "rid", "x")
    small = known.where(F.col("blocks") <= bundle).select("space", F.expr("pmod(xxhash64(rid), blocks)").alias("block"), "rid", "x")
    meet = spaces.where(F.col("blocks") <= bundle).select("space", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    if not spaces.where(F.col("blocks") > bundle).isEmpty():
        dealt, pairs = _deal(tmp, known.where(F.col("blocks") > bundle), cosine, bundle, pivots)
        small, meet = small.unionByName(dealt), meet.unionByName(pairs)
    trees = tmp.save(small.groupBy("space", "block").applyInArrow(_grow, "space long, block long, tree binary"), "trees").withColumn("at", F.expr(f"block div {bundle}"))
    left = meet.join(trees.withColumnRenamed("at", "i"), ["space", "i"]).select("space", "i", "j", F.lit(0).alias("side"), "tree")
    right = meet.where("i <> j").join(trees.withColumnRenamed("at", "j"), ["space", "j"]).select("space", "i", "j", F.lit(1).alias("side"), "tree")
    return left.unionByName(right).groupBy("space", "i", "j").applyInArrow(_of_table(_Meet(cosine)), "rid long, n long, root long")


def _deal(tmp: Scratch, known: DataFrame, cosine: float, bundle: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the vectors of large labels by their nearest pivots, and the pairs of bundles that are in reach."""
    share = F.least(F.col("blocks"), F.lit(pivots)) / F.col("n")  # a sample by hash: about as many pivots as blocks
    hashed = F.pmod(F.xxhash64("rid", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(hashed < share).select("space", F.col("rid").alias("pivot"), "x")
    least = known.groupBy("space").agg(F.min("rid").alias("pivot"), F.min_by("x", "rid").alias("x"))  # one at least
    chosen = tmp.save(chosen.unionByName(least).distinct(), "pivots")
    chunks = known.select("space", F.ceil(F.col("n") / CHUNK).alias("chunks")).distinct()
    shown = chosen.join(chunks, "space").select("space", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"), F.lit(None).cast("long").alias("rid"), "pivot", "x")
    mine = known.select("space", F.expr(f"pmod(xxhash64(rid, 'chunk'), cast(ceil(n / {CHUNK}) as long))").alias("chunk"), "rid", F.lit(None).cast("long").alias("pivot"), "x")
    near = tmp.save(mine.unionByName(shown).groupBy("space", "chunk").applyInArrow(_nearest, "space long, rid long, x array<double>, pivot long, far double"), "nearest")
    balls = near.groupBy("space", "pivot").agg(F.count("*").alias("m"), F.max("far").alias("far")).join(chosen, ["space", "pivot"])
    balls = balls.join(known.select("space", "size").distinct(), "space")
    kind = "space long, pivot long, other long, first long, n_blocks long, other_first long, other_blocks long"
    layout = tmp.save(balls.groupBy("space").applyInArrow(_of_table(_Layout(cosine)), kind), "layout")
    mapping = layout.where("other is null").select("space", "pivot", "first", "n_blocks")
    dealt = near.join(mapping, ["space", "pivot"]).select("space", (F.col("first") + F.expr("pmod(xxhash64(rid), n_blocks)")).alias("block"), "rid", "x")

    def bundles(first: str, n: str) -> Column:
        return F.explode(F.expr(f"sequence({first} div {bundle}, ({first} + {n} - 1) div {bundle})"))

    pairs = layout.where("other is not null").select("space", "other_first", "other_blocks", bundles("first", "n_blocks").alias("p"))
    pairs = pairs.select("space", "p", bundles("other_first", "other_blocks").alias("q"))
    return dealt, pairs.select("space", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).distinct()
