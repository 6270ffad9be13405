"""Connected components of a distributed list of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Links of one group up to which one task finds its components; beyond, rounds of joins contract them first.
LOCAL_LINKS = 1_000_000


def local_roots(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links ``lo[i] - hi[i]`` let it reach."""
    root = np.arange(n)
    while len(lo):
        x, y = root[lo], root[hi]
        live = x != y
        lo, hi = lo[live], hi[live]
        np.minimum.at(root, np.maximum(x[live], y[live]), np.minimum(x[live], y[live]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _local(by: list[str]):
    """Components of one group's links, as rows of all nodes that are not the smallest of theirs."""

    def find(table):
        import pyarrow as pa

        both = pa.chunked_array([*table.column("lo").chunks, *table.column("hi").chunks], table.column("lo").type)
        nodes, code = np.unique(both.to_numpy(), return_inverse=True)
        n = table.num_rows
        root = local_roots(code[:n], code[n:], len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        kind = table.column("lo").type
        columns = {b: table.column(b).take(pa.array(np.zeros(len(moved), np.int64))) for b in by}
        return pa.table({**columns, "node": pa.array(nodes[moved], kind), "component": pa.array(nodes[root[moved]], kind)})

    return find


def _flat(tmp: Scratch, hooks: DataFrame, by: list[str]) -> DataFrame:
    """Pointer jumping until every node points at a root; each step halves the depth."""
    while True:
        up = hooks.select(*by, F.col("node").alias("parent"), F.col("parent").alias("top"))
        met = hooks.join(up, [*by, "parent"], "left")
        if met.where("top is not null").isEmpty():
            return hooks
        made = tmp.save(met.select(*by, "node", F.coalesce("top", "parent").alias("parent")), "hooks")
        tmp.discard(hooks)
        hooks = made


def components(links: DataFrame, *by: str, local: int = LOCAL_LINKS) -> DataFrame:
    """``links(by..., a, b)`` -> ``(by..., node, component)`` of all nodes that are not the smallest of their component,
    separately for each ``by``; a component is named by its smallest node.

    While a group has more than ``local`` links, a round hooks every node to its smallest smaller neighbour, flattens the
    hooks and contracts the links; only local minima are left over, so few rounds are needed.  The rest of each group is
    solved by one task.  Links with a null end or a null in ``by`` and links of a node with itself are ignored; no links
    give no rows.
    """
    keys = list(by)
    names = {k: f"k{i}" for i, k in enumerate(keys)}
    k = list(names.values())
    real = links.dropna(subset=[*keys, "a", "b"]).where("a <> b")
    tagged = real.select(*[F.col(x).alias(n) for x, n in names.items()], F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    with Scratch(links.sparkSession, "components") as tmp:
        edges = tmp.save(tagged.distinct(), "links")
        labels = None
        group = k or [F.lit(True)]
        while (edges.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) > local:
            hooks = _flat(tmp, tmp.save(edges.groupBy(*k, F.col("hi").alias("node")).agg(F.min("lo").alias("parent")), "hooks"), k)
            if labels is None:
                labels = hooks.select(*k, "node", F.col("parent").alias("component"))
            else:
                top = hooks.select(*k, F.col("node").alias("component"), "parent")
                moved = labels.join(top, [*k, "component"], "left").select(*k, "node", F.coalesce("parent", "component").alias("component"))
                labels = moved.unionByName(hooks.select(*k, "node", F.col("parent").alias("component")))
            labels = tmp.save(labels, "labels")
            # every higher end is hooked; a lower end may be a root
            up = edges.join(hooks.select(*k, F.col("node").alias("hi"), F.col("parent").alias("y")), [*k, "hi"])
            up = up.join(hooks.select(*k, F.col("node").alias("lo"), F.col("parent").alias("x")), [*k, "lo"], "left").withColumn("x", F.coalesce("x", "lo"))
            left = tmp.save(up.where("x <> y").select(*k, F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "links")
            tmp.discard(edges, hooks)
            edges = left
        schema = ", ".join([f"{n} {t}" for n, t in edges.dtypes if n in k] + [f"{n} {dict(edges.dtypes)['lo']}" for n in ("node", "component")])
        last = edges.groupBy(*group).applyInArrow(_local(k), schema)
        if labels is not None:
            last = tmp.save(last, "last")
            top = last.select(*k, F.col("node").alias("component"), F.col("component").alias("parent"))
            moved = labels.join(top, [*k, "component"], "left").select(*k, "node", F.coalesce("parent", "component").alias("component"))
            last = moved.unionByName(last)
        return tmp.result(last.toDF(*keys, "node", "component"))
