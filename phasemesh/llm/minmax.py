"""Near-duplicate groups by min-max hashing, with links confirmed on whole shingle sets.

1. Each text becomes its set of five-word shingles, a 128-bit key of the whole set, a signature that keeps both the
   minimum and the maximum under each permutation, and the band keys of the signature.
2. Texts with equal sets are one class; one of them stands for it from here on.
3. Classes that share a band key are candidates.  In each such bucket all are compared with the bucket's centre, the
   member that meets most others; this joins large groups with work in proportion to their size.
4. Buckets that still hold several components have every pair between components compared: no cap, nothing is left out.
   Blocks of signatures, a few hundred bytes for a text of any length, tell first which members can be similar; each pair
   is looked at in the first bucket that it shares.  Only the sets of those are then moved, in blocks of bounded bytes,
   which return a spanning forest of the links they find, not the pairs.

A pair of Jaccard similarity 0.85 shares no band of the default 32 x 8 with a probability of about 4e-5; more similar
pairs are missed far more rarely.  The signatures of a pair just at the threshold agree in fewer places than step 4 asks
for with a probability under 1e-13.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, local_roots
from ..scratch import Scratch, delete_result
from . import store
from .shingles import MinMax, shingles

#: Members of a bucket whose signatures are compared at a time (with as many others), and bytes of whole sets.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: Standard deviations below its mean at which the agreement of two signatures rules a pair out.
MARGIN = 8.0


def _key(hashes: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's key, as signed numbers."""
    key = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)


class _Signatures:
    def __init__(self, bands: int, rows: int, width: int):
        self.hash, self.width = MinMax(bands, rows), width

    def __call__(self, batches):
        import pyarrow as pa

        none = np.zeros(0, np.int64), b""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = [shingles(text, self.width) for text in some.column(1).to_pylist()]
                hi, lo = zip(*map(_key, sets))
                bands, low = zip(*[self.hash.keys(s) if len(s) else none for s in sets])
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=["doc_id", "n", "hi", "lo", "bands", "low"])


class _Sets:
    """Whole shingle sets under their keys."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(t, self.width) for t in batch.slice(at, 512).column(1).to_pylist()]
                hi, lo = zip(*map(_key, sets))
                yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["hi", "lo", "shingles"])


class _Confirm:
    """Keeps the pairs whose whole sets are similar enough."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, batches):
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = []
            for i, (p, q) in enumerate(zip(x, y)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= self.percent * (len(p) + len(q) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], names=["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets on the left with sets on the right, by an inverted index of the right."""
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    values = np.concatenate(right) if right else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for i, s in enumerate(left):
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = hi - lo
        hit = n > 0
        lo, n = lo[hit], n[hit]
        if len(n):
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out[i] = np.bincount(owner[at], minlength=len(right))
    return out


def least_agreement(values: int, percent: int) -> float:
    """Places of two signatures of ``values`` that agree at least, but for a chance of MARGIN standard deviations."""
    share = percent / 100
    return values * share - MARGIN * np.sqrt(values * share * (1 - share))


class _Suspects:
    """Members of two blocks of a bucket that may be similar to one of another component, by their signatures.

    A pair is looked at in one of the buckets that it shares, that of the first band.  Members come out in sub-blocks
    whose sets have bounded bytes (or hold a single set), both sides of every pair in one of them.
    """

    def __init__(self, percent: int, size: int):
        self.percent, self.size = percent, size

    def pairs(self, a: dict, b: dict, band: int) -> tuple[np.ndarray, np.ndarray]:
        found = []
        least = least_agreement(a["low"].shape[1], self.percent)
        for at in range(0, len(a["rep"]), 128):
            x = {k: v[at : at + 128] for k, v in a.items()}
            n, m = x["n"][:, None], b["n"][None, :]
            good = (x["comp"][:, None] != b["comp"][None, :]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
            good &= ~((b["apart"] == 1)[None, :] & (x["rep"][:, None] > b["rep"][None, :]))  # else both orders are looked at
            if good.any():
                same = np.zeros(good.shape, np.uint16)
                for k in range(x["low"].shape[1]):
                    same += x["low"][:, k, None] == b["low"][None, :, k]
                i, j = np.nonzero(good & (same >= least))
                for k in range(band):  # pairs that met in an earlier band go
                    later = x["bands"][i, k] != b["bands"][j, k]
                    i, j = i[later], j[later]
                found.append((at + i, j))
        return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def __call__(self, table):
        import pyarrow as pa

        n = table.num_rows
        columns = {c: table.column(c).to_numpy() for c in ("side", "rep", "comp", "n", "apart")}
        columns["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
        columns["low"] = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(n, -1)
        a, b = ({k: v[columns["side"] == s] for k, v in columns.items()} for s in (0, 1))
        i, j = self.pairs(a, b, int(table.column("band")[0].as_py()))
        out = []
        for side, which in ((a, i), (b, j)):
            here = np.unique(which)
            part = np.zeros(len(side["rep"]), np.int64)
            part[here] = np.cumsum(8 * side["n"][here]) // self.size
            out.append(part[which])
        sub = out[0] * (int(out[1].max(initial=0)) + 1) + out[1]
        rows = [np.unique(np.stack([sub, np.full(len(sub), s), side["rep"][which], side["comp"][which]], 1), axis=0) for s, (side, which) in enumerate(((a, i), (b, j)))]
        rows = np.concatenate(rows)
        keep = {c: pa.array(np.full(len(rows), table.column(c)[0].as_py()), table.schema.field(c).type) for c in ("key", "i", "j")}
        return pa.table({**keep, "sub": pa.array(rows[:, 0]), "side": pa.array(rows[:, 1].astype(np.int32)), "rep": pa.array(rows[:, 2]), "comp": pa.array(rows[:, 3])})


class _Blocks:
    """Compares the whole sets of two sides across components and returns a spanning forest of the links between them."""

    def __init__(self, percent: int):
        self.percent = percent

    def __call__(self, table):
        import pyarrow as pa

        side = table.column("side").to_numpy()
        rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        size = np.array([len(s) for s in sets], np.int64)
        both = overlaps([sets[i] for i in a], [sets[i] for i in b])
        i, j = np.nonzero((100 * both >= self.percent * (size[a][:, None] + size[b][None, :] - both)) & (comp[a][:, None] != comp[b][None, :]))
        nodes, code = np.unique(np.concatenate([rep[a[i]], rep[b[j]]]), return_inverse=True)
        root = local_roots(np.minimum(code[: len(i)], code[len(i) :]), np.maximum(code[: len(i)], code[len(i) :]), len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[root[moved]]), "b": pa.array(nodes[moved])})


def _by_table(made):
    return lambda table: made(table)  # Spark counts the parameters of a function


def groups(docs: DataFrame, percent: int = 85, bands: int = 32, rows: int = 8, width: int = 5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    ``percent``: texts are linked when 100 * intersection >= percent * union of their shingle sets.  Texts that are
    null, empty or without words have no shingles and are linked with nothing.  A row whose doc_id is null is linked with
    nothing, its component is null and it is kept.  Rows that repeat a doc_id each get the component of their own text,
    and all that have its smallest doc_id are kept.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    rows_in = store.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    with Scratch(spark, "minmax") as tmp:
        made = rows_in.mapInArrow(_Signatures(bands, rows, width), "doc_id long, n long, hi long, lo long, bands array<long>, low binary")
        made = tmp.save(made.withColumn("rid", F.monotonically_increasing_id()), "signatures")
        sets = made.where("n > 0 and doc_id is not null")
        classes = sets.groupBy("hi", "lo").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "bands", "low")])
        classes = tmp.save(classes, "classes")
        links = _links(tmp, rows_in, classes, percent, width)
        found = components(links)
        joined = classes.select("hi", "lo", "rep", "doc_id").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        joined = joined.select("hi", "lo", "doc_id", F.coalesce("component", "rep").alias("group"))
        smallest = joined.groupBy("group").agg(F.min("doc_id").alias("component_id"))
        of_class = joined.join(smallest, "group").select("hi", "lo", "component_id")
        out = made.select("doc_id", "n", F.when(F.col("n") > 0, F.col("hi")).alias("hi"), "lo").join(of_class, ["hi", "lo"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
        done = tmp.result(out)
        delete_result(found)
        return done


def _links(tmp: Scratch, texts: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """Links ``a, b`` between classes, enough of them to join what is similar."""
    keys = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = tmp.save(keys.join(sizes, "key"), "members")

    popular = members.groupBy("rep").agg(F.sum("m").alias("popularity"))
    ranked = members.join(popular, "rep")
    centres = ranked.groupBy("key").agg(F.max(F.struct("popularity", "rep", "n")).alias("c"))
    centres = centres.select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("c_n"))
    with_centre = members.join(centres, "key")
    near = (F.lit(100) * F.least("n", "c_n") >= F.lit(percent) * F.greatest("n", "c_n")) & (F.col("rep") != F.col("centre"))
    pairs = tmp.save(with_centre.where(near).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")

    wanted = tmp.save(classes.select("hi", "lo", "rep", "doc_id").join(members.select("rep").distinct(), "rep"), "wanted")
    shown = store.semi(texts, wanted.select("doc_id"), "doc_id").mapInArrow(_Sets(width), "hi long, lo long, shingles binary")
    shown = tmp.save(shown.join(wanted.select("hi", "lo", "rep"), ["hi", "lo"]).dropDuplicates(["rep"]).select("rep", "shingles"), "sets")
    left, right = shown.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), shown.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    linked = tmp.save(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_Confirm(percent), "a long, b long"), "confirmed")
    labels = components(linked)

    comp = with_centre.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    comp = comp.join(labels.select(F.col("node").alias("centre"), F.col("component").alias("cc")), "centre", "left").withColumn("c_comp", F.coalesce("cc", "centre"))
    rest = tmp.save(comp.where("rep <> centre").select("key", "band", "rep", "comp", (F.col("comp") != F.col("c_comp")).cast("int").alias("apart")), "rest")
    tmp.discard(members, pairs, wanted)
    delete_result(labels)
    still = rest.groupBy("key").agg(F.sum("apart").alias("n_a"), F.count("*").alias("n_b"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    still = still.where("n_a > 0 and x <> y").select(
        "key", F.ceil(F.col("n_a") / BLOCK).cast("int").alias("blocks_a"), F.ceil(F.col("n_b") / BLOCK).cast("int").alias("blocks_b")
    )
    split = rest.join(still, "key").withColumn("h", F.xxhash64("rep", "key")).join(classes.select("rep", "n", "bands", "low"), "rep")
    told = ["key", "band", "rep", "comp", "apart", "n", "bands", "low"]
    side_a = split.where("apart = 1").select(
        *told, F.lit(0).alias("side"), F.expr("cast(pmod(h, blocks_a) as int)").alias("i"), F.explode(F.expr("sequence(0, blocks_b - 1)")).alias("j")
    )
    side_b = split.select(*told, F.lit(1).alias("side"), F.explode(F.expr("sequence(0, blocks_a - 1)")).alias("i"), F.expr("cast(pmod(h, blocks_b) as int)").alias("j"))
    both = side_a.unionByName(side_b).groupBy("key", "i", "j")
    suspects = tmp.save(both.applyInArrow(_by_table(_Suspects(percent, BLOCK_BYTES)), "key long, i int, j int, sub long, side int, rep long, comp long"), "suspects")
    blocks = suspects.join(shown, "rep").groupBy("key", "i", "j", "sub")
    return linked.unionByName(blocks.applyInArrow(_by_table(_Blocks(percent)), "a long, b long"))
