"""Mass-univariate tests, permutations and contrasts.

``x``: one row for each vertex (or any key) and session, with ``value``, a 0/1 label ``g`` and ``subject``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..scratch import Scratch, delete_result
from .ordered import average_rank, numbered

#: Labels (subjects x simulations) that are broadcast as one matrix, and keys whose sums meet it at a time.
MATRIX_CELLS, KEYS = 20_000_000, 512
#: Simulations whose hashes one task orders.
DRAWN = 16


def rank_sum(x: DataFrame, *by: str, p: bool = True) -> DataFrame:
    """Rank-sum statistic W of group 0, group sizes and (unless ``p`` is false) the two-sided p.

    Rows without a value or with a label other than 0 and 1 take no part.
    """
    ranked = x.where(F.col("value").isNotNull() & F.col("g").isin(0, 1)).withColumn("_rk", average_rank("value", *by))
    tied = ranked.withColumn("_t", F.count("*").over(Window.partitionBy(*by, "value")).cast("double"))
    n0 = F.count_if(F.col("g") == 0).cast("double")
    out = tied.groupBy(*by).agg(
        (F.sum(F.when(F.col("g") == 0, F.col("_rk"))) - n0 * (n0 + 1) / 2).alias("w"),
        F.count_if(F.col("g") == 0).alias("n0"),
        F.count_if(F.col("g") == 1).alias("n1"),
        F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"),
    )
    if not p:
        return out
    return out.withColumn("p", special.rank_sum_p(F.col("w"), F.col("n0"), F.col("n1"), F.col("ties")))


def signed_rank(pairs: DataFrame, *by: str, p: bool = True) -> DataFrame:
    """Signed-rank statistic V of ``v1 - v2``; pairs with a null are left out, and zero differences but for their number.

    p is exact for fewer than 50 differences without ties and zeros, else normal with continuity correction.
    """
    d = pairs.withColumn("_d", F.col("v1") - F.col("v2")).where("_d is not null").withColumn("_a", F.abs("_d"))
    nil = F.col("_d") == 0  # sorts before all others: ranks of the others are lowered by the number of zeros
    here = Window.partitionBy(*by)
    ranked = d.withColumn("_z", F.count_if(nil).over(here)).withColumn("_rk", average_rank("_a", *by) - F.col("_z")).withColumn("_t", F.count("*").over(Window.partitionBy(*by, "_a")).cast("double"))
    out = ranked.groupBy(*by).agg(
        F.sum(F.when(F.col("_d") > 0, F.col("_rk")).otherwise(0.0)).alias("v"),
        F.count_if(~nil).alias("n"),
        F.sum(F.when(~nil, F.col("_t") * F.col("_t") - 1).otherwise(0.0)).alias("ties"),
        F.count_if(nil).alias("zeros"),
    )
    if not p:
        return out
    return out.withColumn("p", special.signed_rank_p(F.col("v"), F.col("n"), F.col("ties"), F.col("zeros")))


def welch(x: DataFrame, *by: str, p: bool = True) -> DataFrame:
    """Welch's t of group 0 against group 1 and its degrees of freedom."""
    m = {(f, g): F.expr(f"{f}(CASE WHEN g = {g} THEN value END)") for f in ("avg", "var_samp", "count") for g in (0, 1)}
    s = x.groupBy(*by).agg(*[v.alias(f"{f}{g}") for (f, g), v in m.items()])
    a, b = F.col("var_samp0") / F.col("count0"), F.col("var_samp1") / F.col("count1")
    out = s.select(
        *by,
        ((F.col("avg0") - F.col("avg1")) / F.sqrt(a + b)).alias("t"),
        ((a + b) * (a + b) / (a * a / (F.col("count0") - 1) + b * b / (F.col("count1") - 1))).alias("df"),
    )
    return out.withColumn("p", special.t_p(F.col("t"), F.col("df"))) if p else out


def paired_t(pairs: DataFrame, *by: str, p: bool = True) -> DataFrame:
    d = pairs.withColumn("_d", F.col("v1") - F.col("v2"))
    out = d.groupBy(*by).agg((F.avg("_d") / (F.stddev_samp("_d") / F.sqrt(F.count("_d").cast("double")))).alias("t"), (F.count("_d") - 1).cast("double").alias("df"))
    return out.withColumn("p", special.t_p(F.col("t"), F.col("df"))) if p else out


def mean_difference(value: str = "value", label: str = "g") -> Column:
    """Aggregate: mean of group 0 less mean of group 1."""
    return F.avg(F.when(F.col(label) == 0, F.col(value))) - F.avg(F.when(F.col(label) == 1, F.col(value)))


def contrasts(sessions: DataFrame, table: list[tuple[str, str, str]]) -> DataFrame:
    """Sessions of both sides of each named contrast; ``side`` 0 and 1.  ``table``: (name, SQL of side 0, SQL of side 1)."""
    out = None
    for name, zero, one in table:
        part = sessions.withColumn("contrast", F.lit(name)).withColumn("side", F.when(F.expr(zero), 0).when(F.expr(one), 1)).where("side is not null")
        out = part if out is None else out.unionByName(part)
    return out


def permuted_labels(subjects: DataFrame, sims: int, key: str = "subject", label: str = "g", seed: int = 0) -> DataFrame:
    """``sim, subject, g``: labels shuffled among subjects, one label to a subject; sim 0 is as it was.

    Each simulation orders the subjects by a hash of its own, and the labels in that order go to the subjects in the order
    of their keys, so every simulation is a shuffle independent of the others, the same in any engine.  Keys of any type;
    rows with a null key or label are left out; a subject with several labels counts with the smallest.  One simulation's
    subjects, a cohort, are one group.
    """
    dealt = shuffles(subjects, sims, key, label, seed).select("sim", F.explode(F.arrays_zip("keys", "labels")).alias("x"))
    return dealt.select("sim", F.col("x.keys").alias(key), F.col("x.labels").alias(label))


def shuffles(subjects: DataFrame, sims: int, key: str = "subject", label: str = "g", seed: int = 0) -> DataFrame:
    """The same with one row for each simulation: ``sim, keys[], labels[]``, the subjects in the same order in each."""
    known = subjects.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("g"))
    cohort = known.agg(F.sort_array(F.collect_list(F.struct("k", F.col("k").cast("string").alias("name"), "g"))).alias("s")).where(F.size("s") > 0)
    cohort = cohort.select(F.col("s.k").alias("keys"), F.col("s.name").alias("names"), F.col("s.g").alias("g"))
    some = subjects.sparkSession.range(0, sims + 1, DRAWN, -(-(sims + 1) // DRAWN)).select(F.sequence("id", F.least(F.col("id") + DRAWN - 1, F.lit(sims))).cast("array<int>").alias("sims"))
    order = some.crossJoin(F.broadcast(cohort.select("names"))).mapInArrow(_Orders(seed), "sim int, places array<int>")  # one row
    dealt = order.crossJoin(F.broadcast(cohort.select("keys", "g")))
    return dealt.select("sim", "keys", F.transform("places", lambda i: F.get("g", i)).alias("labels"))


class _Orders:
    """Places of the subjects, which come in the order of their keys, in the order of each simulation's hash: md5 of seed,
    simulation and key.  Simulation 0 leaves them as they are.
    """

    def __init__(self, seed: int):
        self.seed = seed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sims, names in zip(*batch.columns):
                names = [n.encode() for n in names.as_py()]
                for sim in sims.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([sim], pa.int32()), pa.array([self._places(sim, names)], pa.list_(pa.int32()))], names=["sim", "places"])

    def _places(self, sim: int, names: list[bytes]) -> np.ndarray:
        if not sim:
            return np.arange(len(names), dtype=np.int32)
        head = f"{self.seed}:{sim}:".encode()
        digests = b"".join([hashlib.md5(head + n, usedforsecurity=False).digest() for n in names])
        high, low = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
        return np.lexsort((low, high)).astype(np.int32)


def _known(labels: DataFrame, key: str) -> DataFrame:
    """``sim, keys[], labels[]``, the keys with simulation 0 only; ``labels``: as of :func:`shuffles` or :func:`permuted_labels`."""
    if "keys" not in labels.columns:
        whole = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("g").cast("tinyint").alias("g"))))
        labels = labels.groupBy("sim").agg(whole.alias("s")).select("sim", F.col("s.k").alias("keys"), F.col("s.g").alias("labels"))
    return labels.select("sim", F.when(F.col("sim") == 0, F.col("keys")).alias("keys"), F.transform("labels", lambda g: g.cast("tinyint")).alias("labels"))


def _matrix(known: DataFrame):
    """``(subjects as a table of k and its column ix, labels [sim, column])`` of :func:`_known`, or None where that is over
    MATRIX_CELLS.
    """
    cells = known.agg(F.sum(F.size("labels"))).first()[0] or 0
    if not 0 < cells <= MATRIX_CELLS:
        return None
    keys = known.where("sim = 0").select("keys").toArrow().column("keys").combine_chunks().flatten()
    found = known.select("sim", "labels").toArrow().sort_by("sim").column("labels").combine_chunks()
    index = pa.table({"k": keys, "ix": pa.array(np.arange(len(keys), dtype=np.int32))})
    return known.sparkSession.createDataFrame(index), found.flatten().to_numpy().reshape(len(found), -1)


def _per_subject(cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and the list's values of one batch of lists of structs (ix, s, n)."""
    flat = cells.flatten()
    row = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    ix, s, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    return np.stack([row, ix]), s.astype(np.float64), n.astype(np.float64)


class _Kernel:
    """Sums by subject of some keys at a time, as matrices over subjects, against all labels at once."""

    def __init__(self, labels):
        self.labels = labels

    def groups(self, cells):
        """Slices of a batch with the sums of values and of counts: both in all, and of group 1 [key, sim]."""
        one = self.labels.value.T == 1
        one = one.astype(np.float64)
        for at in range(0, len(cells), KEYS):
            some = cells.slice(at, KEYS)
            (row, ix), s, n = _per_subject(some)
            sums, counts = np.zeros((2, len(some), len(one)))
            sums[row, ix], counts[row, ix] = s, n
            yield at, len(some), sums.sum(1, keepdims=True), counts.sum(1, keepdims=True), sums @ one, counts @ one


class _Differences(_Kernel):
    def __call__(self, batches):
        for batch in batches:
            for at, size, sums, counts, s1, n1 in self.groups(batch.column(batch.num_columns - 1)):
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = (sums - s1) / (counts - n1) - s1 / n1
                hits = (np.abs(d[:, 1:]) >= np.abs(d[:, :1]) - 1e-12).sum(1)
                seen = [pa.array(d[:, 0], from_pandas=True), pa.array((hits + 1) / d.shape[1])]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, size).columns[:-1], *seen], names=[*batch.schema.names[:-1], "diff", "p"])


def permutation_p(x: DataFrame, labels: DataFrame, *by: str, key: str = "subject") -> DataFrame:
    """Observed difference of group means and the share of relabelled differences at least as large, the observed one
    counted: ``(1 + hits) / (sims + 1)``.

    Values are summed by subject first.  The labels meet them as one matrix, [simulation, subject], that is broadcast
    after its size is checked; beyond MATRIX_CELLS they meet as tiles, see :func:`_tiled_p`.  Rows of subjects without
    labels are left out.
    """
    sums = x.groupBy(*by, key).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("s"), F.count("value").alias("n"))
    known = _known(labels, key).persist()
    try:
        made = _matrix(known)
        if made is None:
            return _tiled_p(sums, known if "keys" in labels.columns else labels, by, key)
    finally:
        known.unpersist()
    index, matrix = made
    cells = sums.join(F.broadcast(index), F.col(key) == F.col("k")).groupBy(*by).agg(F.collect_list(F.struct("ix", "s", "n")).alias("_c"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in cells.dtypes[:-1])
    return cells.mapInArrow(_Differences(x.sparkSession.sparkContext.broadcast(matrix)), f"{kinds}, diff double, p double")


class _Significant(_Kernel):
    def __init__(self, labels, alpha: float):
        super().__init__(labels)
        self.alpha = alpha

    def __call__(self, batches):
        for batch in batches:
            ties = batch.column(batch.num_columns - 2).to_numpy()
            for at, size, ranks, counts, r1, n1 in self.groups(batch.column(batch.num_columns - 1)):
                n0 = counts - n1
                w = ranks - r1 - n0 * (n0 + 1) / 2
                key, sim = np.nonzero(special.rank_sum_below(w, n0, n1, np.broadcast_to(ties[at : at + size, None], w.shape), self.alpha))
                found = [c.take(pa.array(at + key)) for c in batch.columns[:-2]]
                yield pa.RecordBatch.from_arrays([*found, pa.array(sim, pa.int32())], names=[*batch.schema.names[:-2], "sim"])


def significant(x: DataFrame, labels: DataFrame, alpha: float, *by: str, key: str = "subject") -> DataFrame:
    """``by..., sim``: where the two-sided rank-sum test of group 0 against group 1 gives p < alpha under each relabelling.

    Ranks do not depend on labels, so they are taken once and summed by subject; each relabelling then picks its sums, as
    in :func:`permutation_p`.  A label matrix over MATRIX_CELLS is cut into tiles, see :func:`_tiled`.  No labels raise.
    """
    known = _known(labels, key).persist()
    try:
        made = _matrix(known)
    finally:
        known.unpersist()
    if made is None:
        if labels.isEmpty():
            raise ValueError("there are no labels")
        return _tiled(x, labels, alpha, by, key)
    index, matrix = made
    cells = _rank_sums(x, F.broadcast(index), by, key).groupBy(*by).agg(F.sum("t").alias("_ties"), F.collect_list(F.struct("ix", "s", "n")).alias("_c"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in cells.dtypes[:-2])
    return cells.mapInArrow(_Significant(x.sparkSession.sparkContext.broadcast(matrix), alpha), f"{kinds}, sim int")


def _rank_sums(x: DataFrame, index: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """``by..., ix, s, n, t``: each subject's sum of ranks, their number, and its share in the correction for ties."""
    known = x.where(F.col("value").isNotNull()).join(index, F.col(key) == F.col("k"))
    ranked = known.withColumn("_rk", average_rank("value", *by)).withColumn("_t", F.count("*").over(Window.partitionBy(*by, "value")).cast("double"))
    return ranked.groupBy(*by, "ix").agg(F.sum("_rk").alias("s"), F.count("*").alias("n"), F.sum(F.col("_t") * F.col("_t") - 1).alias("t"))


#: Keys, subjects and simulations of a tile.
TILE = (256, 4096, 256)


def _numbered_keys(tmp: Scratch, sums: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The keys ``names...`` with their numbers ``kid``, and ``sums`` with ``kid`` in place of them."""
    sums = tmp.save(sums, "sums")
    known = numbered(sums.select(*names).distinct(), names, "kid")
    met = sums.join(known.select(*[F.col(n).alias(f"{n}k") for n in names], "kid"), [F.col(n).eqNullSafe(F.col(f"{n}k")) for n in names]) if names else sums.crossJoin(F.broadcast(known))
    return known, tmp.save(met.drop(*names, *[f"{n}k" for n in names]).withColumn("n", F.col("n").cast("double")), "numbered")


def _cells(met: DataFrame) -> DataFrame:
    """``st, kb, cells``: sums by number of key and of subject (``kid, ix, s, n``) as tiles."""
    keys, subjects, _ = TILE
    st, kb = F.floor(F.col("ix") / subjects).cast("long").alias("st"), F.floor(F.col("kid") / keys).cast("long").alias("kb")
    return met.groupBy(st, kb).agg(F.collect_list(F.struct((F.col("kid") % keys).cast("int").alias("k"), (F.col("ix") % subjects).cast("int").alias("i"), "s", "n")).alias("cells"))


def _tiled(x: DataFrame, labels: DataFrame, alpha: float, by: Sequence[str], key: str) -> DataFrame:
    """:func:`significant` for any number of labels, as a product of tiles.

    Rank sums [keys x subjects] and labels [subjects x simulations] are cut into tiles that meet by their range of
    subjects; a product is a key's rank sums in group 1 over a range of subjects for a range of simulations, and these are
    added by key and range of simulations.  A task holds one tile of each kind and their product.
    """
    keys, subjects, sims = TILE
    spark, names = x.sparkSession, [f"_b{i}" for i in range(len(by))]
    if "keys" in labels.columns:
        labels = labels.select("sim", F.explode(F.arrays_zip("keys", "labels")).alias("x")).select("sim", F.col("x.keys").alias("k"), F.col("x.labels").alias("g"))
    else:
        labels = labels.select("sim", F.col(key).alias("k"), "g")
    with Scratch(spark, "tiled") as tmp:
        labels = tmp.save(labels.where("k is not null and g is not null").select("sim", "k", F.col("g").cast("int").alias("g")), "labels")
        index = numbered(labels.select("k").distinct(), ["k"], "ix")
        known, met = _numbered_keys(tmp, _rank_sums(x, index, by, key).select(*[F.col(c).alias(n) for c, n in zip(by, names)], "ix", "s", "n", "t"), names)
        ties = met.groupBy("kid").agg(F.sum("t").alias("ties"))
        st = F.floor(F.col("ix") / subjects).cast("long").alias("st")
        left = _cells(met)
        right = labels.join(index, "k").groupBy(st, F.floor(F.col("sim") / sims).cast("long").alias("sb"))
        right = right.agg(F.collect_list(F.struct((F.col("ix") % subjects).cast("int").alias("i"), (F.col("sim") % sims).cast("int").alias("j"), F.col("g").cast("tinyint").alias("g"))).alias("labels"))
        left, right = tmp.save(left, "left"), tmp.save(right, "right")
        parts = left.join(right, "st").select("kb", "sb", "cells", "labels").mapInArrow(_Product(keys, subjects, sims), "kid long, sb long, data binary")
        total = parts.groupBy("kid", "sb").applyInArrow(_added, "kid long, sb long, data binary").join(ties, "kid")
        found = total.select("kid", "sb", "ties", "data").mapInArrow(_TileTest(sims, alpha), "kid long, sim int")
        drawn = labels.select("sim").distinct()  # the last range has numbers that no simulation has
        out = found.join(F.broadcast(drawn), "sim", "left_semi").join(known, "kid")
        done = tmp.result(out.select(*[F.col(n).alias(c) for c, n in zip(by, names)], "sim"))
        delete_result(index)
        delete_result(known)
        return done


class _Product:
    """Products of pairs of tiles, one row a key: its rank sum and number of values in all, then those in group 1 by
    simulation.
    """

    def __init__(self, keys: int, subjects: int, sims: int):
        self.shape = keys, subjects, sims

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        keys, subjects, sims = self.shape
        for batch in batches:
            for row in range(batch.num_rows):
                kb, sb = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                cells, labels = batch.column(2)[row].values, batch.column(3)[row].values
                k, i, s, n = (cells.field(c).to_numpy(zero_copy_only=False) for c in range(4))
                li, lj, g = (labels.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                one = np.zeros((subjects, sims))
                one[li[g == 1], lj[g == 1]] = 1.0
                sums, counts = np.zeros((2, keys, subjects))
                sums[k, i], counts[k, i] = s, n
                held = np.unique(k)
                made = np.hstack([sums[held].sum(1, keepdims=True), counts[held].sum(1, keepdims=True), sums[held] @ one, counts[held] @ one])
                yield pa.RecordBatch.from_arrays([pa.array(kb * keys + held.astype(np.int64)), pa.array([sb] * len(held), pa.int64()), pa.array([r.tobytes() for r in made], pa.binary())], names=["kid", "sb", "data"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of a key's partial sums over all ranges of subjects."""
    total, head = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            head = batch.slice(row, 1)
            part = np.frombuffer(batch.column(2)[row].as_buffer(), np.float64)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([head.column(0), head.column(1), pa.array([total.tobytes()], pa.binary())], names=["kid", "sb", "data"])


class _TileTest:
    """The simulations of a range under which a key is significant."""

    def __init__(self, sims: int, alpha: float):
        self.sims, self.alpha = sims, alpha

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = np.array([np.frombuffer(v.as_buffer(), np.float64) for v in batch.column(3)])
            ranks, counts = made[:, :1], made[:, 1:2]
            r1, n1 = made[:, 2 : 2 + self.sims], made[:, 2 + self.sims :]
            n0 = counts - n1
            w = ranks - r1 - n0 * (n0 + 1) / 2
            ties = np.broadcast_to(batch.column(2).to_numpy()[:, None], w.shape)
            at, sim = np.nonzero(special.rank_sum_below(w, n0, n1, ties, self.alpha))
            first = batch.column(1).to_numpy()[at] * self.sims
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array((first + sim).astype(np.int32))], names=["kid", "sim"])


def _tiled_p(sums: DataFrame, labels: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """:func:`permutation_p` for any number of labels, as a product of tiles.

    ``sums``: ``by..., key, s, n``; ``labels``: of :func:`_known`, or one row for each label.  Each simulation's labels are
    cut into ranges of subjects, a byte a label, and so are the sums; a tile of sums [keys x subjects] meets the labels of
    its range [subjects x simulations], those of simulation 0 with every range of simulations.  A product is a key's sums
    and counts in either group, and these are added by key and range of simulations, in the order of the ranges of
    subjects.  No label is a row by itself, and a task holds one tile of each kind and their product.
    """
    keys, subjects, sims = TILE
    spark, names = sums.sparkSession, [f"_b{i}" for i in range(len(by))]
    with Scratch(spark, "tiled") as tmp:
        if "keys" in labels.columns:
            index = tmp.save(labels.where("sim = 0").select(F.posexplode("keys").alias("ix", "k")), "index")
            cut = labels.select("sim", "labels").mapInArrow(_Cut(subjects), "sim int, st long, data binary")
        else:
            labels = tmp.save(labels.select("sim", F.col(key).alias("k"), F.col("g").cast("tinyint").alias("g")).where("k is not null and g is not null"), "labels")
            index = numbered(labels.select("k").distinct(), ["k"], "ix")
            st = F.floor(F.col("ix") / subjects).cast("long").alias("st")
            some = labels.join(index.hint("merge"), "k").groupBy("sim", st).agg(F.collect_list(F.struct((F.col("ix") % subjects).cast("int").alias("i"), "g")).alias("labels"))
            cut = some.mapInArrow(_Laid(subjects), "sim int, st long, data binary")
        cut = tmp.save(cut, "cut")
        last = (cut.agg(F.max("sim")).first()[0] or 0) // sims
        sb = F.when(F.col("sim") == 0, F.sequence(F.lit(0), F.lit(last))).otherwise(F.array(F.floor(F.col("sim") / sims).cast("int")))
        right = cut.withColumn("sb", F.explode(sb.cast("array<long>"))).groupBy("st", "sb").agg(F.collect_list(F.struct("sim", "data")).alias("labels"))
        # joins are never of a size that is guessed: what is exploded has more rows than Spark believes
        held = sums.join(index.hint("merge"), F.col(key) == F.col("k")).select(*[F.col(c).alias(n) for c, n in zip(by, names)], "ix", "s", "n")
        known, met = _numbered_keys(tmp, held, names)
        met = _cells(met).join(right.hint("merge"), "st").select("kb", "sb", "st", "cells", "labels")
        parts = met.mapInArrow(_Sides(keys, subjects, sims), "kid long, sb long, st long, data binary")
        hits = parts.repartition("kid", "sb").sortWithinPartitions("kid", "sb", "st").mapInArrow(_added_hits, "kid long, sb long, diff double, hits long, n long")
        total = hits.groupBy("kid").agg(F.max(F.when(F.col("sb") == 0, F.col("diff"))).alias("diff"), ((F.sum("hits") + 1).cast("double") / F.sum("n")).alias("p"))
        done = tmp.result(total.join(known, "kid").select(*[F.col(n).alias(c) for c, n in zip(by, names)], "diff", "p"))
        delete_result(index)
        delete_result(known)
        return done


class _Cut:
    """The labels of whole simulations in ranges of subjects, a byte a label."""

    def __init__(self, subjects: int):
        self.subjects = subjects

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sim, labels in zip(*batch.columns):
                g = labels.values.to_numpy().astype(np.int8)
                made = [g[at : at + self.subjects].tobytes() for at in range(0, len(g), self.subjects)]
                yield pa.RecordBatch.from_arrays([pa.array([sim.as_py()] * len(made), pa.int32()), pa.array(np.arange(len(made), dtype=np.int64)), pa.array(made, pa.binary())], names=["sim", "st", "data"])


class _Laid:
    """The same from lists of places and labels; -1 where a simulation has no label."""

    def __init__(self, subjects: int):
        self.subjects = subjects

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for labels in batch.column(2):
                g = np.full(self.subjects, -1, np.int8)
                g[labels.values.field(0).to_numpy()] = labels.values.field(1).to_numpy()
                made.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], names=["sim", "st", "data"])


class _Sides:
    """Products of pairs of tiles, one row a key: by simulation, the first of them 0, its sums and numbers of values in group
    0 and in group 1, and how many of its subjects have a label.
    """

    def __init__(self, keys: int, subjects: int, sims: int):
        self.shape = keys, subjects, sims

    def __call__(self, batches) -> Iterator[pa.RecordBatch]:
        keys, subjects, sims = self.shape
        for batch in batches:
            for row in range(batch.num_rows):
                kb, sb, st = (batch.column(c)[row].as_py() for c in range(3))
                cells, labels = batch.column(3)[row].values, batch.column(4)[row].values
                k, i, s, n = (cells.field(c).to_numpy(zero_copy_only=False) for c in range(4))
                g = np.full((1 + sims, subjects), -1, np.int8)
                for sim, data in zip(labels.field(0).to_pylist(), labels.field(1)):
                    here = np.frombuffer(data.as_buffer(), np.int8)
                    g[1 + sim - sb * sims if sim else 0, : len(here)] = here
                held, k = np.unique(k, return_inverse=True)
                there, values, counts = np.zeros((3, len(held), subjects))
                there[k, i], values[k, i], counts[k, i] = 1.0, s, n
                zero, one = (np.ascontiguousarray((g == label).T, np.float64) for label in (0, 1))
                made = np.stack([values @ zero, counts @ zero, values @ one, counts @ one, there @ (g >= 0).T.astype(np.float64)], 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kb * keys + held.astype(np.int64)), *(pa.array([v] * len(held), pa.int64()) for v in (sb, st)), pa.array([r.tobytes() for r in made], pa.binary())], names=["kid", "sb", "st", "data"]
                )


def _added_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a key's products over all ranges of subjects, which come one after the other: its observed difference, and
    of a range of simulations how many there are and how many differ as much.
    """

    def told(place: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        s0, n0, s1, n1, there = total.reshape(5, -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = s0 / n0 - s1 / n1
        hits = int((np.abs(d[1:]) >= np.abs(d[0]) - 1e-12).sum())
        n = int((there[1:] > 0).sum()) + int(place[1] == 0 and there[0] > 0)
        row = (*place, None if np.isnan(d[0]) else float(d[0]), hits, n)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["kid", "sb", "diff", "hits", "n"])

    now, total = None, None
    for batch in batches:
        for kid, sb, data in zip(*(batch.column(c) for c in (0, 1, 3))):
            place, part = (kid.as_py(), sb.as_py()), np.frombuffer(data.as_buffer(), np.float64)
            if place != now and now is not None:
                yield told(now, total)
            now, total = place, (total + part if place == now else part)
    if now is not None:
        yield told(now, total)
