"""Tests, permutations, clusters and samples against small known cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemesh.functions import special
from phasemesh import scratch
from phasemesh.operators import encode, evar, graph, mesh, ordered, stats
from phasemesh.plans import catalog


def test_t_distribution():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert special.t_two_sided(1.0, 1) == pytest.approx(0.5)


def test_erfc():
    x = np.concatenate([np.linspace(-6, 6, 997), [0.0, 2.5, 10.0, 30.0]])
    assert np.allclose(special.erfc(x), [math.erfc(v) for v in x], rtol=1e-12, atol=1e-300)
    assert math.isnan(special.erfc(math.nan))


def test_signed_rank_is_exact_for_few_differences():
    for n in (1, 3, 6):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for v in range(n * (n + 1) // 2 + 1):
            tail = min(sum(x <= v for x in sums), sum(x >= v for x in sums)) / len(sums)
            assert special.signed_rank_two_sided(v, n)[0] == pytest.approx(min(1.0, 2 * tail))
    for ties, zeros in ((6.0, 0), (0.0, 1)):  # then the normal distribution is taken
        z = (abs(5 - 3 * 4 / 4) - 0.5) / math.sqrt(3 * 4 * 7 / 24 - ties / 48)
        assert special.signed_rank_two_sided(5.0, 3, ties, zeros)[0] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert special.rank_sum_two_sided([3.0, math.nan], [3, 3], [3, 3])[0] == pytest.approx(0.7)


@pytest.mark.parametrize("m,n", [(2, 3), (4, 4), (1, 5)])
def test_rank_sum_counts(m, n):
    want = np.zeros(m * n + 1)
    for c in itertools.combinations(range(1, m + n + 1), m):
        want[sum(c) - m * (m + 1) // 2] += 1
    assert special.rank_sum_counts(m, n).tolist() == want.tolist()


def test_rank_sum(spark):
    x = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 1, 3.0), (0, 1, 4.0), (0, 1, 5.0)], "vertex int, g int, value double")
    r = stats.rank_sum(x, "vertex").first()
    assert (r.w, r.p) == (0.0, pytest.approx(0.2))
    more = x.union(spark.createDataFrame([(0, None, 2.5), (0, 7, 0.5), (0, 1, None)], "vertex int, g int, value double"))
    assert stats.rank_sum(more, "vertex").first() == r


def test_signed_rank_and_paired_t(spark):
    p = spark.createDataFrame([(0, 3.0, 1.0), (0, 5.0, 2.0), (0, 1.0, 2.0), (0, 4.0, 4.0)], "vertex int, v1 double, v2 double")
    r = stats.signed_rank(p, "vertex").first()
    assert (r.v, r.n, r.ties, r.zeros) == (5.0, 3, 0.0, 1)
    r = stats.signed_rank(p.where("v1 <> v2").union(spark.createDataFrame([(0, None, 1.0)], p.schema)), "vertex").first()
    assert (r.v, r.n, r.zeros, r.p) == (5.0, 3, 0, pytest.approx(0.5))
    d = np.array([2.0, 3.0, -1.0, 0.0])
    assert stats.paired_t(p, "vertex").first().t == pytest.approx(d.mean() / (d.std(ddof=1) / 2))


def test_permutation_keeps_subjects_together(spark):
    subjects = spark.createDataFrame([(i, i % 2) for i in range(6)], "subject long, g int")
    labels = stats.permuted_labels(subjects, 5).collect()
    for sim in range(6):
        here = [r for r in labels if r.sim == sim]
        assert len({r.subject for r in here}) == 6 and sum(r.g for r in here) == 3
    assert all(r.g == r.subject % 2 for r in labels if r.sim == 0)


def test_every_shuffle_is_another(spark):
    subjects = spark.createDataFrame([(f"s{i}", i % 2) for i in range(150)], "subject string, g int")
    rows = stats.permuted_labels(subjects, 999).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.sim, {})[r.subject] = r.g
    assert len(by) == 1000 and len({tuple(sorted(v.items())) for v in by.values()}) == 1000
    assert all(sum(v.values()) == 75 for v in by.values())
    means = np.array([[by[s][f"s{i}"] for i in range(150)] for s in range(1, 1000)]).mean(0)
    assert abs(means - 0.5).max() < 0.08  # each subject gets either label about as often: 5 standard errors
    other = {(r.sim, r.subject): r.g for r in stats.permuted_labels(subjects, 3, seed=1).collect()}
    assert any(other[2, f"s{i}"] != by[2][f"s{i}"] for i in range(150))


def test_odd_subjects(spark):
    odd = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", None), ("c", 1)], "subject string, g int")
    assert {(r.subject, r.g) for r in stats.permuted_labels(odd, 2).where("sim = 0").collect()} == {("a", 0), ("c", 1)}
    assert stats.permuted_labels(odd.limit(0), 2).count() == 0


@pytest.fixture(scope="module")
def noise(spark):
    """400 vertices without any effect, 40 subjects of one to three sessions."""
    rng = np.random.default_rng(3)
    rows = [(v, f"p{s}", s % 2, float(x)) for s in range(40) for k in range(s % 3 + 1) for v, x in enumerate(rng.normal(size=400))]
    return spark.createDataFrame(rows, "vertex int, subject string, g int, value double").cache()


def test_matrix_and_join_give_the_same_p(noise, monkeypatch):
    x = noise.where("vertex < 20 and not (vertex = 3 and subject = 'p4')")
    labels = stats.permuted_labels(noise.select("subject", "g"), 50)
    fast = {r.vertex: (r.diff, r.p) for r in stats.permutation_p(x, labels, "vertex").collect()}
    monkeypatch.setattr(stats, "MATRIX_CELLS", 10)
    slow = {r.vertex: (r.diff, r.p) for r in stats.permutation_p(x, labels, "vertex").collect()}
    one_row_each = stats.shuffles(noise.select("subject", "g"), 50)
    assert {r.vertex: (r.diff, r.p) for r in stats.permutation_p(x, one_row_each, "vertex").collect()} == slow
    monkeypatch.setattr(stats, "MATRIX_CELLS", 100_000)
    assert {r.vertex: (r.diff, r.p) for r in stats.permutation_p(x, one_row_each, "vertex").collect()} == fast
    monkeypatch.setattr(stats, "MATRIX_CELLS", 10)
    assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k]) for k in slow)


@pytest.mark.parametrize("name", ["perm_p", "perm_p_paired"])
def test_permutations_beyond_the_limit_equal_sql(spark, tiny, same_as_sql, monkeypatch, name):
    """Labels that are too many for one matrix are no rows that a join sends to the driver."""
    monkeypatch.setattr(stats, "MATRIX_CELLS", 10)
    plans = []

    def query(spark, d):
        found = catalog.QUERIES[name](spark, d)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    same_as_sql(query, catalog.ORACLES[name])
    assert not any(word in plans[0] for word in ("Broadcast", "explode"))


def test_permutations_of_uneven_labels(spark, monkeypatch):
    """A simulation without a subject's label leaves the subject out, and one without any of a key's subjects does not count."""
    x = spark.createDataFrame([(0, "a", 1.0), (0, "b", 4.0), (0, "c", 2.0), (1, "a", 3.0), (1, "b", None)], "vertex int, subject string, value double")
    rows = [(0, "a", 0), (0, "b", 1), (0, "c", 0), (1, "a", 1), (1, "b", 0), (2, "c", 1), (2, "b", 0), (3, "c", 0), (3, "z", 1)]
    labels = spark.createDataFrame(rows, "sim int, subject string, g int")
    monkeypatch.setattr(stats, "MATRIX_CELLS", 5)
    for tile in ((256, 4096, 256), (1, 2, 2)):
        monkeypatch.setattr(stats, "TILE", tile)
        found = {r.vertex: (r.diff, r.p) for r in stats.permutation_p(x, labels, "vertex").collect()}
        assert found == {0: (-2.5, 0.5), 1: (None, pytest.approx(1 / 3))}


@pytest.mark.parametrize("tile", [(256, 4096, 256), (7, 5, 3), (1, 100, 2)])
def test_tiled_labels_give_the_same(spark, noise, monkeypatch, tile):
    """Above the limit labels are cut into tiles: the same keys and simulations, with ties, missing values and null keys."""
    x = noise.where("vertex < 30 and not (vertex = 3 and subject = 'p4')").selectExpr("nullif(vertex, 0) vertex", "vertex % 2 side", "subject", "round(value, 1) value")
    labels = stats.permuted_labels(noise.select("subject", "g"), 20)
    want = sorted(map(str, stats.significant(x, labels, 0.1, "side", "vertex").collect()))
    assert len(want) > 20
    monkeypatch.setattr(stats, "MATRIX_CELLS", 100)
    monkeypatch.setattr(stats, "TILE", tile)
    assert sorted(map(str, stats.significant(x, labels, 0.1, "side", "vertex").select("side", "vertex", "sim").collect())) == want
    one_row_each = stats.shuffles(noise.select("subject", "g"), 20)
    assert sorted(map(str, stats.significant(x, one_row_each, 0.1, "side", "vertex").collect())) == want
    with pytest.raises(ValueError):
        stats.significant(x, labels.limit(0), 0.05, "vertex")


def test_p_is_uniform_without_effect(noise):
    p = np.array([r.p for r in stats.permutation_p(noise, stats.permuted_labels(noise.select("subject", "g"), 199), "vertex").collect()])
    for level in (0.05, 0.25, 0.5, 0.75):
        assert abs((p <= level).mean() - level) < 4 * math.sqrt(level * (1 - level) / len(p))


def test_significant_equals_a_test_of_each_relabelling(spark, noise):
    labels = stats.permuted_labels(noise.select("subject", "g"), 4)
    got = {(r.vertex, r.sim) for r in stats.significant(noise, labels, 0.05, "vertex").collect()}
    each = noise.drop("g").join(labels, "subject")
    want = {(r.vertex, r.sim) for r in stats.rank_sum(each, "vertex", "sim").where("p < 0.05").collect()}
    assert got == want and 0.01 < len(got) / 2000 < 0.12
    few = noise.where("subject in ('p1', 'p2', 'p3', 'p4', 'p5', 'p6', 'p7', 'p8')")  # exact distributions
    got = {(r.vertex, r.sim) for r in stats.significant(few, labels, 0.1, "vertex").collect()}
    assert got == {(r.vertex, r.sim) for r in stats.rank_sum(few.drop("g").join(labels, "subject"), "vertex", "sim").where("p < 0.1").collect()}


def test_cluster_test(spark, noise):
    faces = spark.createDataFrame([(h, 20 * r + c + 200 * i, 20 * r + c + 1 + 200 * i, 20 * (r + 1) + c + 200 * i) for i, h in enumerate(("lh", "rh")) for r in range(9) for c in range(19)], "hemi string, a int, b int, c int")
    planted = F.when((F.col("g") == 1) & (F.col("vertex") % 20 < 4) & (F.col("vertex") < 80), 2.5).otherwise(0.0)
    x = noise.withColumn("hemi", F.when(F.col("vertex") < 200, "lh").otherwise("rh")).withColumn("value", F.col("value") + planted)
    observed, null = mesh.cluster_test(x, mesh.neighbours(faces, "hemi"), x.select("subject", "g"), 60, 0.005, 5, ("hemi",))
    seen, sizes = observed.collect(), [r.max_size for r in null.orderBy("sim").collect()]
    assert [(r.hemi, r.size >= 14) for r in seen] == [("lh", True)]
    assert len(sizes) == 60 and min(sizes) == 0  # simulations without a cluster count
    report = mesh.report(observed, null, "hemi").collect()
    assert [(r.hemi, r.n_clusters, r.n_over) for r in report] == [("lh", 1, 1)]


@pytest.mark.parametrize("local", [1_000_000, 3, 0])
def test_components_of_groups(spark, local):
    rng = np.random.default_rng(1)
    rows = [(h, int(a), int(b)) for h in "xy" for a, b in rng.integers(0, 60, (45, 2))] + [("x", None, 1), (None, 1, 2), ("x", 1, 1)]
    got = {(r.h, r.node): r.component for r in graph.components(spark.createDataFrame(rows, "h string, a long, b long"), "h", local=local).collect()}
    want: dict = {}
    for h in "xy":
        root = {v: v for v in range(60)}
        for _ in range(60):
            for k, a, b in rows:
                if k == h and a is not None:
                    root[a] = root[b] = min(root[a], root[b])
        want |= {(h, v): r for v, r in root.items() if r != v}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a string, b string"), local=local).count() == 0
    assert graph.components(spark.createDataFrame([("b", "c"), ("a", "c")], "a string, b string")).orderBy("node").collect() == [("b", "a"), ("c", "a")]


def test_scratch_is_left_clean(spark, tmp_path, monkeypatch):
    class Elsewhere:  # a session on a cluster, without a shared folder
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Elsewhere.conf)

    with pytest.raises(ValueError):
        scratch.root(Elsewhere)
    monkeypatch.setattr(scratch, "root", lambda spark: f"file://{tmp_path}")
    links = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graph.components(links, local=100)
    assert found.count() == 2000 and ["result" in p.name for p in tmp_path.iterdir()] == [True]
    scratch.delete_result(found)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize(
    "said, default, master, want",
    [
        ("/shared/x/", "hdfs://store:8020", "yarn", "hdfs://store:8020/shared/x"),
        ("/shared/x", "file:///", "yarn", None),
        ("/shared/x", "file:///", "local[4]", "file:///shared/x"),
        ("file:/shared/x", "hdfs://store:8020", "spark://host:7077", "file:///shared/x"),
        ("file:///shared/x/", "file:///", "local-cluster[2,1,1024]", "file:///shared/x"),
        ("hdfs://store/x", "file:///", "yarn", "hdfs://store/x"),
    ],
)
def test_shared_folder(spark, said, default, master, want):
    """Paths without a scheme belong to the default file system; a machine's own disk is refused on a cluster."""

    class Path:
        def __init__(self, path):
            self.path = path

        def getFileSystem(self, conf):
            return self

        def makeQualified(self, path):
            made = spark._jvm.org.apache.hadoop.fs.Path(path.path)
            return made.makeQualified(spark._jvm.java.net.URI(default), spark._jvm.org.apache.hadoop.fs.Path("/"))

    class Session:
        class conf:
            get = staticmethod(lambda *_: said)

        class sparkContext:
            pass

        class _jvm:
            class org:
                class apache:
                    class hadoop:
                        class fs:
                            pass

        _jsc = spark._jsc

    Session.sparkContext.master = master
    Session._jvm.org.apache.hadoop.fs.Path = Path
    if want is None:
        with pytest.raises(ValueError):
            scratch.root(Session)
    else:
        assert scratch.root(Session) == want


def test_shared_folder_of_a_cluster_is_tried(spark, tmp_path, monkeypatch):
    """A plain path that all machines mount is taken on a cluster, also below the warehouse; one where rows are lost raises."""

    class Session:
        def __init__(self, **said):
            self.conf = self
            self.get = lambda name, default=None: said.get(name.split(".")[-2])
            self.sparkContext = self
            self.getConf = lambda: self
            self.master, self.applicationId, self.defaultParallelism = "spark://host:7077", str(tmp_path), 4
            self.range, self._jvm, self._jsc = spark.range, spark._jvm, spark._jsc

    assert scratch.root(Session(checkpoint=f"{tmp_path}/shared")) == f"file://{tmp_path}/shared"
    assert scratch.root(Session(warehouse=f"file:{tmp_path}/house")) == f"file://{tmp_path}/house/checkpoints"
    assert not [p for p in tmp_path.rglob("tried-*") if p.is_dir()]
    (tmp_path / "file").write_text("")
    with pytest.raises(ValueError, match="cannot share"):
        scratch.root(Session(checkpoint=f"{tmp_path}/file"))
    monkeypatch.setattr(scratch, "save", lambda df, path: df.limit(1))
    assert scratch.root(Session(checkpoint=f"{tmp_path}/shared")) == f"file://{tmp_path}/shared"  # tried once
    with pytest.raises(ValueError, match="own disk"):
        scratch.root(Session(checkpoint=f"{tmp_path}/own"))


def ring(n=12):
    return [("lh", i, (i + 1) % n, n + i) for i in range(n)] + [("lh", n + i, n + (i + 1) % n, (i + 1) % n) for i in range(n)]


def test_pairs_do_not_depend_on_where_rows_lie(spark, tmp_path):
    """Values that give 0 added in order of events, and 3 in the order of the second file."""
    import datetime

    from phasemesh.plans import stats_queries

    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, day(3), 7, "view", 1e17), (2, day(4), 7, "view", 3.0), (3, day(5), 7, "view", -1e17), (4, day(6), 7, "view", None), (5, day(20), 7, "view", 2.5)]
    for name, order in (("a", (0, 1, 2, 3, 4)), ("b", (0, 2, 4, 3, 1))):
        df = spark.createDataFrame([rows[i] for i in order], "event_id long, ts timestamp, user_id long, event_type string, value double")
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        assert [tuple(r) for r in stats_queries._pairs(spark, f"{tmp_path}/{name}").collect()] == [(7, "view", 0.0, 2.0)]


def test_neighbors_of_keys_that_meet(spark, tmp_path):
    """Orders over 1,000,000, and parts over 1,000,000, share numbers with parts and suppliers; the rows are those of the SQL."""
    import duckdb

    from phasemesh.plans import stats_queries

    lines = [(5, 1, 2, 3.0), (1_000_007, 7, 2, 1.0), (8, 1_000_004, 4, 2.0), (2_000_009, 3, 9, 4.0), (2_000_006, 1_000_006, 6, 5.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    query, sql = stats_queries.QUERIES["neighbors"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = {tuple(r) for r in query(spark, str(tmp_path)).select("src", "n", "least", "most").collect()}
    assert got == set(con.execute(f"SELECT src, n, least, most FROM ({sql})").fetchall())
    assert {(2_000_006, 1, 2_000_006, 2_000_006), (2_000_004, 2, 8, 2_000_004)} <= got


def test_neighbors_of_missing_keys(spark, tmp_path):
    """A missing key is a vertex that is counted like any other, as in the SQL; it is neither the least nor the most."""
    import duckdb

    from phasemesh.plans import stats_queries

    lines = [(5, None, 2, 3.0), (None, 7, 2, 1.0), (5, 1, None, 2.0), (None, None, None, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    query, sql = stats_queries.QUERIES["neighbors"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = {tuple(r) for r in query(spark, str(tmp_path)).select("src", "n", "least", "most").collect()}
    assert got == set(con.execute(f"SELECT src, n, least, most FROM ({sql})").fetchall())
    assert {(5, 3, 1_000_001, 2_000_002), (None, 5, 5, 2_000_002)} <= got


def test_triangle_with_a_vertex_twice(spark):
    edges = mesh.neighbours(spark.createDataFrame([(1, 1, 2), (2, 3, 4)], "a int, b int, c int"))
    assert {(r.src, r.dst) for r in edges.where("src < 3").collect()} == {(1, 1), (1, 2), (2, 1), (2, 3), (2, 4)}
    assert {r.vertex: r.neighbours for r in mesh.neighbour_lists(edges).collect()}[1] == [1, 2]
    found = mesh.components(spark.createDataFrame([(1,), (2,), (4,)], "vertex int"), edges)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (2, 1), (4, 1)]


def test_clusters_on_a_ring(spark):
    faces = spark.createDataFrame(ring(), "hemi string, a int, b int, c int")
    edges = mesh.neighbours(faces)
    sig = spark.createDataFrame([(v,) for v in (0, 1, 2, 6, 7, 10)], "vertex int")
    got = {(r.component, r.size) for r in mesh.clusters(sig, edges).collect()}
    assert got == {(0, 3), (6, 2), (10, 1)}
    assert mesh.clusters(sig.where("vertex < 0"), edges).count() == 0
    null = mesh.largest_by_sim(spark.createDataFrame([(0, 4)], "sim int, size long"), spark.createDataFrame([(0,), (1,)], "sim int"))
    assert sorted(tuple(r) for r in null.collect()) == [(0, 4), (1, 0)]


def test_long_chain_of_components(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a"))
    got = mesh.components(spark.range(301).withColumnRenamed("id", "vertex"), both).select("component").distinct().collect()
    assert [r.component for r in got] == [0]


def test_combinations():
    items = list(range(7))
    every = ordered.combinations(items, 3)
    assert every == list(itertools.combinations(items, 3))
    some = ordered.combinations(items, 3, 10, 1)
    assert len(set(some)) == 10 and set(some) <= set(every)
    assert ordered.combinations(list(range(200)), 5, 3) and math.comb(200, 5) > 10**9


def test_exact_sample(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert ordered.exact_sample(df, "id", 17, 1).count() == 17
    assert {r["count"] for r in ordered.exact_sample(df, "id", 5, 1, "g").groupBy("g").count().collect()} == {5}


def test_best_run_ties_and_colours(spark):
    r2 = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.5), (0, 1, 0.1), (1, 1, 0.2)], "run int, pc int, r2 double")
    assert sorted((r.pc, r.run) for r in evar.best_run(r2).collect()) == [(0, 0), (1, 1)]
    v = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "v double")
    assert [r.colour for r in encode.palette_index(v, "v", 5).collect()] == [1, 3, 5, None]
