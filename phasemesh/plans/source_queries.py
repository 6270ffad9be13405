"""Queries on readers: files are written from the tables first, into the run's scratch folder, and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import motion
from ..scratch import Scratch
from ..sources import binary, text, tiles
from . import inputs
from .inputs import CELLS, FD, RP

PARAMS = ["p1", "p2", "p3", "p4", "p5", "p6"]


def _session(column: str = "session_id"):
    """The number in a folder's name."""
    return F.regexp_extract(column, r"(\d+)$", 1).cast("long").alias("session_id")


def motion_files(spark: SparkSession, d: str) -> DataFrame:
    """Motion parameters of all suppliers from both kinds of text files, one folder for each session."""
    numbers = F.concat_ws("   ", *[F.format_string("% .6f", F.col(p)) for p in PARAMS])
    m = inputs.motion(spark, d).select("session_id", "t", numbers.alias("numbers"))
    told = m.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", "numbers"))).alias("a"))  # a file is read whole, too

    def file(kind: str, line) -> Column:
        content = F.concat(F.array_join(F.transform("a", line), "\n"), F.lit("\n")).cast("binary")
        return F.struct(F.concat(F.lit(f"{kind}/session_id="), F.col("session_id").cast("string"), F.lit(f"/{kind}.txt")).alias("path"), content.alias("content"))

    plain = file("rp", lambda x: F.concat(F.lit("  "), x["numbers"]))
    counted = file("mcdat", lambda x: F.concat(F.lit("\t"), x["t"].cast("string"), F.lit(" \t"), x["numbers"], F.lit(" ")))
    with Scratch(spark, "motion-files") as tmp:
        path = tmp.place("motion")
        binary.write_files(told.select(F.explode(F.array(plain, counted)).alias("f")).select("f.*"), path)
        read = text.read_realignment(spark, f"{path}/rp", "*.txt").withColumn("kind", F.lit("rp"))
        read = read.unionByName(text.read_mcdat(spark, f"{path}/mcdat", "*.txt").withColumn("kind", F.lit("mcdat")))
        return tmp.result(read.select("kind", _session(), F.col("t").cast("long").alias("t"), *PARAMS))


def displacement_files(spark: SparkSession, d: str) -> DataFrame:
    """Displacement series written with a header line and six decimals, read back, with the number of files found."""
    fd = motion.framewise_displacement(inputs.motion(spark, d))
    with Scratch(spark, "displacement-files") as tmp:
        path = tmp.place("fd")
        text.write_series(fd, path)
        files = text.find_files(spark, path, "*.txt", r"session_id=\d+$").groupBy("session_id").agg(F.count("*").alias("files"))
        read = text.read_series(spark, path, "*.txt").join(files, "session_id")
        return tmp.result(read.select(_session(), F.col("t").cast("long").alias("t"), "fd", "files"))


def visit_export(spark: SparkSession, d: str) -> DataFrame:
    """A ``;`` export whose header has a name twice; renamed, written as a table with a header, and read again."""
    c = inputs.table(spark, d, "customer")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_mktsegment", F.concat(F.col("c_name"), F.lit(" x")))
    with Scratch(spark, "visit-export") as tmp:
        path, out = tmp.place("export"), tmp.place("table")
        lines = c.select(line.alias("value")).withColumn("part", F.spark_partition_id())
        top = lines.select("part").distinct().select(F.lit("Id;Series;Series").alias("value"), "part").withColumn("first", F.lit(0))
        both = lines.withColumn("first", F.lit(1)).unionByName(top).repartition("part").sortWithinPartitions("part", "first")
        both.select("value", "part").write.partitionBy("part").text(path)
        visits = text.read_visits(spark, f"{path}/*", {"Id": "id", "Series.1": "series", "Series": "site"}, ["Id", "Series", "Series.1"])
        text.write_table(visits, out)
        return tmp.result(spark.read.csv(out, header=True, schema="id long, series string, site string"))


def _images(spark, d, shape: tuple[int, int, int], first: int, name: str) -> DataFrame:
    """One image file for each label: components of its embeddings from ``first`` on as voxels, embeddings as frames."""
    e = inputs.table(spark, d, "embeddings").where("label is not null").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    size = int(np.prod(shape))
    affine = np.diag([3.0, 3.0, 3.0, 1.0])
    affine[:3, 3] = (-1, -2, -3)

    def make(table):
        import pyarrow as pa

        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        x = np.array(table.column("x").to_pylist())[order][:, first : first + size]
        content = binary.make_nifti(x.T.reshape(*shape, -1, order="F"), affine)
        return pa.table({"path": pa.array([f"label-{table.column('label')[0].as_py()}/{name}"]), "content": pa.array([content], pa.binary())})

    return e.groupBy("label").applyInArrow(make, "path string, content binary")


def surface_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals at the valid vertices of both hemispheres; the others are dropped by the decoder."""
    with Scratch(spark, "surface-signals") as tmp:
        path = tmp.place("surf")
        for first, hemi in ((0, "lh"), (32, "rh")):
            binary.write_files(_images(spark, d, (32, 1, 1), first, f"{hemi}.signal.nii"), path)
        hemis = F.explode(F.array(F.lit("lh"), F.lit("rh"))).alias("hemi")
        valid = spark.range(32).where("id % 3 <> 0").select(hemis, F.col("id").cast("int").alias("vertex"))
        read = binary.read_surface_signal(spark, path, vertices=valid)
        return tmp.result(read.select(_session(), "hemi", "vertex", F.posexplode("y").alias("t", "y")))


def volumes(spark: SparkSession, d: str) -> DataFrame:
    """Voxels of 4-D images and where the affine puts them."""
    with Scratch(spark, "volumes") as tmp:
        path = tmp.place("func")
        binary.write_files(_images(spark, d, (4, 4, 4), 0, "func.nii"), path)
        a = F.col("affine")
        place = [(a[4 * r] * F.col("i") + a[4 * r + 1] * F.col("j") + a[4 * r + 2] * F.col("k") + a[4 * r + 3]).alias(c) for r, c in enumerate("xyz")]
        read = binary.read_volume(spark, path)
        return tmp.result(read.select(_session(), "i", "j", "k", *place, F.posexplode("y").alias("t", "v")))


def surface_files(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of every supplier's surface file, with the label of their first vertex in its annotation file."""
    li = inputs.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_partkey").cast("long").alias("p"))
    names = {1 + k: f"region {k}" for k in range(8)}

    def make(table):
        import pyarrow as pa

        parts = np.unique(table.column("p").to_numpy())
        a = np.searchsorted(parts, table.column("p").to_numpy())
        b, c = (a + 1) % len(parts), table.column("l_linenumber").to_numpy() % len(parts)
        key = table.column("l_suppkey")[0].as_py()
        points = np.stack([parts, parts * 0, parts * 0 + 1], 1)
        files = {"lh.white": binary.make_surface(points, np.stack([a, b, c], 1)), "lh.aparc.annot": binary.make_annot(1 + parts % 10, names)}
        return pa.table({"path": pa.array([f"supplier-{key}/{n}" for n in files]), "content": pa.array(list(files.values()), pa.binary())})

    with Scratch(spark, "surface-files") as tmp:
        path = tmp.place("surf")
        binary.write_files(li.groupBy("l_suppkey").applyInArrow(make, "path string, content binary"), path)
        labels = binary.read_annotation(spark, path).groupBy("label").agg(F.count("*").alias("n"))
        faces = binary.read_faces(spark, path, "*.white").groupBy("a").agg(F.count("*").alias("n"))
        points = binary.read_vertices(spark, path, "*.white").groupBy(F.col("x").cast("long").alias("x")).agg(F.count("*").alias("n"))
        out = labels.select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
        for kind, df, name in (("first", faces, "a"), ("point", points, "x")):
            out = out.unionByName(df.select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), "n"))
        return tmp.result(out)


def config_variants(spark: SparkSession, d: str) -> DataFrame:
    """A configuration file is written whose runs are the first words of parts' types and whose variants are the brands that
    parts of such types have; every part then looks up its place among the variants of its run.
    """
    parts = inputs.table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("run"), "p_brand")
    runs = parts.groupBy("run").agg(F.sort_array(F.collect_set("p_brand")).alias("brands"))  # words and brands are few
    lines = F.concat(F.lit("  "), "run", F.lit(": ["), F.array_join("brands", ", "), F.lit("]"))
    whole = runs.where("run <> 'ECONOMY'").agg(F.concat(F.lit("runs:\n"), F.array_join(F.sort_array(F.collect_list(lines)), "\n"), F.lit("\n")).alias("text"))
    with Scratch(spark, "config") as tmp:
        place = tmp.place("config")
        binary.write_files(whole.select(F.lit("c.yaml").alias("path"), F.col("text").cast("binary").alias("content")), place)
        config = text.read_config(f"{place}/c.yaml")
    names = [r[0] for r in runs.select("run").collect()]
    known = spark.createDataFrame([(run, text.variants(config, run)) for run in names], "run string, variants array<string>")
    at = F.array_position("variants", F.col("p_brand"))
    return parts.join(F.broadcast(known), "run").select("p_partkey", "run", F.when(at > 0, at).alias("k"), F.size("variants").cast("long").alias("n_variants"))


_VARIANTS = """WITH p AS (SELECT p_partkey, split_part(p_type, ' ', 1) run, p_brand FROM part)
, v AS (SELECT run, p_brand, row_number() OVER (PARTITION BY run ORDER BY p_brand) k, count(*) OVER (PARTITION BY run) n FROM (SELECT DISTINCT run, p_brand FROM p WHERE run <> 'ECONOMY'))
SELECT p_partkey, p.run, CAST(k AS BIGINT) k, CAST(coalesce(n, 0) AS BIGINT) n_variants FROM p LEFT JOIN v ON v.run = p.run AND v.p_brand = p.p_brand"""


def stage_table(spark: SparkSession, d: str) -> DataFrame:
    """A stage's table written once, by market segment, and found again."""
    c = inputs.table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    with Scratch(spark, "stages") as tmp:
        path = tmp.place("stage")
        text.save_stage(c, path, "c_mktsegment")
        again = text.save_stage(c, path, "c_mktsegment")
        return tmp.result(again.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")))


def set_members(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the sessions that a named set holds: a semi-join, so a member listed twice counts once."""
    from .motion_queries import sessions

    s = sessions(spark, d, keys.padded("c_custkey")).where("grp = 'c' and visit = 1").select(F.regexp_extract("session_id", r"^ESO_[CP]0*(\d+)_", 1).cast("long").alias("o_custkey"))
    members = s.unionByName(s)
    kept = inputs.table(spark, d, "orders").join(members, "o_custkey", "left_semi")
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


_IMAGES = """e AS (SELECT label, embedding x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 t FROM embeddings WHERE label IS NOT NULL)
, c AS (SELECT label, t, p, CAST(x[p + 1] AS DOUBLE) v FROM (SELECT label, x, t, unnest(generate_series(0, 63)) p FROM e))"""

def tile_window(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings stored as tiles of 64 x 10, one tile replaced, and a window of them read."""
    with Scratch(spark, "tile-window") as tmp:
        t = tiles.write(inputs.obs(spark, d), tmp.place("matrix"), ["t"], 64, 10)
        old = t.window((64, 128), (20, 30))
        double = F.transform("re", lambda v: v * 2).alias("re")
        t.replace(64, 20, old.select((F.col("row") - 64).alias("row"), double, F.transform("im", lambda v: -v).alias("im")))
        found = t.window((50, 140), (15, 27)).select("row", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
        return tmp.result(found.select("row", (F.col("k") + 15).alias("col"), F.round("z.re", 8).alias("re"), F.round("z.im", 8).alias("im")))


_TILES = f"""WITH {CELLS}
, n AS (SELECT vec_id t, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings)
, w AS (SELECT i, v, re, im, i BETWEEN 64 AND 127 AND v BETWEEN 20 AND 29 AS changed FROM c JOIN n ON n.t = c.t WHERE i BETWEEN 50 AND 139 AND v BETWEEN 15 AND 26)
SELECT i AS "row", v AS col, round(CASE WHEN changed THEN re * 2 ELSE re END, 8) + 0.0 re, round(CASE WHEN changed THEN -im ELSE im END, 8) + 0.0 im FROM w"""

QUERIES = {
    "tile_window": (tile_window, _TILES),
    "motion_files": (
        motion_files,
        f"""WITH {RP}
, k AS (SELECT unnest(['rp', 'mcdat']) kind)
SELECT kind, s session_id, t - 1 t, {', '.join(f'round({p}, 6) + 0.0 {p}' for p in PARAMS)} FROM rp, k""",
    ),
    "displacement_files": (
        displacement_files,
        f"""WITH {FD}
SELECT s session_id, row_number() OVER (PARTITION BY s ORDER BY t) t, round(fd, 6) + 0.0 fd, CAST(1 AS BIGINT) files FROM fd WHERE fd IS NOT NULL""",
    ),
    "visit_export": (visit_export, "SELECT c_custkey id, c_name || ' x' series, c_mktsegment site FROM customer"),
    "surface_signals": (
        surface_signals,
        f"""WITH {_IMAGES}
SELECT CAST(label AS BIGINT) session_id, CASE WHEN p < 32 THEN 'lh' ELSE 'rh' END hemi, CAST(p % 32 AS INTEGER) vertex, CAST(t AS INTEGER) t, v y
FROM c WHERE p % 32 % 3 <> 0""",
    ),
    "volumes": (
        volumes,
        f"""WITH {_IMAGES}, g AS (SELECT label, t, v, CAST(p % 4 AS INTEGER) i, CAST(p // 4 % 4 AS INTEGER) j, CAST(p // 16 AS INTEGER) k FROM c)
SELECT CAST(label AS BIGINT) session_id, i, j, k, CAST(3 * i - 1 AS DOUBLE) x, CAST(3 * j - 2 AS DOUBLE) y, CAST(3 * k - 3 AS DOUBLE) z, CAST(t AS INTEGER) t, v FROM g""",
    ),
    "surface_files": (
        surface_files,
        """WITH p AS (SELECT l_suppkey s, l_partkey p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 a FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))
SELECT 'label' kind, CASE WHEN p % 10 < 8 THEN 'region ' || (p % 10) ELSE 'unknown' END AS name, count(*) n FROM p GROUP BY 2
UNION ALL SELECT 'first', CAST(a AS VARCHAR), count(*) FROM lineitem JOIN p ON s = l_suppkey AND p = l_partkey GROUP BY a
UNION ALL SELECT 'point', CAST(p AS VARCHAR), count(*) FROM p GROUP BY p""",
    ),
    "config_variants": (config_variants, _VARIANTS),
    "stage_table": (stage_table, "SELECT c_mktsegment, count(*) n, round(sum(c_acctbal), 2) balance FROM customer GROUP BY c_mktsegment"),
    "set_members": (
        set_members,
        """SELECT o_custkey, count(*) n, max(o_orderkey) "last" FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 + 1 = 1 AND NOT regexp_matches(format('{:05d}', c_custkey), '0013|0027'))
GROUP BY o_custkey""",
    ),
}
