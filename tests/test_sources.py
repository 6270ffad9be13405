"""Readers on files made here, and the streaming form of displacement."""

import gzip
import os
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemesh.operators import motion
from phasemesh.sources import binary, files, images, text
from phasemesh.streaming import motion as streaming


@pytest.fixture()
def study(tmp_path):
    rng = np.random.default_rng(0)
    for s in ("ESO_C00001_20200101_1200_1", "ESO_P00002_20200101_1200_1", "other"):
        (tmp_path / s).mkdir()
        rows = rng.standard_normal((5, 7)).round(4)
        (tmp_path / s / "rp_a.txt").write_text("\n".join("  ".join(f"{v: .4f}" for v in r[1:]) for r in rows) + "\n")
        (tmp_path / s / "fmcpr.mcdat").write_text("\n".join("   " + " \t ".join(f"{v:.4f}" for v in r) for r in rows) + "\n\n")
        (tmp_path / s / "fd.txt").write_text("header\n0.5\n0.25\n")
    return str(tmp_path)


def test_text_readers(spark, study):
    rp = text.read_realignment(spark, study, "rp_*.txt")
    mc = text.read_mcdat(spark, study, "*.mcdat")
    key = lambda r: (r.session_id, r.t)
    a, b = sorted(rp.drop("file").collect(), key=key), sorted(mc.drop("file").collect(), key=key)
    assert a == b and len(a) == 15
    assert motion.framewise_displacement(rp).count() == 12
    fd = text.read_series(spark, study, "fd.txt")
    assert sorted((r.t, r.fd) for r in fd.where("session_id = 'other'").collect()) == [(1, 0.5), (2, 0.25)]
    files = text.find_files(spark, study, "rp_*.txt", "^ESO_")
    assert files.count() == 2
    assert text.latest(files).first().file.endswith("ESO_P00002_20200101_1200_1/rp_a.txt")


def test_series_round_trip(spark, study, tmp_path):
    fd = text.read_series(spark, study, "fd.txt").select("session_id", "t", "fd")
    out = str(tmp_path / "out")
    text.write_series(fd, out)
    back = text.read_series(spark, out, "part-*")
    assert back.count() == fd.count() == 6


def test_visits_config_and_stages(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Id;Series;Series\n1;a b;x\n2;c;y\n")
    df = text.read_visits(spark, str(tmp_path / "v.csv"), {"Id": "id", "Series.1": "series"}, ["Id", "Series", "Series.1"])
    assert sorted(tuple(r) for r in df.collect()) == [("1", "x"), ("2", "y")]
    (tmp_path / "c.yaml").write_text("runs:\n  rest: [a, b]\n")
    config = text.read_config(str(tmp_path / "c.yaml"))
    assert text.variants(config, "rest") == ["a", "b"] and text.variants(config, "task") == []
    text.write_table(df, str(tmp_path / "t"))
    stage = text.save_stage(df, str(tmp_path / "s"), "id")
    made = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    assert text.save_stage(df, str(tmp_path / "s"), "id").count() == stage.count() == 2  # found again
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")} == made
    assert text.save_stage(df.withColumn("n", F.lit(1)), str(tmp_path / "s"), "id").columns == ["id", "series", "n"]  # another schema
    assert text.save_stage(df.limit(0), str(tmp_path / "s"), "id", version="2").count() == 0
    (tmp_path / "v2.csv").write_text("Id;Series;Series\n3;a;z\n")
    other = text.read_visits(spark, str(tmp_path / "v2.csv"), {"Id": "id", "Series.1": "series"}, ["Id", "Series", "Series.1"])
    assert text.save_stage(other, str(tmp_path / "s"), "id").first().series == "z"  # another input


def test_images(spark, tmp_path, monkeypatch):
    (tmp_path / "s1").mkdir()
    values = np.arange(24, dtype=float).reshape(2, 1, 3, 4)
    affine = np.array([[3, 0, 0, 1], [0, 3, 0, 2], [0, 0, 3, 3], [0, 0, 0, 1.0]])
    (tmp_path / "s1" / "lh.sig.nii.gz").write_bytes(gzip.compress(binary.make_nifti(values, affine)))
    vol = binary.read_volume(spark, str(tmp_path)).collect()
    assert len(vol) == 6
    for r in vol:
        assert r.y == values[r.i, r.j, r.k].tolist() and r.affine == affine.reshape(-1).tolist()
    sig = binary.read_surface_signal(spark, str(tmp_path)).orderBy("vertex").collect()
    assert [r.hemi for r in sig] == ["lh"] * 6
    assert sig[1].y == values[1, 0, 0].tolist() and sig[2].y == values[0, 0, 1].tolist()
    with pytest.raises(ValueError):
        binary.parse_nifti(b"\0" * 400)
    valid = spark.createDataFrame([("lh", 1), ("lh", 4), ("lh", 99), ("rh", 0)], "hemi string, vertex int")
    for limit in (100, 1):  # in the decoder, and joined after it
        monkeypatch.setattr(binary, "MASKED", limit)
        some = binary.read_surface_signal(spark, str(tmp_path), vertices=valid).orderBy("vertex").collect()
        assert [(r.vertex, r.y) for r in some] == [(r.vertex, r.y) for r in sig if r.vertex in (1, 4)]
    assert binary.read_surface_signal(spark, str(tmp_path), vertices=valid.limit(0)).count() == 0
    points, tri = np.eye(3), np.array([[0, 1, 2], [2, 1, 0]])
    assert [x.tolist() for x in binary.parse_surface(binary.make_surface(points, tri))] == [points.tolist(), tri.tolist()]
    codes, names = binary.parse_annot(binary.make_annot([5, 0, 70_000], {5: "cortex", 70_000: "x y"}))
    assert codes.tolist() == [5, 0, 70_000] and names == {5: "cortex", 70_000: "x y"}


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("voxels", [1, 5, 7, 1000])
def test_slabs(spark, tmp_path, packed, voxels):
    """Slabs smaller than a frame, of scaled integers in either byte order and of doubles, plain and packed."""
    rng = np.random.default_rng(voxels)
    shape, whole = (3, 4, 2, 6), {}
    for name, (order, code, kind, slope) in {"a b": (">", 4, "i2", 0.5), "c": ("<", 512, "u2", 0.0), "d": ("<", 64, "f8", 2.0)}.items():
        values = rng.integers(0, 900, shape).astype(np.dtype(kind).newbyteorder(order))
        data = bytearray(binary.make_nifti(np.zeros(shape), np.eye(4))[:352])
        if order == ">":
            data[0:4], data[40:56] = struct.pack(">i", 348), struct.pack(">8h", 4, *shape, 1, 1, 1)
            data[252:256], data[280:328] = struct.pack(">2h", 0, 1), np.arange(12, dtype=">f4").tobytes()
        struct.pack_into(f"{order}2h", data, 70, code, 8 * values.itemsize)
        struct.pack_into(f"{order}3f", data, 108, 352, slope, 7)
        content = bytes(data) + values.tobytes(order="F")
        (tmp_path / name).mkdir()
        (tmp_path / name / f"lh.f.nii{'.gz' if packed else ''}").write_bytes(gzip.compress(content) if packed else content)
        whole[name] = values * slope + 7.0 if slope else values.astype(float)
    found = images.plan(images.files(spark, str(tmp_path), "*.nii*"), False, voxels * 6 * 8)
    slabs = found.collect()
    assert len(slabs) == 3 * -(-24 // -(-24 // -(-24 // voxels))) and all(r.last - r.first <= voxels for r in slabs) and sum(r.last - r.first for r in slabs) == 72
    rows = images.read(spark, str(tmp_path), "*.nii*", False, slab_bytes=voxels * 6 * 8).collect()
    assert len({(r.session_id, r.i, r.j, r.k) for r in rows}) == len(rows) == 72
    for r in rows:
        assert r.y == whole[r.session_id][r.i, r.j, r.k].tolist()
    assert {tuple(r.affine[:4]) for r in rows if r.session_id == "a b"} == {(0.0, 1.0, 2.0, 3.0)}
    want = spark.sparkContext.broadcast({"lh": np.array([2, 3, 17])})
    some = images.read(spark, str(tmp_path), "*.nii*", True, want, voxels * 6 * 8).where("session_id = 'd'").orderBy("vertex").collect()
    assert [(r.hemi, r.vertex, r.y) for r in some] == [("lh", v, whole["d"].reshape(-1, 6, order="F")[v].tolist()) for v in (2, 3, 17)]


def test_bad_images(spark, tmp_path):
    """A file that is no image, and one that ends too early, are named; a folder without images has no rows."""
    (tmp_path / "none").mkdir()
    assert images.read(spark, str(tmp_path / "none"), "*.nii", False).count() == 0
    (tmp_path / "s").mkdir()
    whole = binary.make_nifti(np.zeros((2, 2, 2, 3)), np.eye(4))
    for bad, said in ((b"\0" * 400, "not a NIfTI-1 file"), (b"\0" * 40, "ends before"), (whole[:-8], "ends before"), (gzip.compress(whole)[:-40], "ends before|Error")):
        (tmp_path / "s" / "x.nii").write_bytes(bad)
        with pytest.raises(Exception, match=said):
            binary.read_volume(spark, str(tmp_path / "s")).count()
    (tmp_path / "s" / "x.nii").write_bytes(binary.make_nifti(np.ones((2, 2, 2)), np.eye(4)))
    assert [r.y for r in binary.read_volume(spark, str(tmp_path / "s")).collect()] == [[1.0]] * 8


def test_surface_and_annotation(spark, tmp_path):
    pts = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], ">f4")
    surf = b"\xff\xff\xfecreated\n\n" + struct.pack(">2i", 3, 1) + pts.tobytes() + np.array([[0, 1, 2]], ">i4").tobytes()
    (tmp_path / "lh.white").write_bytes(surf)
    name = b"cortex\0"
    pair = np.array([[0, 5], [1, 0], [2, 5]], ">i4").tobytes()
    table = struct.pack(">i", 1) + struct.pack(">2i", -2, 1) + struct.pack(">i", 4) + b"tab\0" + struct.pack(">i", 1) + struct.pack(">2i", 0, len(name)) + name + struct.pack(">4i", 5, 0, 0, 0)
    (tmp_path / "lh.aparc.annot").write_bytes(struct.pack(">i", 3) + pair + table)
    assert [tuple(r) for r in binary.read_faces(spark, str(tmp_path), "lh.white").collect()] == [("lh", 0, 1, 2)]
    assert binary.read_vertices(spark, str(tmp_path), "lh.white").count() == 3
    assert [r.label for r in binary.read_annotation(spark, str(tmp_path)).orderBy("vertex").collect()] == ["cortex", "unknown", "cortex"]


def test_streaming_displacement(spark, tmp_path):
    rows = [(s, t, *[float((t * (i + 1)) % 5) for i in range(6)]) for s in ("a", "b") for t in range(8)]
    schema = "session_id string, t long, p1 double, p2 double, p3 double, p4 double, p5 double, p6 double"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k], schema).coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        (file,) = (tmp_path / f"made{k}").glob("*.parquet")
        os.utime(file, (1_600_000_000 + k, 1_600_000_000 + k))  # files come in order of their times
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.framewise_displacement(stream).writeStream.format("memory").queryName("fd").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    got = {(r.session_id, r.t): r.fd for r in spark.table("fd").collect()}
    want = {(r.session_id, r.t): r.fd for r in motion.framewise_displacement(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_files_of_very_many_folders_are_listed_by_tasks(spark, tmp_path):
    """The same files as Spark's reader lists, and no list of them in the plan; unpacked, hidden ones left out."""
    for i in range(40):
        for name in (f"a/s{i}/rp x.txt", f"a/_not/s{i}/rp.txt", f"a/s{i}/.rp.txt", f"_k=1/s{i}/deep/rp.txt", f"s{i}.txt"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(f"\n  {i} 1 2 3\t4 5 \r\n\n{i + 1}\n")
    (tmp_path / "a" / "rp.txt.gz").write_bytes(gzip.compress(b"7 8"))
    (tmp_path / "a" / "empty.txt").write_text("")
    for pattern in ("*.txt", "{rp,s1}*.t?t", "*.gz"):
        found = files.listed(spark, str(tmp_path), pattern)
        want = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(str(tmp_path)).where("length > 0")
        assert sorted(r.path.replace("file:///", "file:/") for r in found.collect()) == sorted(r.path for r in want.collect())
    lines = text.read_realignment(spark, str(tmp_path), "rp*")
    assert lines.inputFiles() == []  # each file was held by the driver
    got = Counter((r.session_id, r.t, r.p1, r.p6) for r in lines.collect())
    assert got == Counter([(s, t, float(i + t), None if t else 5.0) for i in range(40) for s in (f"s{i}", "deep") for t in (0, 1)] + [("a", 0, 7.0, None)])
    assert files.listed(spark, str(tmp_path / "s1.txt"), "*") is None and files.listed(spark, f"{tmp_path}/s*", "*") is None


def test_surfaces_are_listed_by_tasks(spark, tmp_path):
    """Surfaces and annotations of many folders: the driver has no list of the files, which it had of each."""
    for i in range(30):
        (tmp_path / f"s{i}").mkdir()
        (tmp_path / f"s{i}" / "lh.white").write_bytes(binary.make_surface(np.eye(3) * i, np.array([[0, 1, 2], [2, 1, 0]])))
        (tmp_path / f"s{i}" / "rh.aparc.annot").write_bytes(binary.make_annot(np.array([1, 2, 9]), {1: "one", 2: "two"}))
    faces, points, labels = binary.read_faces(spark, str(tmp_path), "*.white"), binary.read_vertices(spark, str(tmp_path), "*.white"), binary.read_annotation(spark, str(tmp_path))
    assert all(df.inputFiles() == [] for df in (faces, points, labels))
    assert Counter(map(tuple, faces.collect())) == Counter([("lh", 0, 1, 2), ("lh", 2, 1, 0)] * 30)
    assert Counter(r.x for r in points.collect()) == Counter([0.0] * 60 + [float(i) for i in range(30)])
    assert Counter((r.hemi, r.label) for r in labels.collect()) == Counter({("rh", "one"): 30, ("rh", "two"): 30, ("rh", "unknown"): 30})
    one = binary.read_faces(spark, f"{tmp_path}/s[3]", "*.white")  # by Spark's reader
    assert sorted(map(tuple, one.collect())) == [("lh", 0, 1, 2), ("lh", 2, 1, 0)]
