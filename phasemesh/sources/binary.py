"""Binary neuroimaging files, decoded by tasks: NIfTI-1 images, annotations and surfaces."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, images
from .text import SESSION

#: Valid vertices that are broadcast to a decoder.
MASKED = 5_000_000
#: Magic numbers of surface files (fixed value of the format).
TRIANGLES = 0xFFFFFE
#: Bytes of files that a worker is given at a time.
BATCH_BYTES = 16 << 20


def parse_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Scaled values in file order (first index fastest) and the 4 x 4 affine of a whole small file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head = images.parse_header(data)
    values = np.frombuffer(data, np.dtype(head.dtype), int(np.prod(head.shape)), head.at).astype(np.float64) * head.slope + head.inter
    return values.reshape(head.shape, order="F"), head.affine


def make_nifti(values: np.ndarray, affine: np.ndarray) -> bytes:
    """A NIfTI-1 file of doubles."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 64, 64)
    struct.pack_into("<8f", head, 76, 1, *[1] * 7)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *np.asarray(affine)[:3].reshape(-1))
    head[344:348] = b"n+1\x00"
    return bytes(head) + np.asarray(values, "<f8").tobytes(order="F")


def parse_annot(data: bytes) -> tuple[np.ndarray, dict[int, str]]:
    """Label code of each vertex, and the names of codes."""
    n = struct.unpack_from(">i", data)[0]
    pairs = np.frombuffer(data, ">i4", 2 * n, 4).reshape(-1, 2)
    codes = np.zeros(n, np.int64)
    codes[pairs[:, 0]] = pairs[:, 1]
    at, names = 4 + 8 * n, {}
    if at < len(data) and struct.unpack_from(">i", data, at)[0]:
        version, at = struct.unpack_from(">i", data, at + 4)[0], at + 8
        if version > 0:  # the older table: its entries, the file's name, then names and colours
            count = version
            length = struct.unpack_from(">i", data, at)[0]
            at += 4 + length
        else:
            length = struct.unpack_from(">i", data, at + 4)[0]
            at += 8 + length
            count = struct.unpack_from(">i", data, at)[0]
            at += 4
        for _ in range(count):
            if version <= 0:
                at += 4  # the entry's number
            length = struct.unpack_from(">i", data, at)[0]
            name = data[at + 4 : at + 4 + length].split(b"\0")[0].decode("utf-8", "replace")
            r, g, b, _ = struct.unpack_from(">4i", data, at + 4 + length)
            names[r + (g << 8) + (b << 16)] = name
            at += 4 + length + 16
    return codes, names


def parse_surface(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (n x 3) and 0-based triangles of a surface file."""
    if int.from_bytes(data[:3], "big") != TRIANGLES:
        raise ValueError("not a triangle surface file")
    at = data.index(b"\n\n", 3) + 2
    n, m = struct.unpack_from(">2i", data, at)
    points = np.frombuffer(data, ">f4", 3 * n, at + 8).reshape(-1, 3).astype(np.float64)
    return points, np.frombuffer(data, ">i4", 3 * m, at + 8 + 12 * n).reshape(-1, 3).astype(np.int64)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``session_id, hemi, path`` of files that tasks list, with ``content`` too where only Spark's reader lists them."""
    found = files.listed(spark, path, pattern)
    content = []
    if found is None:
        found, content = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path), ["content"]
    hemi = F.when(F.col("path").rlike(r"(^|[./])lh\."), "lh").when(F.col("path").rlike(r"(^|[./])rh\."), "rh")
    return found.select(F.regexp_extract("path", SESSION, 1).alias("session_id"), hemi.alias("hemi"), "path", *content)


#: Rows of a decoded file that one Arrow batch holds.
SLICE = 16_384


def _decode(found: DataFrame, columns: Callable[[bytes, str | None], dict[str, np.ndarray]], fields: str) -> DataFrame:
    """Each file as rows of Arrow columns made from numpy arrays; a matrix is a column of lists.  A file is read by the task
    that decodes it, one at a time.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for s, h, *c in zip(*b.columns):
                made = columns(c[1].as_py() if len(c) > 1 else _whole(c[0].as_py()), h.as_py())
                n = len(next(iter(made.values())))
                for at in range(0, n, SLICE):
                    part = {k: v[at : at + SLICE] for k, v in made.items()}
                    m = min(SLICE, n - at)
                    out = [pa.array([s.as_py()] * m, pa.string()), pa.array([h.as_py()] * m, pa.string())]
                    for v in part.values():
                        flat = np.ascontiguousarray(v).reshape(-1)
                        out.append(pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * v.shape[1]), pa.array(flat)) if v.ndim == 2 else pa.array(flat.tolist() if v.dtype == object else flat))
                    yield pa.RecordBatch.from_arrays(out, names=["session_id", "hemi", *part])

    return found.mapInArrow(run, f"session_id string, hemi string, {fields}")


def _whole(path: str) -> bytes:
    where, place = files.place_of(path)
    with where.open_input_file(place) as f:
        return f.read()


def read_surface_signal(spark: SparkSession, path: str, pattern: str = "*.nii*", vertices: DataFrame | None = None) -> DataFrame:
    """``session_id, hemi, vertex, y[]``: one row for each vertex, its last dimension being time; read by slabs.

    ``vertices(hemi, vertex)``: only these are made into rows.  They are broadcast to the decoder, a surface's worth of
    numbers; more than MASKED are joined after it instead.
    """
    rows = vertices.select("hemi", "vertex").distinct().limit(MASKED + 1).collect() if vertices is not None else []
    if len(rows) > MASKED:
        return read_surface_signal(spark, path, pattern).join(vertices.select("hemi", "vertex"), ["hemi", "vertex"], "left_semi").select("session_id", "hemi", "vertex", "y")
    wanted = None
    if vertices is not None:
        wanted = spark.sparkContext.broadcast({h: np.sort(np.array([r["vertex"] for r in rows if r["hemi"] == h], np.int64)) for h in {r["hemi"] for r in rows}})
    return images.read(spark, path, pattern, True, wanted)


def read_volume(spark: SparkSession, path: str, pattern: str = "*.nii*") -> DataFrame:
    """``session_id, i, j, k, y[], affine[]`` of images of 3 dimensions or more (further ones are frames); read by slabs."""
    return images.read(spark, path, pattern, False)


def read_annotation(spark: SparkSession, path: str, pattern: str = "*.annot") -> DataFrame:
    """``hemi, vertex, label``; a code without a name is ``unknown``."""

    def columns(data: bytes, _) -> dict[str, np.ndarray]:
        codes, names = parse_annot(data)
        return {"vertex": np.arange(len(codes), dtype=np.int32), "label": np.array([names.get(c, "unknown") for c in codes.tolist()], object)}

    return _decode(_files(spark, path, pattern), columns, "vertex int, label string").drop("session_id")


def read_faces(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``hemi, a, b, c``."""
    return _decode(_files(spark, path, pattern), lambda d, _: dict(zip("abc", parse_surface(d)[1].astype(np.int32).T)), "a int, b int, c int").drop("session_id")


def read_vertices(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``hemi, vertex, x, y, z``."""

    def columns(data: bytes, _) -> dict[str, np.ndarray]:
        points = parse_surface(data)[0]
        return {"vertex": np.arange(len(points), dtype=np.int32), **dict(zip("xyz", points.T))}

    return _decode(_files(spark, path, pattern), columns, "vertex int, x double, y double, z double").drop("session_id")


def make_surface(points: np.ndarray, triangles: np.ndarray) -> bytes:
    """A triangle surface file."""
    head = TRIANGLES.to_bytes(3, "big") + b"made here\n\n" + struct.pack(">2i", len(points), len(triangles))
    return head + np.asarray(points, ">f4").tobytes() + np.asarray(triangles, ">i4").tobytes()


def make_annot(codes: np.ndarray, names: dict[int, str]) -> bytes:
    """A file of vertex labels with a table of their names; a code holds the label's colour."""
    pairs = np.stack([np.arange(len(codes)), np.asarray(codes)], 1)
    table = struct.pack(">4i", 1, -2, len(names), 1) + b"\0" + struct.pack(">i", len(names))
    for i, (code, name) in enumerate(names.items()):
        text = name.encode() + b"\0"
        table += struct.pack(">2i", i, len(text)) + text + struct.pack(">4i", code & 255, code >> 8 & 255, code >> 16 & 255, 0)
    return struct.pack(">i", len(codes)) + pairs.astype(">i4").tobytes() + table


def write_volume(values: DataFrame, path: str) -> None:
    """A displacement map as a table, by session (images are for viewers; tables are for queries)."""
    values.write.partitionBy("session_id").parquet(path)


def write_files(given: DataFrame, base: str) -> int:
    """Write ``given(path, content)`` below the URI ``base``, each by the task that holds it; returns how many.

    A task that is run again writes the same files again.  What a worker is given at a time is bounded by bytes.
    """
    given.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(base)
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                place = f"{folder}/{path.as_py()}"
                where.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with where.open_output_stream(place) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return given.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
