"""NIfTI-1 images read as slabs of voxels, so that no worker holds a file.

Spark lists the files; tasks read their headers; each file is cut into slabs, runs of voxels over all frames whose doubles fit
into SLAB_BYTES; slabs are dealt over tasks.  Of a plain file a task reads the ranges of its slab, frame by frame.  A packed
file has no ranges: each of its slabs streams it up to the slab's last byte, so packed files are cut into as few as fit.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .files import place_of
from .text import SESSION

#: NIfTI-1 data type codes (fixed values of the format).
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
#: Bytes of doubles of a slab, bytes that are unpacked at a time, rows of an Arrow batch and its numbers at most.
SLAB_BYTES, CHUNK, BATCH_ROWS, BATCH_NUMBERS = 64 << 20, 1 << 20, 16_384, 1 << 20
#: Tasks that slabs are dealt to at most.
TASKS = 20_000
HEADER = 348


class Header(NamedTuple):
    shape: tuple[int, ...]
    dtype: str
    at: int
    slope: float
    inter: float
    affine: np.ndarray


def parse_header(data: bytes) -> Header:
    """Shape, type, place and scale of the values, and the 4 x 4 affine, of a file's first 348 bytes."""
    order = "<" if struct.unpack_from("<i", data)[0] == HEADER else ">"
    if struct.unpack_from(f"{order}i", data)[0] != HEADER or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack_from(f"{order}8h", data, 40)
    shape = tuple(max(1, d) for d in dims[1 : dims[0] + 1])
    code = struct.unpack_from(f"{order}h", data, 70)[0]
    if code not in NIFTI_TYPES:
        raise ValueError(f"NIfTI data type {code} is not supported")
    pixdim = struct.unpack_from(f"{order}8f", data, 76)
    at, slope, inter = struct.unpack_from(f"{order}3f", data, 108)
    if slope == 0.0 or not np.isfinite(slope):
        slope, inter = 1.0, 0.0
    qform, sform = struct.unpack_from(f"{order}2h", data, 252)
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack_from(f"{order}12f", data, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, x, y, z = struct.unpack_from(f"{order}6f", data, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array(
            [
                [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
            ]
        )
        size = np.array(pixdim[1:4])
        size[2] *= -1 if pixdim[0] < 0 else 1
        affine[:3, :3], affine[:3, 3] = turn * size, (x, y, z)
    else:
        affine[[0, 1, 2], [0, 1, 2]] = pixdim[1:4]
    return Header(shape, np.dtype(NIFTI_TYPES[code]).newbyteorder(order).str, int(at), float(slope), float(inter), affine)


def _open(path: str):
    """A readable file, unpacked if it is packed, and whether it was."""
    where, place = place_of(path)
    raw = where.open_input_file(place)
    packed = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return (gzip.GzipFile(fileobj=raw) if packed else raw), packed


class _Headers:
    """The shape of each file, and whether it is packed."""

    FIELDS = "session_id string, hemi string, path string, packed boolean, voxels long, frames long, shape array<long>"

    def __init__(self, surface: bool):
        self.surface = surface

    def __call__(self, batches):
        for batch in batches:
            out = []
            for session, hemi, path in zip(*(c.to_pylist() for c in batch.columns)):
                file, packed = _open(path)
                with file:
                    try:
                        shape = parse_header(_exactly(file, HEADER)).shape
                    except (ValueError, struct.error) as e:
                        raise ValueError(f"{path}: {e}") from e
                # a surface's last dimension is time; a volume's fourth is
                if not self.surface:
                    shape = (*shape, 1, 1, 1, 1)[: max(4, len(shape))]
                frames = int(np.prod(shape[-1:] if self.surface else shape[3:]))
                voxels = int(np.prod(shape)) // frames
                out.append((session, hemi, path, packed, voxels, frames, list(shape)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["session_id", "hemi", "path", "packed", "voxels", "frames", "shape"])


def _some(file, n: int) -> bytes:
    """Bytes of a file, one at least.  An early end is no EOFError, which a worker takes for the end of its own input."""
    try:
        got = file.read(n)
    except EOFError:
        got = b""
    if not got:
        raise ValueError("the file ends before its values do")
    return got


def _skip(file, n: int) -> None:
    while n > 0:
        n -= len(_some(file, min(n, CHUNK)))


def _exactly(file, n: int) -> bytes:
    parts = []
    while n > 0:
        parts.append(_some(file, n))
        n -= len(parts[-1])
    return parts[0] if len(parts) == 1 else b"".join(parts)


def read_slab(path: str, first: int, last: int, voxels: int, frames: int) -> tuple[np.ndarray, Header]:
    """Scaled values, voxels x frames, of the voxels from ``first`` to before ``last``."""
    file, packed = _open(path)
    with file:
        head = parse_header(_exactly(file, HEADER))
        kind = np.dtype(head.dtype)
        out = np.empty((frames, last - first), np.float64)
        here = HEADER
        for t in range(frames):
            at = head.at + (t * voxels + first) * kind.itemsize
            if packed:
                _skip(file, at - here)
            else:
                file.seek(at)
            data = _exactly(file, (last - first) * kind.itemsize)
            here = at + len(data)
            out[t] = np.frombuffer(data, kind)
    if (head.slope, head.inter) != (1.0, 0.0):
        out *= head.slope
        out += head.inter
    return out.T, head


class _Slabs:
    """The rows of slabs: ``vertex, y[]`` of the wanted voxels, or ``i, j, k, y[], affine[]``."""

    def __init__(self, surface: bool, wanted=None):
        self.surface, self.wanted = surface, wanted

    def __call__(self, batches):
        for batch in batches:
            for session, hemi, path, voxels, frames, shape, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.arange(first, last)
                if self.wanted is not None:
                    want = self.wanted.value.get(hemi, at[:0])
                    at = want[np.searchsorted(want, first) : np.searchsorted(want, last)]
                    if not len(at):
                        continue
                y, head = read_slab(path, first, last, voxels, frames)
                rows = max(1, min(BATCH_ROWS, BATCH_NUMBERS // max(frames, 1)))
                for k in range(0, len(at), rows):
                    yield self._rows(session, hemi, at[k : k + rows], y[at[k : k + rows] - first], shape, head)

    def _rows(self, session, hemi, at, y, shape, head) -> pa.RecordBatch:
        n = len(at)

        def lists(values: np.ndarray) -> pa.Array:
            flat = np.ascontiguousarray(values).reshape(-1)
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (len(flat) // n)), pa.array(flat))

        session = pa.array([session] * n, pa.string())
        if self.surface:
            return pa.RecordBatch.from_arrays([session, pa.array([hemi] * n, pa.string()), pa.array(at.astype(np.int32)), lists(y)], names=["session_id", "hemi", "vertex", "y"])
        place = np.unravel_index(at, shape[:3], order="F")
        affine = lists(np.broadcast_to(head.affine.reshape(1, -1), (n, 16)))
        return pa.RecordBatch.from_arrays([session, *(pa.array(p.astype(np.int32)) for p in place), lists(y), affine], names=["session_id", "i", "j", "k", "y", "affine"])


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``session_id, hemi, path`` of the files below a folder, listed by Spark, which leaves empty files out; none is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    hemi = F.when(F.col("path").rlike(r"(^|[./])lh\."), "lh").when(F.col("path").rlike(r"(^|[./])rh\."), "rh")
    return found.select(F.regexp_extract("path", SESSION, 1).alias("session_id"), hemi.alias("hemi"), "path")


def plan(found: DataFrame, surface: bool, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """``session_id, hemi, path, voxels, frames, shape, first, last``: one row for each slab of each file."""
    cores = found.sparkSession.sparkContext.defaultParallelism
    heads = found.repartition(max(cores, 1)).mapInArrow(_Headers(surface), _Headers.FIELDS)
    most = F.greatest(F.lit(1), F.floor(F.lit(slab_bytes) / (8 * F.col("frames")))).cast("long")
    slabs = heads.withColumn("n", F.ceil(F.col("voxels") / most)).withColumn("size", F.ceil(F.col("voxels") / F.col("n")))
    slabs = slabs.withColumn("first", F.explode(F.expr("sequence(0L, voxels - 1, size)")))
    return slabs.select("session_id", "hemi", "path", "voxels", "frames", "shape", "first", F.least(F.col("first") + F.col("size"), F.col("voxels")).alias("last"))


def read(spark: SparkSession, path: str, pattern: str, surface: bool, wanted=None, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """Rows of all slabs, about one task for each.  ``wanted``: broadcast sorted vertices by hemisphere; slabs without one
    are not opened.  A list of slabs is written to the shared folder and stays, as the returned plan reads it.
    """
    slabs = Scratch(spark, "slabs").result(plan(files(spark, path, pattern), surface, slab_bytes))
    dealt = slabs.repartition(max(1, min(slabs.count(), TASKS)))
    fields = "session_id string, hemi string, vertex int, y array<double>" if surface else "session_id string, i int, j int, k int, y array<double>, affine array<double>"
    return dealt.mapInArrow(_Slabs(surface, wanted), fields)
