"""Files below a folder, listed by tasks, so that the driver holds no list of them however many there are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch of files.
ROWS, BATCH_BYTES = 4096, 4 << 20
#: Tasks for each core that list, and read what they listed.
DEALT = 4


def place_of(uri: str):
    """Arrow's file system of a URI, and the path there."""
    from pyarrow import fs

    scheme, host, rest = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)", uri).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    where, base = fs.FileSystem.from_uri(f"{scheme}:{host or '//'}/")
    return where, f"{base.rstrip('/')}{rest}"


def _seen(name: str) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


class _Below:
    """``path, folder`` of what is in folders, ``deep``: of all files below them; files stay what they are."""

    FIELDS = "path string, folder boolean"

    def __init__(self, deep: bool):
        self.deep = deep

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bool]] = []
        for batch in batches:
            for path, folder in zip(*(c.to_pylist() for c in batch.columns)):
                for found in self._of(path) if folder else [(path, False)]:
                    held.append(found)
                    if len(held) == ROWS:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    def _of(self, path: str) -> Iterator[tuple[str, bool]]:
        from pyarrow import fs

        where, place = place_of(path)
        todo = [place]
        while todo:
            for f in where.get_file_info(fs.FileSelector(todo.pop())):
                if not _seen(f.base_name):
                    continue
                folder = f.type == fs.FileType.Directory
                if folder and self.deep:
                    todo.append(f.path)
                elif folder or f.size:
                    yield path + f.path[len(place) :], folder

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["path", "folder"])


def listed(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """``path`` of the files below a folder whose names match a glob, as Spark's readers list them, but for empty ones; None
    where the path is no folder that Arrow can list.

    One task lists the folder itself and others what is below its entries, which are dealt out; they read it, too.
    """
    if re.search(r"[*?\[{]", path):
        return None
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = str(root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()).rstrip("/")
    try:
        where, place = place_of(uri)
        if where.get_file_info(place).type.name != "Directory":
            return None
    except (AttributeError, pa.ArrowException, OSError):
        return None
    top = spark.range(1).coalesce(1).select(F.lit(uri).alias("path"), F.lit(True).alias("folder")).mapInArrow(_Below(False), _Below.FIELDS)
    found = top.repartition(DEALT * max(spark.sparkContext.defaultParallelism, 1)).mapInArrow(_Below(True), _Below.FIELDS)
    names = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    return found.where(F.regexp_extract("path", "[^/]*$", 0).rlike(f"^(?s:{names})$")).select("path")


class _Read:
    """``path, value``: whole files, unpacked by what their names end in."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, place = place_of(path)
                with where.open_input_stream(place) as f:
                    data = f.read()
                held.append((path, data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.large_binary()).cast(pa.binary())], names=["path", "value"])


def texts(found: DataFrame) -> DataFrame:
    """``file, value`` of :func:`listed` text files."""
    return found.mapInArrow(_Read(), "path string, value binary").select(F.col("path").alias("file"), F.col("value").cast("string").alias("value"))
