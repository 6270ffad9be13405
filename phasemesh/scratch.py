"""Tables in the shared folder: they end a lineage, survive lost executors and go when nothing reads them any more.

Everything that one task writes and another reads lies under ``spark.checkpoint.dir``, which is read from the session.
A path without a scheme belongs to the default file system, as everywhere in Spark.  Where the setting is missing, a
session on one machine (master ``local``) uses a folder of that machine, and any other one below the warehouse.  Where the
path has no scheme and the default file system is the machine's own, a cluster may mount one folder there or have a disk of
its own on each machine, where executors would lose rows without an error; so a short table is written and counted once in
a session, and again when cores have joined it, and it raises unless all its rows are there.  A folder named with ``file:``
is taken to be shared, as the setting says so.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "file:///tmp/checkpoints"
#: Sessions, folders and numbers of cores with which executors were seen to write what others read.
_seen: set[tuple[str, str, int]] = set()


def _one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith(("local[", "local-cluster["))


def root(spark: SparkSession) -> str:
    """The shared folder of this session as a URI."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and _one_machine(spark):
        found = DEFAULT_DIR
    if found and re.match("[A-Za-z][A-Za-z0-9+.-]+:", found):
        return _uri(found)
    if not found:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{warehouse.rstrip('/')}/checkpoints"
    where = spark._jvm.org.apache.hadoop.fs.Path(found)
    path = _uri(str(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()))
    if path.startswith("file:") and not _one_machine(spark):
        _try_shared(spark, path)
    return path


def _try_shared(spark: SparkSession, path: str) -> None:
    """Raise unless the driver finds all rows of a table of which every core writes one; tried once in a session for its cores."""
    place = f"{path}/tried-{uuid.uuid4().hex}"
    try:
        rows = spark.sparkContext.defaultParallelism
        key = spark.sparkContext.applicationId, path, rows
        if key in _seen:
            return
        found = save(spark.range(0, rows, 1, rows), place).count()
        delete(spark, place)
    except Exception as e:
        raise ValueError(f"executors cannot share {path}; set spark.checkpoint.dir to a folder that the driver and all executors share") from e
    if found < rows:
        raise ValueError(f"{path} is on each machine's own disk; set spark.checkpoint.dir to a folder that the driver and all executors share")
    _seen.add(key)


def _uri(path: str) -> str:
    """With ``//`` after the scheme of a path of this machine, which other readers than Spark's ask for."""
    return re.sub("^file:/+", "file:///", path.rstrip("/"))


def folder(spark: SparkSession, name: str) -> str:
    """A new, empty place below the shared folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def save(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to ``path`` and read it back."""
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_result(df: DataFrame) -> None:
    """Delete a table that :meth:`Scratch.result` wrote, once nothing reads it."""
    path = getattr(df, "_result_path", None)
    if path:
        delete(df.sparkSession, path)


class Scratch:
    """The intermediate tables of one run, all below one folder: ``with Scratch(spark, "name") as tmp``.

    They are deleted at the end of the block, also after an error, and one by one by :meth:`discard` as soon as nothing
    reads them.  What the block returns must not read them: :meth:`result` writes it to a place of its own.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.path = folder(spark, name)
        self._at: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Delete all tables of this run."""
        delete(self.spark, self.path)
        self._at.clear()

    def place(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """``df`` as a table of this run."""
        path = self.place(name)
        out = save(df, path, compression)
        self._at[id(out)] = (out, path)
        return out

    def discard(self, *frames: DataFrame) -> None:
        """Delete tables of this run that no later plan reads; other frames are left alone."""
        for df in frames:
            _, path = self._at.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` as a table that stays after this run."""
        path = folder(self.spark, f"{self.name}-result")
        out = save(df, path)
        out._result_path = path
        return out
