"""Text files: motion parameters, displacement series, visit exports, configuration, and folders of sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

#: The session's folder is the last but one part of a file's path.
SESSION = r"([^/]+)/[^/]+$"


def _lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Numbered non-empty lines of whole files; a file is one row, as lines need their order.  With ``pattern`` all files below
    a folder are read, which tasks list.
    """
    found = files.listed(spark, path, pattern) if pattern else None
    if found is None:
        reader = spark.read.format("text").option("wholetext", True)
        if pattern:
            reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        whole = reader.load(path).select(F.col("_metadata.file_path").alias("file"), "value")
    else:
        whole = files.texts(found)
    # the session is found once a file, not once a line
    whole = whole.select("file", F.regexp_extract("file", SESSION, 1).alias("session_id"), "value")
    return whole.select("file", "session_id", F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: ~x.rlike(r"^\s*$"))).alias("t", "line"))


def _numbers(first: int, n: int) -> list[Column]:
    parts = F.split(F.btrim("line", F.lit(" \t\n\x0b\f\r")), r"\s+")
    return [F.get(parts, F.lit(first + i)).cast("double").alias(f"p{i + 1}") for i in range(n)]


def read_realignment(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Six numbers to a line, parted by runs of white space: ``file, session_id, t, p1..p6``."""
    return _lines(spark, path, pattern).select("file", "session_id", "t", *_numbers(0, 6))


def read_mcdat(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The same from files whose first column is to be left out."""
    return _lines(spark, path, pattern).select("file", "session_id", "t", *_numbers(1, 6))


def read_series(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One number to a line after a header line: ``file, session_id, t, fd``."""
    lines = _lines(spark, path, pattern).where("t > 0")
    return lines.select("file", "session_id", F.col("t").alias("t"), F.col("line").cast("double").alias("fd"))


def write_series(df: DataFrame, path: str, value: str = "fd", header: str = "fd", key: str = "session_id", order: str = "t") -> None:
    """One folder for each key with a header line and six decimals to a line, in order."""
    lines = df.select(key, F.col(order).cast("long").alias("_o"), F.format_string("%f", F.col(value).cast("double")).alias("value"))
    top = df.select(key).distinct().select(key, F.lit(-(1 << 62)).alias("_o"), F.lit(header).alias("value"))
    both = lines.unionByName(top).repartition(key).sortWithinPartitions(key, "_o")
    both.select(key, "value").write.partitionBy(key).text(path)


def read_visits(spark: SparkSession, path: str, names: Mapping[str, str], columns: list[str]) -> DataFrame:
    """A ``;`` export with a header.  ``columns``: the file's columns in order, as strings (of equal names the later end
    in ``.1``); ``names``: those to keep, with their new names.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.csv(path, sep=";", header=True, schema=schema, enforceSchema=True)
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def write_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def read_config(path: str) -> dict:
    """A YAML file, read by the driver; a path of its own or a URI."""
    import yaml
    from pyarrow import fs

    where, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with where.open_input_file(place) as f:
        return yaml.safe_load(f.readall()) or {}


def variants(config: Mapping, run: str) -> list[str]:
    """The run's variants; none if it is not listed."""
    return list((config.get("runs") or {}).get(run, []))


def find_files(spark: SparkSession, path: str, pattern: str, folder: str = ".*") -> DataFrame:
    """``file, session_id, length`` of files by glob, in folders whose name matches a regular expression; contents are
    not read.
    """
    below = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    found = below.select(F.col("path").alias("file"), F.regexp_extract("path", SESSION, 1).alias("session_id"), "length")
    return found.where(F.col("session_id").rlike(folder))


def latest(files: DataFrame, *by: str, column: str = "file") -> DataFrame:
    """The file whose name sorts last (of each group)."""
    return files.groupBy(*by).agg(F.max(column).alias(column)) if by else files.agg(F.max(column).alias(column))


def save_stage(df: DataFrame, path: str, *by: str, version: str = "1") -> DataFrame:
    """A stage's table, partitioned, reused if it is there already for the same files, columns and ``version``.

    What else the table depends on, the code that makes it above all, is for ``version`` to tell.
    """
    spark = df.sparkSession
    told = "\n".join([version, df.schema.json(), *by, *sorted(df.inputFiles())])
    path = f"{path.rstrip('/')}/stage-{hashlib.sha256(told.encode()).hexdigest()[:16]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("int"))
