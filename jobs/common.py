"""What the jobs share: their config, their log, and settings that hold while a job runs."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def config(spark: SparkSession, path: str | None, job: str) -> dict:
    """The JSON config at ``path``, which Spark reads, over the one that lies beside the job."""
    known = json.loads((Path(__file__).parent / f"{job}.json").read_text())
    if path:
        (row,) = spark.read.text(path, wholetext=True).collect()
        given = json.loads(row[0])
        if unknown := set(given) - set(known):
            raise ValueError(f"{path} has settings that {job} does not know: {', '.join(sorted(unknown))}")
        known |= given
    return known


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` for a dot in their names) that go back to what they were."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def begin_log() -> None:
    """Log to standard error, for the command line."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
