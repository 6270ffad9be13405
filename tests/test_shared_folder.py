"""Queries on a cluster whose shared folder is a plain path on the machines' own file system, as a mounted folder is."""

import pytest

import __spark_entry__
from phasemesh import scratch

QUERIES = (
    "block_offsets box_summary cluster_report components config_variants cpca_dual cpca_pim cpca_pimvr cpca_restarts displacement_files fd_outlier "
    "job2_cohort_table job1_motion_stream magnitude_medians magnitudes max_cluster_null motion_files motion_table stage_table solver_simulation "
    "surface_files surface_signals"
)


@pytest.fixture
def plain_folder(spark, tmp_path, monkeypatch):
    """``spark`` taken for a cluster, with ``spark.checkpoint.dir`` a path without a scheme."""
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda conf, name, *default: str(tmp_path) if name == "spark.checkpoint.dir" else get(conf, name, *default))
    monkeypatch.setattr(scratch, "_one_machine", lambda spark: False)
    return tmp_path


@pytest.mark.parametrize("name", QUERIES.split())
def test_query_with_a_plain_folder(plain_folder, same_as_sql, name):
    same_as_sql(__spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
    assert any(path == f"file://{plain_folder}" for _, path, _ in scratch._seen)


def test_folder_is_tried_again_with_more_cores(spark, plain_folder, monkeypatch):
    """The first cores of a cluster may be those of the driver's own machine; what they write, the driver finds."""
    cores = spark.sparkContext.defaultParallelism
    assert scratch.root(spark) == f"file://{plain_folder}"
    monkeypatch.setattr(scratch, "save", lambda df, path: df.limit(cores))
    assert scratch.root(spark) == f"file://{plain_folder}"
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", cores + 2)
    with pytest.raises(ValueError, match="own disk"):
        scratch.root(spark)
