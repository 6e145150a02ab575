"""Every registered query against its DuckDB twin on the smallest data set."""

import pytest

from __spark_entry__ import entry, queries
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_twin(spark, name):
    assert compare(spark, name, FOLDER) >= 0


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1


SLICED = ["trace_run_merge", "trace_double_click", "trace_state_repair", "merge_labels", "thread_episodes", "rule_seq_order", "press_release", "backward_context", "trajectory"]


@pytest.mark.parametrize("name", SLICED)
def test_twin_with_large_sessions_cut_into_slices(spark, name):
    spark.conf.set("sessionloom.rowsPerSlice", "20")
    try:
        assert compare(spark, name, FOLDER) > 0
    finally:
        spark.conf.unset("sessionloom.rowsPerSlice")
