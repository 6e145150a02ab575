"""Writers store what the readers expect."""

import os
import tempfile

from pyspark.sql import functions as F

from sessionloom.operators.sequence import order_sessions
from sessionloom.sources import sinks


def test_trajectory_rows_get_dense_ids_and_relative_paths(spark):
    rows = spark.createDataFrame(
        [("s", 5, "click", "/data/s/shots/a.jpg", "/other/b.jpg", 1.0, 2.0, 1.0), ("s", 9, "drag", None, None, 3.0, 3.0, 0.0)],
        "session_id string, run_id bigint, action string, before string, after string, time_before double, time_after double, time_range double",
    )
    got = sinks.trajectory_rows(order_sessions(rows, "session_id", "run_id"), F.lit("/data/s/")).orderBy("id").collect()
    assert [(r.id, r.state_before, r.state_after) for r in got] == [("n1", "shots/a.jpg", "/other/b.jpg"), ("n2", None, None)]


def test_report_is_written_sorted_per_model(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/report"
    rows = spark.createDataFrame([("s", "r", "2", "second"), ("s", "r", "1", "first")], "session_id string, root_id string, sort_key string, line string")
    sinks.write_report(rows, path)
    folder = f"{path}/session_id=s/root_id=r"
    text = "".join(open(f"{folder}/{name}").read() for name in os.listdir(folder) if name.endswith(".txt"))
    assert text == "first\nsecond\n"


def test_segments_keep_their_meta_beside_them(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/segments"
    rows = spark.createDataFrame([("s", 1)], "session_id string, seg_idx bigint")
    meta = spark.createDataFrame([("s", 1, "f")], "session_id string, n_rows bigint, input_fingerprint string")
    sinks.write_with_meta(rows, meta, path)
    assert spark.read.parquet(f"{path}/rows").join(spark.read.parquet(f"{path}/meta"), "session_id").count() == 1
