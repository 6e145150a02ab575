"""Streams give the same rows as the batch form of the same rule."""

import json
import os
import tempfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sessionloom.operators import consolidate
from sessionloom.plans import bursts, standins
from sessionloom.streaming import ingest
from sessionloom.streaming.rules import KeyBursts, PressRelease, RunMerge, ScrollThrottle
from sessionloom.streaming.run import run_batch, run_stream

FOLDER = "/root/testdata/sf0.001"


def stream_of(spark, rows):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows.write.mode("overwrite").json(f"{path}/in")
    return spark.readStream.schema(rows.schema).json(f"{path}/in"), path


def run(spark, stream, rule, name):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    query = run_stream(stream, rule).writeStream.format("memory").queryName(name).option("checkpointLocation", path).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_press_release_stream_equals_batch_and_native(spark):
    rows = bursts.mouse_events(spark, FOLDER)
    batch = sorted(tuple(r) for r in run_batch(rows, PressRelease()).collect())
    native = sorted(tuple(r) for r in consolidate.press_release(rows).select("session_id", "press_line", "release_line", "action", "x", "y", "end_x", "end_y").collect())
    stream, _ = stream_of(spark, rows)
    assert len(batch) > 0 and batch == native == run(spark, stream, PressRelease(), "press_release_out")


def test_run_merge_stream_with_pause_flush_equals_batch(spark):
    rows = bursts.merge_events(standins.actions(spark, FOLDER))
    ends = rows.groupBy("session_id").agg((F.max("ts") + 1).alias("ts")).select(
        "session_id", "ts", F.lit(10**9).alias("line_no"), F.lit("pause").alias("kind"), F.lit("").alias("action"), F.lit("").alias("token"), F.lit(False).alias("hotkey")
    )
    stream, _ = stream_of(spark, rows.unionByName(ends))
    got = run(spark, stream, RunMerge(), "run_merge_out")
    native = consolidate.merge_runs(standins.actions(spark, FOLDER)).df.select("session_id", "run_id", "kind", "action", "ts_before", "ts_after", "n_events")
    assert got == sorted(tuple(r) for r in native.collect())
    assert got == sorted(tuple(r) for r in run_batch(rows, RunMerge()).collect())


def feed(rule, events):
    state, out = rule.new_state(), []
    for e in events:
        state, rows = rule.feed(state, e)
        out += rows
    return out + rule.flush(state)


def test_key_burst_is_anchored_at_its_first_key():
    events = [{"ts": t, "line_no": i, "kind": "key"} for i, t in enumerate([0.0, 1.9, 2.1, 3.0, 9.0])]
    assert feed(KeyBursts(2.0), events) == [(0.0, 0, 1, 2), (2.1, 2, 3, 2), (9.0, 4, 4, 1)]


def test_pause_flushes_and_drops_until_resume():
    kinds = [("key", 0.0), ("pause", 0.5), ("key", 0.6), ("resume", 0.7), ("key", 0.8)]
    events = [{"ts": t, "line_no": i, "kind": k} for i, (k, t) in enumerate(kinds)]
    assert feed(KeyBursts(2.0), events) == [(0.0, 0, 0, 1), (0.8, 4, 4, 1)]


def test_scroll_throttle():
    points = [(0.0, 0, 0), (0.3, 50, 0), (0.6, 2, 0), (0.7, 50, 0), (0.9, 90, 0), (3.1, 90, 0)]
    events = [{"ts": t, "line_no": i, "kind": "scroll", "x": float(x), "y": float(y), "dx": 0.0, "dy": 1.0} for i, (t, x, y) in enumerate(points)]
    assert [r[0] for r in feed(ScrollThrottle(), events)] == [0, 3, 5]


def test_press_release_distance_border():
    def pair(d):
        base = {"button": "left", "monitor": 1, "y": 0.0}
        return feed(PressRelease(), [{**base, "kind": "press", "ts": 0.0, "line_no": 0, "x": 0.0}, {**base, "kind": "release", "ts": 1.0, "line_no": 1, "x": d}])[0][2]

    assert (pair(5.0), pair(5.1)) == ("click_left", "drag_left")


def test_late_rows_go_to_their_own_table(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{path}/in")

    def put(name, stamps):
        with open(f"{path}/in/{name}.json", "w") as handle:
            handle.writelines(json.dumps({"session_id": "s", "content": "x", "ts": t, "line_no": int(t)}) + "\n" for t in stamps)

    def drain():
        stream = ingest.read_log(spark, f"{path}/in")
        sink = ingest.split_late(f"{path}/main", f"{path}/late", 600.0)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination(60)

    put("a", [1000.0, 2000.0])
    drain()
    put("b", [1300.0, 1500.0, 2100.0])
    drain()
    assert sorted(r.ts for r in spark.read.parquet(f"{path}/main/rows").collect()) == [1000.0, 1500.0, 2000.0, 2100.0]
    assert [r.ts for r in spark.read.parquet(f"{path}/late").collect()] == [1300.0]


def _drain(spark, path, sink, name="cp", per_trigger=1):
    stream = ingest.read_log(spark, f"{path}/in", per_trigger)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)


def _put(path, name, rows):
    os.makedirs(f"{path}/in", exist_ok=True)
    with open(f"{path}/in/{name}.json", "w") as handle:
        handle.writelines(json.dumps({"session_id": s, "content": c, "ts": t, "line_no": n}) + "\n" for n, (s, c, t) in enumerate(rows))


def test_enrichment_stopped_in_mid_batch_restarts(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = {f"f{i}": [("s", f"c{i * 4 + j}", 1000.0 + i) for j in range(6)] for i in range(4)}  # files overlap by two keys
    for i, (name, part) in enumerate(rows.items()):
        _put(path, name, part)
        os.utime(f"{path}/in/{name}.json", (10_000 + i, 10_000 + i))
    asked = []

    def ask(open_rows):
        asked.extend(r.content for r in open_rows.select("content").collect())
        failed = F.col("content") == "c5"
        return open_rows.select("session_id", "content", F.when(failed, "error").otherwise("success").alias("status"), F.concat(F.lit("seen "), "content").alias("goal"))

    whole = ingest.enrich_once(f"{path}/one_go", ["session_id", "content"], ask)
    _drain(spark, path, whole, "cp_one_go")
    once = sorted(asked)
    asked.clear()
    sink = ingest.enrich_once(f"{path}/stopped", ["session_id", "content"], ask)
    stops = [2, 3]

    def stopping(batch, batch_id):
        sink(batch, batch_id)
        if batch_id in stops:
            stops.remove(batch_id)
            raise RuntimeError("stopped after the write, before the commit")

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            _drain(spark, path, stopping)
    _drain(spark, path, stopping)
    _drain(spark, path, stopping)
    read = lambda name: sorted((r.content, r.status, r.goal, r.batch_id) for r in spark.read.parquet(f"{path}/{name}").collect())
    assert read("stopped") == read("one_go")
    assert [c for c, *_ in read("stopped")].count("c4") == 1 and [c for c, *_ in read("stopped")].count("c5") == 2
    assert len(once) == len(read("one_go")) and len(asked) > len(once)  # the two stopped batches were asked again


def test_repeats_inside_and_outside_the_watermark(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    files = [[("s", "a", 1000.0), ("s", "a", 1001.0), ("s", "b", 1500.0)], [("s", "a", 1400.0), ("t", "a", 1600.0)], [("s", "c", 2200.0)], [("s", "a", 2300.0), ("s", "b", 2300.0), ("s", "c", 2301.0)]]
    sink = ingest.split_repeats(f"{path}/main", f"{path}/again", ["session_id", "content"], 600.0)
    state = {"stopped": False}

    def stopping(batch, batch_id):
        sink(batch, batch_id)
        if batch_id == 1 and not state["stopped"]:
            state["stopped"] = True
            raise RuntimeError("stopped")

    for i, rows in enumerate(files):
        _put(path, f"f{i}", rows)
        if i == 1:
            with pytest.raises(StreamingQueryException):
                _drain(spark, path, stopping)
        _drain(spark, path, stopping)
    read = lambda p: sorted((r.session_id, r.content, r.ts) for r in spark.read.parquet(p).collect())
    # By 2300 the first a (1000) and b (1500) lie more than 600 s before 2200 and are forgotten, c isn't.
    assert read(f"{path}/again") == [("s", "a", 1001.0), ("s", "a", 1400.0), ("s", "c", 2301.0)]
    assert read(f"{path}/main/rows") == [("s", "a", 1000.0), ("s", "a", 2300.0), ("s", "b", 1500.0), ("s", "b", 2300.0), ("s", "c", 2200.0), ("t", "a", 1600.0)]
