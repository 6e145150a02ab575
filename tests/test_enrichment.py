"""Partial answers, first candidates, key sets, bounded profiles, input files: hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators import boxes, candidates, enrich, flatten, keyset, profiles
from sessionloom.sources import logs


def test_first_distinct_in_order(spark):
    rows = [("a", "x", 5), ("a", "y", 1), ("a", "x", 0), ("a", None, 0), ("a", "z", 1), ("a", "w", 9), ("b", None, 1), (None, "q", 2)]
    df = spark.createDataFrame(rows, "g string, v string, at int")
    got = {r.g: r.firsts for r in profiles.first_distinct(df, ["g"], "v", "at", 3, "firsts").collect()}
    assert got == {"a": ["x", "y", "z"], None: ["q"]}


def test_texts_are_distinct_before_they_are_cut(spark):
    items = F.array(*(F.lit(t) for t in ["a  b", "a b", " ", "x" * 30 + "1", "x" * 30 + "2", "c", "d"]))
    got = spark.range(1).select(text.uniq_truncated(items, 4, 20).alias("v")).first().v
    assert got == ["a b", "x" * 17 + "...", "x" * 17 + "...", "c"]


@pytest.mark.parametrize(("response", "want"), [
    ('{"t": " a "}', "a"), ('```json\n{"t": "b"}\n```', "b"), ('<think>{}</think>{"t": "c"}', "c"), ('{"t": 7}', None), ('{"t": null}', None), ('{"t": " "}', None), ("[1]", None), ("no", None), (None, None),
])
def test_answer_text(spark, response, want):
    df = spark.createDataFrame([(response,)], "r string")
    assert df.select(enrich.answer_text(F.col("r"), "t").alias("v")).first().v == want


def test_enrichment_keeps_the_rest_of_the_row(spark):
    fields = "session_id string, action_id string, action string, goal string, active_application string, visual_content string, md_results string, other int"
    rows = [("s", "1", "click", "g", "App", "old", "text", 1), ("s", "2", "click", None, None, None, "text", 2), ("s", "3", "click", "g", "App", "old", " ", 3), ("s", "1", "click", "g", "App", "old", "text", 4)]
    df = spark.createDataFrame(rows, fields)
    seen = []

    def ask(requests):
        seen.extend(json.loads(r.content) for r in requests.select("content").collect())
        return requests.select("request_id", F.when(F.get_json_object("content", "$.objective") == "g", F.lit('{"visual_content": "new"}')).alias("response"))

    none = spark.createDataFrame([], "cache_key string, enriched_visual_content string, line_no long")
    out, fresh = enrich.enrich_visuals(df, ask, none, "m")
    got = sorted((r.other, r.visual_content, r.enriched, r.action, r.goal) for r in out.collect())
    assert got == [(1, "new", True, "click", "g"), (2, None, False, "click", None), (3, "old", False, "click", "g"), (4, "new", True, "click", "g")]
    assert len(seen) == 2 and fresh.count() == 1  # equal rows ask once; a failed answer is not stored
    again, _ = enrich.enrich_visuals(df, lambda r: r.where(F.lit(False)).select("request_id", F.lit(None).cast("string").alias("response")), fresh.withColumn("line_no", F.lit(1)), "m")
    assert [r.visual_content for r in again.where("other = 1").collect()] == ["new"]


def test_first_valid_runs_a_stage_for_open_models_only(spark):
    models = spark.createDataFrame([(i,) for i in range(6)], "k int")
    ran = []

    def stage(name, made, valid):
        def build(open_models):
            ran.append((name, sorted(r.k for r in open_models.collect())))
            df = open_models.where(F.col("k").isin(made))
            return df.select("k", F.lit(f"{name}{'!' if valid else ''}").alias("candidate"))

        return name, build

    check = lambda df: df.select("k", F.col("candidate").endswith("!").alias("valid"), F.concat(F.lit("no "), "candidate").alias("feedback"))
    stages = [stage("a", [0, 1], True), stage("b", [2, 3], False), stage("c", [3, 4], True), stage("d", [5], False)]
    out = {r.k: (r.candidate, r.origin, r.valid) for r in candidates.first_valid(models, stages, check, ["k"]).collect()}
    assert out == {0: ("a!", "a", True), 1: ("a!", "a", True), 2: ("b", "b", False), 3: ("c!", "c", True), 4: ("c!", "c", True), 5: ("d", "d", False)}
    assert ran == [("a", [0, 1, 2, 3, 4, 5]), ("b", [2, 3, 4, 5]), ("c", [2, 3, 4, 5]), ("d", [2, 5])]
    nothing = candidates.first_valid(models, [stage("e", [], True)], check, ["k"]).collect()
    assert {(r.candidate, r.origin, r.valid) for r in nothing} == {(None, None, False)}


SCHEMA = {"a": None, "b?": None, "c": [{"d": None}], "e": {"f": {"g": None}}}


def _findings(spark, document):
    df = spark.createDataFrame([("s", "r", document)], "session_id string, root_id string, value string")
    return sorted((r.path, r.detail) for r in keyset.key_findings(df, SCHEMA).collect())


def test_keys_at_every_depth(spark):
    good = {"a": 1, "c": [{"d": 1}], "e": {"f": {"g": None}}}
    assert _findings(spark, json.dumps(good)) == []
    assert _findings(spark, json.dumps(good | {"b": 2, "c": []})) == []
    wrong = {"a": 1, "x": 1, "c": [{"d": 1}, {"d": 1, "y": 2}, 3], "e": {"f": {"h": 1}}}
    assert _findings(spark, json.dumps(wrong)) == [
        ("$", "extra x"), ("$.c[1]", "extra y"), ("$.c[2]", "not an object"), ("$.e.f", "extra h"), ("$.e.f", "missing g"),
    ]
    assert _findings(spark, json.dumps({"a": 1, "c": [], "e": None})) == []
    assert _findings(spark, '{"a": 1}') == [("$", "missing c"), ("$", "missing e")]
    assert _findings(spark, "nothing") == [("$", "not an object")]


def test_answers_are_checked_for_their_keys(spark):
    rows = [("1", '```json\n{"a": 1, "c": [{"d": 1}], "e": {"f": {"g": 1}}}\n```'), ("2", '{"a": 1, "c": [{"z": 1}], "e": {"f": {"g": 1}}}'), ("3", "sorry"), ("4", None)]
    none = (False, "$ misses a; $ misses c; $ misses e")  # an answer without JSON reads as an empty object
    got = {r.request_id: (r.valid, "; ".join(sorted(r.feedback.split("; ")))) for r in keyset.answers_checked(spark.createDataFrame(rows, "request_id string, response string"), SCHEMA).collect()}
    assert got == {"1": (True, ""), "2": (False, "$.c[0] may not have z; $.c[0] misses d"), "3": none, "4": none}


def test_unknown_fields_fail_the_strict_trajectory_reader(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    path = tmp_path / "s1" / "trajectory.jsonl"
    path.write_text('{"id": "n1", "action": "click"}\n{"id": "n2", "action": "click", "odd": 1}\n')
    with pytest.raises(Exception, match="unknown or missing fields at .*trajectory.jsonl"):
        logs.read_trajectory(spark, str(path)).collect()
    assert [r.id for r in logs.read_trajectory(spark, str(path), strict=False).collect()] == ["n1", "n2"]
    path.write_text('{"id": "n1", "action": "click", "time_range": 2}\n')
    assert [(r.id, r.time_range) for r in logs.read_trajectory(spark, str(path)).collect()] == [("n1", 2.0)]


def test_inputs_by_name(spark):
    sessions = spark.createDataFrame([("a", "d/a"), ("b", "d/b/"), ("c", "d/c")], "session_id string, folder string")
    listing = spark.createDataFrame([("d/a/raw",), ("d/b/grounded",), ("d/b/raw",), ("d/a/raw",)], "path string")
    got = sorted(tuple(r) for r in logs.resolve_inputs(sessions, listing, ["grounded", "raw", "old"]).collect())
    assert got == [("a", "d/a/raw", "raw", True), ("b", "d/b/grounded", "grounded", True), ("c", "d/c/grounded", "grounded", False)]


def test_layout_items(spark):
    items = [{"type": "text", "bbox": [0.1, 0.2, 0.3, 0.4], "content": "a"}, {"bbox": {"x1": 30, "y1": 20, "x2": 10, "y2": 10}, "content": {"k": 1}}, "x", {"type": "icon", "bbox": None}, {"type": "icon", "bbox": [1, 2]}]
    df = spark.createDataFrame([(1, json.dumps({"parsed_content": items})), (2, "{}"), (3, None)], "id int, value string")
    got = [(r.id, r["index"], r.label, r.native_label, r.content, tuple(r.box)) for r in boxes.layout_items(df, 100, 50).collect()]
    assert got == [(1, 0, "text", "text", "a", (10.0, 10.0, 30.0, 20.0)), (1, 1, "image", "unknown", '{"k":1}', (10.0, 10.0, 30.0, 20.0))]


def test_keys_are_read_without_writing_objects_as_text(spark):
    df = spark.createDataFrame([("s", "m", '{"id": 1, "more": {"x": 1}}')], "session_id string, root_id string, value string")
    rows = keyset.object_keys(df, {"id": None, "more": {"x": None, "y": None}})
    assert sorted((r.place, sorted(r.found)) for r in rows.collect()) == [("$", ["id", "more"]), ("$.more", ["x"])]
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    assert "structstojson" not in plan and "jsonobjectkeys" not in plan


def test_walk_hands_over_bounded_pieces(spark):
    steps = [{"name": f"step {i}"} for i in range(2 * flatten.CHUNK + 1)]
    rows = list(flatten._step_rows(("s", "m"), {"id": "p", "body": {"operator": "SEQ", "steps": steps}}))
    assert [len(b) for b in flatten._batches(iter(rows), flatten.STEPS)] == [flatten.CHUNK, flatten.CHUNK, 1]
    value = json.dumps({"procedure_nodes": [{"id": "p", "body": {"operator": "SEQ", "steps": steps}}]})
    df = spark.createDataFrame([("s", "m", value)], "session_id string, root_id string, value string")
    assert flatten.body_steps(df).agg({"places": "count"}).first()[0] == len(steps)
