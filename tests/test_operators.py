"""Hand-made cases and brute force for functions, windows, threads, rules, sources and provider rounds."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from sessionloom import provider
from sessionloom.functions import answers, cost, geometry, ids, text, timefn
from sessionloom.operators import boxes, graphs, online, procedures, resume, rules, screenshots, segments, threads, windows
from sessionloom.operators.sequence import order_sessions
from sessionloom.sources import logs, sinks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def strings(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def test_text_functions(spark):
    assert value(spark, text.truncate(F.lit(" a\nb " + "x" * 20), 10)) == "a b xxx..."
    assert value(spark, text.clip(F.lit("one  two three four"), 11)) == "one two..."
    assert value(spark, text.limit_sentences(F.lit("A b. C d! E f?"), 2, 100)) == "A b. C d!"
    assert value(spark, text.slug(F.lit("  Hello, World! "), F.lit("x"))) == "hello_world"
    assert value(spark, text.normalize(F.lit("  A  B "))) == "a b"
    assert value(spark, text.representative_samples(strings(*"abcdefghi"), 4)) == ["a", "d", "f", "i"]
    assert value(spark, text.deliverable(strings("report.docx", "Save button"), F.lit("o"))) == "report.docx"
    assert value(spark, text.infer_anchors(F.lit("open my-file in DataFrame"), F.lit(""), strings("e1"), strings(), 3)) == ["my-file", "DataFrame", "e1"]
    assert value(spark, text.ends(strings("a", "b", "c"), False)) == ["a", "b", "c"]
    assert value(spark, text.ends(strings("a", "b", "c"), True)) == ["a", "b", "b", "c"]


def test_ids(spark):
    assert value(spark, ids.expand_range(F.lit("activity_0001-activity_0003"))) == ["activity_0001", "activity_0002", "activity_0003"]
    for bad in ("activity_0003-activity_0001", "activity_1", "activity_0001-subgoal_segment_0002", "x"):
        assert value(spark, ids.expand_range(F.lit(bad))) is None


def test_times(spark):
    assert value(spark, timefn.coerce_epoch(F.lit("1970-01-01T00:01:00Z"))) == 60.0
    assert value(spark, timefn.coerce_epoch(F.lit("12.5"))) == 12.5
    assert value(spark, timefn.duration_text(F.lit(3720.0))) == "1h 2m"
    assert value(spark, timefn.clock_text(F.lit(65.0))) == "01:05"


def test_boxes_and_crop(spark):
    df = spark.createDataFrame([((0.1, 0.2, 0.5, 0.6),), ((5.0, 5.0, 5.0, 9.0),)], "b struct<x1: double, y1: double, x2: double, y2: double>")
    got = [r.box and tuple(r.box) for r in boxes.normalize_boxes(df, F.col("b"), 1000, 500).collect()]
    assert got == [(100.0, 100.0, 500.0, 300.0), None]
    box = geometry.box_struct(*[F.lit(v) for v in (80.0, 90.0, 180.0, 160.0)])
    assert tuple(value(spark, geometry.crop_rect(F.lit(100.0), F.lit(120.0), box, F.lit(400), F.lit(300))))[:2] == (0, 15)
    points = value(spark, geometry.action_points(F.lit("drag_left(start_x=1.5, start_y=2, end_x=3, end_y=4)")))
    assert [tuple(p) for p in points] == [("drag start", 1.5, 2.0), ("drag end", 3.0, 4.0)]


def test_prices(spark):
    calls = spark.createDataFrame([(1, None, "gpt-5.5", 1000, 250, 100), (2, None, "gpt-5.5", 300000, 0, 1000), (3, "x", "gpt-5.5", 1, 0, 1)],
                                  "id int, provider string, model_ref string, input_tokens bigint, cache_read_tokens bigint, output_tokens bigint")
    assert [r.price_usd for r in cost.with_price(calls).orderBy("id").collect()] == [0.006875, 3.045, None]


def test_answers(spark):
    assert value(spark, answers.json_object_text(F.lit("x ```json\n{\"a\": 1}\n``` y"))) == '{"a": 1}'
    assert value(spark, answers.json_object_text(F.lit("so {\"a\": 2} it is"))) == '{"a": 2}'
    assert value(spark, answers.json_object_text(F.lit("[1]"))) == "{}"


@pytest.mark.parametrize("n", [0, 1, 40, 41, 100])
@pytest.mark.parametrize("overlap", [0, 3, 4, 39])
def test_window_cores_tile(spark, n, overlap):
    totals = spark.createDataFrame([("s", n)], "session_id string, n bigint")
    rows = windows.count_windows(totals, 40, overlap).orderBy("window_no").collect()
    covered = [i for r in rows for i in range(r.core_start, r.core_end)]
    assert covered == list(range(n))


def test_merge_groups_chain_and_nest(spark):
    cand = spark.createDataFrame([("s", i) for i in range(8)], "session_id string, seg_idx bigint")
    ranges = spark.createDataFrame([("s", 0, 1), ("s", 1, 3), ("s", 5, 7), ("s", 6, 7)], "session_id string, start_idx bigint, end_idx bigint")
    got = segments.merge_groups(order_sessions(cand, "session_id", "seg_idx"), ranges).df.orderBy("seg_idx").collect()
    assert [r.group_no for r in got] == [1, 1, 1, 1, 2, 3, 3, 3]


def test_episodes(spark):
    rows = spark.createDataFrame([("s", "C1", i) for i in (0, 1, 3, 4, 9)], "session_id string, canonical_root_id string, leaf_idx bigint")
    got = [(r.episode_id, r.start_leaf_idx, r.end_leaf_idx) for r in threads.episodes(rows).orderBy("episode_no").collect()]
    assert got == [("C1.E1", 0, 1), ("C1.E2", 3, 4), ("C1.E3", 9, 9)]


def leaves(spark, rows):
    schema = "session_id string, leaf_idx bigint, objective string, procedure_summary string, apps_used array<string>, entities array<string>, ocr_texts array<string>, pre_state string, post_state string, num_actions bigint"
    return spark.createDataFrame([("s", i, o, "", apps, ents, [], "", "", n) for i, (o, apps, ents, n) in enumerate(rows)], schema)


def test_online_assignment(spark):
    mail = ("Write the mail to Ann", ["Mail"], ["Draft to Ann"], 9)
    code = ("Fix parser bug 12345 in repository", ["Editor"], ["parser.py"], 9)
    short = ("click", ["Other"], [], 2)
    got = [(r.provisional_root_id, r.rule) for r in online.assign_threads(leaves(spark, [mail, code, mail, code, short]), batch_size=2).orderBy("leaf_idx").collect()]
    assert got == [("R001", "new"), ("R002", "new"), ("R001", "score"), ("R002", "score"), ("R002", "recent")]
    # Threads born in a batch are reachable only through the recent rule.
    got = [r.rule for r in online.assign_threads(leaves(spark, [mail, code, mail]), batch_size=15).orderBy("leaf_idx").collect()]
    assert got == ["new", "new", "new"]


def tree(spark, rows):
    schema = "session_id string, root_id string, path string, parent_path string, node_id string, ordinal bigint, refs array<string>"
    return spark.createDataFrame([("s", "r", *r) for r in rows], schema)


def found(df):
    return sorted((r.rule_id, r.path, r.detail) for r in df.collect())


def test_partition_rules(spark):
    root = ("$", None, "C1", 0, ["activity_0000-activity_0002"])
    a, b = ("$.a", "$", "C1.1", 1, ["activity_0000-activity_0001"]), ("$.b", "$", "C1.2", 2, ["activity_0002"])
    assert found(rules.partition_rules(tree(spark, [root, a, b]))) == []
    assert ("V21", "$", "missing activity_0002") in found(rules.partition_rules(tree(spark, [root, a])))
    over = ("$.b", "$", "C1.2", 2, ["activity_0001-activity_0003"])
    got = found(rules.partition_rules(tree(spark, [root, a, over])))
    assert got == [("V19", "$.b", "activity_0003"), ("V20", "$", "activity_0001"), ("V21", "$", "extra activity_0003")]


def test_graph_rules(spark):
    edges = spark.createDataFrame([("s", "r", "a", "b"), ("s", "r", "b", "c"), ("s", "r", "c", "b"), ("s", "q", "a", "b")], "session_id string, root_id string, parent_id string, child_id string")
    assert [r.root_id for r in graphs.cycle_rules(edges).collect()] == ["r"]
    starts = spark.createDataFrame([("s", "r", "a")], "session_id string, root_id string, node_id string")
    assert sorted(r.node_id for r in graphs.reachable(edges, starts).collect()) == ["a", "b", "c"]


def test_vague_wording(spark):
    for phrase, vague in (("Until done", True), ("It works!", True), ("All 3 rows read", False), ("looks good to me", True)):
        assert value(spark, rules.vague_stop(F.lit(phrase))) is vague
    assert value(spark, rules.vague_verifier(F.lit("Manual check."))) is True


def test_last_row_wins(spark):
    rows = spark.createDataFrame([("s", "a", 1, "x"), ("s", "a", 2, "y")], "session_id string, k string, line_no bigint, v string")
    assert [r.v for r in resume.last_wins(rows, ["session_id", "k"], F.col("line_no")).collect()] == ["y"]


def test_log_files(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{root}/s1")
    with open(f"{root}/s1/raw_trace.jsonl", "w") as handle:
        for content, ts in (("b", 2), ("a", 1), (None, 3), ("c", 2)):
            handle.write(json.dumps({"content": content, "timestamp": ts}) + "\n\n")
    objects, _ = logs.json_objects(logs.read_lines(spark, f"{root}/*/raw_trace.jsonl"))
    rows = logs.raw_events(objects).orderBy("ts", "split_start", "split_row").collect()
    assert [(r.session_id, r.action) for r in rows] == [("s1", "a"), ("s1", "b"), ("s1", "c")]
    with open(f"{root}/s1/raw_trace.jsonl", "a") as handle:
        handle.write("[1]\n")
    lines = logs.read_lines(spark, f"{root}/*/raw_trace.jsonl")
    assert [r.value for r in logs.json_objects(lines, strict=False)[1].collect()] == ["[1]"]
    with pytest.raises(Exception, match="not a JSON object"):
        logs.json_objects(lines)[0].collect()


def test_screenshot_listing_and_data_url(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{root}/s1/shots")
    with open(f"{root}/s1/shots/1.5_click_before.jpg", "wb") as handle:
        handle.write(b"abc")
    parsed = screenshots.parse_paths(logs.list_screenshots(spark, root)).first()
    assert (parsed.session_id, parsed.ss_time, parsed.action, parsed.tag) == ("s1", 1.5, "click", "before")
    files = spark.read.format("binaryFile").load(f"{root}/s1/shots")
    assert files.select(screenshots.data_url(F.col("path"), F.col("content")).alias("u")).first().u == "data:image/jpeg;base64,YWJj"


def test_merged_output_refuses_repeated_roots(spark):
    rows = spark.createDataFrame([("s", "r", True, 1.0), ("s", "r", True, 1.0)], "session_id string, root_id string, ok boolean, estimated_usd double")
    with pytest.raises(Exception, match="duplicate root id"):
        sinks.merged_output(rows, unique_roots=True).collect()


def test_provider_rounds_repair_and_failure(spark):
    def model(request):
        if request["content"] == "fail":
            raise ValueError("no")
        return ("good" if request["feedback"] or request["content"] == "easy" else "bad"), {"input_tokens": 1}

    requests = spark.createDataFrame([("1", "easy"), ("2", "hard"), ("3", "fail")], "request_id string, content string")
    check = lambda a: a.select("request_id", (F.col("response") == "good").alias("valid"), F.lit("try again").alias("feedback"))
    out, ledger = provider.rounds(requests, model, check, max_attempts=2, concurrency=2)
    assert sorted((r.request_id, r.valid, r.attempt) for r in out.collect()) == [("1", True, 1), ("2", True, 2), ("3", False, 2)]
    assert ledger.count() == 5


def test_fingerprint_sees_order_and_content(spark):
    def of(*values):
        rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "session_id string, idx bigint, v string")
        return segments.fingerprint(rows, ["idx", "v"]).first().input_fingerprint

    assert of("a", "b") == of("a", "b") != of("b", "a")


def test_ids_past_four_digits(spark):
    from sessionloom.functions import ids

    row = spark.sql("select 'activity_9998-activity_10002' r, 'activity_12' s").select(ids.expand_range(F.col("r")), ids.expand_range(F.col("s"))).first()
    assert row[0] == ["activity_9998", "activity_9999", "activity_10000", "activity_10001", "activity_10002"] and row[1] is None


def test_slug_reads_whole_text(spark):
    from sessionloom.functions import text

    row = spark.createDataFrame([("-" * 301 + "report",)], "t string").select(text.slug(F.col("t"), F.lit("session"))).first()
    assert row[0] == "report"


def test_slices_are_even_and_change_nothing(spark):
    from sessionloom.operators.sequence import SLICE, order_sessions

    rows = [("a", float(1 if i else 1_000_000), i) for i in range(5)] + [("a", float(i), i) for i in range(10, 1_000)]
    rows += [("a", None, i) for i in range(2_000, 2_010)] + [(None, float(i), i) for i in range(30)] + [("b", 1.0, 1)]
    df = spark.createDataFrame(rows, "session_id string, ts double, line_no long")
    made = []
    for limit in (10_000_000, 100):
        so = order_sessions(df, "session_id", ("ts", "line_no"), limit=limit)
        if so.sliced:
            largest = so.rows.groupBy("session_id", SLICE).count().agg(F.max("count")).first()[0]
            assert largest <= 200
        so = so.neighbours(prev={"p": "line_no"}, next={"n": "line_no"}).index("i").totals(t=("max", F.col("line_no")))
        made.append(sorted(map(str, so.df.select("session_id", "ts", "line_no", "p", "n", "i", "t").collect())))
    assert made[0] == made[1]


def test_trim_goes_by_position(spark):
    from sessionloom.operators.consolidate import trim_to_complete
    from sessionloom.operators.sequence import order_sessions

    rows = [("s", 1.0, 1, None, "x"), ("s", 1.0, 2, "b", "a"), ("s", 2.0, 3, "b", "a"), ("s", 2.0, 4, "b", None)]
    so = order_sessions(spark.createDataFrame(rows, "session_id string, ts double, line_no long, before string, after string"), "session_id", ("ts", "line_no"))
    assert sorted(r["line_no"] for r in trim_to_complete(so).df.collect()) == [2, 3]


def test_evidence_is_found_at_any_depth(spark):
    from sessionloom.operators import evidence

    df = spark.sql("""select 's' session_id, 'r' root_id, 'activity_0001' activity_id, array('a1') raw_action_ids, 'sem_9' semantic_action_id,
      array(named_struct('action_id', 'a2', 'inner', named_struct('action_ids', array('a3', ' ', null), 'other', 'a9'))) source_actions""")
    assert {r["evidence_id"] for r in evidence.evidence_owners(df).collect()} == {"activity_0001", "a1", "sem_9", "a2", "a3"}


def test_transient_errors_go_by_type_and_status():
    class ReadTimeout(Exception):
        pass

    class Slow(ReadTimeout):
        pass

    class Status(Exception):
        def __init__(self, code):
            self.response = type("R", (), {"status_code": code})()

    assert provider.is_transient(ReadTimeout()) and provider.is_transient(Slow()) and provider.is_transient(Status(503))
    assert not provider.is_transient(ValueError("row 4290 of 503")) and not provider.is_transient(Status(500))


def _graph(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "session_id string, root_id string, parent_id bigint, child_id bigint")


def _start(spark, *names):
    return spark.createDataFrame([("s", n, 0) for n in names], "session_id string, root_id string, node_id bigint")


def test_long_chains_take_few_rounds(spark):
    chain = [("chain", i, i + 1) for i in range(10_000)]
    ring = [("ring", i, (i + 1) % 2_001) for i in range(2_001)] + [("ring", 5_000 + i, 5_001 + i) for i in range(3)]
    edges = _graph(spark, chain + ring).cache()
    left, _, rounds = graphs.contract(edges, _start(spark, "chain", "ring"))
    assert rounds <= 15
    assert left.where("root_id = 'chain' and rooted").count() == 10_000
    assert left.where("root_id = 'ring' and rooted").count() == 2_000
    found = {r.root_id for r in graphs.cyclic_models(edges).collect()}
    assert found == {"ring"}


def test_reach_and_cycles_of_random_graphs(spark):
    rnd = random.Random(12)
    models = {}
    for m in range(60):
        n = rnd.randint(1, 12)
        models[f"m{m}"] = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 2 * n))] + [(a, a + 1) for a in range(n, n + 3)]
    edges = _graph(spark, [(m, *e) for m, es in models.items() for e in es]).cache()

    def seen(es, start):
        found, todo = set(), [start]
        while todo:
            node = todo.pop()
            for p, c in es:
                if p == node and c not in found:
                    found.add(c)
                    todo.append(c)
        return found

    got = {(r.root_id, r.node_id) for r in graphs.reachable(edges, _start(spark, *models)).collect()}
    assert got == {(m, n) for m, es in models.items() for n in {0} | seen(es, 0)}
    cyclic = {m for m, es in models.items() if any(p in seen(es, p) for p, _ in es)}
    assert {r.root_id for r in graphs.cyclic_models(edges).collect()} == cyclic
    assert 0 < len(cyclic) < len(models)


def test_procedure_documents_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def made(root):
        seen.add(1)
        return json.dumps({"version": "1", "root_procedure_id": "p", "procedure_nodes": [{
            "id": "p", "name": "n", "operator": "SEQ", "description": "d", "activity_refs": ["activity_0001"], "evidence_summary": "e",
            "body": {"operator": "SEQ", "activity_refs": ["activity_0002"], "steps": [{"activity_id": f"activity_000{root}"}]},
        }]})

    documents = spark.range(1, 3).select(F.lit("s").alias("session_id"), F.col("id").cast("string").alias("root_id"))
    documents = documents.withColumn("value", F.udf(made)("root_id"))
    known = documents.select("session_id", "root_id", F.lit("activity_0001").alias("activity_id"))
    found = procedures.procedure_findings(documents, known)
    assert sorted((r.root_id, r.rule_id, r.detail) for r in found.collect()) == [
        ("1", "V35", "extra activity_0002"), ("1", "V35", "missing activity_0001"), ("2", "V36", "extra activity_0001"), ("2", "V36", "missing activity_0002"), ("2", "V46", "activity_0002"),
    ]
    assert seen.value == 2


def test_sound_models_are_those_no_graph_rule_rejects(spark, monkeypatch):
    edges = {
        "tree": [(1, 2), (1, 3), (3, 4)], "dangling": [(1, 2), (1, -2)], "twice": [(1, 2), (1, 2)], "two parents": [(1, 2), (1, 3), (2, 3)],
        "below": [(1, 2), (2, 1)], "loop": [(1, 2), (3, 4), (4, 3)], "lost": [(1, 2)], "no root": [(2, 3)], "null": [(1, 2), (1, None)], "alone": [],
    }
    ids = {"tree": 4, "two parents": 3, "loop": 4, "lost": 3, "no root": 3, "alone": 1}
    nodes = spark.createDataFrame([("s", m, i) for m in edges for i in range(2 if m == "no root" else 1, ids.get(m, 2) + 1)], "session_id string, root_id string, node_id long")
    rows = spark.createDataFrame([("s", m, *e) for m, es in edges.items() for e in es], "session_id string, root_id string, parent_id long, child_id long")
    starts = nodes.where("node_id = 1")
    searched, contract = set(), graphs.contract

    def seen(edges, *rest):
        searched.update(r["root_id"] for r in edges.collect())
        return contract(edges, *rest)

    found = [graphs.dangling_rules(rows, nodes), graphs.parent_rules(rows, starts), graphs.cycle_rules(rows), graphs.reach_rules(rows, nodes, starts)]
    want = {r["root_id"] for r in rules.accepted(nodes.select("session_id", "root_id").distinct(), rules.union_all(*found)).collect()}
    monkeypatch.setattr(graphs, "contract", seen)
    got = {r["root_id"] for r in graphs.sound_models(nodes, rows, starts).collect()}
    assert got == want == {"tree", "alone"}
    assert searched == {"tree", "loop", "lost", "no root"}
