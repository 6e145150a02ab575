"""Rules over trees in their own row against the same rules over the node table."""

import json
import random

from pyspark.sql import functions as F

from sessionloom.operators import tree_rows
from sessionloom.plans import enrichment


def _node(rng, n, depth):
    ids = lambda p, w=4: f"{p}_{rng.randint(0, n + 1):0{w}d}"
    refs = [
        rng.choice([
            ids("activity"), ids("activity"), f"{ids('activity')}-{ids('activity')}", ids("subgoal_segment"), ids("activity", 5), "activity_12", "odd", "", f"{ids('activity')}-{ids('subgoal_segment')}",
            f"activity_0001-activity_{n:04d}", f"activity_0001-activity_{n:04d}\n", "activity_99999999999", "activity_0002-x",
        ])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))
    ]
    children = [_node(rng, n, depth + 1) if rng.random() < 0.95 else "no node" for _ in range(rng.choice([0, 0, 1, 2, 3]) if depth < 4 else 0)]
    return {"id": "x", rng.choice(["subgoal_segments", "activity_refs"]): refs, "decomposition": children}


def _whole(a, b):
    """A tree without a fault."""
    ref = [f"activity_{a:04d}-activity_{b:04d}"] if a < b else [f"activity_{a:04d}"]
    half = (a + b) // 2
    return {"subgoal_segments": ref if b - a < 2 else [], "decomposition": [] if b - a < 2 else [_whole(a, half), _whole(half + 1, b)]}


def _made(spark):
    rng = random.Random(7)
    rows = [("s", f"r{i}", n, json.dumps(_node(rng, n, 0))) for i in range(400) for n in [rng.randint(1, 6)]]
    rows += [("s", f"w{n}", n, json.dumps(_whole(1, n))) for n in range(1, 30)]
    rows += [("s", "wide", 100, json.dumps(_whole(1, 100))), ("s", "long", 5_000, json.dumps(_whole(1, 2))), ("s", "far", 3, json.dumps({"subgoal_segments": ["activity_0001-activity_9999"]}))]
    return spark.createDataFrame(rows, "session_id string, root_id string, n long, candidate string")


def test_trees_in_rows_break_the_rules_of_the_node_table(spark):
    made = _made(spark)
    got = {r["root_id"]: (r["valid"], r["feedback"]) for r in enrichment.judged_trees(made).collect()}
    want = {r["root_id"]: (r["feedback"] == "", r["feedback"]) for r in enrichment._large_trees_told(made).collect()}
    assert got == want and len(got) == 432
    assert len(set(got.values())) > 8 and got["w29"] == (True, "") and got["wide"] == (True, "")


def test_only_large_trees_leave_their_row_and_none_is_shuffled(spark):
    made = _made(spark)
    known = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.format_string("activity_%04d", i))
    rows = tree_rows.broken_rules(made.withColumnRenamed("candidate", "value"), F.col("n"), known, F.col("n") > 1)
    assert {r["root_id"] for r in rows.where("rules is null").collect()} == {"wide", "long", "far"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
