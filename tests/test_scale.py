"""What keeps the cost of the rules down: plans without sorts of whole tables, and the results that the cheaper forms must still give."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import ids, text
from sessionloom.operators import candidates, rules, trees
from sessionloom.plans import models

FOLDER = "/root/testdata/sf0.001"
NODE = "session_id string, root_id string, path string, parent_path string, node_id string, ordinal bigint, refs array<string>"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def spread(spark, refs, **options):
    rows = spark.createDataFrame([(r,) for r in refs], "r string")
    return [r[0] for r in rows.select(ids.expand_range(F.col("r"), **options)).collect()]


def test_references_spread_with_one_regular_expression(spark):
    refs = ["activity_0009-activity_0011", "subgoal_segment_0002", "activity_9999-activity_10000", "activity_0001\n", "activity_0003-activity_0002", "activity_1", "activity_0001-x", "activity_0001-subgoal_segment_0002", None, "", "activity_99999999999"]
    want = [["activity_0009", "activity_0010", "activity_0011"], ["subgoal_segment_0002"], ["activity_9999", "activity_10000"], ["activity_0001"], *[None] * 7]
    assert spread(spark, refs) == want
    assert spread(spark, ["activity_7-activity_11", "activity_007"], digits="+") == [[f"activity_{n}" for n in (7, 8, 9, 10, 11)], ["activity_007"]]
    rows = spark.createDataFrame([("activity_0001",)], "r string").select(ids.expand_range(F.col("r")))
    assert "regexp_extract" not in plan(rows)


def test_partition_aggregates_hold_no_sets(spark):
    rows = [("$", None, "1", 0, ["activity_0001-activity_0003"]), ("$.a", "$", "1.1", 1, ["activity_0001", "activity_0004"]), ("$.b", "$", "1.2", 2, ["activity_0001-activity_0002"]), ("$.c", "$", "1.3", 3, ["activity_0004"])]
    nodes = spark.createDataFrame([("s", "r", *r) for r in rows], NODE)
    found = rules.partition_rules(nodes)
    got = sorted((r["rule_id"], r["path"], r["detail"]) for r in found.collect())
    assert got == [
        ("V19", "$.a", "activity_0004"), ("V19", "$.c", "activity_0004"), ("V20", "$", "activity_0001"), ("V20", "$", "activity_0004"), ("V21", "$", "extra activity_0004"), ("V21", "$", "missing activity_0003"),
    ]
    assert "collect_set" not in plan(found)


def test_root_cover_needs_no_full_join(spark):
    nodes = spark.createDataFrame([("s", "r", "$", None, "1", 0, ["activity_0001", "activity_0009"]), ("s", "r", "$.a", "$", "1.1", 1, ["activity_0002"]), ("s", "q", "$", None, "1", 0, ["activity_0001"])], NODE)
    known = spark.createDataFrame([("s", "r", f"activity_{i:04d}", i) for i in (1, 2, 3)], "session_id string, root_id string, activity_id string, semantic_action_idx int")
    found = rules.root_cover_rules(nodes, known.drop("semantic_action_idx"), known)
    got = sorted((r["root_id"], r["rule_id"], r["detail"]) for r in found.collect())
    assert got == [("r", "V22", "extra activity_0009"), ("r", "V22", "missing activity_0002"), ("r", "V22", "missing activity_0003"), ("r", "V23", "missing 2"), ("r", "V23", "missing 3"), ("r", "V23t", "3")]
    assert "FullOuter" not in plan(found)


def test_ranges_of_whole_runs_are_not_put_in_order(spark):
    rows = spark.createDataFrame([("a", n) for n in (3, 1, 2, 2)] + [("b", n) for n in (1, 2, 9, 4, 5)] + [(None, 7)], "k string, n bigint")
    got = sorted((r["k"] or "", r["range_no"], r["ref"]) for r in trees.compact_ranges(rows, ["k"]).collect())
    assert got == [("", 1, "activity_0007"), ("a", 1, "activity_0001-activity_0003"), ("b", 1, "activity_0001-activity_0002"), ("b", 2, "activity_0004-activity_0005"), ("b", 3, "activity_0009")]


def test_candidate_stages_read_stored_models(spark):
    seen = []

    def check(made):
        seen.append(plan(made))
        return made.select("id", (F.col("id") > 1).alias("valid"), F.lit("low").alias("feedback"))

    stage = lambda rows: rows.withColumn("candidate", F.lit("c"))
    out = candidates.first_valid(spark.range(4), [("one", stage), ("two", stage)], check, ["id"])
    assert sorted((r["id"], r["origin"], r["valid"]) for r in out.collect()) == [(0, "two", False), (1, "two", False), (2, "one", True), (3, "one", True)]
    assert len(seen) == 2 and not any("Range" in p for p in seen)


def test_two_sides_are_compared_by_one_aggregate(spark):
    left, right = (spark.createDataFrame([("s", "r", x) for x in items], "session_id string, root_id string, item string") for items in (["a", "b", "b", None], ["b", "c", None]))
    found = rules.two_sided(left, right, ["session_id", "root_id"], "item", "V0")
    assert sorted(str(r["detail"]) for r in found.collect()) == ["None", "None", "extra c", "missing a"]
    assert "Join" not in plan(found)
    assert "Join" not in plan(models.rule_body_union(spark, FOLDER))


@pytest.mark.parametrize("size", [1, 79, 80, 81, 82, 177, 178, 180, 181, 182, 4000])
def test_limits_look_at_the_head_only(spark, size):
    values = ["x" * size, "-" * size, ("ab, " * size)[:size], " \n" * size + "y" * size, "--" + "a-" * size, "\u00e4" * size + "b"]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    got = rows.select(text.truncate(F.col("t")), text.clip(F.col("t"), 160), text.slug(F.col("t"), F.lit("none")))
    import re

    def want(v):
        line, flat = v.replace("\n", " ").strip(), re.sub(r"\s+", " ", v).strip()
        slug = re.sub("[^A-Za-z0-9]+", "_", v.lower().strip()).strip("_")[:80]
        return (line if len(line) <= 180 else line[:177] + "...", flat if len(flat) <= 160 else flat[:157].rstrip() + "...", slug or "none")

    assert [tuple(r) for r in got.collect()] == [want(v) for v in values]
    assert "substring" in plan(rows.select(text.truncate(F.col("t"))))
