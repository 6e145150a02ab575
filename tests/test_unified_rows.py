"""Rules over unified models in their own row against the same rules over tables."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import unified
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


def _models(spark):
    rng = random.Random(5)
    refs = lambda: [rng.randint(1, 9) for _ in range(rng.choice([0, 1, 1, 2, 3]))]

    def node(place):
        steps = [(i, rng.choice(["a", "a", "a", " ", None]), refs() if rng.random() < 0.95 else None) for i in rng.sample(range(1, 20), rng.choice([0, 1, 2, 3, 5]))]
        body = sorted({r for _, _, own in steps for r in own or []})
        return f"$.root{place}", rng.random() < 0.5, rng.choice(["SEQ", "FOR", None]), body if rng.random() < 0.5 else refs(), steps

    outer = lambda: (rng.choice(["0.2"] * 8 + ["0.1", None]), rng.choice([["version", "root"]] * 8 + [["root"], ["version", "root", "cost", "a"]]))
    rows = [("s", f"m{i}", *outer(), [node(p) for p in range(rng.choice([1, 1, 2, 4]))]) for i in range(500)]
    step = "struct<ordinal: bigint, name: string, refs: array<bigint>>"
    nodes = f"array<struct<path: string, is_leaf: boolean, operator: string, refs: array<bigint>, steps: array<{step}>>>"
    return spark.createDataFrame(rows, f"session_id string, root_id string, version string, keys array<string>, nodes {nodes}")


def test_models_in_rows_break_the_rules_of_the_tables(spark):
    models = _models(spark)
    nodes = models.select("session_id", "root_id", F.explode("nodes").alias("n")).select("session_id", "root_id", "n.*")
    steps = nodes.select("session_id", "root_id", "path", F.explode("steps").alias("x")).select("session_id", "root_id", "path", "x.*")
    parts = models.drop("nodes"), nodes.drop("steps"), steps
    plain = lambda df: sorted(tuple(r) for r in df.select("root_id", "path", "rule_id", "severity", "detail").collect())
    got = plain(unified.model_rules(models))
    assert got == plain(unified.unified_rules(*parts)) and {r[2] for r in got} == {"V41", "V42", "V43", "V45"} and len(got) > 500
    good = {r["root_id"] for r in unified.accepted_models(models).collect()}
    assert good == {r["root_id"] for r in unified.accepted(*parts).collect()} and good
    assert "Exchange" not in unified.model_rules(models)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["rule_unified", "model_cache_accept"])
def test_orders_too_large_for_a_row(spark, tmp_path, name):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    key = lambda k: F.lit(k).cast(lines.schema["l_orderkey"].dataType)
    first, other = (lines.limit(1_300).withColumn("l_orderkey", key(k)) for k in (1_000_001, 1_000_010))
    both = lines.unionByName(first).unionByName(other).toArrow()
    pq.write_table(both, tmp_path / "lineitem.parquet", coerce_timestamps="us")
    assert compare(spark, name, str(tmp_path)) > 0


def test_rules_shuffle_the_lines_once(spark):
    """Before, models, nodes and steps were made apart, and every rule dealt its rows out again."""
    from __spark_entry__ import queries

    plan = queries()["rule_unified"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
