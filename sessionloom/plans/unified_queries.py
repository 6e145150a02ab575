"""Unified models from orders: an order is a model of one node, its lines are the body's steps; faults come from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.operators import unified
from sessionloom.plans.base import query, table
from sessionloom.plans.standins import with_ctes
from sessionloom.session import cut_lineage

UNIFIED_SQL = """
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS root_id, CAST(l_orderkey AS BIGINT) AS ok,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal,
    CASE WHEN l_partkey % 41 = 0 THEN ' ' ELSE concat('step ', l_partkey) END AS name, CAST(l_partkey AS BIGINT) AS part, CAST(l_suppkey AS BIGINT) AS supp FROM lineitem
),
steps AS (
  SELECT root_id, ok, ordinal, name, CASE WHEN part % 37 = 0 THEN [] WHEN part % 5 = 0 THEN [ordinal * 3, ordinal * 3 + 1 + supp % 4] ELSE [ordinal * 3] END AS refs FROM lines
),
own AS (SELECT root_id, ok, unnest(refs) AS ref FROM steps),
node_refs AS (SELECT DISTINCT root_id, ok, ref FROM own WHERE NOT (ok % 11 = 0 AND ref = 3) UNION SELECT DISTINCT root_id, ok, 1000 FROM lines WHERE ok % 13 = 0),
shape AS (
  SELECT root_id, 'V41' AS rule_id, concat('version ', CASE WHEN ok % 28 = 1 THEN 'none' ELSE '0.1' END) AS detail FROM (SELECT DISTINCT root_id, ok FROM lines) WHERE ok % 14 = 1
  UNION ALL SELECT root_id, 'V41', 'extra cost' FROM (SELECT DISTINCT root_id, ok FROM lines) WHERE ok % 17 = 2
),
deeper AS (
  SELECT root_id, 'V42' AS rule_id, concat('name ', ordinal) AS detail FROM steps WHERE trim(name) = ''
  UNION ALL SELECT root_id, 'V42', concat('refs ', ordinal) FROM steps WHERE len(refs) = 0
  UNION ALL SELECT DISTINCT a.root_id, 'V43', concat('overlap ', a.ordinal) FROM (SELECT root_id, ordinal, unnest(refs) AS ref FROM steps) a
    JOIN (SELECT root_id, ordinal, unnest(refs) AS ref FROM steps) b ON a.root_id = b.root_id AND a.ref = b.ref AND b.ordinal < a.ordinal
  UNION ALL SELECT root_id, 'V43', concat('order ', ordinal) FROM (
    SELECT root_id, ok, ordinal, list_min(refs) AS low, lag(list_max(refs)) OVER (PARTITION BY root_id ORDER BY ordinal) AS before FROM steps WHERE len(refs) > 0 AND ok % 2 = 0)
    WHERE low <= before
  UNION ALL SELECT DISTINCT root_id, 'V45', concat('outside ', ref) FROM own WHERE ok % 11 = 0 AND ref = 3
  UNION ALL SELECT DISTINCT root_id, 'V45', 'missing 1000' FROM lines WHERE ok % 13 = 0 AND ok % 3 <> 0
)
"""


# What orders a model's steps.
PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _step(ordinal: Column, part: Column, supp: Column) -> tuple[Column, Column]:
    """Name and references of a step."""
    at = ordinal * 3
    refs = F.when(part % 37 == 0, F.array().cast("array<bigint>")).when(part % 5 == 0, F.array(at, at + 1 + supp % 4)).otherwise(F.array(at))
    return F.when(part % 41 == 0, " ").otherwise(F.concat(F.lit("step "), part.cast("string"))), refs


def _claims(body: Column) -> Column:
    """References of the node over those of its body."""
    kept = F.filter(body, lambda r: ~((F.col("ok") % 11 == 0) & (r == 3)))
    return F.when(F.col("ok") % 13 == 0, F.concat(kept, F.array(F.lit(1000).cast("bigint")))).otherwise(kept)


def _outer() -> list[Column]:
    """Version and keys of the outer object."""
    ok = F.col("ok")
    keys = F.when(ok % 17 == 2, F.array(F.lit("version"), F.lit("root"), F.lit("cost"))).otherwise(F.array(F.lit("version"), F.lit("root")))
    return [F.when(ok % 28 == 1, F.lit(None)).when(ok % 14 == 1, "0.1").otherwise("0.2").alias("version"), keys.alias("keys")]


def _kind() -> list[Column]:
    return [(F.col("ok") % 3 != 0).alias("is_leaf"), F.when(F.col("ok") % 2 == 0, "SEQ").otherwise("FOR").alias("operator")]


def unified_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line items as tables of models, nodes and steps."""
    order = Window.partitionBy("l_orderkey").orderBy(*PLACE)
    ok, part, supp = (F.col(c).cast("bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    lines = rows.select(
        F.lit("s").alias("session_id"), ok.cast("string").alias("root_id"), F.lit("$.root").alias("path"), ok.alias("ok"),
        F.row_number().over(order).cast("bigint").alias("ordinal"), part.alias("part"), supp.alias("supp"),
    )
    name, refs = _step(F.col("ordinal"), F.col("part"), F.col("supp"))
    steps = lines.withColumns({"refs": refs, "name": name})
    body = F.array_distinct(F.flatten(F.collect_list("refs")))
    nodes = steps.groupBy("session_id", "root_id", "path", "ok").agg(body.alias("body"))
    models = nodes.select("session_id", "root_id", *_outer())
    nodes = nodes.select("session_id", "root_id", "path", "ok", _claims(F.col("body")).alias("refs"), *_kind())
    return models, nodes, steps.select("session_id", "root_id", "path", "ordinal", "name", "refs")


def unified_models(rows: DataFrame) -> DataFrame:
    """Line items as models that hold their parts, a row each."""
    ok = F.col("l_orderkey").cast("bigint")
    models = rows.select(ok.alias("ok"), F.struct(*PLACE).alias("p")).groupBy("ok").agg(F.array_sort(F.collect_list("p")).alias("lines"))

    def step(line: Column, i: Column) -> Column:
        ordinal = (i + 1).cast("bigint")
        name, refs = _step(ordinal, line["l_partkey"].cast("bigint"), line["l_suppkey"].cast("bigint"))
        return F.struct(ordinal.alias("ordinal"), name.alias("name"), refs.alias("refs"))

    models = models.select("ok", F.transform("lines", step).alias("steps"))
    body = F.array_distinct(F.flatten(F.transform("steps", lambda s: s["refs"])))
    node = F.struct(F.lit("$.root").alias("path"), *_kind(), _claims(body).alias("refs"), F.col("steps").alias("steps"))
    return models.select(F.lit("s").alias("session_id"), F.col("ok").cast("string").alias("root_id"), *_outer(), F.array(node).alias("nodes"))


def _by_size(spark: SparkSession, folder: str, small, large) -> DataFrame:
    """Models of up to `unified.STEPS` steps in their own row, the others, if there are any, over tables."""
    lines = table(spark, folder, "lineitem")
    many = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unified.STEPS).select("l_orderkey")
    if many.isEmpty():
        return small(unified_models(lines))
    many = cut_lineage(many)
    return small(unified_models(lines.join(many, "l_orderkey", "left_anti"))).unionByName(large(*unified_rows(lines.join(many, "l_orderkey", "left_semi"))))


@query(
    "rule_unified",
    with_ctes(UNIFIED_SQL) + "SELECT * FROM shape UNION ALL SELECT * FROM deeper WHERE root_id NOT IN (SELECT root_id FROM shape)",
)
def rule_unified(spark: SparkSession, folder: str) -> DataFrame:
    found = _by_size(spark, folder, unified.model_rules, unified.unified_rules)
    return found.select("root_id", "rule_id", "detail")


@query(
    "model_cache_accept",
    with_ctes(UNIFIED_SQL)
    + "SELECT DISTINCT root_id FROM lines WHERE root_id NOT IN (SELECT root_id FROM shape) AND root_id NOT IN (SELECT root_id FROM deeper)",
)
def model_cache_accept(spark: SparkSession, folder: str) -> DataFrame:
    return _by_size(spark, folder, lambda m: unified.accepted_models(m).select("root_id"), lambda *tables: unified.accepted(*tables).select("root_id"))
