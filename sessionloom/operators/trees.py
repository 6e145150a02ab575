"""Objective trees as node tables: coverage, closure over descendants, leaves, ranges, positions.

nodes: session_id, root_id, path (unique), parent_path, node_id, ordinal, depth, refs array<string>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import ids
from sessionloom.operators.sequence import islands, order_sessions
from sessionloom.session import cut_lineage

MODEL = ["session_id", "root_id"]
NODE = [*MODEL, "path"]


def coverage(nodes: DataFrame, prefixes: tuple[str, ...] = ids.ACTIVITY_AND_SEGMENT) -> DataFrame:
    """(node, reference place, activity id): every reference expanded; malformed ones yield nothing."""
    refs = nodes.select(*NODE, F.posexplode("refs").alias("ref_no", "ref"))
    return refs.select(*NODE, "ref_no", F.explode(ids.expand_range(F.col("ref"), prefixes)).alias("activity_id"))


def ancestor_ids(nodes: DataFrame) -> DataFrame:
    """Every node paired with itself and its ancestors, read off the dotted id (no recursion)."""
    parts = F.split("node_id", r"\.")
    depths = F.explode(F.sequence(F.lit(1), F.size(parts)))
    rows = nodes.select(*MODEL, "node_id", parts.alias("_p"), depths.alias("_d"))
    return rows.select(*MODEL, "node_id", F.array_join(F.slice("_p", F.lit(1), F.col("_d")), ".").alias("ancestor_id"))


def subtree_coverage(nodes: DataFrame) -> DataFrame:
    """(node id, activity): activities of the node and of all its descendants."""
    direct = coverage(nodes).join(nodes.select(*NODE, "node_id"), NODE).select(*MODEL, "node_id", "activity_id").distinct()
    up = ancestor_ids(nodes.select(*MODEL, "node_id").distinct())
    return direct.join(up, [*MODEL, "node_id"]).select(*MODEL, F.col("ancestor_id").alias("node_id"), "activity_id").distinct()


def leaves(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(*MODEL, F.col("parent_path").alias("path")).where(F.col("path").isNotNull()).distinct()
    return nodes.join(parents, NODE, "left_anti")


def ref_counts(nodes: DataFrame) -> DataFrame:
    """Number of references and of distinct activities behind them, per node."""
    spread = F.flatten(F.transform("refs", lambda r: F.coalesce(ids.expand_range(r), F.array().cast("array<string>"))))
    return nodes.select(*NODE, F.size("refs").alias("n_refs"), F.size(F.array_distinct(spread)).alias("n_activities"))


def compact_ranges(rows: DataFrame, keys: list[str], prefix: str = "activity", number: str = "n") -> DataFrame:
    """Maximal runs of consecutive numbers per group, as id ranges (one row per run, in order).

    A group with as many numbers as there are from its first to its last is one run; only the others are put in order.
    """
    numbers = cut_lineage(rows.select(*keys, F.col(number).cast("bigint").alias("n")).distinct())
    spans = numbers.groupBy(*keys).agg(F.min("n").alias("start_no"), F.max("n").alias("end_no"), F.count(F.lit(1)).alias("_n"))
    one_run = F.coalesce(F.col("end_no") - F.col("start_no") + 1 == F.col("_n"), F.lit(False))
    gaps = spans.where(~one_run).select(*(F.col(c).alias(f"_of_{c}") for c in keys))
    rest = numbers.join(gaps, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], "left_semi")
    so = order_sessions(rest, keys, "n")
    so = so.neighbours(prev={"_prev": "n"})
    so = islands(so, F.coalesce(F.col("_prev") + 1 != F.col("n"), F.lit(True)), "range_no")
    out = so.rows.groupBy(*keys, "range_no").agg(F.min("n").alias("start_no"), F.max("n").alias("end_no"))
    out = out.unionByName(spans.where(one_run).select(*keys, F.lit(1).cast("bigint").alias("range_no"), "start_no", "end_no"))
    return out.withColumn("ref", ids.range_text(prefix, F.col("start_no"), F.col("end_no")))


def timeline(covered: DataFrame, positions: DataFrame, totals: DataFrame) -> DataFrame:
    """Marks of a coverage bar: left edge and width in percent of the session's activities.

    covered: session_id, node_id, activity_id.  positions: session_id, activity_id, position.  totals: session_id, total.
    """
    rows = covered.join(positions, ["session_id", "activity_id"]).join(totals, "session_id")
    total = F.col("total").cast("double")
    return rows.withColumns(
        {"left_pct": F.col("position") / total * 100, "width_pct": F.greatest(F.lit(0.4), F.lit(100.0) / total)}
    )


def tree_lines(nodes: DataFrame) -> DataFrame:
    """Report lines of a tree in pre-order; ``sort_key`` orders them inside the model."""
    padded = F.transform(F.split("node_id", r"\."), lambda p: F.lpad(p, 8, "0"))
    line = F.concat(
        F.repeat(F.lit("  "), F.col("depth")), F.lit("- **"), F.col("node_id"), F.lit("** "), F.col("objective"),
        F.lit(" ("), F.array_join("refs", ", "), F.lit(")"),
    )
    return nodes.select(*MODEL, "node_id", F.array_join(padded, ".").alias("sort_key"), line.alias("line"))
