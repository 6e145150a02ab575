"""Joining models with each other and with the trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import ids, text

MODEL = ["session_id", "root_id"]
MAX_ACTIVITIES = 50
MAX_BYTES = 1_500_000


def _expanded(refs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(refs, lambda r: F.coalesce(ids.expand_range(r), F.array().cast("array<string>"))))))


def copy_grounding(unified: DataFrame, objective: DataFrame, fields: list[str]) -> DataFrame:
    """Objective fields copied onto unified nodes of the same id and the same, non-empty activities."""
    source = objective.select(*MODEL, "node_id", _expanded(F.col("refs")).alias("_refs"), *[F.col(f).alias(f"_o_{f}") for f in fields])
    target = unified.withColumn("_refs", _expanded(F.col("refs")))
    joined = target.join(source.where(F.size("_refs") > 0), [*MODEL, "node_id", "_refs"], "left")
    copied = {f: F.coalesce(f"_o_{f}", f) for f in fields}
    out = joined.withColumns(copied | {"grounding_copied": F.coalesce(*[F.col(f"_o_{f}").isNotNull() for f in fields[:1]])})
    return out.drop("_refs", *[f"_o_{f}" for f in fields])


def fill_leaves(exprs: DataFrame, activities: DataFrame) -> DataFrame:
    """Name and description of activity leaves from their activity; unmatched leaves stay as they are."""
    known = activities.select(*MODEL, "activity_id", F.col("objective").alias("_name"), F.col("additional_context").alias("_text"))
    out = exprs.join(known, [*MODEL, "activity_id"], "left")
    return out.withColumns({"name": F.coalesce("_name", "name"), "description": F.coalesce("_text", "description")}).drop("_name", "_text")


def pair_models(objective: DataFrame, procedure: DataFrame) -> DataFrame:
    """Objective and procedure models of the same file key; a session with one of each pairs them anyway.

    Both: session_id, file_key.
    """
    same = objective.join(procedure, ["session_id", "file_key"]).select("session_id", F.col("file_key").alias("objective_key"), F.col("file_key").alias("procedure_key"))
    single = lambda t, name: t.groupBy("session_id").agg(F.count(F.lit(1)).alias(f"_n_{name}"), F.min("file_key").alias(name))
    alone = single(objective, "objective_key").join(single(procedure, "procedure_key"), "session_id")
    alone = alone.where((F.col("_n_objective_key") == 1) & (F.col("_n_procedure_key") == 1) & (F.col("objective_key") != F.col("procedure_key")))
    return same.unionByName(alone.select("session_id", "objective_key", "procedure_key"))


def match_cached_roots(cached: DataFrame, inputs: DataFrame) -> DataFrame:
    """Cached roots joined to today's inputs by path, else by a base name that is unique on both sides.

    cached, inputs: session_id, path, base_name.  ``complete`` is true when every input of the session
    is matched exactly once and no cached root is left over.
    """
    exact = cached.join(inputs.select("session_id", "path", F.lit(1).alias("_e")), ["session_id", "path"], "left")
    by_path = exact.where(F.col("_e") == 1).select("session_id", F.col("path").alias("cached_path"), "path")
    rest_c = exact.where(F.col("_e").isNull()).select("session_id", F.col("path").alias("cached_path"), "base_name")
    rest_i = inputs.join(by_path.select("session_id", "path"), ["session_id", "path"], "left_anti")
    only = lambda t, keep: t.groupBy("session_id", "base_name").agg(F.count(F.lit(1)).alias("_n"), F.min(keep).alias(keep)).where(F.col("_n") == 1).drop("_n")
    by_name = only(rest_c, "cached_path").join(only(rest_i, "path"), ["session_id", "base_name"]).select("session_id", "cached_path", "path")
    matched = by_path.unionByName(by_name)
    count = lambda t, name: t.groupBy("session_id").agg(F.count(F.lit(1)).alias(name))
    sizes = count(inputs, "_i").join(count(cached, "_c"), "session_id", "full").join(count(matched, "_m"), "session_id", "left")
    complete = (F.col("_i") == F.coalesce("_m", F.lit(0))) & (F.col("_c") == F.coalesce("_m", F.lit(0)))
    return matched.join(sizes.select("session_id", F.coalesce(complete, F.lit(False)).alias("complete")), "session_id")


def session_bundle(manifest: DataFrame, derived: DataFrame, objective: DataFrame, procedure: DataFrame, unified: DataFrame) -> DataFrame:
    """Threads of a session with whatever models exist for them (all keyed by session_id, root_id)."""
    out = manifest.join(derived, MODEL)
    for table in (objective, procedure, unified):
        out = out.join(table, MODEL, "left")
    return out


def activity_threads(members: DataFrame) -> DataFrame:
    """Thread of each activity; where threads overlap the later one of the manifest wins."""
    return members.groupBy("session_id", "activity_id").agg(F.max_by("root_id", "manifest_order").alias("root_id"))


def trace_table(activities: DataFrame, membership: DataFrame) -> DataFrame:
    """Report rows of the trace: position, thread or ``unassigned``, id, objective, context, events."""
    out = activities.join(membership, ["session_id", "activity_id"], "left")
    return out.select(
        "session_id", "position", F.coalesce("root_id", F.lit("unassigned")).alias("thread"), "activity_id", "objective",
        text.or_empty(F.col("additional_context")).alias("additional_context"), "event_count",
    )


def route(models: DataFrame, inclusive: bool, max_activities: int = MAX_ACTIVITIES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One direct call or an agent run, by activities and serialized size.

    The objective stage allows exactly ``max_activities`` (inclusive); the later stages do not.  An
    unreadable document (null) counts as too large.
    """
    few = F.col("n_activities") <= max_activities if inclusive else F.col("n_activities") < max_activities
    small = F.coalesce(F.col("doc_bytes") <= max_bytes, F.lit(False))
    return models.withColumn("route", F.when(few & small, "direct").otherwise("agent"))


def large_sequences(exprs: DataFrame, min_leaves: int = 8) -> DataFrame:
    """SEQ nodes with many activity leaves among their steps: worth a second look for loops."""
    leaf = (F.col("kind") == "activity") & (F.col("slot") == "steps")
    counts = exprs.groupBy(*MODEL, "node_id").agg(F.count_if(leaf).alias("n_leaves"), F.max("node_operator").alias("node_operator"))
    return counts.where((F.col("node_operator") == "SEQ") & (F.col("n_leaves") >= min_leaves))
