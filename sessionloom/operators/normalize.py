"""Older model forms to today's: grounding, tree ids and coverage, compact ids for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import ids, text
from sessionloom.functions.bind import let
from sessionloom.operators.sequence import order_sessions
from sessionloom.operators.trees import MODEL, NODE, compact_ranges, coverage
from sessionloom.operators.rules import OUTCOME_STATUSES
from sessionloom.schemas import CRITERION, DELIVERABLE, OUTCOME

DEFAULT_KIND = "artifact_or_state"
NO_OUTCOME = "The available evidence does not independently verify completion."


def _list(value: Column, ddl: str) -> Column:
    return F.coalesce(F.from_json(value, f"array<{ddl}>"), F.from_json(F.lit("[]"), f"array<{ddl}>"))


def _refs(own: Column, fallback: Column) -> Column:
    return F.when(F.size(text.unique_texts(own)) > 0, text.unique_texts(own)).otherwise(fallback)


def grounding(nodes: DataFrame, body: str = "body") -> DataFrame:
    """Deliverables, criteria, outcome and evidence of each node from its JSON body, old text forms included.

    nodes: objective, refs (fallback evidence), body (JSON).
    """
    fields = ["objective_grounding", "evidence_refs", "deliverables", "success_criteria", "observed_outcome", "deliverable"]
    schema = ", ".join(f"{f} string" for f in fields)  # nested values stay JSON text until they are needed
    rows = nodes.withColumn("_b", F.from_json(body, schema))
    nested = F.ltrim(F.col("_b.objective_grounding")).startswith("{")
    rows = rows.withColumn("_s", F.when(nested, F.from_json("_b.objective_grounding", schema)).otherwise(F.col("_b")))
    spread = F.array_distinct(F.flatten(F.transform("refs", lambda r: F.coalesce(ids.expand_range(r), F.array(r)))))
    given = F.coalesce(F.from_json("_s.evidence_refs", "array<string>"), F.array().cast("array<string>"))
    rows = rows.withColumn("_ev", let(given, lambda g: _refs(g, spread)))
    is_list = lambda c: F.ltrim(c).startswith("[")
    old_text = lambda name: F.when(~F.ltrim(f"_b.{name}").rlike(r"^[\[{]"), text.text_or_null(F.col(f"_b.{name}")))
    target = F.coalesce(old_text("deliverable"), text.text_or_null(F.col("_s.deliverable")), text.text_or_null(F.col("objective")), F.lit("Objective outcome"))
    complete = lambda t: F.concat(F.lit("The "), t, F.lit(" is complete."))
    rows = rows.withColumn("_target", target)
    rows = rows.withColumn("_state", F.coalesce(old_text("success_criteria"), complete(F.col("_target"))))
    ev = F.col("_ev")

    def item(x: Column) -> Column:
        t = text.strip(x["target"])
        return F.struct(
            F.coalesce(text.text_or_null(x["kind"]), F.lit(DEFAULT_KIND)).alias("kind"), t.alias("target"),
            F.coalesce(text.text_or_null(x["expected_state"]), complete(t)).alias("expected_state"), _refs(x["evidence_refs"], ev).alias("evidence_refs"),
        )

    def criterion(x: Column) -> Column:
        return F.struct(
            text.strip(x["predicate"]).alias("predicate"), F.coalesce(text.text_or_null(x["verifier"]), F.lit("unknown")).alias("verifier"),
            _refs(x["evidence_refs"], ev).alias("evidence_refs"), x["confidence"].alias("confidence"),
        )

    keep = lambda items, field: F.filter(items, lambda x: text.filled(text.strip(x[field])))
    items = F.transform(keep(_list(F.when(is_list(F.col("_s.deliverables")), F.col("_s.deliverables")), DELIVERABLE), "target"), item)
    criteria = F.transform(keep(_list(F.when(is_list(F.col("_s.success_criteria")), F.col("_s.success_criteria")), CRITERION), "predicate"), criterion)
    one_item = F.array(F.struct(F.lit(DEFAULT_KIND).alias("kind"), F.col("_target").alias("target"), F.col("_state").alias("expected_state"), ev.alias("evidence_refs")))
    one_criterion = F.array(F.struct(F.col("_state").alias("predicate"), F.lit("unknown").alias("verifier"), ev.alias("evidence_refs"), F.lit(None).cast("double").alias("confidence")))
    rows = rows.withColumn("_o", F.from_json("_s.observed_outcome", OUTCOME))
    outcome = F.col("_o")
    status = text.strip(F.coalesce(outcome["status"], F.lit("unknown")))
    out = rows.withColumns(
        {
            "deliverables": let(items, lambda d: F.when(F.size(d) > 0, d).otherwise(one_item)),
            "success_criteria": let(criteria, lambda c: F.when(F.size(c) > 0, c).otherwise(one_criterion)),
            "observed_outcome": F.struct(
                F.when(status.isin(OUTCOME_STATUSES), status).otherwise("unknown").alias("status"),
                F.coalesce(text.text_or_null(outcome["description"]), F.lit(NO_OUTCOME)).alias("description"),
                text.unique_texts(outcome["evidence_refs"]).alias("evidence_refs"),
            ),
            "evidence_refs": ev,
        }
    )
    return out.drop("_ev", "_target", "_state", "_b", "_s", "_o")


def position_ids(nodes: DataFrame, root_ids: DataFrame) -> DataFrame:
    """Node ids rebuilt from places: the root's id and the ordinals in the path."""
    ordinals = F.transform(F.regexp_extract_all("path", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: (n.cast("int") + 1).cast("string"))
    named = nodes.join(root_ids.select(*MODEL, "source_root_id"), MODEL, "left")
    return named.withColumn("node_id", F.array_join(F.concat(F.array(F.coalesce("source_root_id", "root_id")), ordinals), ".")).drop("source_root_id")


def fill_references(nodes: DataFrame, source_activities: DataFrame) -> DataFrame:
    """References where a node has none: the root takes the source's activities, inner nodes their descendants'.

    The path prefix names the ancestors, so one aggregate replaces a bottom-up walk.
    """
    empty = nodes.where(F.size("refs") == 0).select(*NODE, "parent_path")
    number = ids.id_number(F.col("activity_id")).alias("n")
    above = F.explode(F.slice(_ancestor_paths(F.col("path")), F.lit(1), F.size(F.split("path", r"\.")) - 1)).alias("path")
    up = coverage(nodes).select(*NODE, number).select(*MODEL, above, "n").join(empty, NODE, "left_semi")
    root = empty.where(F.col("parent_path").isNull()).select(*NODE).join(source_activities.select(*MODEL, number), MODEL).select(*NODE, "n")
    ranges = compact_ranges(up.unionByName(root).where(F.col("n").isNotNull()), NODE)
    filled = ranges.groupBy(*NODE).agg(text.ordered_collect("range_no", "ref").alias("_refs"))
    out = nodes.join(filled, NODE, "left")
    return out.withColumn("refs", F.when(F.size("refs") == 0, F.coalesce("_refs", "refs")).otherwise(F.col("refs"))).drop("_refs")


def _ancestor_paths(path: Column) -> Column:
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "."))


def requires_decomposition(sources: DataFrame) -> DataFrame:
    """sources: n_activities, source_children."""
    return sources.withColumn("requires_decomposition", (F.col("n_activities") > 1) | (F.col("source_children") > 0))


# ---- compact ids -----------------------------------------------------------------------------


def dense_ids(activities: DataFrame, order: str) -> DataFrame:
    """Activity ids numbered 0, 1, 2 ... per model in order of first appearance."""
    first = activities.where(F.col("activity_id").rlike(r"^(activity|subgoal_segment)_\d{4,}$")).groupBy(*MODEL, "activity_id").agg(F.min(order).alias("_o"))
    return order_sessions(first, MODEL, ("_o", "activity_id")).index("n").df.drop("_o")


def compact_references(refs: DataFrame, numbers: DataFrame) -> DataFrame:
    """References as plain numbers for a prompt: 3 or 3-7; unknown ids keep their own number.  refs: ref."""
    pattern = r"^((?:activity|subgoal_segment)_\d{4,})(?:-((?:activity|subgoal_segment)_\d{4,}))?$"
    left, right = F.regexp_extract("ref", pattern, 1), F.regexp_extract("ref", pattern, 2)
    rows = refs.withColumns({"_l": left, "_r": right})
    side = lambda c: numbers.select(*MODEL, F.col("activity_id").alias(c), F.col("n").alias(f"{c}n"))
    rows = rows.join(side("_l"), [*MODEL, "_l"], "left").join(side("_r"), [*MODEL, "_r"], "left")
    number = lambda c: F.coalesce(F.col(f"{c}n"), ids.id_number(F.col(c)).cast("bigint")).cast("string")
    short = F.when(F.col("_r") == "", number("_l")).otherwise(F.concat(number("_l"), F.lit("-"), number("_r")))
    return rows.withColumn("compact", F.when(F.col("_l") == "", F.col("ref")).otherwise(short)).drop("_l", "_r", "_ln", "_rn")


def restore_references(answers: DataFrame, numbers: DataFrame, keys: list[str]) -> DataFrame:
    """Compact numbers back to id ranges.  answers: keys..., compact; the result has one row per range."""
    left = F.regexp_extract("compact", r"^(\d+)(?:-(\d+))?$", 1).try_cast("bigint")
    right = F.coalesce(F.regexp_extract("compact", r"^(\d+)-(\d+)$", 2).try_cast("bigint"), left)
    spread = answers.select(*keys, F.explode(F.sequence(left, F.greatest(left, right))).alias("n"))
    known = spread.join(numbers.select(*MODEL, "n", "activity_id"), [*MODEL, "n"], "left")
    back = known.select(*keys, F.coalesce("activity_id", ids.padded("subgoal_segment_", F.col("n"))).alias("activity_id"))
    parts = back.select(*keys, F.regexp_extract("activity_id", r"^(.*)_\d+$", 1).alias("prefix"), ids.id_number(F.col("activity_id")).alias("n"))
    ranges = compact_ranges(parts, [*keys, "prefix"])
    return ranges.withColumn("ref", ids.range_text(F.col("prefix"), F.col("start_no"), F.col("end_no")))
