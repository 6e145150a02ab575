"""Which activity owns which evidence, and which identifiers a source knows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import ids, text

MODEL = ["session_id", "root_id"]
# Keys that hold one identifier, keys that list identifiers, and keys that list references.
SCALAR_KEYS = (
    "activity_id", "semantic_action_id", "start_semantic_action_id", "end_semantic_action_id", "raw_action_id", "action_id", "start_action_id", "end_action_id",
)
LIST_KEYS = ("activity_ids", "semantic_action_ids", "raw_action_ids", "action_ids")
REFERENCE_KEYS = ("source_activity_ids", "subgoal_segments", "evidence_subgoal_segments")


def _none() -> Column:
    return F.array().cast("array<string>")


def nested_ids(fields: Iterable[T.StructField], at: Callable[[str], Column], lists: Sequence[str] = LIST_KEYS) -> Column:
    """All identifiers under known keys, at any depth of structs and arrays, as one array (nulls included)."""
    parts = []
    for field in fields:
        column, kind = at(field.name), field.dataType
        if field.name in SCALAR_KEYS and isinstance(kind, T.StringType):
            parts.append(F.array(column))
        elif field.name in lists and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            parts.append(F.coalesce(column, _none()))
        elif isinstance(kind, T.StructType):
            parts.append(F.coalesce(nested_ids(kind.fields, column.__getitem__, lists), _none()))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            parts.append(_below(column, kind.elementType.fields, lists))
    return F.concat(_none(), *parts)


def _below(column: Column, fields: Sequence[T.StructField], lists: Sequence[str]) -> Column:
    return F.coalesce(F.flatten(F.transform(column, lambda x: nested_ids(fields, x.__getitem__, lists))), _none())


def evidence_owners(activities: DataFrame) -> DataFrame:
    """(evidence id, owning activity) from the activity rows' own and nested identifiers."""
    fields = [f for f in activities.schema.fields if f.name not in MODEL]
    owned = activities.where(F.col("activity_id").rlike(r"^(activity|subgoal_segment)_\d{4,}$"))
    rows = owned.select(*MODEL, "activity_id", F.explode(nested_ids(fields, F.col)).alias("_e"))
    rows = rows.select(*MODEL, text.text_or_null(F.col("_e")).alias("evidence_id"), "activity_id")
    return rows.where(F.col("evidence_id").isNotNull()).distinct()


def known_ids(owners: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Every identifier of the source; ranges, listed or owned, count with all their members.

    references: session_id, root_id, refs array<string>.
    """
    known = owners.select(*MODEL, F.col("evidence_id").alias("_r"))
    if references is not None:
        known = known.unionByName(references.select(*MODEL, F.explode("refs").alias("_r")))
    spread = F.coalesce(ids.expand_range(F.col("_r")), F.array("_r"))
    return known.select(*MODEL, F.explode(spread).alias("evidence_id")).distinct()


def source_ids(sources: DataFrame) -> DataFrame:
    """(model, evidence id): everything a source names under known keys and reference lists, at any depth; ranges count with all their members."""
    fields = [f for f in sources.schema.fields if f.name not in MODEL]
    named = sources.select(*MODEL, F.explode(nested_ids(fields, F.col, (*LIST_KEYS, *REFERENCE_KEYS))).alias("_e"))
    rows = named.select(*MODEL, text.text_or_null(F.col("_e")).alias("_r")).where(F.col("_r").isNotNull())
    return rows.select(*MODEL, F.explode(F.coalesce(ids.expand_range(F.col("_r")), F.array("_r"))).alias("evidence_id")).distinct()


def semantic_index(activities: DataFrame) -> DataFrame:
    """(activity, semantic action number): from the listed ids, else from the index range."""
    parsed = F.filter(
        F.transform(F.coalesce("semantic_action_ids", F.array().cast("array<string>")),
                    lambda i: F.regexp_extract(i, r"^semantic_action_(\d+)$", 1).try_cast("bigint")),
        lambda n: n.isNotNull(),
    )
    start, end = F.col("start_semantic_action_idx").cast("bigint"), F.col("end_semantic_action_idx").cast("bigint")
    spread = F.when(start <= end, F.sequence(start, end))
    numbers = F.when(F.size(parsed) > 0, parsed).otherwise(spread)
    return activities.select(*MODEL, "activity_id", F.explode(numbers).alias("semantic_action_idx")).distinct()
