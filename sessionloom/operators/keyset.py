"""Exactly the keys of a schema, at every depth of a JSON document.

A schema is a nested dictionary: key to None (a value), a dictionary (an object) or a list of one dictionary (objects). Each object of a document that the schema
names becomes a row with its place and its keys; rules compare these with the keys that the schema has there. Keys ending in ``?`` may be absent; a
schema with the key ``*`` allows any other key.
A tree that nests itself is flattened to one document a node first (`flatten.tree_nodes`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import answers
from sessionloom.functions.bind import let
from sessionloom.operators.rules import MODEL, findings

Schema = dict

# The keys of stored rows and model parts.
TRAJECTORY: Schema = dict.fromkeys(["id", "action", "state_before?", "state_after?", "time_before?", "time_after?", "time_range?"])
DELIVERABLE: Schema = dict.fromkeys(["kind", "target", "expected_state", "evidence_refs"])
CRITERION: Schema = dict.fromkeys(["predicate", "verifier", "evidence_refs", "confidence"])
OUTCOME: Schema = dict.fromkeys(["status", "description", "evidence_refs"])
OBJECTIVE_NODE: Schema = {
    **dict.fromkeys(["id", "objective", "summary", "evidence_refs", "subgoal_segments", "decomposition?"]),
    "deliverables": [DELIVERABLE], "success_criteria": [CRITERION], "observed_outcome": OUTCOME,
}
UNIFIED_STEP: Schema = dict.fromkeys(["name", "activity_refs", "description?"])
UNIFIED_PROCEDURE: Schema = {
    **dict.fromkeys(["operator", "name", "description?", "condition?", "condition_grounding?", "bindings?", "evidence_summary?"]), "body": [UNIFIED_STEP],
}
UNIFIED_NODE: Schema = {
    **dict.fromkeys(["id", "objective", "evidence_refs", "activity_refs", "decomposition?", "summary?"]),
    "deliverables": [DELIVERABLE], "success_criteria": [CRITERION], "observed_outcome": OUTCOME, "procedure": UNIFIED_PROCEDURE,
}
FOR_BINDINGS: Schema = dict.fromkeys(["iteration_variable", "collection"])
WHILE_GROUNDING: Schema = dict.fromkeys(["predicate", "verifier", "observed_status", "evidence_refs"])

PROCEDURE_NODE: Schema = dict.fromkeys(["id", "name", "operator", "description", "activity_refs", "evidence_summary", "*"])
PROCEDURE_MODEL: Schema = {**dict.fromkeys(["version", "root_procedure_id"]), "procedure_nodes": [PROCEDURE_NODE]}

_PLACE = "array<struct<place: string, found: array<string>, required: array<string>, allowed: array<string>>>"


def _places(value: Column, schema: Schema, place: Column) -> Column:
    """Every object that the schema names, with its keys; null keys mean that something else stands there."""
    names = {key.rstrip("?"): (part, not key.endswith("?")) for key, part in schema.items() if key != "*"}
    required = F.array(*(F.lit(k) for k, (_, must) in names.items() if must)).cast("array<string>").alias("required")
    allowed = F.array(*(F.lit(k) for k in names)).cast("array<string>")
    # A map of the fields holds the keys; the object is not written as text to read them.
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string, variant>"))
    own = let(keys, lambda found: F.struct(place.alias("place"), found.alias("found"), required, (found if "*" in schema else allowed).alias("allowed")))
    out = F.array(own).cast(_PLACE)
    none = F.array().cast(_PLACE)
    for key, (part, _) in names.items():
        if isinstance(part, dict):
            out = F.concat(out, let(F.try_variant_get(value, f"$.{key}", "variant"), _inner(part, F.concat(place, F.lit(f".{key}")), none)))
        elif isinstance(part, list):
            items = F.try_variant_get(value, f"$.{key}", "array<variant>")
            out = F.concat(out, F.coalesce(F.flatten(F.transform(items, _each(part[0], F.concat(place, F.lit(f".{key}["))))), none))
    return out


def _inner(schema: Schema, place: Column, none: Column) -> Callable[[Column], Column]:
    # An absent or null object is the required key's matter, not its own.
    return lambda inner: F.when(inner.isNotNull() & ~F.is_variant_null(inner), _places(inner, schema, place)).otherwise(none)


def _each(schema: Schema, place: Column) -> Callable[[Column, Column], Column]:
    return lambda item, i: _places(item, schema, F.concat(place, i.cast("string"), F.lit("]")))


def object_keys(documents: DataFrame, schema: Schema, value: str = "value") -> DataFrame:
    """One row per object of each document that the schema names: place, found, required, allowed. Other columns stay."""
    rest = [c for c in documents.columns if c != value]
    parsed = documents.withColumn("_v", F.try_parse_json(value))
    return parsed.select(*rest, F.explode(_places(F.col("_v"), schema, F.lit("$"))).alias("_o")).select(*rest, "_o.*")


def key_findings(documents: DataFrame, schema: Schema, rule: str = "V1", value: str = "value") -> DataFrame:
    """Missing and extra keys of every object, one finding a key. documents: session_id, root_id, value, and path where a document is a part of a model."""
    missing, extra = F.array_except("required", "found"), F.array_except("found", "allowed")
    rows = object_keys(documents, schema, value).where(F.col("found").isNull() | (F.size(missing) > 0) | (F.size(extra) > 0))
    named = lambda word, keys: F.transform(keys, lambda k: F.concat(F.lit(f"{word} "), k))
    problems = F.when(F.col("found").isNull(), F.array(F.lit("not an object"))).otherwise(
        F.concat(named("missing", missing), named("extra", extra))
    )
    place = F.concat(F.col("path"), F.substr("place", F.lit(2))) if "path" in documents.columns else F.col("place")
    return findings(rows.select(*MODEL, place.alias("path"), F.explode(problems).alias("_d")), rule, F.col("_d"))


def type_findings(documents: DataFrame, types: dict[str, tuple[str, ...]], rule: str, value: str = "value") -> DataFrame:
    """Values of another type than allowed, by their place in the document; absent ones pass. types: place to names of variant types (STRING, VOID, BOOLEAN ...)."""
    parsed = documents.withColumn("_v", F.try_parse_json(value))
    kind = lambda at: F.schema_of_variant(F.try_variant_get("_v", f"$.{at}", "variant"))
    wrong = F.filter(F.array(*(F.when(~kind(at).isin(*allowed), F.lit(at)) for at, allowed in types.items())), lambda x: x.isNotNull())
    path = F.col("path") if "path" in documents.columns else F.lit("$")
    rows = parsed.select(*MODEL, path.alias("path"), F.explode(wrong).alias("_d"))
    return findings(rows, rule, F.concat(F.lit("type of "), "_d"))


def strict(rows: DataFrame, schema: Schema, where: Column, value: str = "value") -> DataFrame:
    """The rows as they are; the read fails at the first one with a missing or an extra key, and names its place (`where`)."""
    checked = rows.withColumn("_o", _places(F.try_parse_json(value), schema, F.lit("$")))
    wrong = F.filter("_o", lambda o: o["found"].isNull() | (F.size(F.array_except(o["required"], o["found"])) > 0) | (F.size(F.array_except(o["found"], o["allowed"])) > 0))
    first = F.get(wrong, F.lit(0))
    keys = F.coalesce(F.array_join(F.array_except(first["found"], first["allowed"]), ","), F.lit(""))
    message = F.concat(F.lit("unknown or missing fields at "), where, F.lit(" "), first["place"], F.lit(": "), keys)
    return checked.withColumn(value, F.when(F.size(wrong) > 0, F.raise_error(message).cast("string")).otherwise(F.col(value))).drop("_o")


def answers_checked(found: DataFrame, schema: Schema) -> DataFrame:
    """request_id, valid and feedback of answers whose JSON object must have exactly the schema's keys, for provider rounds. found: request_id, response."""
    rows = found.select("request_id", F.coalesce(answers.json_object_text(answers.without_thinking(F.col("response"))), F.lit("null")).alias("value"))
    keys = object_keys(rows, schema)
    told = F.concat_ws(
        "; ", F.when(F.col("found").isNull(), F.concat("place", F.lit(" is no object"))),
        F.transform(F.array_except("required", "found"), lambda k: F.concat(F.col("place"), F.lit(" misses "), k)),
        F.transform(F.array_except("found", "allowed"), lambda k: F.concat(F.col("place"), F.lit(" may not have "), k)),
    )
    wrong = keys.withColumn("_t", told).where("_t <> ''").groupBy("request_id").agg(F.array_join(F.array_sort(F.collect_set("_t")), "; ").alias("feedback"))  # objects of one answer
    return rows.select("request_id").join(wrong, "request_id", "left").select(
        "request_id", F.col("feedback").isNull().alias("valid"), F.coalesce("feedback", F.lit("")).alias("feedback")
    )
