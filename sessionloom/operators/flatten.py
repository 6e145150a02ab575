"""Recursive JSON models to flat rows.  Spark structs cannot recurse, so nested documents are walked once
per row in Arrow batches; everything after that is relational."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import cost

NODES = (
    "session_id string, root_id string, path string, parent_path string, node_id string, ordinal bigint, depth int, "
    "objective string, summary string, refs array<string>, evidence_refs array<string>, body string"
)
EXPRESSIONS = (
    "session_id string, root_id string, node_id string, node_operator string, expr_path string, parent_expr_path string, ordinal bigint, slot string, "
    "kind string, operator string, name string, activity_id string, procedure_node_id string, activity_refs array<string>, in_loop boolean"
)


#: Rows that a walk hands over at once, so that its memory follows neither the number of documents in a batch nor their size.
CHUNK = 5_000
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def _strings(value) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list) else []


def _tree_walk(document: dict) -> Iterator[tuple]:
    stack = [(document, "$", None, 0, 0)]
    while stack:
        node, path, parent, ordinal, depth = stack.pop()
        yield node, path, parent, ordinal, depth
        for i, child in enumerate(node.get("decomposition") or []):
            if isinstance(child, dict):
                stack.append((child, f"{path}.decomposition[{i}]", path, i + 1, depth + 1))


def _tree_refs(node: dict) -> list[str]:
    return _strings(node.get("subgoal_segments") or node.get("activity_refs"))


def _tree_rows(head: tuple, document: dict) -> Iterator[tuple]:
    for node, path, parent, ordinal, depth in _tree_walk(document):
        body = {k: v for k, v in node.items() if k != "decomposition"}
        yield (*head, path, parent, node.get("id"), ordinal, depth, node.get("objective"), node.get("summary"),
               _tree_refs(node), _strings(node.get("evidence_refs")), json.dumps(body))


def _kind(expr) -> str:
    if not isinstance(expr, dict):
        return "unknown"
    if expr.get("procedure_node_id") is not None:
        return "mixed" if "activity_id" in expr or "operator" in expr else "node"
    if "operator" in expr:
        return "operator"
    if "activity_id" in expr:
        return "activity"
    return "step" if expr.get("name") else "unknown"


def body_rows(head: tuple, node: dict) -> Iterator[tuple]:
    stack = []

    def push(holder: dict, place: str, parent: str | None, looped: bool) -> None:
        for slot in ("body", "steps", "branches"):
            if slot in holder and holder[slot] is not None:
                value = holder[slot]
                items = value if isinstance(value, list) else [value]
                for i, item in enumerate(items):
                    stack.append((item, f"{place}{slot}.{i}", parent, i + 1, slot, looped))

    push(node, "", None, node.get("operator") in ("FOR", "WHILE"))
    while stack:
        expr, place, parent, ordinal, slot, looped = stack.pop()
        kind, plain = _kind(expr), expr if isinstance(expr, dict) else {}
        refs = plain.get("activity_refs")
        yield (*head, node.get("id"), node.get("operator"), place, parent, ordinal, slot, kind, plain.get("operator"), plain.get("name"),
               plain.get("activity_id"), plain.get("procedure_node_id"), None if refs is None else _strings(refs), looped)
        if kind == "operator" or (kind == "unknown" and any(s in plain for s in ("steps", "branches"))):
            push(plain, place + "/", place, looped or plain.get("operator") in ("FOR", "WHILE"))


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [c.strip().split() for c in schema.split(", ")]
    while held := list(islice(rows, CHUNK)):
        columns = [pa.array(column, _ARROW[kind]) for column, (_, kind) in zip(zip(*held, strict=True), fields, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _walk(documents: DataFrame, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = ((session.as_py(), root.as_py(), value.as_py()) for batch in batches for session, root, value in zip(*batch.columns, strict=True))
        return _batches((row for session, root, value in heads for row in rows_of((session, root), json.loads(value))), schema)

    return documents.select("session_id", "root_id", "value").mapInArrow(run, schema)


def tree_nodes(documents: DataFrame) -> DataFrame:
    """Objective or unified trees (documents: session_id, root_id, value) to one row per node."""
    return _walk(documents, NODES, _tree_rows)


#: Documents that `tree_arrays` takes apart at once; as it keeps a bounded number of nodes of each, so is what it holds.
TREES = 1_000


def tree_arrays(documents: DataFrame, most: int) -> DataFrame:
    """Trees (value) as a column of their row: nodes array<struct<path, parent_path, refs>>, null where a tree has more than `most`. Other columns stay."""
    rest = documents.drop("value")
    strings = T.ArrayType(T.StringType())
    node = T.StructType().add("path", T.StringType()).add("parent_path", T.StringType()).add("refs", strings)
    schema = T.StructType([*rest.schema.fields, T.StructField("nodes", T.ArrayType(node))])

    def lists(items: list[list]) -> list[int]:
        return [0, *accumulate(map(len, items))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), TREES):
                part = batch.slice(a, TREES)
                trees = [list(islice(_tree_walk(json.loads(value)), most + 1)) for value in part.column(len(part.columns) - 1).to_pylist()]
                large = [len(tree) > most for tree in trees]
                trees = [[] if wide else tree for tree, wide in zip(trees, large, strict=True)]
                flat = [at for tree in trees for at in tree]
                refs = [_tree_refs(at[0]) for at in flat]
                refs = pa.ListArray.from_arrays(pa.array(lists(refs), pa.int32()), pa.array([r for own in refs for r in own], pa.string()))
                nodes = pa.StructArray.from_arrays([pa.array([at[1] for at in flat], pa.string()), pa.array([at[2] for at in flat], pa.string()), refs], ["path", "parent_path", "refs"])
                nodes = pa.ListArray.from_arrays(pa.array(lists(trees), pa.int32()), nodes, mask=pa.array(large, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], nodes], names=schema.fieldNames())

    return documents.select(*rest.columns, "value").mapInArrow(run, schema)


def body_expressions(documents: DataFrame) -> DataFrame:
    """Procedure models to one row per body expression of every node."""

    def rows_of(head, document):
        for node in document.get("procedure_nodes") or []:
            yield from body_rows(head, node)

    return _walk(documents, EXPRESSIONS, rows_of)


STEPS = "session_id string, root_id string, node_id string, places array<int>, label string, is_step boolean"


def _step_rows(head: tuple, node: dict) -> Iterator[tuple]:
    stack = [(node.get("body"), [])]
    while stack:
        body, above = stack.pop()
        if not isinstance(body, dict):
            continue
        steps = [s for s in body.get("steps") or [] if isinstance(s, dict)] if isinstance(body.get("steps"), list) else []
        for i, step in enumerate(steps, 1):
            yield (*head, node.get("id"), [*above, i], str(step.get("name") or step.get("operator") or f"step {i}").strip(), True)
            stack.append((step.get("body"), [*above, i]))
        if not steps and body.get("operator"):
            yield (*head, node.get("id"), [*above, 1], str(body["operator"]).strip(), False)


def body_steps(documents: DataFrame) -> DataFrame:
    """Steps of the bodies of all procedure nodes at any depth, with their places from the outside in.

    A body without steps shows its operator (not a step).
    """

    def rows_of(head, document):
        for node in document.get("procedure_nodes") or []:
            if isinstance(node, dict):
                yield from _step_rows(head, node)

    return _walk(documents, STEPS, rows_of)


def procedure_nodes(documents: DataFrame) -> DataFrame:
    """Nodes of procedure models with the parts that their rules look at: one row per node that is an object."""
    items = F.try_variant_get(F.try_parse_json("value"), "$.procedure_nodes", "array<variant>")
    texts = ("name", "operator", "description", "evidence_summary", "condition")
    whole = ", ".join(f"{t} string" for t in ("id", *texts)) + ", activity_refs array<string>, bindings variant, condition_grounding variant, body variant, steps variant, branches variant"
    # A node is taken apart in one look; what is no object has no parts.
    rows = documents.select("session_id", "root_id", F.posexplode(items).alias("ordinal", "_v"))
    rows = rows.select("session_id", "root_id", "ordinal", F.try_variant_get("_v", "$", f"struct<{whole}>").alias("_n")).where("_n is not null")
    n = F.col("_n")

    def part(at, fields):
        return F.when(n[at].isNotNull(), F.struct(*(F.try_variant_get(n[at], f"$.{name}", kind).alias(alias) for name, alias, kind in fields)))

    bindings = [("iteration_variable", "iteration_variable", "string"), ("collection", "collection", "array<string>")]
    grounding = [("predicate", "predicate", "string"), ("verifier", "verifier", "string"), ("observed_status", "status", "string"), ("evidence_refs", "evidence_refs", "array<string>")]
    return rows.select(
        "session_id", "root_id", "ordinal", n["id"].alias("node_id"), *(n[t].alias(t) for t in texts), F.coalesce(n["activity_refs"], F.array().cast("array<string>")).alias("activity_refs"),
        part("bindings", bindings).alias("bindings"), part("condition_grounding", grounding).alias("grounding"), F.coalesce(n["body"], n["steps"], n["branches"]).isNotNull().alias("has_body"),
    )


def _usage_objects(value) -> Iterator[dict]:
    stack = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            yield item
            stack.extend(reversed(list(item.values())))
        elif isinstance(item, list):
            stack.extend(reversed(item))


def usage_objects(events: DataFrame) -> DataFrame:
    """Every ``usage`` object inside JSON event lines: session_id, stream_id, line_no, place, usage (text)."""
    schema = "session_id string, stream_id string, line_no bigint, place bigint, usage string"

    def rows_of(session, stream, line_no, value):
        try:
            document = json.loads(value)
        except ValueError:
            return
        found = (o["usage"] for o in _usage_objects(document) if isinstance(o.get("usage"), dict))
        for i, u in enumerate(found):
            yield session, stream, line_no, i, json.dumps(u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = ([c.as_py() for c in line] for batch in batches for line in zip(*batch.columns, strict=True))
        return _batches((row for line in heads for row in rows_of(*line)), schema)

    lines = events.where(F.ltrim("value").startswith("{")).select("session_id", "stream_id", "line_no", "value")
    return lines.mapInArrow(run, schema)


def largest_usage(events: DataFrame) -> DataFrame:
    """Usage with the most total tokens per stream, the first one on ties."""
    rows = usage_objects(events).withColumn("u", cost.normalize_usage(F.try_parse_json("usage")))
    rank = F.struct(F.col("u.total_tokens"), -F.col("line_no"), -F.col("place"))
    return rows.groupBy("session_id", "stream_id").agg(F.max_by("u", rank).alias("u")).select("session_id", "stream_id", "u.*")
