"""All rules of procedure models inside the document's own row, for documents of plain form and bounded size: no node table, no shuffle.

The rules are those of `procedures.procedure_findings`. A document of odd form (no JSON, repeated keys, values of other types than the model has, ids that are null or
repeat), one too large for a row, or one whose graph has dangling, repeated or second references or may have a loop is left to the tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import ids
from sessionloom.functions.bind import let
from sessionloom.operators import flatten, keyset, rules
from sessionloom.operators.rules import MODEL

#: Nodes, body expressions, and ids behind all references and of the source, up to which a model is judged in its row.
NODES = 64
EXPRESSIONS = 1_000
IDS = 2_000

TEXTS = ("name", "operator", "description", "evidence_summary", "condition")
SLOTS = ("body", "steps", "branches")
_STATED = {"status": "observed_status"}
_PLAIN, _ONLY_TEXT = {str, type(None)}, {str}
_STRINGS = pa.list_(pa.string())
_BINDINGS = pa.struct([("iteration_variable", pa.string()), ("collection", _STRINGS)])
_GROUNDING = pa.struct([("predicate", pa.string()), ("verifier", pa.string()), ("status", pa.string()), ("evidence_refs", _STRINGS)])
_NODE = pa.struct([
    ("node_id", pa.string()), *((t, pa.string()) for t in TEXTS), ("activity_refs", _STRINGS), ("bindings", _BINDINGS), ("grounding", _GROUNDING), ("has_body", pa.bool_()), ("keys", _STRINGS),
])
_EXPRESSION = pa.struct([
    ("node_id", pa.string()), ("expr_path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("activity_id", pa.string()), ("procedure_node_id", pa.string()),
    ("activity_refs", _STRINGS), ("in_loop", pa.bool_()),
])
_ROW = (
    "session_id string, root_id string, known array<string>, keys array<string>, root_procedure_id string, "
    "nodes array<struct<node_id: string, name: string, operator: string, description: string, evidence_summary: string, condition: string, activity_refs: array<string>, "
    "bindings: struct<iteration_variable: string, collection: array<string>>, grounding: struct<predicate: string, verifier: string, status: string, evidence_refs: array<string>>, "
    "has_body: boolean, keys: array<string>>>, "
    "exprs array<struct<node_id: string, expr_path: string, kind: string, name: string, activity_id: string, procedure_node_id: string, activity_refs: array<string>, in_loop: boolean>>, "
    "reached array<string>"
)


class _Odd(ValueError):
    """The document is left to the tables."""


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Odd
    return out


def _constant(name: str):
    raise _Odd


_JSON = json.JSONDecoder(object_pairs_hook=_object, parse_constant=_constant)


def _plain(values) -> None:
    """Texts or nulls only."""
    if not _PLAIN.issuperset(map(type, values)):
        raise _Odd


def _texts(value) -> list[str] | None:
    if value is not None and (type(value) is not list or not _ONLY_TEXT.issuperset(map(type, value))):
        raise _Odd
    return value


def _part(node: dict, key: str, texts: tuple[str, ...], items: str) -> dict | None:
    """The texts and the list of an object inside a node, by their names in the row."""
    value = node[key]
    if type(value) is not dict:
        raise _Odd
    out = {name: value.get(_STATED.get(name, name)) for name in texts}
    _plain(out.values())
    out[items] = _texts(value.get(items))
    return out


def _node(node: dict) -> tuple:
    if type(node) is not dict or type(node.get("id")) is not str:
        raise _Odd
    texts = [node.get(t) for t in TEXTS]
    _plain(texts)
    held = [node[slot] for slot in SLOTS if slot in node]
    if None in held:
        raise _Odd
    return (
        node["id"], *texts, _texts(node.get("activity_refs")) or [],
        _part(node, "bindings", ("iteration_variable",), "collection") if "bindings" in node else None,
        _part(node, "condition_grounding", ("predicate", "verifier", "status"), "evidence_refs") if "condition_grounding" in node else None,
        bool(held), list(node),
    )


def _model(value: str | None) -> tuple:
    """keys, root_procedure_id, nodes, expressions and the nodes that the root reaches; nulls for a document that is left to the tables."""
    try:
        document = _JSON.decode(value or "")
        items = document.get("procedure_nodes") if type(document) is dict else None
        if type(items) is not list or len(items) > NODES or type(document.get("root_procedure_id")) is not str:
            raise _Odd
        nodes = [_node(item) for item in items]
        if len({n[0] for n in nodes}) < len(nodes):
            raise _Odd
        exprs, below = [], {}
        for item in items:
            for _, operator, path, _, _, _, kind, _, name, activity, child, refs, looped in flatten.body_rows((), item):
                _plain((name, activity, child))
                exprs.append((item["id"], path, kind, name, activity, child, refs, looped))
                if kind == "node":
                    below.setdefault(item["id"], []).append(child)
            if len(exprs) > EXPRESSIONS:
                raise _Odd
        root = document["root_procedure_id"]
        reached, stack = {root}, [root]
        while stack:
            fresh = [child for child in below.get(stack.pop(), ()) if child not in reached]
            reached.update(fresh)
            stack.extend(fresh)
        return list(document), root, nodes, exprs, sorted(reached)
    except (ValueError, RecursionError):
        return None, None, None, None, None


def _list(items: list, kind: pa.DataType) -> pa.Array:
    """Lists of structs from lists of tuples, column by column; None is a null list."""
    flat = [x for own in items if own for x in own]
    columns = zip(*flat, strict=True) if flat else [()] * kind.num_fields
    held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    starts = [0, *accumulate(len(own or ()) for own in items)]
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), held, mask=pa.array([own is None for own in items], pa.bool_()))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), flatten.TREES):
            part = batch.slice(a, flatten.TREES)
            models = [_model(value) for value in part.column(3).to_pylist()]
            keys, roots, nodes, exprs, reached = zip(*models, strict=True)
            columns = [pa.array(keys, _STRINGS), pa.array(roots, pa.string()), _list(nodes, _NODE), _list(exprs, _EXPRESSION), pa.array(reached, _STRINGS)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["session_id", "root_id", "known", "keys", "root_procedure_id", "nodes", "exprs", "reached"])


def _spread(refs: Column) -> Column:
    return F.flatten(F.transform(refs, lambda r: F.coalesce(ids.expand_range(r, ids.ACTIVITY), F.array().cast("array<string>"))))


def _told(path: Column, rule: str, details: Column) -> Column:
    return F.transform(details, lambda d: F.struct(path.cast("string").alias("path"), F.lit(rule).alias("rule_id"), d.alias("detail")))


def _sides(path: Column, rule: str, left: Column, right: Column) -> Column:
    """What the right side lacks and what it has too much."""
    named = lambda word, items: F.transform(items, lambda i: F.concat(F.lit(f"{word} "), i))
    both = F.struct(left.alias("left"), right.alias("right"))
    return _told(path, rule, let(both, lambda b: F.concat(named("missing", F.array_except(b["left"], b["right"])), named("extra", F.array_except(b["right"], b["left"])))))


def models(documents: DataFrame) -> DataFrame:
    """Documents (session_id, root_id, known array<string>: the source's activities, null without one; value) with their parts; fits tells which are judged in their row."""
    rows = documents.select(*MODEL, "known", "value").mapInArrow(_rows, _ROW)
    size = lambda refs: F.aggregate(refs, F.lit(0).cast("bigint"), lambda total, r: total + ids.range_size(r))
    behind = size(F.flatten(F.transform("nodes", lambda n: n["activity_refs"]))) + size(F.flatten(F.transform("exprs", lambda e: F.coalesce(e["activity_refs"], F.array().cast("array<string>")))))
    edges = F.filter("exprs", lambda e: e["kind"] == "node")
    rows = rows.withColumns({"parents": F.transform(edges, lambda e: e["node_id"]), "children": F.transform(edges, lambda e: e["procedure_node_id"]), "ids": F.transform("nodes", lambda n: n["node_id"])})
    none = lambda items: F.size(items) == 0
    # One edge to every child, none to the root: a loop would lie where the root doesn't reach, along a node that is parent and child.
    tree = (F.size(F.array_distinct("children")) == F.size("children")) & none(F.array_except("children", "ids")) & ~F.array_contains("children", F.col("root_procedure_id"))
    tree = tree & (none(F.array_except("parents", "reached")) | none(F.array_intersect("parents", "children")))
    fits = (behind <= IDS) & (F.coalesce(F.size("known"), F.lit(0)) <= IDS) & tree
    return rows.withColumn("fits", F.coalesce(fits, F.lit(False)))


def _keys(path: Column, found: Column, schema: dict) -> Column:
    must = F.array(*(F.lit(k) for k in schema if not k.endswith("?") and k != "*"))
    may = F.array(*(F.lit(k.rstrip("?")) for k in schema))
    named = lambda word, items: F.transform(items, lambda i: F.concat(F.lit(f"{word} "), i))
    told = named("missing", F.array_except(must, found))
    return _told(path, "V1", told if "*" in schema else F.concat(told, named("extra", F.array_except(found, may))))


def shape_findings(texts: tuple[str, ...]) -> Column:
    """V1 and V2 of a model's row; texts: fields of a node that must not be blank."""
    places = F.transform("nodes", lambda n, i: _keys(F.concat(F.lit("$.procedure_nodes["), i.cast("string"), F.lit("]")), n["keys"], keyset.PROCEDURE_NODE))
    blanks = lambda n: F.filter(F.array(*(F.when(rules.blank(n[t]), F.lit(t)) for t in texts)), lambda t: t.isNotNull())
    return F.concat(_keys(F.lit("$"), F.col("keys"), keyset.PROCEDURE_MODEL), F.flatten(places), F.flatten(F.transform("nodes", lambda n: _told(n["node_id"], "V2", blanks(n)))))


def deep_findings() -> Column:
    """V24, V35, V36, V40 and V46 (known activities) of a model's row, beside the rules that look at one node or expression only."""
    place = lambda e: F.concat_ws("/", e["node_id"], e["expr_path"])
    inner = lambda e: (e["kind"] == "operator") & e["activity_refs"].isNotNull()
    refs = lambda e: F.when(e["kind"] == "activity", F.array(e["activity_id"])).otherwise(F.coalesce(e["activity_refs"], F.array().cast("array<string>")))
    named = F.transform(F.filter("exprs", lambda e: ~inner(e)), lambda e: F.struct(e["node_id"].alias("node_id"), e["expr_path"].alias("expr_path"), _spread(refs(e)).alias("items")))
    owned = F.transform("nodes", lambda n: F.struct(n["node_id"].alias("node_id"), _spread(n["activity_refs"]).alias("items")))

    def judged(bodies: Column, own: Column) -> Column:
        items = lambda held: F.flatten(F.transform(held, lambda x: x["items"]))

        def node(n: Column) -> Column:
            # Every child has one parent, whose place among the edges is the child's.
            below = F.filter(own, lambda o: F.get("parents", (F.array_position("children", o["node_id"]) - 1).cast("int")) == n["node_id"])
            return _sides(n["node_id"], "V36", F.concat(items(F.filter(bodies, lambda b: b["node_id"] == n["node_id"])), items(below)), n["items"])

        def operator(e: Column) -> Column:
            below = F.filter(bodies, lambda b: (b["node_id"] == e["node_id"]) & b["expr_path"].startswith(F.concat(e["expr_path"], F.lit("/"))))
            return _sides(place(e), "V35", items(below), _spread(e["activity_refs"]))

        return F.concat(F.flatten(F.transform(own, node)), F.flatten(F.transform(F.filter("exprs", inner), operator)))

    leaf = lambda e: F.coalesce(e["activity_id"].rlike(r"^activity_\d{4,}$"), F.lit(False))
    unknown = F.filter("exprs", lambda e: (e["kind"] == "activity") & ~F.coalesce(F.array_contains("known", e["activity_id"]), F.lit(False)) & leaf(e))
    unknown = F.when(F.size("known") > 0, F.flatten(F.transform(unknown, lambda e: _told(place(e), "V46", F.array(e["activity_id"])))))
    none = F.array().cast("array<struct<path: string, rule_id: string, detail: string>>")
    root = F.lit("$")

    def beyond(own: Column) -> Column:
        """Activities that reached nodes name and the root does not; a model without its root node has nothing to compare with."""
        held = lambda test: F.flatten(F.transform(F.filter(own, test), lambda n: n["items"]))
        more = F.array_except(held(lambda n: F.array_contains("reached", n["node_id"])), held(lambda n: n["node_id"] == F.col("root_procedure_id")))
        return F.when(F.array_contains("ids", F.col("root_procedure_id")), _told(root, "V40", more)).otherwise(none)

    return F.concat(
        let(owned, lambda own: F.concat(let(named, lambda bodies: judged(bodies, own)), beyond(own))), F.coalesce(unknown, none),
        _told(root, "V24", F.array_except(F.array("root_procedure_id"), "ids")), _told(root, "V40", F.array_except("ids", "reached")),
    )
