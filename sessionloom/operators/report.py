"""Report lines as rows: cells, tables, procedure flow.  Writers sort and store them; nothing is joined into one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators import trees
from sessionloom.operators.trees import MODEL


def refs_cell(refs: Column) -> Column:
    return F.when(F.size(refs) > 0, F.array_join(refs, ", ")).otherwise("-")


def _joined(items: Column) -> Column:
    shown = F.filter(items, text.filled)
    return F.when(F.size(shown) > 0, F.array_join(shown, "; ")).otherwise("-")


def deliverables_cell(items: Column) -> Column:
    """kind: target -> expected state."""

    def label(x: Column) -> Column:
        target, state, kind = (F.trim(text.or_empty(x[k])) for k in ("target", "expected_state", "kind"))
        changed = (state != "") & (state != target)
        body = F.when(changed & (target != ""), F.concat(target, F.lit(" -> "), state)).otherwise(F.when(target != "", target).otherwise(state))
        return F.when((kind != "") & (body != ""), F.concat(kind, F.lit(": "), body)).otherwise(body)

    return _joined(F.transform(items, label))


def criteria_cell(items: Column) -> Column:
    return _joined(F.transform(items, lambda x: F.trim(text.or_empty(x["predicate"]))))


def outcome_cell(outcome: Column) -> Column:
    status, description = (F.nullif(F.trim(outcome[k]), F.lit("")) for k in ("status", "description"))
    return F.coalesce(F.nullif(F.concat_ws(": ", status, description), F.lit("")), F.lit("-"))


def condition_cell(operator: Column, condition: Column, grounding: Column) -> Column:
    """Exit predicate of a WHILE with how it was checked; a dash for everything else."""
    part = lambda k: F.nullif(F.trim(grounding[k]), F.lit(""))
    predicate = F.coalesce(part("predicate"), F.nullif(F.trim(condition), F.lit("")))
    evidence = F.when(F.size(grounding["evidence_refs"]) > 0, F.concat(F.lit("evidence: "), refs_cell(grounding["evidence_refs"])))
    details = F.concat_ws("; ", F.concat(F.lit("verify: "), part("verifier")), part("status"), evidence)
    suffix = F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise("")
    return F.when(F.coalesce(operator != "WHILE", F.lit(True)), "-").otherwise(F.coalesce(F.concat(predicate, F.when(grounding.isNotNull(), suffix).otherwise("")), F.lit("-")))


def escape_cell(cell: Column) -> Column:
    return text.collapse(F.replace(text.or_empty(cell), F.lit("|"), F.lit(r"\|")))


def table_line(cells: list[Column]) -> Column:
    parts: list[Column] = [F.lit("| ")]
    for i, cell in enumerate(cells):
        parts += ([F.lit(" | ")] if i else []) + [escape_cell(cell)]
    return F.concat(*parts, F.lit(" |"))


def procedure_table(nodes: DataFrame) -> DataFrame:
    """One table line per procedure node.  nodes: name, node_id, operator, condition, grounding, activity_refs, evidence_summary, description."""
    name = F.coalesce(text.text_or_null(F.col("name")), text.text_or_null(F.col("node_id")), F.lit("?"))
    why = F.coalesce(text.text_or_null(F.col("evidence_summary")), text.text_or_null(F.col("description")), F.lit(""))
    cells = [name, text.or_empty(F.col("operator")), condition_cell(F.col("operator"), F.col("condition"), F.col("grounding")), refs_cell(F.col("activity_refs")), why]
    return nodes.select(*MODEL, F.col("node_id").alias("sort_key"), table_line(cells).alias("line"))


def objective_lines(nodes: DataFrame) -> DataFrame:
    """Report of an objective tree in reading order: a line per node, and below it summary, deliverables, criteria and outcome where there are any.

    nodes: path, node_id, depth, objective, summary, refs, deliverables, success_criteria, observed_outcome. The places in the path, padded, sort as the tree
    reads; the line's own number comes last.
    """
    indent = F.repeat(F.lit("  "), F.col("depth"))
    more = lambda word, cell: F.when(~cell.isin("", "-"), F.concat(indent, F.lit(f"  - {word}"), cell))
    name = F.coalesce(text.text_or_null(F.col("node_id")), F.lit("?"))
    lines = F.array(
        F.concat(indent, F.lit("- **"), name, F.lit("** "), text.or_empty(F.col("objective")), F.lit(" _("), refs_cell(F.col("refs")), F.lit(")_")),
        more("", F.trim(text.or_empty(F.col("summary")))), more("Deliverables: ", deliverables_cell(F.col("deliverables"))), more("Success: ", criteria_cell(F.col("success_criteria"))),
        more("Observed outcome: ", outcome_cell(F.col("observed_outcome"))),
    )
    rows = nodes.select(*MODEL, path_key(F.col("path")).alias("_key"), F.posexplode(lines).alias("_n", "line")).where(F.col("line").isNotNull())
    return rows.select(*MODEL, F.concat_ws(":", "_key", F.col("_n").cast("string")).alias("sort_key"), "line")


def path_key(path: Column) -> Column:
    """Places along a path, padded, so that keys sort as the tree reads; the root's is empty."""
    return F.array_join(F.transform(F.regexp_extract_all(path, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: F.lpad(n, 8, "0")), ".")


def leaf_table(nodes: DataFrame) -> DataFrame:
    """Table of the leaf objectives, in reading order below its two heading lines."""
    leaves = trees.leaves(nodes)
    cells = [
        F.coalesce(text.text_or_null(F.col("node_id")), F.lit("?")), refs_cell(F.col("refs")), F.col("objective"), deliverables_cell(F.col("deliverables")),
        criteria_cell(F.col("success_criteria")), outcome_cell(F.col("observed_outcome")), F.col("summary"),
    ]
    heads = ["ID", "Local objectives", "Objective", "Deliverables", "Success criteria", "Observed outcome", "Evidence summary"]
    top = F.array(F.struct(F.lit("0").alias("k"), table_line([F.lit(h) for h in heads]).alias("l")), F.struct(F.lit("1").alias("k"), F.lit("|" + " --- |" * len(heads)).alias("l")))
    above = leaves.select(*MODEL).distinct().select("*", F.explode(top).alias("_t")).select(*MODEL, F.col("_t.k").alias("sort_key"), F.col("_t.l").alias("line"))
    return above.unionByName(leaves.select(*MODEL, F.concat(F.lit("2:"), path_key(F.col("path"))).alias("sort_key"), table_line(cells).alias("line")))


def body_lines(steps: DataFrame) -> DataFrame:
    """Numbered steps of a body, steps of nested bodies indented below their own. steps: `flatten.body_steps`."""
    places = F.transform("places", lambda n: F.lpad(n.cast("string"), 8, "0"))
    number = F.when(F.col("is_step"), F.concat(F.element_at("places", -1).cast("string"), F.lit(". "))).otherwise(F.lit("- "))
    line = F.concat(F.repeat(F.lit("  "), F.size("places") - 1), number, F.col("label"))
    return steps.select(*MODEL, "node_id", F.array_join(places, ".").alias("sort_key"), line.alias("line"))


def procedure_flow(expressions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Numbered flow of the root's body: each node reference with the name and operator of its node.

    expressions: rows of the root node's body, with ordinal and procedure_node_id.
    """
    names = nodes.select(*MODEL, F.col("node_id").alias("procedure_node_id"), F.col("name").alias("_name"), F.col("operator").alias("_op"))
    rows = expressions.join(names, [*MODEL, "procedure_node_id"], "left")
    label = F.coalesce(F.col("_name"), F.col("procedure_node_id"), F.col("name"), F.concat(F.lit("step "), F.col("ordinal").cast("string")))
    suffix = F.when(F.col("_op").isNotNull(), F.concat(F.lit(" ["), F.col("_op"), F.lit("]"))).otherwise("")
    line = F.concat(F.col("ordinal").cast("string"), F.lit(". **"), label, F.lit("**"), suffix)
    return rows.select(*MODEL, F.format_string("%08d", "ordinal").alias("sort_key"), line.alias("line"))


def operator_label(operator: Column, variable: Column) -> Column:
    """Reader's wording of an operator; a FOR names its variable, a plain sequence has none."""
    each = F.coalesce(F.replace(text.text_or_null(variable), F.lit("_"), F.lit(" ")), F.lit("item"))
    return (
        F.when(operator == "FOR", F.concat(F.lit("Repeat for each "), each))
        .when(operator == "WHILE", "Repeat until complete")
        .when(operator == "CHOICE", "Choose one path")
        .when(operator == "PARALLEL", "Can happen together")
    )


def collection(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Report of all models of a session: a heading before each model's lines.  titles: session_id, root_id, title."""
    heads = titles.select(*MODEL, F.lit("").alias("sort_key"), F.concat(F.lit("## "), F.col("title")).alias("line"))
    return heads.unionByName(lines.select(*MODEL, "sort_key", "line"))
