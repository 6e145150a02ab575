"""Integrity rules as set operations over flattened models.

Every rule yields findings(session_id, root_id, path, rule_id, severity, detail); a rule about
identifiers yields one row per offending identifier, so no list is ever collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import ids, text
from sessionloom.operators.sequence import order_sessions
from sessionloom.operators.trees import MODEL, NODE, coverage
from sessionloom.session import cut_lineage

# Fixed values of the rules.
OUTCOME_STATUSES = ["achieved", "partial", "failed", "abandoned", "unknown"]
CONDITION_STATUSES = ["satisfied", "unsatisfied", "unknown"]
OPERATORS = ["SEQ", "FOR", "WHILE", "CHOICE"]
LARGE_NODE = 20
SMALL_DECOMPOSITION = 5


def findings(rows: DataFrame, rule: str, detail: Column, severity: str = "error") -> DataFrame:
    path = F.col("path") if "path" in rows.columns else F.lit("$")
    return rows.select(*MODEL, path.cast("string").alias("path"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_rules(rows: DataFrame, tests: list[tuple[str, Column, Column]], severity: str = "error") -> DataFrame:
    """Several per-row rules in one pass: (rule id, violated, detail)."""
    hits = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(r).alias("rule_id"), d.cast("string").alias("detail"))) for r, bad, d in tests]),
        lambda h: h.isNotNull(),
    )
    path = F.col("path") if "path" in rows.columns else F.lit("$")
    # Most rows break no rule; only the others get an array.
    broken = rows.where(reduce(Column.__or__, (F.coalesce(bad, F.lit(False)) for _, bad, _ in tests)))
    out = broken.select(*MODEL, path.alias("path"), F.explode(hits).alias("_h"))
    return out.select(*MODEL, "path", "_h.rule_id", F.lit(severity).alias("severity"), "_h.detail")


def blank(c: Column) -> Column:
    return ~text.filled(text.strip(text.or_empty(c)))


def _duplicates(refs: Column) -> Column:
    return F.size(refs) != F.size(F.array_distinct(refs))


# ---- shape of objective nodes (V2 - V6) ------------------------------------------------------


def shape_rules(nodes: DataFrame) -> DataFrame:
    """Texts, evidence lists, deliverables, criteria and outcome of every node."""
    refs = F.col("evidence_refs")
    tests = [("V2", blank(F.col(c)), F.lit(c)) for c in ("node_id", "objective", "summary")]
    tests += [
        ("V3", F.size(refs) == 0, F.lit("evidence_refs empty")),
        ("V3", F.exists(refs, blank), F.lit("evidence_refs blank entry")),
        ("V3", _duplicates(refs), F.lit("evidence_refs duplicate")),
        ("V4", F.size("deliverables") == 0, F.lit("deliverables empty")),
        ("V4", F.size("success_criteria") == 0, F.lit("success_criteria empty")),
        ("V3", F.size("refs") == 0, F.lit("subgoal_segments empty")),
    ]
    outcome = F.col("observed_outcome")
    tests += [
        ("V6", ~F.coalesce(outcome["status"].isin(OUTCOME_STATUSES), F.lit(False)), F.lit("outcome status")),
        ("V2", blank(outcome["description"]), F.lit("outcome description")),
        ("V6", (outcome["status"] != "unknown") & (F.size(outcome["evidence_refs"]) == 0), F.lit("outcome cites no evidence")),
        ("V6", F.size(F.array_except(outcome["evidence_refs"], refs)) > 0, F.lit("outcome evidence outside node")),
    ]
    own = row_rules(nodes, tests)

    def items(column: str, texts: tuple[str, ...], extra: list[tuple[str, Column, Column]]) -> DataFrame:
        rows = nodes.select(*NODE, "evidence_refs", F.posexplode(column).alias("_i", "_x"))
        x = F.col("_x")
        place = F.concat(F.lit(f"{column}["), F.col("_i").cast("string"), F.lit("]"))
        checks = [("V2", blank(x[t]), F.concat(place, F.lit(f".{t}"))) for t in texts]
        checks += [
            ("V4", F.size(x["evidence_refs"]) == 0, place),
            ("V3", _duplicates(x["evidence_refs"]), place),
            ("V4", F.size(F.array_except(x["evidence_refs"], refs)) > 0, F.concat(place, F.lit(" evidence outside node"))),
        ]
        return row_rules(rows, checks + extra)

    confidence = F.col("_x")["confidence"]
    in_range = [("V5", ~confidence.between(0.0, 1.0), F.lit("confidence"))]
    return union_all(
        own, items("deliverables", ("kind", "target", "expected_state"), []), items("success_criteria", ("predicate", "verifier"), in_range)
    )


# ---- ids and references (V8 - V18) -----------------------------------------------------------


def root_rules(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Root id equals the source's; a source of several activities has a decomposed root.

    sources: session_id, root_id, source_root_id, requires_decomposition.
    """
    roots = nodes.where(F.col("parent_path").isNull()).join(sources, MODEL)
    children = nodes.where(F.col("parent_path").isNotNull()).select(*MODEL, F.lit(True).alias("_split")).distinct()
    rows = roots.join(children, MODEL, "left")
    tests = [
        ("V8", F.col("source_root_id").isNotNull() & (F.col("source_root_id") != F.col("node_id")), F.col("node_id")),
        ("V9", F.col("requires_decomposition") & F.col("_split").isNull(), F.lit("empty decomposition")),
    ]
    return row_rules(rows, tests)


def id_rules(nodes: DataFrame) -> DataFrame:
    """Ids unique in the tree, nested under the parent's id, and numbered 1, 2, 3 ..."""
    repeated = nodes.groupBy(*MODEL, "node_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    parents = nodes.select(*MODEL, F.col("path").alias("parent_path"), F.col("node_id").alias("_parent_id"))
    child = nodes.join(parents, [*MODEL, "parent_path"])
    nested = child.where(~F.col("node_id").startswith(F.concat(F.col("_parent_id"), F.lit("."))))
    expected = F.concat(F.col("_parent_id"), F.lit("."), F.col("ordinal").cast("string"))
    sequential = child.where(F.col("node_id") != expected)
    return union_all(
        findings(repeated, "V10", F.col("node_id")), findings(nested, "V11", F.col("node_id")), findings(sequential, "V12", F.col("node_id"))
    )


def evidence_rules(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Cited evidence that the source does not know."""
    cited = nodes.select(*NODE, F.explode(F.array_distinct("evidence_refs")).alias("evidence_id"))
    return findings(cited.join(known, [*MODEL, "evidence_id"], "left_anti"), "V13", F.col("evidence_id"))


def span_rules(nodes: DataFrame, owners: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Cited evidence owned only by activities outside the node (evidence without owner passes)."""
    cited = nodes.select(*NODE, F.explode(F.array_distinct("evidence_refs")).alias("evidence_id"))
    inside = (covered if covered is not None else coverage(nodes)).select(*NODE, "activity_id").distinct().withColumn("_in", F.lit(1))
    owned = cited.join(owners, [*MODEL, "evidence_id"]).join(inside, [*NODE, "activity_id"], "left")
    judged = owned.groupBy(*NODE, "evidence_id").agg(F.count("_in").alias("_n"))
    return findings(judged.where(F.col("_n") == 0), "V16", F.col("evidence_id"))


def reference_rules(nodes: DataFrame, known_activities: DataFrame, prefixes: tuple[str, ...] = ids.ACTIVITY_AND_SEGMENT) -> DataFrame:
    """References malformed, unknown (only where the source lists activities), or repeated in one node."""
    refs = nodes.select(*NODE, F.explode("refs").alias("ref"))
    malformed = refs.where(ids.expand_range(F.col("ref"), prefixes).isNull())
    covered = coverage(nodes, prefixes)
    has_source = known_activities.select(*MODEL).distinct()
    unknown = covered.join(has_source, MODEL, "left_semi").join(known_activities, [*MODEL, "activity_id"], "left_anti")
    repeated = covered.groupBy(*NODE, "activity_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return union_all(
        findings(malformed, "V14", F.col("ref")), findings(unknown, "V14", F.col("activity_id")), findings(repeated, "V15", F.col("activity_id"))
    )


def size_rules(nodes: DataFrame, large: int = LARGE_NODE, small: int = SMALL_DECOMPOSITION) -> DataFrame:
    """One-activity nodes must not be split; review hints for single, large and small split nodes."""
    spread = F.flatten(F.transform("refs", lambda r: F.coalesce(ids.expand_range(r), F.array().cast("array<string>"))))
    parents = nodes.where(F.col("parent_path").isNotNull()).select(*MODEL, F.col("parent_path").alias("path"), F.lit(True).alias("_split")).distinct()
    rows = nodes.withColumn("_n", F.size(F.array_distinct(spread))).join(parents, NODE, "left")
    split, n = F.col("_split").isNotNull(), F.col("_n")
    errors = row_rules(rows, [("V17", (n == 1) & split, n)])
    hints = [
        ("V18a", (n == 1) & F.col("parent_path").isNotNull(), n),
        ("V18b", n > large, n),
        ("V18c", (n > 0) & (n < small) & split, n),
    ]
    return union_all(errors, row_rules(rows, hints, "warning"))


# ---- partition and coverage (V19 - V23) ------------------------------------------------------


def partition_rules(nodes: DataFrame) -> DataFrame:
    """Children inside the parent (V19), siblings disjoint (V20), together the parent exactly.

    References are expanded once: every activity of a node counts at the node itself and, as a child's, at the parent, so one
    aggregate by (place, activity) holds all that the rules compare.
    """
    spread = F.flatten(F.transform("refs", lambda r: F.coalesce(ids.expand_range(r), F.array().cast("array<string>"))))
    held = nodes.select(*NODE, "parent_path", F.array_distinct(spread).alias("items"))
    parents = held.where(F.col("parent_path").isNotNull() & (F.size("items") > 0)).select(*MODEL, F.col("parent_path").alias("path")).distinct()
    marked = held.join(parents.withColumn("_split", F.lit(True)), NODE, "left")
    role = lambda at, own, split: F.struct(at.alias("at"), own.alias("own"), split.alias("split"))
    no = F.lit(False)
    at_node, at_parent = role(F.col("path"), F.lit(True), F.coalesce("_split", no)), role(F.col("parent_path"), no, no)
    roles = F.when(F.col("parent_path").isNull(), F.array(at_node)).otherwise(F.array(at_node, at_parent))
    rows = marked.select(*MODEL, F.explode("items").alias("activity_id"), roles.alias("roles")).select(*MODEL, "activity_id", F.explode("roles").alias("_r"))
    # A node names an activity once, so the rows that are not the place's own count its children. Flags and counts aggregate without sorting.
    grouped = rows.groupBy(*MODEL, F.col("_r.at").alias("at"), "activity_id").agg(
        F.max("_r.own").alias("own"), F.max("_r.split").alias("split"), F.count_if(~F.col("_r.own")).alias("many")
    )
    several, missing, extra = F.col("many") > 1, F.col("own") & (F.col("many") == 0) & F.col("split"), ~F.col("own")
    wrong = cut_lineage(grouped.select(*MODEL, "at", "activity_id", several.alias("several"), missing.alias("missing"), extra.alias("extra")).where("several OR missing OR extra"))
    item = F.col("activity_id")
    outside = held.where(F.col("parent_path").isNotNull()).select(*NODE, F.col("parent_path").alias("at"), F.explode("items").alias("activity_id"))
    outside = outside.join(wrong.where("extra").select(*MODEL, "at", "activity_id"), [*MODEL, "at", "activity_id"], "left_semi")
    tests = [("V20", F.col("several"), item), ("V21", F.col("missing"), F.concat(F.lit("missing "), item)), ("V21", F.col("extra"), F.concat(F.lit("extra "), item))]
    return findings(outside, "V19", item).unionByName(row_rules(wrong.withColumnRenamed("at", "path"), tests))


def two_sided(left: DataFrame, right: DataFrame, keys: list[str], item: str, rule: str) -> DataFrame:
    """What ``right`` lacks (missing) and what it has too much (extra), as findings."""
    sides = lambda l, r: [F.lit(l).alias("_l"), F.lit(r).alias("_r")]
    rows = left.select(*keys, item, *sides(True, False)).unionByName(right.select(*keys, item, *sides(False, True)))
    both = rows.groupBy(*keys, item).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    meet = F.col("_l") & F.col("_r") & reduce(Column.__and__, (F.col(c).isNotNull() for c in [*keys, item]))  # nothing equals a null
    words = F.filter(F.array(F.when(F.col("_l"), "missing "), F.when(F.col("_r"), "extra ")), lambda w: w.isNotNull())
    told = both.where(~meet).select(*keys, item, F.explode(words).alias("_w"))
    return findings(told, rule, F.concat("_w", F.col(item).cast("string")))


def root_cover_rules(nodes: DataFrame, source_activities: DataFrame, semantic: DataFrame) -> DataFrame:
    """The root covers the source's activities (V22) and semantic actions, and so does the tree.

    One aggregate by activity holds who names it, one by semantic action what that comes to.
    """
    refs = nodes.select(*MODEL, F.col("parent_path").isNull().alias("root"), F.explode("refs").alias("ref"))
    named = refs.select(*MODEL, "root", F.explode(ids.expand_range(F.col("ref"))).alias("activity_id")).withColumns({"source": F.lit(False), "tree": F.lit(True)})
    listed = source_activities.select(*MODEL, F.lit(False).alias("root"), "activity_id", F.lit(True).alias("source"), F.lit(False).alias("tree"))
    by_id = named.unionByName(listed).groupBy(*MODEL, "activity_id").agg(*(F.max(c).alias(c) for c in ("source", "root", "tree")))
    missing = by_id.where("source AND NOT root")
    extra = by_id.where("root AND NOT source").join(source_activities.select(*MODEL).distinct(), MODEL, "left_semi")
    actions = semantic.select(*MODEL, "activity_id", "semantic_action_idx").join(by_id.where("tree").drop("source"), [*MODEL, "activity_id"], "left")
    covers = lambda c: F.max(F.coalesce(F.col(c) & F.col("semantic_action_idx").isNotNull(), F.lit(False))).alias(c)
    by_action = actions.groupBy(*MODEL, "semantic_action_idx").agg(covers("root"), covers("tree"))
    number = F.col("semantic_action_idx")
    tests = [("V23", ~F.col("root"), F.concat(F.lit("missing "), number.cast("string"))), ("V23t", ~F.col("tree"), number)]
    return union_all(
        findings(missing, "V22", F.concat(F.lit("missing "), F.col("activity_id"))), findings(extra, "V22", F.concat(F.lit("extra "), F.col("activity_id"))),
        row_rules(by_action, tests),
    )


def order_rules(parts: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Ordered parts must be increasing and disjoint: each part starts after all earlier ones end.

    parts: keys..., ordinal, low, high (null bounds = empty part, skipped); path names the place.
    """
    so = order_sessions(parts.where(F.col("low").isNotNull()), keys, "ordinal").running(_top=("max", F.col("high")))
    so = so.neighbours(prev={"_before": "_top"})
    return findings(so.df.where(F.col("low") <= F.col("_before")), rule, F.col("ordinal"))


def sibling_order_rules(nodes: DataFrame) -> DataFrame:
    """Siblings of a unified tree follow the source order."""
    number = ids.id_number(F.col("activity_id"))
    bounds = coverage(nodes).groupBy(*NODE).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    parts = nodes.where(F.col("parent_path").isNotNull()).join(bounds, NODE).select(*MODEL, F.col("parent_path").alias("path"), "ordinal", "low", "high")
    return order_rules(parts, NODE, "V44")


def verdicts(all_findings: DataFrame, models: DataFrame) -> DataFrame:
    """Per model: number of errors and warnings; valid when there is no error."""
    counts = all_findings.groupBy(*MODEL).agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    out = models.select(*MODEL).distinct().join(counts, MODEL, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("errors", "warnings")})
    return out.withColumn("valid", F.col("errors") == 0)


def accepted(models: DataFrame, found: DataFrame) -> DataFrame:
    """Stored models that pass today's rules (R10), whatever their kind; the others are made again."""
    wrong = found.where(F.col("severity") == "error").select(*MODEL).distinct()
    return models.join(wrong, MODEL, "left_anti")


def gated(shape: DataFrame, deeper: DataFrame) -> DataFrame:
    """Deeper findings only for models without a shape error."""
    broken = shape.where(F.col("severity") == "error").select(*MODEL).distinct()
    return shape.unionByName(deeper.join(broken, MODEL, "left_anti"))


def hierarchy_findings(nodes, activities, owners, known, semantic, sources) -> DataFrame:
    """All rules of an objective tree."""
    activity_ids = activities.select(*MODEL, "activity_id").distinct()
    deeper = union_all(
        root_rules(nodes, sources), id_rules(nodes), evidence_rules(nodes, known), reference_rules(nodes, activity_ids),
        span_rules(nodes, owners), size_rules(nodes), partition_rules(nodes), root_cover_rules(nodes, activity_ids, semantic),
    )
    return gated(shape_rules(nodes), deeper)


# ---- procedure nodes (V24 - V31, V46) --------------------------------------------------------

# Wordings that say nothing about when a loop ends or how it is checked.
VAGUE_STOP_PREFIXES = ["until ", "continue until ", "repeat until "]
VAGUE_STOPS = [
    "done", "complete", "completed", "satisfied", "successful", "acceptable", "ready", "it works",
    "the task is done", "the work is complete", "the objective is satisfied",
]
SUBJECTIVE_PHRASES = [
    "clear enough", "good enough", "looks good", "behaves acceptably", "works properly", "works reliably",
    "as desired", "as expected", "until done", "until satisfied",
]
VAGUE_VERIFIERS = ["check", "verify", "observe", "inspect", "manual check", "human review", "unknown"]


def plain_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def vague_stop(c: Column) -> Column:
    """An exit text that names no observable state."""
    pattern = "|".join([f"^{p}" for p in VAGUE_STOP_PREFIXES] + [f"^{s}$" for s in VAGUE_STOPS] + SUBJECTIVE_PHRASES)
    return plain_words(c).rlike(pattern)


def vague_verifier(c: Column) -> Column:
    return plain_words(c).isin(VAGUE_VERIFIERS)


def operator_rules(nodes: DataFrame) -> DataFrame:
    """Operator contracts.  nodes: operator, bindings struct<iteration_variable, collection>, condition, grounding
    struct<predicate, verifier, status, evidence_refs>, activity_refs, has_body."""
    op, b, g = F.col("operator"), F.col("bindings"), F.col("grounding")
    loop = op == "WHILE"
    has_bindings = b.isNotNull() & (b["iteration_variable"].isNotNull() | b["collection"].isNotNull())
    tests = [
        ("V25", ~F.coalesce(op.isin(OPERATORS), F.lit(False)), op),
        ("V26", (op == "FOR") & blank(b["iteration_variable"]), F.lit("iteration_variable")),
        ("V26", (op == "FOR") & (F.coalesce(F.size(b["collection"]), F.lit(0)) <= 0), F.lit("collection")),
        ("V27", loop & blank(F.col("condition")), F.lit("condition")),
        ("V27", loop & g.isNotNull() & (F.trim("condition") != F.trim(g["predicate"])), F.lit("condition differs from predicate")),
        ("V27", loop & has_bindings, F.lit("bindings on WHILE")),
        ("V28", ~op.isin("FOR", "WHILE") & has_bindings, F.lit("bindings")),
        ("V28", ~loop & g.isNotNull(), F.lit("grounding")),
        ("V29", loop & g.isNull(), F.lit("grounding")),
        ("V29", loop & g.isNotNull() & (blank(g["predicate"]) | vague_stop(g["predicate"])), F.lit("vague predicate")),
        ("V29", loop & g.isNotNull() & (blank(g["verifier"]) | vague_verifier(g["verifier"])), F.lit("vague verifier")),
        ("V29", loop & g.isNotNull() & ~F.coalesce(g["status"].isin(CONDITION_STATUSES), F.lit(False)), F.lit("status")),
        ("V30", loop & (F.size(F.array_except(g["evidence_refs"], F.col("activity_refs"))) > 0), F.lit("evidence outside loop")),
        ("V31", ~F.col("has_body"), F.lit("no body")),
    ]
    return row_rules(nodes, tests)


def expression_rules(exprs: DataFrame) -> DataFrame:
    """Kinds of body expressions (V32), no activity leaf inside a loop (V33), leaf id form.

    exprs: kind (node, activity, operator, step, mixed, unknown), in_loop, activity_id, name, activity_refs.
    """
    leaf = F.col("kind") == "activity"
    tests = [
        ("V32", F.col("kind").isin("unknown", "mixed"), F.col("kind")),
        ("V32", (F.col("kind") == "step") & (blank(F.col("name")) | (F.coalesce(F.size("activity_refs"), F.lit(0)) <= 0)), F.lit("step")),
        ("V33", leaf & F.col("in_loop"), F.col("activity_id")),
        ("V46", leaf & ~F.coalesce(F.col("activity_id").rlike(r"^activity_\d{4,}$"), F.lit(False)), F.col("activity_id")),
    ]
    return row_rules(exprs, tests)


def known_leaf_rules(exprs: DataFrame, activities: DataFrame) -> DataFrame:
    """Well-formed activity leaves name an activity of the source (V46); a model without a source has no such rule.

    activities: session_id, root_id, activity_id.
    """
    leaves = exprs.where((F.col("kind") == "activity") & F.col("activity_id").rlike(r"^activity_\d{4,}$"))
    known = activities.select(*MODEL, "activity_id").distinct()
    unknown = leaves.join(known, [*MODEL, "activity_id"], "left_anti").join(known.select(*MODEL).distinct(), MODEL, "left_semi")
    return findings(unknown.withColumn("path", F.concat_ws("/", "node_id", "expr_path")), "V46", F.col("activity_id"))


def named_activities(exprs: DataFrame) -> DataFrame:
    """(expression, activity): what an expression itself names; an inline operator's stated references only repeat its body."""
    refs = F.when(F.col("kind") == "activity", F.array("activity_id")).otherwise(F.col("activity_refs"))
    inner = (F.col("kind") == "operator") & F.col("activity_refs").isNotNull()
    spread = F.flatten(F.transform(refs, lambda r: F.coalesce(ids.expand_range(r, ids.ACTIVITY), F.array().cast("array<string>"))))
    return exprs.where(~inner).select(*MODEL, "node_id", "expr_path", F.explode(spread).alias("activity_id"))


def expression_coverage(exprs: DataFrame) -> DataFrame:
    """(expression, activity): an expression covers what it and everything below it names.

    expr_path is slash-separated, so ancestors are its prefixes; no recursion is needed.
    """
    rows = named_activities(exprs)
    parts = F.split("expr_path", "/")
    up = rows.select(*MODEL, "node_id", "activity_id", parts.alias("_p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_d"))
    return up.select(*MODEL, "node_id", F.array_join(F.slice("_p", F.lit(1), F.col("_d")), "/").alias("expr_path"), "activity_id").distinct()


def inline_operator_rules(exprs: DataFrame) -> DataFrame:
    """Stated references of an inline operator equal what its body covers."""
    stated = exprs.where((F.col("kind") == "operator") & F.col("activity_refs").isNotNull())
    spread = F.flatten(F.transform("activity_refs", lambda r: F.coalesce(ids.expand_range(r, ids.ACTIVITY), F.array().cast("array<string>"))))
    place = F.concat_ws("/", "node_id", "expr_path").alias("path")
    # Coverage is spread only in nodes that state something.
    holding = exprs.join(stated.select(*MODEL, "node_id").distinct(), [*MODEL, "node_id"], "left_semi")
    left = expression_coverage(holding).join(stated.select(*MODEL, "node_id", "expr_path"), [*MODEL, "node_id", "expr_path"], "left_semi")
    right = stated.select(*MODEL, place, F.explode(spread).alias("activity_id"))
    return two_sided(left.select(*MODEL, place, "activity_id"), right, NODE, "activity_id", "V35")


def node_body_rules(nodes: DataFrame, exprs: DataFrame, edges: DataFrame) -> DataFrame:
    """References of a node equal those of its body and its child nodes together."""
    own = nodes.select(*MODEL, F.col("node_id").alias("path"), F.explode("activity_refs").alias("_r"))
    own = own.select(*NODE, F.explode(ids.expand_range(F.col("_r"), ids.ACTIVITY)).alias("activity_id"))
    # The node stands above all its expressions, so their own activities are enough.
    body = named_activities(exprs).select(*MODEL, F.col("node_id").alias("path"), "activity_id")
    child = own.withColumnRenamed("path", "child_id").join(edges, [*MODEL, "child_id"]).select(*MODEL, F.col("parent_id").alias("path"), "activity_id")
    return two_sided(body.unionByName(child), own, NODE, "activity_id", "V36")
