"""Rules of unified models (V41-V43, V45) over flattened rows, and acceptance of stored models by today's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.bind import let
from sessionloom.operators import rules
from sessionloom.operators.rules import MODEL, NODE, blank, findings, gated, row_rules, union_all
from sessionloom.operators.sequence import order_sessions

# The accepted version and the only keys of the outer object.
VERSION = "0.2"
KEYS = ("version", "root")
#: Steps up to which a model is judged in its own row.
STEPS = 1_000


def _shape_tests() -> list[tuple[str, Column, Column]]:
    wanted = F.array(*(F.lit(k) for k in KEYS))
    missing, extra = F.array_except(wanted, "keys"), F.array_except("keys", wanted)
    return [
        ("V41", F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(F.sort_array(missing), ","))),
        ("V41", F.size(extra) > 0, F.concat(F.lit("extra "), F.array_join(F.sort_array(extra), ","))),
        ("V41", F.coalesce(F.col("version") != VERSION, F.lit(True)), F.concat(F.lit("version "), F.coalesce("version", F.lit("none")))),
    ]


def shape_rules(models: DataFrame) -> DataFrame:
    """Version is the accepted one and the outer object has its two keys only. models: version, keys array<string>."""
    return row_rules(models, _shape_tests())


def body_rules(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """A body has steps, and each step a name and references; V43: steps are disjoint, those of a SEQ in source order.

    nodes: path, operator; steps: path, ordinal, name, refs array<bigint> (source positions).
    """
    empty = findings(nodes.join(steps.select(*NODE).distinct(), NODE, "left_anti"), "V42", F.lit("empty body"))
    place = F.col("ordinal").cast("string")
    no_refs = F.coalesce(F.size("refs"), F.lit(0)) <= 0
    shaped = row_rules(steps, [("V42", blank(F.col("name")), F.concat(F.lit("name "), place)), ("V42", no_refs, F.concat(F.lit("refs "), place))])
    held = steps.select(*NODE, "ordinal", F.explode("refs").alias("ref")).distinct()
    first = held.groupBy(*NODE, "ref").agg(F.min("ordinal").alias("first"))
    again = held.join(first, [*NODE, "ref"]).where(F.col("ordinal") > F.col("first")).select(*NODE, "ordinal").distinct()
    overlap = findings(again, "V43", F.concat(F.lit("overlap "), F.col("ordinal").cast("string")))
    bounds = steps.where(~no_refs).join(nodes.where(F.col("operator") == "SEQ").select(*NODE), NODE, "left_semi")
    # Each step only looks back to the step before it.
    bounds = bounds.select(*NODE, "ordinal", F.array_min("refs").alias("low"), F.array_max("refs").alias("high"))
    return union_all(empty, shaped, overlap, follows_rules(bounds))


def follows_rules(parts: DataFrame) -> DataFrame:
    """A part starts after the part before it ends. parts: path, ordinal, low, high."""
    so = order_sessions(parts, NODE, "ordinal").neighbours(prev={"_before": "high"})
    return findings(so.df.where(F.col("low") <= F.col("_before")), "V43", F.concat(F.lit("order "), F.col("ordinal").cast("string")))


def body_cover_rules(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """An inner node's body lies within the node, a leaf's body is the node. nodes: path, is_leaf, refs array<bigint>."""
    body = steps.select(*NODE, F.explode("refs").alias("ref")).distinct().withColumn("_body", F.lit(True))
    own = nodes.select(*NODE, F.explode("refs").alias("ref")).distinct().withColumn("_own", F.lit(True))
    both = body.join(own, [*NODE, "ref"], "full").where(F.col("_body").isNull() | F.col("_own").isNull())
    both = both.join(nodes.select(*NODE, "is_leaf"), NODE).where(F.col("_own").isNull() | F.col("is_leaf"))
    word = F.when(F.col("_own").isNull(), "outside ").otherwise("missing ")
    return findings(both, "V45", F.concat(word, F.col("ref").cast("string")))


def unified_rules(models: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """All findings; models whose shape is wrong get no deeper ones."""
    return gated(shape_rules(models), union_all(body_rules(nodes, steps), body_cover_rules(nodes, steps)))


def accepted(models: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Stored models that pass today's rules."""
    return rules.accepted(models, unified_rules(models, nodes, steps))


# ---- models of bounded size, in their own row ------------------------------------------------


def _told(path: Column, rule: str, details: Column) -> Column:
    return F.transform(details, lambda d: F.struct(path.cast("string").alias("path"), F.lit(rule).alias("rule_id"), d.alias("detail")))


def _where(items: Column, bad, detail) -> Column:
    return F.transform(F.filter(items, lambda x: F.coalesce(bad(x), F.lit(False))), detail)


def _node_findings(node: Column) -> Column:
    """V42, V43 and V45 of one node: what `body_rules` and `body_cover_rules` say of it."""
    steps, path = F.array_sort(node["steps"]), node["path"]
    at = lambda word: lambda x: F.concat(F.lit(f"{word} "), x["ordinal"].cast("string"))
    refs = lambda x: F.coalesce(F.size(x["refs"]), F.lit(0))
    named = lambda word: lambda r: F.concat(F.lit(f"{word} "), r.cast("string"))
    none = F.array().cast("array<string>")

    def judged(s: Column) -> Column:
        held = F.filter(s, lambda x: refs(x) > 0)
        each = F.flatten(F.transform(held, lambda x: F.array_distinct(x["refs"])))
        before = lambda x: F.flatten(F.transform(F.filter(held, lambda y: y["ordinal"] < x["ordinal"]), lambda y: y["refs"]))
        # Only a body that names something twice is compared step by step.
        again = F.when(F.size(F.array_distinct(each)) < F.size(each), F.array_distinct(_where(held, lambda x: F.arrays_overlap(x["refs"], before(x)), at("overlap")))).otherwise(none)
        late = let(held, lambda h: F.filter(
            F.transform(h, lambda x, i: F.when((i > 0) & (F.array_min(x["refs"]) <= F.array_max(F.get(h, i - 1)["refs"])), at("order")(x))), lambda d: d.isNotNull()
        ))
        outside = F.transform(F.array_except(each, node["refs"]), named("outside"))
        lost = F.when(node["is_leaf"], F.transform(F.array_except(node["refs"], each), named("missing"))).otherwise(none)
        return F.concat(
            _told(path, "V42", F.when(F.size(s) == 0, F.array(F.lit("empty body"))).otherwise(none)), _told(path, "V42", _where(s, lambda x: blank(x["name"]), at("name"))),
            _told(path, "V42", _where(s, lambda x: refs(x) <= 0, at("refs"))), _told(path, "V43", again),
            _told(path, "V43", F.when(node["operator"] == "SEQ", late).otherwise(none)), _told(path, "V45", outside), _told(path, "V45", lost),
        )

    return let(steps, judged)


def _model_findings() -> Column:
    """Findings of a model's row; one whose shape is wrong gets no deeper ones."""
    hits = F.filter(
        F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit("$").alias("path"), F.lit(rule).alias("rule_id"), detail.alias("detail"))) for rule, bad, detail in _shape_tests())),
        lambda h: h.isNotNull(),
    )
    return let(hits, lambda shape: F.when(F.size(shape) > 0, shape).otherwise(F.flatten(F.transform("nodes", _node_findings))))


def model_rules(models: DataFrame) -> DataFrame:
    """`unified_rules` over models that hold their parts: no join and no shuffle.

    models: version, keys array<string>, nodes array<struct<path, is_leaf, operator, refs array<bigint>, steps array<struct<ordinal, name, refs array<bigint>>>>>.
    A step's first field is its ordinal, which no other step of the node has; references are not null. For models of up to `STEPS` steps, so that a row stays small.
    """
    told = models.select(*MODEL, F.explode(_model_findings()).alias("_f"))
    return told.select(*MODEL, "_f.path", "_f.rule_id", F.lit("error").alias("severity"), "_f.detail")


def accepted_models(models: DataFrame) -> DataFrame:
    """`accepted` for models that hold their parts."""
    return models.where(F.size(_model_findings()) == 0)
