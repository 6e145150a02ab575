"""All rules of procedure models, from their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import flatten, graphs, keyset, procedure_rows, rules
from sessionloom.operators.rules import MODEL
from sessionloom.session import cut_lineage

TEXTS = ("node_id", "name", "description", "evidence_summary")


def shape_rules(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Keys of the model and its nodes (V1), texts of the nodes (V2)."""
    texts = [("V2", rules.blank(F.col(t)), F.lit(t)) for t in TEXTS]
    return keyset.key_findings(documents, keyset.PROCEDURE_MODEL).unionByName(rules.row_rules(nodes.withColumn("path", F.coalesce("node_id", F.lit("$"))), texts))


def procedure_findings(documents: DataFrame, activities: DataFrame) -> DataFrame:
    """Findings of every rule; a model with a shape error gets no deeper ones.

    documents: session_id, root_id, value. activities: session_id, root_id, activity_id, of the models' sources. Documents, and the node and
    expression tables parsed from them, are written, as each rule reads them.
    """
    documents = cut_lineage(documents.select(*MODEL, "value", F.get_json_object("value", "$.root_procedure_id").alias("root_procedure_id")))
    nodes = cut_lineage(flatten.procedure_nodes(documents))
    shape = cut_lineage(shape_rules(documents.select(*MODEL, "value"), nodes))
    broken = cut_lineage(shape.select(*MODEL).distinct())
    sound = documents.join(broken, MODEL, "left_anti")
    exprs = cut_lineage(flatten.body_expressions(sound))
    starts = sound.select(*MODEL, F.col("root_procedure_id").alias("node_id"))
    own = cut_lineage(nodes.join(broken, MODEL, "left_anti"))
    edges = exprs.where(F.col("kind") == "node").select(*MODEL, F.col("node_id").alias("parent_id"), F.col("procedure_node_id").alias("child_id"))
    placed = exprs.withColumn("path", F.concat_ws("/", "node_id", "expr_path"))
    deeper = rules.union_all(
        rules.operator_rules(own.withColumn("path", F.col("node_id"))), rules.expression_rules(placed), rules.known_leaf_rules(exprs, activities), rules.inline_operator_rules(exprs),
        rules.node_body_rules(own, exprs, edges), graphs.node_table_rules(own, starts.withColumnRenamed("node_id", "root_procedure_id")), graphs.dangling_rules(edges, own),
        graphs.parent_rules(edges, starts), graphs.cycle_rules(edges), graphs.reach_rules(edges, own, starts),
    )
    return shape.unionByName(deeper)


def model_findings(documents: DataFrame) -> DataFrame:
    """`procedure_findings` of documents that come with their source's activities: each is judged in its row, odd and large ones over tables.

    documents: session_id, root_id, value, known array<string> (null without a source).
    """
    held = procedure_rows.models(documents).withColumn("shape", procedure_rows.shape_findings(TEXTS))
    sound = F.col("fits") & (F.size("shape") == 0)
    held = held.withColumn("sound", sound).withColumn("deep", F.when(F.col("sound"), procedure_rows.deep_findings()))
    when_sound = [F.when(F.col("sound"), F.col(c)).alias(c) for c in ("nodes", "exprs")]
    held = cut_lineage(held.select(*MODEL, "fits", *when_sound, F.when(F.col("fits"), F.coalesce("deep", "shape")).alias("found")))
    told = held.select(*MODEL, F.explode("found").alias("_f")).select(*MODEL, "_f.path", "_f.rule_id", F.lit("error").alias("severity"), "_f.detail")
    nodes = held.select(*MODEL, F.explode("nodes").alias("_n")).select(*MODEL, "_n.*").withColumn("path", F.col("node_id"))
    exprs = held.select(*MODEL, F.explode("exprs").alias("_e")).select(*MODEL, "_e.*").withColumn("path", F.concat_ws("/", "node_id", "expr_path"))
    told = rules.union_all(told, rules.operator_rules(nodes), rules.expression_rules(exprs))
    odd = held.where("not fits").select(*MODEL)
    if odd.isEmpty():
        return told
    rest = cut_lineage(documents.join(odd, MODEL, "left_semi"))
    activities = rest.select(*MODEL, F.explode("known").alias("activity_id"))
    return told.unionByName(procedure_findings(rest.select(*MODEL, "value"), activities))
