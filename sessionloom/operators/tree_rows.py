"""Tree rules inside a document's own row, for trees of bounded size: no node table, no shuffle.

The rules are those of `rules` after `normalize.position_ids` and `normalize.fill_references`; which of them a tree breaks is the same. Ids are made from places, so
the rules on ids (V8, V10 to V12) hold without a look. A tree that is too large for a row is left to the node table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import ids
from sessionloom.operators import flatten
from sessionloom.operators.trees import MODEL

#: Nodes, and ids behind all references and of the source, up to which a tree is judged in its row.
NODES = 64
IDS = 2_000


def broken_rules(documents: DataFrame, n_known: Column, known: Column, requires_decomposition: Column) -> DataFrame:
    """session_id, root_id and the names of the rules that each tree breaks, sorted; null where the tree is too large.

    documents: session_id, root_id, value and the columns of the other arguments. known: the source's activity ids, one semantic action each.
    """
    rows = flatten.tree_arrays(documents, NODES)
    behind = F.aggregate(F.flatten(F.transform("nodes", lambda x: x["refs"])), F.lit(0).cast("bigint"), lambda total, r: total + ids.range_size(r))
    fits = F.coalesce((behind <= IDS) & (n_known <= IDS), F.lit(False))
    # What several expressions use is a column of its own, so that it is made once.
    rows = rows.withColumn("fits", fits)
    rows = rows.select(*MODEL, F.when(F.col("fits"), F.col("nodes")).alias("nodes"), F.when(F.col("fits"), known).alias("known"), requires_decomposition.alias("split"))
    none = F.array().cast("array<string>")
    spread = lambda x: F.array_distinct(F.flatten(F.transform(x["refs"], lambda r: F.coalesce(ids.expand_range(r), none))))
    node = lambda x, items: F.struct(x["path"].alias("path"), x["parent_path"].alias("parent_path"), (F.size(x["refs"]) == 0).alias("empty"), items.alias("items"))
    rows = rows.withColumns({"nodes": F.transform("nodes", lambda x: node(x, spread(x))), "numbers": F.transform("known", ids.id_number)})

    def filled(x: Column) -> Column:
        """A node without references takes its descendants' activities by number, the root the source's too."""
        below = F.flatten(F.transform(F.filter("nodes", lambda y: y["path"].startswith(F.concat(x["path"], F.lit(".")))), lambda y: y["items"]))
        # Ids out of references end in their number for certain.
        numbers = F.transform(below, lambda i: F.substring_index(i, "_", -1).try_cast("int"))
        numbers = F.when(x["parent_path"].isNull(), F.concat(numbers, F.col("numbers"))).otherwise(numbers)
        return F.transform(F.array_distinct(F.filter(numbers, lambda i: i.isNotNull())), lambda i: ids.range_text("activity", i, i))

    rows = rows.withColumn("nodes", F.transform("nodes", lambda x: F.struct(x["path"].alias("path"), x["parent_path"].alias("parent_path"), F.when(x["empty"], filled(x)).otherwise(x["items"]).alias("items"))))
    # Activities beside the place they count at; neither has a bar in it.
    placed = lambda nodes, at: F.flatten(F.transform(nodes, lambda x: F.transform(x["items"], lambda i: F.concat(x[at], F.lit("|"), i))))
    children = F.filter("nodes", lambda x: x["parent_path"].isNotNull())
    root = F.filter("nodes", lambda x: x["parent_path"].isNull())
    held = lambda nodes: F.flatten(F.transform(nodes, lambda x: x["items"]))
    rows = rows.select(
        *MODEL, "nodes", "known", "split", placed(F.col("nodes"), "path").alias("own"), placed(children, "parent_path").alias("below"), held(root).alias("root"), held(F.col("nodes")).alias("tree"),
    )
    parents = F.transform(F.filter("nodes", lambda x: x["parent_path"].isNotNull() & (F.size(x["items"]) > 0)), lambda x: x["parent_path"])
    some = lambda items: F.size(items) > 0
    missing = F.array_intersect(F.transform(F.array_except("own", "below"), lambda p: F.substring_index(p, "|", 1)), parents)
    rows = rows.select(
        *MODEL, F.col("nodes").isNotNull().alias("fits"), (F.size("nodes") == 1).alias("alone"), "split", some(F.array_except("below", "own")).alias("outside"), (F.size(F.array_distinct("below")) < F.size("below")).alias("repeated"),
        some(missing).alias("missing"), some(F.array_except("known", "root")).alias("uncovered"), (some(F.col("known")) & some(F.array_except("root", "known"))).alias("unknown"),
        some(F.array_except("known", "tree")).alias("lost"),
    )
    tests = [
        ("V19", F.col("outside")), ("V20", F.col("repeated")), ("V21", F.col("outside") | F.col("missing")), ("V22", F.col("uncovered") | F.col("unknown")),
        ("V23", F.col("uncovered")), ("V23t", F.col("lost")), ("V9", F.col("split") & F.col("alone")),
    ]
    broken = F.filter(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in tests)), lambda rule: rule.isNotNull())
    return rows.select(*MODEL, F.when(F.col("fits"), broken).alias("rules"))
