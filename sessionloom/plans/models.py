"""Queries over objective trees and procedure graphs, and their integrity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions import ids
from sessionloom.operators import evidence, graphs, rules, trees
from sessionloom.operators.sequence import order_sessions
from sessionloom.plans.base import query, table
from sessionloom.plans.standins import with_ctes

# ---- objective trees: one per region; nations and customers below; one activity per customer --

TREE_SQL = """
cust AS (
  SELECT c_custkey AS ck, c_nationkey AS nk, n_regionkey AS rk, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_nationkey, c_custkey) - 1 AS act,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS j FROM customer JOIN nation ON c_nationkey = n_nationkey
),
nat AS (
  SELECT n_nationkey AS nk, n_regionkey AS rk, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, lo, hi
  FROM nation JOIN (SELECT nk AS k, min(act) AS lo, max(act) AS hi FROM cust GROUP BY nk) ON n_nationkey = k
),
tree_nodes AS (
  SELECT concat('C', rk + 1) AS root_id, '$' AS path, NULL AS parent_path, concat('C', rk + 1) AS node_id, 0 AS ordinal, 0 AS depth, concat('region ', rk) AS objective,
    concat(printf('activity_%04d', min(lo)), '-', printf('activity_%04d', max(hi))) AS ref, -1 AS ck, min(lo) AS act FROM nat GROUP BY rk
  UNION ALL
  SELECT concat('C', rk + 1), concat('$.decomposition[', i - 1, ']'), '$', concat('C', rk + 1, '.', i), i, 1, n_name,
    concat(printf('activity_%04d', lo), '-', printf('activity_%04d', hi)), -1, lo FROM nat
  UNION ALL
  SELECT concat('C', c.rk + 1), concat('$.decomposition[', i - 1, '].decomposition[', j - 1, ']'), concat('$.decomposition[', i - 1, ']'),
    CASE WHEN ck % 61 = 3 THEN concat('X.', j) WHEN ck % 53 = 9 THEN concat('C', c.rk + 1, '.', i, '.', j + 1000) ELSE concat('C', c.rk + 1, '.', i, '.', j) END,
    j, 2, c_mktsegment, CASE WHEN ck % 97 = 5 THEN 'activity_12' ELSE printf('activity_%04d', act + CASE WHEN ck % 40 = 7 THEN 1 ELSE 0 END) END, ck, act
  FROM cust c JOIN nat n ON c.nk = n.nk
),
source_acts AS (SELECT concat('C', rk + 1) AS root_id, act, printf('activity_%04d', act) AS activity_id FROM cust WHERE ck % 71 <> 2),
cover AS (
  SELECT root_id, path, parent_path, node_id, depth, printf('activity_%04d', a) AS activity_id, a FROM (
    SELECT *, unnest(range(CAST(regexp_extract(ref, '^activity_([0-9]+)', 1) AS BIGINT), 1 + CAST(regexp_extract(ref, 'activity_([0-9]+)$', 1) AS BIGINT))) AS a
    FROM tree_nodes WHERE regexp_matches(ref, '^activity_[0-9]{4,}(-activity_[0-9]{4,})?$'))
)
"""
MODEL = ["session_id", "root_id"]


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"), "n_name")
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ck"), F.col("c_nationkey").alias("nk"), "c_mktsegment", "c_acctbal"
    ).join(nations, "nk")
    order = F.col("nk") * F.lit(1e12) + F.col("ck")
    so = order_sessions(rows.withColumn("_o", order), "rk", ("_o", "ck")).index("act")
    return order_sessions(so.df, "nk", "ck").index("j", start=1).df.drop("_o")


def tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Node table with some faults: wrong ids, shifted and malformed references, foreign evidence."""
    cust = _customers(spark, folder)
    nat = cust.groupBy("rk", "nk", "n_name").agg(F.min("act").alias("lo"), F.max("act").alias("hi"))
    nat = nat.withColumn("i", F.row_number().over(Window.partitionBy("rk").orderBy("nk")))  # at most 25 nations
    root_id = F.concat(F.lit("C"), (F.col("rk") + 1).cast("string"))
    act_id = lambda n: ids.padded("activity_", n)
    both = lambda lo, hi: F.concat(act_id(lo), F.lit("-"), act_id(hi))
    nation_path = F.concat(F.lit("$.decomposition["), (F.col("i") - 1).cast("string"), F.lit("]"))
    nation_id = F.concat_ws(".", root_id, F.col("i").cast("string"))

    def shape(path, parent, node, ordinal, depth, objective, ref, ck, act):
        return [
            F.lit("s").alias("session_id"), root_id.alias("root_id"), path.alias("path"), parent.alias("parent_path"), node.alias("node_id"),
            ordinal.cast("bigint").alias("ordinal"), F.lit(depth).alias("depth"), objective.alias("objective"), F.array(ref).alias("refs"),
            ck.cast("bigint").alias("ck"), act.cast("bigint").alias("act"),
        ]

    none = F.lit(None).cast("string")
    roots = nat.groupBy("rk").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
        *shape(F.lit("$"), none, root_id, F.lit(0), 0, F.concat(F.lit("region "), F.col("rk").cast("string")), both(F.col("lo"), F.col("hi")), F.lit(-1), F.col("lo"))
    )
    inner = nat.select(*shape(nation_path, F.lit("$"), nation_id, F.col("i"), 1, F.col("n_name"), both(F.col("lo"), F.col("hi")), F.lit(-1), F.col("lo")))
    ck, j = F.col("ck"), F.col("j")
    leaf_id = (
        F.when(ck % 61 == 3, F.concat(F.lit("X."), j.cast("string")))
        .when(ck % 53 == 9, F.concat_ws(".", nation_id, (j + 1000).cast("string")))
        .otherwise(F.concat_ws(".", nation_id, j.cast("string")))
    )
    leaf_path = F.concat(nation_path, F.lit(".decomposition["), (j - 1).cast("string"), F.lit("]"))
    ref = F.when(ck % 97 == 5, "activity_12").otherwise(act_id(F.col("act") + F.when(ck % 40 == 7, 1).otherwise(0)))
    leaf = cust.join(F.broadcast(nat.select("nk", "i")), "nk").select(  # 25 nations
        *shape(leaf_path, nation_path, leaf_id, j, 2, F.col("c_mktsegment"), ref, ck, F.col("act"))
    )
    return roots.unionByName(inner).unionByName(leaf)


def with_evidence(nodes: DataFrame) -> DataFrame:
    ck, act = F.col("ck"), F.col("act")
    cited = F.when(ck % 43 == 0, F.lit("ghost")).when(ck % 37 == 0, ids.padded("activity_", act + 5)).otherwise(ids.padded("activity_", act))
    return nodes.withColumn("evidence_refs", F.array(cited, ids.padded("semantic_action_", act)))


def source_activities(spark: SparkSession, folder: str) -> DataFrame:
    act = F.col("act")
    return _customers(spark, folder).where(F.col("ck") % 71 != 2).select(
        F.lit("s").alias("session_id"), F.concat(F.lit("C"), (F.col("rk") + 1).cast("string")).alias("root_id"), "act",
        ids.padded("activity_", act).alias("activity_id"), F.array(ids.padded("semantic_action_", act)).alias("semantic_action_ids"),
        F.array(F.concat(F.lit("a"), act.cast("string")), F.concat(F.lit("a"), (act + 1).cast("string"))).alias("raw_action_ids"),
        act.alias("start_semantic_action_idx"), act.alias("end_semantic_action_idx"),
    )


@query(
    "range_expand",
    with_ctes(TREE_SQL) + "SELECT root_id, path, activity_id FROM cover",
)
def range_expand(spark: SparkSession, folder: str) -> DataFrame:
    return trees.coverage(tree_nodes(spark, folder)).select("root_id", "path", "activity_id")


@query(
    "range_compact",
    with_ctes(TREE_SQL)
    + """, g AS (SELECT root_id, act, act - row_number() OVER (PARTITION BY root_id ORDER BY act) AS grp FROM source_acts)
SELECT root_id, row_number() OVER (PARTITION BY root_id ORDER BY min(act)) AS range_no, min(act) AS start_no, max(act) AS end_no,
  CASE WHEN min(act) = max(act) THEN printf('activity_%04d', min(act)) ELSE concat(printf('activity_%04d', min(act)), '-', printf('activity_%04d', max(act))) END AS ref
FROM g GROUP BY root_id, grp""",
)
def range_compact(spark: SparkSession, folder: str) -> DataFrame:
    return trees.compact_ranges(source_activities(spark, folder), ["root_id"], number="act")


@query(
    "tree_coverage",
    with_ctes(TREE_SQL)
    + """, up AS (SELECT DISTINCT root_id, node_id, unnest([array_to_string(list_slice(string_split(node_id, '.'), 1, d), '.') FOR d IN range(1, len(string_split(node_id, '.')) + 1)]) AS anc FROM tree_nodes)
SELECT c.root_id, u.anc AS node_id, count(DISTINCT activity_id) AS n_activities, min(activity_id) AS first_activity_id, max(activity_id) AS last_activity_id
FROM cover c JOIN up u ON c.root_id = u.root_id AND c.node_id = u.node_id GROUP BY ALL""",
)
def tree_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = trees.subtree_coverage(tree_nodes(spark, folder))
    return rows.groupBy("root_id", "node_id").agg(
        F.count(F.lit(1)).alias("n_activities"), F.min("activity_id").alias("first_activity_id"), F.max("activity_id").alias("last_activity_id")
    )


@query("tree_leaves", with_ctes(TREE_SQL) + "SELECT root_id, path, node_id, objective FROM tree_nodes WHERE depth = 2")
def tree_leaves(spark: SparkSession, folder: str) -> DataFrame:
    return trees.leaves(tree_nodes(spark, folder)).select("root_id", "path", "node_id", "objective")


@query(
    "ref_counts",
    with_ctes(TREE_SQL) + "SELECT t.root_id, t.path, 1 AS n_refs, count(c.activity_id) AS n_activities FROM tree_nodes t LEFT JOIN cover c ON t.root_id = c.root_id AND t.path = c.path GROUP BY ALL",
)
def ref_counts(spark: SparkSession, folder: str) -> DataFrame:
    return trees.ref_counts(tree_nodes(spark, folder)).select("root_id", "path", "n_refs", F.col("n_activities").cast("bigint").alias("n_activities"))


@query(
    "coverage_timeline",
    with_ctes(TREE_SQL)
    + """SELECT c.root_id, path, c.activity_id, round(act * 100.0 / total, 6) AS left_pct, round(greatest(0.4, 100.0 / total), 6) AS width_pct
FROM cover c JOIN source_acts s ON c.root_id = s.root_id AND c.activity_id = s.activity_id JOIN (SELECT root_id, count(*) AS total FROM source_acts GROUP BY ALL) t ON t.root_id = c.root_id WHERE depth = 1""",
)
def coverage_timeline(spark: SparkSession, folder: str) -> DataFrame:
    nodes = tree_nodes(spark, folder).where(F.col("depth") == 1)
    acts = source_activities(spark, folder).select(F.col("root_id").alias("session_id"), "activity_id", F.col("act").alias("position"))
    total = acts.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    covered = trees.coverage(nodes).select(F.col("root_id").alias("session_id"), "path", "activity_id")
    out = trees.timeline(covered, acts, total)
    return out.select(
        F.col("session_id").alias("root_id"), "path", "activity_id", F.round("left_pct", 6).alias("left_pct"), F.round("width_pct", 6).alias("width_pct")
    )


@query(
    "report_tree",
    with_ctes(TREE_SQL)
    + """SELECT root_id, node_id, array_to_string([lpad(p, 8, '0') FOR p IN string_split(node_id, '.')], '.') AS sort_key, concat(repeat('  ', depth), '- **', node_id, '** ', objective, ' (', ref, ')') AS line FROM tree_nodes""",
)
def report_tree(spark: SparkSession, folder: str) -> DataFrame:
    return trees.tree_lines(tree_nodes(spark, folder)).drop("session_id")


# ---- evidence --------------------------------------------------------------------------------

EVIDENCE_SQL = """
owners AS (
  SELECT root_id, activity_id, activity_id AS evidence_id FROM source_acts UNION SELECT root_id, activity_id, printf('semantic_action_%04d', act) FROM source_acts
  UNION SELECT root_id, activity_id, concat('a', act) FROM source_acts UNION SELECT root_id, activity_id, concat('a', act + 1) FROM source_acts
),
cited AS (
  SELECT root_id, path, CASE WHEN ck % 43 = 0 THEN 'ghost' WHEN ck % 37 = 0 THEN printf('activity_%04d', act + 5) ELSE printf('activity_%04d', act) END AS evidence_id FROM tree_nodes
  UNION SELECT root_id, path, printf('semantic_action_%04d', act) FROM tree_nodes
)
"""


@query("evidence_owners", with_ctes(TREE_SQL, EVIDENCE_SQL) + "SELECT root_id, evidence_id, activity_id FROM owners")
def evidence_owners(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.evidence_owners(source_activities(spark, folder)).drop("session_id")


@query(
    "known_ids",
    with_ctes(TREE_SQL, EVIDENCE_SQL)
    + "SELECT root_id, evidence_id FROM owners UNION SELECT root_id, activity_id FROM cover WHERE depth = 1",
)
def known_ids(spark: SparkSession, folder: str) -> DataFrame:
    owners = evidence.evidence_owners(source_activities(spark, folder))
    listed = tree_nodes(spark, folder).where(F.col("depth") == 1).select(*MODEL, "refs")
    return evidence.known_ids(owners, listed).drop("session_id")


FINDING = ["root_id", "path", "rule_id", "severity", "detail"]


@query(
    "unknown_evidence",
    with_ctes(TREE_SQL, EVIDENCE_SQL)
    + """SELECT root_id, path, 'V13' AS rule_id, 'error' AS severity, evidence_id AS detail FROM cited c WHERE NOT EXISTS
  (SELECT 1 FROM owners o WHERE o.root_id = c.root_id AND o.evidence_id = c.evidence_id)""",
)
def unknown_evidence(spark: SparkSession, folder: str) -> DataFrame:
    owners = evidence.evidence_owners(source_activities(spark, folder))
    return rules.evidence_rules(with_evidence(tree_nodes(spark, folder)), evidence.known_ids(owners)).select(FINDING)


@query(
    "evidence_out_of_span",
    with_ctes(TREE_SQL, EVIDENCE_SQL)
    + """SELECT c.root_id, c.path, 'V16' AS rule_id, 'error' AS severity, c.evidence_id AS detail FROM cited c JOIN owners o ON o.root_id = c.root_id AND o.evidence_id = c.evidence_id
LEFT JOIN cover v ON v.root_id = c.root_id AND v.path = c.path AND v.activity_id = o.activity_id GROUP BY ALL HAVING count(v.path) = 0""",
)
def evidence_out_of_span(spark: SparkSession, folder: str) -> DataFrame:
    owners = evidence.evidence_owners(source_activities(spark, folder))
    return rules.span_rules(with_evidence(tree_nodes(spark, folder)), owners).select(FINDING)


# ---- tree rules ------------------------------------------------------------------------------


@query(
    "rule_partition",
    with_ctes(TREE_SQL)
    + """, u AS (SELECT root_id, parent_path AS path, activity_id, count(*) AS n FROM cover WHERE parent_path IS NOT NULL GROUP BY ALL)
SELECT c.root_id, c.path, 'V19' AS rule_id, 'error' AS severity, c.activity_id AS detail FROM cover c WHERE parent_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cover p WHERE p.root_id = c.root_id AND p.path = c.parent_path AND p.activity_id = c.activity_id)
UNION ALL SELECT root_id, path, 'V20', 'error', activity_id FROM u WHERE n > 1
UNION ALL SELECT root_id, path, 'V21', 'error', concat('missing ', activity_id) FROM cover c WHERE depth < 2 AND NOT EXISTS (SELECT 1 FROM u WHERE u.root_id = c.root_id AND u.path = c.path AND u.activity_id = c.activity_id)
UNION ALL SELECT root_id, path, 'V21', 'error', concat('extra ', activity_id) FROM u WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE u.root_id = c.root_id AND u.path = c.path AND u.activity_id = c.activity_id)""",
)
def rule_partition(spark: SparkSession, folder: str) -> DataFrame:
    return rules.partition_rules(tree_nodes(spark, folder)).select(FINDING)


@query(
    "rule_child_ids",
    with_ctes(TREE_SQL)
    + """SELECT root_id, '$' AS path, 'V10' AS rule_id, 'error' AS severity, node_id AS detail FROM tree_nodes GROUP BY root_id, node_id HAVING count(*) > 1
UNION ALL SELECT c.root_id, c.path, 'V11', 'error', c.node_id FROM tree_nodes c JOIN tree_nodes p ON c.root_id = p.root_id AND c.parent_path = p.path WHERE NOT starts_with(c.node_id, concat(p.node_id, '.'))
UNION ALL SELECT c.root_id, c.path, 'V12', 'error', c.node_id FROM tree_nodes c JOIN tree_nodes p ON c.root_id = p.root_id AND c.parent_path = p.path WHERE c.node_id <> concat(p.node_id, '.', c.ordinal)""",
)
def rule_child_ids(spark: SparkSession, folder: str) -> DataFrame:
    return rules.id_rules(tree_nodes(spark, folder)).select(FINDING)


@query(
    "rule_references",
    with_ctes(TREE_SQL)
    + """SELECT root_id, path, 'V14' AS rule_id, 'error' AS severity, ref AS detail FROM tree_nodes WHERE NOT regexp_matches(ref, '^activity_[0-9]{4,}(-activity_[0-9]{4,})?$')
UNION ALL SELECT root_id, path, 'V14', 'error', activity_id FROM cover c WHERE NOT EXISTS (SELECT 1 FROM source_acts s WHERE s.root_id = c.root_id AND s.activity_id = c.activity_id)""",
)
def rule_references(spark: SparkSession, folder: str) -> DataFrame:
    known = source_activities(spark, folder).select(*MODEL, "activity_id")
    return rules.reference_rules(tree_nodes(spark, folder), known).select(FINDING)


@query(
    "rule_root_cover",
    with_ctes(TREE_SQL)
    + """, r AS (SELECT root_id, activity_id, a FROM cover WHERE depth = 0)
SELECT root_id, '$' AS path, 'V22' AS rule_id, 'error' AS severity, concat('extra ', activity_id) AS detail FROM r WHERE NOT EXISTS (SELECT 1 FROM source_acts s WHERE s.root_id = r.root_id AND s.activity_id = r.activity_id)
UNION ALL SELECT root_id, '$', 'V22', 'error', concat('missing ', activity_id) FROM source_acts s WHERE NOT EXISTS (SELECT 1 FROM r WHERE s.root_id = r.root_id AND s.activity_id = r.activity_id)
UNION ALL SELECT root_id, '$', 'V23', 'error', concat('missing ', act) FROM source_acts s WHERE NOT EXISTS (SELECT 1 FROM r WHERE s.root_id = r.root_id AND s.activity_id = r.activity_id)
UNION ALL SELECT root_id, '$', 'V23t', 'error', CAST(act AS VARCHAR) FROM source_acts s WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE s.root_id = c.root_id AND s.activity_id = c.activity_id)""",
)
def rule_root_cover(spark: SparkSession, folder: str) -> DataFrame:
    acts = source_activities(spark, folder)
    return rules.root_cover_rules(tree_nodes(spark, folder), acts.select(*MODEL, "activity_id"), evidence.semantic_index(acts)).select(FINDING)


@query(
    "rule_warnings",
    with_ctes(TREE_SQL)
    + """, n AS (SELECT t.root_id, t.path, t.depth, count(c.activity_id) AS n FROM tree_nodes t LEFT JOIN cover c ON t.root_id = c.root_id AND t.path = c.path GROUP BY ALL)
SELECT root_id, path, 'V17' AS rule_id, 'error' AS severity, CAST(n AS VARCHAR) AS detail FROM n WHERE n = 1 AND depth < 2
UNION ALL SELECT root_id, path, 'V18a', 'warning', CAST(n AS VARCHAR) FROM n WHERE n = 1 AND depth > 0
UNION ALL SELECT root_id, path, 'V18b', 'warning', CAST(n AS VARCHAR) FROM n WHERE n > 20
UNION ALL SELECT root_id, path, 'V18c', 'warning', CAST(n AS VARCHAR) FROM n WHERE n > 0 AND n < 5 AND depth < 2""",
)
def rule_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return rules.size_rules(tree_nodes(spark, folder)).select(FINDING)


@query(
    "rule_sibling_order",
    with_ctes(TREE_SQL)
    + """, b AS (SELECT c.root_id, c.parent_path AS path, t.ordinal, min(a) AS low, max(a) AS high FROM cover c JOIN tree_nodes t ON c.root_id = t.root_id AND c.path = t.path WHERE c.parent_path IS NOT NULL GROUP BY ALL)
SELECT root_id, path, 'V44' AS rule_id, 'error' AS severity, CAST(ordinal AS VARCHAR) AS detail FROM
  (SELECT *, max(high) OVER (PARTITION BY root_id, path ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) WHERE low <= before""",
)
def rule_sibling_order(spark: SparkSession, folder: str) -> DataFrame:
    return rules.sibling_order_rules(tree_nodes(spark, folder)).select(FINDING)


@query(
    "verdicts",
    with_ctes(TREE_SQL)
    + """, bad AS (SELECT c.root_id FROM tree_nodes c JOIN tree_nodes p ON c.root_id = p.root_id AND c.parent_path = p.path WHERE NOT starts_with(c.node_id, concat(p.node_id, '.'))
  UNION ALL SELECT c.root_id FROM tree_nodes c JOIN tree_nodes p ON c.root_id = p.root_id AND c.parent_path = p.path WHERE c.node_id <> concat(p.node_id, '.', c.ordinal)
  UNION ALL SELECT root_id FROM (SELECT root_id, node_id FROM tree_nodes GROUP BY ALL HAVING count(*) > 1)),
big AS (SELECT root_id, path FROM cover GROUP BY ALL HAVING count(*) > 20), one AS (SELECT root_id, path FROM cover WHERE depth > 0 GROUP BY ALL HAVING count(*) = 1)
SELECT t.root_id, (SELECT count(*) FROM bad b WHERE b.root_id = t.root_id) AS errors,
  (SELECT count(*) FROM big b WHERE b.root_id = t.root_id) + (SELECT count(*) FROM one o WHERE o.root_id = t.root_id) AS warnings,
  (SELECT count(*) FROM bad b WHERE b.root_id = t.root_id) = 0 AS valid FROM (SELECT DISTINCT root_id FROM tree_nodes) t""",
)
def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    nodes = tree_nodes(spark, folder)
    found = rules.id_rules(nodes).unionByName(rules.size_rules(nodes).where(F.col("rule_id").isin("V18a", "V18b")))
    return rules.verdicts(found, nodes).drop("session_id")


@query(
    "rule_shape",
    with_ctes(TREE_SQL)
    + """, n AS (SELECT t.*, CASE WHEN c_acctbal < 0 THEN ' ' ELSE 'sum' END AS summary, c_acctbal / 9000 AS conf, ['achieved', 'partial', 'failed', 'abandoned', 'unknown', 'done'][t.ck % 6 + 1] AS status FROM tree_nodes t JOIN cust c ON t.ck = c.ck)
SELECT root_id, path, 'V2' AS rule_id, 'error' AS severity, 'summary' AS detail FROM n WHERE summary = ' '
UNION ALL SELECT root_id, path, 'V5', 'error', 'confidence' FROM n WHERE conf < 0 OR conf > 1
UNION ALL SELECT root_id, path, 'V6', 'error', 'outcome status' FROM n WHERE status = 'done'
UNION ALL SELECT root_id, path, 'V6', 'error', 'outcome cites no evidence' FROM n WHERE status <> 'unknown' AND ck % 5 = 0
UNION ALL SELECT root_id, path, 'V4', 'error', 'deliverables empty' FROM n WHERE ck % 23 = 1
UNION ALL SELECT root_id, path, 'V4', 'error', 'deliverables[0] evidence outside node' FROM n WHERE ck % 19 = 2 AND ck % 23 <> 1
UNION ALL SELECT root_id, path, 'V3', 'error', 'success_criteria[0]' FROM n WHERE ck % 29 = 3""",
)
def rule_shape(spark: SparkSession, folder: str) -> DataFrame:
    nodes = with_evidence(tree_nodes(spark, folder)).withColumn("evidence_refs", F.array(F.lit("e1"), F.lit("e2")))
    balance = table(spark, folder, "customer").select(F.col("c_custkey").alias("ck"), "c_acctbal")
    ck = F.col("ck")
    refs = lambda *names: F.array(*[F.lit(n) for n in names])
    item = F.struct(
        F.lit("file").alias("kind"), F.lit("t").alias("target"), F.lit("saved").alias("expected_state"),
        F.when(ck % 19 == 2, refs("e9")).otherwise(refs("e1")).alias("evidence_refs"),
    )
    criterion = F.struct(
        F.lit("p").alias("predicate"), F.lit("v").alias("verifier"), (F.col("c_acctbal") / 9000).alias("confidence"),
        F.when(ck % 29 == 3, refs("e1", "e1")).otherwise(refs("e1")).alias("evidence_refs"),
    )
    status = F.get(refs("achieved", "partial", "failed", "abandoned", "unknown", "done"), (ck % 6).cast("int"))
    rows = nodes.join(balance, "ck").withColumns(
        {
            "summary": F.when(F.col("c_acctbal") < 0, " ").otherwise("sum"),
            "deliverables": F.when(ck % 23 == 1, F.slice(F.array(item), 1, 0)).otherwise(F.array(item)),
            "success_criteria": F.array(criterion),
            "observed_outcome": F.struct(
                status.alias("status"), F.lit("d").alias("description"),
                F.when(ck % 5 == 0, F.array().cast("array<string>")).otherwise(refs("e2")).alias("evidence_refs"),
            ),
        }
    )
    return rules.shape_rules(rows).select(FINDING)


# ---- procedure graphs: one per customer; orders are nodes in heap order ----------------------

GRAPH_SQL = """
gnodes AS (SELECT o_custkey AS root, o_orderkey AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
gedges AS (
  SELECT root, i // 2 AS p, i AS c FROM gnodes WHERE i > 1 AND NOT (ok % 45 = 13 AND i > 3)
  UNION ALL SELECT root, 1, i FROM gnodes WHERE i > 1 AND ok % 30 = 7
  UNION ALL SELECT root, i, i // 2 FROM gnodes WHERE i > 1 AND ok % 40 = 11
  UNION ALL SELECT root, i, -i FROM gnodes WHERE ok % 50 = 3
)
"""


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, folder, "orders").select(F.lit("s").alias("session_id"), F.col("o_custkey").cast("string").alias("root_id"), F.col("o_orderkey").alias("ok"))
    nodes = order_sessions(rows, "root_id", "ok").index("i", start=1).df.withColumn("node_id", F.col("i"))
    ok, i = F.col("ok"), F.col("i")
    half = F.floor(i / 2)
    pair = lambda p, c: F.struct(p.cast("bigint").alias("parent_id"), c.cast("bigint").alias("child_id"))
    options = F.array(
        F.when((i > 1) & ~((ok % 45 == 13) & (i > 3)), pair(half, i)),
        F.when((i > 1) & (ok % 30 == 7), pair(F.lit(1), i)),
        F.when((i > 1) & (ok % 40 == 11), pair(i, half)),
        F.when(ok % 50 == 3, pair(i, -i)),
    )
    edges = nodes.select(*MODEL, F.explode(F.filter(options, lambda e: e.isNotNull())).alias("e")).select(*MODEL, "e.*")
    return nodes, edges, nodes.where(i == 1).select(*MODEL, "node_id")


@query(
    "rule_graph_parents",
    with_ctes(GRAPH_SQL)
    + """, pairs AS (SELECT root, p, c, count(*) AS n FROM gedges GROUP BY ALL)
SELECT CAST(root AS VARCHAR) AS root_id, CAST(p AS VARCHAR) AS path, 'V38a' AS rule_id, 'error' AS severity, CAST(c AS VARCHAR) AS detail FROM pairs WHERE n > 1
UNION ALL SELECT CAST(root AS VARCHAR), '$', 'V38b', 'error', CAST(c AS VARCHAR) FROM pairs GROUP BY root, c HAVING count(*) > 1
UNION ALL SELECT DISTINCT CAST(root AS VARCHAR), '$', 'V38c', 'error', '1' FROM pairs WHERE c = 1""",
)
def rule_graph_parents(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, starts = _graph(spark, folder)
    return graphs.parent_rules(edges, starts).select(FINDING)


@query(
    "rule_dangling",
    with_ctes(GRAPH_SQL)
    + "SELECT CAST(root AS VARCHAR) AS root_id, CAST(p AS VARCHAR) AS path, 'V37' AS rule_id, 'error' AS severity, CAST(c AS VARCHAR) AS detail FROM gedges WHERE c < 0",
)
def rule_dangling(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges, _ = _graph(spark, folder)
    return graphs.dangling_rules(edges, nodes).select(FINDING)


@query(
    "rule_graph_reach",
    with_ctes(GRAPH_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, seen AS (SELECT root, 1::BIGINT AS n FROM gnodes WHERE i = 1 UNION SELECT e.root, e.c FROM seen s JOIN gedges e ON e.root = s.root AND e.p = s.n)
SELECT CAST(g.root AS VARCHAR) AS root_id, '$' AS path, 'V40' AS rule_id, 'error' AS severity, CAST(g.i AS VARCHAR) AS detail FROM gnodes g LEFT JOIN seen s ON g.root = s.root AND g.i = s.n WHERE s.n IS NULL""",
)
def rule_graph_reach(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges, starts = _graph(spark, folder)
    return graphs.reach_rules(edges, nodes, starts).select(FINDING)


@query(
    "rule_graph_cycle",
    with_ctes(GRAPH_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, walk AS (SELECT root, p AS a, c AS n FROM gedges UNION SELECT w.root, w.a, e.c FROM walk w JOIN gedges e ON e.root = w.root AND e.p = w.n)
SELECT DISTINCT CAST(root AS VARCHAR) AS root_id, '$' AS path, 'V39' AS rule_id, 'error' AS severity, 'cycle' AS detail FROM walk WHERE a = n""",
)
def rule_graph_cycle(spark: SparkSession, folder: str) -> DataFrame:
    _, edges, _ = _graph(spark, folder)
    return graphs.cycle_rules(edges).select(FINDING)


SCOPE_SQL = """
scope AS (SELECT *, CASE WHEN i = 1 THEN 'activity_0000-activity_0039' ELSE concat(printf('activity_%04d', ok % 50), CASE WHEN ok % 9 = 4 THEN printf('-activity_%04d', ok % 50 + 1) ELSE '' END) END AS ref FROM gnodes),
seen AS (SELECT root, 1::BIGINT AS n FROM gnodes WHERE i = 1 UNION SELECT e.root, e.c FROM seen s JOIN gedges e ON e.root = s.root AND e.p = s.n)
"""


@query(
    "rule_graph_scope",
    with_ctes(GRAPH_SQL, SCOPE_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """SELECT CAST(g.root AS VARCHAR) AS root_id, '$' AS path, 'V40' AS rule_id, 'error' AS severity, CAST(g.i AS VARCHAR) AS detail FROM gnodes g LEFT JOIN seen s ON g.root = s.root AND g.i = s.n WHERE s.n IS NULL
UNION ALL SELECT DISTINCT CAST(g.root AS VARCHAR), '$', 'V40', 'error', printf('activity_%04d', a) FROM (
  SELECT g.root, g.i, unnest(range(CAST(regexp_extract(ref, '^activity_([0-9]+)', 1) AS BIGINT), 1 + CAST(regexp_extract(ref, 'activity_([0-9]+)$', 1) AS BIGINT))) AS a FROM scope g) g
  JOIN seen s ON g.root = s.root AND g.i = s.n WHERE a > 39""",
)
def rule_graph_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Reached nodes may name no activity that the root does not name."""
    nodes, edges, starts = _graph(spark, folder)
    number = F.col("ok") % 50
    own = F.when(F.col("ok") % 9 == 4, ids.range_text("activity", number, number + 1)).otherwise(ids.padded("activity_", number))
    nodes = nodes.withColumn("activity_refs", F.array(F.when(F.col("i") == 1, "activity_0000-activity_0039").otherwise(own)))
    return graphs.reach_rules(edges, nodes, starts).select(FINDING)


@query(
    "rule_root_node",
    with_ctes(GRAPH_SQL)
    + """SELECT CAST(root AS VARCHAR) AS root_id, '$' AS path, 'V24' AS rule_id, 'error' AS severity, '1' AS detail FROM gnodes WHERE i = 1 AND ok % 3 = 0
UNION ALL SELECT CAST(root AS VARCHAR), '$', 'V24', 'error', CAST(i AS VARCHAR) FROM gnodes WHERE i > 1 AND ok % 8 = 5""",
)
def rule_root_node(spark: SparkSession, folder: str) -> DataFrame:
    """Some models lack their root node, some nodes are there twice."""
    nodes, _, starts = _graph(spark, folder)
    ok, i = F.col("ok"), F.col("i")
    kept = nodes.where(~((i == 1) & (ok % 3 == 0)))
    kept = kept.unionByName(kept.where((i > 1) & (ok % 8 == 5)))
    return graphs.node_table_rules(kept, starts.withColumnRenamed("node_id", "root_procedure_id")).select(FINDING)


@query(
    "rule_known_leaves",
    """SELECT CAST(l_orderkey AS VARCHAR) AS root_id, concat('p/body.', l_linenumber) AS path, 'V46' AS rule_id, 'error' AS severity, printf('activity_%04d', l_partkey) AS detail
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_suppkey % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size % 4 <> 0)""",
)
def rule_known_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Line items are activity leaves; the parts of some sizes are no activities of the source, and orders in status P have no source."""
    order = F.col("l_orderkey").cast("string").alias("root_id")
    leaf_id = F.when(F.col("l_suppkey") % 5 == 0, "activity_1").otherwise(ids.padded("activity_", F.col("l_partkey")))
    lines = table(spark, folder, "lineitem").select(
        F.lit("s").alias("session_id"), order, F.lit("p").alias("node_id"), F.concat(F.lit("body."), F.col("l_linenumber").cast("string")).alias("expr_path"),
        F.lit("activity").alias("kind"), leaf_id.alias("activity_id"), "l_partkey", "l_orderkey",
    )
    parts = table(spark, folder, "part").where(F.col("p_size") % 4 != 0).select("p_partkey")
    sources = table(spark, folder, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("l_orderkey"))
    named = lines.join(sources, "l_orderkey", "left_semi").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    named = named.select("session_id", "root_id", ids.padded("activity_", F.col("l_partkey")).alias("activity_id"))
    # Every source has one more activity, which no line names.
    own = sources.select(F.lit("s").alias("session_id"), F.col("l_orderkey").cast("string").alias("root_id"), F.lit("own").alias("activity_id"))
    return rules.known_leaf_rules(lines, named.unionByName(own)).select(FINDING)


# ---- procedure bodies: line items are ordered parts of an order ------------------------------

PARTS_SQL = """
parts AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal,
    CAST(l_linenumber AS BIGINT) AS low, CAST(l_linenumber + l_partkey % 2 AS BIGINT) AS high FROM lineitem
)
"""


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("root_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    so = order_sessions(rows, "root_id", ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).index("ordinal", start=1)
    low = F.col("l_linenumber").cast("bigint")
    return so.df.select(
        F.lit("s").alias("session_id"), "root_id", F.lit("$.body").alias("path"), "ordinal", low.alias("low"), (low + F.col("l_partkey") % 2).alias("high")
    )


@query(
    "rule_seq_order",
    with_ctes(PARTS_SQL)
    + """SELECT CAST(l_orderkey AS VARCHAR) AS root_id, '$.body' AS path, 'V34' AS rule_id, 'error' AS severity, CAST(ordinal AS VARCHAR) AS detail FROM
  (SELECT *, max(high) OVER (PARTITION BY l_orderkey ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM parts) WHERE low <= before""",
)
def rule_seq_order(spark: SparkSession, folder: str) -> DataFrame:
    return rules.order_rules(_parts(spark, folder), [*MODEL, "path"], "V34").select(FINDING)


@query(
    "rule_body_union",
    with_ctes(PARTS_SQL)
    + """, body AS (SELECT DISTINCT l_orderkey, unnest(range(low, high + 1)) AS a FROM parts),
own AS (SELECT l_orderkey, unnest(range(min(low), max(low) + 1)) AS a FROM parts GROUP BY l_orderkey)
SELECT CAST(coalesce(b.l_orderkey, o.l_orderkey) AS VARCHAR) AS root_id, 'p1' AS path, 'V36' AS rule_id, 'error' AS severity,
  CASE WHEN o.a IS NULL THEN concat('missing ', printf('activity_%04d', b.a)) ELSE concat('extra ', printf('activity_%04d', o.a)) END AS detail
FROM body b FULL JOIN own o ON b.l_orderkey = o.l_orderkey AND b.a = o.a WHERE b.a IS NULL OR o.a IS NULL""",
)
def rule_body_union(spark: SparkSession, folder: str) -> DataFrame:
    """The node claims the span of its parts' first activities; the parts cover something else."""
    parts = _parts(spark, folder)
    claim = ids.range_text("activity", F.min("low"), F.max("low"))
    nodes = parts.groupBy(*MODEL).agg(F.array(claim).alias("activity_refs")).withColumn("node_id", F.lit("p1"))
    exprs = parts.select(
        *MODEL, F.lit("p1").alias("node_id"), F.concat(F.lit("body/"), F.col("ordinal").cast("string")).alias("expr_path"), F.lit("step").alias("kind"),
        F.lit(None).cast("string").alias("activity_id"), F.array(ids.range_text("activity", F.col("low"), F.col("high"))).alias("activity_refs"),
    )
    edges = nodes.where(F.lit(False)).select(*MODEL, F.col("node_id").alias("parent_id"), F.col("node_id").alias("child_id"))
    return rules.node_body_rules(nodes, exprs, edges).select(FINDING)


@query(
    "rule_operators",
    """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS root_id, CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k,
  CASE o_orderkey % 5 WHEN 0 THEN 'SEQ' WHEN 1 THEN 'FOR' WHEN 2 THEN 'WHILE' WHEN 3 THEN 'CHOICE' ELSE 'PARALLEL' END AS op FROM orders)
SELECT root_id, path, 'V25' AS rule_id, 'error' AS severity, op AS detail FROM n WHERE op = 'PARALLEL'
UNION ALL SELECT root_id, path, 'V26', 'error', 'iteration_variable' FROM n WHERE op = 'FOR' AND k % 7 = 0
UNION ALL SELECT root_id, path, 'V26', 'error', 'collection' FROM n WHERE op = 'FOR' AND (k % 7 = 0 OR k % 11 = 0)
UNION ALL SELECT root_id, path, 'V27', 'error', 'condition differs from predicate' FROM n WHERE op = 'WHILE' AND k % 13 = 0
UNION ALL SELECT root_id, path, 'V27', 'error', 'bindings on WHILE' FROM n WHERE op = 'WHILE' AND k % 3 = 0 AND k % 7 <> 0
UNION ALL SELECT root_id, path, 'V28', 'error', 'bindings' FROM n WHERE op NOT IN ('FOR', 'WHILE') AND k % 3 = 0 AND k % 7 <> 0
UNION ALL SELECT root_id, path, 'V29', 'error', 'vague predicate' FROM n WHERE op = 'WHILE' AND k % 4 = 1
UNION ALL SELECT root_id, path, 'V29', 'error', 'vague verifier' FROM n WHERE op = 'WHILE' AND k % 6 = 0
UNION ALL SELECT root_id, path, 'V29', 'error', 'status' FROM n WHERE op = 'WHILE' AND k % 8 = 7
UNION ALL SELECT root_id, path, 'V30', 'error', 'evidence outside loop' FROM n WHERE op = 'WHILE' AND k % 9 = 0
UNION ALL SELECT root_id, path, 'V31', 'error', 'no body' FROM n WHERE k % 17 = 0""",
)
def rule_operators(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    op = F.get(F.array(*[F.lit(o) for o in ("SEQ", "FOR", "WHILE", "CHOICE", "PARALLEL")]), (k % 5).cast("int"))
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    bound = (k % 7 != 0) & ((op == "FOR") | (k % 3 == 0))
    bindings = F.struct(F.lit("item").alias("iteration_variable"), F.when(k % 11 == 0, F.slice(names("a"), 1, 0)).otherwise(names("a", "b")).alias("collection"))
    predicate = F.when(k % 4 == 1, "Until done!").otherwise("the list shows no unread row")
    grounding = F.struct(
        predicate.alias("predicate"), F.when(k % 6 == 0, "Manual check.").otherwise("row count").alias("verifier"),
        F.when(k % 8 == 7, "maybe").otherwise("satisfied").alias("status"), F.when(k % 9 == 0, names("activity_0009")).otherwise(names("activity_0001")).alias("evidence_refs"),
    )
    rows = table(spark, folder, "orders").select(
        F.lit("s").alias("session_id"), F.col("o_custkey").cast("string").alias("root_id"), k.cast("string").alias("path"), op.alias("operator"),
        F.when(bound, bindings).alias("bindings"), F.when(op == "WHILE", F.when(k % 13 == 0, "other").otherwise(F.concat(predicate, F.lit(" ")))).alias("condition"),
        F.when(op == "WHILE", grounding).alias("grounding"), names("activity_0001", "activity_0002").alias("activity_refs"), (k % 17 != 0).alias("has_body"),
    )
    return rules.operator_rules(rows).select(FINDING)
