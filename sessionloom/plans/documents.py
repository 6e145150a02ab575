"""Queries over stored lines and documents: parsing, legacy forms, flattening, reports, merged outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import flatten, normalize, online, reassign, report, rules, threads, trees
from sessionloom.plans import standins
from sessionloom.plans.base import ORACLES, query, table
from sessionloom.plans.models import TREE_SQL, source_activities, tree_nodes
from sessionloom.plans.standins import ACTIONS_SQL, with_ctes
from sessionloom.plans.thread_queries import assigned, leaves
from sessionloom.session import cut_lineage
from sessionloom.sources import logs, sinks

SESSION = "session_id"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Action log as stored lines, with blank, broken, non-object and incomplete ones among them."""
    k = F.col("k")
    whole = F.to_json(F.struct(F.lit("Screen").alias("observer_name"), F.when(k % 13 != 0, F.col("action")).alias("content"), F.col("ts").cast("string").alias("timestamp")))
    value = F.when(k % 11 == 1, "  ").when(k % 11 == 2, "{broken").when(k % 11 == 3, "[1]").otherwise(whole)
    return standins.actions(spark, folder).select(
        SESSION, F.lit("raw_trace.jsonl").alias("file"), F.lit(0).cast("bigint").alias("split_start"), F.col("line_no").alias("split_row"), value.alias("value")
    )


@query(
    "raw_log_parse",
    with_ctes(ACTIONS_SQL) + "SELECT session_id, line_no AS split_row, action, round(ts, 3) AS ts FROM actions WHERE k % 11 NOT IN (1, 2, 3) AND k % 13 <> 0",
)
def raw_log_parse(spark: SparkSession, folder: str) -> DataFrame:
    good, _ = logs.json_objects(_lines(spark, folder), strict=False)
    return logs.raw_events(good).select(SESSION, "split_row", "action", F.round("ts", 3).alias("ts"))


@query("raw_log_rejects", with_ctes(ACTIONS_SQL) + "SELECT session_id, line_no AS split_row, CASE k % 11 WHEN 2 THEN '{broken' ELSE '[1]' END AS value FROM actions WHERE k % 11 IN (2, 3)")
def raw_log_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return logs.json_objects(_lines(spark, folder), strict=False)[1].select(SESSION, "split_row", "value")


@query(
    "input_choice",
    with_ctes(ACTIONS_SQL)
    + """SELECT session_id, count(*) AS n, CAST(session_id AS BIGINT) % 3 = 0 AS from_raw FROM actions WHERE CAST(session_id AS BIGINT) % 3 < 2 GROUP BY ALL""",
)
def input_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Raw log for some sessions, the older table for others; a session with both uses the raw log."""
    number = F.col(SESSION).cast("bigint")
    rows = standins.actions(spark, folder)
    raw = rows.where(number % 3 == 0).select(SESSION, F.col("line_no").alias("split_row"), "action", F.lit(True).alias("from_raw"))
    created = F.col("ts").cast("string").alias("created_at")
    legacy = logs.legacy_events(rows.where(number % 3 < 2).select(SESSION, F.col("line_no").alias("id"), F.col("action").alias("content"), created))
    chosen = logs.prefer(raw, legacy.withColumn("from_raw", F.lit(False)).select(SESSION, "split_row", "action", "from_raw"))
    return chosen.groupBy(SESSION, "from_raw").agg(F.count(F.lit(1)).alias("n"))


@query(
    "action_trace",
    with_ctes(ACTIONS_SQL)
    + """SELECT session_id, line_no AS idx, CASE WHEN k % 4 = 0 THEN concat('row_', line_no) ELSE concat('a', line_no) END AS action_id,
  CASE WHEN k % 5 <> 0 THEN action WHEN k % 3 = 0 THEN concat('action_', line_no) ELSE concat('goal ', k, ' | Active application: ', event_type) END AS action,
  CASE WHEN k % 7 = 0 THEN line_no ELSE k END AS original_index, CASE WHEN k % 2 = 0 THEN concat('seen ', k) ELSE '' END AS md_results
FROM actions WHERE k % 9 <> 4""",
)
def action_trace(spark: SparkSession, folder: str) -> DataFrame:
    k, line = F.col("k"), F.col("line_no").cast("string")
    rows = standins.actions(spark, folder).select(
        SESSION, F.col("line_no").alias("idx"), F.when(k % 4 != 0, F.concat(F.lit("a"), line)).alias("id"), F.lit("").alias("node_id"),
        F.when(k % 9 == 4, "meta").otherwise("node").alias("row_type"), F.lit("action").alias("node_type"), F.when(k % 5 == 0, " ").otherwise(F.col("action")).alias("action"),
        F.when(k % 3 != 0, F.concat(F.lit(" goal "), k.cast("string"))).alias("goal"), F.when(k % 3 != 0, F.col("event_type")).alias("active_application"),
        F.when(k % 7 == 0, -1).otherwise(k).cast("string").alias("original_index"),
        F.when(k % 2 == 0, F.to_json(F.struct(F.concat(F.lit("seen "), k.cast("string")).alias("md_results")))).alias("ocr_results"),
    )
    out = logs.action_trace(rows)
    return out.select(SESSION, "idx", "action_id", "action", "original_index", F.coalesce("md_results", F.lit("")).alias("md_results"))


@query(
    "activity_scan",
    """SELECT CAST(o_custkey AS VARCHAR) AS session_id, printf('activity_%05d', o_orderkey) AS activity_id, CASE o_orderkey % 2 WHEN 0 THEN o_orderpriority ELSE o_orderstatus END AS additional_context, CAST(o_orderkey AS BIGINT) AS event_count FROM orders""",
)
def activity_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Stored activities under their present and former names."""
    k = F.col("o_orderkey")
    number = F.format_string("%05d", k)
    present = F.to_json(F.struct(F.concat(F.lit("activity_"), number).alias("activity_id"), F.col("o_orderpriority").alias("additional_context"), k.alias("event_count")))
    former = F.to_json(F.struct(F.concat(F.lit("subgoal_segment_"), number).alias("subgoal_segment_id"), F.col("o_orderstatus").alias("detail_brief"), k.alias("event_count")))
    older = F.to_json(F.struct(F.concat(F.lit("local_objective_"), number).alias("local_objective_id"), F.col("o_orderstatus").alias("detail_brief"), k.alias("event_count")))
    value = F.when(k % 2 == 0, present).when(k % 3 == 0, former).otherwise(older)
    rows = logs.activity_rows(table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias(SESSION), value.alias("value")))
    return rows.select(SESSION, "activity_id", "additional_context", "event_count")


@query(
    "leaf_scan",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS leaf_idx, printf('subgoal_segment_%04d', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS activity_id,
  CASE WHEN role = 'user' THEN role ELSE 'Unclassified step' END AS objective, turn + 2 AS num_actions FROM conversations""",
)
def leaf_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One stored document per conversation (a conversation is a short list of turns)."""
    item = F.struct("turn", F.when(F.col("role") == "user", F.col("role")).alias("leaf_latent_task"), (F.col("turn") + 2).alias("event_count"))
    turns = table(spark, folder, "conversations").groupBy(F.col("conv_id").cast("string").alias(SESSION)).agg(F.array_sort(F.collect_list(item)).alias("items"))
    as_list = F.to_json("items")
    as_object = F.to_json(F.struct(F.col("items").alias("subgoal_segments")))
    documents = turns.select(SESSION, F.when(F.col(SESSION).cast("bigint") % 2 == 0, as_list).otherwise(as_object).alias("value"))
    return logs.leaf_rows(logs.leaf_values(documents)).select(SESSION, "leaf_idx", "activity_id", "objective", "num_actions")


@query(
    "tree_flatten",
    """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_linenumber FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS root_id, '$' AS path, '' AS parent_path, concat('C', l_orderkey) AS node_id, 0 AS depth FROM l GROUP BY l_orderkey
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), concat('$.decomposition[', i - 1, ']'), '$', concat('C', l_orderkey, '.', l_linenumber), 1 FROM l""",
)
def tree_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Each order as a nested document of its line items (a handful), flattened to node rows."""
    child = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    name = F.concat(F.lit("C"), F.col("l_orderkey").cast("string"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(child)).alias("c"))
    nodes = F.transform("c", lambda x: F.struct(F.concat_ws(".", name, x["l_linenumber"].cast("string")).alias("id"), F.array().cast("array<string>").alias("decomposition")))
    documents = lines.select(
        F.lit("s").alias(SESSION), F.col("l_orderkey").cast("string").alias("root_id"), F.to_json(F.struct(name.alias("id"), nodes.alias("decomposition"))).alias("value")
    )
    out = flatten.tree_nodes(documents)
    return out.select("root_id", "path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), "node_id", "depth")


@query(
    "rule_expressions",
    """SELECT CAST(o_orderkey AS VARCHAR) AS root_id, concat('body.0') AS path, 'V32' AS rule_id, 'error' AS severity, 'mixed' AS detail FROM orders WHERE o_orderkey % 6 = 1
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'body.0', 'V32', 'error', 'unknown' FROM orders WHERE o_orderkey % 6 = 2
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'body.0/steps.1', 'V33', 'error', 'activity_0002' FROM orders WHERE o_orderkey % 6 = 3
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'body.0', 'V46', 'error', concat('act', o_custkey) FROM orders WHERE o_orderkey % 6 = 4
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'p1/body.0', 'V35', 'error', 'missing activity_0002' FROM orders WHERE o_orderkey % 6 = 5""",
)
def rule_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """Procedure documents of one node per order, some with faulty bodies, flattened and judged."""
    k = F.col("o_orderkey")
    leaves_json = '[{"activity_id": "activity_0001"}, {"activity_id": "activity_0002"}]'
    body = (
        F.when(k % 6 == 1, '{"procedure_node_id": "p2", "operator": "SEQ"}')
        .when(k % 6 == 2, '{"note": 1}')
        .when(k % 6 == 3, '{"operator": "FOR", "steps": [{"name": "do", "activity_refs": ["activity_0001"]}, {"activity_id": "activity_0002"}]}')
        .when(k % 6 == 4, F.concat(F.lit('{"activity_id": "act'), F.col("o_custkey").cast("string"), F.lit('"}')))
        .when(k % 6 == 5, f'{{"operator": "SEQ", "activity_refs": ["activity_0001"], "steps": {leaves_json}}}')
        .otherwise(f'{{"operator": "SEQ", "activity_refs": ["activity_0001-activity_0002"], "steps": {leaves_json}}}')
    )
    value = F.concat(F.lit('{"procedure_nodes": [{"id": "p1", "operator": "SEQ", "body": '), body, F.lit("}]}"))
    documents = table(spark, folder, "orders").select(F.lit("s").alias(SESSION), k.cast("string").alias("root_id"), value.alias("value"))
    exprs = flatten.body_expressions(documents)
    found = rules.expression_rules(exprs.withColumn("path", F.col("expr_path"))).unionByName(rules.inline_operator_rules(exprs))
    return found.select("root_id", "path", "rule_id", "severity", "detail")


@query(
    "event_usage_max",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS stream_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT session_id, stream_id, max(k) AS total_tokens FROM e WHERE k % 7 <> 3 GROUP BY ALL""",
)
def event_usage_max(spark: SparkSession, folder: str) -> DataFrame:
    """Largest usage object nested anywhere in JSON event lines; lines that are not JSON are skipped."""
    k = F.get_json_object("props", "$.k")
    nested = F.concat(F.lit('{"a": [{"usage": {"total_tokens": '), k, F.lit('}}, {"b": {"usage": {"total_tokens": 0}}}]}'))
    lines = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias(SESSION), F.col("event_type").alias("stream_id"), F.col("event_id").alias("line_no"),
        F.when(k.cast("int") % 7 == 3, "{broken").otherwise(nested).alias("value"),
    )
    return flatten.largest_usage(lines).select(SESSION, "stream_id", "total_tokens")


@query(
    "grounding_normalize",
    """WITH o AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'file' ELSE NULL END AS old FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS root_id, CASE o_orderkey % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'sheet' ELSE o_orderpriority END AS target,
  CASE o_orderkey % 3 WHEN 0 THEN 'saved' WHEN 1 THEN 'The sheet is complete.' ELSE concat('The ', o_orderpriority, ' is complete.') END AS expected_state,
  CASE o_orderkey % 3 WHEN 0 THEN 'saved' WHEN 1 THEN 'The sheet is filled' ELSE concat('The ', o_orderpriority, ' is complete.') END AS predicate,
  CASE WHEN o_orderkey % 3 = 1 THEN 'partial' ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 'e1' ELSE 'activity_0003,activity_0004' END AS evidence FROM o""",
)
def grounding_normalize(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, '{"deliverable": "report", "success_criteria": "saved"}').when(
        k % 3 == 1,
        '{"evidence_refs": ["e1"], "deliverables": [{"target": "sheet"}, {"target": " "}], "success_criteria": [{"predicate": "The sheet is filled"}], "observed_outcome": {"status": "partial", "description": "half"}}',
    ).otherwise('{"observed_outcome": {"status": "great"}}')
    nodes = table(spark, folder, "orders").select(
        F.lit("s").alias(SESSION), k.cast("string").alias("root_id"), F.col("o_orderpriority").alias("objective"), F.array(F.lit("activity_0003-activity_0004")).alias("refs"), body.alias("body")
    )
    out = normalize.grounding(nodes)
    return out.select(
        "root_id", F.col("deliverables")[0]["target"].alias("target"), F.col("deliverables")[0]["expected_state"].alias("expected_state"),
        F.col("success_criteria")[0]["predicate"].alias("predicate"), F.col("observed_outcome.status").alias("status"), F.array_join("evidence_refs", ",").alias("evidence"),
    )


@query(
    "hierarchy_normalize",
    with_ctes(TREE_SQL)
    + """SELECT t.root_id, t.path, CASE depth WHEN 0 THEN t.root_id WHEN 1 THEN concat(t.root_id, '.', ordinal) ELSE concat(t.root_id, '.', CAST(regexp_extract(t.path, '\\[(\\d+)\\]', 1) AS BIGINT) + 1, '.', ordinal) END AS node_id FROM tree_nodes t""",
)
def hierarchy_normalize(spark: SparkSession, folder: str) -> DataFrame:
    nodes = tree_nodes(spark, folder)
    roots = nodes.where(F.col("parent_path").isNull()).select(*trees.MODEL, F.col("root_id").alias("source_root_id"))
    return normalize.position_ids(nodes, roots).select("root_id", "path", "node_id")


@query(
    "fill_references",
    with_ctes(TREE_SQL)
    + """, need AS (SELECT n.root_id, n.path, c.a FROM tree_nodes n JOIN cover c ON c.root_id = n.root_id AND c.depth = 2 AND c.parent_path = n.path WHERE n.depth = 1),
g AS (SELECT root_id, path, a, a - dense_rank() OVER (PARTITION BY root_id, path ORDER BY a) AS grp FROM (SELECT DISTINCT * FROM need)),
r AS (SELECT root_id, path, min(a) AS s, CASE WHEN min(a) = max(a) THEN printf('activity_%04d', min(a)) ELSE concat(printf('activity_%04d', min(a)), '-', printf('activity_%04d', max(a))) END AS ref FROM g GROUP BY root_id, path, grp)
SELECT root_id, path, string_agg(ref, ',' ORDER BY s) AS refs FROM r GROUP BY ALL""",
)
def fill_references(spark: SparkSession, folder: str) -> DataFrame:
    """Inner nodes without references get those of their descendants."""
    nodes = tree_nodes(spark, folder)
    emptied = nodes.withColumn("refs", F.when(F.col("depth") == 2, F.col("refs")).otherwise(F.slice("refs", 1, 0)))
    out = normalize.fill_references(emptied, source_activities(spark, folder)).where(F.col("depth") == 1)
    return out.select("root_id", "path", F.array_join("refs", ",").alias("refs"))


@query(
    "id_codec",
    with_ctes(TREE_SQL)
    + """, num AS (SELECT root_id, activity_id, row_number() OVER (PARTITION BY root_id ORDER BY act) - 1 AS n FROM source_acts)
SELECT t.root_id, t.path, ref, CASE WHEN ref = 'activity_12' THEN ref WHEN length(ref) > 13 THEN concat(coalesce(a.n, CAST(substr(ref, 10, 4) AS BIGINT)), '-', coalesce(b.n, CAST(substr(ref, 24, 4) AS BIGINT)))
  ELSE CAST(coalesce(a.n, CAST(substr(ref, 10, 4) AS BIGINT)) AS VARCHAR) END AS compact FROM tree_nodes t
LEFT JOIN num a ON a.root_id = t.root_id AND a.activity_id = substr(ref, 1, 13) LEFT JOIN num b ON b.root_id = t.root_id AND b.activity_id = substr(ref, 15, 13)""",
)
def id_codec(spark: SparkSession, folder: str) -> DataFrame:
    numbers = normalize.dense_ids(source_activities(spark, folder), "act")
    refs = tree_nodes(spark, folder).select(*trees.NODE, F.explode("refs").alias("ref"))
    return normalize.compact_references(refs, numbers).drop(SESSION)


@query(
    "id_restore",
    with_ctes(TREE_SQL)
    + """, num AS (SELECT root_id, activity_id, act, row_number() OVER (PARTITION BY root_id ORDER BY act) - 1 AS n FROM source_acts),
j AS (SELECT root_id, n // 10 AS batch, act, act - row_number() OVER (PARTITION BY root_id, n // 10 ORDER BY act) AS grp FROM num)
SELECT root_id, batch, CASE WHEN min(act) = max(act) THEN printf('activity_%04d', min(act)) ELSE concat(printf('activity_%04d', min(act)), '-', printf('activity_%04d', max(act))) END AS ref FROM j GROUP BY root_id, batch, grp""",
)
def id_restore(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that name ten activities each as 0-9, 10-19 ... turned back into id ranges."""
    numbers = normalize.dense_ids(source_activities(spark, folder), "act")
    batch = F.floor(F.col("n") / 10)
    answers = numbers.groupBy(*trees.MODEL, batch.alias("batch")).agg(F.concat_ws("-", F.min("n").cast("string"), F.max("n").cast("string")).alias("compact"))
    return normalize.restore_references(answers, numbers, [*trees.MODEL, "batch"]).select("root_id", "batch", "ref")


@query(
    "report_procedure",
    """SELECT CAST(o_orderkey AS VARCHAR) AS root_id, concat('| ', o_orderpriority, ' | ', CASE WHEN o_orderkey % 2 = 0 THEN 'WHILE' ELSE 'SEQ' END, ' | ',
  CASE WHEN o_orderkey % 2 = 0 THEN concat('no row \\| left (verify: count; satisfied; evidence: a', o_custkey, ')') ELSE '-' END, ' | ', CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE 'activity_0001, activity_0002' END, ' | ', o_orderstatus, ' |') AS line FROM orders""",
)
def report_procedure(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    grounding = F.struct(
        F.lit("no row | left").alias("predicate"), F.lit("count").alias("verifier"), F.lit("satisfied").alias("status"), F.array(F.concat(F.lit("a"), F.col("o_custkey").cast("string"))).alias("evidence_refs")
    )
    two = F.array(F.lit("activity_0001"), F.lit("activity_0002"))
    nodes = table(spark, folder, "orders").select(
        F.lit("s").alias(SESSION), k.cast("string").alias("root_id"), F.lit("p1").alias("node_id"), F.col("o_orderpriority").alias("name"), F.when(k % 2 == 0, "WHILE").otherwise("SEQ").alias("operator"),
        F.lit("").alias("condition"), F.when(k % 2 == 0, grounding).alias("grounding"), F.when(k % 3 == 0, F.slice(two, 1, 0)).otherwise(two).alias("activity_refs"),
        F.lit(" ").alias("evidence_summary"), F.col("o_orderstatus").alias("description"),
    )
    return report.procedure_table(nodes).select("root_id", "line")


@query(
    "merged_output",
    """SELECT CAST(o_custkey AS VARCHAR) AS session_id, count(*) AS root_count, count(*) FILTER (o_orderstatus <> 'F') AS ok_count, round(CAST(sum(CAST(o_totalprice AS DECIMAL(28, 12))) AS DOUBLE), 6) AS estimated_usd FROM orders GROUP BY ALL""",
)
def merged_output(spark: SparkSession, folder: str) -> DataFrame:
    results = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias(SESSION), F.col("o_orderkey").cast("string").alias("root_id"), (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_totalprice").alias("estimated_usd")
    )
    return sinks.merged_output(results, unique_roots=True)


# White space is one space in the comparison text, and a list without members leaves its label alone.
PROFILE_SQL = """SELECT session_id, canonical_root_id, leaf_count, trim(regexp_replace(lower(concat('label: objective: deliverable: success_criteria: summary: last_update: anchor: apps_used: ', replace(apps, '|', ', '),
  ' entities: ', replace(entities, '|', ', '), ' sample_leaf_objectives: ', replace(samples, '|', ' | '))), ' +', ' ', 'g')) AS text, lower(apps) AS apps, lower(entities) AS entities FROM ({rollup})"""


@query("root_profiles", PROFILE_SQL.format(rollup=ORACLES["thread_rollup"]))
def root_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison text of every finished thread."""
    rows = cut_lineage(leaves(spark, folder))
    out = reassign.root_profiles(threads.roll_up(rows, assigned(rows)))
    return out.select(SESSION, "canonical_root_id", "leaf_count", "text", F.array_join("apps", "|").alias("apps"), F.array_join("items", "|").alias("entities"))


@query("reassignment_candidates")
def reassignment_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of threads of more than three leaves that fit a smaller thread of their session better."""
    rows = cut_lineage(leaves(spark, folder))  # read by every step below
    root = F.when(F.col("k0") < 70, F.lit("T")).otherwise(F.col("objective")).alias("canonical_root_id")
    placed = rows.select(SESSION, "leaf_idx", root)
    profiles = reassign.root_profiles(threads.roll_up(rows, placed))
    out = reassign.candidates(cut_lineage(online.prepare(rows)), placed, cut_lineage(profiles), small_thread=3)
    return out.select(SESSION, "leaf_idx", "current_root_id", F.array_join("alternatives", "|").alias("alternatives"))
