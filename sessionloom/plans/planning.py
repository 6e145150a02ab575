"""Queries over work plans, input files, thread summaries, nested reports and layout items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import boxes, evidence, flatten, report, requests, segments, threads, windows
from sessionloom.operators.sequence import order_sessions
from sessionloom.plans import models, standins
from sessionloom.plans.base import query, table
from sessionloom.plans.models import TREE_SQL
from sessionloom.plans.standins import ACTIONS_SQL, SEGMENTS_SQL, STATES_SQL, STEPS_SQL, with_ctes
from sessionloom.plans.thread_queries import BASE, EPISODES_SQL, assigned, leaves
from sessionloom.session import cut_lineage
from sessionloom.sources import logs

SESSION, ROOT = "session_id", "canonical_root_id"

# ---- plans and inputs ------------------------------------------------------------------------


@query(
    "preflight_plan",
    with_ctes(ACTIONS_SQL, STATES_SQL, STEPS_SQL)
    + """, a AS (SELECT session_id, count(*) AS actions, count(*) FILTER (ocr IS NOT NULL) AS enrichments, count(*) FILTER (ocr IS NOT NULL AND line_no % 5 = 0) AS enrichments_cached,
  count(*) FILTER (before IS NOT NULL) AS grounding_requests FROM steps GROUP BY ALL),
t AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, count(*) AS threads, count(*) FILTER (o_orderkey % 101 <= 50 AND CAST(o_totalprice * 10 AS BIGINT) <= 1500000) AS direct_calls FROM orders GROUP BY ALL)
SELECT coalesce(a.session_id, t.session_id) AS session_id, coalesce(actions, 0) AS actions, coalesce(enrichments, 0) AS enrichments, coalesce(enrichments_cached, 0) AS enrichments_cached,
  coalesce(grounding_requests, 0) AS grounding_requests, CAST(coalesce(CASE WHEN actions <= 12 THEN 1 ELSE ceil((actions - 12) / 7.0) + 1 END, 0) AS BIGINT) AS backward_windows,
  CAST(coalesce(CASE WHEN actions <= 1 THEN 0 WHEN actions <= 16 THEN 1 ELSE ceil((actions - 16) / 14.0) + 1 END, 0) AS BIGINT) AS most_merge_batches,
  coalesce(threads, 0) AS threads, coalesce(direct_calls, 0) AS direct_calls, coalesce(threads - direct_calls, 0) AS agent_runs FROM a FULL JOIN t ON a.session_id = t.session_id""",
)
def preflight_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Calls that a run over each session would make; customers' orders are its threads."""
    rows = standins.steps(spark, folder).df.select(
        SESSION, F.col("ocr").alias("md_results"), F.col("before").isNull().alias("before_missing"), (F.col("line_no") % 5 == 0).alias("cached")
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias(SESSION), (F.col("o_orderkey") % 101).alias("n_activities"), F.round(F.col("o_totalprice") * 10).cast("bigint").alias("doc_bytes")
    )
    return windows.preflight(rows, orders, {"backward": (12, 5), "merge": (16, 2)})


@query(
    "input_files",
    """WITH s AS (SELECT DISTINCT user_id AS u FROM events)
SELECT CAST(u AS VARCHAR) AS session_id, concat('data/', u, '/', CASE WHEN u % 7 = 3 THEN 'grounded.jsonl' WHEN u % 3 = 0 THEN 'grounded.jsonl' WHEN u % 3 = 1 THEN 'raw.jsonl' ELSE 'activities.jsonl' END) AS path,
  CASE WHEN u % 7 = 3 OR u % 3 = 0 THEN 'grounded.jsonl' WHEN u % 3 = 1 THEN 'raw.jsonl' ELSE 'activities.jsonl' END AS name, u % 7 <> 3 AS found FROM s""",
)
def input_files(spark: SparkSession, folder: str) -> DataFrame:
    """Grounded rows where a session has them, else raw rows, else the legacy name; some sessions have no file at all."""
    users = table(spark, folder, "events").select("user_id").distinct()
    place = F.concat(F.lit("data/"), F.col("user_id").cast("string"))
    name = lambda n: F.concat(place, F.lit(f"/{n}.jsonl"))
    u = F.col("user_id")
    kept = F.when(u % 3 == 0, F.array(name("grounded"), name("raw"))).when(u % 3 == 1, F.array(name("raw"), name("activities"))).otherwise(F.array(name("activities")))
    listing = users.where(u % 7 != 3).select(F.explode(kept).alias("path"))
    sessions = users.select(u.cast("string").alias(SESSION), F.concat(place, F.lit("/")).alias("folder"))
    return logs.resolve_inputs(sessions, listing, ["grounded.jsonl", "raw.jsonl", "activities.jsonl"])


@query(
    "thread_outcomes",
    """SELECT CAST(o_custkey AS VARCHAR) AS session_id, CAST(o_orderkey AS VARCHAR) AS root_id, concat('runs/', o_custkey, '/', o_orderkey, '.json') AS input_file, concat('runs/', o_custkey, '/', o_orderkey, '.hierarchy.json') AS output_file,
  o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AS ok, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_totalprice < 150000 THEN 'direct' ELSE 'agent' END AS execution_mode, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('m', o_orderkey % 3) END AS model,
  o_orderkey % 101 AS activity_count, o_orderkey * 10 AS total_tokens FROM orders""",
)
def thread_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows of threads whose runs succeeded, failed, or are still to come."""
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").withColumns({SESSION: F.col("o_custkey").cast("string"), "root_id": k.cast("string")})
    outcomes = rows.where(k % 5 != 0).select(
        SESSION, "root_id", (F.col("o_orderstatus") == "F").alias("ok"), F.when(F.col("o_totalprice") < 150000, "direct").otherwise("agent").alias("execution_mode"),
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"),
    )
    asked = rows.select(SESSION, "root_id", (k % 101).alias("activities"), (k * 10).alias("tokens"), F.lit(0.0).alias("usd"))
    out = requests.thread_results(asked, "runs", outcomes).drop("estimated_usd")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("execution_mode", "model")})


@query(
    "activity_rehydrate",
    with_ctes(ACTIONS_SQL, STATES_SQL, STEPS_SQL, SEGMENTS_SQL)
    + """, a AS (SELECT session_id, seg_idx // 3 AS act_idx, min(seg_idx) AS s, max(seg_idx) AS e, arg_min(k0, seg_idx) AS k0, sum(end_action_idx - start_action_idx + 1) AS n FROM segments GROUP BY ALL),
bad AS (SELECT session_id FROM a WHERE (k0 % 40 = 13 AND act_idx = 1) OR (k0 % 50 = 7 AND act_idx = 0))
SELECT session_id, act_idx, CAST(n AS BIGINT) AS event_count FROM a WHERE CAST(session_id AS BIGINT) % 7 <> 0 AND session_id NOT IN (SELECT session_id FROM bad)""",
)
def activity_rehydrate(spark: SparkSession, folder: str) -> DataFrame:
    """Stored activities over semantic actions: borders, ids and fingerprint are judged, and evidence is rebuilt from today's semantic actions."""
    so = standins.segments(standins.steps(spark, folder))
    semantic = so.df.withColumn("semantic_action_id", F.format_string("semantic_action_%04d", "seg_idx"))
    current = standins.totals(semantic).withColumnRenamed("n", "n_rows").join(segments.fingerprint(semantic, ["semantic_action_id", "label", "context"], "seg_idx"), SESSION)
    stale = F.col(SESSION).cast("bigint") % 7 == 0
    stored = current.withColumn("input_fingerprint", F.when(stale, "old").otherwise(F.col("input_fingerprint")))
    act = F.floor(F.col("seg_idx") / 3).alias("act_idx")
    activities = semantic.groupBy(SESSION, act).agg(
        F.min("seg_idx").alias("start_idx"), F.max("seg_idx").alias("end_idx"), F.min_by("k0", "seg_idx").alias("k0"),
        F.min_by("semantic_action_id", "seg_idx").alias("start_id"), F.max_by("semantic_action_id", "seg_idx").alias("end_id"),
    )
    k0 = F.col("k0")
    activities = activities.withColumns({
        "segment_id": F.format_string("activity_%04d", "act_idx"), "end_idx": F.col("end_idx") + F.when((k0 % 40 == 13) & (F.col("act_idx") == 1), 1).otherwise(0),
        "start_id": F.when((k0 % 50 == 7) & (F.col("act_idx") == 0), "someone else").otherwise(F.col("start_id")),
    })
    judged = segments.cache_verdict(order_sessions(activities, SESSION, "start_idx"), semantic.select(SESSION, "seg_idx", "semantic_action_id"), stored, current, "seg_idx", "semantic_action_id")
    kept = activities.join(judged.where("reusable").select(SESSION), SESSION, "left_semi")
    rebuilt = segments.rows_of_segments(kept.select(SESSION, "act_idx", "start_idx", "end_idx"), semantic, "seg_idx")
    return rebuilt.groupBy(SESSION, "act_idx").agg(F.sum(F.col("end_action_idx") - F.col("start_action_idx") + 1).alias("event_count"))


# ---- thread summaries ------------------------------------------------------------------------

FIRSTS_SQL = """
own AS (SELECT * FROM assigned WHERE canonical_root_id <> ''),
seen AS (SELECT o.session_id, o.canonical_root_id, o.leaf_idx, s.idx, s.app, s.entity, s.ocr FROM own o JOIN steps s ON o.session_id = s.session_id AND s.idx BETWEEN start_action_idx AND end_action_idx),
values_of AS (
  SELECT session_id, canonical_root_id, 'apps' AS kind, app AS v, min(idx) AS p FROM seen GROUP BY ALL
  UNION ALL SELECT session_id, canonical_root_id, 'entities', entity, min(idx) FROM seen WHERE entity <> '' GROUP BY ALL
  UNION ALL SELECT session_id, canonical_root_id, 'screen', ocr, min(idx) FROM seen WHERE ocr IS NOT NULL GROUP BY ALL
  UNION ALL SELECT session_id, canonical_root_id, 'anchors', entity, min(p) FROM (
    SELECT session_id, canonical_root_id, leaf_idx, entity, min(idx) AS p FROM seen WHERE entity <> '' GROUP BY session_id, canonical_root_id, leaf_idx, entity
    QUALIFY row_number() OVER (PARTITION BY session_id, canonical_root_id, leaf_idx ORDER BY min(idx)) <= 3) GROUP BY session_id, canonical_root_id, entity
),
lists AS (
  SELECT session_id, canonical_root_id, string_agg(v, '|' ORDER BY p) FILTER (kind = 'apps' AND n <= 4) AS apps, string_agg(v, '|' ORDER BY p) FILTER (kind = 'entities' AND n <= 6) AS entities,
    string_agg(v, '|' ORDER BY p) FILTER (kind = 'screen' AND n <= 3) AS screen, string_agg(v, '|' ORDER BY p) FILTER (kind = 'anchors' AND n <= 5) AS anchors
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, canonical_root_id, kind ORDER BY p) AS n FROM values_of) GROUP BY ALL
)
"""


@query(
    "root_summaries",
    with_ctes(*BASE, EPISODES_SQL, FIRSTS_SQL)
    + """SELECT o.session_id, o.canonical_root_id, count(*) AS leaf_count, min(o.leaf_idx) AS first_leaf_idx, max(o.leaf_idx) AS last_leaf_idx,
  arg_min(concat(o.label, '. ', l.context), o.leaf_idx) AS summary, arg_max(l.context, o.leaf_idx) AS last_update, coalesce(any_value(apps), '') AS apps, coalesce(any_value(entities), '') AS entities,
  coalesce(any_value(screen), '') AS screen, coalesce(any_value(anchors), '') AS anchors, any_value(n_episodes) AS n_episodes
FROM own o JOIN leaves l ON l.session_id = o.session_id AND l.leaf_idx = o.leaf_idx
JOIN (SELECT session_id, canonical_root_id, count(*) AS n_episodes FROM episodes GROUP BY ALL) e ON e.session_id = o.session_id AND e.canonical_root_id = o.canonical_root_id LEFT JOIN lists i ON i.session_id = o.session_id AND i.canonical_root_id = o.canonical_root_id GROUP BY o.session_id, o.canonical_root_id""",
)
def root_summaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(leaves(spark, folder))
    out = threads.root_summaries(rows, cut_lineage(assigned(rows)))
    lists = {"apps": "apps_used", "entities": "entities", "screen": "ocr_texts", "anchors": "anchor"}
    return out.select(
        SESSION, ROOT, "leaf_count", "first_leaf_idx", "last_leaf_idx", "summary", "last_update", "n_episodes", *(F.array_join(c, "|").alias(n) for n, c in lists.items())
    )


@query(
    "thread_output_ids",
    with_ctes(*BASE)
    + """, own AS (SELECT * FROM assigned WHERE canonical_root_id <> ''),
seen AS (SELECT o.session_id, o.canonical_root_id, o.leaf_idx, s.idx, s.app, s.action_id, s.idx - o.start_action_idx AS j FROM own o JOIN steps s ON o.session_id = s.session_id AND s.idx BETWEEN start_action_idx AND end_action_idx),
ids AS (
  SELECT session_id, canonical_root_id, 'activity' AS kind, printf('activity_%04d', leaf_idx) AS id, leaf_idx AS pos FROM own UNION ALL SELECT session_id, canonical_root_id, 'raw', action_id, idx FROM seen
  UNION ALL SELECT session_id, canonical_root_id, 'semantic', action_id, idx FROM seen WHERE j < 3 UNION ALL SELECT session_id, canonical_root_id, 'application', app, idx FROM seen
),
firsts AS (SELECT session_id, canonical_root_id, kind, id, min(pos) AS pos FROM ids GROUP BY ALL)
SELECT session_id, canonical_root_id, kind, id, row_number() OVER (PARTITION BY session_id, canonical_root_id, kind ORDER BY pos) AS place FROM firsts""",
)
def thread_output_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(leaves(spark, folder))
    return threads.output_ids(rows, cut_lineage(assigned(rows))).select(SESSION, ROOT, "kind", "id", "place")


# ---- prompts, patches and known ids ----------------------------------------------------------


@query(
    "merge_payloads",
    with_ctes(ACTIONS_SQL, STATES_SQL, STEPS_SQL, SEGMENTS_SQL)
    + """, p AS (
  SELECT g.session_id, g.seg_idx, g.start_action_idx AS a, g.end_action_idx AS b, g.label, s.idx, concat('{"action":"', s.action, '"', CASE WHEN s.k % 3 = 0 THEN concat(',"grounded_immediate_intent":"goal ', s.k, '"') ELSE '' END, ',"active_application":"', s.app, '"}') AS j
  FROM segments g JOIN steps s ON s.session_id = g.session_id AND s.idx BETWEEN g.start_action_idx AND g.end_action_idx),
t AS (SELECT *, 0 AS half FROM p WHERE idx <= a + 1 UNION ALL SELECT *, 1 FROM p WHERE idx >= b - 1)
SELECT session_id, seg_idx, concat('{"action_range":[', a, ',', b, '],"semantic_action":"', label, '","event_count":', b - a + 1, ',"representative_actions":[', string_agg(j, ',' ORDER BY half, idx), ']}') AS payload FROM t GROUP BY session_id, seg_idx, a, b, label""",
)
def merge_payloads(spark: SparkSession, folder: str) -> DataFrame:
    so = standins.steps(spark, folder)
    goal = F.when(F.col("k") % 3 == 0, F.concat(F.lit("goal "), F.col("k").cast("string")))
    rows = so.df.select(SESSION, "idx", "action", goal.alias("goal"), F.col("app").alias("active_application"))
    return requests.merge_payloads(standins.segments(so).df, rows)


@query(
    "patched_texts",
    with_ctes(ACTIONS_SQL, STATES_SQL, STEPS_SQL)
    + """, w AS (SELECT session_id, ocr IS NULL AND before IS NOT NULL AS o, line_no % 4 <> 0 AS f FROM steps)
SELECT session_id, count(*) AS asked, count(*) FILTER (f) AS patched, count(*) FILTER (NOT f) AS still_missing FROM w WHERE o GROUP BY session_id""",
)
def patched_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A later reading finds text for three lines of four; every row is read, only missing ones change."""
    rows = standins.steps(spark, folder).df.select(SESSION, "line_no", "before", "ocr")
    found = rows.select(SESSION, "line_no", F.when(F.col("line_no") % 4 != 0, "read").otherwise("{}").alias("ocr"))
    return requests.patch_texts(rows, found, "ocr", [SESSION, "line_no"])[1]


@query(
    "source_known_ids",
    """WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s FROM lineitem),
i AS (
  SELECT k, printf('activity_%04d', p % 100) AS e FROM l UNION SELECT k, concat('a', s) FROM l UNION SELECT k, printf('activity_%04d', 100 + k % 7 + unnest([0, 1, 2])) FROM l UNION SELECT k, printf('subgoal_segment_%04d', k % 9) FROM l
)
SELECT CAST(k AS VARCHAR) AS root_id, e AS evidence_id FROM i""",
)
def source_known_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Sources nested three deep, with reference lists that hold ranges."""
    k = F.col("l_orderkey")
    padded = lambda word, n: F.format_string(f"{word}_%04d", n.cast("bigint"))
    member = F.struct(padded("activity", F.col("l_partkey") % 100).alias("activity_id"), F.struct(F.array(F.concat(F.lit("a"), F.col("l_suppkey").cast("string")), F.lit(" ")).alias("raw_action_ids")).alias("evidence"))
    packed = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(member).alias("members"))
    span = F.concat(padded("activity", 100 + k % 7), F.lit("-"), padded("activity", 102 + k % 7))
    sources = packed.select(
        F.lit("s").alias(SESSION), k.cast("string").alias("root_id"), F.struct("members", F.array(span).alias("source_activity_ids")).alias("root_objective"),
        F.array(padded("subgoal_segment", k % 9)).alias("subgoal_segments"), F.lit("activity_9999").alias("title"),
    )
    return evidence.source_ids(sources).select("root_id", "evidence_id")


# ---- reports ---------------------------------------------------------------------------------


@query(
    "report_body",
    """WITH d AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS j FROM lineitem)
SELECT CAST(o_custkey AS VARCHAR) AS root_id, lpad(CAST(i AS VARCHAR), 8, '0') AS sort_key, concat(i, '. ', CASE WHEN o_orderkey % 4 = 1 THEN 'SEQ' WHEN o_orderkey % 4 = 2 THEN concat('step ', i) ELSE o_orderpriority END) AS line FROM d
UNION ALL SELECT CAST(o_custkey AS VARCHAR), concat(lpad(CAST(i AS VARCHAR), 8, '0'), '.', lpad(CAST(j AS VARCHAR), 8, '0')), concat('  ', j, '. part ', l_partkey) FROM d JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0
UNION ALL SELECT CAST(o_custkey AS VARCHAR), concat(lpad(CAST(i AS VARCHAR), 8, '0'), '.', lpad(CAST(j AS VARCHAR), 8, '0'), '.00000001'), '    - FOR' FROM d JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 AND l_partkey % 3 = 0
UNION ALL SELECT CAST(o_custkey AS VARCHAR), concat(lpad(CAST(i AS VARCHAR), 8, '0'), '.', lpad(CAST(j AS VARCHAR), 8, '0'), '.00000001'), '    1. last' FROM d JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 AND l_partkey % 3 = 1
UNION ALL SELECT CAST(o_custkey AS VARCHAR), concat(lpad(CAST(i AS VARCHAR), 8, '0'), '.00000001'), '  - SEQ' FROM d WHERE o_orderkey % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l_orderkey = o_orderkey)""",
)
def report_body(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies nested three deep: a customer's orders, their lines, a last step or an operator below these."""
    k, part = F.col("o_orderkey"), F.col("l_partkey")
    nested = F.struct(F.when(part % 3 == 0, "FOR").alias("operator"), F.when(part % 3 == 1, F.array(F.struct(F.lit("last").alias("name")))).alias("steps"))
    step = F.struct(F.concat(F.lit("part "), part.cast("string")).alias("name"), F.when(part % 3 != 2, nested).alias("body"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    inner = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").groupBy("o_orderkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), step.alias("s")))), lambda x: x["s"]).alias("steps")
    )
    body = F.struct(F.lit("SEQ").alias("operator"), F.when(k % 5 != 0, F.col("steps")).alias("steps"))
    outer = F.struct(F.when(~(k % 4).isin(1, 2), F.col("o_orderpriority")).alias("name"), F.when(k % 4 == 1, "SEQ").alias("operator"), F.when(k % 5 != 0, body).alias("body"))
    rows = table(spark, folder, "orders").join(inner, "o_orderkey", "left")
    documents = rows.groupBy(F.lit("s").alias(SESSION), F.col("o_custkey").cast("string").alias("root_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), outer.alias("s")))), lambda x: x["s"]).alias("steps")
    )
    node = F.struct(F.lit("p").alias("id"), F.struct(F.lit("SEQ").alias("operator"), "steps").alias("body"))
    steps = flatten.body_steps(documents.select(SESSION, "root_id", F.to_json(F.struct(F.array(node).alias("procedure_nodes"))).alias("value")))
    return report.body_lines(steps).select("root_id", "sort_key", "line")


@query(
    "report_objectives",
    with_ctes(TREE_SQL)
    + """, n AS (SELECT *, array_to_string([lpad(x, 8, '0') FOR x IN regexp_extract_all(path, '\\[([0-9]+)\\]', 1)], '.') AS k, CASE WHEN act % 4 = 0 THEN '' ELSE concat('about ', act) END AS summary FROM tree_nodes),
lines AS (
  SELECT root_id, concat(k, ':0') AS sort_key, concat(repeat('  ', depth), '- **', node_id, '** ', objective, ' _(', ref, ')_') AS line FROM n
  UNION ALL SELECT root_id, concat(k, ':1'), concat(repeat('  ', depth), '  - ', summary) FROM n WHERE summary <> ''
  UNION ALL SELECT root_id, concat(k, ':2'), concat(repeat('  ', depth), '  - Deliverables: file: a -> b; report: c') FROM n WHERE act % 3 = 0
  UNION ALL SELECT root_id, concat(k, ':3'), concat(repeat('  ', depth), '  - Success: p | q') FROM n WHERE act % 5 = 0
  UNION ALL SELECT root_id, concat(k, ':4'), concat(repeat('  ', depth), '  - Observed outcome: ', CASE WHEN act % 7 = 1 THEN 'achieved' ELSE 'partial: half' END) FROM n WHERE act % 7 IN (1, 2)
  UNION ALL SELECT DISTINCT root_id, '0', '| ID | Local objectives | Objective | Deliverables | Success criteria | Observed outcome | Evidence summary |' FROM n
  UNION ALL SELECT DISTINCT root_id, '1', '| --- | --- | --- | --- | --- | --- | --- |' FROM n
  UNION ALL SELECT root_id, concat('2:', k), concat('| ', node_id, ' | ', ref, ' | ', objective, ' | ', CASE WHEN act % 3 = 0 THEN 'file: a -> b; report: c' ELSE '-' END, ' | ', CASE WHEN act % 5 = 0 THEN 'p \\| q' ELSE '-' END,
    ' | ', CASE WHEN act % 7 = 1 THEN 'achieved' WHEN act % 7 = 2 THEN 'partial: half' ELSE '-' END, ' | ', summary, ' |') FROM n WHERE depth = 2
)
SELECT * FROM lines""",
)
def report_objectives(spark: SparkSession, folder: str) -> DataFrame:
    """Tree lines with their details, and the table of leaves."""
    act = F.col("act")
    item = lambda kind, target, state: F.struct(F.lit(kind).alias("kind"), F.lit(target).alias("target"), F.lit(state).alias("expected_state"))
    nodes = models.tree_nodes(spark, folder).withColumns({
        "summary": F.when(act % 4 == 0, " ").otherwise(F.concat(F.lit("about "), act.cast("string"))),
        "deliverables": F.when(act % 3 == 0, F.array(item("file", "a", "b"), item("report", "", "c"), item("", "", ""))),
        "success_criteria": F.when(act % 5 == 0, F.array(F.struct(F.lit("p | q").alias("predicate")))),
        "observed_outcome": F.when((act % 7).isin(1, 2), F.struct(F.when(act % 7 == 1, "achieved").otherwise("partial").alias("status"), F.when(act % 7 == 2, "half").otherwise(" ").alias("description"))),
    })
    return report.objective_lines(nodes).unionByName(report.leaf_table(nodes)).select("root_id", "sort_key", "line")


# ---- layout items ----------------------------------------------------------------------------


@query(
    "layout_items",
    """WITH i AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS index FROM lineitem)
SELECT CAST(k AS VARCHAR) AS id, index, CASE WHEN p % 3 = 0 THEN 'text' ELSE 'image' END AS label, CASE p % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'icon' ELSE 'unknown' END AS native_label,
  CASE p % 4 WHEN 0 THEN concat('part ', p) WHEN 1 THEN CAST(p AS VARCHAR) WHEN 2 THEN concat('{"n":', p, '}') END AS content, CAST(100.0 AS DOUBLE) AS x1, CAST(200.0 + s % 10 * 10 AS DOUBLE) AS x2 FROM i WHERE p % 5 <> 0 AND p % 7 <> 0""",
)
def layout_items(spark: SparkSession, folder: str) -> DataFrame:
    """An answer for every order, an item for every line; some are no objects and some have no box."""
    part = F.col("l_partkey").cast("string")
    box = F.concat(F.lit("[0.1,0.1,"), F.format_number(F.lit(0.2) + F.col("l_suppkey") % 10 * 0.01, 2), F.lit(",0.5]"))
    kind = F.when(F.col("l_partkey") % 3 == 0, '"type":"text",').when(F.col("l_partkey") % 3 == 1, '"type":"icon",').otherwise("")
    turn = F.col("l_partkey") % 4
    content = F.when(turn == 0, F.concat(F.lit('"part '), part, F.lit('"'))).when(turn == 1, part).when(turn == 2, F.concat(F.lit('{"n":'), part, F.lit("}"))).otherwise("null")
    item = F.concat(F.lit("{"), kind, F.lit('"bbox":'), F.when(F.col("l_partkey") % 5 == 0, "null").otherwise(box), F.lit(',"content":'), content, F.lit("}"))
    item = F.when(F.col("l_partkey") % 7 == 0, "3").otherwise(item)
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    found = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), item.alias("i")))), lambda x: x["i"]), ",").alias("items")
    )
    answers = found.select("id", F.concat(F.lit('{"parsed_content":['), "items", F.lit("]}")).alias("value"))
    out = boxes.layout_items(answers, 1000, 800)
    return out.select("id", "index", "label", "native_label", "content", F.round("box.x1", 6).alias("x1"), F.round("box.x2", 6).alias("x2"))
