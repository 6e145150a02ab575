"""Queries over task threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import online, segments, threads, windows
from sessionloom.plans import standins
from sessionloom.plans.base import query, table
from sessionloom.session import cut_lineage
from sessionloom.plans.standins import ACTIONS_SQL, SEGMENTS_SQL, STATES_SQL, STEPS_SQL, with_ctes

SESSION, ROOT = "session_id", "canonical_root_id"

# Leaves are the candidate segments; a leaf's provisional thread comes from the first step's number.
LEAVES_SQL = """
leaves AS (SELECT *, seg_idx AS leaf_idx, concat('P', k0 // 20) AS provisional_root_id, k0 % 6 AS num_actions FROM segments),
provisional AS (
  SELECT *, concat('C', row_number() OVER (PARTITION BY session_id ORDER BY first_leaf_idx)) AS canonical_root_id
  FROM (SELECT session_id, provisional_root_id, min(leaf_idx) AS first_leaf_idx FROM leaves GROUP BY ALL)
),
assigned AS (
  SELECT l.session_id, l.leaf_idx, l.provisional_root_id, CASE WHEN l.k0 % 29 = 0 THEN 'C1' WHEN l.k0 = 99 THEN '' ELSE p.canonical_root_id END AS canonical_root_id,
    l.label, l.num_actions, l.start_action_idx, l.end_action_idx
  FROM leaves l JOIN provisional p ON l.session_id = p.session_id AND l.provisional_root_id = p.provisional_root_id
)
"""
BASE = (ACTIONS_SQL, STATES_SQL, STEPS_SQL, SEGMENTS_SQL, LEAVES_SQL)


def leaves(spark: SparkSession, folder: str) -> DataFrame:
    so = standins.steps(spark, folder)
    rows = so.df.withColumn("leaf_idx", F.floor(F.col("idx") / standins.SEGMENT_ROWS))
    evidence = segments.roll_up(rows, [SESSION, "leaf_idx"])
    names = standins.segments(so).df.select(SESSION, F.col("seg_idx").alias("leaf_idx"), "label", "context", "k0")
    out = evidence.join(names, [SESSION, "leaf_idx"])
    return out.select(
        SESSION, "leaf_idx", "k0", F.format_string("activity_%04d", "leaf_idx").alias("activity_id"),
        F.col("label").alias("objective"), F.col("context").alias("procedure_summary"), "apps_used", "entities", "ocr_texts", "pre_state", "post_state",
        F.col("start_action_idx").alias("start_node_idx"), F.col("end_action_idx").alias("end_node_idx"), "start_action_id", "end_action_id",
        "raw_action_ids", "event_count", (F.col("k0") % 6).alias("num_actions"), F.slice("raw_action_ids", 1, 3).alias("semantic_action_ids"),
        F.slice("ocr_texts", 1, 2).alias("semantic_actions"),
    )


def assignments(rows: DataFrame) -> DataFrame:
    return rows.select(SESSION, "leaf_idx", "k0", F.concat(F.lit("P"), F.floor(F.col("k0") / 20).cast("string")).alias("provisional_root_id"))


def assigned(rows: DataFrame) -> DataFrame:
    """Canonical assignment with a few overrides and a few unassigned leaves."""
    given = assignments(rows)
    members = threads.identity_consolidation(given)
    roots = members.select(SESSION, ROOT, F.lit("").alias("label"), F.concat(F.lit("thread "), "provisional_root_id").alias("objective"))
    moved = given.where((F.col("k0") % 29 == 0) | (F.col("k0") == 99)).select(
        SESSION, "leaf_idx", F.when(F.col("k0") % 29 == 0, "C1").otherwise("").alias(ROOT)
    )
    return threads.thread_map(given.drop("k0"), members.select(SESSION, ROOT, "provisional_root_id"), roots, moved)


@query(
    "thread_map",
    with_ctes(*BASE)
    + """SELECT a.session_id, a.leaf_idx, a.provisional_root_id, a.canonical_root_id, coalesce('thread ' || p.provisional_root_id, '') AS canonical_root_label
FROM assigned a LEFT JOIN provisional p ON a.session_id = p.session_id AND a.canonical_root_id = p.canonical_root_id""",
)
def thread_map(spark: SparkSession, folder: str) -> DataFrame:
    return assigned(leaves(spark, folder))


EPISODES_SQL = """
runs AS (
  SELECT session_id, canonical_root_id, leaf_idx, leaf_idx - row_number() OVER (PARTITION BY session_id, canonical_root_id ORDER BY leaf_idx) AS grp
  FROM assigned WHERE canonical_root_id <> ''
),
episodes AS (
  SELECT session_id, canonical_root_id, row_number() OVER (PARTITION BY session_id, canonical_root_id ORDER BY grp) AS episode_no,
    min(leaf_idx) AS start_leaf_idx, max(leaf_idx) AS end_leaf_idx, count(*) AS n_leaves FROM runs GROUP BY session_id, canonical_root_id, grp
)
"""


@query(
    "thread_episodes",
    with_ctes(*BASE, EPISODES_SQL) + "SELECT *, concat(canonical_root_id, '.E', episode_no) AS episode_id FROM episodes",
)
def thread_episodes(spark: SparkSession, folder: str) -> DataFrame:
    return threads.episodes(assigned(leaves(spark, folder)))


@query(
    "thread_rollup",
    with_ctes(*BASE, EPISODES_SQL)
    + """, own AS (SELECT * FROM assigned WHERE canonical_root_id <> ''),
first_app AS (SELECT o.session_id, canonical_root_id, app AS v, min(idx) AS p FROM own o JOIN steps s ON o.session_id = s.session_id AND s.idx BETWEEN start_action_idx AND end_action_idx GROUP BY ALL),
first_entity AS (SELECT o.session_id, canonical_root_id, entity AS v, min(idx) AS p FROM own o JOIN steps s ON o.session_id = s.session_id AND s.idx BETWEEN start_action_idx AND end_action_idx WHERE entity <> '' GROUP BY ALL),
first_obj AS (SELECT session_id, canonical_root_id, label AS v, min(leaf_idx) AS p FROM own GROUP BY ALL)
SELECT b.*, coalesce(a.list, '') AS apps, coalesce(e.list, '') AS entities, coalesce(o.list, '') AS samples, ep.n_episodes FROM (
  SELECT session_id, canonical_root_id, count(*) AS leaf_count, min(leaf_idx) AS first_leaf_idx, max(leaf_idx) AS last_leaf_idx, min(start_action_idx) AS start_node_idx, max(end_action_idx) AS end_node_idx FROM own GROUP BY ALL) b
LEFT JOIN (SELECT session_id, canonical_root_id, string_agg(v, '|' ORDER BY p) AS list FROM first_app GROUP BY ALL) a USING (session_id, canonical_root_id)
LEFT JOIN (SELECT session_id, canonical_root_id, string_agg(v, '|' ORDER BY p) AS list FROM (SELECT *, row_number() OVER (PARTITION BY session_id, canonical_root_id ORDER BY p) AS rn FROM first_entity) WHERE rn <= 12 GROUP BY ALL) e USING (session_id, canonical_root_id)
LEFT JOIN (SELECT session_id, canonical_root_id, string_agg(v, '|' ORDER BY p) AS list FROM first_obj GROUP BY ALL) o USING (session_id, canonical_root_id)
JOIN (SELECT session_id, canonical_root_id, count(*) AS n_episodes FROM episodes GROUP BY ALL) ep USING (session_id, canonical_root_id)""",
)
def thread_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(leaves(spark, folder))  # read by every part of the roll-up
    out = threads.roll_up(rows, cut_lineage(assigned(rows)))
    lists = {"apps": "apps_used", "entities": "entities", "samples": "sample_leaf_objectives"}
    return out.select(
        SESSION, ROOT, "leaf_count", "first_leaf_idx", "last_leaf_idx", "start_node_idx", "end_node_idx", "n_episodes",
        *[F.array_join(src, "|").alias(name) for name, src in lists.items()],
    )


@query(
    "thread_outputs",
    with_ctes(*BASE)
    + """SELECT session_id, canonical_root_id, count(*) AS activity_count, CAST(sum(end_action_idx - start_action_idx + 1) AS BIGINT) AS event_count,
  printf('activity_%04d', min(leaf_idx)) AS first_activity_id, printf('activity_%04d', max(leaf_idx)) AS last_activity_id,
  CAST(sum(end_action_idx - start_action_idx + 1) AS BIGINT) AS semantic_action_count, CAST(sum(end_action_idx - start_action_idx + 1) AS BIGINT) AS raw_action_count
FROM assigned WHERE canonical_root_id <> '' GROUP BY ALL""",
)
def thread_outputs(spark: SparkSession, folder: str) -> DataFrame:
    rows = leaves(spark, folder)
    return threads.outputs(rows, assigned(rows))


@query(
    "semantic_assignments",
    with_ctes(*BASE)
    + """, ocr_seen AS (SELECT session_id, idx // 5 AS leaf_idx, ocr, row_number() OVER (PARTITION BY session_id, idx // 5 ORDER BY min(idx)) AS rn FROM steps WHERE ocr IS NOT NULL GROUP BY session_id, idx // 5, ocr)
SELECT a.session_id, a.leaf_idx, s.idx AS semantic_action_idx, CASE WHEN s.idx - a.start_action_idx < 3 THEN s.action_id ELSE f.action_id END AS semantic_action_id,
  coalesce(o.ocr, a.label) AS semantic_action, a.canonical_root_id
FROM assigned a JOIN steps s ON a.session_id = s.session_id AND s.idx BETWEEN start_action_idx AND end_action_idx
JOIN steps f ON a.session_id = f.session_id AND f.idx = start_action_idx
LEFT JOIN ocr_seen o ON o.session_id = a.session_id AND o.leaf_idx = a.leaf_idx AND o.rn = s.idx - a.start_action_idx + 1 AND o.rn <= 2""",
)
def semantic_assignments(spark: SparkSession, folder: str) -> DataFrame:
    rows = leaves(spark, folder)
    return threads.semantic_assignments(rows, assigned(rows)).drop("provisional_root_id", "canonical_root_label")


THREADS_SQL = """
thread_rows AS (
  SELECT session_id, canonical_root_id, count(*) AS leaf_count, min(leaf_idx) AS first_leaf_idx, max(leaf_idx) AS last_leaf_idx, arg_min(num_actions, leaf_idx) AS num_actions
  FROM assigned WHERE canonical_root_id <> '' GROUP BY ALL
)
"""


def _threads(rows: DataFrame) -> DataFrame:
    return assigned(rows).where(F.col(ROOT) != "").groupBy(SESSION, ROOT).agg(
        F.count(F.lit(1)).alias("leaf_count"), F.min("leaf_idx").alias("first_leaf_idx"), F.max("leaf_idx").alias("last_leaf_idx")
    )


@query(
    "micro_absorption",
    with_ctes(*BASE, THREADS_SQL)
    + """, n AS (SELECT *, lag(canonical_root_id) OVER w AS pr, lag(last_leaf_idx) OVER w AS pl, lag(leaf_count) OVER w AS pc,
    lead(canonical_root_id) OVER w AS nr, lead(first_leaf_idx) OVER w AS nf, lead(leaf_count) OVER w AS nc FROM thread_rows WINDOW w AS (PARTITION BY session_id ORDER BY first_leaf_idx)),
d AS (SELECT *, CASE WHEN first_leaf_idx - pl BETWEEN 0 AND 2 THEN (first_leaf_idx - pl) * 1000000 + pc * 10 END AS ps,
    CASE WHEN nf - first_leaf_idx BETWEEN 0 AND 2 THEN (nf - first_leaf_idx) * 1000000 + nc * 10 + 1 END AS ns FROM n WHERE leaf_count = 1 AND num_actions <= 3)
SELECT session_id, first_leaf_idx AS leaf_idx, canonical_root_id AS from_root_id, CASE WHEN ns IS NULL OR ps < ns THEN pr ELSE nr END AS canonical_root_id
FROM d WHERE ps IS NOT NULL OR ns IS NOT NULL""",
)
def micro_absorption(spark: SparkSession, folder: str) -> DataFrame:
    rows = leaves(spark, folder)
    return threads.micro_absorption(_threads(rows), rows)


@query(
    "recent_assignments",
    with_ctes(*BASE)
    + """SELECT session_id, leaf_idx, canonical_root_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY leaf_idx DESC) AS recency FROM assigned) WHERE recency <= 10""",
)
def recent_assignments(spark: SparkSession, folder: str) -> DataFrame:
    rows = assigned(leaves(spark, folder)).select(SESSION, "leaf_idx", ROOT)
    return windows.recent_rows(rows, 10, "leaf_idx").withColumn("recency", F.col("recency").cast("bigint"))


@query(
    "consolidation_apply",
    with_ctes(*BASE)
    + """, answer AS (SELECT DISTINCT session_id, provisional_root_id, concat('G', CAST(substr(provisional_root_id, 2) AS BIGINT) % 2) AS g FROM leaves),
first_leaf AS (SELECT a.session_id, g, min(first_leaf_idx) AS first_leaf_idx, count(*) AS n_members FROM answer a JOIN provisional p ON a.session_id = p.session_id AND a.provisional_root_id = p.provisional_root_id GROUP BY ALL)
SELECT session_id, g AS answer_root, first_leaf_idx, n_members, concat('C', row_number() OVER (PARTITION BY session_id ORDER BY first_leaf_idx)) AS canonical_root_id FROM first_leaf""",
)
def consolidation_apply(spark: SparkSession, folder: str) -> DataFrame:
    """An answer joins the provisional threads into two groups and names one thread that does not exist."""
    given = assignments(leaves(spark, folder)).drop("k0")
    group = F.concat(F.lit("G"), (F.substring("provisional_root_id", 2, 9).cast("bigint") % 2).cast("string")).alias("answer_root")
    answer = given.select(SESSION, group, "provisional_root_id")
    ghost = answer.select(SESSION, "answer_root", F.lit("P999").alias("provisional_root_id"))
    return threads.apply_consolidation(answer.unionByName(ghost), given)


@query(
    "answer_checks",
    with_ctes(*BASE)
    + """, answer AS (SELECT session_id, leaf_idx + CASE WHEN k0 = 50 THEN 1000 ELSE 0 END AS leaf_idx, CASE WHEN k0 % 31 = 0 THEN 'P77' ELSE provisional_root_id END AS g FROM leaves WHERE k0 % 37 <> 0
  UNION ALL SELECT session_id, leaf_idx, provisional_root_id FROM leaves WHERE k0 % 41 = 1 AND k0 % 37 <> 0 AND k0 <> 50),
c AS (SELECT session_id, leaf_idx, count(*) AS n FROM answer GROUP BY ALL),
b AS (SELECT coalesce(l.session_id, c.session_id) AS session_id, l.leaf_idx AS e, c.n FROM leaves l FULL JOIN c ON l.session_id = c.session_id AND l.leaf_idx = c.leaf_idx)
SELECT b.session_id, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unknown_items, count(*) FILTER (n > 1) AS repeated, coalesce(any_value(u.k), 0) AS unknown_groups
FROM b LEFT JOIN (SELECT session_id, count(*) AS k FROM answer WHERE g = 'P77' GROUP BY ALL) u ON b.session_id = u.session_id GROUP BY b.session_id""",
)
def answer_checks(spark: SparkSession, folder: str) -> DataFrame:
    """A discovery answer with missing, repeated, unknown leaves and unknown threads."""
    given = assignments(leaves(spark, folder))
    k0 = F.col("k0")
    kept = given.where(k0 % 37 != 0)
    shifted = F.col("leaf_idx") + F.when(k0 == 50, 1000).otherwise(0)
    answer = kept.select(SESSION, shifted.alias("leaf_idx"), F.when(k0 % 31 == 0, "P77").otherwise(F.col("provisional_root_id")).alias("root"))
    again = kept.where((k0 % 41 == 1) & (k0 != 50)).select(SESSION, "leaf_idx", F.col("provisional_root_id").alias("root"))
    known = given.select(SESSION, F.col("provisional_root_id").alias("root"))
    return threads.check_partition(answer.unionByName(again), given.select(SESSION, "leaf_idx"), "leaf_idx", "root", known)


@query(
    "thread_documents",
    with_ctes(*BASE)
    + """SELECT session_id, canonical_root_id, count(*) FILTER (leaf_idx % 13 <> 5) AS activity_count, count(*) FILTER (leaf_idx % 13 = 5) AS missing_activity_count
FROM assigned WHERE canonical_root_id <> '' GROUP BY ALL""",
)
def thread_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = leaves(spark, folder)
    name = F.format_string("activity_%04d", "leaf_idx").alias("activity_id")
    members = assigned(rows).where(F.col(ROOT) != "").select(SESSION, ROOT, F.col("leaf_idx").alias("position"), name)
    return threads.manifest(threads.thread_documents(members, rows.where(F.col("leaf_idx") % 13 != 5)))


@query(
    "default_thread",
    with_ctes(*BASE, THREADS_SQL)
    + "SELECT session_id, arg_max(canonical_root_id, leaf_count * 100000 - first_leaf_idx) AS canonical_root_id FROM thread_rows GROUP BY session_id",
)
def default_thread(spark: SparkSession, folder: str) -> DataFrame:
    rows = _threads(leaves(spark, folder))
    return threads.default_thread(rows.withColumnsRenamed({"leaf_count": "activity_count", "first_leaf_idx": "manifest_order"}))


@query("thread_assign_online")
def thread_assign_online(spark: SparkSession, folder: str) -> DataFrame:
    return online.assign_threads(leaves(spark, folder))


@query("conversation_threads")
def conversation_threads(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation as activities of a session, placed online."""
    none = F.array().cast("array<string>")
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("leaf_idx"), F.col("text").alias("objective"),
        F.lit("").alias("procedure_summary"), F.array("role").alias("apps_used"), none.alias("entities"), none.alias("ocr_texts"),
        F.lit("").alias("pre_state"), F.lit("").alias("post_state"), (F.col("turn") % 5 + 1).alias("num_actions"),
    )
    return online.assign_threads(rows, batch_size=2)


@query(
    "sample_texts",
    """WITH seen AS (SELECT conv_id, CASE role WHEN 'user' THEN concat('U', turn) ELSE concat('a', turn % 4) END AS v, turn FROM conversations),
u AS (SELECT conv_id, v, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM seen GROUP BY conv_id, v),
spots AS (SELECT DISTINCT conv_id, CAST(round_even(i * (n - 1) / 2.0, 0) AS BIGINT) AS pos FROM u, range(0, 3) t(i) WHERE n > 3)
SELECT CAST(u.conv_id AS VARCHAR) AS session_id, string_agg(v, '|' ORDER BY u.pos) AS samples FROM u LEFT JOIN spots s ON u.conv_id = s.conv_id AND u.pos = s.pos WHERE n <= 3 OR s.pos IS NOT NULL GROUP BY u.conv_id""",
)
def sample_texts(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("role") == "user", F.concat(F.lit("U"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("a"), (F.col("turn") % 4).cast("string")))
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", value.alias("v"))
    out = threads.sample_texts(rows, ["session_id"], F.col("v"), "turn", 3)
    return out.select("session_id", F.array_join("samples", "|").alias("samples"))
