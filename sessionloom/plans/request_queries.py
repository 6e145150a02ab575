"""Queries of the request and reader projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import requests
from sessionloom.plans import standins
from sessionloom.plans.base import query, table
from sessionloom.plans.standins import ACTIONS_SQL, SEGMENTS_SQL, STATES_SQL, STEPS_SQL, with_ctes

BASE = (ACTIONS_SQL, STATES_SQL, STEPS_SQL)
TURNS_SQL = "turns AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role AS root_id, text, concat('activity_', turn) AS activity_id FROM conversations)"


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", F.col("role").alias("root_id"), "text",
        F.concat(F.lit("activity_"), F.col("turn").cast("string")).alias("activity_id"),
    )


@query(
    "grounding_requests",
    with_ctes(ACTIONS_SQL, STATES_SQL)
    + """SELECT session_id, line_no, coalesce(CASE WHEN line_no % 13 = 0 THEN 'activity entry is missing action'
    WHEN before IS NULL THEN 'before screenshot not found' END, '') AS error,
  coalesce(CASE WHEN line_no % 13 <> 0 AND before IS NOT NULL THEN before END, '') AS before_image,
  coalesce(CASE WHEN line_no % 13 <> 0 AND before IS NOT NULL THEN after END, '') AS after_image FROM states""",
)
def grounding_requests(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.states(spark, folder).withColumn("action", F.when(F.col("line_no") % 13 != 0, F.col("action")))
    made = requests.grounding_requests(rows)
    return made.select("session_id", "line_no", *[F.coalesce(c, F.lit("")).alias(c) for c in ("error", "before_image", "after_image")])


@query(
    "side_choice",
    with_ctes(ACTIONS_SQL, STATES_SQL)
    + """SELECT session_id, line_no, CASE WHEN before IS NULL THEN coalesce(after, '') ELSE before END AS forward,
  CASE WHEN after IS NULL THEN coalesce(before, '') ELSE after END AS backward FROM states""",
)
def side_choice(spark: SparkSession, folder: str) -> DataFrame:
    before, after = F.col("before"), F.col("after")
    return standins.states(spark, folder).select(
        "session_id", "line_no", F.coalesce(requests.side(before, after), F.lit("")).alias("forward"),
        F.coalesce(requests.side(before, after, reverse=True), F.lit("")).alias("backward"),
    )


@query(
    "missing_text_worklist",
    with_ctes(*BASE) + "SELECT session_id, idx, action_id, before FROM steps WHERE k % 3 = 0 AND line_no % 7 <> 0",
)
def missing_text_worklist(spark: SparkSession, folder: str) -> DataFrame:
    return requests.missing_texts(standins.steps(spark, folder).df, "ocr").select("session_id", "idx", "action_id", "before")


@query(
    "action_payloads",
    with_ctes(*BASE)
    + """SELECT session_id, idx, action, action_id AS id, CASE WHEN k % 4 = 0 THEN 'error' ELSE '' END AS status, app AS active_application,
  CASE WHEN length(c) <= 220 THEN c ELSE concat(substr(c, 1, 217), '...') END AS content, CASE WHEN entity = '' THEN 4 ELSE 5 END - CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS n_keys
FROM (SELECT *, CASE WHEN entity = '' THEN '' ELSE repeat(concat(entity, ' '), 1 + k % 40) END AS e FROM steps), LATERAL (SELECT trim(replace(e, chr(10), ' ')) AS c)""",
)
def action_payloads(spark: SparkSession, folder: str) -> DataFrame:
    steps = standins.steps(spark, folder).df
    k = F.col("k")
    content = F.when(F.col("entity") != "", F.repeat(F.concat("entity", F.lit(" ")), (1 + k % 40).cast("int"))).otherwise(F.lit(""))
    status = F.when(k % 4 == 0, "error").otherwise("success")
    payload = requests.action_payload(status, F.lit(None).cast("string"), F.col("app"), content, F.col("action_id"), F.col("action"))
    rows = steps.select("session_id", "idx", payload.alias("payload"))
    value = lambda key: F.coalesce(F.get_json_object("payload", f"$.{key}"), F.lit(""))
    return rows.select(
        "session_id", "idx", value("action").alias("action"), value("id").alias("id"), value("status").alias("status"),
        value("active_application").alias("active_application"), value("important_content_on_screen").alias("content"),
        F.size(F.json_object_keys("payload")).alias("n_keys"),
    )


@query(
    "backward_context",
    with_ctes(*BASE, SEGMENTS_SQL)
    + """SELECT b.session_id, b.batch, b.start, b."end", CAST(count(s.seg_idx) AS BIGINT) AS n_context,
  coalesce(string_agg(concat('- ', s.label), chr(10) ORDER BY s.seg_idx) FILTER (s.seg_idx IS NOT NULL), 'End of session. No subsequent actions.') AS context
FROM (SELECT session_id, batch, greatest(n - batch * 12 - 12, 0) AS start, n - batch * 12 AS "end"
      FROM (SELECT session_id, n, unnest(range((n - 1) // 12 + 1)) AS batch FROM (SELECT session_id, max(idx) + 1 AS n FROM steps GROUP BY session_id))) b
LEFT JOIN (SELECT * FROM segments) s ON s.session_id = b.session_id AND s.start_action_idx >= b."end"
  AND s.seg_idx < 8 + CAST(ceil(b."end" / 5.0) AS BIGINT)
GROUP BY b.session_id, b.batch, b.start, b."end" """,
)
def backward_context(spark: SparkSession, folder: str) -> DataFrame:
    steps = standins.steps(spark, folder)
    made = requests.following_context(requests.backward_batches(steps.df.select("session_id", "idx"), 12), standins.segments(steps).df)
    return made.select("session_id", F.col("batch").cast("bigint"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), F.col("n_context").cast("bigint"), "context")


@query(
    "threads_recent_first",
    with_ctes(TURNS_SQL)
    + """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_leaf_idx DESC, first_leaf_idx DESC, root_id) AS place
FROM (SELECT session_id, root_id, min(turn) AS first_leaf_idx, max(turn) AS last_leaf_idx FROM turns GROUP BY ALL)""",
)
def threads_recent_first(spark: SparkSession, folder: str) -> DataFrame:
    spans = turns(spark, folder).groupBy("session_id", "root_id").agg(F.min("turn").alias("first_leaf_idx"), F.max("turn").alias("last_leaf_idx"))
    return requests.recent_first(spans).withColumn("place", F.col("place").cast("bigint"))


@query(
    "related_trace",
    with_ctes(TURNS_SQL)
    + """SELECT session_id, activity_id, turn FROM (
  SELECT *, length(text) % 7 = 0 AS hit, bool_or(length(text) % 7 = 0) OVER (PARTITION BY session_id) AS any_hit FROM turns) WHERE hit OR NOT any_hit""",
)
def related_trace(spark: SparkSession, folder: str) -> DataFrame:
    rows = turns(spark, folder)
    return requests.related_only(rows, rows.where(F.length("text") % 7 == 0)).select("session_id", "activity_id", "turn")


@query(
    "thread_results",
    with_ctes(TURNS_SQL)
    + """SELECT session_id, root_id, concat('runs/', session_id, '/', root_id, '.json') AS input_file,
  concat('runs/', session_id, '/', root_id, '.hierarchy.json') AS output_file, count(*) > 0 AS ok, 'per_thread' AS execution_mode,
  count(*) AS activity_count, CAST(sum(length(text)) AS BIGINT) AS total_tokens, round(sum(length(text)) / 1e6, 8) AS estimated_usd
FROM turns GROUP BY session_id, root_id""",
)
def thread_results(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.sum(F.length("text").cast("bigint"))
    threads = turns(spark, folder).groupBy("session_id", "root_id").agg(F.count("*").alias("activities"), tokens.alias("tokens"), (tokens / 1e6).alias("usd"))
    return requests.thread_results(threads, "runs")
