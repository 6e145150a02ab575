"""Queries over the raw trace: run merging, timing, state repair, trimming, double clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators import consolidate
from sessionloom.operators.sequence import order_sessions
from sessionloom.plans import standins
from sessionloom.plans.base import query
from sessionloom.plans.standins import ACTIONS_SQL, HOUR, STATES_SQL, with_ctes

RUNS_SQL = """
seen AS (
  SELECT *, CASE WHEN contains(action, 'press') THEN 'key' WHEN contains(action, 'scroll') THEN 'scroll' ELSE 'other' END AS kind
  FROM actions
),
lagged AS (
  SELECT *, lag(kind) OVER w AS pk, lag(action) OVER w AS pa FROM seen WINDOW w AS (PARTITION BY session_id ORDER BY ts, line_no)
),
kept AS (
  SELECT *, CASE WHEN kind = 'key' AND pk = 'key' AND NOT (contains(action, '.cmd') OR contains(action, '.enter')
       OR contains(action, '.tab') OR contains(action, '.up') OR contains(action, '.down')) THEN 0 ELSE 1 END AS opens,
    CASE regexp_extract(action, '\\(([^()]*)', 1) WHEN 'Key.space' THEN ' ' WHEN 'Key.shift' THEN '' WHEN 'Key.backspace' THEN 'Key.backspace'
      WHEN 'Key.enter' THEN 'Key.enter+' ELSE replace(regexp_extract(action, '\\(([^()]*)', 1), '''', '') END AS token
  FROM lagged WHERE NOT (kind = 'scroll' AND pa IS NOT DISTINCT FROM action)
),
numbered AS (
  SELECT *, sum(opens) OVER w AS run_id, sum(CASE WHEN opens = 1 OR token <> 'Key.backspace' THEN 1 ELSE 0 END) OVER w AS piece
  FROM kept WINDOW w AS (PARTITION BY session_id ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING)
),
pieces AS (
  SELECT session_id, run_id, piece, kind, arg_min(token, line_no) AS token, count(*) AS n, min(ts) AS ts_before, max(ts) AS ts_after,
    arg_min(action, ts) AS action
  FROM numbered GROUP BY session_id, run_id, piece, kind
),
runs AS (
  SELECT session_id, run_id, kind, CASE WHEN kind = 'key'
      THEN concat('key_press(''', string_agg(substr(token, 1, greatest(0, length(token) - (n - 1))), '' ORDER BY piece), ''')')
      ELSE min(action) END AS action,
    min(ts_before) AS ts_before, max(ts_after) AS ts_after, sum(n) AS n_events
  FROM pieces GROUP BY session_id, run_id, kind
)
"""


@query(
    "trace_run_merge",
    with_ctes(ACTIONS_SQL, RUNS_SQL)
    + """SELECT session_id, concat('n', CAST(run_id AS BIGINT)) AS id, kind, action, CAST(n_events AS BIGINT) AS n_events,
  round(ts_before, 3) AS ts_before, round(ts_after, 3) AS ts_after FROM runs""",
)
def trace_run_merge(spark: SparkSession, folder: str) -> DataFrame:
    runs = consolidate.merge_runs(standins.actions(spark, folder)).df
    return runs.select(
        "session_id", "id", "kind", "action", "n_events", F.round("ts_before", 3).alias("ts_before"), F.round("ts_after", 3).alias("ts_after")
    )


TIMES_SQL = """
own AS (
  SELECT *, coalesce(TRY_CAST(split_part(split_part(before, '/', 2), '_', 1) AS DOUBLE), 0) AS b,
    coalesce(TRY_CAST(split_part(split_part(after, '/', 2), '_', 1) AS DOUBLE), 0) AS a
  FROM states
),
filled AS (
  SELECT *, CASE WHEN b = 0 THEN a ELSE b END AS time_before, CASE WHEN a = 0 THEN b ELSE a END AS time_after FROM own
),
timed AS (
  SELECT *, time_after - time_before AS time_range,
    CASE WHEN time_before <> 0 AND coalesce(last_time, 0) <> 0 THEN time_before - last_time ELSE 0 END AS time_diff
  FROM (SELECT *, lag(CASE WHEN a <> 0 THEN a ELSE b END) OVER (PARTITION BY session_id ORDER BY ts, line_no) AS last_time FROM filled)
)
"""


@query(
    "trace_timing",
    with_ctes(ACTIONS_SQL, STATES_SQL, TIMES_SQL)
    + """SELECT session_id, line_no, round(time_before, 3) AS time_before, round(time_after, 3) AS time_after,
  round(time_range, 3) AS time_range, round(time_diff, 3) AS time_diff FROM timed""",
)
def trace_timing(spark: SparkSession, folder: str) -> DataFrame:
    so = order_sessions(standins.states(spark, folder), "session_id", ("ts", "line_no"))
    timed = consolidate.measure_times(so).df
    columns = ["time_before", "time_after", "time_range", "time_diff"]
    return timed.select("session_id", "line_no", *[F.round(c, 3).alias(c) for c in columns])


@query(
    "trace_state_repair",
    with_ctes(ACTIONS_SQL, STATES_SQL)
    + """SELECT session_id, line_no, action,
  coalesce(CASE WHEN before IS NULL AND NOT contains(action, 'press') THEN lag(after) OVER w ELSE before END, '') AS before,
  coalesce(CASE WHEN contains(action, 'drag') THEN after ELSE coalesce(lead(before) OVER w, after) END, '') AS after
FROM states WINDOW w AS (PARTITION BY session_id ORDER BY ts, line_no)""",
)
def trace_state_repair(spark: SparkSession, folder: str) -> DataFrame:
    so = order_sessions(standins.states(spark, folder), "session_id", ("ts", "line_no"))
    rows = consolidate.repair_states(so).df
    return rows.select("session_id", "line_no", "action", *[F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after")])


# Only every fifth event counts as complete here, so that trimming removes rows at both ends.
@query(
    "trace_trim",
    with_ctes(ACTIONS_SQL, STATES_SQL)
    + """SELECT session_id, line_no FROM (
  SELECT session_id, line_no, i, min(i) FILTER (complete) OVER (PARTITION BY session_id) AS lo, max(i) FILTER (complete) OVER (PARTITION BY session_id) AS hi
  FROM (SELECT session_id, line_no, line_no % 5 = 0 AND before IS NOT NULL AND after IS NOT NULL AS complete,
          row_number() OVER (PARTITION BY session_id ORDER BY ts, line_no) AS i FROM states))
WHERE lo IS NULL OR i BETWEEN lo AND hi""",
)
def trace_trim(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.states(spark, folder).withColumn("before", F.when(F.col("line_no") % 5 == 0, F.col("before")))
    so = order_sessions(rows, "session_id", ("ts", "line_no"))
    return consolidate.trim_to_complete(so).df.select("session_id", "line_no")


CLICKS_SQL = """
clicks AS (
  SELECT *, row_number() OVER w AS i, lead(action) OVER w AS na, lead(time_diff) OVER w AS nd, lead(time_range) OVER w AS nr,
    lead(k) OVER w AS nk, lead(v) OVER w AS nv, lead(time_after) OVER w AS nta
  FROM timed WINDOW w AS (PARTITION BY session_id ORDER BY ts, line_no)
),
flags AS (
  SELECT *, coalesce(contains(action, 'click') AND contains(na, 'click') AND nd <= 43200.0 AND sqrt((nk - k) * (nk - k) + (nv - v) * (nv - v)) < 100.0, false) AS p
  FROM clicks
),
chains AS (
  SELECT *, CASE WHEN p OR pp THEN row_number() OVER (PARTITION BY session_id, grp ORDER BY i) - 1 END AS place FROM (
    SELECT *, sum(CASE WHEN pp THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM (
      SELECT *, coalesce(lag(p) OVER (PARTITION BY session_id ORDER BY i), false) AS pp FROM flags))
)
"""


@query(
    "trace_double_click",
    with_ctes(ACTIONS_SQL, STATES_SQL, TIMES_SQL, CLICKS_SQL)
    + """SELECT session_id, line_no, CASE WHEN d THEN concat('double_', substr(action, 1, 5), substr(action, 11)) ELSE action END AS action, d AS is_double,
  round(CASE WHEN d THEN time_range + nr ELSE time_range END, 3) AS time_range,
  round(CASE WHEN d THEN time_diff + nd ELSE time_diff END, 3) AS time_diff,
  round(CASE WHEN d THEN nta ELSE time_after END, 3) AS time_after
FROM (SELECT *, p AND place % 2 = 0 AS d FROM chains) WHERE NOT (pp AND place % 2 = 1)""",
)
def trace_double_click(spark: SparkSession, folder: str) -> DataFrame:
    so = order_sessions(standins.states(spark, folder), "session_id", ("ts", "line_no"))
    so = consolidate.merge_double_clicks(consolidate.measure_times(so), max_gap=12 * HOUR, max_distance=100.0)
    columns = ["time_range", "time_diff", "time_after"]
    return so.df.select("session_id", "line_no", "action", "is_double", *[F.round(c, 3).alias(c) for c in columns])


@query(
    "trace_session_duration",
    with_ctes(ACTIONS_SQL)
    + """SELECT session_id, CAST(greatest(0, floor(arg_max(ts, line_no) - arg_min(ts, line_no))) AS BIGINT) AS duration_seconds
FROM actions GROUP BY session_id""",
)
def trace_session_duration(spark: SparkSession, folder: str) -> DataFrame:
    return consolidate.session_duration(standins.actions(spark, folder))
