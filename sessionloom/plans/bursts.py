"""Batch twins of the streaming rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import keys
from sessionloom.operators import consolidate
from sessionloom.plans import standins
from sessionloom.plans.base import query
from sessionloom.plans.standins import ACTIONS_SQL, HOUR, with_ctes
from sessionloom.streaming.rules import KeyBursts, RunMerge, ScrollThrottle
from sessionloom.streaming.run import run_batch

DAY = 24 * HOUR


@query(
    "key_bursts",
    with_ctes(ACTIONS_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, kp AS (SELECT session_id, ts, line_no FROM actions WHERE contains(action, 'press')),
nxt AS (SELECT a.session_id, a.ts, min(b.ts) AS n FROM kp a LEFT JOIN kp b ON a.session_id = b.session_id AND b.ts > a.ts + 172800.0 GROUP BY a.session_id, a.ts),
starts AS (SELECT session_id, min(ts) AS ts FROM kp GROUP BY session_id UNION ALL SELECT s.session_id, n.n FROM starts s JOIN nxt n ON s.session_id = n.session_id AND s.ts = n.ts WHERE n.n IS NOT NULL)
SELECT k.session_id, round(s.ts, 3) AS burst_start, arg_min(line_no, k.ts) AS first_line, arg_max(line_no, k.ts) AS last_line, count(*) AS n_keys
FROM kp k ASOF JOIN starts s ON k.session_id = s.session_id AND k.ts >= s.ts GROUP BY k.session_id, s.ts""",
)
def key_bursts(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.actions(spark, folder).where(keys.is_key(F.col("action"))).select("session_id", "ts", "line_no", F.lit("key").alias("kind"))
    return run_batch(rows, KeyBursts(2 * DAY), pause=2 * DAY).withColumn("burst_start", F.round("burst_start", 3))


@query(
    "scroll_throttle",
    with_ctes(ACTIONS_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, sc AS (SELECT session_id, ts, line_no, CAST(k AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y, k % 10 <> 0 AS big, row_number() OVER (PARTITION BY session_id ORDER BY ts, line_no) AS rn FROM actions WHERE event_type = 'view'),
st AS (
  SELECT session_id, rn, line_no, ts AS st, 0 AS cnt, x AS lx, y AS ly, ts AS lt, big AS kept FROM sc WHERE rn = 1
  UNION ALL
  SELECT session_id, rn, line_no, CASE WHEN fresh THEN ts ELSE st END, CASE WHEN fresh THEN 0 WHEN far THEN cnt + 1 ELSE cnt END,
    CASE WHEN ok THEN x ELSE lx END, CASE WHEN ok THEN y ELSE ly END, CASE WHEN ok THEN ts ELSE lt END, ok AND big
  FROM (SELECT *, fresh OR (far AND NOT (ts > st AND (cnt + 1) / (ts - st) > 1.0 / 50000)) AS ok FROM (
    SELECT n.*, s.st, s.cnt, s.lx, s.ly, s.lt, n.ts - s.st > 864000.0 AS fresh,
      NOT (n.ts - s.st > 864000.0) AND NOT (n.ts - s.lt < 21600.0) AND sqrt((n.x - s.lx) * (n.x - s.lx) + (n.y - s.ly) * (n.y - s.ly)) >= 20 AS far
    FROM st s JOIN sc n ON n.session_id = s.session_id AND n.rn = s.rn + 1)))
SELECT session_id, line_no FROM st WHERE kept""",
)
def scroll_throttle(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.actions(spark, folder).where(F.col("event_type") == "view").select(
        "session_id", "ts", "line_no", F.lit("scroll").alias("kind"), F.col("k").cast("double").alias("x"), F.col("v").cast("double").alias("y"),
        F.lit(0.0).alias("dx"), F.when(F.col("k") % 10 == 0, 0.5).otherwise(1.0).alias("dy"),
    )
    rule = ScrollThrottle(min_gap=6 * HOUR, min_distance=20.0, max_rate=1 / 50000, timeout=10 * DAY)
    return run_batch(rows, rule, pause=10 * DAY)


@query(
    "press_release",
    with_ctes(ACTIONS_SQL)
    + """, b AS (SELECT session_id, ts, line_no, event_type IN ('click', 'error') AS is_press, CASE WHEN k % 3 = 0 THEN 'right' ELSE 'left' END AS button, CAST(k AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y, k % 2 AS monitor
    FROM actions WHERE event_type IN ('click', 'error', 'view')),
n AS (SELECT *, count(*) FILTER (is_press) OVER (PARTITION BY session_id ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING) AS pn FROM b),
p AS (SELECT * FROM n WHERE is_press), r AS (SELECT * FROM n WHERE NOT is_press),
m AS (SELECT p.session_id, p.line_no AS press_line, p.button, p.x, p.y, p.monitor, r.line_no AS release_line, r.x AS rx, r.y AS ry, r.monitor AS rm,
    row_number() OVER (PARTITION BY p.session_id, p.pn ORDER BY r.ts, r.line_no) AS rk FROM p JOIN r ON p.session_id = r.session_id AND p.pn = r.pn AND p.button = r.button)
SELECT session_id, press_line, release_line, concat(CASE WHEN d THEN 'drag_' ELSE 'click_' END, button) AS action, x, y, CASE WHEN d THEN rx END AS end_x, CASE WHEN d THEN ry END AS end_y
FROM (SELECT *, rm = monitor AND sqrt((rx - x) * (rx - x) + (ry - y) * (ry - y)) > 5 AS d FROM m WHERE rk = 1)""",
)
def press_release(spark: SparkSession, folder: str) -> DataFrame:
    return consolidate.press_release(mouse_events(spark, folder))


def mouse_events(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "release").otherwise("press")
    return standins.actions(spark, folder).where(F.col("event_type").isin("click", "error", "view")).select(
        "session_id", "ts", "line_no", kind.alias("kind"), F.when(F.col("k") % 3 == 0, "right").otherwise("left").alias("button"),
        F.col("k").cast("double").alias("x"), F.col("v").cast("double").alias("y"), (F.col("k") % 2).alias("monitor"),
    )


def merge_events(actions: DataFrame) -> DataFrame:
    """Action log as events of the online run merge."""
    action = F.col("action")
    return actions.select(
        "session_id", "ts", "line_no", keys.merge_kind(action).alias("kind"), "action", keys.key_token(action).alias("token"), keys.is_hotkey(action).alias("hotkey")
    )


@query("run_merge_online")
def run_merge_online(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming form of run merging over the whole log; equal to trace_run_merge."""
    return run_batch(merge_events(standins.actions(spark, folder)), RunMerge())
