"""Queries over segments: windows, merging, answer checks, roll-ups, cache checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators import segments, windows
from sessionloom.plans import standins
from sessionloom.plans.base import query
from sessionloom.plans.standins import ACTIONS_SQL, ANSWERS_SQL, SEGMENTS_SQL, STATES_SQL, STEPS_SQL, with_ctes

BASE = (ACTIONS_SQL, STATES_SQL, STEPS_SQL)
SESSION = "session_id"

# ---- windows: 12 rows, overlap 5, so cores lose 2 on the left and 3 on the right ---------------

WINDOWS_SQL = """
w0 AS (
  SELECT session_id, n, unnest(range(0, CASE WHEN n <= 12 THEN 1 ELSE CAST(ceil((n - 12) / 7.0) AS BIGINT) + 1 END)) AS window_no
  FROM (SELECT DISTINCT session_id, n FROM steps)
),
w1 AS (SELECT *, window_no * 7 AS window_start, least(n, window_no * 7 + 12) AS window_end FROM w0),
windows AS (
  SELECT *, CASE WHEN window_no = 0 THEN 0 ELSE window_start + 2 END AS core_start, CASE WHEN window_end = n THEN n ELSE window_end - 3 END AS core_end FROM w1
)
"""


@query(
    "count_windows",
    with_ctes(*BASE, WINDOWS_SQL)
    + "SELECT session_id, window_no, window_start, window_end, core_start, core_end FROM windows WHERE core_start < core_end",
)
def count_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.event_rows(spark, folder)
    out = windows.count_windows(standins.totals(rows), 12, 5)
    return out.select(SESSION, "window_no", "window_start", "window_end", "core_start", "core_end")


@query(
    "window_rows",
    with_ctes(*BASE, WINDOWS_SQL)
    + """SELECT s.session_id, idx, window_no, idx >= core_start AND idx < core_end AS in_core FROM steps s JOIN windows w
ON s.session_id = w.session_id AND idx >= window_start AND idx < window_end""",
)
def window_rows(spark: SparkSession, folder: str) -> DataFrame:
    counted = standins.steps(spark, folder).totals(n=("sum", F.lit(1).cast("bigint"))).df
    return windows.assign_windows(counted, 12, 5).select(SESSION, "idx", "window_no", "in_core")


@query(
    "window_stitch",
    with_ctes(*BASE, WINDOWS_SQL)
    + """, groups AS (SELECT session_id, window_no, g * 4 AS s, least(g * 4 + 3, window_end - window_start - 1) AS e
    FROM (SELECT *, unnest(range(0, CAST(ceil((window_end - window_start) / 4.0) AS BIGINT))) AS g FROM windows WHERE core_start < core_end AND window_no % 3 <> 1)),
clipped AS (SELECT w.session_id, w.window_no, CASE WHEN s IS NULL THEN core_start ELSE greatest(window_start + s, core_start) END AS start_action_idx,
    CASE WHEN s IS NULL THEN core_end - 1 ELSE least(window_start + e, core_end - 1) END AS end_action_idx
  FROM windows w LEFT JOIN groups g ON w.session_id = g.session_id AND w.window_no = g.window_no WHERE core_start < core_end)
SELECT * FROM clipped WHERE start_action_idx <= end_action_idx""",
)
def window_stitch(spark: SparkSession, folder: str) -> DataFrame:
    """Every third window has no answer; the others are cut into fours."""
    table = windows.count_windows(standins.totals(standins.event_rows(spark, folder)), 12, 5)
    width = F.col("window_end") - F.col("window_start")
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(width / 4) - 1)).alias("g")
    answered = table.where(F.col("window_no") % 3 != 1).select(SESSION, "window_no", width.alias("width"), part)
    groups = answered.select(
        SESSION, "window_no", (F.col("g") * 4).alias("start_idx"), F.least(F.col("g") * 4 + 3, F.col("width") - 1).alias("end_idx"), F.lit("").alias("label")
    )
    return windows.stitch_windows(table, groups).drop("label")


@query(
    "merge_batch_counts",
    """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n FROM events GROUP BY user_id),
b AS (SELECT *, CASE WHEN n <= 1 THEN 0 WHEN n <= 16 THEN 1 ELSE CAST(ceil((n - 16) / 14.0) AS BIGINT) + 1 END AS c FROM t)
SELECT session_id, n, CAST(c AS BIGINT) AS semantic_batches, CAST(CASE WHEN c > 0 AND n - (c - 1) * 14 <= 1 THEN c - 1 ELSE c END AS BIGINT) AS activity_batches FROM b""",
)
def merge_batch_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.totals(standins.event_rows(spark, folder))
    return rows.select(
        SESSION, "n",
        windows.expected_merge_batches(F.col("n"), 16, 2, skip_single=False).alias("semantic_batches"),
        windows.expected_merge_batches(F.col("n"), 16, 2, skip_single=True).alias("activity_batches"),
    )


@query(
    "context_windows",
    with_ctes(*BASE, SEGMENTS_SQL)
    + """SELECT b.session_id, b.batch_no, b.n_segments, coalesce(c.n_context, 0) AS n_context, coalesce(c.context, 'Start of session.') AS context FROM
  (SELECT session_id, seg_idx // 4 AS batch_no, count(*) AS n_segments FROM segments GROUP BY ALL) b LEFT JOIN
  (SELECT x.session_id, x.batch_no, count(*) AS n_context, string_agg(concat('- ', label), chr(10) ORDER BY seg_idx) AS context
   FROM (SELECT DISTINCT session_id, seg_idx // 4 AS batch_no FROM segments) x JOIN segments s
     ON s.session_id = x.session_id AND s.seg_idx < x.batch_no * 4 AND s.seg_idx >= x.batch_no * 4 - 6 GROUP BY ALL) c
  ON b.session_id = c.session_id AND b.batch_no = c.batch_no""",
)
def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.segments(standins.steps(spark, folder)).df
    return windows.prior_context(rows, batch_size=4, keep=6)


# ---- merging ---------------------------------------------------------------------------------

GROUPS_SQL = """
marks AS (SELECT DISTINCT session_id, unnest(range(start_idx + 1, end_idx + 1)) AS seg_idx FROM merge_ranges WHERE start_idx < end_idx),
members AS (
  SELECT s.*, sum(CASE WHEN m.seg_idx IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.session_id ORDER BY s.seg_idx ROWS UNBOUNDED PRECEDING) AS group_no
  FROM segments s LEFT JOIN marks m ON s.session_id = m.session_id AND s.seg_idx = m.seg_idx
),
grouped AS (
  SELECT session_id, CAST(group_no AS BIGINT) AS group_no, min(seg_idx) AS first_idx, max(seg_idx) AS last_idx, min(start_action_idx) AS start_action_idx,
    max(end_action_idx) AS end_action_idx, arg_max(label, seg_idx) AS last_label, string_agg(context, ' ' ORDER BY seg_idx) AS context
  FROM members GROUP BY session_id, group_no
),
labelled AS (
  SELECT g.session_id, g.group_no, arg_min(r.label, (CASE WHEN r.start_idx = first_idx AND r.end_idx = last_idx THEN 0 ELSE 1000000 END)
      + (1000 - (r.end_idx - r.start_idx)) * 1000 + range_order) AS label
  FROM grouped g JOIN merge_ranges r ON g.session_id = r.session_id AND r.start_idx >= first_idx AND r.end_idx <= last_idx GROUP BY ALL
)
"""


@query(
    "merge_boundaries",
    with_ctes(*BASE, SEGMENTS_SQL, GROUPS_SQL) + "SELECT session_id, seg_idx, CAST(group_no AS BIGINT) AS group_no FROM members",
)
def merge_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    candidates = standins.segments(standins.steps(spark, folder))
    return segments.merge_groups(candidates, standins.merge_ranges(candidates)).df.select(SESSION, "seg_idx", "group_no")


@query(
    "merge_labels",
    with_ctes(*BASE, SEGMENTS_SQL, GROUPS_SQL)
    + """SELECT g.session_id, g.group_no, first_idx, last_idx, start_action_idx, end_action_idx, coalesce(l.label, last_label) AS label, context
FROM grouped g LEFT JOIN labelled l ON g.session_id = l.session_id AND g.group_no = l.group_no""",
)
def merge_labels(spark: SparkSession, folder: str) -> DataFrame:
    candidates = standins.segments(standins.steps(spark, folder))
    ranges = standins.merge_ranges(candidates)
    members = segments.merge_groups(candidates, ranges)
    groups = members.rows.groupBy(SESSION, "group_no").agg(F.min("seg_idx").alias("first_idx"), F.max("seg_idx").alias("last_idx"))
    labels = segments.group_labels(groups, ranges, members.df)
    return segments.collapse_groups(members, labels)


# ---- roll-ups --------------------------------------------------------------------------------


def _segment_rows(spark: SparkSession, folder: str) -> DataFrame:
    return standins.steps(spark, folder).df.withColumn("seg_idx", F.floor(F.col("idx") / standins.SEGMENT_ROWS))


DISTINCT_SQL = """
seen AS (
  SELECT session_id, idx // 5 AS seg_idx, kind, val, min(idx) AS first_at FROM (
    SELECT session_id, idx, 'app' AS kind, app AS val FROM steps UNION ALL SELECT session_id, idx, 'entity', entity FROM steps
    UNION ALL SELECT session_id, idx, 'ocr', ocr FROM steps UNION ALL SELECT session_id, idx, 'id', action_id FROM steps)
  WHERE val <> '' GROUP BY ALL
),
lists AS (
  SELECT session_id, seg_idx, string_agg(val, '|' ORDER BY first_at) FILTER (kind = 'app') AS apps, coalesce(string_agg(val, '|' ORDER BY first_at) FILTER (kind = 'entity'), '') AS entities,
    coalesce(string_agg(val, '|' ORDER BY first_at) FILTER (kind = 'ocr'), '') AS ocr_texts, string_agg(val, '|' ORDER BY first_at) FILTER (kind = 'id') AS raw_action_ids
  FROM seen GROUP BY ALL
)
"""


@query(
    "segment_rollup",
    with_ctes(*BASE, DISTINCT_SQL)
    + """SELECT s.*, apps, entities, ocr_texts, raw_action_ids FROM (
  SELECT session_id, idx // 5 AS seg_idx, min(idx) AS start_action_idx, max(idx) AS end_action_idx, arg_min(action_id, idx) AS start_action_id, arg_max(action_id, idx) AS end_action_id,
    coalesce(arg_min(before, idx) FILTER (before <> ''), '') AS pre_state, coalesce(arg_max(after, idx) FILTER (after <> ''), '') AS post_state, count(*) AS event_count
  FROM steps GROUP BY ALL) s JOIN lists l ON s.session_id = l.session_id AND s.seg_idx = l.seg_idx""",
)
def segment_rollup(spark: SparkSession, folder: str) -> DataFrame:
    out = segments.roll_up(_segment_rows(spark, folder), [SESSION, "seg_idx"])
    lists = {"raw_action_ids": "raw_action_ids", "apps": "apps_used", "entities": "entities", "ocr_texts": "ocr_texts"}
    return out.select(
        SESSION, "seg_idx", "start_action_idx", "end_action_idx", "start_action_id", "end_action_id",
        *[F.array_join(src, "|").alias(name) for name, src in lists.items()], "pre_state", "post_state", "event_count",
    )


@query(
    "ordered_distinct",
    with_ctes(*BASE) + "SELECT session_id, entity AS value, min(idx) AS first_at FROM steps WHERE entity <> '' GROUP BY ALL",
)
def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return segments.first_seen(standins.steps(spark, folder).df, [SESSION], F.col("entity"), "idx")


@query(
    "sequence_context",
    with_ctes(*BASE)
    + """SELECT session_id, idx // 5 AS seg_idx, coalesce(string_agg(CASE WHEN action IN ('key_press(Key.space)', 'key_press(Key.backspace)') THEN ' ' WHEN action = 'key_press(Key.enter)' THEN chr(10)
    WHEN contains(action, 'Key.') THEN '' ELSE substr(action, 12, 1) END, '' ORDER BY idx) FILTER (starts_with(action, 'key_press(')), '') AS typed,
  count(DISTINCT app) AS n_apps, count(*) AS n_actions FROM steps GROUP BY ALL""",
)
def sequence_context(spark: SparkSession, folder: str) -> DataFrame:
    from sessionloom.functions import keys

    rows = _segment_rows(spark, folder).withColumn("typed", keys.typed_text(F.col("action")))
    return rows.groupBy(SESSION, "seg_idx").agg(
        F.array_join(text.ordered_collect("idx", "typed"), "").alias("typed"),
        F.count_distinct("app").alias("n_apps"),
        F.count(F.lit(1)).alias("n_actions"),
    )


@query(
    "segment_range_join",
    with_ctes(*BASE, SEGMENTS_SQL, GROUPS_SQL)
    + """SELECT g.session_id, g.group_no, s.idx, s.action_id FROM grouped g JOIN steps s ON g.session_id = s.session_id AND s.idx BETWEEN start_action_idx AND end_action_idx""",
)
def segment_range_join(spark: SparkSession, folder: str) -> DataFrame:
    so = standins.steps(spark, folder)
    candidates = standins.segments(so)
    members = segments.merge_groups(candidates, standins.merge_ranges(candidates))
    bounds = members.rows.groupBy(SESSION, "group_no").agg(F.min("start_action_idx").alias("start_idx"), F.max("end_action_idx").alias("end_idx"))
    return segments.rows_of_segments(bounds, so.df.select(SESSION, "idx", "action_id")).select(SESSION, "group_no", "idx", "action_id")


# ---- answer checks ---------------------------------------------------------------------------

REPORT_SQL = """
checked AS (
  SELECT a.*, b.batch_size, start_idx < 0 OR end_idx < 0 OR start_idx >= batch_size OR end_idx >= batch_size AS outside
  FROM answers a JOIN batches b ON a.session_id = b.session_id AND a.batch_no = b.batch_no
),
counts AS (
  SELECT session_id, batch_no, count(*) AS n_ranges, count(*) FILTER (outside) AS out_of_range,
    count(*) FILTER (NOT outside AND end_idx - start_idx + 1 < {w}) AS bad_width,
    count(*) FILTER (NOT outside AND end_idx - start_idx + 1 >= {w} AND trim(label) = '') AS missing_text FROM checked GROUP BY ALL
),
places AS (
  SELECT session_id, batch_no, count(*) AS covered, count(*) FILTER (t > 1) AS overlapping FROM (
    SELECT session_id, batch_no, p, count(*) AS t FROM (SELECT session_id, batch_no, unnest(range(start_idx, end_idx + 1)) AS p FROM checked
      WHERE NOT outside AND end_idx - start_idx + 1 >= {w}) GROUP BY ALL) GROUP BY ALL
),
report AS (
  SELECT b.session_id, b.batch_no, b.batch_size, coalesce(n_ranges, 0) AS n_ranges, coalesce(out_of_range, 0) AS out_of_range, coalesce(bad_width, 0) AS bad_width,
    coalesce(missing_text, 0) AS missing_text, coalesce(overlapping, 0) AS overlapping, b.batch_size - coalesce(covered, 0) AS missing
  FROM batches b LEFT JOIN counts c ON b.session_id = c.session_id AND b.batch_no = c.batch_no LEFT JOIN places p ON b.session_id = p.session_id AND b.batch_no = p.batch_no
)
"""


@query(
    "group_check",
    with_ctes(*BASE, ANSWERS_SQL, REPORT_SQL.format(w=1))
    + "SELECT *, out_of_range = 0 AND bad_width = 0 AND overlapping = 0 AND missing = 0 AND n_ranges > 0 AND missing_text = 0 AS valid FROM report",
)
def group_check(spark: SparkSession, folder: str) -> DataFrame:
    batches, answers = standins.answer_batches(standins.steps(spark, folder))
    return segments.check_groups(answers, batches, needs_text=True)


@query(
    "merge_check",
    with_ctes(*BASE, ANSWERS_SQL, REPORT_SQL.format(w=2))
    + "SELECT * EXCLUDE (missing), CAST(0 AS BIGINT) AS missing, out_of_range = 0 AND bad_width = 0 AND overlapping = 0 AS valid FROM report",
)
def merge_check(spark: SparkSession, folder: str) -> DataFrame:
    batches, answers = standins.answer_batches(standins.steps(spark, folder))
    return segments.check_merges(answers, batches)


@query(
    "merge_repair",
    with_ctes(*BASE, ANSWERS_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, usable AS (SELECT a.*, row_number() OVER (PARTITION BY a.session_id, a.batch_no ORDER BY start_idx, range_order) AS ord
  FROM answers a JOIN batches b ON a.session_id = b.session_id AND a.batch_no = b.batch_no WHERE start_idx >= 0 AND end_idx < batch_size AND start_idx < end_idx),
next_of AS (SELECT u.session_id, u.batch_no, u.ord, min(x.ord) AS nxt FROM usable u JOIN usable x
  ON u.session_id = x.session_id AND u.batch_no = x.batch_no AND x.ord > u.ord AND x.start_idx > u.end_idx GROUP BY ALL),
chain AS (SELECT session_id, batch_no, ord FROM usable WHERE ord = 1 UNION ALL
  SELECT n.session_id, n.batch_no, n.nxt FROM chain c JOIN next_of n ON c.session_id = n.session_id AND c.batch_no = n.batch_no AND c.ord = n.ord)
SELECT u.session_id, u.batch_no, start_idx, end_idx, label FROM usable u JOIN chain c ON u.session_id = c.session_id AND u.batch_no = c.batch_no AND u.ord = c.ord""",
)
def merge_repair(spark: SparkSession, folder: str) -> DataFrame:
    batches, answers = standins.answer_batches(standins.steps(spark, folder))
    return segments.repair_merges(answers, batches)


@query(
    "group_repair",
    with_ctes(*BASE, ANSWERS_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, clamped AS (SELECT a.session_id, a.batch_no, b.batch_size, a.label, greatest(0, least(batch_size - 1, start_idx)) AS s, end_idx,
    row_number() OVER (PARTITION BY a.session_id, a.batch_no ORDER BY start_idx, range_order) AS ord
  FROM answers a JOIN batches b ON a.session_id = b.session_id AND a.batch_no = b.batch_no),
usable AS (SELECT *, greatest(s, least(batch_size - 1, end_idx)) AS e FROM clamped),
next_of AS (SELECT u.session_id, u.batch_no, u.ord, min(x.ord) AS nxt FROM usable u JOIN usable x
  ON u.session_id = x.session_id AND u.batch_no = x.batch_no AND x.ord > u.ord AND x.s > u.e GROUP BY ALL),
chain AS (SELECT session_id, batch_no, ord FROM usable WHERE ord = 1 UNION ALL
  SELECT n.session_id, n.batch_no, n.nxt FROM chain c JOIN next_of n ON c.session_id = n.session_id AND c.batch_no = n.batch_no AND c.ord = n.ord),
kept AS (SELECT u.session_id, u.batch_no, s, e, label FROM usable u JOIN chain c ON u.session_id = c.session_id AND u.batch_no = c.batch_no AND u.ord = c.ord),
places AS (SELECT session_id, batch_no, unnest(range(0, batch_size)) AS p FROM batches)
SELECT session_id, batch_no, s AS start_idx, e AS end_idx, label FROM kept
UNION ALL SELECT p.session_id, p.batch_no, p, p, '' FROM places p LEFT JOIN kept k ON p.session_id = k.session_id AND p.batch_no = k.batch_no AND p BETWEEN s AND e WHERE s IS NULL""",
)
def group_repair(spark: SparkSession, folder: str) -> DataFrame:
    batches, answers = standins.answer_batches(standins.steps(spark, folder))
    return segments.repair_groups(answers, batches)


# ---- fingerprints and caches -----------------------------------------------------------------

PRINT_SQL = """
l0 AS (SELECT session_id, idx AS i, sha256(concat('{"idx":', idx, ',"action_id":"', action_id, '","app":"', app, '","entity":"', entity, '","ocr":',
    CASE WHEN ocr IS NULL THEN 'null' ELSE concat('"', ocr, '"') END, '}')) AS d FROM steps),
l1 AS (SELECT session_id, i // 1024 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM l0 GROUP BY session_id, i // 1024),
l2 AS (SELECT session_id, i // 1024 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM l1 GROUP BY session_id, i // 1024),
l3 AS (SELECT session_id, i // 1024 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM l2 GROUP BY session_id, i // 1024),
prints AS (SELECT session_id, sha256(string_agg(d, '' ORDER BY i)) AS input_fingerprint FROM l3 GROUP BY session_id, i // 1024)
"""

PRINT_FIELDS = ["idx", "action_id", "app", "entity", "ocr"]


@query("input_fingerprint", with_ctes(*BASE, PRINT_SQL) + "SELECT * FROM prints")
def input_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return segments.fingerprint(standins.steps(spark, folder).df, PRINT_FIELDS)


@query(
    "cache_rehydrate",
    with_ctes(*BASE, SEGMENTS_SQL)
    + """, bad AS (SELECT DISTINCT session_id FROM segments WHERE k0 = 13 AND seg_idx = 3 UNION SELECT session_id FROM segments WHERE k0 % 50 = 7 AND seg_idx = 2)
SELECT s.session_id, CAST(s.session_id AS BIGINT) % 9 <> 0 AND b.session_id IS NULL AS reusable FROM (SELECT DISTINCT session_id FROM steps) s LEFT JOIN bad b ON s.session_id = b.session_id""",
)
def cache_rehydrate(spark: SparkSession, folder: str) -> DataFrame:
    """Stored segments, some with a shifted border or a wrong border id, and some with a stale fingerprint."""
    so = standins.steps(spark, folder)
    current = standins.totals(so.df).withColumnRenamed("n", "n_rows").join(segments.fingerprint(so.df, PRINT_FIELDS), SESSION)
    stale = F.col(SESSION).cast("bigint") % 9 == 0
    stored_meta = current.withColumn("input_fingerprint", F.when(stale, "old").otherwise(F.col("input_fingerprint")))
    cached = standins.segments(so)
    shifted = (F.col("k0") == 13) & (F.col("seg_idx") == 3)
    renamed = (F.col("k0") % 50 == 7) & (F.col("seg_idx") == 2)
    cached = cached.with_columns(
        {
            "segment_id": F.format_string("semantic_action_%04d", F.col("seg_idx")),
            "start_idx": F.col("start_action_idx") + F.when(shifted, 1).otherwise(0),
            "end_idx": F.col("end_action_idx"),
            "start_id": F.when(renamed, "someone else"),
            "end_id": F.lit(""),
        }
    )
    return segments.cache_verdict(cached, so.df.select(SESSION, "idx", "action_id"), stored_meta, current)
