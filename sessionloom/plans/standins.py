"""Trace tables derived from the star-schema, event and text tables, and the same derivations as SQL.

``*_SQL`` strings are common-table-expression bodies for the DuckDB twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.operators.sequence import SLICE, SessionOrder, order_sessions
from sessionloom.plans.base import table

HOUR = 3600.0


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


ACTIONS_SQL = """
event_rows AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS line_no, epoch_us(ts) / 1e6 AS ts, epoch_us(ts) AS ts_us,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v, event_type, value
  FROM events
),
actions AS (
  SELECT session_id, line_no, ts, ts_us, k, v, event_type, value,
    CASE event_type
      WHEN 'click' THEN concat('click_left(', k, '.0, ', v, '.0)')
      WHEN 'view' THEN concat('scroll(', k % 2, '.0, 1.0, dx=0.00, dy=-1.00)')
      WHEN 'purchase' THEN CASE k % 10 WHEN 0 THEN 'key_press(Key.backspace)' WHEN 1 THEN 'key_press(Key.space)'
                             WHEN 2 THEN 'key_press(Key.shift)' ELSE concat('key_press(''', chr(CAST(97 + k % 26 AS INTEGER)), ''')') END
      WHEN 'signup' THEN CASE k % 4 WHEN 0 THEN 'key_press(Key.enter)' ELSE concat('key_press(''', chr(CAST(97 + k % 26 AS INTEGER)), ''')') END
      ELSE concat('drag_left(', k, '.0, ', v, '.0, ', k + 5, '.0, ', v + 8, '.0)')
    END AS action
  FROM event_rows
)
"""


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("line_no"),
        (micros / F.lit(1e6)).alias("ts"),
        micros.alias("ts_us"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.floor("value").alias("v"),
        "event_type",
        "value",
    )


def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Action log: one recorded input event per row of ``events``."""
    kind, k, v = F.col("event_type"), F.col("k"), F.col("v")
    letter = F.concat(F.lit("key_press('"), F.char(97 + k % 26), F.lit("')"))

    def call(name, *args):
        parts = [F.lit(f"{name}(")]
        for i, arg in enumerate(args):
            parts += [F.lit(", ")] * (i > 0) + [arg.cast("string"), F.lit(".0")]
        return F.concat(*parts, F.lit(")"))

    purchase = (
        F.when(k % 10 == 0, "key_press(Key.backspace)")
        .when(k % 10 == 1, "key_press(Key.space)")
        .when(k % 10 == 2, "key_press(Key.shift)")
        .otherwise(letter)
    )
    action = (
        F.when(kind == "click", call("click_left", k, v))
        .when(kind == "view", F.concat(F.lit("scroll("), (k % 2).cast("string"), F.lit(".0, 1.0, dx=0.00, dy=-1.00)")))
        .when(kind == "purchase", purchase)
        .when(kind == "signup", F.when(k % 4 == 0, "key_press(Key.enter)").otherwise(letter))
        .otherwise(call("drag_left", k, v, k + 5, v + 8))
    )
    return event_rows(spark, folder).withColumn("action", action)


# Screenshot paths: half an hour before and after the event, some of them missing.
SHOT_OFFSET_US = 1_800_000_000

STATES_SQL = """
states AS (
  SELECT *,
    CASE WHEN line_no % 7 = 0 THEN NULL ELSE concat('shots/', (ts_us - 1800000000) // 1000000, '.',
      lpad(CAST((ts_us - 1800000000) % 1000000 AS VARCHAR), 6, '0'), '_', action, '_before.jpg') END AS before,
    CASE WHEN line_no % 7 = 3 OR line_no % 11 = 0 THEN NULL ELSE concat('shots/', (ts_us + 1800000000) // 1000000, '.',
      lpad(CAST((ts_us + 1800000000) % 1000000 AS VARCHAR), 6, '0'), '_', action, '_after.jpg') END AS after
  FROM actions
)
"""


def _shot_path(us, tag):
    seconds = F.floor(us / 1_000_000).cast("string")
    return F.concat(
        F.lit("shots/"), seconds, F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"), F.lit("_"), F.col("action"), F.lit(f"_{tag}.jpg")
    )


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Action log with before/after screenshot paths, some absent."""
    us, line = F.col("ts_us"), F.col("line_no")
    return actions(spark, folder).withColumns(
        {
            "before": F.when(line % 7 != 0, _shot_path(us - SHOT_OFFSET_US, "before")),
            "after": F.when((line % 7 != 3) & (line % 11 != 0), _shot_path(us + SHOT_OFFSET_US, "after")),
        }
    )


def screenshots(spark: SparkSession, folder: str) -> DataFrame:
    """Screenshot listing: the paths of ``states``, one per row."""
    rows = states(spark, folder).select("session_id", F.explode(F.array("before", "after")).alias("path"))
    return rows.where(F.col("path").isNotNull())


STEPS_SQL = """
steps AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, line_no) - 1 AS idx, count(*) OVER (PARTITION BY session_id) AS n,
    concat('a', line_no) AS action_id, concat('App ', event_type) AS app, CASE WHEN k % 5 = 0 THEN '' ELSE concat('panel ', k % 7) END AS entity,
    CASE WHEN k % 3 <> 0 THEN concat('text ', k % 11) END AS ocr
  FROM states
)
"""


def steps(spark: SparkSession, folder: str) -> SessionOrder:
    """Grounded action rows: dense position, application, visible content, screen text, states."""
    k = F.col("k")
    rows = states(spark, folder).withColumns(
        {
            "action_id": F.concat(F.lit("a"), F.col("line_no").cast("string")),
            "app": F.concat(F.lit("App "), "event_type"),
            "entity": F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("panel "), (k % 7).cast("string"))),
            "ocr": F.when(k % 3 != 0, F.concat(F.lit("text "), (k % 11).cast("string"))),
            "state_before": F.col("before"),
            "state_after": F.col("after"),
        }
    )
    return order_sessions(rows, "session_id", ("ts", "line_no")).index("idx")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


SEGMENT_ROWS = 5

SEGMENTS_SQL = """
segments AS (
  SELECT session_id, idx // 5 AS seg_idx, min(idx) AS start_action_idx, max(idx) AS end_action_idx,
    concat('do ', arg_min(event_type, idx)) AS label, concat('k', CAST(sum(k) AS BIGINT)) AS context, arg_min(k, idx) AS k0
  FROM steps GROUP BY session_id, idx // 5
),
merge_ranges AS (
  SELECT session_id, seg_idx AS range_order, seg_idx AS start_idx, seg_idx + 1 + k0 % 2 AS end_idx, concat('merge ', k0) AS label
  FROM (SELECT *, max(seg_idx) OVER (PARTITION BY session_id) AS last_seg FROM segments) WHERE k0 % 3 = 0 AND seg_idx + 1 + k0 % 2 <= last_seg
)
"""


def segments(so: SessionOrder) -> SessionOrder:
    """Candidate segments: five consecutive steps each."""
    idx = F.col("idx")
    extra = [F.min(SLICE).alias(SLICE)] if so.sliced else []
    rows = so.rows.groupBy("session_id", F.floor(idx / SEGMENT_ROWS).alias("seg_idx")).agg(
        F.min(idx).alias("start_action_idx"), F.max(idx).alias("end_action_idx"),
        F.concat(F.lit("do "), F.min_by("event_type", idx)).alias("label"),
        F.concat(F.lit("k"), F.sum("k").cast("string")).alias("context"), F.min_by("k", idx).alias("k0"), *extra,
    )
    return so.derive(rows, order=("seg_idx",))


def merge_ranges(candidates: SessionOrder) -> DataFrame:
    """Merge answers: some segments ask to be joined with the next one or two."""
    rows = candidates.df
    last = rows.groupBy("session_id").agg(F.max("seg_idx").alias("last_seg"))
    end = F.col("seg_idx") + 1 + F.col("k0") % 2
    asked = rows.where(F.col("k0") % 3 == 0).join(last, "session_id").where(end <= F.col("last_seg"))
    return asked.select(
        "session_id", F.col("seg_idx").alias("range_order"), F.col("seg_idx").alias("start_idx"), end.alias("end_idx"),
        F.concat(F.lit("merge "), F.col("k0").cast("string")).alias("label"),
    )


ANSWERS_SQL = """
batches AS (SELECT session_id, idx // 10 AS batch_no, count(*) AS batch_size FROM steps GROUP BY session_id, idx // 10),
answers AS (
  SELECT session_id, idx // 10 AS batch_no, idx % 10 AS range_order, idx % 10 - CASE WHEN k % 19 = 0 THEN 20 ELSE 0 END AS start_idx,
    idx % 10 + k % 4 - CASE WHEN k % 17 = 0 THEN 2 ELSE 0 END AS end_idx, CASE WHEN k % 23 = 0 THEN ' ' ELSE concat('g', k) END AS label
  FROM steps WHERE k % 4 <> 1
)
"""


def answer_batches(so: SessionOrder) -> tuple[DataFrame, DataFrame]:
    """Batches of ten steps and imperfect grouping answers for them."""
    k, place, batch = F.col("k"), F.col("idx") % 10, F.floor(F.col("idx") / 10).alias("batch_no")
    rows = so.df
    batches = rows.groupBy("session_id", batch).agg(F.count(F.lit(1)).alias("batch_size"))
    answers = rows.where(k % 4 != 1).select(
        "session_id", batch, place.alias("range_order"),
        (place - F.when(k % 19 == 0, 20).otherwise(0)).alias("start_idx"),
        (place + k % 4 - F.when(k % 17 == 0, 2).otherwise(0)).alias("end_idx"),
        F.when(k % 23 == 0, " ").otherwise(F.concat(F.lit("g"), k.cast("string"))).alias("label"),
    )
    return batches, answers
