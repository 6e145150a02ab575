"""Queries that exercise the column functions: geometry, text, usage and price."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import cost as cost_fn
from sessionloom.functions import geometry, keys, text, timefn
from sessionloom.operators import boxes, cost
from sessionloom.plans import standins
from sessionloom.plans.base import query, table
from sessionloom.plans.standins import ACTIONS_SQL, with_ctes

# ---- geometry --------------------------------------------------------------------------------


@query(
    "action_points",
    with_ctes(ACTIONS_SQL)
    + """, points AS (
  SELECT session_id, line_no, 'click' AS label, 1 AS pos, CAST(k AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y FROM actions WHERE event_type = 'click'
  UNION ALL SELECT session_id, line_no, 'drag start', 1, k, v FROM actions WHERE event_type = 'error'
  UNION ALL SELECT session_id, line_no, 'drag end', 2, k + 5, v + 8 FROM actions WHERE event_type = 'error')
SELECT session_id, line_no, pos, label, x, y FROM points""",
)
def action_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.actions(spark, folder).select(
        "session_id", "line_no", F.posexplode(geometry.action_points(F.col("action"))).alias("_i", "p")
    )
    return rows.select("session_id", "line_no", (F.col("_i") + 1).alias("pos"), "p.label", "p.x", "p.y")


BOXES_SQL = """
raw_boxes AS (
  SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
    CASE l_linenumber % 3 WHEN 0 THEN l_quantity / 50.0 ELSE l_quantity * 30 END AS rx1,
    CASE l_linenumber % 3 WHEN 0 THEN CAST(0.1 AS DOUBLE) ELSE (l_partkey % 100) * 1e1 END AS ry1,
    CASE l_linenumber % 3 WHEN 0 THEN 5e-1 ELSE (l_suppkey % 100) * 15e0 END AS rx2,
    CASE l_linenumber % 3 WHEN 0 THEN 9e-1 ELSE (l_partkey % 100) * 1e1 + (l_suppkey % 7) * 4e1 END AS ry2
  FROM lineitem
),
scaled AS (
  SELECT *, greatest(abs(rx1), abs(ry1), abs(rx2), abs(ry2)) <= 1.5 AS rel FROM raw_boxes
),
pixel_boxes AS (
  SELECT *, greatest(0.0, least(least(rx1 * sx, rx2 * sx), 1440.0)) AS x1, greatest(0.0, least(greatest(rx1 * sx, rx2 * sx), 1440.0)) AS x2,
    greatest(0.0, least(least(ry1 * sy, ry2 * sy), 900.0)) AS y1, greatest(0.0, least(greatest(ry1 * sy, ry2 * sy), 900.0)) AS y2
  FROM (SELECT *, CASE WHEN rel THEN 1440.0 ELSE 1.0 END AS sx, CASE WHEN rel THEN 900.0 ELSE 1.0 END AS sy FROM scaled)
)
"""


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    relative = F.col("l_linenumber") % 3 == 0
    left, top = F.col("l_quantity"), (F.col("l_partkey") % 100) * 10.0
    raw = geometry.box_struct(
        F.when(relative, left / 50.0).otherwise(left * 30),
        F.when(relative, F.lit(0.1)).otherwise(top),
        F.when(relative, F.lit(0.5)).otherwise((F.col("l_suppkey") % 100) * 15.0),
        F.when(relative, F.lit(0.9)).otherwise(top + (F.col("l_suppkey") % 7) * 40.0),
    )
    rows = table(spark, folder, "lineitem").withColumn("raw", raw)
    return boxes.normalize_boxes(rows, F.col("raw"), 1440, 900)


@query(
    "box_normalize",
    with_ctes(BOXES_SQL)
    + """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2,
  ok AND (x2 - x1) * (y2 - y1) / (1440.0 * 900.0) <= 0.2 AND x2 - x1 <= 0.85 * 1440 AND y2 - y1 <= 0.85 * 900 AS visible
FROM (SELECT *, x2 > x1 AND y2 > y1 AS ok FROM pixel_boxes)""",
)
def box_normalize(spark: SparkSession, folder: str) -> DataFrame:
    visible = F.coalesce(geometry.is_reasonable(F.col("box"), F.lit(1440), F.lit(900)), F.lit(False))
    return _boxes(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", *[F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")], visible.alias("visible")
    )


POINTS_SQL = """
targets AS (
  SELECT o_orderkey, CAST(o_custkey % 1440 AS DOUBLE) AS px, CAST(o_orderkey % 900 AS DOUBLE) AS py FROM orders
),
hits AS (
  SELECT o_orderkey, px, py, x1, y1, x2, y2, row_number() OVER (PARTITION BY o_orderkey
      ORDER BY (x2 - x1) * (y2 - y1), l_linenumber, l_partkey, l_quantity, l_extendedprice) AS rn
  FROM targets JOIN pixel_boxes ON l_orderkey = o_orderkey
  WHERE x2 > x1 AND y2 > y1 AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2
    AND (x2 - x1) * (y2 - y1) / (1440.0 * 900.0) <= 0.2 AND x2 - x1 <= 0.85 * 1440 AND y2 - y1 <= 0.85 * 900
)
"""


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        (F.col("o_custkey") % 1440).cast("double").alias("px"),
        (F.col("o_orderkey") % 900).cast("double").alias("py"),
    )


def _hit(spark: SparkSession, folder: str) -> DataFrame:
    candidates = _boxes(spark, folder).select(
        F.col("l_orderkey").alias("image_id"), "box",
        F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("entry"),
    )
    return boxes.smallest_box(_targets(spark, folder), candidates, "image_id", 1440, 900)


@query(
    "point_in_box",
    with_ctes(BOXES_SQL, POINTS_SQL)
    + """SELECT o_orderkey AS image_id, x1, y1, x2, y2 FROM hits WHERE rn = 1""",
)
def point_in_box(spark: SparkSession, folder: str) -> DataFrame:
    rows = _hit(spark, folder).where(F.col("box").isNotNull())
    return rows.select("image_id", *[F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")])


@query(
    "crop_rect",
    with_ctes(BOXES_SQL, POINTS_SQL)
    + """, sized AS (
  SELECT t.o_orderkey, CASE WHEN rn = 1 THEN (x1 + x2) / 2 ELSE t.px END AS cx, CASE WHEN rn = 1 THEN (y1 + y2) / 2 ELSE t.py END AS cy,
    least(1440, CASE WHEN rn = 1 THEN greatest(320, CAST(round_even(x2 - x1 + 48, 0) AS BIGINT)) ELSE 640 END) AS w,
    least(900, CASE WHEN rn = 1 THEN greatest(220, CAST(round_even(y2 - y1 + 48, 0) AS BIGINT)) ELSE 420 END) AS h
  FROM targets t LEFT JOIN (SELECT * FROM hits WHERE rn = 1) s ON t.o_orderkey = s.o_orderkey),
placed AS (SELECT *, greatest(0, least(CAST(round_even(cx - w / 2.0, 0) AS BIGINT), 1440 - w)) AS left_px,
  greatest(0, least(CAST(round_even(cy - h / 2.0, 0) AS BIGINT), 900 - h)) AS top_px FROM sized)
SELECT o_orderkey AS image_id, left_px, top_px, CAST(left_px + w AS BIGINT) AS right_px, CAST(top_px + h AS BIGINT) AS bottom_px FROM placed""",
)
def crop_rect(spark: SparkSession, folder: str) -> DataFrame:
    rows = _hit(spark, folder).withColumn(
        "crop", geometry.crop_rect(F.col("px"), F.col("py"), F.col("box"), F.lit(1440), F.lit(900))
    )
    names = {"left_px": "x1", "top_px": "y1", "right_px": "x2", "bottom_px": "y2"}
    return rows.select("image_id", *[F.col(f"crop.{src}").cast("bigint").alias(name) for name, src in names.items()])


@query(
    "action_overlays",
    with_ctes(ACTIONS_SQL)
    + """, o AS (
  SELECT session_id, line_no, CASE WHEN event_type = 'error' THEN k - 22 ELSE k - 32 END AS x1, CASE WHEN event_type = 'error' THEN v - 22 ELSE v - 32 END AS y1,
    CASE WHEN event_type = 'error' THEN k + 27 ELSE k + 32 END AS x2, CASE WHEN event_type = 'error' THEN v + 30 ELSE v + 32 END AS y2
  FROM actions WHERE event_type IN ('error', 'click'))
SELECT session_id, line_no, CAST(greatest(0, least(x1, 1439)) AS BIGINT) AS x1, CAST(greatest(0, least(y1, 899)) AS BIGINT) AS y1,
  CAST(least(x2, 1439) AS BIGINT) AS x2, CAST(least(y2, 899) AS BIGINT) AS y2 FROM o""",
)
def action_overlays(spark: SparkSession, folder: str) -> DataFrame:
    w, h = F.lit(1440), F.lit(900)
    p = F.col("p")
    start, end = F.get(p, 0), F.get(p, 1)
    rows = standins.actions(spark, folder).withColumn("p", geometry.action_points(F.col("action"))).where(F.size("p") > 0)
    box = F.when(
        F.size(p) == 2, geometry.drag_overlay(start["x"], start["y"], end["x"], end["y"], w, h)
    ).otherwise(geometry.point_overlay(start["x"], start["y"], w, h))
    rows = rows.withColumn("o", box).where(F.col("o").isNotNull())
    return rows.select("session_id", "line_no", *[F.col(f"o.{c}").cast("bigint").alias(c) for c in ("x1", "y1", "x2", "y2")])


# ---- input text ------------------------------------------------------------------------------


@query(
    "trace_key_text",
    with_ctes(ACTIONS_SQL)
    + """SELECT session_id, line_no,
  CASE WHEN action = 'key_press(Key.space)' THEN ' ' WHEN action = 'key_press(Key.shift)' THEN '' WHEN action = 'key_press(Key.backspace)' THEN 'Key.backspace'
    WHEN action = 'key_press(Key.enter)' THEN 'Key.enter+' ELSE substr(action, 12, 1) END AS token,
  CASE WHEN action IN ('key_press(Key.space)', 'key_press(Key.backspace)') THEN ' ' WHEN action = 'key_press(Key.shift)' THEN ''
    WHEN action = 'key_press(Key.enter)' THEN chr(10) ELSE substr(action, 12, 1) END AS typed
FROM actions WHERE contains(action, 'press')""",
)
def trace_key_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.actions(spark, folder).where(keys.is_key(F.col("action")))
    return rows.select("session_id", "line_no", keys.key_token(F.col("action")).alias("token"), keys.typed_text(F.col("action")).alias("typed"))


@query(
    "event_texts",
    with_ctes(ACTIONS_SQL)
    + """SELECT session_id, line_no, CASE WHEN event_type = 'view' THEN printf('scroll(%.1f, %.1f, dx=%.2f, dy=%.2f)', k * 1.0, v * 1.0, 0.0, k / 4.0)
  WHEN event_type = 'error' THEN printf('drag_left(start_x=%.1f, start_y=%.1f, end_x=%.1f, end_y=%.1f)', k * 1.0, v * 1.0, k + 5.0, v + 8.0)
  WHEN event_type = 'click' THEN printf('click_left(%.1f, %.1f)', k * 1.0, v * 1.0) ELSE concat('key_press(', k, ')') END AS content FROM actions""",
)
def event_texts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "scroll").when(F.col("event_type") == "error", "drag_left").when(
        F.col("event_type") == "click", "click_left"
    ).otherwise("key_press")
    k, v = F.col("k").cast("double"), F.col("v").cast("double")
    content = keys.event_text(kind, k, v, F.lit(0.0), k / 4, k + 5, v + 8, F.col("k").cast("string"))
    return standins.event_rows(spark, folder).select("session_id", "line_no", content.alias("content"))


@query(
    "duration_texts",
    """WITH t AS (SELECT o_orderkey, CAST(round_even(o_totalprice / 10, 0) AS BIGINT) AS s, CAST(trunc(o_totalprice / 10) AS BIGINT) AS c FROM orders)
SELECT o_orderkey, CASE WHEN s // 3600 > 0 THEN concat(s // 3600, 'h ', s % 3600 // 60, 'm') WHEN s // 60 > 0 THEN concat(s // 60, 'm ', s % 60, 's')
  ELSE concat(s, 's') END AS short_text,
  CASE WHEN c // 3600 > 0 THEN printf('%d:%02d:%02d', c // 3600, c % 3600 // 60, c % 60) ELSE printf('%02d:%02d', c // 60, c % 60) END AS clock FROM t""",
)
def duration_texts(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.col("o_totalprice") / 10
    return table(spark, folder, "orders").select(
        "o_orderkey", timefn.duration_text(seconds).alias("short_text"), timefn.clock_text(seconds).alias("clock")
    )


# ---- text ------------------------------------------------------------------------------------


@query(
    "text_limits",
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, trim(replace(text, chr(10), ' ')) AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) <= 180 THEN line ELSE concat(substr(line, 1, 177), '...') END AS truncated,
  CASE WHEN length(t) <= 160 THEN t ELSE concat(rtrim(substr(t, 1, 157)), '...') END AS clipped,
  md5(lower(t)) AS normalized_md5,
  CASE WHEN length(s) <= 320 THEN s ELSE concat(substr(s, 1, 317), '...') END AS two_sentences,
  coalesce(nullif(substr(trim(regexp_replace(lower(t), '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 80), ''), 'session') AS slug
FROM (SELECT *, regexp_extract(t, '^(?:.*?[.!?] .*?[.!?]) |^(.*)$') AS r,
        CASE WHEN regexp_matches(t, '^.*?[.!?] .*?[.!?] ') THEN rtrim(regexp_extract(t, '^.*?[.!?] .*?[.!?] ')) ELSE t END AS s FROM c)""",
)
def text_limits(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id",
        text.truncate(t).alias("truncated"),
        text.clip(t, 160).alias("clipped"),
        F.md5(text.normalize(t)).alias("normalized_md5"),
        text.limit_sentences(t, 2, 320).alias("two_sentences"),
        text.slug(text.collapse(t), F.lit("session")).alias("slug"),
    )


@query("anchors")
def anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Anchor, deliverable and success wording for each document read as an activity."""
    entities = F.array(F.concat(F.col("source"), F.lit(" menu")), F.concat(F.col("source"), F.lit("/"), F.col("lang")), F.col("lang"))
    t = F.col("text")
    found = text.infer_anchors(t, F.lit(""), entities, F.array().cast("array<string>"), 5)
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(found, " | ").alias("anchors"),
        text.deliverable(entities, t).alias("deliverable"),
        text.success_criterion(entities, t, F.array(t)).alias("criterion"),
    )


# ---- usage and price -------------------------------------------------------------------------

LEDGER_SQL = """
ledger AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS session_id, l_returnflag AS operation, l_linestatus AS stage,
    l_orderkey * 1000 + l_linenumber AS call_id, l_partkey,
    CASE l_linenumber % 4 WHEN 0 THEN 'openai/gpt-5.4' WHEN 1 THEN 'gpt-5.5-mini' WHEN 2 THEN 'openai:GPT-5-4' ELSE 'other/gpt-5.4' END AS model_name,
    CAST(l_partkey * 1000 AS BIGINT) AS input_tokens, CAST(l_suppkey * 500 AS BIGINT) AS cache_read_tokens, CAST(l_quantity * 100 AS BIGINT) AS output_tokens
  FROM lineitem
),
priced AS (
  SELECT *, CASE l_linenumber % 4 WHEN 1 THEN 2.0 WHEN 3 THEN NULL ELSE 1.0 END * CASE WHEN input_tokens > 272000
      THEN (input_tokens - c) * 5.0 + c * 0.5 + output_tokens * 22.5 ELSE (input_tokens - c) * 2.5 + c * 0.25 + output_tokens * 15.0 END / 1000000.0 AS price_usd
  FROM (SELECT *, least(cache_read_tokens, input_tokens) AS c, call_id % 1000 AS l_linenumber FROM ledger)
)
"""


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Call ledger: one model call per line item."""
    number = F.col("l_linenumber") % 4
    model = F.when(number == 0, "openai/gpt-5.4").when(number == 1, "gpt-5.5-mini").when(number == 2, "openai:GPT-5-4").otherwise("other/gpt-5.4")
    calls = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("session_id"),
        F.col("l_returnflag").alias("operation"),
        F.col("l_linestatus").alias("stage"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("call_id"),
        "l_partkey",
        model.alias("model_name"),
        (F.col("l_partkey") * 1000).alias("input_tokens"),
        (F.col("l_suppkey") * 500).alias("cache_read_tokens"),
        (F.col("l_quantity") * 100).cast("bigint").alias("output_tokens"),
    )
    return calls.withColumn("_m", cost_fn.split_provider(F.col("model_name"))).select("*", "_m.*").drop("_m")


@query(
    "usage_cost",
    with_ctes(LEDGER_SQL)
    + """SELECT call_id, l_partkey, input_tokens, output_tokens, CASE WHEN call_id % 1000 % 4 = 1 THEN 'gpt-5.5-mini' WHEN call_id % 1000 % 4 = 2 THEN 'GPT-5-4' ELSE 'gpt-5.4' END AS model_ref,
  round(CAST(price_usd AS DOUBLE), 6) AS price_usd FROM priced""",
)
def usage_cost(spark: SparkSession, folder: str) -> DataFrame:
    priced = cost_fn.with_price(ledger(spark, folder))
    return priced.select("call_id", "l_partkey", "input_tokens", "output_tokens", "model_ref", F.round("price_usd", 6).alias("price_usd"))


@query(
    "usage_totals",
    with_ctes(LEDGER_SQL)
    + """, sums AS (
  SELECT CASE WHEN grouping(operation) = 0 THEN 'operation' WHEN grouping(stage) = 0 THEN 'stage' ELSE 'total' END AS grain,
    session_id, stage, operation, count(*) AS llm_requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
    round(CAST(sum(CAST(price_usd AS DECIMAL(28, 12))) AS DOUBLE), 6) AS estimated_usd,
    arg_min(model_name, call_id * 100000000 + l_partkey) AS m
  FROM priced GROUP BY GROUPING SETS ((session_id, stage, operation), (session_id, stage), ()))
SELECT grain, session_id, stage, operation, CASE WHEN grain = 'operation' THEN m END AS model, llm_requests, input_tokens, output_tokens, total_tokens, cache_read_tokens, estimated_usd FROM sums""",
)
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    calls = cost_fn.with_price(ledger(spark, folder), name="estimated_usd").withColumns(
        {
            "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
            "model": F.col("model_name"),
            "call_id": F.struct("call_id", "l_partkey"),
        }
    )
    out = cost.cost_breakdown(calls)
    return out.withColumn("estimated_usd", F.round("estimated_usd", 6))


@query(
    "cost_sections",
    with_ctes(LEDGER_SQL)
    + """SELECT session_id, round(CAST(coalesce(sum(u) FILTER (operation = 'R'), 0) AS DOUBLE), 6) AS ocr_usd, count(*) FILTER (operation = 'R') AS ocr_items,
  round(CAST(coalesce(sum(u) FILTER (operation = 'N'), 0) AS DOUBLE), 6) AS grounding_usd, count(*) FILTER (operation = 'N') AS grounding_items,
  round(CAST(coalesce(sum(u), 0) AS DOUBLE), 6) AS total_usd
FROM (SELECT *, CAST(coalesce(price_usd, 0) AS DECIMAL(28, 12)) AS u FROM priced) WHERE operation IN ('R', 'N') GROUP BY session_id""",
)
def cost_sections(spark: SparkSession, folder: str) -> DataFrame:
    section = F.when(F.col("operation") == "R", "ocr").when(F.col("operation") == "N", "grounding")
    items = cost_fn.with_price(ledger(spark, folder)).select(
        "session_id", section.alias("section"), F.coalesce("price_usd", F.lit(0.0)).alias("usd"), F.lit(1).alias("requests")
    )
    out = cost.cost_sections(items.where(F.col("section").isNotNull()), ["session_id"])
    return out.select(
        "session_id", F.round("ocr_usd", 6).alias("ocr_usd"), "ocr_items", F.round("grounding_usd", 6).alias("grounding_usd"), "grounding_items",
        F.round("total_usd", 6).alias("total_usd"),
    )


@query(
    "call_usage",
    """SELECT event_id, k AS input_tokens, 10 AS output_tokens, k + 10 AS total_tokens, least(k, 40) AS cache_read_tokens FROM
  (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""".replace("10 AS output", "CAST(10 AS BIGINT) AS output").replace(
        "least(k, 40)", "CASE WHEN k > 0 THEN least(k, 40) ELSE 40 END"
    ),
)
def call_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Usage objects with alternative key names, as a provider would return them."""
    k = F.get_json_object("props", "$.k")
    payload = F.concat(F.lit('{"prompt_tokens": '), k, F.lit(', "completion_tokens": 10.7, "prompt_tokens_details": {"cached_tokens": 40}}'))
    usage = cost_fn.normalize_usage(F.try_parse_json(payload))
    return table(spark, folder, "events").select("event_id", usage.alias("u")).select("event_id", "u.*")
