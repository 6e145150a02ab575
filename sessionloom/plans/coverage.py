"""Queries over small operators: costs, overrides, answer checks, stored files, screen geometry, report wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import provider
from sessionloom.functions import cost as cost_fn
from sessionloom.functions import geometry, text, timefn
from sessionloom.operators import cost, evidence, normalize, report, resume, rules, threads
from sessionloom.plans import models, standins
from sessionloom.plans.base import ORACLES, query, table
from sessionloom.plans.models import FINDING, TREE_SQL
from sessionloom.plans.standins import ACTIONS_SQL, STATES_SQL, with_ctes
from sessionloom.plans.values import LEDGER_SQL, ledger
from sessionloom.sources import logs

SESSION, ROOT = "session_id", "canonical_root_id"


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumns({"k": F.col("o_orderkey"), "id": F.col("o_orderkey").cast("string"), SESSION: F.col("o_custkey").cast("string")})


# ---- costs -----------------------------------------------------------------------------------


@query(
    "effective_costs",
    """WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 0.0 ELSE o_totalprice END AS r, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0.0 ELSE 2.0 END AS c,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 3.0 END AS p, o_orderkey % 7 <> 0 AS t FROM orders)
SELECT CAST(k AS VARCHAR) AS id, CAST(CASE WHEN r > 0 OR (r IS NOT NULL AND NOT t) THEN r WHEN c > 0 OR (c IS NOT NULL AND NOT t) THEN c ELSE coalesce(p, 0) END AS DOUBLE) AS usd,
  CASE WHEN r > 0 OR (r IS NOT NULL AND NOT t) THEN 'reported' WHEN c > 0 OR (c IS NOT NULL AND NOT t) THEN 'computed' WHEN p IS NOT NULL THEN 'price_table' WHEN t THEN 'usage_no_price' ELSE 'none' END AS source FROM n""",
)
def effective_costs(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    number = lambda v: F.lit(v).cast("double")
    reported = F.when(k % 3 == 1, number(0)).when(k % 3 == 2, F.col("o_totalprice").cast("double"))
    computed = F.when(k % 4 == 1, number(0)).when(k % 4 > 1, number(2))
    out = _orders(spark, folder).withColumn("c", cost_fn.effective_cost(reported, computed, F.when(k % 5 != 0, number(3)), k % 7 != 0))
    return out.select("id", "c.usd", F.coalesce("c.source", F.lit("none")).alias("source"))


@query(
    "usage_sums",
    with_ctes(LEDGER_SQL)
    + """SELECT session_id, operation, nullif(CAST(sum(input_tokens) AS BIGINT), 0) AS input_tokens, nullif(CAST(sum(output_tokens) AS BIGINT), 0) AS output_tokens, nullif(CAST(sum(CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE cache_read_tokens END) AS BIGINT), 0) AS cache_read_tokens FROM ledger GROUP BY ALL""",
)
def usage_sums(spark: SparkSession, folder: str) -> DataFrame:
    calls = ledger(spark, folder).withColumn("cache_read_tokens", F.when(F.col("l_partkey") % 2 != 0, F.col("cache_read_tokens")))
    return cost.usage_totals(calls, [SESSION, "operation"]).select(SESSION, "operation", "input_tokens", "output_tokens", "cache_read_tokens")


# ---- overrides and answers -------------------------------------------------------------------


@query(
    "later_overrides",
    with_ctes(ACTIONS_SQL)
    + """, o AS (SELECT session_id, line_no, 1 AS turn, 'A' AS r FROM actions WHERE k % 2 = 0 UNION ALL SELECT session_id, line_no, 2, 'B' FROM actions WHERE k % 3 = 0 UNION ALL SELECT session_id, line_no, 3, 'C' FROM actions WHERE k % 5 = 0)
SELECT session_id, line_no AS leaf_idx, arg_max(r, turn) AS canonical_root_id FROM o GROUP BY ALL""",
)
def later_overrides(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.event_rows(spark, folder)
    part = lambda step, root: rows.where(F.col("k") % step == 0).select(SESSION, F.col("line_no").alias("leaf_idx"), F.lit(root).alias(ROOT))
    return threads.later_wins(part(2, "A"), part(3, "B"), part(5, "C"))


@query(
    "answer_wording",
    """SELECT CAST(o_custkey AS VARCHAR) AS session_id, count(*) - count(DISTINCT o_orderkey % 4) AS repeated_ids, count(*) FILTER (o_orderkey % 3 = 0) AS missing_deliverable, count(*) FILTER (o_orderkey % 5 = 0) AS missing_success_criteria
FROM orders GROUP BY ALL""",
)
def answer_wording(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    rows = _orders(spark, folder).select(SESSION, (k % 4).alias("temp_id"), F.when(k % 3 != 0, "d").otherwise(" ").alias("deliverable"), F.when(k % 5 != 0, "c").alias("success_criteria"))
    return threads.check_wording(rows, "temp_id")


PLACED_SQL = """
expected AS (SELECT o_custkey AS s, o_orderkey AS item FROM orders WHERE o_orderkey % 6 <> 0),
answer AS (SELECT o_custkey AS s, o_orderkey AS item, o_orderkey % 5 AS g FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_custkey, o_orderkey, 9 FROM orders WHERE o_orderkey % 11 = 0),
counts AS (SELECT s, item, count(*) AS n FROM answer GROUP BY ALL)
"""


@query(
    "consolidation_check",
    with_ctes(PLACED_SQL)
    + """SELECT CAST(s AS VARCHAR) AS session_id, missing, unknown_items, repeated, coalesce(unknown_groups, 0) AS unknown_groups FROM (
  SELECT coalesce(e.s, c.s) AS s, count(*) FILTER (c.n IS NULL) AS missing, count(*) FILTER (e.item IS NULL) AS unknown_items, count(*) FILTER (c.n > 1) AS repeated
  FROM expected e FULL JOIN counts c ON e.s = c.s AND e.item = c.item GROUP BY ALL) LEFT JOIN (SELECT s, count(*) AS unknown_groups FROM answer WHERE g > 4 GROUP BY ALL) USING (s)""",
)
def consolidation_check(spark: SparkSession, folder: str) -> DataFrame:
    """An answer puts every expected thread into one known group; some are left out, some unknown, some named twice, some groups unknown."""
    k = F.col("k")
    rows = _orders(spark, folder)
    answer = rows.where(k % 7 != 0).select(SESSION, k.alias("item"), (k % 5).alias("g")).unionByName(rows.where(k % 11 == 0).select(SESSION, k.alias("item"), F.lit(9).cast("bigint").alias("g")))
    groups = rows.select(SESSION, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("g")).distinct()
    return threads.check_partition(answer, rows.where(k % 6 != 0).select(SESSION, k.alias("item")), "item", "g", groups)


@query(
    "loop_rescan",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 1 THEN concat('new ', o_orderkey) ELSE o_orderstatus END AS model, o_orderkey % 3 = 1 AS replaced FROM orders",
)
def loop_rescan(spark: SparkSession, folder: str) -> DataFrame:
    """A rescanned model replaces the old one only if it is valid; two thirds were asked, half of these are valid."""
    old = _orders(spark, folder).select("id", "k", F.col("o_orderstatus").alias("model"))
    new = old.where(F.col("k") % 3 > 0).select("id", F.concat(F.lit("new "), "id").alias("model"), (F.col("k") % 3 == 1).alias("valid"))
    return provider.accept_if_valid(old.drop("k"), new, ["id"], "model").select("id", "model", "replaced")


@query(
    "grounded_responses",
    with_ctes(ACTIONS_SQL, STATES_SQL)
    + """SELECT session_id, line_no, action, CASE WHEN k % 4 = 1 THEN 'error' ELSE 'success' END AS status, CASE WHEN k % 4 <> 1 THEN concat('goal ', line_no) END AS goal, CASE WHEN k % 4 = 1 THEN 'ReadTimeout: slow' END AS error,
  CASE WHEN k % 6 = 0 THEN 'own' WHEN k % 6 = 1 THEN 'screen' ELSE '' END AS warnings FROM states""",
)
def grounded_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Raw columns with an answer or an error; warnings of the answer before those of the text recogniser."""
    k = F.col("k")
    rows = standins.states(spark, folder).select(SESSION, "line_no", F.concat(F.lit("a"), F.col("line_no").cast("string")).alias("id"), "action", "k")
    one = lambda word: F.array(F.lit(word))
    none = F.array().cast("array<string>")
    answers = rows.select(
        SESSION, "id", F.when(k % 4 != 1, F.concat(F.lit("goal "), F.col("line_no").cast("string"))).alias("goal"), F.when(k % 4 == 1, "ReadTimeout: slow").alias("error"),
        F.when(k % 6 == 0, one("own")).otherwise(none).alias("warnings"), F.when(k % 6 < 2, one("screen")).otherwise(none).alias("ocr_warnings"),
    )
    out = resume.response_rows(rows.drop("k"), answers)
    return out.select(SESSION, "line_no", "action", "status", "goal", "error", F.coalesce(F.array_join("warnings", "|"), F.lit("")).alias("warnings"))


# ---- stored files ----------------------------------------------------------------------------


@query(
    "manifest_threads",
    """WITH f AS (SELECT o_custkey AS s, concat(CASE WHEN o_orderkey % 5 = 0 THEN 'hierarchy_' ELSE 't' END, o_orderkey, '.json') AS n, o_orderkey AS k FROM orders)
SELECT CAST(s AS VARCHAR) AS session_id, n AS file_name FROM f WHERE s % 3 = 0 AND k % 2 = 0 UNION ALL SELECT CAST(s AS VARCHAR), n FROM f WHERE s % 3 <> 0 AND k % 5 <> 0""",
)
def manifest_threads(spark: SparkSession, folder: str) -> DataFrame:
    """Every third customer has a manifest with the even orders and one absent file; the others use their plain documents."""
    k, s = F.col("k"), F.col("o_custkey")
    rows = _orders(spark, folder).withColumn("file_name", F.concat(F.when(k % 5 == 0, "hierarchy_").otherwise("t"), "id", F.lit(".json")))
    named = F.when(k % 2 == 0, F.struct(F.col("file_name").alias("file"), F.lit("C1").alias("canonical_root_id")))
    roots = rows.where(s % 3 == 0).groupBy(SESSION).agg(F.collect_list(named).alias("r"))
    absent = F.array(F.struct(F.lit("gone.json").alias("file"), F.lit("C2").alias("canonical_root_id")))
    manifests = roots.select(SESSION, F.to_json(F.struct(F.concat("r", absent).alias("roots"))).alias("value"))
    return logs.manifest_inputs(manifests, rows.select(SESSION, "file_name"))


@query(
    "merged_root_scan",
    """WITH r AS (SELECT o_custkey AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT CAST(s AS VARCHAR) AS session_id, i AS root_order, concat('C', k) AS root_id, concat('{"n":', k, '}') AS model FROM r WHERE k % 3 <> 0 AND k % 4 <> 1""",
)
def merged_root_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Roots of a session's merged output that are ok and hold a model."""
    k = F.col("k")
    root = F.struct(F.concat(F.lit("C"), "id").alias("root_id"), (k % 3 != 0).alias("ok"), F.when(k % 4 != 1, F.struct(k.alias("n"))).alias("hierarchy"))
    packed = _orders(spark, folder).groupBy(SESSION).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), root.alias("r")))), lambda x: x["r"]).alias("roots"))
    return logs.merged_roots(packed.select(SESSION, F.to_json(F.struct("roots")).alias("value")), "hierarchy").withColumn("root_order", F.col("root_order").cast("bigint"))


@query(
    "validation_sources",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE concat('source ', CASE WHEN o_orderkey % 4 = 0 THEN concat('/abs/', o_orderkey) WHEN o_orderkey % 4 = 1 THEN concat('d/', o_custkey, '/src/', o_orderkey) ELSE concat('s3://b/', o_orderkey) END) END AS source_value FROM orders""",
)
def validation_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that name their source absolutely, beside themselves, by address, or not at all."""
    k = F.col("k")
    named = F.when(k % 4 == 0, F.concat(F.lit("/abs/"), "id")).when(k % 4 == 1, F.concat(F.lit("src/"), "id")).when(k % 4 == 2, F.concat(F.lit("s3://b/"), "id"))
    rows = _orders(spark, folder).withColumns({"named": named, "folder": F.concat(F.lit("d/"), SESSION, F.lit("/"))})
    documents = rows.select("id", SESSION, F.concat("folder", "id", F.lit(".json")).alias("file"), F.to_json(F.struct(F.col("named").alias("source_file"))).alias("value"))
    place = F.when(k % 4 == 1, F.concat("folder", "named")).otherwise(F.col("named"))
    sources = rows.where("named is not null").select(place.alias("file"), F.concat(F.lit("source "), place).alias("value"))
    return logs.with_source(documents, sources).select("id", "source_value")


@query(
    "activities_keyed",
    """SELECT CAST(o_custkey AS VARCHAR) AS session_id, concat('activity_', o_orderkey % 5) AS activity_id, max(o_orderkey) AS place, arg_max(o_orderstatus, o_orderkey) AS objective FROM orders WHERE o_orderkey % 5 <> 4 GROUP BY ALL""",
)
def activities_keyed(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    rows = _orders(spark, folder).select(SESSION, F.when(k % 5 == 4, " ").otherwise(F.concat(F.lit("activity_"), (k % 5).cast("string"))).alias("activity_id"), k.alias("place"), F.col("o_orderstatus").alias("objective"))
    return logs.activities_by_id(rows, F.col("place")).select(SESSION, "activity_id", "place", "objective")


@query(
    "epoch_times",
    """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey + 0.5 WHEN 1 THEN epoch(CAST(o_orderdate AS TIMESTAMP)) + 3723 WHEN 2 THEN epoch(CAST(o_orderdate AS TIMESTAMP)) + 3723.25 WHEN 3 THEN epoch(CAST(o_orderdate AS TIMESTAMP)) - 3477 END AS t FROM orders""",
)
def epoch_times(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, ISO texts with Z, without zone (UTC) and with an offset, blanks and other texts."""
    k = F.col("k")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    given = (
        F.when(k % 6 == 0, F.concat("id", F.lit(".5"))).when(k % 6 == 1, F.concat(day, F.lit("T01:02:03Z"))).when(k % 6 == 2, F.concat(day, F.lit("T01:02:03.250")))
        .when(k % 6 == 3, F.concat(day, F.lit("T01:02:03+02:00"))).when(k % 6 == 4, " ").otherwise("soon")
    )
    return _orders(spark, folder).select("k", timefn.coerce_epoch(given).alias("t"))


@query(
    "evidence_completion",
    """WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
v AS (
  SELECT k, 'apps' AS kind, 'App 0' AS v, 0 AS i FROM l UNION ALL SELECT k, 'apps', concat('App ', p % 3), i FROM l UNION ALL SELECT k, 'entities', CASE WHEN p % 4 = 0 THEN concat('own ', p % 5) ELSE concat('seen ', p % 6) END, i FROM l WHERE p % 7 <> 0
  UNION ALL SELECT k, 'raw', concat('a', i), i FROM l UNION ALL SELECT k, 'screen', concat('t', p % 2), i FROM l WHERE p % 3 = 0
),
f AS (SELECT k, kind, v, min(i) AS i FROM v GROUP BY ALL),
lists AS (SELECT k, string_agg(v, '|' ORDER BY i) FILTER (kind = 'apps') AS apps, string_agg(v, '|' ORDER BY i) FILTER (kind = 'entities') AS entities, string_agg(v, '|' ORDER BY i) FILTER (kind = 'raw') AS raw, string_agg(v, '|' ORDER BY i) FILTER (kind = 'screen') AS screen FROM f GROUP BY ALL)
SELECT CAST(l.k AS VARCHAR) AS id, any_value(apps) AS apps, coalesce(any_value(entities), '') AS entities, any_value(raw) AS raw, coalesce(any_value(screen), '') AS screen,
  CASE WHEN l.k % 3 = 0 THEN 'before' ELSE coalesce(arg_min(concat('b', p), i) FILTER (p % 2 = 0), '') END AS pre_state, coalesce(arg_max(concat('c', p), i) FILTER (p % 5 = 0), '') AS post_state FROM l JOIN lists ON lists.k = l.k GROUP BY l.k""",
)
def evidence_completion(spark: SparkSession, folder: str) -> DataFrame:
    """Orders are activities with one stored application; their lines are the source actions that complete them."""
    p = F.col("x.l_partkey")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    packed = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("l"))
    rows = packed.select("l_orderkey", F.posexplode("l").alias("i", "x"))
    numbered = lambda word, n: F.concat(F.lit(word), n.cast("string"))
    visible = F.when(p % 7 == 0, " ").when(p % 4 == 0, "shadowed").otherwise(numbered("seen ", p % 6))
    action = F.struct(
        numbered("a", F.col("i") + 1).alias("action_id"), numbered("App ", p % 3).alias("active_application"), F.when((p % 4 == 0) & (p % 7 != 0), numbered("own ", p % 5)).alias("grounded_visual_content"),
        visible.alias("visual_content"), F.when(p % 3 == 0, numbered("t", p % 2)).alias("md_results"), F.when(p % 2 == 0, numbered("b", p)).alias("state_before"), F.when(p % 5 == 0, numbered("c", p)).alias("state_after"),
    )
    source = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", action.alias("a")))), lambda y: y["a"]).alias("source_actions"))
    none = F.array().cast("array<string>")
    stored = source.select(
        F.col("l_orderkey").cast("string").alias("id"), "source_actions", F.array(F.lit("App 0")).alias("apps_used"), none.alias("entities"), none.alias("raw_action_ids"), none.alias("ocr_texts"),
        F.when(F.col("l_orderkey") % 3 == 0, " before ").alias("pre_state"), F.lit("").alias("post_state"),
    )
    out = logs.complete_evidence(stored)
    lists = {"apps": "apps_used", "entities": "entities", "raw": "raw_action_ids", "screen": "ocr_texts"}
    return out.select("id", *(F.array_join(c, "|").alias(n) for n, c in lists.items()), "pre_state", "post_state")


# ---- screens ---------------------------------------------------------------------------------


@query(
    "screen_points",
    """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, CAST(l_partkey AS DOUBLE) AS x, CAST(l_suppkey * 7 % 1100 AS DOUBLE) AS y FROM lineitem)
SELECT id, l_partkey, l_suppkey, greatest(0.0, x - 30) AS x1, greatest(0.0, y - 20) AS y1, least(1600.0, x + 30) AS x2, least(900.0, y + 20) AS y2,
  CAST(CASE WHEN x >= 0 AND x < 400 AND y >= 0 AND y < 900 THEN 1 WHEN x >= 400 AND x < 1000 AND y >= 100 AND y < 1000 THEN 2 END AS BIGINT) AS monitor, greatest(0.0, least(x * (800 / 1600.0), 799.0)) AS image_x FROM p""",
)
def screen_points(spark: SparkSession, folder: str) -> DataFrame:
    """Capture box, monitor (right and lower edge outside) and image place of points."""
    x, y = F.col("x"), F.col("y")
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_suppkey", F.col("l_partkey").cast("double").alias("x"), (F.col("l_suppkey") * 7 % 1100).cast("double").alias("y")
    )
    monitor = lambda a, b, w, h: F.struct(*(F.lit(v).alias(n) for v, n in ((a, "left"), (b, "top"), (w, "width"), (h, "height"))))
    box = geometry.capture_box(x, y, F.lit(1600), F.lit(900))
    monitors = F.array(monitor(0, 0, 400, 900), monitor(400, 100, 600, 900))
    out = rows.select("id", "l_partkey", "l_suppkey", box.alias("b"), geometry.monitor_of_point(x, y, monitors).cast("bigint").alias("monitor"), geometry.to_image(x, F.lit(1600), F.lit(800)).alias("image_x"))
    return out.select("id", "l_partkey", "l_suppkey", "b.*", "monitor", "image_x")


@query(
    "shared_items",
    """WITH n AS (SELECT o_orderkey AS k, ['Red', ' blue  sky', concat('x', o_orderkey % 3), ''] AS a, ['RED', 'Blue Sky', concat('X', o_orderkey % 5), 'red', ''] AS b, list_slice(['a', 'b', 'c', 'd', 'e'], 1, CAST(o_orderkey % 6 AS INTEGER)) AS l FROM orders)
SELECT k, CAST(2 + CASE WHEN k % 3 = k % 5 THEN 1 ELSE 0 END AS INTEGER) AS shared, array_to_string(CASE WHEN len(l) <= 4 THEN l ELSE ['a', 'b', 'd', 'e'] END, '') AS ends FROM n""",
)
def shared_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items two lists share after normalizing; first two and last two members of a list."""
    k = F.col("k")
    listed = lambda *words: F.array(*(w if not isinstance(w, str) else F.lit(w) for w in words))
    a = listed("Red", " blue  sky", F.concat(F.lit("x"), (k % 3).cast("string")), "")
    b = listed("RED", "Blue Sky", F.concat(F.lit("X"), (k % 5).cast("string")), "red", "")
    members = F.slice(listed("a", "b", "c", "d", "e"), F.lit(1), (k % 6).cast("int"))
    return _orders(spark, folder).select("k", text.shared_count(a, b).alias("shared"), F.array_join(text.ends(members, repeat=False), "").alias("ends"))


# ---- reports ---------------------------------------------------------------------------------


@query(
    "operator_labels",
    """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN concat('Repeat for each ', CASE WHEN o_orderkey % 4 = 0 THEN 'item' ELSE 'open row' END) WHEN 1 THEN 'Repeat until complete' WHEN 2 THEN 'Choose one path' WHEN 3 THEN 'Can happen together' ELSE '' END AS label FROM orders""",
)
def operator_labels(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    op = F.get(F.array(*(F.lit(o) for o in ("FOR", "WHILE", "CHOICE", "PARALLEL", "SEQ"))), (k % 6).cast("int"))
    return _orders(spark, folder).select("k", F.coalesce(report.operator_label(op, F.when(k % 4 != 0, "open_row")), F.lit("")).alias("label"))


@query(
    "report_flow",
    """WITH e AS (SELECT l_orderkey AS k, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT CAST(k AS VARCHAR) AS root_id, printf('%08d', i) AS sort_key, concat(i, '. **', CASE WHEN l_suppkey % 4 = 0 THEN concat('step ', i) WHEN l_suppkey % 4 = 1 THEN concat('p', l_suppkey % 9) ELSE concat('name ', l_suppkey % 9) END, '**', CASE WHEN l_suppkey % 4 > 1 THEN ' [SEQ]' ELSE '' END) AS line FROM e
UNION ALL SELECT DISTINCT CAST(k AS VARCHAR), '', concat('## Order ', k) FROM e""",
)
def report_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Flow of every order below its heading: references to known nodes, to unknown ones, and plain steps."""
    s = F.col("l_suppkey")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("l")).select("l_orderkey", F.posexplode("l").alias("i", "x"))
    rows = rows.select(F.lit("s").alias(SESSION), F.col("l_orderkey").cast("string").alias("root_id"), (F.col("i") + 1).alias("ordinal"), "x.l_suppkey")
    kind = F.when(s % 4 == 1, F.concat(F.lit("p"), (s % 9).cast("string"))).when(s % 4 > 1, F.concat(F.lit("q"), (s % 9).cast("string")))
    exprs = rows.select(SESSION, "root_id", "ordinal", kind.alias("procedure_node_id"), F.lit(None).cast("string").alias("name"))
    nodes = rows.select(SESSION, "root_id").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("n"))
    nodes = nodes.select(SESSION, "root_id", F.concat(F.lit("q"), F.col("n").cast("string")).alias("node_id"), F.concat(F.lit("name "), F.col("n").cast("string")).alias("name"), F.lit("SEQ").alias("operator"))
    titles = rows.select(SESSION, "root_id", F.concat(F.lit("Order "), "root_id").alias("title")).distinct()
    return report.collection(report.procedure_flow(exprs, nodes), titles).select("root_id", "sort_key", "line")


# ---- all rules of a tree ---------------------------------------------------------------------

_PARTS = ["rule_child_ids", "unknown_evidence", "rule_references", "evidence_out_of_span", "rule_warnings", "rule_partition", "rule_root_cover"]
_DEEPER = " UNION ALL ".join(f"SELECT root_id, path, rule_id, severity, detail FROM ({ORACLES[n]})" for n in _PARTS)


@query(
    "rule_hierarchy",
    with_ctes(TREE_SQL)
    + f""", shape AS (SELECT root_id, path, 'V2' AS rule_id, 'error' AS severity, 'summary' AS detail FROM tree_nodes WHERE root_id = 'C1' AND ck % 11 = 1),
deeper AS ({_DEEPER} UNION ALL SELECT 'C3', '$', 'V8', 'error', 'C3' FROM tree_nodes WHERE root_id = 'C3' AND depth = 0)
SELECT * FROM shape UNION ALL SELECT * FROM deeper WHERE root_id NOT IN (SELECT root_id FROM shape)""",
)
def rule_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """All rules of objective trees; a tree with a shape error gets no deeper findings."""
    acts = models.source_activities(spark, folder)
    owners = evidence.evidence_owners(acts)
    one = F.slice("evidence_refs", 1, 1)
    nodes = models.with_evidence(models.tree_nodes(spark, folder))
    nodes = nodes.withColumns({
        "summary": F.when((F.col("root_id") == "C1") & (F.col("ck") % 11 == 1), " ").otherwise("s"),
        "deliverables": F.array(F.struct(F.lit("k").alias("kind"), F.lit("t").alias("target"), F.lit("e").alias("expected_state"), one.alias("evidence_refs"))),
        "success_criteria": F.array(F.struct(F.lit("p").alias("predicate"), F.lit("v").alias("verifier"), F.lit(0.5).alias("confidence"), one.alias("evidence_refs"))),
        "observed_outcome": F.struct(F.lit("achieved").alias("status"), F.lit("d").alias("description"), one.alias("evidence_refs")),
    })
    counted = acts.groupBy("session_id", "root_id").agg(F.count(F.lit(1)).alias("n_activities"))
    sources = normalize.requires_decomposition(counted.withColumn("source_children", F.lit(0)))
    sources = sources.withColumn("source_root_id", F.when(F.col("root_id") == "C3", "C9").otherwise(F.col("root_id")))
    return rules.hierarchy_findings(nodes, acts, owners, evidence.known_ids(owners), evidence.semantic_index(acts), sources).select(FINDING)
