"""Queries over joins with the trace and between models: screenshots, resume, caches, alignment, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import answers as answer_fn
from sessionloom.operators import alignment, consolidate, resume, screenshots
from sessionloom.plans import standins
from sessionloom.plans.base import query, table
from sessionloom.plans.models import TREE_SQL, tree_nodes
from sessionloom.plans.standins import ACTIONS_SQL, HOUR, STATES_SQL, with_ctes
from sessionloom.plans.trace import RUNS_SQL

SESSION = "session_id"

# ---- screenshots -----------------------------------------------------------------------------

SHOTS_SQL = """
shots AS (
  SELECT session_id, before AS path, (ts_us - 1800000000) / 1e6 AS t FROM states WHERE before IS NOT NULL
  UNION ALL SELECT session_id, after, (ts_us + 1800000000) / 1e6 FROM states WHERE after IS NOT NULL
)
"""


@query(
    "screenshot_candidates",
    with_ctes(ACTIONS_SQL, STATES_SQL, SHOTS_SQL)
    + """SELECT a.session_id, a.line_no, s.path, round(abs(s.t - a.ts), 3) AS gap FROM actions a JOIN shots s
ON a.session_id = s.session_id AND s.t > a.ts - 7201 AND s.t < a.ts + 7201 AND contains(s.path, a.action) WHERE abs(s.t - a.ts) < 7200""",
)
def screenshot_candidates(spark: SparkSession, folder: str) -> DataFrame:
    events = standins.actions(spark, folder).select(SESSION, F.col("line_no").alias("run_id"), F.lit(0).alias("pos"), "ts", "action")
    pairs = screenshots.candidates(events, standins.screenshots(spark, folder), 2 * HOUR)
    return pairs.select(SESSION, F.col("run_id").alias("line_no"), "path", F.round("gap", 3).alias("gap"))


CLAIM_SQL = """
wishes AS (
  SELECT n.session_id, n.run_id, n.line_no AS pos, n.action, s.path, abs(s.t - n.ts) AS gap,
    CASE WHEN n.kind = 'key' THEN '_first.jpg' ELSE '_before.jpg' END AS first, CASE WHEN n.kind = 'key' THEN '_final.jpg' ELSE '_after.jpg' END AS final
  FROM numbered n JOIN shots s ON n.session_id = s.session_id AND s.t > n.ts - {tolerance} - 1 AND s.t < n.ts + {tolerance} + 1 AND contains(s.path, n.action)
  WHERE abs(s.t - n.ts) < {tolerance}
),
asks AS (
  SELECT session_id, 2 * run_id AS ask, list(path ORDER BY pos, NOT ends_with(path, first), gap, path) AS paths FROM wishes GROUP BY session_id, run_id
  UNION ALL
  SELECT session_id, 2 * run_id + 1, list(path ORDER BY -pos, NOT ends_with(path, final), gap, path) FROM wishes GROUP BY session_id, run_id
),
in_turn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ask) AS n FROM asks),
walk AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS ask, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS path FROM in_turn
  UNION ALL
  SELECT session_id, n, ask, CASE WHEN path IS NULL THEN taken ELSE list_append(taken, path) END, path FROM (
    SELECT w.session_id, t.n, CAST(t.ask AS BIGINT) AS ask, w.taken, list_filter(t.paths, lambda p: NOT list_contains(w.taken, p))[1] AS path
    FROM walk w JOIN in_turn t ON t.session_id = w.session_id AND t.n = w.n + 1)
),
claimed AS (
  SELECT session_id, ask // 2 AS run_id, max(path) FILTER (ask % 2 = 0) AS before, max(path) FILTER (ask % 2 = 1) AS after FROM walk WHERE ask >= 0 GROUP BY ALL
)
"""


def _claim_sql(hours: int, *more: str) -> str:
    return with_ctes(ACTIONS_SQL, STATES_SQL, SHOTS_SQL, RUNS_SQL, CLAIM_SQL.format(tolerance=hours * 3600), *more).replace("WITH ", "WITH RECURSIVE ", 1)


MATCH_SQL = """SELECT r.session_id, CAST(r.run_id AS BIGINT) AS run_id, r.action, c.before, c.after
FROM runs r LEFT JOIN claimed c ON c.session_id = r.session_id AND c.run_id = r.run_id"""


def _matched(spark: SparkSession, folder: str, hours: int) -> tuple:
    labelled = consolidate.label_runs(standins.actions(spark, folder))
    runs = consolidate.collapse_runs(labelled)
    constituents = labelled.df.select(SESSION, "run_id", F.col("line_no").alias("pos"), "ts", "action")
    return runs, screenshots.match_states(runs.rows, constituents, standins.screenshots(spark, folder), hours * HOUR)


@query("screenshot_match", _claim_sql(2) + MATCH_SQL)
def screenshot_match(spark: SparkSession, folder: str) -> DataFrame:
    """States of merged runs, each screenshot used once (tolerance two hours for the sparse log)."""
    return _matched(spark, folder, 2)[1].select(SESSION, "run_id", "action", "before", "after")


@query("screenshot_contest", _claim_sql(96) + MATCH_SQL)
def screenshot_contest(spark: SparkSession, folder: str) -> DataFrame:
    """As before with four days of tolerance, so that many runs want the same screenshots."""
    return _matched(spark, folder, 96)[1].select(SESSION, "run_id", "action", "before", "after")


# The final rows: states as matched, trimmed, repaired, timed again, double clicks as by default (0.5 s, 10 px).
TRAJECTORY_SQL = """
matched AS (
  SELECT r.*, c.before, c.after, row_number() OVER (PARTITION BY r.session_id ORDER BY r.run_id) AS i
  FROM runs r LEFT JOIN claimed c ON c.session_id = r.session_id AND c.run_id = r.run_id
),
seen_times AS (
  SELECT *, coalesce(TRY_CAST(split_part(split_part(before, '/', 2), '_', 1) AS DOUBLE), 0) AS b,
    coalesce(TRY_CAST(split_part(split_part(after, '/', 2), '_', 1) AS DOUBLE), 0) AS a FROM matched
),
first_times AS (
  SELECT *, CASE WHEN b = 0 THEN a ELSE b END AS time_before, CASE WHEN a = 0 THEN b ELSE a END AS time_after,
    coalesce(lag(CASE WHEN a <> 0 THEN a ELSE b END) OVER (PARTITION BY session_id ORDER BY i), 0) AS last_time FROM seen_times
),
trimmed AS (
  SELECT * FROM (
    SELECT *, min(i) FILTER (b <> 0 AND a <> 0) OVER (PARTITION BY session_id) AS lo, max(i) FILTER (b <> 0 AND a <> 0) OVER (PARTITION BY session_id) AS hi FROM first_times)
  WHERE lo IS NULL OR i BETWEEN lo AND hi
),
repaired AS (
  SELECT * EXCLUDE (before, after), CASE WHEN before IS NULL AND NOT contains(action, 'press') THEN lag(after) OVER w ELSE before END AS before,
    CASE WHEN contains(action, 'drag') THEN after ELSE coalesce(lead(before) OVER w, after) END AS after
  FROM trimmed WINDOW w AS (PARTITION BY session_id ORDER BY i)
),
again AS (
  SELECT *, CASE WHEN a2 = 0 THEN b2 ELSE a2 END - CASE WHEN b2 = 0 THEN a2 ELSE b2 END AS time_range,
    CASE WHEN time_before <> 0 AND last_time <> 0 THEN time_before - last_time ELSE 0 END AS time_diff FROM (
    SELECT *, coalesce(TRY_CAST(split_part(split_part(before, '/', 2), '_', 1) AS DOUBLE), 0) AS b2,
      coalesce(TRY_CAST(split_part(split_part(after, '/', 2), '_', 1) AS DOUBLE), 0) AS a2 FROM repaired)
),
pointed AS (
  SELECT *, TRY_CAST(regexp_extract(action, '\\(([-0-9.]+), ([-0-9.]+)', 1) AS DOUBLE) AS x, TRY_CAST(regexp_extract(action, '\\(([-0-9.]+), ([-0-9.]+)', 2) AS DOUBLE) AS y FROM again
),
paired AS (
  SELECT *, coalesce(contains(action, 'click') AND contains(lead(action) OVER w, 'click') AND lead(time_diff) OVER w <= 0.5
    AND sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) < 10, false) AS p,
    lead(after) OVER w AS next_after, lead(time_after) OVER w AS next_time, lead(time_range) OVER w AS next_range
  FROM pointed WINDOW w AS (PARTITION BY session_id ORDER BY i)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY i) - 1 AS place FROM (
    SELECT *, sum(CASE WHEN pp THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, coalesce(lag(p) OVER (PARTITION BY session_id ORDER BY i), false) AS pp FROM paired))
),
rows_left AS (SELECT *, p AND place % 2 = 0 AS d FROM placed WHERE NOT (pp AND place % 2 = 1))
"""


@query(
    "trajectory",
    _claim_sql(2, TRAJECTORY_SQL)
    + """SELECT session_id, concat('n', row_number() OVER (PARTITION BY session_id ORDER BY i)) AS id, CASE WHEN d THEN concat('double_click(', split_part(action, '(', 2)) ELSE action END AS action,
  before, CASE WHEN d THEN next_after ELSE after END AS after, round(time_before, 3) AS time_before, round(CASE WHEN d THEN next_time ELSE time_after END, 3) AS time_after,
  round(CASE WHEN d THEN time_range + next_range ELSE time_range END, 3) AS time_range FROM rows_left""",
)
def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events to final action rows: merge, match, time, trim, repair, double clicks, dense ids."""
    runs, matched = _matched(spark, folder, 2)
    rows = consolidate.trajectory(runs.derive(matched)).index("_n", start=1).df
    times = [F.round(c, 3).alias(c) for c in ("time_before", "time_after", "time_range")]
    return rows.select(SESSION, F.concat(F.lit("n"), F.col("_n").cast("string")).alias("id"), "action", "before", "after", *times)


@query(
    "missing_screenshots",
    with_ctes(ACTIONS_SQL, STATES_SQL)
    + """SELECT session_id, line_no, before IS NULL OR line_no % 13 = 2 AS missing_before, after IS NOT NULL AND line_no % 17 = 4 AS missing_after FROM states""",
)
def missing_screenshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.states(spark, folder)
    line = F.col("line_no")
    listed = rows.select(SESSION, F.explode(F.array(F.when(line % 13 != 2, F.col("before")), F.when(line % 17 != 4, F.col("after")))).alias("path"))
    return screenshots.missing_flags(rows, listed).select(SESSION, "line_no", "missing_before", "missing_after")


@query(
    "screenshot_names",
    with_ctes(ACTIONS_SQL, STATES_SQL)
    + """SELECT session_id, line_no, CASE WHEN contains(action, 'key_press') THEN concat(action, '_before') ELSE action END AS action, 'before' AS tag FROM states WHERE before IS NOT NULL""",
)
def screenshot_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.states(spark, folder).where(F.col("before").isNotNull()).select(SESSION, "line_no", F.col("before").alias("path"))
    return screenshots.parse_paths(rows).select(SESSION, "line_no", "action", "tag")


# ---- resume ----------------------------------------------------------------------------------

STORED_SQL = """
entries AS (SELECT session_id, line_no, concat('a', line_no) AS id, action, before, after, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, line_no) - 1 AS original_index FROM states),
finished AS (SELECT session_id, id AS provenounce_id, line_no, CASE WHEN line_no % 10 = 0 THEN 'error' ELSE 'success' END AS status,
    CASE WHEN line_no % 31 = 0 THEN NULL ELSE id END AS id, CASE WHEN line_no % 8 = 1 THEN 'changed' ELSE action END AS action, before, after, ts, concat('goal ', line_no) AS goal FROM entries WHERE line_no % 3 <> 0),
progress AS (SELECT session_id, id AS provenounce_id, line_no, 'success' AS status, id, action, before, after, ts, concat('again ', line_no) AS goal FROM entries WHERE line_no % 4 = 0),
stored AS (SELECT * FROM progress UNION ALL SELECT * FROM finished f WHERE NOT EXISTS (SELECT 1 FROM progress p WHERE p.session_id = f.session_id AND p.provenounce_id = f.provenounce_id))
"""
RESUME = (ACTIONS_SQL, STATES_SQL, STORED_SQL)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.steps(spark, folder).df
    return rows.select(
        SESSION, "line_no", F.col("action_id").alias("id"), "action", F.col("before").alias("state_before"), F.col("after").alias("state_after"),
        F.col("ts").alias("time_before"), F.col("ts").alias("time_after"), F.lit(0.0).alias("time_range"), F.col("idx").alias("original_index"),
    )


def _stored(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    line = F.col("line_no")
    rows = entries.withColumn(resume.KEY, F.col("id")).drop("original_index")
    text_of = lambda word: F.concat(F.lit(f"{word} "), line.cast("string"))
    finished = rows.where(line % 3 != 0).withColumns(
        {
            "status": F.when(line % 10 == 0, "error").otherwise("success"), "id": F.when(line % 31 != 0, F.col("id")),
            "action": F.when(line % 8 == 1, "changed").otherwise(F.col("action")), "goal": text_of("goal"),
        }
    )
    progress = rows.where(line % 4 == 0).withColumns({"status": F.lit("success"), "goal": text_of("again")})
    return finished, progress


@query("resume_overlay", with_ctes(*RESUME) + "SELECT session_id, provenounce_id, status, goal FROM stored")
def resume_overlay(spark: SparkSession, folder: str) -> DataFrame:
    return resume.stored_outputs(*_stored(_entries(spark, folder))).select(SESSION, resume.KEY, "status", "goal")


@query(
    "resume_done",
    with_ctes(*RESUME) + "SELECT session_id, provenounce_id FROM finished WHERE status = 'success' UNION SELECT session_id, provenounce_id FROM progress",
)
def resume_done(spark: SparkSession, folder: str) -> DataFrame:
    return resume.done_ids(*_stored(_entries(spark, folder)))


@query(
    "resume_worklist",
    with_ctes(*RESUME)
    + """SELECT e.session_id, e.id, e.original_index FROM entries e WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.session_id = e.session_id AND s.provenounce_id = e.id
  AND s.status = 'success' AND (s.id IS NULL OR s.action = e.action))""",
)
def resume_worklist(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    return resume.worklist(entries, resume.stored_outputs(*_stored(entries))).select(SESSION, "id", "original_index")


@query(
    "regrounded_rows",
    with_ctes(*RESUME)
    + "SELECT e.session_id, e.id, e.original_index, e.action, s.status, s.goal FROM entries e JOIN stored s ON s.session_id = e.session_id AND s.provenounce_id = e.id WHERE e.original_index < 40",
)
def regrounded_rows(spark: SparkSession, folder: str) -> DataFrame:
    """First forty raw rows of every session with their stored answer (a session limit is part of the operator)."""
    entries = _entries(spark, folder)
    out = resume.rejoin(entries, resume.stored_outputs(*_stored(entries)), limit=40)
    return out.select(SESSION, "id", "original_index", "action", "status", "goal")


@query(
    "trace_counters",
    with_ctes(*RESUME)
    + """, w AS (SELECT e.* FROM entries e WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.session_id = e.session_id AND s.provenounce_id = e.id AND s.status = 'success' AND (s.id IS NULL OR s.action = e.action)))
SELECT e.session_id, count(*) AS loaded, (SELECT count(*) FROM w WHERE w.session_id = e.session_id) AS ready, (SELECT count(*) FROM w WHERE w.session_id = e.session_id AND before IS NULL) AS missing_before,
  (SELECT count(*) FROM stored s WHERE s.session_id = e.session_id AND status = 'success') AS success, (SELECT count(*) FROM stored s WHERE s.session_id = e.session_id AND status = 'error') AS error,
  count(*) - (SELECT count(*) FROM w WHERE w.session_id = e.session_id) AS skipped FROM entries e GROUP BY e.session_id""",
)
def trace_counters(spark: SparkSession, folder: str) -> DataFrame:
    entries = _entries(spark, folder)
    stored = resume.stored_outputs(*_stored(entries))
    waiting = screenshots.missing_flags(resume.worklist(entries, stored), standins.screenshots(spark, folder), "state_before", "state_after")
    return resume.counters(entries, waiting, stored).drop("missing_after")


@query(
    "duplicate_ids",
    "SELECT CAST(l_orderkey AS VARCHAR) AS session_id, CAST(l_linenumber AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias(SESSION), F.col("l_linenumber").cast("string").alias("id"))
    return resume.duplicate_ids(rows, [SESSION, "id"])


@query(
    "cache_lookup",
    with_ctes(ACTIONS_SQL)
    + """, c AS (SELECT concat(k, '/', event_type) AS key, arg_max(line_no, line_no) AS v FROM actions WHERE line_no % 2 = 0 AND k % 5 <> 2 GROUP BY ALL)
SELECT a.session_id, a.line_no, c.v IS NOT NULL AS cache_hit, CASE WHEN c.v IS NULL THEN a.event_type ELSE concat('seen ', c.v) END AS visual_content FROM actions a LEFT JOIN c ON c.key = concat(a.k, '/', a.event_type)""",
)
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.actions(spark, folder).select(SESSION, "line_no", "k", "event_type", F.col("event_type").alias("visual_content"))
    prepared = rows.withColumns(
        {"action_id": F.col("k").cast("string"), "action": F.lit(""), "goal": F.lit(None).cast("string"), "active_application": F.col("event_type"), "md_results": F.lit("")}
    )
    key = resume.cache_key(F.lit("m"))
    stored = prepared.where(F.col("line_no") % 2 == 0).select(
        key.alias("cache_key"), "line_no",
        F.when(F.col("k") % 5 == 2, "  ").otherwise(F.concat(F.lit(" seen "), F.col("line_no").cast("string"))).alias("enriched_visual_content"),
    )
    return resume.apply_cache(prepared, stored, key).select(SESSION, "line_no", "cache_hit", "visual_content")


# ---- alignment -------------------------------------------------------------------------------


@query(
    "grounding_copy",
    with_ctes(TREE_SQL)
    + """, o AS (SELECT root_id, node_id, ref, concat('goal of ', path) AS outcome FROM tree_nodes WHERE node_id LIKE 'C%.%.%' AND ordinal < 1000 AND ck % 2 = 0 AND ref <> 'activity_12'),
u AS (SELECT root_id, path, node_id, CASE WHEN ck % 5 = 0 THEN 'activity_0000' ELSE ref END AS ref FROM tree_nodes)
SELECT u.root_id, u.path, coalesce(o.outcome, 'own') AS outcome, o.outcome IS NOT NULL AS grounding_copied FROM u LEFT JOIN o ON u.root_id = o.root_id AND u.node_id = o.node_id AND u.ref = o.ref""",
)
def grounding_copy(spark: SparkSession, folder: str) -> DataFrame:
    nodes = tree_nodes(spark, folder)
    leaf = F.col("node_id").rlike(r"^C.*\..*\.")
    objective = nodes.where(leaf & (F.col("ck") % 2 == 0)).withColumn("outcome", F.concat(F.lit("goal of "), "path"))
    unified = nodes.withColumns(
        {"outcome": F.lit("own"), "refs": F.when(F.col("ck") % 5 == 0, F.array(F.lit("activity_0000"))).otherwise(F.col("refs"))}
    )
    return alignment.copy_grounding(unified, objective, ["outcome"]).select("root_id", "path", "outcome", "grounding_copied")


@query(
    "leaf_fill",
    """SELECT CAST(l_orderkey AS VARCHAR) AS root_id, l_linenumber, l_partkey, coalesce(p_name, 'own name') AS name, coalesce(p_type, '') AS description
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 2 = 0) ON l_partkey = p_partkey""",
)
def leaf_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Line items are activity leaves, parts the activities they name."""
    exprs = table(spark, folder, "lineitem").select(
        F.lit("s").alias(SESSION), F.lit("r").alias("root_id"), F.col("l_orderkey").cast("string").alias("order_id"), "l_linenumber", "l_partkey",
        F.col("l_partkey").cast("string").alias("activity_id"), F.lit("own name").alias("name"), F.lit("").alias("description"),
    )
    activities = table(spark, folder, "part").where(F.col("p_size") % 2 == 0).select(
        F.lit("s").alias(SESSION), F.lit("r").alias("root_id"), F.col("p_partkey").cast("string").alias("activity_id"),
        F.col("p_name").alias("objective"), F.col("p_type").alias("additional_context"),
    )
    out = alignment.fill_leaves(exprs, activities)
    return out.select(F.col("order_id").alias("root_id"), "l_linenumber", "l_partkey", "name", "description")


@query(
    "model_pairs",
    """WITH o AS (SELECT o_custkey AS s, concat('k', o_orderkey % 7) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), p AS (SELECT o_custkey AS s, concat('k', o_orderkey % 7) AS f FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL),
o1 AS (SELECT s, min(f) AS f FROM o GROUP BY s HAVING count(*) = 1), p1 AS (SELECT s, min(f) AS f FROM p GROUP BY s HAVING count(*) = 1)
SELECT CAST(o.s AS VARCHAR) AS session_id, o.f AS objective_key, p.f AS procedure_key FROM o JOIN p ON o.s = p.s AND o.f = p.f
UNION ALL SELECT CAST(o1.s AS VARCHAR), o1.f, p1.f FROM o1 JOIN p1 ON o1.s = p1.s WHERE o1.f <> p1.f""",
)
def model_pairs(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    models = lambda status: orders.where(F.col("o_orderstatus") == status).select(
        F.col("o_custkey").cast("string").alias(SESSION), F.concat(F.lit("k"), (F.col("o_orderkey") % 7).cast("string")).alias("file_key")
    ).distinct()
    return alignment.pair_models(models("F"), models("P"))


@query(
    "cache_root_match",
    """WITH c AS (SELECT o_custkey AS s, concat('d', o_orderkey % 3, '/f', o_orderkey % 11) AS path, concat('f', o_orderkey % 11) AS b FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL),
i AS (SELECT o_custkey AS s, concat('d', CASE WHEN o_orderkey % 4 = 0 THEN 9 ELSE o_orderkey % 3 END, '/f', o_orderkey % 11) AS path, concat('f', o_orderkey % 11) AS b FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL),
e AS (SELECT c.s, c.path AS cached_path, c.path FROM c JOIN i ON c.s = i.s AND c.path = i.path),
rc AS (SELECT s, b, min(path) AS cached_path FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.s = c.s AND e.path = c.path) GROUP BY s, b HAVING count(*) = 1),
ri AS (SELECT s, b, min(path) AS path FROM i WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.s = i.s AND e.path = i.path) GROUP BY s, b HAVING count(*) = 1),
m AS (SELECT * FROM e UNION ALL SELECT rc.s, cached_path, path FROM rc JOIN ri ON rc.s = ri.s AND rc.b = ri.b)
SELECT CAST(m.s AS VARCHAR) AS session_id, cached_path, path, (SELECT count(*) FROM c WHERE c.s = m.s) = count(*) OVER (PARTITION BY m.s) AND (SELECT count(*) FROM i WHERE i.s = m.s) = count(*) OVER (PARTITION BY m.s) AS complete FROM m""",
)
def cache_root_match(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").where(F.col("o_orderstatus") != "O")
    name = F.concat(F.lit("f"), (k % 11).cast("string"))
    files = lambda folder_no: rows.select(
        F.col("o_custkey").cast("string").alias(SESSION), F.concat(F.lit("d"), folder_no.cast("string"), F.lit("/"), name).alias("path"), name.alias("base_name")
    ).distinct()
    return alignment.match_cached_roots(files(k % 3), files(F.when(k % 4 == 0, 9).otherwise(k % 3)))


@query(
    "session_bundle",
    """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey, o_orderstatus, o_totalprice FROM orders)
SELECT session_id, CAST(o_orderkey AS VARCHAR) AS root_id, o_orderkey % 2 = 0 AS has_objective, o_orderkey % 3 = 0 AS has_procedure, o_orderkey % 6 = 0 AS has_unified, CAST(l.n AS BIGINT) AS n_activities
FROM o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey""",
)
def session_bundle(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias(SESSION), k.cast("string").alias("root_id"), k)
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_activities"))
    derived = rows.join(lines, "o_orderkey").select(SESSION, "root_id", "n_activities")
    model = lambda step, name: rows.where(k % step == 0).select(SESSION, "root_id", F.lit(True).alias(name))
    out = alignment.session_bundle(rows.select(SESSION, "root_id"), derived, model(2, "has_objective"), model(3, "has_procedure"), model(6, "has_unified"))
    return out.select(SESSION, "root_id", "n_activities", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_objective", "has_procedure", "has_unified")])


@query(
    "report_trace",
    with_ctes(ACTIONS_SQL)
    + """SELECT a.session_id, line_no AS position, CASE WHEN k % 6 = 0 THEN 'unassigned' ELSE concat('T', k % 6) END AS thread, concat('activity_', line_no) AS activity_id, event_type AS objective, k AS event_count FROM actions a""",
)
def report_trace(spark: SparkSession, folder: str) -> DataFrame:
    rows = standins.event_rows(spark, folder).withColumn("activity_id", F.concat(F.lit("activity_"), F.col("line_no").cast("string")))
    k = F.col("k")
    members = rows.where(k % 6 != 0).select(SESSION, "activity_id", F.concat(F.lit("T"), (k % 6).cast("string")).alias("root_id"), (k % 6).alias("manifest_order"))
    earlier = members.withColumns({"root_id": F.lit("T0"), "manifest_order": F.lit(0).cast("bigint")})
    activities = rows.select(SESSION, F.col("line_no").alias("position"), "activity_id", F.col("event_type").alias("objective"), F.lit("").alias("additional_context"), k.alias("event_count"))
    return alignment.trace_table(activities, alignment.activity_threads(members.unionByName(earlier))).drop("additional_context")


@query(
    "work_counts",
    """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, CAST(o_orderkey AS VARCHAR) AS root_id, o_orderkey % 101 AS n, CAST(o_totalprice * 10 AS BIGINT) AS bytes FROM orders)
SELECT session_id, root_id, CASE WHEN n <= 50 AND bytes <= 1500000 THEN 'direct' ELSE 'agent' END AS objective_route, CASE WHEN n < 50 AND bytes <= 1500000 THEN 'direct' ELSE 'agent' END AS procedure_route FROM n""",
)
def work_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias(SESSION), F.col("o_orderkey").cast("string").alias("root_id"),
        (F.col("o_orderkey") % 101).alias("n_activities"), F.round(F.col("o_totalprice") * 10).cast("bigint").alias("doc_bytes"),
    )
    first = alignment.route(rows, inclusive=True).withColumnRenamed("route", "objective_route")
    return alignment.route(first, inclusive=False).withColumnRenamed("route", "procedure_route").drop("n_activities", "doc_bytes")


@query(
    "large_sequences",
    """SELECT CAST(l_orderkey AS VARCHAR) AS root_id, count(*) AS n_leaves FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey HAVING count(*) >= 8""",
)
def large_sequences(spark: SparkSession, folder: str) -> DataFrame:
    exprs = table(spark, folder, "lineitem").select(
        F.lit("s").alias(SESSION), F.col("l_orderkey").cast("string").alias("root_id"), F.lit("p").alias("node_id"), F.lit("activity").alias("kind"),
        F.lit("steps").alias("slot"), F.when(F.col("l_orderkey") % 2 == 0, "SEQ").otherwise("FOR").alias("node_operator"),
    )
    return alignment.large_sequences(exprs).select("root_id", "n_leaves")


# ---- model answers ---------------------------------------------------------------------------


@query(
    "model_json_extract",
    with_ctes(ACTIONS_SQL)
    + """SELECT session_id, line_no, CASE WHEN k % 6 = 5 THEN 0 ELSE 1 END AS n_groups, CASE WHEN k % 6 = 5 THEN -1 ELSE k END AS first_start,
  CASE WHEN k % 6 = 5 THEN '' WHEN k % 6 = 4 THEN 'Unclassified activity' ELSE event_type END AS first_label FROM actions""",
)
def model_json_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Answers wrapped in fences, thinking text, prose, or not JSON at all."""
    k = F.col("k").cast("string")
    label = F.when(F.col("k") % 6 == 4, F.lit(" ")).otherwise(F.col("event_type"))
    body = F.concat(F.lit('{"segments": [{"start_idx": '), k, F.lit(', "end_idx": "'), k, F.lit('", "objective": "'), label, F.lit('"}, {"start_idx": "x"}]}'))
    kind = F.col("k") % 6
    response = (
        F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone")))
        .when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("<think>{no}</think>"), body))
        .when(kind == 3, F.concat(F.lit("The answer is "), body, F.lit(" as asked.")))
        .when(kind == 4, body)
        .otherwise(F.lit("I cannot say [1, 2]"))
    )
    rows = standins.event_rows(spark, folder).withColumn("json", answer_fn.json_object_text(answer_fn.without_thinking(response)))
    rows = rows.withColumn("g", answer_fn.parse_groups(F.col("json")))
    return rows.select(
        SESSION, "line_no", F.size("g").alias("n_groups"), F.coalesce(F.get("g", 0)["start_idx"], F.lit(-1)).alias("first_start"),
        F.coalesce(F.get("g", 0)["label"], F.lit("")).alias("first_label"),
    )
