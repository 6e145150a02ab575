"""What is sent to a model or a reader: request rows, payloads, side choices, work lists, following context and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators.sequence import order_sessions

# The messages of rejected requests and the context of a session's last batch.
NO_ACTION = "activity entry is missing action"
NO_BEFORE = "before screenshot not found"
END_OF_SESSION = "End of session. No subsequent actions."


def grounding_requests(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Request rows: the action and the image before it are required (else an error), the image after it is not."""
    action = F.col("action")
    error = F.when(action.isNull() | (action == ""), NO_ACTION).when(F.col(before).isNull() | (F.col(before) == ""), NO_BEFORE)
    return rows.withColumns({
        "error": error,
        "before_image": F.when(error.isNull(), F.col(before)),
        "after_image": F.when(error.isNull() & (F.col(after) != ""), F.col(after)),
    })


def side(before: Column, after: Column, reverse: bool = False) -> Column:
    """The value before an action, or after it when read backwards; the other side where that is missing."""
    return F.coalesce(after, before) if reverse else F.coalesce(before, after)


def missing_texts(rows: DataFrame, texts: str, before: str = "before") -> DataFrame:
    """Rows without screen text whose screenshot is there: the work list of a later reading."""
    empty = F.col(texts).isNull() | F.trim(F.col(texts).cast("string")).isin("", "{}", "[]")
    return rows.where(empty & F.col(before).isNotNull() & (F.col(before) != ""))


def action_payload(status: Column, goal: Column, app: Column, content: Column, action_id: Column, action: Column, limit: int = 220) -> Column:
    """JSON of one action for a prompt: empty values and the status "success" are left out, screen content is cut to `limit`."""
    filled = lambda c: F.when(c.isNotNull() & (c != ""), c)
    return F.to_json(F.struct(
        F.coalesce(action, F.lit("")).alias("action"), filled(action_id).alias("id"), F.when(status != "success", filled(status)).alias("status"),
        filled(goal).alias("grounded_immediate_intent"), filled(app).alias("active_application"),
        F.when(filled(content).isNotNull(), text.truncate(content, limit)).alias("important_content_on_screen"),
    ))


def _filled(c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), c)


def representative_payload(action: Column, goal: Column, app: Column) -> Column:
    """The few words of one action among others: cut to 140 and 160 characters, empty parts left out."""
    return F.struct(
        text.truncate(action, 140).alias("action"), F.when(_filled(goal).isNotNull(), text.truncate(goal, 160)).alias("grounded_immediate_intent"), _filled(app).alias("active_application"),
    )


def merge_payloads(segments: DataFrame, rows: DataFrame, session: str = "session_id") -> DataFrame:
    """JSON of each segment for a merge prompt, with its first two and last two actions (a short segment shows them twice).

    Only these rows are joined. segments: session, seg_idx, start_action_idx, end_action_idx, label. rows: session, idx, action, goal, active_application.
    """
    start, end = F.col("start_action_idx"), F.col("end_action_idx")
    head = F.sequence(start, F.least(end, start + 1))
    tail = F.sequence(F.greatest(start, end - 1), end)
    picked = segments.select(session, "seg_idx", F.posexplode(F.concat(head, tail)).alias("_n", "idx")).join(rows.select(session, "idx", "action", "goal", "active_application"), [session, "idx"])
    part = representative_payload(F.col("action"), F.col("goal"), F.col("active_application"))
    shown = picked.groupBy(session, "seg_idx").agg(F.array_sort(F.collect_list(F.struct("_n", part.alias("p")))).alias("_r"))  # at most four
    out = segments.select(session, "seg_idx", "start_action_idx", "end_action_idx", "label").join(shown, [session, "seg_idx"], "left")
    payload = F.struct(
        F.array(start, end).alias("action_range"), F.col("label").alias("semantic_action"), (end - start + 1).alias("event_count"),
        F.transform("_r", lambda r: r["p"]).alias("representative_actions"),
    )
    return out.select(session, "seg_idx", F.to_json(payload).alias("payload"))


def leaf_payload(leaf: dict[str, Column]) -> Column:
    """JSON of one activity for thread discovery: four applications, six entities, three screen texts of 320 characters, states of 120."""
    return F.to_json(F.struct(
        leaf["leaf_idx"].alias("leaf_idx"), F.array(leaf["start"], leaf["end"]).alias("node_range"), leaf["objective"].alias("objective"), leaf["procedure_summary"].alias("procedure_summary"),
        F.slice(leaf["apps_used"], 1, 4).alias("apps_used"), F.slice(leaf["entities"], 1, 6).alias("entities"),
        F.transform(F.slice(leaf["ocr_texts"], 1, 3), lambda t: text.truncate(t, 320)).alias("ocr_text"), text.truncate(leaf["pre_state"], 120).alias("pre_state"),
        text.truncate(leaf["post_state"], 120).alias("post_state"), leaf["num_actions"].alias("num_actions"),
    ))


def patch_texts(rows: DataFrame, found: DataFrame, texts: str, keys: list[str], before: str = "before") -> tuple[DataFrame, DataFrame]:
    """Rows with the screen texts that a later reading found, and per session how many were asked, patched and still missing.

    Only rows of the work list (`missing_texts`) change, and only where a text was found. found: keys and the text.
    """
    open_rows = missing_texts(rows, texts, before).select(*keys).withColumn("_open", F.lit(True))
    new = found.where(F.col(texts).isNotNull() & ~F.trim(F.col(texts)).isin("", "{}", "[]")).select(*keys, F.col(texts).alias("_new")).dropDuplicates(keys)
    marked = rows.join(open_rows, keys, "left").join(new, keys, "left")
    hit = F.col("_open").isNotNull() & F.col("_new").isNotNull()
    counts = marked.where("_open").groupBy(keys[0]).agg(
        F.count(F.lit(1)).alias("asked"), F.count_if(hit).alias("patched"), F.count_if(~hit).alias("still_missing")
    )
    return marked.withColumn(texts, F.when(hit, F.col("_new")).otherwise(F.col(texts))).drop("_open", "_new"), counts


def backward_batches(steps: DataFrame, size: int, session: str = "session_id") -> DataFrame:
    """Batches of `size` steps counted from a session's end: batch 0 is the last; the first may be short. steps: session, idx."""
    counted = steps.groupBy(session).agg((F.max("idx") + 1).alias("n"))
    spread = counted.select(session, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size))).alias("batch"))
    end = F.col("n") - F.col("batch") * size
    return spread.select(session, "batch", F.greatest(end - size, F.lit(0)).alias("start"), end.alias("end"))


def following_context(batches: DataFrame, segments: DataFrame, most: int = 8, session: str = "session_id") -> DataFrame:
    """Each backward batch with the labels of the next `most` segments that start at or after its end.

    segments: session, seg_idx (dense), start_action_idx, label. A batch's first following segment comes from the boundaries alone, and
    its context meets by equality of segment numbers, so nothing is compared pair by pair.
    """
    marks = batches.select(session, F.col("end").alias("at"), "batch", F.lit(None).cast("long").alias("seg")).unionByName(
        segments.select(session, F.col("start_action_idx").alias("at"), F.lit(None).cast("long").alias("batch"), F.col("seg_idx").cast("long").alias("seg"))
    )
    # Read from the end: at one place, segments come before the batch that they follow.
    placed = marks.withColumns({"_back": -F.col("at"), "_kind": F.col("batch").isNotNull().cast("int")})
    so = order_sessions(placed, session, ("_back", "_kind")).running(next=("min", F.col("seg")))
    first = so.df.where(F.col("batch").isNotNull()).select(session, "batch", "next")
    wanted = first.where(F.col("next").isNotNull()).select(session, "batch", F.explode(F.sequence(F.col("next"), F.col("next") + most - 1)).alias("seg_idx"))
    found = wanted.join(segments.select(session, F.col("seg_idx").cast("long").alias("seg_idx"), "label"), [session, "seg_idx"])
    lines = found.groupBy(session, "batch").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "label"))).alias("rows"))
    context = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["label"])), "\n")
    return batches.join(lines, [session, "batch"], "left").select(
        session, "batch", "start", "end", F.coalesce(F.size("rows"), F.lit(0)).alias("n_context"),
        F.coalesce(context, F.lit(END_OF_SESSION)).alias("context"),
    )


def recent_first(threads: DataFrame, session: str = "session_id") -> DataFrame:
    """Threads numbered by (last leaf, first leaf), latest first. threads: session, root_id, first_leaf_idx, last_leaf_idx."""
    order = Window.partitionBy(session).orderBy(F.desc("last_leaf_idx"), F.desc("first_leaf_idx"), "root_id")
    return threads.withColumn("place", F.row_number().over(order))


def related_only(trace: DataFrame, related: DataFrame, session: str = "session_id", item: str = "activity_id") -> DataFrame:
    """The trace's related rows; a session of which nothing is related keeps all its rows."""
    some = related.select(session).distinct().withColumn("_some", F.lit(True))
    hit = related.select(session, item).distinct().withColumn("_hit", F.lit(True))
    marked = trace.join(some, session, "left").join(hit, [session, item], "left")
    return marked.where(F.col("_some").isNull() | F.col("_hit")).drop("_some", "_hit")


def thread_results(threads: DataFrame, folder: str, outcomes: DataFrame | None = None) -> DataFrame:
    """One result row per thread: paths, ok, mode, activities, usage and cost. threads: session_id, root_id, activities, tokens, usd.

    outcomes (session_id, root_id, ok, execution_mode, model) tells how each thread's run ended; a thread without one has not run and isn't ok. Without
    that table, threads with activities count as run one by one.
    """
    name = F.concat_ws("/", F.lit(folder), "session_id", "root_id")
    paths = [F.concat(name, F.lit(".json")).alias("input_file"), F.concat(name, F.lit(".hierarchy.json")).alias("output_file")]
    if outcomes is None:
        rows, end = threads, [(F.col("activities") > 0).alias("ok"), F.lit("per_thread").alias("execution_mode")]
    else:
        told = outcomes.select("session_id", "root_id", F.col("ok").alias("_ok"), F.col("execution_mode").alias("_mode"), F.col("model").alias("_model"))
        rows = threads.join(told, ["session_id", "root_id"], "left")
        end = [F.coalesce("_ok", F.lit(False)).alias("ok"), F.col("_mode").alias("execution_mode"), F.col("_model").alias("model")]
    return rows.select(
        "session_id", "root_id", *paths, *end, F.col("activities").alias("activity_count"), F.col("tokens").alias("total_tokens"), F.round("usd", 8).alias("estimated_usd")
    )
