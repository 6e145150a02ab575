"""Raw input events to action rows: run merging, timing, state repair, trimming, double clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import keys
from sessionloom.functions.timefn import path_epoch
from sessionloom.operators.sequence import SLICE, SessionOrder, order_sessions

SESSION = "session_id"


def label_runs(actions: DataFrame, enable_hotkey: bool = True, order: tuple[str, ...] = ("ts", "line_no")) -> SessionOrder:
    """Every kept event with the number of the merged row it belongs to (1-based, dense).

    Neighbouring key presses share a run; a hotkey press opens a new run.  A scroll equal to the
    scroll just before it is dropped.  All other events stand alone.
    """
    rows = actions.withColumn("kind", keys.merge_kind(F.col("action")))
    so = order_sessions(rows, SESSION, order).neighbours(prev={"prev_kind": "kind", "prev_action": "action"})
    is_key = F.col("kind") == "key"
    repeated_scroll = (F.col("kind") == "scroll") & F.col("prev_action").eqNullSafe(F.col("action"))
    joins_previous = is_key & F.col("prev_kind").eqNullSafe(F.lit("key"))
    if enable_hotkey:
        joins_previous = joins_previous & ~keys.is_hotkey(F.col("action"))
    so = so.where(~repeated_scroll).with_columns({"starts_run": ~joins_previous})
    so = so.with_columns({"token": F.when(is_key, keys.key_token(F.col("action")))})
    # A backspace directly after a token belongs to that token's piece; the first row of a run always opens one.
    so = so.with_columns({"starts_piece": F.col("starts_run") | (F.col("token") != keys.BACKSPACE)})
    so = so.running(
        run_id=("sum", F.col("starts_run").cast("bigint")),
        piece_id=("sum", F.col("starts_piece").cast("bigint")),
    )
    return so.derive(so.rows.drop("prev_kind", "prev_action"))


def merge_runs(actions: DataFrame, enable_hotkey: bool = True, order: tuple[str, ...] = ("ts", "line_no")) -> SessionOrder:
    """One row per run: composed action text, first and last event, times, event count."""
    return collapse_runs(label_runs(actions, enable_hotkey, order), order)


def collapse_runs(so: SessionOrder, order: tuple[str, ...] = ("ts", "line_no")) -> SessionOrder:
    position = F.struct(*order)
    slice_agg = [F.min(SLICE).alias(SLICE)] if so.sliced else []
    pieces = so.rows.groupBy(SESSION, "run_id", "piece_id").agg(
        F.min_by(F.struct("kind", "action", "ts", "token"), position).alias("head"),
        F.max_by(F.struct("action", "ts"), position).alias("tail"),
        F.count(F.lit(1)).alias("n"),
        *slice_agg,
    )
    kept = F.length("head.token") - (F.col("n") - 1)
    pieces = pieces.withColumn("text", F.substr(F.col("head.token"), F.lit(1), F.greatest(kept, F.lit(0)).cast("int")))
    ordered_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_id", "text"))), lambda p: p["text"]), "")
    runs = pieces.groupBy(SESSION, "run_id").agg(
        F.min_by("head", "piece_id").alias("head"),
        F.max_by("tail", "piece_id").alias("tail"),
        F.sum("n").alias("n_events"),
        ordered_text.alias("typed"),
        *slice_agg,
    )
    is_key = F.col("head.kind") == "key"
    runs = runs.select(
        SESSION,
        "run_id",
        F.concat(F.lit("n"), F.col("run_id").cast("string")).alias("id"),
        F.col("head.kind").alias("kind"),
        F.when(is_key, F.concat(F.lit("key_press('"), F.col("typed"), F.lit("')"))).otherwise(F.col("head.action")).alias("action"),
        F.col("head.action").alias("first_action"),
        F.col("tail.action").alias("last_action"),
        F.col("head.ts").alias("ts_before"),
        F.col("tail.ts").alias("ts_after"),
        "n_events",
        *([SLICE] if so.sliced else []),
    )
    return so.derive(runs, order=("run_id",))


def _present(path: Column) -> Column:
    return path.isNotNull() & (path != "")


def measure_times(so: SessionOrder, before: str = "before", after: str = "after") -> SessionOrder:
    """Add time_before, time_after, time_range, time_diff from the screenshot paths; unknown is 0."""
    so = so.neighbours(prev={"_prev_before": before, "_prev_after": after, "_prev_row": so.order[0]})
    own_before = F.coalesce(path_epoch(F.col(before)), F.lit(0.0))
    own_after = F.coalesce(path_epoch(F.col(after)), F.lit(0.0))
    last_path = F.when(_present(F.col("_prev_after")), F.col("_prev_after")).otherwise(F.col("_prev_before"))
    so = so.with_columns(
        {
            "time_before": F.when(own_before != 0, own_before).otherwise(own_after),
            "time_after": F.when(own_after != 0, own_after).otherwise(own_before),
            "_last": F.coalesce(path_epoch(last_path), F.lit(0.0)),
        }
    )
    known = F.col("_prev_row").isNotNull() & (F.col("_last") != 0) & (F.col("time_before") != 0)
    so = so.with_columns(
        {
            "time_range": F.col("time_after") - F.col("time_before"),
            "time_diff": F.when(known, F.col("time_before") - F.col("_last")).otherwise(F.lit(0.0)),
        }
    )
    return so.derive(so.rows.drop("_prev_before", "_prev_after", "_prev_row", "_last"))


def repair_states(so: SessionOrder, before: str = "before", after: str = "after") -> SessionOrder:
    """Fill a missing before from the previous after, and take the next before as the after state."""
    so = so.neighbours(prev={"_prev_after": after}, next={"_next_before": before, "_next_row": so.order[0]})
    action = F.col("action")
    own_before, own_after = F.col(before), F.col(after)
    new_before = F.when(own_before.isNotNull() | keys.is_key(action), own_before).otherwise(F.col("_prev_after"))
    use_next = ~keys.is_drag(action) & F.col("_next_row").isNotNull() & _present(F.col("_next_before"))
    so = so.with_columns({"_b": new_before, "_a": F.when(use_next, F.col("_next_before")).otherwise(own_after)})
    so = so.with_columns({before: F.col("_b"), after: F.col("_a")})
    return so.derive(so.rows.drop("_b", "_a", "_prev_after", "_next_before", "_next_row"))


def trim_to_complete(so: SessionOrder, before: str = "before", after: str = "after") -> SessionOrder:
    """Keep the rows from the first to the last one that has both states; keep all if none has."""
    complete = _present(F.col(before)) & _present(F.col(after))
    position = F.struct(*so.order)
    at = F.when(complete, position)
    so = so.totals(_from=("min", at), _to=("max", at))
    so = so.where(F.col("_from").isNull() | ((position >= F.col("_from")) & (position <= F.col("_to"))))
    return so.derive(so.rows.drop("_from", "_to"))


def merge_double_clicks(
    so: SessionOrder,
    max_gap: float = 0.5,
    max_distance: float = 10.0,
    keep_last: bool = True,
) -> SessionOrder:
    """Pair neighbouring clicks greedily from the left and replace each pair by one row.

    The pairable rows form islands; the rows at even places of an island open a pair, which is what
    a left-to-right scan finds.  The recorder's scan leaves out a session's last row unless it closes
    a pair; ``keep_last=True`` keeps that row, so that no action is lost.
    """
    so = so.index("_i").with_columns({"_x": keys.click_x(F.col("action")), "_y": keys.click_y(F.col("action"))})
    following = {
        "_n_action": "action",
        "_n_x": "_x",
        "_n_y": "_y",
        "_n_diff": "time_diff",
        "_n_after": "after",
        "_n_time_after": "time_after",
        "_n_range": "time_range",
        "_n_i": "_i",
    }
    so = so.neighbours(next=following)
    dx, dy = F.col("_n_x") - F.col("_x"), F.col("_n_y") - F.col("_y")
    pairs = (
        keys.is_click(F.col("action"))
        & keys.is_click(F.col("_n_action"))
        & (F.col("_n_diff") <= max_gap)
        & (F.sqrt(dx * dx + dy * dy) < max_distance)
    )
    so = so.with_columns({"_pairs": F.coalesce(pairs, F.lit(False))})
    so = so.neighbours(prev={"_prev_pairs": "_pairs"})
    so = so.with_columns({"_prev_pairs": F.coalesce("_prev_pairs", F.lit(False))})
    so = so.running(_island=("max", F.when(F.col("_pairs") & ~F.col("_prev_pairs"), F.col("_i"))))
    place = F.col("_i") - F.col("_island")
    opens = F.col("_pairs") & (place % 2 == 0)
    closes = F.col("_prev_pairs") & ((place - 1) % 2 == 0)
    so = so.with_columns({"is_double": F.coalesce(opens, F.lit(False)), "_closes": F.coalesce(closes, F.lit(False))})
    keep = ~F.col("_closes")
    if not keep_last:
        keep = keep & F.col("_n_i").isNotNull()
    so = so.where(keep)
    double = F.col("is_double")
    merged = {
        "action": F.when(double, F.concat(F.lit("double_click("), F.split("action", r"\(")[1])).otherwise(F.col("action")),
        "after": F.when(double, F.col("_n_after")).otherwise(F.col("after")),
        "time_after": F.when(double, F.col("_n_time_after")).otherwise(F.col("time_after")),
        "time_range": F.when(double, F.col("time_range") + F.col("_n_range")).otherwise(F.col("time_range")),
        "time_diff": F.when(double, F.col("time_diff") + F.col("_n_diff")).otherwise(F.col("time_diff")),
    }
    so = so.with_columns(merged)
    return so.derive(so.rows.drop("_i", "_x", "_y", *following, "_pairs", "_prev_pairs", "_island", "_closes"))


def press_release(events: DataFrame, min_distance: float = 5.0) -> DataFrame:
    """Mouse presses paired with their release: a drag on the same monitor, else a click at the press point.

    A press replaces an open one, so the first matching release after the latest press is its own.
    events: kind (press, release), button, x, y, monitor.
    """
    so = order_sessions(events, SESSION, ("ts", "line_no"))
    so = so.running(_press=("sum", (F.col("kind") == "press").cast("bigint"))).where(F.col("_press") > 0)
    place = F.struct("ts", "line_no")
    here = F.struct("line_no", "x", "y", "button", "monitor")
    is_press = F.col("kind") == "press"
    pairs = so.rows.groupBy(SESSION, "_press", "button").agg(
        F.min(F.when(is_press, here)).alias("p"), F.min_by(F.when(~is_press, here), F.when(~is_press, place)).alias("r")
    ).where(F.col("p").isNotNull() & F.col("r").isNotNull())
    dx, dy = F.col("r.x") - F.col("p.x"), F.col("r.y") - F.col("p.y")
    drag = (F.col("p.monitor") == F.col("r.monitor")) & (F.sqrt(dx * dx + dy * dy) > min_distance)
    return pairs.select(
        SESSION, F.col("p.line_no").alias("press_line"), F.col("r.line_no").alias("release_line"),
        F.concat(F.when(drag, "drag_").otherwise("click_"), F.col("button")).alias("action"), F.col("p.x").alias("x"), F.col("p.y").alias("y"),
        F.when(drag, F.col("r.x")).alias("end_x"), F.when(drag, F.col("r.y")).alias("end_y"),
    )


def session_duration(events: DataFrame, ts: str = "ts", line: str = "line_no") -> DataFrame:
    """Whole seconds between the first and last numeric timestamp in file order; 0 if not rising."""
    numeric = events.where(F.col(ts).isNotNull())
    ends = numeric.groupBy(SESSION).agg(F.min_by(ts, line).alias("_first"), F.max_by(ts, line).alias("_last"))
    span = F.col("_last") - F.col("_first")
    return ends.select(SESSION, F.when(span > 0, F.floor(span)).otherwise(F.lit(0)).cast("bigint").alias("duration_seconds"))


def trajectory(so: SessionOrder) -> SessionOrder:
    """Matched runs to final action rows: time, trim, repair, re-measure the range, pair clicks.

    The gap used for pairing comes from the states as matched; only the range is measured again.
    """
    so = trim_to_complete(measure_times(so))
    so = repair_states(so)
    so = so.with_columns({"_tb": F.col("time_before"), "_ta": F.col("time_after"), "_td": F.col("time_diff")})
    so = measure_times(so)
    so = so.with_columns({"time_before": F.col("_tb"), "time_after": F.col("_ta"), "time_diff": F.col("_td")})
    return merge_double_clicks(so.derive(so.rows.drop("_tb", "_ta", "_td")))
