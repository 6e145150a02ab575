"""Count windows over an ordered session: overlapping windows with tiling cores, forward batches, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.alignment import route

SESSION = "session_id"


def _trims(size: int, overlap: int) -> tuple[int, int, int, int]:
    size = max(1, size)
    overlap = max(0, min(overlap, size - 1))
    left = overlap // 2
    return size, max(1, size - overlap), left, overlap - left


def _window_bounds(number: Column, total: Column, size: int, overlap: int) -> dict[str, Column]:
    size, step, left, right = _trims(size, overlap)
    start = number * step
    end = F.least(total, start + size)
    core_start = F.when(start == 0, start).otherwise(F.least(end, start + left))
    core_end = F.when(end >= total, end).otherwise(F.greatest(core_start, end - right))
    return {"window_start": start, "window_end": end, "core_start": core_start, "core_end": core_end}


def window_total(total: Column, size: int, overlap: int) -> Column:
    """How many windows cover ``total`` rows: one if they fit, else until the end is reached."""
    size, step, _, _ = _trims(size, overlap)
    return F.when(total <= 0, 0).when(total <= size, 1).otherwise(F.ceil((total - size) / F.lit(step)) + 1).cast("bigint")


def count_windows(totals: DataFrame, size: int, overlap: int, total: str = "n") -> DataFrame:
    """Windows per session from its row count; cores of neighbouring windows tile the session."""
    numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), window_total(F.col(total), size, overlap) - 1))
    rows = totals.where(F.col(total) > 0).select(SESSION, total, numbers.alias("window_no"))
    rows = rows.withColumns(_window_bounds(F.col("window_no"), F.col(total), size, overlap))
    return rows.where(F.col("core_start") < F.col("core_end"))


def assign_windows(rows: DataFrame, size: int, overlap: int, index: str = "idx", total: str = "n") -> DataFrame:
    """Each row with every window that holds it (by arithmetic, no join) and whether it is in the core."""
    size, step, _, _ = _trims(size, overlap)
    last = window_total(F.col(total), size, overlap) - 1
    first_no = F.greatest(F.lit(0), F.ceil((F.col(index) - size + 1) / F.lit(step))).cast("bigint")
    last_no = F.least(F.floor(F.col(index) / F.lit(step)), last).cast("bigint")
    out = rows.withColumn("window_no", F.explode(F.sequence(first_no, last_no)))
    out = out.withColumns(_window_bounds(F.col("window_no"), F.col(total), size, overlap))
    return out.withColumn("in_core", (F.col(index) >= F.col("core_start")) & (F.col(index) < F.col("core_end")))


def stitch_windows(windows: DataFrame, groups: DataFrame) -> DataFrame:
    """Window-local groups to global segments clipped to the cores; a window without groups is one segment.

    groups: session_id, window_no, start_idx, end_idx (inside the window), label.
    """
    joined = windows.join(groups, [SESSION, "window_no"], "left")
    answered = F.col("start_idx").isNotNull()
    begin = F.when(answered, F.greatest(F.col("window_start") + F.col("start_idx"), F.col("core_start"))).otherwise(F.col("core_start"))
    finish = F.when(answered, F.least(F.col("window_start") + F.col("end_idx"), F.col("core_end") - 1)).otherwise(F.col("core_end") - 1)
    out = joined.select(SESSION, "window_no", begin.alias("start_action_idx"), finish.alias("end_action_idx"), "label")
    return out.where(F.col("start_action_idx") <= F.col("end_action_idx"))


def expected_merge_batches(total: Column, size: int, overlap: int, skip_single: bool) -> Column:
    """Batches a merge pass needs.  ``skip_single`` is the activity form, which stops before a last batch of one."""
    step = max(1, size - overlap)
    count = F.when(total <= size, 1).otherwise(F.ceil((total - size) / F.lit(step)) + 1).cast("bigint")
    if skip_single:
        last_start = (count - 1) * step
        count = F.when((total - last_start <= 1) & (count > 0), count - 1).otherwise(count)
    return F.when(total <= 1, F.lit(0)).otherwise(count).cast("bigint")


def preflight(rows: DataFrame, threads: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """What a run over each session would ask for, without a call: one row per session.

    rows: session_id, md_results, before_missing, cached, one per action; threads: session_id, n_activities, doc_bytes, one per task thread. sizes: (batch, overlap) of
    backward and merge. Segments aren't known before a run, so merge batches are an upper bound: one segment an action.
    """
    screen = F.length(F.trim(F.coalesce("md_results", F.lit("")))) > 0
    counted = rows.groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(screen).alias("enrichments"), F.count_if(screen & F.col("cached")).alias("enrichments_cached"),
        F.count_if(~F.col("before_missing")).alias("grounding_requests"),
    )
    n = F.col("actions")
    counted = counted.withColumns({
        "backward_windows": window_total(n, *sizes["backward"]), "most_merge_batches": expected_merge_batches(n, *sizes["merge"], skip_single=False),
    })
    routed = route(threads, inclusive=True).groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("threads"), F.count_if(F.col("route") == "direct").alias("direct_calls"), F.count_if(F.col("route") == "agent").alias("agent_runs")
    )
    out = counted.join(routed, SESSION, "full")
    return out.select(SESSION, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in out.columns if c != SESSION))


def prior_context(segments: DataFrame, batch_size: int, keep: int, index: str = "seg_idx", label: str = "label") -> DataFrame:
    """For every forward batch, the text of up to ``keep`` segments before it (older first)."""
    rows = segments.withColumn("_batch", F.floor(F.col(index) / F.lit(batch_size)))
    # A segment can only be context for the batches that start within ``keep`` places after it.
    reach = (keep + batch_size - 1) // batch_size
    shifted = rows.withColumn("batch_no", F.explode(F.array(*[F.col("_batch") + i for i in range(1, reach + 1)])))
    near = shifted.where(F.col(index) >= F.col("batch_no") * batch_size - keep)
    context = near.groupBy(SESSION, "batch_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, label))), lambda p: F.concat(F.lit("- "), p[label])), "\n").alias("context"),
        F.count(F.lit(1)).alias("n_context"),
    )
    batches = rows.groupBy(SESSION, F.col("_batch").alias("batch_no")).agg(F.count(F.lit(1)).alias("n_segments"))
    out = batches.join(context, [SESSION, "batch_no"], "left")
    return out.withColumns({"context": F.coalesce("context", F.lit("Start of session.")), "n_context": F.coalesce("n_context", F.lit(0))})


def recent_rows(rows: DataFrame, keep: int, index: str) -> DataFrame:
    """Last ``keep`` rows of every session.  The rank limit is applied before the shuffle."""
    w = Window.partitionBy(SESSION).orderBy(F.col(index).desc())
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= keep)
