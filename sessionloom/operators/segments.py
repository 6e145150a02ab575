"""Segments over an ordered session: merging, labels, roll-ups, answer checks and repairs, cache checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.functions.bind import let
from sessionloom.operators.sequence import SessionOrder, islands

SESSION = "session_id"


# ---- merging ---------------------------------------------------------------------------------


def merge_groups(candidates: SessionOrder, ranges: DataFrame) -> SessionOrder:
    """Number the groups that result when every range joins the candidates it spans.

    candidates: ordered rows with seg_idx.  ranges: session_id, start_idx, end_idx over seg_idx; ranges
    of any batch may overlap, chain or nest.  Only borders are exploded, never pairs.
    """
    usable = ranges.where(F.col("start_idx") < F.col("end_idx"))
    # A border i joins candidate i to candidate i + 1, so candidate i + 1 does not open a group.
    joined = usable.select(SESSION, F.explode(F.sequence(F.col("start_idx") + 1, F.col("end_idx"))).alias("seg_idx")).distinct()
    marked = candidates.rows.join(joined.withColumn("_joined", F.lit(True)), [SESSION, "seg_idx"], "left")
    so = candidates.derive(marked)
    so = islands(so, F.col("_joined").isNull(), "group_no")
    return so.derive(so.rows.drop("_joined"))


def group_labels(groups: DataFrame, ranges: DataFrame, members: DataFrame) -> DataFrame:
    """Best label per group: the range equal to the group, else the widest inside it, first on ties.

    groups: session_id, group_no, first_idx, last_idx.  members: session_id, seg_idx, group_no.
    A range lies in the group of its first candidate.
    """
    inside = ranges.where(F.col("start_idx") < F.col("end_idx")).join(
        members.select(SESSION, F.col("seg_idx").alias("start_idx"), "group_no"), [SESSION, "start_idx"]
    )
    fitted = inside.join(groups, [SESSION, "group_no"])
    exact = (F.col("start_idx") == F.col("first_idx")) & (F.col("end_idx") == F.col("last_idx"))
    rank = F.struct((~exact).cast("int"), (F.col("start_idx") - F.col("end_idx")), F.col("range_order"))
    # For an exact range only the order counts; its width is the group's.
    return fitted.groupBy(SESSION, "group_no").agg(F.min_by("label", rank).alias("merge_label"))


def collapse_groups(members: SessionOrder, labels: DataFrame, max_context: int = 1200) -> DataFrame:
    """One row per group: bounds, label (range label, else last, else first) and clipped joined context."""
    # A candidate's own label and context; members: seg_idx, group_no, label, context, start/end_action_idx.
    order = F.col("seg_idx")
    grouped = members.rows.groupBy(SESSION, "group_no").agg(
        F.min(order).alias("first_idx"),
        F.max(order).alias("last_idx"),
        F.min("start_action_idx").alias("start_action_idx"),
        F.max("end_action_idx").alias("end_action_idx"),
        F.min_by("label", order).alias("_first"),
        F.max_by("label", order).alias("_last"),
    )
    # Every non-blank context gives at least one character and a blank, so the first ``max_context`` of
    # them decide the clipped text; a group of any size is cut to that many rows before it is collected.
    told = members.rows.where(text.filled(text.strip(F.col("context")))).select(SESSION, "group_no", "seg_idx", "context")
    told = top_ranked(told, [SESSION, "group_no"], [order], max_context)
    joined = told.groupBy(SESSION, "group_no").agg(
        text.clip(F.array_join(text.ordered_collect(order, F.col("context")), " "), max_context).alias("context")
    )
    grouped = grouped.join(joined, [SESSION, "group_no"], "left").withColumn("context", F.coalesce("context", F.lit("")))
    best = F.coalesce(text.text_or_null(F.col("merge_label")), text.text_or_null(F.col("_last")), text.text_or_null(F.col("_first")))
    out = grouped.join(labels, [SESSION, "group_no"], "left")
    return out.withColumn("label", F.coalesce(best, F.lit("Unclassified semantic action"))).drop("_first", "_last", "merge_label")


# ---- roll-up ---------------------------------------------------------------------------------


def first_seen(rows: DataFrame, keys: list[str], value: Column, order: str) -> DataFrame:
    """Distinct non-empty values per group with the place where each was first seen."""
    named = rows.select(*keys, F.col(order).alias("_o"), text.text_or_null(value).alias("value"))
    return named.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.min("_o").alias("first_at"))


def roll_up(rows: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Evidence of a segment from its action rows.

    rows: keys, order, action_id, app, entity, ocr, state_before, state_after.  Lists hold distinct
    non-empty texts in order of first sight; pre is the first and post the last known state.
    """
    o = F.col(order)
    lists = {"raw_action_ids": "action_id", "apps_used": "app", "entities": "entity", "ocr_texts": "ocr"}
    return rows.groupBy(*keys).agg(
        F.min(o).alias("start_action_idx"),
        F.max(o).alias("end_action_idx"),
        F.min_by("action_id", o).alias("start_action_id"),
        F.max_by("action_id", o).alias("end_action_id"),
        *[text.ordered_distinct(order, src).alias(name) for name, src in lists.items()],
        F.coalesce(F.min_by("state_before", F.when(text.filled(F.col("state_before")), o)), F.lit("")).alias("pre_state"),
        F.coalesce(F.max_by("state_after", F.when(text.filled(F.col("state_after")), o)), F.lit("")).alias("post_state"),
        F.count(F.lit(1)).alias("event_count"),
    )


# ---- checks and repairs of grouping answers --------------------------------------------------


def _ranges_checked(ranges: DataFrame, batches: DataFrame, min_width: int) -> DataFrame:
    size = F.col("batch_size")
    rows = ranges.join(batches, [SESSION, "batch_no"])
    outside = (F.col("start_idx") < 0) | (F.col("end_idx") < 0) | (F.col("start_idx") >= size) | (F.col("end_idx") >= size)
    narrow = ~outside & (F.col("end_idx") - F.col("start_idx") + 1 < min_width)
    return rows.withColumns({"_outside": outside, "_narrow": narrow})


def _range_report(ranges: DataFrame, batches: DataFrame, min_width: int, cover: bool, needs_text: bool) -> DataFrame:
    checked = _ranges_checked(ranges, batches, min_width)
    good = ~F.col("_outside") & ~F.col("_narrow")
    no_text = good & (F.trim(F.coalesce("label", F.lit(""))) == "")
    counts = checked.groupBy(SESSION, "batch_no").agg(
        F.count(F.lit(1)).alias("n_ranges"),
        F.count_if(F.col("_outside")).alias("out_of_range"),
        F.count_if(F.col("_narrow")).alias("bad_width"),
        F.count_if(no_text).alias("missing_text"),
    )
    places = checked.where(good).select(SESSION, "batch_no", F.explode(F.sequence("start_idx", "end_idx")).alias("place"))
    per_place = places.groupBy(SESSION, "batch_no", "place").agg(F.count(F.lit(1)).alias("times"))
    covered = per_place.groupBy(SESSION, "batch_no").agg(
        F.count(F.lit(1)).alias("covered"), F.count_if(F.col("times") > 1).alias("overlapping")
    )
    out = batches.join(counts, [SESSION, "batch_no"], "left").join(covered, [SESSION, "batch_no"], "left")
    names = ["n_ranges", "out_of_range", "bad_width", "missing_text", "covered", "overlapping"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    out = out.withColumn("missing", F.col("batch_size") - F.col("covered") if cover else F.lit(0).cast("bigint"))
    valid = (F.col("out_of_range") == 0) & (F.col("bad_width") == 0) & (F.col("overlapping") == 0)
    if cover:
        valid = valid & (F.col("missing") == 0) & (F.col("n_ranges") > 0)
    if needs_text:
        valid = valid & (F.col("missing_text") == 0)
    return out.withColumn("valid", valid).drop("covered")


def check_groups(groups: DataFrame, batches: DataFrame, needs_text: bool = False) -> DataFrame:
    """Per batch: are the groups in range, ordered, disjoint and covering?"""
    return _range_report(groups, batches, 1, cover=True, needs_text=needs_text)


def check_merges(ranges: DataFrame, batches: DataFrame) -> DataFrame:
    """Per batch: are the merge ranges in range, at least two wide and disjoint?"""
    return _range_report(ranges, batches, 2, cover=False, needs_text=False)


def _first_come(ranges: Column) -> Column:
    """Drop ranges that touch one kept before; the input is sorted by start, so only the last end matters."""
    empty = F.slice(ranges, 1, 0)

    def step(kept: Column, item: Column) -> Column:
        clear = F.size(kept) == 0
        last_end = F.coalesce(F.try_element_at(kept, F.lit(-1))["end_idx"], F.lit(-1))
        return F.when(clear | (item["start_idx"] > last_end), F.concat(kept, F.array(item))).otherwise(kept)

    return F.aggregate(ranges, empty, step)


def _batch_ranges(rows: DataFrame) -> DataFrame:
    item = F.struct("start_idx", "range_order", "end_idx", "label")
    return rows.groupBy(SESSION, "batch_no", "batch_size").agg(F.array_sort(F.collect_list(item)).alias("ranges"))


def repair_merges(ranges: DataFrame, batches: DataFrame) -> DataFrame:
    """Keep the usable merge ranges of each batch, first come first served."""
    checked = _ranges_checked(ranges, batches, 2).where(~F.col("_outside") & ~F.col("_narrow"))
    kept = _batch_ranges(checked).withColumn("r", F.explode(_first_come(F.col("ranges"))))
    return kept.select(SESSION, "batch_no", "r.start_idx", "r.end_idx", "r.label")


def repair_groups(groups: DataFrame, batches: DataFrame) -> DataFrame:
    """Clamp groups to the batch, keep the first of any that overlap, and fill holes with single rows."""
    rows = groups.join(batches, [SESSION, "batch_no"], "right")
    last = F.col("batch_size") - 1
    start = F.greatest(F.lit(0), F.least(last, F.col("start_idx")))
    end = F.greatest(start, F.least(last, F.col("end_idx")))
    sort_key = F.struct(F.col("start_idx").alias("given_start"), "range_order")
    item = F.struct(sort_key.alias("k"), start.alias("start_idx"), end.alias("end_idx"), "label")
    packed = rows.groupBy(SESSION, "batch_no", "batch_size").agg(
        F.array_sort(F.collect_list(F.when(F.col("start_idx").isNotNull(), item))).alias("ranges")
    )
    plain = F.transform(F.col("ranges"), lambda r: F.struct(r["start_idx"], r["end_idx"], r["label"]))

    def fill(kept: Column) -> Column:
        covered = F.flatten(F.transform(kept, lambda r: F.sequence(r["start_idx"], r["end_idx"])))
        holes = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("batch_size") - 1), covered)
        singles = F.transform(holes, lambda h: F.struct(h.alias("start_idx"), h.alias("end_idx"), F.lit("").alias("label")))
        return F.concat(kept, singles)

    out = packed.withColumn("r", F.explode(let(_first_come(plain), fill)))
    return out.select(SESSION, "batch_no", "r.start_idx", "r.end_idx", "r.label")


# ---- fingerprints and cached segmentations ---------------------------------------------------

FAN_OUT = 1024


def fingerprint(rows: DataFrame, fields: list[str], index: str = "idx") -> DataFrame:
    """SHA-256 of a session's ordered rows.

    Row digests are hashed in blocks of 1024, blocks in blocks of 1024, and so on, so that no task
    ever holds more than 1024 digests of a session however long it is.
    """
    canonical = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    level = rows.select(SESSION, F.col(index).alias("_i"), F.sha2(canonical, 256).alias("_d"))
    for _ in range(4):
        level = level.groupBy(SESSION, F.floor(F.col("_i") / FAN_OUT).alias("_i")).agg(
            F.sha2(F.array_join(text.ordered_collect("_i", "_d"), ""), 256).alias("_d")
        )
    return level.select(SESSION, F.col("_d").alias("input_fingerprint"))


def cache_verdict(
    cached: SessionOrder,
    rows: DataFrame,
    cached_meta: DataFrame,
    current: DataFrame,
    index: str = "idx",
    row_id: str = "action_id",
) -> DataFrame:
    """Whether a stored segmentation still fits its input, per session.

    cached: ordered by seg_idx, with segment_id, start_idx, end_idx, start_id, end_id.  cached_meta:
    session_id, n_rows, input_fingerprint as stored.  current: the same two, computed now.  The ranges
    must be an exact ordered partition, stored border ids must agree, ids must be unique.
    """
    so = cached.neighbours(prev={"_prev_end": "end_idx"})
    at = lambda side: rows.select(SESSION, F.col(index).alias(f"{side}_idx"), F.col(row_id).alias(f"_{side}_now"))
    joined = so.df.join(at("start"), [SESSION, "start_idx"], "left").join(at("end"), [SESSION, "end_idx"], "left")
    agree = lambda side: (
        ~text.filled(F.col(f"{side}_id")) | ~text.filled(F.col(f"_{side}_now")) | (F.col(f"{side}_id") == F.col(f"_{side}_now"))
    )
    fits = (F.col("start_idx") == F.coalesce(F.col("_prev_end") + 1, F.lit(0))) & (F.col("end_idx") >= F.col("start_idx"))
    ids = joined.groupBy(SESSION, "segment_id").agg(F.count(F.lit(1)).alias("_same"))
    repeated = ids.groupBy(SESSION).agg(F.max("_same").alias("_same"))
    parts = joined.groupBy(SESSION).agg(
        F.bool_and(F.coalesce(fits & agree("start") & agree("end"), F.lit(False))).alias("_fits"), F.max("end_idx").alias("_last")
    )
    now = current.withColumnsRenamed({"n_rows": "_n_now", "input_fingerprint": "_print_now"})
    out = cached_meta.join(now, SESSION, "left").join(parts, SESSION, "left").join(repeated, SESSION, "left")
    valid = (
        (F.col("n_rows") == F.col("_n_now")) & (F.col("input_fingerprint") == F.col("_print_now"))
        & F.col("_fits") & (F.col("_last") == F.col("_n_now") - 1) & (F.col("_same") == 1)
    )
    return out.select(SESSION, F.coalesce(valid, F.lit(False)).alias("reusable"))


def rows_of_segments(segments: DataFrame, rows: DataFrame, index: str = "idx") -> DataFrame:
    """Rows with the segment whose inclusive range holds them (ranges expanded, equal join)."""
    spread = segments.withColumn(index, F.explode(F.sequence("start_idx", "end_idx")))
    return spread.join(rows, [SESSION, index])


def top_ranked(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """First ``keep`` rows per group; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= keep).drop("_rank")
