"""Enrichment item by item: which rows ask, what they send, and how partial answers fold back into their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import answers, text
from sessionloom.operators import resume
from sessionloom.operators.profiles import first_distinct

SESSION = "session_id"
Ask = Callable[[DataFrame], DataFrame]
VISUALS, VISUAL_CHARS = 12, 320


def answer_text(response: Column, field: str) -> Column:
    """A text field of a JSON answer, trimmed; null where the answer is no object, or the field is no text or blank."""
    value = F.try_variant_get(F.try_parse_json(answers.json_object_text(answers.without_thinking(response))), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", text.text_or_null(F.try_variant_get(value, "$", "string")))


def enrich_visuals(rows: DataFrame, ask: Ask, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Rows with richer visual content, and the new cache rows.

    Only rows with screen text (md_results) take part. A stored answer is used first; the rest asks, once for each distinct key; an answer that
    failed, is no object, or has no text leaves the row as it was. No other column changes.
    rows: session_id, action_id, action, goal, active_application, visual_content, md_results. `ask` takes request_id, operation, model and content, and
    gives request_id and response (null where the call failed).
    """
    needs = text.filled(text.strip(F.col("md_results")))
    known = resume.apply_cache(rows, cache, F.when(needs, resume.cache_key(F.lit(model))))
    waiting = known.where(F.col("cache_key").isNotNull() & ~F.col("cache_hit"))
    fields = {"objective": "goal", "active_application": "active_application", "visual_content": "visual_content", "md_results": "md_results"}
    payload = F.to_json(F.struct(*(text.or_empty(F.col(c)).alias(name) for name, c in fields.items())))
    requests = waiting.groupBy(F.col("cache_key").alias("request_id")).agg(F.min(payload).alias("content"))
    requests = requests.withColumns({"operation": F.lit("visual_enrichment"), "model": F.lit(model)})
    found = ask(requests).select(F.col("request_id").alias("cache_key"), answer_text(F.col("response"), "visual_content").alias("_new")).where(F.col("_new").isNotNull())
    out = known.join(found, "cache_key", "left").withColumn("enriched", F.col("cache_hit") | F.col("_new").isNotNull())
    out = out.withColumn("visual_content", F.coalesce("_new", "visual_content")).drop("_new", "cache_key", "cache_hit")
    return out, found.withColumnRenamed("_new", "enriched_visual_content")


def detail_requests(segments: DataFrame, rows: DataFrame, model: str) -> DataFrame:
    """One request for each segment, with its first distinct visual texts.

    segments: session_id, seg_idx, start_action_idx, end_action_idx, label. rows: session_id, idx, visual_content.
    """
    spread = segments.select(SESSION, "seg_idx", F.explode(F.sequence("start_action_idx", "end_action_idx")).alias("idx"))
    seen = spread.join(rows.select(SESSION, "idx", "visual_content"), [SESSION, "idx"])
    events = seen.groupBy(SESSION, "seg_idx").agg(F.count(F.lit(1)).alias("event_count"))
    texts = first_distinct(seen.withColumn("_t", text.collapse(text.or_empty(F.col("visual_content")))).where("_t <> ''"), [SESSION, "seg_idx"], "_t", "idx", VISUALS, "_texts")
    named = segments.select(SESSION, "seg_idx", "start_action_idx", "end_action_idx", "label")
    all_of = named.join(events, [SESSION, "seg_idx"], "left").join(texts, [SESSION, "seg_idx"], "left")
    short = F.transform(F.coalesce("_texts", F.array().cast("array<string>")), lambda t: text.truncate(t, VISUAL_CHARS))
    payload = F.struct(
        F.col("label").alias("semantic_action"), F.array("start_action_idx", "end_action_idx").alias("action_range"), F.coalesce("event_count", F.lit(0)).alias("event_count"),
        short.alias("visual_contents"),
    )
    return all_of.select(
        SESSION, "seg_idx", F.concat_ws("/", SESSION, F.col("seg_idx").cast("string")).alias("request_id"), F.lit("action_detail").alias("operation"),
        F.lit(model).alias("model"), F.to_json(payload).alias("content"),
    )


def with_details(segments: DataFrame, rows: DataFrame, ask: Ask, model: str) -> DataFrame:
    """Segments with `action_details`; a failed or wordless answer gives an empty text, the rest of the row is as it was."""
    requests = detail_requests(segments, rows, model)
    found = ask(requests).select("request_id", answer_text(F.col("response"), "action_details").alias("action_details"))
    named = requests.select(SESSION, "seg_idx", "request_id").join(found, "request_id").select(SESSION, "seg_idx", "action_details")
    return segments.join(named, [SESSION, "seg_idx"], "left").withColumn("action_details", text.or_empty(F.col("action_details")))
