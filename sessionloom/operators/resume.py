"""Resuming enrichment: which rows are done, which are stale, and how cached answers rejoin the trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text

SESSION = "session_id"
KEY = "provenounce_id"  # spelled as in the stored files
SOURCE_FIELDS = ["id", "action", "state_before", "state_after", "time_before", "time_after", "time_range"]


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Latest row per key.  An aggregate, so that repeats are dropped before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*")


def stored_outputs(output: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Stored rows by id, the last one winning, with progress rows over finished ones.

    Both tables: session_id, provenounce_id, line_no, ...
    """
    rows = output.withColumn("_turn", F.lit(0))
    if progress is not None:
        rows = rows.unionByName(progress.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    rows = rows.where(F.col(KEY).isNotNull())
    return last_wins(rows, [SESSION, KEY], F.struct("_turn", "line_no")).drop("_turn")


def done_ids(*tables: DataFrame) -> DataFrame:
    """Ids with a successful row in any of the tables."""
    parts = [t.where((F.col("status") == "success") & text.filled(F.col(KEY))).select(SESSION, KEY) for t in tables]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.distinct()


def worklist(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Raw entries without a successful stored row made from exactly the same source fields.

    A stored row without ``id`` comes from before sources were kept and counts as a match.
    """
    cached = stored.where(F.col("status") == "success").select(
        SESSION, F.col(KEY).alias("_key"), *[F.col(c).alias(f"_{c}") for c in SOURCE_FIELDS]
    )
    same = F.col("_id").isNull()
    exact = F.lit(True)
    for c in SOURCE_FIELDS:
        exact = exact & F.col(c).eqNullSafe(F.col(f"_{c}"))
    condition = (entries[SESSION] == cached[SESSION]) & (F.col("id") == F.col("_key")) & (same | exact)
    return entries.join(cached, condition, "left_anti")


def rejoin(entries: DataFrame, stored: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored answers in raw order: raw fields overwrite, stale ids drop, missing ones are skipped.

    entries: session_id, original_index and the source fields.
    """
    rows = entries if limit is None else entries.where(F.col("original_index") < limit)
    answers = stored.drop(*SOURCE_FIELDS, "original_index").withColumnRenamed(KEY, "id")
    return rows.join(answers, [SESSION, "id"]).withColumn(KEY, F.col("id"))


def duplicate_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def response_rows(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """Grounded rows: raw columns always copied; an answer gives a success, an error text an error row.

    answers: session_id, id, goal, active_application, visual_content, md_results, warnings, ocr_warnings, error.
    """
    joined = entries.join(answers, [SESSION, "id"], "left")
    failed = F.col("error").isNotNull()
    warned = F.when(F.size("warnings") > 0, F.col("warnings")).otherwise(F.col("ocr_warnings"))
    return joined.withColumns({"status": F.when(failed, "error").otherwise("success"), "warnings": warned, KEY: F.col("id")}).drop("ocr_warnings")


def cache_key(model: Column) -> Column:
    """SHA-256 over the model and everything its enrichment answer depends on."""
    parts = ["action_id", "action", "goal", "active_application", "visual_content"]
    body = F.struct(
        F.lit(1).alias("version"), model.alias("model"), *[text.or_empty(F.col(c)).alias(c) for c in parts],
        F.sha2(text.or_empty(F.col("md_results")), 256).alias("md_results_sha256"),
    )
    return F.sha2(F.to_json(body), 256)


def apply_cache(rows: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Cached texts replace visible content; ``cache_hit`` is false for rows still to be asked.

    cache: cache_key, enriched_visual_content, line_no (last non-empty value wins).
    """
    usable = cache.where(text.filled(text.strip(F.col("enriched_visual_content")))).select("cache_key", "enriched_visual_content", "line_no")
    latest = last_wins(usable, ["cache_key"], F.col("line_no")).drop("line_no")
    out = rows.withColumn("cache_key", key).join(latest, "cache_key", "left")
    return out.withColumns(
        {
            "cache_hit": F.col("enriched_visual_content").isNotNull(),
            "visual_content": F.coalesce(text.strip(F.col("enriched_visual_content")), F.col("visual_content")),
        }
    ).drop("enriched_visual_content")


def counters(entries: DataFrame, waiting: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per session: rows loaded, skipped, ready, missing screenshots, successes and errors."""
    loaded = entries.groupBy(SESSION).agg(F.count(F.lit(1)).alias("loaded"))
    ready = waiting.groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("ready"), F.count_if("missing_before").alias("missing_before"), F.count_if("missing_after").alias("missing_after")
    )
    done = outputs.groupBy(SESSION).agg(
        F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "error").alias("error")
    )
    out = loaded.join(ready, SESSION, "left").join(done, SESSION, "left")
    names = ["ready", "missing_before", "missing_after", "success", "error"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return out.withColumn("skipped", F.col("loaded") - F.col("ready"))
