"""Writers.  Every output is a table partitioned by session; nothing is gathered into one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.sequence import SessionOrder
from sessionloom.operators.trees import MODEL

SESSION = "session_id"


def relative_path(path: Column, folder: Column) -> Column:
    """Path inside the session folder; paths elsewhere stay as they are."""
    prefix = F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"))
    return F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def trajectory_rows(so: SessionOrder, folder: Column | None = None) -> DataFrame:
    """Action rows in their stored form: ids n1, n2, ... and session-relative screenshot paths."""
    rows = so.index("_n", start=1).df
    paths = {c: (relative_path(F.col(c), folder) if folder is not None else F.col(c)) for c in ("before", "after")}
    return rows.select(
        SESSION, F.concat(F.lit("n"), F.col("_n").cast("string")).alias("id"), "action", paths["before"].alias("state_before"), paths["after"].alias("state_after"),
        "time_before", "time_after", "time_range",
    )


def write_json(rows: DataFrame, path: str, keys: tuple[str, ...] = (SESSION,), mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy(*keys).json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append-only log of progress or cache rows."""
    rows.write.mode("append").parquet(path)


def write_with_meta(rows: DataFrame, meta: DataFrame, path: str) -> None:
    """Segments or activities, and one meta row per session beside them."""
    rows.write.mode("overwrite").partitionBy(SESSION).parquet(f"{path}/rows")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def write_thread_documents(documents: DataFrame, manifest: DataFrame, path: str) -> None:
    """Thread members as JSON lines, one folder per thread, and the manifest with its counts."""
    write_json(documents, f"{path}/documents", (SESSION, "canonical_root_id"))
    write_json(manifest, f"{path}/manifest")


def merged_output(results: DataFrame, unique_roots: bool = False) -> DataFrame:
    """One summary row per session over its root results: counts and cost.

    results: session_id, root_id, ok, estimated_usd.  ``unique_roots`` fails on a repeated root id.
    """
    per_root = results.groupBy(*MODEL).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("ok").alias("_ok"), F.sum(F.col("estimated_usd").cast("decimal(28,12)")).alias("_usd")
    )
    if unique_roots:
        message = F.concat(F.lit("duplicate root id "), F.col("root_id"), F.lit(" in session "), F.col(SESSION))
        per_root = per_root.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(message).cast("bigint")).otherwise(F.col("_n")))
    return per_root.groupBy(SESSION).agg(
        F.sum("_n").alias("root_count"), F.sum("_ok").alias("ok_count"), F.round(F.coalesce(F.sum("_usd"), F.lit(0)).cast("double"), 6).alias("estimated_usd")
    )


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text, one folder per model, sorted inside it by their key."""
    ordered = lines.repartition(*MODEL).sortWithinPartitions(*MODEL, "sort_key")
    ordered.select(*MODEL, "line").write.mode("overwrite").partitionBy(*MODEL).text(path)


def write_costs(breakdown: DataFrame, path: str) -> None:
    breakdown.write.mode("overwrite").parquet(path)
