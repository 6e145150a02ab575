"""Usage and cost roll-ups over the call ledger (one row per model call)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.cost import TOKEN_KEYS


def usage_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the token columns per group; fractions are cut before adding, zero sums become null."""
    present = [c for c in TOKEN_KEYS if c in calls.columns]
    return calls.groupBy(*keys).agg(
        *[F.nullif(F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))), F.lit(0)).alias(c) for c in present]
    )


def cost_breakdown(calls: DataFrame) -> DataFrame:
    """Totals per (session, stage, operation), per (session, stage) and over everything.

    ``grain`` names the level.  The model shown for an operation is the one of its first call.
    """
    sums = {c: F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(c) for c in TOKEN_KEYS[1:]}
    grouped = calls.groupingSets(
        [["session_id", "stage", "operation"], ["session_id", "stage"], []], "session_id", "stage", "operation"
    ).agg(
        F.grouping_id().alias("_level"),
        F.count(F.lit(1)).alias("llm_requests"),
        *sums.values(),
        F.round(F.sum(F.col("estimated_usd").cast("decimal(28,12)")).cast("double"), 6).alias("estimated_usd"),
        F.min_by("model", F.struct("call_id")).alias("_first_model"),
    )
    grain = F.when(F.col("_level") == 0, "operation").when(F.col("_level") == 1, "stage").otherwise("total")
    return grouped.select(
        grain.alias("grain"), "session_id", "stage", "operation",
        F.when(F.col("_level") == 0, F.col("_first_model")).alias("model"),
        "llm_requests", *TOKEN_KEYS[1:], "estimated_usd",
    )


def cost_sections(items: DataFrame, keys: list[str], sections: tuple[str, ...] = ("ocr", "grounding", "redaction")) -> DataFrame:
    """USD, item and request counts per section, one row per group, with the total of all sections."""
    aggregates = []
    for section in sections:
        here = F.col("section") == section
        aggregates += [
            F.round(F.coalesce(F.sum(F.when(here, F.col("usd").cast("decimal(28,12)"))), F.lit(0)).cast("double"), 6).alias(f"{section}_usd"),
            F.count_if(here).alias(f"{section}_items"),
            F.coalesce(F.sum(F.when(here, F.col("requests"))), F.lit(0)).cast("bigint").alias(f"{section}_requests"),
        ]
    total = F.round(F.sum(F.when(F.col("section").isin(*sections), F.col("usd").cast("decimal(28,12)"))).cast("double"), 6)
    return items.groupBy(*keys).agg(*aggregates, F.coalesce(total, F.lit(0.0)).alias("total_usd"))
