"""Provider rounds over batches of the action log with a scripted offline provider."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import provider
from sessionloom.functions import answers as answer_fn
from sessionloom.operators import segments
from sessionloom.plans import standins
from sessionloom.plans.base import query
from sessionloom.plans.standins import ACTIONS_SQL, STATES_SQL, STEPS_SQL, with_ctes

SESSION = "session_id"


def scripted(request: dict) -> tuple[str, dict]:
    """Offline answers: one group per batch; batches of odd number leave out their last row at first."""
    size, number = int(request["batch_size"]), int(request["batch_no"])
    end = size - 1
    if number % 2 == 1 and size > 1 and not request["feedback"]:
        end -= 1
    if number % 5 == 4:
        raise ValueError("scripted failure")
    text = json.dumps({"segments": [{"start_idx": 0, "end_idx": end, "objective": f"batch {number}"}]})
    return f"```json\n{text}\n```", {"input_tokens": size, "output_tokens": 1, "total_tokens": size + 1}


@query(
    "provider_rounds",
    with_ctes(ACTIONS_SQL, STATES_SQL, STEPS_SQL)
    + """, b AS (SELECT session_id, idx // 10 AS batch_no, count(*) AS batch_size FROM steps GROUP BY ALL)
SELECT session_id, batch_no, batch_size, batch_no % 5 <> 4 AS valid, CASE WHEN batch_no % 5 = 4 OR (batch_no % 2 = 1 AND batch_size > 1) THEN 2 ELSE 1 END AS attempt,
  CASE WHEN batch_no % 5 = 4 THEN 'ValueError: scripted failure' ELSE '' END AS error FROM b""",
)
def provider_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Segmentation of batches of ten with one repair round; a failed call stays as an error row."""
    batches, _ = standins.answer_batches(standins.steps(spark, folder))
    requests = batches.withColumns(
        {"request_id": F.concat_ws("/", SESSION, F.col("batch_no").cast("string")), "operation": F.lit("segment"), "model": F.lit("offline")}
    )

    def check(answers: DataFrame) -> DataFrame:
        parsed = answers.withColumn("g", F.explode_outer(answer_fn.parse_groups(answer_fn.json_object_text(F.col("response")))))
        groups = parsed.where(F.col("g").isNotNull()).select(SESSION, "batch_no", "g.*")
        report = segments.check_groups(groups, answers.select(SESSION, "batch_no", "batch_size"), needs_text=True)
        feedback = F.concat(F.lit("missing rows: "), F.col("missing").cast("string"))
        return report.select(F.concat_ws("/", SESSION, F.col("batch_no").cast("string")).alias("request_id"), "valid", feedback.alias("feedback"))

    out, _ = provider.rounds(requests, scripted, check, max_attempts=2, concurrency=8)
    return out.select(SESSION, "batch_no", "batch_size", "valid", "attempt", F.coalesce("error", F.lit("")).alias("error"))
