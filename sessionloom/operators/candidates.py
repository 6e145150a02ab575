"""A valid candidate for every model from the first source that has one.

Sources are stages in order of preference: what is stored, an answer of the provider, the same asked again with the errors, a repair of the last answer, a
placeholder. A stage runs only for models that no earlier stage settled, is judged once, and its rows are written before the next stage reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def first_valid(models: DataFrame, stages: list[Stage], check: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Models with candidate, origin (the stage's name), valid and feedback.

    A stage takes the open models, with `previous` and `feedback` of the stage before (null where it had none), and gives keys and
    candidate, at most one row a model; if it also gives valid and feedback, these hold and it isn't judged again. `check` takes keys, candidate and the models'
    other columns, and gives keys, valid and feedback. A model that no stage settles keeps the last candidate that there was, not valid, with its feedback.
    """
    own = models.columns
    models = cut_lineage(models)  # every stage's judgement reads them
    state, settled, kind = models, [], None
    for number, (name, build) in enumerate(stages):
        given = state if kind else state.withColumn("feedback", F.lit(None).cast("string"))
        made = build(given)
        judged_already = "valid" in made.columns
        made = made.where(F.col("candidate").isNotNull()).select(*keys, "candidate", *(["valid", "feedback"] if judged_already else []))
        if kind is None:
            kind = made.schema["candidate"].dataType
            state = state.withColumns({"kept": F.lit(None).cast(kind), "kept_origin": F.lit(None).cast("string"), "kept_feedback": F.lit(None).cast("string")})
        if not judged_already:
            made = cut_lineage(made)
            made = made.join(check(made.join(models, keys)).select(*keys, "valid", "feedback"), keys, "left")
        made = made.withColumnsRenamed({"valid": "_valid", "feedback": "_feedback"})
        out = state.drop("previous", "feedback").join(made, keys, "left")
        there = F.col("candidate").isNotNull()
        out = cut_lineage(out.select(
            *own, F.coalesce("_valid", F.lit(False)).alias("valid"), F.col("candidate").alias("previous"), F.col("_feedback").alias("feedback"),
            F.when(there, F.col("candidate")).otherwise(F.col("kept")).alias("kept"), F.when(there, F.lit(name)).otherwise(F.col("kept_origin")).alias("kept_origin"),
            F.when(there, F.col("_feedback")).otherwise(F.col("kept_feedback")).alias("kept_feedback"),
        ))
        last = number == len(stages) - 1
        settled.append(out if last else out.where("valid"))
        state = out.where(~F.col("valid")).drop("valid")
    return reduce(DataFrame.unionByName, settled).select(
        *own, F.col("kept").alias("candidate"), F.col("kept_origin").alias("origin"), "valid", F.col("kept_feedback").alias("feedback")
    )
