"""Model calls as a table: requests in, responses out, with checks and bounded rounds of repair.

A provider is a plain function ``request dict -> (text, usage dict)``.  Requests are spread over a fixed
number of partitions, which bounds the calls in flight.  Every round's responses are written to a table
before they are used, so a lost executor or a retried stage never asks the model twice for a used answer. A task lost before its
round is written does ask again; calls of one partition run one after the other.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.session import checkpoint_dir

Provider = Callable[[dict], tuple[str, dict]]

RESPONSES = (
    "request_id string, attempt int, response string, error string, input_tokens bigint, output_tokens bigint, total_tokens bigint, cache_read_tokens bigint"
)
# Errors that are worth another try, by the exception's own or inherited type name, and by status of the response.
TRANSIENT_TYPES = ("ConnectError", "ConnectTimeout", "ReadTimeout", "PoolTimeout")
TRANSIENT_STATUS = (502, 503, 429)


def is_transient(error: Exception) -> bool:
    """By type and status code, never by the message; any client library may have raised it."""
    if any(kind.__name__ in TRANSIENT_TYPES for kind in type(error).__mro__):
        return True
    return getattr(getattr(error, "response", None), "status_code", None) in TRANSIENT_STATUS


def _ask(provider: Provider, request: dict, retries: int, first_delay: float) -> tuple:
    """One call; transient failures are tried again after doubling delays, the last error becomes a row."""
    for turn in range(retries):
        try:
            response, usage = provider(request)
            counts = [int(usage.get(k, 0)) for k in ("input_tokens", "output_tokens", "total_tokens", "cache_read_tokens")]
            return (response, None, *counts)
        except Exception as error:  # the failure is data: it becomes an error row
            text = f"{type(error).__name__}: {error}"
            if turn + 1 >= retries or not is_transient(error):
                return (None, text, 0, 0, 0, 0)
            time.sleep(first_delay * 2**turn)
    raise AssertionError("unreachable")


def call(requests: DataFrame, provider: Provider, concurrency: int = 32, retries: int = 3, first_delay: float = 2.0) -> DataFrame:
    """Responses to requests(request_id, attempt, operation, model, system, content, feedback)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in RESPONSES.split(",")]
        for part in parts:
            rows = [(r["request_id"], r["attempt"], *_ask(provider, r, max(1, retries), first_delay)) for r in part.to_dict("records")]
            yield pd.DataFrame(rows, columns=names)

    return requests.repartition(concurrency, "request_id").mapInPandas(run, RESPONSES)


def _store(responses: DataFrame, folder: str, attempt: int) -> DataFrame:
    path = f"{folder}/attempt={attempt}"
    responses.drop("attempt").write.mode("overwrite").parquet(path)
    return responses.sparkSession.read.schema(responses.drop("attempt").schema).parquet(path).withColumn("attempt", F.lit(attempt))


def rounds(
    requests: DataFrame,
    provider: Provider,
    check: Callable[[DataFrame], DataFrame],
    max_attempts: int = 2,
    folder: str | None = None,
    concurrency: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """Ask, check, ask again with the errors, up to ``max_attempts``.

    ``check`` takes answers(request_id, response, ...) with the request columns and returns
    (request_id, valid, feedback).  Returns (last answer of every request with ``valid``, call ledger).
    A call that failed counts as invalid.  The number of rounds is fixed, each one a job on the rest.
    """
    spark = requests.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/responses-{uuid.uuid4().hex}"
    open_requests = requests.withColumn("feedback", F.lit("")) if "feedback" not in requests.columns else requests
    settled, ledgers = [], []
    for attempt in range(1, max_attempts + 1):
        responses = _store(call(open_requests.withColumn("attempt", F.lit(attempt)), provider, concurrency), folder, attempt)
        ledgers.append(responses)
        answers = open_requests.join(responses, "request_id")
        verdict = check(answers).select("request_id", "valid", F.col("feedback").alias("_feedback"))
        judged = answers.join(verdict, "request_id", "left").withColumn(
            "valid", F.coalesce(F.col("valid"), F.lit(False)) & F.col("error").isNull()
        )
        # Judged once: the next round and the result both read the written rows.
        judged.write.mode("overwrite").parquet(f"{folder}/judged-{attempt}")
        judged = spark.read.schema(judged.schema).parquet(f"{folder}/judged-{attempt}")
        last = attempt == max_attempts
        settled.append((judged if last else judged.where("valid")).drop("_feedback"))
        if not last:
            rest = judged.where(~F.col("valid")).withColumn("feedback", F.coalesce("_feedback", "error", F.lit("")))
            open_requests = rest.select(*open_requests.columns)
    out, ledger = settled[0], ledgers[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    for more in ledgers[1:]:
        ledger = ledger.unionByName(more)
    return out, ledger


def accept_if_valid(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The new text where its check passed, the old one everywhere else."""
    candidate = new.where("valid").select(*keys, F.col(column).alias("_new"))
    out = old.join(candidate, keys, "left")
    return out.withColumns({column: F.coalesce("_new", column), "replaced": F.col("_new").isNotNull()}).drop("_new")
