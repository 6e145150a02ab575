"""Streaming ingestion of the event log: late rows and repeats set aside, enrichment that restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.schemas import RAW_TRACE
from sessionloom.session import cut_lineage


def read_log(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of raw events from a folder that writers only ever add files to."""
    return spark.readStream.schema(RAW_TRACE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def drop_repeats(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """First row per key while it is inside the watermark."""
    timed = events.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(keys)


def _latest(spark: SparkSession, path: str) -> float | None:
    try:
        return spark.read.parquet(path).agg(F.max("ts")).first()[0]
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def split_late(target: str, late: str, delay_seconds: float = 600.0) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: on-time rows to ``target``, rows older than the newest known minus the delay to ``late``.

    A batch writes its own folder and replaces it when run again, so a retry adds nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _latest(spark, f"{target}/marks")
        cut = F.lit(newest - delay_seconds) if newest is not None else F.lit(float("-inf"))
        save = lambda rows, path: rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        save(batch.where(F.col("ts") >= cut), f"{target}/rows")
        save(batch.where(F.col("ts") < cut), late)
        marks = batch.agg(F.max("ts").alias("ts")).where(F.col("ts").isNotNull())
        save(marks.select(F.greatest("ts", F.lit(newest)).alias("ts")) if newest is not None else marks, f"{target}/marks")

    return write


def append_progress(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink of enrichment answers; each batch owns one folder and may be retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def _written(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Rows of the batches before this one; None where nothing has been written.

    A batch that is run again doesn't see what its first attempt left. Two streams never share a folder, so numbers only grow.
    """
    try:
        return spark.read.option("basePath", path).parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def enrich_once(path: str, keys: list[str], ask: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that asks for the rows of a batch that no earlier batch answered, and appends the answers to the progress table.

    ``ask`` takes the batch's open rows, one a key, and gives their answers with ``status``. A batch is one folder, replaced when the batch is run again after a stop, so
    a restart from the checkpoint adds nothing twice and asks only for what was not stored. Failed rows (status other than success) are asked again when they
    come again. Only keys and status of earlier batches are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        earlier = _written(spark, path, batch_id)
        if earlier is not None:
            fresh = fresh.join(earlier.where(F.col("status") == "success").select(*keys).distinct(), keys, "left_anti")
        ask(fresh).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def split_repeats(target: str, repeats: str, keys: list[str], delay_seconds: float = 600.0) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: the first row of each key to ``target``, later ones to ``repeats``, as long as the key is remembered.

    A key is remembered while its first row is at most the delay older than the newest row of earlier batches, as the watermark of
    `drop_repeats` would have it; after that it is new again. Firsts go by (ts, line_no). Each batch writes the keys that are still remembered, so
    only the batch before is read and what is held is bounded by the delay. Every folder is replaced when a batch is run again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = _written(spark, f"{target}/keys", batch_id)
        last = held.agg(F.max("batch_id").alias("b")).first()["b"] if held is not None else None
        known = held.where(F.col("batch_id") == last).drop("batch_id") if last is not None else None
        newest = known.agg(F.max("newest")).first()[0] if known is not None else None
        limit = F.lit(newest - delay_seconds) if newest is not None else F.lit(float("-inf"))
        if known is None:
            live = batch.select(*keys, F.col("ts").alias("first_ts")).where(F.lit(False))
        else:
            live = known.where(F.col("first_ts").isNotNull() & (F.col("first_ts") >= limit)).select(*keys, "first_ts")
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "line_no"))
        ranked = batch.withColumn("_n", turn).join(live.withColumnRenamed("first_ts", "_first"), keys, "left")
        ranked = cut_lineage(ranked.withColumn("_again", F.col("_first").isNotNull() | (F.col("_n") > 1)).drop("_n", "_first"))
        save = lambda rows, path: rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        firsts = ranked.where(~F.col("_again")).drop("_again")
        save(firsts, f"{target}/rows")
        save(ranked.where("_again").drop("_again"), repeats)
        now = batch.agg(F.max("ts")).first()[0]
        newest = now if newest is None else newest if now is None else max(now, newest)
        kept = live.unionByName(firsts.select(*keys, F.col("ts").alias("first_ts")))
        # One row without keys carries the newest time when no key is left.
        mark = kept.sparkSession.createDataFrame([tuple([None] * len(kept.columns))], kept.schema)
        save(kept.unionByName(mark).withColumn("newest", F.lit(newest).cast("double")), f"{target}/keys")

    return write
