"""Spark session helpers: construction for local runs, checkpoint folder, lineage cut."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sessionloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs; on a cluster the submitted configuration wins."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local run that names none gets one of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def stage_dir(spark: SparkSession) -> str:
    """Where this application writes its stage tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stages/{spark.sparkContext.applicationId}"


def remove_stages(spark: SparkSession) -> None:
    """Delete this application's stage tables. Results that were not written anywhere read from them, so call it when the last one is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Computed once, columnar, and readable after any executor is lost. `remove_stages` deletes the tables.
    """
    path = f"{stage_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_sessionloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "sessionloom")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), "sessionloom")
    context.addPyFile(archive)
    context._sessionloom_shipped = True
