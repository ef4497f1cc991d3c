"""Session settings and the few places that look at the cluster."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexiloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a session whose executors are threads of this
    process; a cluster must name a folder that all its machines see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lexiloom-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder for files that outlive a stage, below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


def settle(df: DataFrame) -> DataFrame:
    """The table written once below the shared checkpoint folder and read back.

    For tables that several branches of one flow read (numbered blocks, review lines): each
    branch then scans only its columns instead of running the whole flow before it again, and a
    lost executor costs a read, not a recomputation.
    """
    spark = df.sparkSession
    path = work_dir(spark, f"table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finer(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt evenly over tasks of about ``rows`` each, unless they arrive in as many tasks already.

    For generators that make many rows of each: what such a task counts must fit in its memory, however
    large the splits of the table are.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the cores when a scan arrives in fewer tasks than there are cores.

    Large inputs already arrive in many splits and are returned as they are, so no
    shuffle is added at scale; one small file would otherwise keep a row generator
    (split, n-grams) in a single task.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= width:
        return df
    return df.repartition(width, *keys)
