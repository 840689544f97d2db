"""Shared working folder: staged tables and checkpoints.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local
session works below its warehouse; a cluster has to name the folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} has to name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def use_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder unless already set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(spark))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage, survives executor loss, and gives
    the optimizer the true size, so that it picks the join strategy from it."""
    path = new_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
