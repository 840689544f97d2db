"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline.sources.staging import stage


def write_splits(df: DataFrame, path: str) -> None:
    """One partitioned table instead of one file per split; a reader of a
    single split prunes to its folder. Rows stay where they are: no shuffle."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.where(df["split"] == split).drop("split")


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """For metric tables only: a handful of rows in one file."""
    metrics.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_stats_json(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    scored.write.mode("overwrite").parquet(path)


def append_log(records: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append only; retention is applied when the log is read. Partitioned by
    day, a reader of the newest rows prunes to the last folders."""
    writer = records.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def compact_log(
    spark: SparkSession, path: str, days: Sequence[str], partition_by: str = "day", rows_per_file: int = 5_000_000
) -> None:
    """Rewrites these days of a partitioned log as few files, one per ``rows_per_file`` rows; other
    days are not read. For days that are closed: no append may run meanwhile.

    The rows are written to the shared folder first, so that a failure in between loses none.
    """
    log = spark.read.parquet(path)
    day = F.col(partition_by)
    held = stage(log.where(day.isin([*days])), "log-compaction")
    sizes = held.groupBy(partition_by).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    # One row a day; a large day goes to as many tasks as it gets files.
    part = F.pmod(F.xxhash64(*[F.col(c) for c in held.columns]), F.col("_files"))
    dealt = held.join(F.broadcast(sizes), partition_by).withColumn("_part", part)
    (
        dealt.repartition(partition_by, "_part")
        .drop("_files", "_part")
        .select(*log.columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(partition_by)
        .parquet(path)
    )
