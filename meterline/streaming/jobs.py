"""Streaming: scoring, drift of the newest rows, windowed statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from meterline import schemas as S
from meterline.functions import calendar as C, numeric as N
from meterline.ml.scoring import linear_score
from meterline.operators import reference as RF
from meterline.operators.cleaning import validate_trips
from meterline.operators.features import serving_features
from meterline.operators.ranking import last_n


def score_requests(
    requests: DataFrame,
    coefficients: Mapping[str, float],
    intercept: float,
    keep: Sequence[str] = ("event_id", "ts"),
) -> DataFrame:
    """Validate, derive the features, score and clamp. Stateless, so it is the
    same for a table and for a stream."""
    valid = validate_trips(requests).where("valid").drop("failed_rules", "valid")
    featured = serving_features(valid, keep=keep)
    return featured.withColumn(
        "prediction", N.floor_at_zero(linear_score(coefficients, intercept))
    )


def rejected_requests(requests: DataFrame) -> DataFrame:
    """The invalid requests, whole, with their ``failed_rules``."""
    return validate_trips(requests).where("not valid").drop("valid")


def stream_rejects(requests: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append the requests that `stream_score` does not score to a table of
    their own, exactly once, until the input is drained."""
    return (
        rejected_requests(requests)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


def stream_score(
    requests: DataFrame,
    coefficients: Mapping[str, float],
    intercept: float,
    output: str,
    checkpoint: str,
    keep: Sequence[str] = ("event_id", "ts"),
) -> StreamingQuery:
    """Append scored rows to a log table, exactly once, until the input is
    drained. Invalid requests are for `stream_rejects`."""
    return (
        score_requests(requests, coefficients, intercept, keep)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


def _put_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """The batch's partition of a table; a replay replaces it."""
    (
        rows.withColumn("batch", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch")
        .parquet(path)
    )


def tail_writer(
    summary: DataFrame,
    path: str,
    n: int = S.RECENT_LOG_ROWS,
    min_rows: int = S.MIN_LOG_ROWS,
    order: Sequence[str] = ("ts", "event_id"),
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the newest n rows in arrival
    order and writes their drift report.

    ``summary`` is the stored summary of the reference. Each batch reads only itself, the n rows
    its predecessor kept and the summary. The kept rows alternate between two folders, and the
    report is one table with a partition per batch: replaying a batch overwrites the same files,
    and never those it reads.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = last_n(batch, n, *order).withColumn("batch", F.lit(batch_id).cast("bigint"))
        if batch_id > 0:
            kept = spark.read.schema(newest.schema).parquet(f"{path}/tail/{(batch_id - 1) % 2}")
            newest = newest.unionByName(kept)
        here = f"{path}/tail/{batch_id % 2}"
        last_n(newest, n, "batch", *order).write.mode("overwrite").parquet(here)
        tail = spark.read.schema(newest.schema).parquet(here)
        report = RF.drift_report(summary, tail, min_rows=min_rows)
        _put_batch(report, batch_id, f"{path}/report")

    return write


def stream_drift_tail(
    scored: DataFrame,
    summary: DataFrame,
    path: str,
    checkpoint: str,
    n: int = S.RECENT_LOG_ROWS,
    min_rows: int = S.MIN_LOG_ROWS,
) -> StreamingQuery:
    """Drift of the newest rows after every batch, against a stored summary of the reference."""
    return (
        scored.writeStream.foreachBatch(tail_writer(summary, path, n, min_rows))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def window_stats(
    rows: DataFrame,
    features: Sequence[str] = S.DRIFT_FEATURES,
    width: str = "1 day",
    lateness: str = "1 hour",
    ts: str = "ts",
) -> DataFrame:
    """Count and means per tumbling event-time window, for the trend of the
    mean shift. Rows later than the watermark are dropped by a stream; `stream_late_rows` keeps
    them in a side table. The last windows come out once later rows have passed their end."""
    timed = rows
    if isinstance(rows.schema[ts].dataType, T.TimestampNTZType):
        timed = rows.withColumn(ts, C.to_instant(F.col(ts)))
    return (
        timed.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.avg(c).alias(f"mean_{c}") for c in features],
        )
        .select(C.from_instant(F.col("w.start")).alias("window_start"), "rows", *[f"mean_{c}" for c in features])
    )


def stream_window_stats(
    rows: DataFrame,
    output: str,
    checkpoint: str,
    features: Sequence[str] = S.DRIFT_FEATURES,
    width: str = "1 day",
    lateness: str = "1 hour",
) -> StreamingQuery:
    return (
        window_stats(rows, features, width, lateness)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )


def late_writer(
    path: str, width: str = "1 day", lateness: str = "1 hour", ts: str = "ts"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that puts aside the rows which `window_stats` drops: those whose
    window had ended when the watermark of the batches before passed it.

    The greatest time seen so far is a table of one row, which alternates between two folders;
    the late rows are a table with a partition per batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.col(ts)
        if isinstance(batch.schema[ts].dataType, T.TimestampNTZType):
            at = C.to_instant(at)
        newest = batch.agg(F.max(at).alias("newest"))
        if batch_id > 0:
            seen = spark.read.schema("newest timestamp").parquet(f"{path}/newest/{(batch_id - 1) % 2}")
            mark = seen.select(F.col("newest") - F.expr(f"INTERVAL {lateness}")).scalar()
            _put_batch(batch.where(F.window(at, width)["end"] <= mark), batch_id, f"{path}/late")
            newest = newest.unionByName(seen).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/newest/{batch_id % 2}")

    return write


def stream_late_rows(
    rows: DataFrame, path: str, checkpoint: str, width: str = "1 day", lateness: str = "1 hour", ts: str = "ts"
) -> StreamingQuery:
    """The late rows of a stream, whole, in a side table under ``path``, until the input is drained."""
    return (
        rows.writeStream.foreachBatch(late_writer(path, width, lateness, ts))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
