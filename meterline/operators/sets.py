"""Row concatenation and what is computed over two tables together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """Duplicates kept; columns matched by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def combined_range(
    reference: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """``feature, low, high`` over both tables and the rows of each; each table
    is reduced to one row before the two meet."""
    from meterline.operators.profile import bounds

    return united_range(bounds(reference, columns), bounds(current, columns))


def united_range(reference: DataFrame, current: DataFrame) -> DataFrame:
    """The same from the bounds (``feature, low, high, n``) of each table."""
    return (
        reference.withColumn("is_ref", F.lit(1))
        .unionByName(current.withColumn("is_ref", F.lit(0)))
        .groupBy("feature")
        .agg(
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.sum(F.when(F.col("is_ref") == 1, F.col("n"))).alias("n_reference"),
            F.sum(F.when(F.col("is_ref") == 0, F.col("n"))).alias("n_current"),
        )
    )
