"""Top-k, last-n and running results.

Top-k is ``orderBy().limit()`` (each task keeps k rows). The two running
operators order a whole table in one task and are for result tables only: one
row per model feature, one row per tuning trial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from meterline.operators.profile import rows_of


def cumulative_share(importances: DataFrame, by: str = "importance") -> DataFrame:
    """Importances in falling order with their running sum and position."""
    order = Window.orderBy(F.desc(by), "feature")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return importances.withColumns(
        {"position": F.row_number().over(order), "cumulative": F.sum(by).over(running)}
    )


def features_needed(
    importances: DataFrame, thresholds: Sequence[float] = (0.8, 0.9), by: str = "importance"
) -> DataFrame:
    """``threshold, features``: how many features reach each share."""
    wide = cumulative_share(importances, by).agg(
        *[F.count_if(F.col("cumulative") < t).alias(f"t{i}") for i, t in enumerate(thresholds)]
    )
    return rows_of(
        wide,
        [
            F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"t{i}") + 1).alias("features"))
            for i, t in enumerate(thresholds)
        ],
    )


def running_best(trials: DataFrame, value: str, order: str = "trial") -> DataFrame:
    seen = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.min(value).over(seen))


def last_n(df: DataFrame, n: int, *newest_first: str) -> DataFrame:
    """The n latest rows; the columns must order rows uniquely."""
    return df.orderBy(*[F.desc(c) for c in newest_first]).limit(n)


def last_n_per_key(df: DataFrame, n: int, key: str, *newest_first: str) -> DataFrame:
    """The n latest rows of each key. The row-number limit is also applied
    before the shuffle, so a hot key sends n rows per task, not all of them."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in newest_first])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def leaderboard(results: DataFrame, metric: str = "rmse", name: str = "model") -> DataFrame:
    """Best first; a model without the metric comes last."""
    return results.orderBy(F.asc_nulls_last(metric), name)


def best_model(results: DataFrame, metric: str = "mae", name: str = "model") -> DataFrame:
    return results.agg(
        F.min_by(name, F.struct(metric, name)).alias(name), F.min(metric).alias(metric)
    )


def top_zones(trips: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        trips.groupBy(column)
        .agg(F.count(F.lit(1)).alias("trips"))
        .orderBy(F.desc("trips"), column)
        .limit(n)
    )


def top_by_abs(df: DataFrame, value: str, name: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(F.abs(value)), name).limit(n)


def top_features(importances: DataFrame, n: int = 15, by: str = "importance") -> DataFrame:
    return importances.orderBy(F.desc(by), "feature").limit(n)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in a stated order; rows have no order of their own."""
    return df.orderBy(*order).limit(n)
