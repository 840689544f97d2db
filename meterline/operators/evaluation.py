"""Regression metrics over scored rows (label and prediction in one row)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline import schemas as S
from meterline.functions import calendar as C, numeric as N, trip as TR
from meterline.operators import distribution as DI
from meterline.operators.profile import corr_with, rows_of

BASIC = ("rmse", "mae", "r2", "mape")
FULL = ("rmse", "mae", "mse", "r2", "mape", "max_error", "explained_variance", "std_error")


def add_errors(df: DataFrame, label: str = S.TARGET, prediction: str = "predicted") -> DataFrame:
    return df.withColumns(TR.error_columns(F.col(label), F.col(prediction)))


def metric_exprs(label: Column, prediction: Column) -> dict[str, Column]:
    """Aggregates behind every metric; all are one-pass and merge partially.

    A zero label has no percentage error and is left out of ``mape``; rows without
    a label or a prediction are left out of everything.
    """
    label, prediction = label.cast("double"), prediction.cast("double")
    error = label - prediction
    # A row without a prediction takes no part in any term.
    label = F.when(error.isNotNull(), label)
    sse, n = F.sum(error * error), F.count(error)
    return {
        "rmse": F.sqrt(N.ratio(sse, n)),
        "mae": F.avg(F.abs(error)),
        "mse": N.ratio(sse, n),
        "r2": F.lit(1.0) - N.ratio(sse, F.var_pop(label) * n),
        "mape": F.avg(N.ratio(F.abs(error), F.abs(label))) * 100.0,
        "max_error": F.max(F.abs(error)),
        "explained_variance": F.lit(1.0) - N.ratio(F.var_pop(error), F.var_pop(label)),
        "std_error": F.stddev_pop(error),
    }


def metrics(
    df: DataFrame,
    label: str = S.TARGET,
    prediction: str = "predicted",
    by: Sequence[str] = (),
    names: Sequence[str] = BASIC,
) -> DataFrame:
    exprs = metric_exprs(F.col(label), F.col(prediction))
    aggs = [exprs[m].alias(m) for m in names]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def regression_metrics(
    df: DataFrame,
    label: str = S.TARGET,
    prediction: str = "predicted",
    by: Sequence[str] = (),
    approx: bool = False,
) -> DataFrame:
    """All metrics with ``median_ae``; ``by`` is for few groups."""
    wide = metrics(df, label, prediction, by, FULL)
    errors = df.select(*by, F.abs(F.col(label) - F.col(prediction)).alias("abs_error"))
    median = DI.quantiles(errors, ["abs_error"], [0.5], by, approx).select(
        *by, F.col("q")[0].alias("median_ae")
    )
    if not by:
        return wide.withColumn("median_ae", median.scalar())
    # Null-safe, so a null group keeps its median; the optimizer sizes the join.
    named = median.select(*[F.col(c).alias(f"_{c}") for c in by], "median_ae")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return wide.join(named, same, "left").drop(*[f"_{c}" for c in by])


def regression_metrics_basic(
    df: DataFrame, label: str = S.TARGET, prediction: str = "predicted"
) -> DataFrame:
    return metrics(df, label, prediction)


def metrics_by_split(
    df: DataFrame, label: str = S.TARGET, prediction: str = "predicted", split: str = "split"
) -> DataFrame:
    return regression_metrics(df, label, prediction, [split])


def metrics_long(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = [c for c in wide.columns if c not in by]
    return wide.unpivot(list(by), names, "metric", "value")


def error_summary(df: DataFrame, label: str = S.TARGET, prediction: str = "predicted") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    base = df.agg(
        F.avg(e).alias("mean_error"),
        F.stddev_samp(e).alias("std_error"),
        F.min(e).alias("min_error"),
        F.max(e).alias("max_error"),
        F.avg(F.abs(e)).alias("mean_abs_error"),
    )
    median = DI.exact_quantiles(df.select(F.abs(e).alias("abs_error")), ["abs_error"], [0.5])
    return base.withColumn("median_abs_error", median.select(F.col("q")[0]).scalar())


def error_percentiles(
    df: DataFrame,
    label: str = S.TARGET,
    prediction: str = "predicted",
    percentiles: Sequence[int] = S.ERROR_PERCENTILES,
    approx: bool = False,
) -> DataFrame:
    """``percentile, abs_error``."""
    errors = df.select(F.abs(F.col(label) - F.col(prediction)).alias("abs_error"))
    q = DI.quantiles(errors, ["abs_error"], [p / 100.0 for p in percentiles], approx=approx)
    names = F.array(*[F.lit(int(p)) for p in percentiles])
    return q.select(F.explode(F.arrays_zip(names.alias("percentile"), F.col("q"))).alias("z")).select(
        F.col("z.percentile").alias("percentile"), F.col("z.q").alias("abs_error")
    )


def error_buckets(df: DataFrame, label: str = S.TARGET, prediction: str = "predicted") -> DataFrame:
    """Count and percent per absolute-error bucket; empty buckets are kept."""
    err = F.abs(F.col(label) - F.col(prediction))
    bucket = N.left_closed_bucket(err, S.ERROR_BUCKETS)
    total = F.count(F.lit(1)).alias("_n")
    wide = df.select(bucket.alias("b")).agg(
        total, *[F.count_if(F.col("b") == name).alias(name) for _, _, name in S.ERROR_BUCKETS]
    )
    return rows_of(
        wide,
        [
            F.struct(
                F.lit(i).alias("bucket"),
                F.lit(name).alias("label"),
                F.col(f"`{name}`").alias("count"),
                N.percent(F.col(f"`{name}`"), F.col("_n")).alias("pct"),
            )
            for i, (_, _, name) in enumerate(S.ERROR_BUCKETS)
        ],
    )


# --- segments -----------------------------------------------------------------------

SEGMENTS = ("pickup_hour", "pickup_dayofweek", "fare_range", "distance_range")


def segment_metrics(
    df: DataFrame, label: str = S.TARGET, prediction: str = "predicted"
) -> DataFrame:
    """MAE, MAPE, count, share and mean fare by hour, weekday, fare range and
    distance range: one scan through grouping sets, empty segments omitted."""
    rows = df.select(
        F.col("pickup_hour").cast("string").alias("pickup_hour"),
        C.day_name(F.col("pickup_dayofweek")).alias("pickup_dayofweek"),
        TR.fare_range(F.col(label)).alias("fare_range"),
        TR.distance_range(F.col("trip_distance")).alias("distance_range"),
        F.col(label).alias("_y"),
        F.col(prediction).alias("_p"),
    )
    exprs = metric_exprs(F.col("_y"), F.col("_p"))
    dims = [F.col(c) for c in SEGMENTS]
    grouped = rows.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("_set"),
        exprs["mae"].alias("mae"),
        exprs["mape"].alias("mape"),
        F.avg("_y").alias("avg_fare"),
        F.count(F.lit(1)).alias("count"),
    )
    # In the grouping id, the bit of the grouped column is 0 and all others are 1.
    full = (1 << len(SEGMENTS)) - 1
    kind = value = None
    for i, c in enumerate(SEGMENTS):
        is_set = F.col("_set") == (full ^ (1 << (len(SEGMENTS) - 1 - i)))
        kind = F.when(is_set, c) if kind is None else kind.when(is_set, c)
        value = F.when(is_set, F.col(c)) if value is None else value.when(is_set, F.col(c))
    # A few dozen rows remain for the share window.
    share = Window.partitionBy("segment")
    return (
        grouped.withColumns({"segment": kind, "value": value})
        .withColumn("pct", N.percent(F.col("count"), F.sum("count").over(share)))
        .where(F.col("value").isNotNull())
        .select("segment", "value", "mae", "mape", "avg_fare", "count", "pct")
    )


def corr_with_error(
    df: DataFrame, features: Sequence[str], label: str = S.TARGET, prediction: str = "predicted"
) -> DataFrame:
    return corr_with(add_errors(df, label, prediction), features, "abs_error").orderBy(
        F.desc(F.abs("r")), "feature"
    )


# --- worst rows ---------------------------------------------------------------------


def worst_predictions(
    df: DataFrame,
    n: int = 100,
    key: str = "trip_id",
    label: str = S.TARGET,
    prediction: str = "predicted",
) -> DataFrame:
    return add_errors(df, label, prediction).orderBy(F.desc("abs_error"), key).limit(n)


def worst_vs_overall(
    df: DataFrame,
    n: int = 100,
    key: str = "trip_id",
    label: str = S.TARGET,
    prediction: str = "predicted",
) -> DataFrame:
    """Mean fare, prediction and error of the worst rows and of all rows."""

    def summary(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(
            F.avg(label).alias("avg_actual"),
            F.avg(prediction).alias("avg_predicted"),
            F.avg("abs_error").alias("avg_abs_error"),
            F.count(F.lit(1)).alias("rows"),
        ).select(F.lit(name).alias("population"), "*")

    scored = add_errors(df, label, prediction)
    worst = worst_predictions(df, n, key, label, prediction)
    return summary(worst, "worst").unionByName(summary(scored, "overall"))


def worst_by_fare_range(
    df: DataFrame, n: int = 100, key: str = "trip_id", label: str = S.TARGET
) -> DataFrame:
    worst = worst_predictions(df, n, key, label)
    return worst.groupBy(TR.fare_range(F.col(label)).alias("fare_range")).agg(
        F.count(F.lit(1)).alias("count")
    )


def split_summary(df: DataFrame, target: str = S.TARGET, split: str = "split") -> DataFrame:
    share = Window.partitionBy()
    # One row per split reaches the window.
    return (
        df.groupBy(split)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(target).alias("target_mean"),
            F.stddev_samp(target).alias("target_std"),
        )
        .withColumn("pct", N.percent(F.col("rows"), F.sum("rows").over(share)))
    )


# --- model comparison -----------------------------------------------------------------


def compare_models(
    df: DataFrame, predictions: Mapping[str, str], label: str = S.TARGET
) -> DataFrame:
    """Full metrics of many prediction columns, best rmse first.

    The columns are unpivoted, so all models share one scan.
    """
    renamed = df.select(label, *[F.col(c).cast("double").alias(m) for m, c in predictions.items()])
    long = renamed.unpivot([label], list(predictions), "model", "_p")
    return regression_metrics(long, label, "_p", ["model"]).orderBy("rmse", "model")


def _side_by_side(df: DataFrame, first: str, second: str, label: str) -> DataFrame:
    pairs = {}
    for name, column in (("a", first), ("b", second)):
        e = metric_exprs(F.col(label), F.col(column))
        pairs.update({f"{m}_{name}": e[m] for m in ("mae", "rmse", "r2")})
    return df.agg(*[v.alias(k) for k, v in pairs.items()])


def compare_versions(
    df: DataFrame, first: str, second: str, label: str = S.TARGET
) -> DataFrame:
    """``metric, first, second, diff_pct, winner``; a positive difference
    means the second is better, and the winner is the one with less MAE."""
    wide = _side_by_side(df, first, second, label)
    winner = F.when(F.col("mae_b") < F.col("mae_a"), F.lit(second)).otherwise(F.lit(first))
    rows = []
    for m in ("mae", "rmse", "r2"):
        a, b = F.col(f"{m}_a"), F.col(f"{m}_b")
        gain = b - a if m == "r2" else a - b
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                a.alias("first"),
                b.alias("second"),
                (N.ratio(gain, a) * 100.0).alias("diff_pct"),
                winner.alias("winner"),
            )
        )
    return rows_of(wide, rows)


def baseline_vs_tuned(df: DataFrame, baseline: str, tuned: str, label: str = S.TARGET) -> DataFrame:
    """``metric, baseline, tuned, improvement, improvement_pct``."""
    wide = _side_by_side(df, baseline, tuned, label)
    rows = []
    for m in ("mae", "rmse", "r2"):
        a, b = F.col(f"{m}_a"), F.col(f"{m}_b")
        gain = b - a if m == "r2" else a - b
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                a.alias("baseline"),
                b.alias("tuned"),
                gain.alias("improvement"),
                (N.ratio(gain, a) * 100.0).alias("improvement_pct"),
            )
        )
    return rows_of(wide, rows)


def evaluation_verdicts(
    df: DataFrame, label: str = S.TARGET, prediction: str = "predicted", split: str = "split"
) -> DataFrame:
    """``check, value, flag`` from metrics of the train and test split and
    from the mean MAE of the high-fare ranges of the test split."""
    y, p = F.col(label), F.col(prediction)
    err = F.abs(y - p)
    train, test = F.col(split) == "train", F.col(split) == "test"
    rng = TR.fare_range(y)
    test_m = metric_exprs(F.when(test, y), F.when(test, p))
    # Ranges whose label names 50 or 100, as a pattern over the labels.
    high = [x for x in S.FARE_BIN_LABELS if "50" in x or "100" in x]
    wide = df.agg(
        test_m["r2"].alias("r2"),
        test_m["mape"].alias("mape"),
        test_m["mae"].alias("mae"),
        F.avg(F.when(train, err)).alias("train_mae"),
        *[F.avg(F.when(test & (rng == x), err)).alias(f"h{i}") for i, x in enumerate(high)],
    )
    found = F.array_compact(F.array(*[F.col(f"h{i}") for i in range(len(high))]))
    high_mae = N.ratio(
        F.aggregate(found, F.lit(0.0), lambda a, x: a + x), F.size(found).cast("double")
    )
    gap = F.abs(F.col("train_mae") - F.col("mae"))
    checks = [
        ("good_r2", F.col("r2"), F.col("r2") > S.VERDICT_R2),
        ("low_mape", F.col("mape"), F.col("mape") < S.VERDICT_MAPE),
        ("low_overfitting", gap, gap < S.VERDICT_GAP),
        ("mae_could_be_lower", F.col("mae"), F.col("mae") > S.VERDICT_MAE),
        ("high_fares_worse", high_mae, high_mae > F.col("mae") * S.VERDICT_HIGH_FARES),
        ("alert_level", F.col("mae") * S.VERDICT_ALERT, F.lit(True)),
    ]
    return rows_of(
        wide,
        [
            F.struct(
                F.lit(name).alias("check"),
                value.alias("value"),
                F.coalesce(flag, F.lit(False)).cast("int").alias("flag"),
            )
            for name, value, flag in checks
        ],
    )
