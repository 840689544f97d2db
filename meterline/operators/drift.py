"""Feature, target and performance drift between two tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterline import schemas as S
from meterline.functions import numeric as N
from meterline.functions.calendar import cyclic_shift
from meterline.operators import distribution as DI
from meterline.operators.cleaning import common_columns
from meterline.operators.evaluation import metric_exprs
from meterline.operators.profile import histogram_pair, moments, rows_of


def column_drift(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str] = S.DRIFT_FEATURES,
    threshold: float = S.DRIFT_THRESHOLD,
    norm: str = "std",
    ranges: int | None = None,
) -> DataFrame:
    """``feature, distance, score, drifted`` of numeric columns.

    The Wasserstein distance is divided by the reference deviation (``std``,
    at least 0.001), by the combined range (``range``), or kept (``none``). Each table is read
    once. ``ranges=1`` skips the spreading of values over tasks, for two samples of bounded size.
    Against a stored summary of the reference: `reference.column_drift`.
    """
    scales = {
        "std": F.greatest(F.col("ref_std"), F.lit(0.001)),
        "range": F.col("high") - F.col("low"),
        "none": F.lit(1.0),
    }
    if norm not in scales:
        raise ValueError(f"unknown normalisation: {norm}")
    score = N.ratio(F.col("wasserstein"), scales[norm])
    return DI.distances(reference, current, columns, ranges).select(
        "feature",
        F.col("wasserstein").alias("distance"),
        score.alias("score"),
        F.lit(threshold).alias("threshold"),
        F.coalesce(score > threshold, F.lit(False)).cast("int").alias("drifted"),
    )


def column_drift_cat(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    threshold: float = S.DRIFT_THRESHOLD,
) -> DataFrame:
    """Same shape for categorical columns, scored by Jensen-Shannon distance."""
    d = F.col("js_distance")
    return DI.jensen_shannon(reference, current, columns).select(
        "feature",
        d.alias("distance"),
        d.alias("score"),
        F.lit(threshold).alias("threshold"),
        (d > threshold).cast("int").alias("drifted"),
    )


def dataset_drift(per_column: DataFrame, share: float = S.DRIFT_SHARE) -> DataFrame:
    """Drifted if more than ``share`` of the columns are."""
    part = N.ratio(F.sum("drifted").cast("double"), F.count(F.lit(1)).cast("double"))
    return per_column.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.sum("drifted").alias("n_drifted"),
        part.alias("drift_share"),
        (part > share).cast("int").alias("dataset_drift"),
    )


def mean_shift(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str] = S.HISTOGRAM_FEATURES,
    limit_pct: float = S.MEAN_SHIFT_PCT,
) -> DataFrame:
    """Change of the mean in percent; 0 where the reference mean is 0."""

    def means(df: DataFrame, name: str) -> DataFrame:
        return moments(df, columns).select("feature", F.col("mean").alias(name))

    a, b = F.col("reference_mean"), F.col("current_mean")
    change = F.when(a != 0, (b - a) / a * 100.0).otherwise(F.lit(0.0))
    return (
        means(reference, "reference_mean")
        .join(F.broadcast(means(current, "current_mean")), "feature")
        .withColumn("change_pct", change)
        .withColumn("drifted", (F.abs("change_pct") > limit_pct).cast("int"))
    )


def target_drift(
    reference: DataFrame,
    current: DataFrame,
    target: str = S.TARGET,
    prediction: str = "predicted",
    **kwargs,
) -> DataFrame:
    return column_drift(reference, current, [target, prediction], **kwargs)


def performance_by_population(
    populations: Mapping[str, DataFrame], label: str = S.TARGET, prediction: str = "predicted"
) -> DataFrame:
    """``population, mae, rmse, r2``: each table is reduced where it lies."""
    out = None
    for name, df in populations.items():
        e = metric_exprs(F.col(label), F.col(prediction))
        row = df.agg(*[e[m].alias(m) for m in ("mae", "rmse", "r2")]).select(
            F.lit(name).alias("population"), "*"
        )
        out = row if out is None else out.unionByName(row)
    return out


def performance_drift(
    populations: Mapping[str, DataFrame],
    label: str = S.TARGET,
    prediction: str = "predicted",
    limit_pct: float = 10.0,
) -> DataFrame:
    """Metrics per population and the MAE change against the first one."""
    per = performance_by_population(populations, label, prediction)
    first = next(iter(populations))
    # One row per population.
    base = per.where(F.col("population") == first).select(F.col("mae")).scalar()
    change = N.ratio(F.col("mae") - base, base) * 100.0
    return per.withColumn("mae_change_pct", change).withColumn(
        "degraded", (F.col("mae_change_pct") > limit_pct).cast("int")
    )


def check_alerts(
    reference: DataFrame,
    current: DataFrame,
    label: str = S.TARGET,
    prediction: str = "predicted",
    limits: Mapping[str, float] = S.ALERT_LIMITS,
) -> DataFrame:
    """``alert, value, threshold``: one row per limit that is broken."""

    def side(df: DataFrame, p: str) -> DataFrame:
        e = metric_exprs(F.col(label), F.col(prediction))
        return df.agg(F.struct(e["mae"].alias("mae"), e["r2"].alias("r2")).alias(p))

    cur = side(current, "cur").withColumn("ref", side(reference, "ref").scalar())
    increase = N.ratio(F.col("cur.mae") - F.col("ref.mae"), F.col("ref.mae")) * 100.0
    drop = F.col("ref.r2") - F.col("cur.r2")
    checks = [
        ("mae_increase_pct", increase),
        ("max_mae", F.col("cur.mae")),
        ("r2_decrease", drop),
    ]
    rows = [
        F.struct(
            F.lit(name).alias("alert"),
            value.alias("value"),
            F.lit(float(limits[name])).alias("threshold"),
        )
        for name, value in checks
    ]
    return rows_of(cur, rows).where(F.col("value") > F.col("threshold"))


def standard_normal(key: Column, seed: int) -> Column:
    """A normal number that hangs on the key alone: Box-Muller over two uniform numbers of 48 bits
    each from the key's hash, so that it is the same in every run and partitioning."""
    h = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    uniform = lambda at: (F.conv(F.substring(h, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.sqrt(F.log(uniform(1)) * -2.0) * F.cos(uniform(13) * (2.0 * math.pi))


def perturb(
    df: DataFrame, scenario: str, noise_seed: int = S.SAMPLE_SEED, key: str = "trip_id"
) -> DataFrame:
    """What-if changes of a table.

    ``distance``: x1.5; ``time``: +3 hours; ``extreme``: distance x2, +8
    hours, +2 to 4 passengers by a hash of the row; ``noise``: gaussian noise
    of half a deviation on the duration, drawn from the row's ``key`` and the seed.
    """
    if scenario == "none":
        return df
    if scenario == "distance":
        return df.withColumn("trip_distance", F.col("trip_distance") * 1.5)
    if scenario == "time":
        return df.withColumn("pickup_hour", cyclic_shift(F.col("pickup_hour"), 3))
    if scenario == "extreme":
        extra = F.pmod(F.col("PULocationID") + F.col("DOLocationID"), F.lit(3)) + 2
        return df.withColumns(
            {
                "trip_distance": F.col("trip_distance") * 2.0,
                "pickup_hour": cyclic_shift(F.col("pickup_hour"), 8),
                "passenger_count": F.col("passenger_count") + extra,
            }
        )
    if scenario == "noise":
        spread = df.agg(F.stddev_samp("trip_duration_minutes")).scalar()
        return df.withColumn(
            "trip_duration_minutes",
            F.col("trip_duration_minutes") + standard_normal(F.col(key), noise_seed) * spread * 0.5,
        )
    raise ValueError(f"unknown scenario: {scenario}")


def drift_report(
    reference: DataFrame,
    tail: DataFrame,
    reference_fare_mean: Column | None = None,
    log_rows: Column | None = None,
    min_rows: int = S.MIN_LOG_ROWS,
    prediction: str = "prediction",
    ranges: int | None = None,
    categorical: Sequence[str] = (),
) -> DataFrame:
    """Everything about the newest log rows as one table ``feature, metric,
    value``: drift scores and verdicts, dataset verdict, means, shared
    histograms in percent and mean fare.

    With fewer than ``min_rows`` rows the only row is the metric
    ``too_few_rows``. ``tail`` is bounded (the last hundred rows), the reference
    need not be; ``ranges=1`` is for a staged reference sample. ``categorical`` columns are scored
    by the distance of their frequencies and take part in the dataset verdict. Against a stored
    summary of the reference: `reference.drift_report`.
    """
    columns = [c for c in common_columns(reference.select(*_known(reference)), tail) if c not in categorical]
    drift = column_drift(reference, tail, columns, ranges=ranges)
    if categorical:
        drift = drift.unionByName(column_drift_cat(reference, tail, categorical))
    means = mean_shift(reference, tail, columns).drop("change_pct", "drifted")
    bars = histogram_pair(reference, tail, [c for c in S.HISTOGRAM_FEATURES if c in columns])
    return report_of(drift, means, bars, tail, reference_fare_mean, log_rows, min_rows, prediction)


def report_of(
    drift: DataFrame,
    means: DataFrame,
    bars: DataFrame,
    tail: DataFrame,
    reference_fare_mean: Column | None = None,
    log_rows: Column | None = None,
    min_rows: int = S.MIN_LOG_ROWS,
    prediction: str = "prediction",
) -> DataFrame:
    """The report from its parts: drift and means per feature, shared histograms."""
    enough = tail.select(F.count(F.lit(1)) >= min_rows).scalar()

    def metric(feature: Column, name: Column, value: Column) -> Column:
        return F.struct(
            feature.alias("feature"), name.alias("metric"), value.cast("double").alias("value")
        )

    # One row per feature, and one over all of them.
    rolled = (
        drift.join(F.broadcast(means), "feature", "left")
        .groupingSets([[F.col("feature")], []], F.col("feature"))
        .agg(
            F.max("score").alias("score"),
            F.sum("drifted").alias("drifted"),
            F.count(F.lit(1)).alias("n"),
            F.max("reference_mean").alias("reference_mean"),
            F.max("current_mean").alias("current_mean"),
        )
    )
    share = N.ratio(F.col("drifted").cast("double"), F.col("n").cast("double"))
    overall = {
        "n_features": F.col("n"),
        "n_drifted": F.col("drifted"),
        "drift_share": share,
        "dataset_drift": (share > S.DRIFT_SHARE).cast("int"),
    }
    # Categories have no means.
    named = [F.when(F.col(m).isNotNull(), metric(F.col("feature"), F.lit(m), F.col(m))) for m in ("reference_mean", "current_mean")]
    single = [metric(F.col("feature"), F.lit(m), F.col(m)) for m in ("score", "drifted")]
    scores = rolled.where(enough).select(
        F.explode(
            F.when(
                F.col("feature").isNull(),
                F.array(*[metric(F.lit("dataset"), F.lit(m), v) for m, v in overall.items()]),
            ).otherwise(F.array_compact(F.array(*single, *named)))
        ).alias("_r")
    )
    bars = bars.where(enough)
    sides = [
        metric(F.col("feature"), F.format_string(f"{side}[%s]", F.col("label")), F.col(side))
        for side in ("reference_pct", "current_pct")
    ]
    whole = tail.agg(F.count(F.lit(1)).alias("n"), F.avg(prediction).alias("fare"))
    ok = F.col("n") >= min_rows
    total = F.col("n") if log_rows is None else log_rows
    rows = [
        metric(F.lit("dataset"), F.lit("total_predictions"), total),
        F.when(~ok, metric(F.lit("dataset"), F.lit("too_few_rows"), F.col("n"))),
        F.when(ok, metric(F.lit("fare_amount"), F.lit("current_mean"), F.col("fare"))),
    ]
    if reference_fare_mean is not None:
        rows.append(
            F.when(ok, metric(F.lit("fare_amount"), F.lit("reference_mean"), reference_fare_mean))
        )
    return (
        scores.select("_r.*")
        .unionByName(bars.select(F.explode(F.array(*sides)).alias("_r")).select("_r.*"))
        .unionByName(
            whole.select(F.explode(F.array_compact(F.array(*rows))).alias("_r")).select("_r.*")
        )
    )


def _known(df: DataFrame) -> list[str]:
    return [c for c in S.DRIFT_FEATURES if c in df.columns]
