"""Projections, filters and the cleaning presets.

Filters on stored columns merge into one predicate and are pushed to the
parquet reader; those on derived columns stay above the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from meterline import schemas as S
from meterline.functions import calendar as C
from meterline.functions.trip import avg_speed

# --- projections -------------------------------------------------------------


def select_available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def rename_target(df: DataFrame, column: str = S.TARGET) -> DataFrame:
    return df.withColumnRenamed(column, "target")


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def conform_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The features in model order; one the frame lacks becomes 0."""
    have = set(df.columns)
    return df.select(
        *keep, *[F.col(c) if c in have else F.lit(0).alias(c) for c in features]
    )


def require_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(
        *[f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def common_columns(reference: DataFrame, current: DataFrame) -> list[str]:
    return [c for c in reference.columns if c in set(current.columns)]


# --- row filters ---------------------------------------------------------------


def drop_nulls_any(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_nulls_subset(df: DataFrame, subset: Sequence[str] = S.CRITICAL_COLUMNS) -> DataFrame:
    return df.na.drop("any", subset=list(subset))


def fill_null(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.na.fill(dict(values))


def filter_between(df: DataFrame, column: str | Column, bounds: tuple[float, float]) -> DataFrame:
    value = F.col(column) if isinstance(column, str) else column
    return df.where(value.between(*bounds))


def filter_fare(df: DataFrame) -> DataFrame:
    return filter_between(df, "fare_amount", S.FARE_RANGE)


def filter_distance(df: DataFrame) -> DataFrame:
    return filter_between(df, "trip_distance", S.DISTANCE_RANGE)


def filter_passengers(df: DataFrame) -> DataFrame:
    return filter_between(df, "passenger_count", S.PASSENGER_RANGE)


def filter_total(df: DataFrame) -> DataFrame:
    return filter_between(df, "total_amount", S.TOTAL_RANGE)


def filter_duration(df: DataFrame) -> DataFrame:
    return filter_between(df, "trip_duration_minutes", S.DURATION_RANGE)


def filter_speed(df: DataFrame, max_speed: float = S.STRICT.max_speed) -> DataFrame:
    return filter_between(df, "avg_speed_mph", (1.0, max_speed))


def mask_filter(df: DataFrame, **limits: tuple[float, float]) -> DataFrame:
    """Open intervals: ``mask_filter(df, fare_amount=(0, 100))``."""
    masks = [(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in limits.items()]
    return df.where(reduce(lambda a, b: a & b, masks))


def isin_filter(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def regex_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


# --- presets -------------------------------------------------------------------


def computed_once(df: DataFrame, keep: Sequence[str] | None = None, **columns: Column) -> DataFrame:
    """Add columns whose expressions run once per row.

    A projected expression is copied into every filter that uses it once the
    optimizer pushes the filter down; a generator of one row is a stop. Filters
    on other columns still pass it and reach the scan.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    names = [c for c in (df.columns if keep is None else keep) if c not in columns]
    return df.select(*names, F.inline(F.array(row)))


def add_duration(df: DataFrame) -> DataFrame:
    minutes = C.duration_minutes(F.col(S.PICKUP), F.col(S.DROPOFF))
    return computed_once(df, trip_duration_minutes=minutes)


def add_speed(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "avg_speed_mph", avg_speed(F.col("trip_distance"), F.col("trip_duration_minutes"))
    )


def clean_trips(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Strict cleaning: required columns, no nulls, valid amounts. ``keep``
    names further columns to carry along unchecked, such as a row key."""
    required = [c for c in S.REQUIRED_COLUMNS if c in df.columns]
    return (
        df.transform(select_available, [*keep, *required])
        .transform(drop_nulls_subset, required)
        .transform(filter_fare)
        .transform(filter_distance)
        .transform(filter_passengers)
        .transform(filter_total)
    )


def clean_trips_impute(df: DataFrame, preset: S.CleaningPreset = S.IMPUTE) -> DataFrame:
    """Imputing cleaning: all columns kept, duration and speed filtered too."""
    return (
        df.transform(drop_nulls_subset, preset.null_subset)
        .transform(fill_null, dict(preset.fill))
        .transform(filter_fare)
        .transform(filter_distance)
        .transform(filter_passengers)
        .transform(filter_total)
        .transform(add_duration)
        .transform(filter_duration)
        .transform(add_speed)
        .transform(filter_speed, preset.max_speed)
    )


def cleaning_steps(df: DataFrame, preset: S.CleaningPreset) -> list[tuple[str, Column]]:
    """Name and predicate of each step, in the order the preset applies them."""
    fills = dict(preset.fill)
    if preset.null_subset is None:
        checked = [c for c in S.REQUIRED_COLUMNS if c in df.columns]
    else:
        checked = list(preset.null_subset)
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in checked])
    passengers = F.col("passenger_count")
    if "passenger_count" in fills:
        passengers = F.coalesce(passengers, F.lit(fills["passenger_count"]))
    minutes = C.duration_minutes(F.col(S.PICKUP), F.col(S.DROPOFF))
    return [
        ("nulls", not_null),
        ("fare", F.col("fare_amount").between(*S.FARE_RANGE)),
        ("distance", F.col("trip_distance").between(*S.DISTANCE_RANGE)),
        ("passengers", passengers.between(*S.PASSENGER_RANGE)),
        ("total", F.col("total_amount").between(*S.TOTAL_RANGE)),
        ("duration", minutes.between(*S.DURATION_RANGE)),
        ("speed", avg_speed(F.col("trip_distance"), minutes).between(1.0, preset.max_speed)),
    ]


def clean_audit(df: DataFrame, preset: S.CleaningPreset = S.STRICT) -> DataFrame:
    """Rows kept and removed per step, from one pass over the data.

    A row belongs to the first step it fails, so one integer per row and one
    count per step replace a job per filter.
    """
    steps = cleaning_steps(df, preset)
    first_failed = F.lit(len(steps))
    for i in reversed(range(len(steps))):
        first_failed = F.when(F.coalesce(steps[i][1], F.lit(False)), first_failed).otherwise(i)
    counts = df.select(first_failed.alias("failed")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("failed") >= i).alias(f"reached_{i}") for i in range(1, len(steps) + 1)],
    )
    rows = [
        F.struct(F.lit(0).alias("step"), F.lit("initial").alias("name"),
                 F.col("total").alias("kept"), F.lit(0).cast("bigint").alias("removed"))
    ]
    for i, (name, _) in enumerate(steps, start=1):
        before = F.col("total") if i == 1 else F.col(f"reached_{i - 1}")
        rows.append(
            F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"),
                     F.col(f"reached_{i}").alias("kept"),
                     (before - F.col(f"reached_{i}")).alias("removed"))
        )
    return counts.select(
        "total", F.explode(F.array(*rows)).alias("r")
    ).select(
        "r.*",
        F.round(F.try_divide(F.col("r.kept") * F.lit(100.0), F.col("total")), 6).alias("kept_pct"),
    )


# --- request validation ----------------------------------------------------------

# Defaults and limits of a scoring request.
REQUEST_DEFAULTS = {
    "PULocationID": 161,
    "DOLocationID": 237,
    "pickup_month": 1,
    "is_weekend": 0,
    "trip_duration_minutes": 15.0,
}
REQUEST_RULES = {
    "trip_distance": (0.1, 100.0),
    "passenger_count": (1, 6),
    "PULocationID": (1, None),
    "DOLocationID": (1, None),
    "pickup_hour": (0, 23),
    "pickup_dayofweek": (0, 6),
    "pickup_month": (1, 12),
    "is_weekend": (0, 1),
    "trip_duration_minutes": (1.0, 180.0),
}


def validate_trips(df: DataFrame) -> DataFrame:
    """Fill request defaults and mark rows: ``failed_rules`` names what broke,
    ``valid`` is true for none. Split on ``valid`` to quarantine."""
    have = set(df.columns)
    filled = df
    for name, default in REQUEST_DEFAULTS.items():
        value = F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
        filled = filled.withColumn(name, value)
    failures = []
    for name, (low, high) in REQUEST_RULES.items():
        ok = F.col(name) >= low
        if high is not None:
            ok = ok & (F.col(name) <= high)
        failures.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    return filled.withColumn("failed_rules", F.array_compact(F.array(*failures))).withColumn(
        "valid", F.size("failed_rules") == 0
    )
