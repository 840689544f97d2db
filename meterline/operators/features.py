"""Feature engineering: projections only, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from meterline import schemas as S
from meterline.functions import calendar as C, trip as TR
from meterline.operators import cleaning as CL


def time_parts(df: DataFrame, ts: str = S.PICKUP) -> DataFrame:
    t = F.col(ts)
    return df.withColumns(
        {
            "pickup_hour": C.hour_of(t),
            "pickup_day": C.day_of(t),
            "pickup_dayofweek": C.weekday_of(t),
            "pickup_month": C.month_of(t),
            "pickup_year": C.year_of(t),
        }
    )


def cyclic_encode(df: DataFrame, column: str, period: float, prefix: str | None = None) -> DataFrame:
    """``{prefix}_sin`` and ``{prefix}_cos``; a missing column is skipped."""
    if column not in df.columns:
        return df
    sin, cos = C.cyclic(F.col(column), period)
    name = prefix or column
    return df.withColumns({f"{name}_sin": sin, f"{name}_cos": cos})


def cyclic_time(df: DataFrame) -> DataFrame:
    out = {}
    for name, column, period in (
        ("hour", "pickup_hour", 24),
        ("dow", "pickup_dayofweek", 7),
        ("month", "pickup_month", 12),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = C.cyclic(F.col(column), period)
    return df.withColumns(out)


def polynomial(df: DataFrame, columns: Sequence[str], degree: int = 2) -> DataFrame:
    """``{c}_pow2 .. {c}_pow{degree}`` (powers only, no cross terms)."""
    powers = {
        f"{c}_pow{d}": F.pow(F.col(c), F.lit(float(d)))
        for c in columns
        if c in df.columns
        for d in range(2, degree + 1)
    }
    return df.withColumns(powers) if powers else df


def interaction(df: DataFrame, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    have = set(df.columns)
    products = {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs if {a, b} <= have}
    return df.withColumns(products) if products else df


def trip_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "same_location": TR.same_location(F.col("PULocationID"), F.col("DOLocationID")),
            "has_tip": TR.positive_flag(F.col("tip_amount")),
            "has_tolls": TR.positive_flag(F.col("tolls_amount")),
        }
    )


def engineer_features(df: DataFrame, max_speed: float = S.STRICT.max_speed) -> DataFrame:
    """Basic features over strictly cleaned trips: time parts, weekend, time of
    day, duration and speed with their range filters; raw datetimes dropped."""
    return (
        df.transform(time_parts)
        .withColumn("is_weekend", C.is_weekend(F.col("pickup_dayofweek")))
        .withColumn("time_of_day", C.time_of_day_cut(F.col("pickup_hour")))
        .transform(CL.add_duration)
        .transform(CL.filter_duration)
        .transform(CL.add_speed)
        .transform(CL.filter_speed, max_speed)
        .drop(S.PICKUP, S.DROPOFF)
    )


def engineer_features_full(df: DataFrame, rush: str = "train") -> DataFrame:
    """The wide feature set over trips cleaned with the imputing preset."""
    base = df.transform(time_parts).transform(cyclic_time)
    if "avg_speed_mph" not in df.columns:
        base = base.transform(CL.add_duration).transform(CL.add_speed)
    hour, dow = F.col("pickup_hour"), F.col("pickup_dayofweek")
    return base.withColumns(
        {
            "is_weekend": C.is_weekend(dow),
            "time_of_day": C.time_of_day_rule(hour),
            "is_rush_hour": C.is_rush_hour(hour, dow, rush),
            "distance_category": TR.distance_category(F.col("trip_distance")),
            "tip_percentage": TR.tip_percentage(F.col("tip_amount"), F.col("fare_amount")),
        }
    ).transform(trip_flags)


def serving_features(
    requests: DataFrame,
    rush: str = "train",
    vendor_id: int = 2,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The 18 model features of scoring requests, as one projection.

    The same expressions as in training are used, so a scored row sees what
    the model was fitted on; ``rush='serve'`` gives the all-week variant.
    """
    minutes = TR.estimate_duration(F.col("trip_distance"))
    hour, dow = F.col("pickup_hour"), F.col("pickup_dayofweek")
    hour_sin, hour_cos = C.cyclic(hour, 24)
    dow_sin, dow_cos = C.cyclic(dow, 7)
    derived = requests.withColumn("trip_duration_minutes", minutes).withColumns(
        {
            "avg_speed_mph": TR.avg_speed(
                F.col("trip_distance"), F.col("trip_duration_minutes"), "serve"
            ),
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
            "VendorID": F.lit(vendor_id),
            "has_tolls": F.lit(0),
            "is_rush_hour": C.is_rush_hour(hour, dow, rush),
            "same_location": TR.same_location(F.col("PULocationID"), F.col("DOLocationID")),
            "is_weekend": C.is_weekend(dow),
        }
    )
    return CL.conform_features(derived, S.ALL_FEATURES, keep)
