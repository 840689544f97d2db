"""Trip, zone and fare column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meterline import schemas as S
from meterline.functions.numeric import clip, cut, ratio


def avg_speed(distance: Column, minutes: Column, variant: str = "clean") -> Column:
    """Miles per hour.

    ``clean``: plain ratio, null for a zero duration; ``guarded``: 0.01 h added
    to the duration; ``serve``: fallback for a duration that is not positive,
    then clipped to the serving range.
    """
    if variant == "clean":
        return ratio(distance, minutes / 60.0)
    if variant == "guarded":
        return ratio(distance, minutes / 60.0 + 0.01)
    if variant == "serve":
        speed = F.when(minutes <= 0, F.lit(S.FALLBACK_SPEED_MPH)).otherwise(
            ratio(distance, minutes / 60.0)
        )
        return clip(speed, *S.SERVING_SPEED_RANGE)
    raise ValueError(f"unknown speed variant: {variant}")


def tip_percentage(tip: Column, fare: Column) -> Column:
    return F.when(fare > 0, ratio(tip, fare) * 100.0).otherwise(F.lit(0.0))


def positive_flag(amount: Column) -> Column:
    return F.coalesce(amount > 0, F.lit(False)).cast("int")


def same_location(pickup: Column, dropoff: Column) -> Column:
    return F.coalesce(pickup == dropoff, F.lit(False)).cast("int")


def estimate_duration(distance: Column, mph: float = S.NETWORK_SPEED_MPH) -> Column:
    return clip(distance / F.lit(mph) * 60.0, *S.DURATION_RANGE)


def estimate_duration_steps(distance: Column) -> Column:
    """Slower speeds and a minimum time for very short trips."""
    return (
        F.when(distance < 0.5, F.greatest(F.lit(3.0), distance / 7.0 * 60.0))
        .when(distance < 1.0, F.greatest(F.lit(5.0), distance / 9.0 * 60.0))
        .otherwise(distance / 12.0 * 60.0)
    )


def distance_category(distance: Column) -> Column:
    return cut(distance, S.DISTANCE_CATEGORY_EDGES, S.DISTANCE_CATEGORY_LABELS)


def fare_range(fare: Column) -> Column:
    return cut(fare, S.FARE_BIN_EDGES, S.FARE_BIN_LABELS, include_lowest=True)


def distance_range(distance: Column) -> Column:
    return cut(distance, S.DISTANCE_BIN_EDGES, S.DISTANCE_BIN_LABELS, include_lowest=True)


def fare_tier(fare: Column) -> Column:
    return F.when(fare < 10, "short").when(fare < 30, "medium").otherwise("long")


def error_columns(actual: Column, predicted: Column) -> dict[str, Column]:
    error = actual - predicted
    return {
        "error": error,
        "abs_error": F.abs(error),
        "pct_error": ratio(F.abs(error), actual) * 100.0,
    }


def route_key(pickup: Column, dropoff: Column) -> Column:
    return F.concat_ws("_", pickup.cast("string"), dropoff.cast("string"))


def parse_route_key(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, "_")
    return F.try_element_at(parts, F.lit(1)).try_cast("bigint"), F.try_element_at(
        parts, F.lit(2)
    ).try_cast("bigint")


def zone_label(zone: Column, borough: Column) -> Column:
    return F.format_string("%s (%s)", zone, borough)


def payment_label(code: Column) -> Column:
    pairs = [F.lit(x) for item in S.PAYMENT_LABELS.items() for x in item]
    known = F.try_element_at(F.create_map(*pairs), code.cast("int"))
    return F.coalesce(known, F.format_string("Unknown (%s)", code.cast("string")))


def as_string_key(value: Column) -> Column:
    return value.cast("string")


def linear_fare(
    distance: Column, intercept: float = 3.0, per_mile: float = 2.6
) -> Column:
    return F.lit(intercept) + F.lit(per_mile) * distance
