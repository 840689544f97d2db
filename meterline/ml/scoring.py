"""Transparent linear scoring and the shape of a scored record."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from meterline.functions import calendar as C, numeric as N


def linear_score(coefficients: Mapping[str, float], intercept: float = 0.0) -> Column:
    score = F.lit(float(intercept))
    for name, weight in coefficients.items():
        score = score + F.lit(float(weight)) * F.col(name)
    return score


def score_linear(
    df: DataFrame,
    coefficients: Mapping[str, float],
    intercept: float = 0.0,
    output: str = "predicted_fare",
) -> DataFrame:
    """Score with stored coefficients: stays in generated code, no model."""
    return df.withColumn(output, linear_score(coefficients, intercept))


def prediction_record(
    scored: DataFrame,
    prediction: str = "predicted_fare",
    timestamp: str = "ts",
    model_name: str = "trip-fare",
    model_version: str = "unknown",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Fare clamped at zero and in cents, with currency, model and time."""
    return scored.select(
        *keep,
        N.round_cents(N.floor_at_zero(F.col(prediction))).alias("predicted_fare"),
        F.lit("USD").alias("currency"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        C.iso_timestamp(F.col(timestamp)).alias("timestamp"),
    )
