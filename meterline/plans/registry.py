"""The query registry behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meterline.plans.oracle import sql

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums differ in the last bits with the order of addition; results are
    compared after rounding (adding 0.0 turns -0.0 into 0.0)."""
    return df.select(
        *[
            (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register under a name, with the SQL body that follows the views."""

    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query: {name}")
        REGISTRY[name] = Query(
            lambda spark, sf_dir: rounded(fn(spark, sf_dir)), None if oracle is None else sql(oracle)
        )
        return fn

    return add
