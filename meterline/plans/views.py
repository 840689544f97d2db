"""Deterministic trip, log, zone and route views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline import schemas as S
from meterline.functions import calendar as C
from meterline.functions.trip import linear_fare
from meterline.operators import cleaning as CL, features as FE
from meterline.operators.lookups import route_mean_distance
from meterline.operators.sampling import split_data
from meterline.sources.readers import drop_unnamed_zones
from meterline.sources.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips made from ``lineitem``; unclean on purpose."""
    base = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "l_orderkey * 7 + l_linenumber * 13 + l_partkey * 3 as k"
    )
    located = CL.computed_once(
        base,
        ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"],
        VendorID=F.expr("1 + k % 2"),
        tpep_pickup_datetime=F.expr("timestampadd(MINUTE, cast(k % 1440 as int), l_shipdate)"),
        trip_distance=F.expr("l_quantity * (l_partkey % 10) / 20.0D * if(k % 31 = 0, 10.0D, 1.0D)"),
        _lag=F.expr("(l_suppkey * 5) % 600 - if(k % 37 = 0, 3600, 0)"),
        passenger_count=F.expr("if(k % 19 = 0, null, cast(k % 8 as double))"),
        PULocationID=F.expr("1 + l_partkey % 265"),
        DOLocationID=F.expr("1 + (l_suppkey * 31 + l_linenumber * 17) % 265"),
        payment_type=F.expr("1 + k % 4"),
        tolls_amount=F.expr("if(k % 11 = 0, 6.5D, 0.0D)"),
        _factor=F.expr("if(k % 29 = 0, 0.0D, if(k % 23 = 0, 9.0D, 1.0D))"),
    )
    metered = "(floor(trip_distance * 250) + floor(l_extendedprice) % 500 + 200) / 100.0D * _factor"
    priced = CL.computed_once(
        located,
        fare_amount=F.expr(f"if(_factor = 0.0D, -5.0D, {metered})"),
        tpep_dropoff_datetime=F.expr(
            "timestampadd(SECOND, cast(floor(trip_distance * 240) + _lag as int),"
            " tpep_pickup_datetime)"
        ),
    )
    return priced.selectExpr(
        "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
        " cast(rint(l_extendedprice * 100) as bigint))) as trip_id",
        "VendorID",
        S.PICKUP,
        S.DROPOFF,
        "passenger_count",
        "trip_distance",
        "PULocationID",
        "DOLocationID",
        "payment_type",
        "fare_amount",
        "fare_amount * l_discount as tip_amount",
        "tolls_amount",
        "fare_amount + fare_amount * l_discount + tolls_amount as total_amount",
    )


def timed_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips with time parts and duration, nothing filtered."""
    return trips(spark, sf_dir).transform(FE.time_parts).transform(CL.add_duration)


def strict_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly cleaned trips with the basic features; the trip key is kept."""
    return (
        trips(spark, sf_dir)
        .transform(CL.clean_trips, ("trip_id", "VendorID", "tolls_amount"))
        .transform(FE.engineer_features)
    )


def full_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips cleaned with the imputing preset, with the wide feature set."""
    return (
        trips(spark, sf_dir)
        .transform(CL.clean_trips_impute)
        .transform(FE.engineer_features_full)
    )


def scored_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict features with a 70/10/20 split and two transparent predictions."""
    d = F.col("trip_distance")
    return (
        strict_features(spark, sf_dir)
        .transform(split_data)
        .withColumns({"predicted": linear_fare(d), "predicted_b": linear_fare(d, 4.0, 2.4)})
    )


def split_of(scored: DataFrame, split: str) -> DataFrame:
    return scored.where(F.col("split") == split)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log made from ``events``."""
    return log_from_events(table(spark, sf_dir, "events"))


def log_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "ts",
        (F.col("value") / 10.0).alias("trip_distance"),
        (F.get_json_object("props", "$.k").cast("bigint") % 6 + 1).alias("passenger_count"),
        (F.col("user_id") % 265 + 1).alias("PULocationID"),
        (F.col("event_id") % 265 + 1).alias("DOLocationID"),
        C.hour_of(F.col("ts")).alias("pickup_hour"),
        C.weekday_of(F.col("ts")).alias("pickup_dayofweek"),
        C.month_of(F.col("ts")).alias("pickup_month"),
        linear_fare(F.col("value") / 10.0).alias("prediction"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone dimension made from ``nation`` and ``region``: 25 rows, and one
    without a borough that the null rule drops."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
    return drop_unnamed_zones(
        joined.select(
            F.col("n_nationkey").cast("bigint").alias("LocationID"),
            F.when(F.col("n_nationkey") != 24, F.col("r_name")).alias("Borough"),
            F.col("n_name").alias("Zone"),
        )
    )


def zoned_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips whose location ids are folded onto the 25 ids of :func:`zones`."""
    return trips(spark, sf_dir).withColumns(
        {"PULocationID": F.col("PULocationID") % 25, "DOLocationID": F.col("DOLocationID") % 25}
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route table of the training trips, staged so that its size is known to
    the optimizer when trips are joined to it."""
    train = split_of(scored_trips(spark, sf_dir), "train")
    return stage(route_mean_distance(train), "routes")
