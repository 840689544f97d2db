"""Registered queries: sources, sinks, projections, filters and scalars."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark.sql import functions as F

from meterline import schemas as S
from meterline.functions import calendar as C, numeric as N, trip as TR
from meterline.operators import cleaning as CL, features as FE, sets as SE
from meterline.operators import evaluation as EV, profile as PR, ranking as RK
from meterline.plans import views as V
from meterline.plans.registry import query
from meterline.sources import readers as RD, staging as ST, writers as WR

# --- sources ---------------------------------------------------------------------


@query("s1_scan_parquet", "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def _(spark, d):
    return RD.scan_parquet(
        spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_extendedprice"]
    )


@query(
    "s2_scan_many",
    """SELECT n_nationkey, n_name, n_regionkey, NULL::INT AS r_regionkey, NULL::VARCHAR AS r_name
    FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region""",
)
def _(spark, d):
    return RD.scan_many(spark, [f"{d}/nation.parquet", f"{d}/region.parquet"])


@query(
    "s3_select_months",
    """SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS orders,
      round(avg(o_totalprice), 6) AS mean_price, sum(o_custkey)::DOUBLE AS custkeys,
      sum(CASE WHEN month(o_orderdate) % 2 = 0 THEN 1.5 END)::DOUBLE AS fees,
      min(o_orderdate)::TIMESTAMP AS first_day
    FROM orders WHERE month(o_orderdate) <> 7 GROUP BY 1, 2""",
)
def _(spark, d):
    # All orders as monthly files: even months have a column more, and another type of key; some
    # hold prices as decimals, some days as dates. Every month but July is asked for.
    folder = ST.new_path(spark, "months")
    orders = V.table(spark, d, "orders")
    month = F.month("o_orderdate")
    years = [r[0] for r in orders.select(F.year("o_orderdate")).distinct().collect()]
    even = orders.withColumns({"fee": F.lit(1.5), "o_custkey": F.col("o_custkey").cast("double")})

    def put(at: tuple[int, int]) -> None:
        year, m = at
        source = orders if m % 2 else even
        rows = source.where((F.year("o_orderdate") == year) & (month == m))
        if m % 3 == 0:
            rows = rows.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(14,4)"))
        if m % 4 == 1:
            rows = rows.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
        rows.write.parquet(RD.month_paths(folder, year, [m])[0])

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(put, product(years, range(1, 13))))
    some = [m for m in range(1, 13) if m != 7]
    frames = [RD.select_months(spark, folder, y, some) for y in years]
    months = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return months.groupBy(F.year("o_orderdate").alias("y"), month.alias("m")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.avg("o_totalprice").alias("mean_price"),
        F.sum(F.col("o_custkey").cast("double")).alias("custkeys"),
        F.sum("fee").alias("fees"),
        F.min("o_orderdate").alias("first_day"),
    )


@query("s4_scan_zones", "SELECT LocationID, Borough, Zone FROM zones")
def _(spark, d):
    nation, region = V.table(spark, d, "nation"), V.table(spark, d, "region")
    raw = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left").select(
        F.col("n_nationkey").alias("LocationID"),
        F.when(F.col("n_nationkey") != 24, F.col("r_name")).alias("Borough"),
        F.col("n_name").alias("Zone"),
        F.lit("Yellow Zone").alias("service_zone"),
    )
    path = ST.new_path(spark, "zones")
    raw.write.csv(path, header=True)
    return RD.scan_zones(spark, path).select("LocationID", "Borough", "Zone")


@query(
    "s5_scan_prediction_log",
    """SELECT event_id, round(trip_distance, 6) AS trip_distance, passenger_count::BIGINT AS passenger_count,
      pickup_hour::BIGINT AS pickup_hour, round(prediction, 6) AS prediction FROM log""",
)
def _(spark, d):
    # Half of the records use the old key of the nested record.
    log = V.event_log(spark, d)
    inputs = F.struct("trip_distance", "passenger_count", "pickup_hour")
    old = F.col("event_id") % 2 == 0
    path = ST.new_path(spark, "log")
    log.select(
        F.col("event_id").cast("string").alias("timestamp"),
        F.when(~old, inputs).alias("inputs"),
        F.when(old, inputs).alias("input"),
        "prediction",
    ).write.json(path)
    return RD.flatten_inputs(RD.scan_prediction_log(spark, path)).select(
        F.col("timestamp").cast("bigint").alias("event_id"),
        "trip_distance",
        "passenger_count",
        "pickup_hour",
        "prediction",
    )


@query(
    "s5b_scan_prediction_log_arrays",
    """SELECT event_id, round(trip_distance, 6) AS trip_distance, passenger_count::BIGINT AS passenger_count,
      round(prediction, 6) AS prediction FROM log""",
)
def _(spark, d):
    # Files of one array each, as the service writes them; an array has some hundred records.
    log = V.event_log(spark, d)
    record = F.struct(
        F.col("event_id").cast("string").alias("timestamp"),
        F.struct("trip_distance", "passenger_count").alias("inputs"),
        "prediction",
    )
    arrays = log.groupBy(F.expr("event_id div 400").alias("part")).agg(F.to_json(F.collect_list(record), {"pretty": "true"}).alias("j"))
    path = ST.new_path(spark, "log-arrays")
    arrays.select("j").write.text(path)
    return RD.flatten_inputs(RD.scan_prediction_log(spark, path)).select(
        F.col("timestamp").cast("bigint").alias("event_id"), "trip_distance", "passenger_count", "prediction"
    )


@query(
    "s6_scan_route_table",
    """SELECT PULocationID, DOLocationID, round(avg_distance, 6) AS avg_distance
    FROM routes""",
)
def _(spark, d):
    # One JSON object per pickup zone, as the lookup file stores its routes; an
    # object has at most one entry per drop-off zone.
    key = TR.route_key(F.col("PULocationID"), F.col("DOLocationID"))
    per_zone = (
        V.routes(spark, d)
        .groupBy("PULocationID")
        .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, "avg_distance")))).alias("j"))
    )
    path = ST.new_path(spark, "routes-json")
    per_zone.select("j").write.text(path)
    return RD.scan_route_table(spark, path)


# --- sinks -----------------------------------------------------------------------


@query("k1_write_splits", "SELECT split, count(*) AS rows, round(avg(fare_amount), 6) AS fare FROM scored GROUP BY 1")
def _(spark, d):
    path = ST.new_path(spark, "splits")
    WR.write_splits(V.scored_trips(spark, d).select(*S.BASIC_FEATURES, S.TARGET, "split"), path)
    return (
        WR.read_split(spark, path)
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("fare_amount").alias("fare"))
    )


_METRICS = """round(sqrt(avg((fare_amount - predicted) ** 2)), 6) AS rmse,
  round(avg(abs(fare_amount - predicted)), 6) AS mae,
  round(1 - avg((fare_amount - predicted) ** 2) / var_pop(fare_amount), 6) AS r2,
  round(avg(abs(fare_amount - predicted) / abs(fare_amount)) * 100, 6) AS mape"""


@query("k2_write_metrics_csv", f"SELECT {_METRICS} FROM test")
def _(spark, d):
    path = ST.new_path(spark, "metrics")
    WR.write_metrics_csv(EV.metrics(V.split_of(V.scored_trips(spark, d), "test")), path)
    return spark.read.schema("rmse double, mae double, r2 double, mape double").csv(path, header=True)


@query(
    "k3_write_stats_json",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, 10::BIGINT AS bars FROM train"""
        for c in S.STATS_FEATURES
    ),
)
def _(spark, d):
    path = ST.new_path(spark, "stats")
    WR.write_stats_json(PR.reference_stats(V.split_of(V.scored_trips(spark, d), "train")), path)
    schema = "feature string, mean double, std double, hist array<double>, bin_edges array<double>, min double, max double"
    return spark.read.schema(schema).json(path).select(
        "feature", "mean", "std", "min", "max", F.size("hist").cast("bigint").alias("bars")
    )


@query(
    "k4_write_predictions",
    "SELECT trip_id, trip_distance, round(predicted, 6) AS predicted_fare FROM test",
)
def _(spark, d):
    path = ST.new_path(spark, "predictions")
    scored = V.split_of(V.scored_trips(spark, d), "test")
    WR.write_predictions(scored.withColumnRenamed("predicted", "predicted_fare"), path)
    return spark.read.parquet(path).select("trip_id", "trip_distance", "predicted_fare")


@query(
    "k5_append_log",
    """SELECT event_id, round(trip_distance, 6) AS trip_distance, round(prediction, 6) AS prediction
    FROM log ORDER BY ts DESC, event_id DESC LIMIT 1000""",
)
def _(spark, d):
    # Two appends; the retention limit is applied when reading.
    path = ST.new_path(spark, "log-append")
    log = V.event_log(spark, d)
    log = log.withColumn("day", F.to_date("ts"))
    WR.append_log(log.where("event_id % 3 = 0"), path, "day")
    WR.append_log(log.where("event_id % 3 <> 0"), path, "day")
    kept = RK.last_n(spark.read.parquet(path), S.LOG_RETENTION, "ts", "event_id")
    return kept.select("event_id", "trip_distance", "prediction")


@query(
    "k5b_compact_log",
    """SELECT strftime(l.day, '%Y-%m-%d') AS day, (l.day < DATE '2024-01-20')::INT AS compacted, count(*) AS rows, round(sum(prediction), 4) AS predictions,
      TRUE AS few_files FROM (SELECT ts::DATE AS day, prediction FROM log) l GROUP BY l.day""",
)
def _(spark, d):
    # Many small files a day; the closed days become one file each.
    path = ST.new_path(spark, "log-compact")
    log = V.event_log(spark, d).withColumn("day", F.to_date("ts"))
    for k in range(2):
        WR.append_log(log.where(F.col("event_id") % 2 == k).repartition(4), path, "day")
    closed = [f"2024-01-{x:02d}" for x in range(1, 20)]
    WR.compact_log(spark, path, closed)
    rows = spark.read.parquet(path).withColumn("file", F.input_file_name())
    compacted = F.col("day") < F.lit("2024-01-20").cast("date")
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.max(compacted.cast("int")).alias("compacted"),
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("prediction"), 4).alias("predictions"),
        (F.max(~compacted) | (F.count_distinct("file") == 1)).alias("few_files"),
    )


# --- projections -------------------------------------------------------------------


@query(
    "p1_select_available",
    "SELECT passenger_count, trip_distance, round(fare_amount, 6) AS fare_amount FROM trips",
)
def _(spark, d):
    return CL.select_available(
        V.trips(spark, d), ["passenger_count", "trip_distance", "not_there", "fare_amount"]
    )


_KEY = "SELECT trip_id FROM trips WHERE "


def _kept(name, where, fn):
    @query(name, _KEY + where)
    def _(spark, d):
        return fn(V.trips(spark, d)).select("trip_id")


_kept("p2_drop_nulls_any", "passenger_count IS NOT NULL", CL.drop_nulls_any)


@query(
    "p3_drop_nulls_subset",
    """SELECT count(*) AS rows, count_if(passenger_count IS NULL)::BIGINT AS null_passengers
    FROM trips WHERE trip_distance IS NOT NULL""",
)
def _(spark, d):
    return CL.drop_nulls_subset(V.trips(spark, d)).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("passenger_count").isNull()).alias("null_passengers"),
    )


@query("p4_fill_null", "SELECT trip_id, coalesce(passenger_count, 1.0::DOUBLE) AS passenger_count FROM trips")
def _(spark, d):
    return CL.fill_null(V.trips(spark, d), {"passenger_count": 1.0}).select(
        "trip_id", "passenger_count"
    )


_kept("p5_filter_fare", "fare_amount BETWEEN 2.5 AND 500", CL.filter_fare)
_kept("p6_filter_distance", "trip_distance BETWEEN 0.1 AND 100", CL.filter_distance)
_kept("p7_filter_passengers", "passenger_count BETWEEN 1 AND 6", CL.filter_passengers)
_kept("p8_filter_total", "total_amount BETWEEN 2.5 AND 1000", CL.filter_total)


@query("p9_filter_duration", "SELECT trip_id FROM timed WHERE trip_duration_minutes BETWEEN 1 AND 180")
def _(spark, d):
    return CL.filter_duration(V.timed_trips(spark, d)).select("trip_id")


@query(
    "p10_filter_speed",
    """SELECT trip_id FROM timed WHERE trip_duration_minutes <> 0
    AND trip_distance / (trip_duration_minutes / 60) BETWEEN 1 AND 60""",
)
def _(spark, d):
    return CL.filter_speed(CL.add_speed(V.timed_trips(spark, d))).select("trip_id")


@query(
    "p11_clean_trips",
    "SELECT trip_id, passenger_count, trip_distance, round(fare_amount, 6) AS fare_amount, round(total_amount, 6) AS total_amount FROM clean",
)
def _(spark, d):
    return CL.clean_trips(V.trips(spark, d), ["trip_id"]).select(
        "trip_id", "passenger_count", "trip_distance", "fare_amount", "total_amount"
    )


@query(
    "p12_clean_trips_impute",
    """SELECT trip_id, passenger_count, round(trip_duration_minutes, 6) AS trip_duration_minutes,
    round(avg_speed_mph, 6) AS avg_speed_mph FROM imputed""",
)
def _(spark, d):
    return CL.clean_trips_impute(V.trips(spark, d)).select(
        "trip_id", "passenger_count", "trip_duration_minutes", "avg_speed_mph"
    )


def _audit_sql(preset: S.CleaningPreset) -> str:
    riders = "passenger_count" if preset is S.STRICT else "coalesce(passenger_count, 1.0)"
    nulls = "passenger_count IS NOT NULL" if preset is S.STRICT else "trip_distance IS NOT NULL"
    steps = [
        ("nulls", nulls),
        ("fare", "fare_amount BETWEEN 2.5 AND 500"),
        ("distance", "trip_distance BETWEEN 0.1 AND 100"),
        ("passengers", f"{riders} BETWEEN 1 AND 6"),
        ("total", "total_amount BETWEEN 2.5 AND 1000"),
        ("duration", "trip_duration_minutes BETWEEN 1 AND 180"),
        (
            "speed",
            "trip_duration_minutes <> 0 AND trip_distance / (trip_duration_minutes / 60)"
            f" BETWEEN 1 AND {preset.max_speed}",
        ),
    ]
    rows = ["SELECT 0 AS step, 'initial' AS name, count(*) AS kept FROM timed"]
    for i, (name, _) in enumerate(steps, start=1):
        where = " AND ".join(f"({p})" for _, p in steps[:i])
        rows.append(f"SELECT {i} AS step, '{name}' AS name, count(*) AS kept FROM timed WHERE {where}")
    return f"""SELECT step::INT AS step, name, kept,
      coalesce(lag(kept) OVER (ORDER BY step) - kept, 0)::BIGINT AS removed,
      round(kept * 100.0::DOUBLE / max(kept) OVER (), 6) AS kept_pct
      FROM ({" UNION ALL ".join(rows)})"""


@query("p13_clean_audit", _audit_sql(S.STRICT))
def _(spark, d):
    return CL.clean_audit(V.trips(spark, d), S.STRICT)


@query("p13b_clean_audit_impute", _audit_sql(S.IMPUTE))
def _(spark, d):
    return CL.clean_audit(V.trips(spark, d), S.IMPUTE)


_kept(
    "p14_mask_filter",
    "fare_amount > 0 AND fare_amount < 100 AND trip_distance > 0 AND trip_distance < 30",
    lambda t: CL.mask_filter(t, fare_amount=(0, 100), trip_distance=(0, 30)),
)
_kept("p15_isin_filter", "payment_type IN (1, 2)", lambda t: CL.isin_filter(t, "payment_type", [1, 2]))

_FARE_RANGE = """CASE WHEN fare_amount < 0 THEN NULL WHEN fare_amount <= 10 THEN '$0-10'
  WHEN fare_amount <= 20 THEN '$10-20' WHEN fare_amount <= 30 THEN '$20-30'
  WHEN fare_amount <= 50 THEN '$30-50' WHEN fare_amount <= 100 THEN '$50-100' ELSE '$100+' END"""
_DISTANCE_RANGE = """CASE WHEN trip_distance < 0 THEN NULL WHEN trip_distance <= 1 THEN '0-1 mi'
  WHEN trip_distance <= 3 THEN '1-3 mi' WHEN trip_distance <= 5 THEN '3-5 mi'
  WHEN trip_distance <= 10 THEN '5-10 mi' WHEN trip_distance <= 20 THEN '10-20 mi'
  ELSE '20+ mi' END"""


@query(
    "p16_regex_filter",
    f"""SELECT fare_range, count(*) AS trips FROM (SELECT {_FARE_RANGE} AS fare_range FROM trips)
    WHERE regexp_matches(fare_range, '50|100') GROUP BY 1""",
)
def _(spark, d):
    ranges = V.trips(spark, d).select(TR.fare_range(F.col("fare_amount")).alias("fare_range"))
    return CL.regex_filter(ranges, "fare_range", "50|100").groupBy("fare_range").agg(
        F.count(F.lit(1)).alias("trips")
    )


@query("p17_rename_target", "SELECT trip_id, round(fare_amount, 6) AS target FROM trips")
def _(spark, d):
    return CL.rename_target(V.trips(spark, d)).select("trip_id", "target")


@query("p18_drop_columns", "SELECT trip_id, VendorID, passenger_count, trip_distance, PULocationID, DOLocationID, payment_type, tolls_amount FROM trips")
def _(spark, d):
    return CL.drop_columns(
        V.trips(spark, d), [S.PICKUP, S.DROPOFF, "fare_amount", "tip_amount", "total_amount"]
    )


@query(
    "p19_conform_features",
    "SELECT trip_id, DOLocationID, trip_distance, 0 AS not_there FROM trips",
)
def _(spark, d):
    return CL.conform_features(
        V.trips(spark, d), ["DOLocationID", "trip_distance", "not_there"], keep=["trip_id"]
    )


@query("p20_require_features", "SELECT passenger_count, trip_distance FROM clean")
def _(spark, d):
    cleaned = CL.clean_trips(V.trips(spark, d))
    try:
        CL.require_features(cleaned, ["trip_distance", "not_there"])
    except ValueError:
        pass
    else:
        raise AssertionError("a missing feature must be refused")
    names = ["passenger_count", "trip_distance"]
    return CL.require_features(cleaned, names).select(*names)


@query(
    "p21_select_numeric",
    """SELECT VendorID, passenger_count, trip_distance, PULocationID, DOLocationID, payment_type,
    round(fare_amount, 6) AS fare_amount, round(tip_amount, 6) AS tip_amount, tolls_amount, round(total_amount, 6) AS total_amount FROM trips""",
)
def _(spark, d):
    return CL.select_numeric(V.trips(spark, d))


@query("p21b_select_categorical", "SELECT trip_id FROM trips")
def _(spark, d):
    return CL.select_categorical(V.trips(spark, d))


@query(
    "p22_common_columns",
    """SELECT passenger_count::DOUBLE AS passenger_count, round(trip_distance, 6) AS trip_distance, PULocationID, DOLocationID, pickup_hour,
    pickup_dayofweek, pickup_month FROM log""",
)
def _(spark, d):
    log = V.event_log(spark, d)
    names = CL.common_columns(V.strict_features(spark, d), log)
    return log.select(*names).withColumn("passenger_count", F.col("passenger_count").cast("double"))


@query(
    "p23_validate_trips",
    """SELECT event_id, trip_distance BETWEEN 0.1 AND 100 AS valid,
    CASE WHEN trip_distance BETWEEN 0.1 AND 100 THEN '' ELSE 'trip_distance' END AS failed_rules FROM log""",
)
def _(spark, d):
    checked = CL.validate_trips(V.event_log(spark, d))
    return checked.select(
        "event_id", "valid", F.array_join("failed_rules", ",").alias("failed_rules")
    )


@query(
    "p23b_validate_raw_trips",
    """SELECT failed_rules, count(*) AS rows FROM (SELECT concat_ws(',',
      CASE WHEN trip_distance BETWEEN 0.1 AND 100 THEN NULL ELSE 'trip_distance' END,
      CASE WHEN coalesce(passenger_count BETWEEN 1 AND 6, false) THEN NULL ELSE 'passenger_count' END,
      CASE WHEN trip_duration_minutes BETWEEN 1 AND 180 THEN NULL ELSE 'trip_duration_minutes' END
    ) AS failed_rules FROM timed) GROUP BY 1""",
)
def _(spark, d):
    checked = CL.validate_trips(V.timed_trips(spark, d))
    return checked.groupBy(F.array_join("failed_rules", ",").alias("failed_rules")).agg(
        F.count(F.lit(1)).alias("rows")
    )


# --- scalars -----------------------------------------------------------------------


@query(
    "f1_time_parts",
    "SELECT trip_id, pickup_hour, pickup_day, pickup_dayofweek, pickup_month, pickup_year FROM timed",
)
def _(spark, d):
    return FE.time_parts(V.trips(spark, d)).select(
        "trip_id", "pickup_hour", "pickup_day", "pickup_dayofweek", "pickup_month", "pickup_year"
    )


def _trip_columns(name: str, columns: Callable[[], dict], sql_columns: str, source: str = "timed"):
    """One row per trip: the key and the named expressions."""

    @query(name, f"SELECT trip_id, {sql_columns} FROM {source}")
    def _(spark, d):
        base = V.timed_trips(spark, d) if source == "timed" else V.scored_trips(spark, d)
        return base.select("trip_id", *[c.alias(n) for n, c in columns().items()])


def _c(name):
    return F.col(name)


_trip_columns(
    "f2_parse_ts",
    lambda: {
        "parsed": C.parse_ts(_c(S.PICKUP).cast("string")),
        "bad": C.parse_ts(F.concat(F.lit("x"), _c("trip_id"))).isNull(),
    },
    "tpep_pickup_datetime AS parsed, true AS bad",
)
_trip_columns(
    "f3_duration_minutes",
    lambda: {"minutes": C.duration_minutes(_c(S.PICKUP), _c(S.DROPOFF))},
    "round(trip_duration_minutes, 6) AS minutes",
)
_trip_columns(
    "f4_is_weekend",
    lambda: {"is_weekend": C.is_weekend(_c("pickup_dayofweek"))},
    "(pickup_dayofweek >= 5)::INT AS is_weekend",
)
_trip_columns(
    "f5_time_of_day_cut",
    lambda: {"time_of_day": C.time_of_day_cut(_c("pickup_hour"))},
    """CASE WHEN pickup_hour <= 6 THEN 'night' WHEN pickup_hour <= 12 THEN 'morning'
    WHEN pickup_hour <= 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day""",
)
_trip_columns(
    "f6_time_of_day_rule",
    lambda: {"time_of_day": C.time_of_day_rule(_c("pickup_hour"))},
    """CASE WHEN pickup_hour BETWEEN 6 AND 11 THEN 'morning' WHEN pickup_hour BETWEEN 12 AND 16
    THEN 'afternoon' WHEN pickup_hour BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day""",
)
_trip_columns(
    "f7_is_rush_hour",
    lambda: {v: C.is_rush_hour(_c("pickup_hour"), _c("pickup_dayofweek"), v) for v in ("train", "serve", "ui")},
    """((pickup_hour BETWEEN 7 AND 9 OR pickup_hour BETWEEN 16 AND 19) AND pickup_dayofweek < 5)::INT AS train,
    (pickup_hour BETWEEN 16 AND 19)::INT AS serve, (pickup_hour IN (7, 8, 9, 17, 18, 19))::INT AS ui""",
)
_trip_columns(
    "f8_day_name", lambda: {"day": C.day_name(_c("pickup_dayofweek"))}, "dayname(tpep_pickup_datetime) AS day"
)
_trip_columns(
    "f9_cyclic_encode",
    lambda: dict(zip(("pickup_day_sin", "pickup_day_cos"), C.cyclic(_c("pickup_day"), 31))),
    """round(sin(2 * pi() * pickup_day / 31), 6) + 0.0 AS pickup_day_sin,
    round(cos(2 * pi() * pickup_day / 31), 6) + 0.0 AS pickup_day_cos""",
)


@query(
    "f10_cyclic_time",
    "SELECT trip_id, "
    + ", ".join(
        f"round({fn}(2 * pi() * {col} / {p}), 6) + 0.0 AS {name}_{fn}"
        for name, col, p in (("hour", "pickup_hour", 24), ("dow", "pickup_dayofweek", 7), ("month", "pickup_month", 12))
        for fn in ("sin", "cos")
    )
    + " FROM timed",
)
def _(spark, d):
    return FE.cyclic_time(V.timed_trips(spark, d)).select(
        "trip_id", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"
    )


_trip_columns(
    "f11_avg_speed",
    lambda: {v: TR.avg_speed(_c("trip_distance"), _c("trip_duration_minutes"), v) for v in ("clean", "guarded", "serve")},
    """CASE WHEN trip_duration_minutes = 0 THEN NULL ELSE round(trip_distance / (trip_duration_minutes / 60), 6) + 0.0 END AS clean,
    round(trip_distance / (trip_duration_minutes / 60 + 0.01::DOUBLE), 6) + 0.0 AS guarded,
    round(greatest(1.0::DOUBLE, least(60.0::DOUBLE, CASE WHEN trip_duration_minutes <= 0 THEN 12.0::DOUBLE
      ELSE trip_distance / (trip_duration_minutes / 60) END)), 6) AS serve""",
)


@query(
    "f12_polynomial",
    """SELECT trip_id, round(trip_distance ** 2, 6) AS trip_distance_pow2,
    round(trip_distance ** 3, 4) AS trip_distance_pow3 FROM scored""",
)
def _(spark, d):
    out = FE.polynomial(V.scored_trips(spark, d), ["trip_distance", "not_there"], 3)
    return out.select(
        "trip_id", "trip_distance_pow2", F.round("trip_distance_pow3", 4).alias("trip_distance_pow3")
    )


@query(
    "f13_interaction",
    "SELECT trip_id, round(trip_distance * pickup_hour, 6) AS trip_distance_x_pickup_hour FROM scored",
)
def _(spark, d):
    pairs = [("trip_distance", "pickup_hour"), ("trip_distance", "not_there")]
    return FE.interaction(V.scored_trips(spark, d), pairs).select("trip_id", "trip_distance_x_pickup_hour")


_trip_columns(
    "f14_tip_percentage",
    lambda: {"tip_percentage": TR.tip_percentage(_c("tip_amount"), _c("fare_amount"))},
    "CASE WHEN fare_amount > 0 THEN round(tip_amount / fare_amount * 100, 6) ELSE 0.0::DOUBLE END AS tip_percentage",
)


@query(
    "f15_trip_flags",
    """SELECT trip_id, (PULocationID = DOLocationID)::INT AS same_location,
    (tip_amount > 0)::INT AS has_tip, (tolls_amount > 0)::INT AS has_tolls FROM trips""",
)
def _(spark, d):
    return FE.trip_flags(V.trips(spark, d)).select("trip_id", "same_location", "has_tip", "has_tolls")


_trip_columns(
    "f16_clip",
    lambda: {
        "minutes": N.clip(_c("trip_duration_minutes"), 1.0, 180.0),
        "riders": N.clip(_c("passenger_count"), 1.0, 6.0),
    },
    """round(greatest(1.0::DOUBLE, least(180.0::DOUBLE, trip_duration_minutes)), 6) AS minutes,
    CASE WHEN passenger_count IS NOT NULL THEN greatest(1.0::DOUBLE, least(6.0::DOUBLE, passenger_count)) END AS riders""",
)
_trip_columns(
    "f17_clamp_floor",
    lambda: {"fare": N.floor_at_zero(_c("fare_amount"))},
    "CASE WHEN fare_amount < 0 THEN 0.0::DOUBLE ELSE round(fare_amount, 6) END AS fare",
)
_trip_columns(
    "f18_round2",
    lambda: {"cents": N.round_cents(TR.linear_fare(_c("trip_distance")))},
    "round_even((3.0 + 2.6 * trip_distance) * 100, 0) / 100 AS cents",
)
_trip_columns(
    "f19_log1p",
    lambda: {"log_fare": N.log1p(_c("fare_amount"))},
    "round(ln(1 + fare_amount), 6) AS log_fare",
    "scored",
)
_trip_columns(
    "f20_estimate_duration",
    lambda: {"minutes": TR.estimate_duration(_c("trip_distance"))},
    "round(greatest(1.0::DOUBLE, least(180.0::DOUBLE, trip_distance / 11.0::DOUBLE * 60)), 6) AS minutes",
)
_trip_columns(
    "f21_estimate_duration_steps",
    lambda: {"minutes": TR.estimate_duration_steps(_c("trip_distance"))},
    """round(CASE WHEN trip_distance < 0.5 THEN greatest(3.0::DOUBLE, trip_distance / 7 * 60)
    WHEN trip_distance < 1 THEN greatest(5.0::DOUBLE, trip_distance / 9 * 60)
    ELSE trip_distance / 12 * 60 END, 6) AS minutes""",
)
_trip_columns(
    "f22_distance_category",
    lambda: {"category": TR.distance_category(_c("trip_distance"))},
    """CASE WHEN trip_distance <= 0 OR trip_distance > 100 THEN NULL WHEN trip_distance <= 1 THEN 'very_short'
    WHEN trip_distance <= 3 THEN 'short' WHEN trip_distance <= 5 THEN 'medium'
    WHEN trip_distance <= 10 THEN 'long' ELSE 'very_long' END AS category""",
)
_trip_columns(
    "f23_cut",
    lambda: {
        "fare_range": TR.fare_range(_c("fare_amount")),
        "distance_range": TR.distance_range(_c("trip_distance")),
        "fare_rank": N.cut_index(_c("fare_amount"), S.FARE_BIN_EDGES, include_lowest=True),
    },
    f"""{_FARE_RANGE} AS fare_range, {_DISTANCE_RANGE} AS distance_range,
    CASE WHEN fare_amount < 0 THEN NULL WHEN fare_amount <= 10 THEN 0 WHEN fare_amount <= 20 THEN 1
    WHEN fare_amount <= 30 THEN 2 WHEN fare_amount <= 50 THEN 3 WHEN fare_amount <= 100 THEN 4 ELSE 5 END AS fare_rank""",
)
_trip_columns(
    "f24_fare_tier",
    lambda: {"tier": TR.fare_tier(_c("fare_amount"))},
    "CASE WHEN fare_amount < 10 THEN 'short' WHEN fare_amount < 30 THEN 'medium' ELSE 'long' END AS tier",
)
_trip_columns(
    "f25_error_columns",
    lambda: TR.error_columns(F.col("fare_amount"), F.col("predicted")),
    """round(fare_amount - predicted, 6) + 0.0 AS error, round(abs(fare_amount - predicted), 6) AS abs_error,
    round(abs(fare_amount - predicted) / fare_amount * 100, 6) AS pct_error""",
    "scored",
)
_trip_columns(
    "f26_cyclic_shift",
    lambda: {"later": C.cyclic_shift(_c("pickup_hour"), 8), "earlier": C.cyclic_shift(_c("pickup_hour"), -3)},
    "((pickup_hour + 8) % 24)::INT AS later, ((pickup_hour + 21) % 24)::INT AS earlier",
)


def _route():
    return TR.route_key(F.col("PULocationID"), F.col("DOLocationID"))


_trip_columns(
    "f27_route_key",
    lambda: {
        "route": _route(),
        "pu": TR.parse_route_key(_route())[0],
        "dropoff": TR.parse_route_key(_route())[1],
    },
    "concat_ws('_', PULocationID, DOLocationID) AS route, PULocationID AS pu, DOLocationID AS dropoff",
)


@query("f28_zone_label", "SELECT LocationID, Zone || ' (' || Borough || ')' AS label FROM zones")
def _(spark, d):
    return V.zones(spark, d).select(
        "LocationID", TR.zone_label(F.col("Zone"), F.col("Borough")).alias("label")
    )


_trip_columns(
    "f29_bin_label",
    lambda: {"label": N.bin_label(_c("trip_distance"), _c("trip_distance") + 1.25)},
    "printf('%.1f-%.1f', trip_distance, trip_distance + 1.25::DOUBLE) AS label",
)


@query(
    "f30_iso_timestamp",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso FROM log""",
)
def _(spark, d):
    return V.event_log(spark, d).select("event_id", C.iso_timestamp(F.col("ts")).alias("iso"))


_trip_columns("f31_as_string_key", lambda: {"pu": TR.as_string_key(_c("PULocationID"))}, "PULocationID::VARCHAR AS pu")


@query(
    "f32_flatten_inputs",
    "SELECT event_id, round(trip_distance, 6) AS trip_distance, passenger_count, pickup_hour::BIGINT AS pickup_hour FROM log",
)
def _(spark, d):
    log = V.event_log(spark, d)
    text = F.to_json(F.struct("trip_distance", "passenger_count", "pickup_hour"))
    nested = log.select(F.col("event_id").alias("timestamp"), RD.parse_inputs(text).alias("inputs"), "prediction")
    return RD.flatten_inputs(nested).select(
        F.col("timestamp").alias("event_id"), "trip_distance", "passenger_count", "pickup_hour"
    )


_trip_columns(
    "f33_payment_label",
    lambda: {"label": TR.payment_label(_c("payment_type") + 1)},
    """CASE payment_type + 1 WHEN 1 THEN 'Credit Card' WHEN 2 THEN 'Cash' WHEN 3 THEN 'No Charge'
    WHEN 4 THEN 'Dispute' ELSE 'Unknown (' || (payment_type + 1)::VARCHAR || ')' END AS label""",
)
_trip_columns(
    "f34_quality_status",
    lambda: {"status": N.quality_status(_c("trip_distance"))},
    "CASE WHEN trip_distance < 1 THEN 'ok' WHEN trip_distance < 5 THEN 'warn' ELSE 'bad' END AS status",
)

# --- set operations ------------------------------------------------------------------


@query(
    "u1_union_all",
    """SELECT split, count(*) AS rows, round(sum(fare_amount), 2) AS fares FROM
    (SELECT * FROM train UNION ALL SELECT * FROM test UNION ALL SELECT * FROM test) GROUP BY 1""",
)
def _(spark, d):
    s = V.scored_trips(spark, d).select("split", "fare_amount")
    train, test = V.split_of(s, "train"), V.split_of(s, "test")
    return (
        SE.union_all(train, test, test)
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("fare_amount"), 2).alias("fares"))
    )


@query(
    "u2_combined_range",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, least(min(a), min(b))::DOUBLE AS low, greatest(max(a), max(b))::DOUBLE AS high,
        count(a)::BIGINT AS n_reference, count(b)::BIGINT AS n_current
        FROM (SELECT {c} AS a, NULL AS b FROM train UNION ALL SELECT NULL, {c} FROM log)"""
        for c in S.HISTOGRAM_FEATURES
    ),
)
def _(spark, d):
    train = V.split_of(V.scored_trips(spark, d), "train")
    return SE.combined_range(train, V.event_log(spark, d), S.HISTOGRAM_FEATURES)
