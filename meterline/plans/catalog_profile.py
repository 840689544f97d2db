"""Registered queries: lookups, profiling, evaluation, windows and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline import schemas as S
from meterline.functions import trip as TR
from meterline.operators import cleaning as CL, evaluation as EV, lookups as LK
from meterline.operators import profile as PR, ranking as RK
from meterline.plans import views as V
from meterline.plans.registry import query
from meterline.sources.staging import stage

TRIP_NUMBERS = ["passenger_count", "trip_distance", "fare_amount", "tip_amount", "total_amount", "trip_duration_minutes"]
_E = "fare_amount - predicted"


def _test(spark, d):
    return V.split_of(V.scored_trips(spark, d), "test")


def _union(parts):
    return " UNION ALL ".join(parts)


# --- joins -----------------------------------------------------------------------


@query(
    "j1_lookup_route_distance",
    """SELECT trip_id, round(coalesce(avg_distance, 3.0), 6) AS route_distance,
    coalesce(avg_distance > 0, false) AS has_data
    FROM trips LEFT JOIN routes USING (PULocationID, DOLocationID)""",
)
def _(spark, d):
    out = LK.lookup_route_distance(V.trips(spark, d), V.routes(spark, d))
    return out.select("trip_id", "route_distance", "has_data")


@query(
    "j1b_lookup_route_distance_salted",
    """SELECT trip_id, round(coalesce(avg_distance, 0.0), 6) AS route_distance
    FROM trips LEFT JOIN routes USING (PULocationID, DOLocationID)""",
)
def _(spark, d):
    # The way for a route table beyond the broadcast limit.
    out = LK.lookup_route_distance(
        V.trips(spark, d), V.routes(spark, d), default=0.0, skewed=True, row_key=["trip_id"]
    )
    return out.select("trip_id", "route_distance")


@query(
    "j2_fill_distance",
    """SELECT trip_id, round(CASE WHEN trip_distance <= 0 THEN coalesce(avg_distance, 3.0) ELSE trip_distance END, 6)
    AS trip_distance FROM trips LEFT JOIN routes USING (PULocationID, DOLocationID)""",
)
def _(spark, d):
    return LK.fill_distance(V.trips(spark, d), V.routes(spark, d)).select("trip_id", "trip_distance")


@query(
    "j3_enrich_zones",
    """SELECT trip_id, p.Borough AS pickup_borough, p.Zone AS pickup_zone,
    q.Borough AS dropoff_borough, q.Zone AS dropoff_zone FROM trips t
    LEFT JOIN zones p ON t.PULocationID % 25 = p.LocationID
    LEFT JOIN zones q ON t.DOLocationID % 25 = q.LocationID""",
)
def _(spark, d):
    return LK.enrich_zones(V.zoned_trips(spark, d), V.zones(spark, d)).select(
        "trip_id", "pickup_borough", "pickup_zone", "dropoff_borough", "dropoff_zone"
    )


_CLASSES = """(SELECT 'PULocationID' AS feature, PULocationID::VARCHAR AS class FROM train
  UNION SELECT 'DOLocationID', DOLocationID::VARCHAR FROM train)"""
_DICT = f"SELECT feature, class, row_number() OVER (PARTITION BY feature ORDER BY class) - 1 AS code FROM {_CLASSES}"


@query(
    "j4_encode_lookup",
    f"""SELECT trip_id, coalesce(p.code, -1) AS PULocationID, coalesce(q.code, -1) AS DOLocationID
    FROM trips t LEFT JOIN ({_DICT}) p ON p.feature = 'PULocationID' AND p.class = (t.PULocationID * 2)::VARCHAR
    LEFT JOIN ({_DICT}) q ON q.feature = 'DOLocationID' AND q.class = t.DOLocationID::VARCHAR""",
)
def _(spark, d):
    # Doubled pickup ids, so that half of the classes are unseen.
    train = V.split_of(V.scored_trips(spark, d), "train")
    # Staged like a fitted transformer's, so that its size is known to the join.
    dictionary = stage(LK.encoder_fit(train, ["PULocationID", "DOLocationID"]), "classes")
    doubled = V.trips(spark, d).withColumn("PULocationID", F.col("PULocationID") * 2)
    return LK.encode_lookup(doubled, dictionary, ["PULocationID", "DOLocationID"]).select(
        "trip_id", "PULocationID", "DOLocationID"
    )


@query("j5_align_label", "SELECT trip_id, trip_distance, round(fare_amount, 6) AS fare_amount FROM train")
def _(spark, d):
    # Features and label stay in one row, so a sample of rows carries both.
    train = V.split_of(V.scored_trips(spark, d), "train")
    return train.select("trip_id", "trip_distance", "fare_amount")


@query(
    "j6_compare_stats",
    _union(
        f"""SELECT '{c}' AS feature, '{s}' AS stat, round(a, 6) AS reference, round(b, 6) AS current,
        round(b - a, 6) AS diff FROM (SELECT {f}(CASE WHEN r THEN v END) AS a, {f}(CASE WHEN NOT r THEN v END) AS b FROM
        (SELECT true AS r, {c}::DOUBLE AS v FROM train UNION ALL SELECT false, {c}::DOUBLE FROM log))"""
        for c in S.DRIFT_FEATURES
        for s, f in (("mean", "avg"), ("std", "stddev_samp"))
    ),
)
def _(spark, d):
    train = V.split_of(V.scored_trips(spark, d), "train")
    sides = [
        LK.stats_long(PR.moments(df, S.DRIFT_FEATURES), ["mean", "std"])
        for df in (train, V.event_log(spark, d))
    ]
    return LK.compare_stats(*sides)


# --- profile ---------------------------------------------------------------------


@query(
    "a1_describe",
    _union(
        f"""SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 5) AS mean,
        round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min,
        round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
        round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM timed"""
        for c in TRIP_NUMBERS
    ),
)
def _(spark, d):
    # Means of cents over 60,000 rows often end in a 5 at the seventh digit.
    return PR.describe(V.timed_trips(spark, d), TRIP_NUMBERS).withColumn("mean", F.round("mean", 5))


@query(
    "a2_null_profile",
    _union(
        f"""SELECT '{c}' AS "column", count_if({c} IS NULL)::BIGINT AS missing,
        round_even(count_if({c} IS NULL) * 100.0::DOUBLE / count(*) * 100, 0) / 100 AS missing_pct FROM trips"""
        for c in ["trip_id", *S.REQUIRED_COLUMNS]
    ),
)
def _(spark, d):
    return PR.null_profile(V.trips(spark, d).select("trip_id", *S.REQUIRED_COLUMNS))


@query("a2b_rows_with_nulls", "SELECT count_if(passenger_count IS NULL)::BIGINT AS rows_with_nulls FROM trips")
def _(spark, d):
    return PR.rows_with_nulls(V.trips(spark, d))


@query(
    "a3_value_counts",
    """SELECT passenger_count, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM trips), 6) AS pct
    FROM trips WHERE passenger_count IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    return PR.value_counts(V.trips(spark, d), "passenger_count")


@query(
    "a4_group_mean",
    """SELECT pickup_hour, round(avg(fare_amount), 6) AS mean_fare_amount FROM timed
    WHERE fare_amount > 0 AND fare_amount < 100 GROUP BY 1""",
)
def _(spark, d):
    return PR.group_mean(CL.mask_filter(V.timed_trips(spark, d), fare_amount=(0, 100)), "pickup_hour")


@query(
    "a4b_group_mean_payment",
    """SELECT payment_type, round(avg(fare_amount), 6) AS mean_fare_amount FROM trips
    WHERE fare_amount > 0 AND fare_amount < 100 AND payment_type IN (1, 2) GROUP BY 1""",
)
def _(spark, d):
    masked = CL.mask_filter(V.trips(spark, d), fare_amount=(0, 100))
    return PR.group_mean(CL.isin_filter(masked, "payment_type", [1, 2]), "payment_type")


@query(
    "a5_pivot_count",
    "SELECT pickup_dayofweek, "
    + ", ".join(f'count_if(pickup_hour = {h})::BIGINT AS "{h}"' for h in range(24))
    + " FROM timed GROUP BY 1",
)
def _(spark, d):
    return PR.pivot_count(V.timed_trips(spark, d), "pickup_dayofweek", "pickup_hour", range(24))


@query(
    "a6_shape_stats",
    _union(
        f"""SELECT '{c}' AS feature, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis,
        (SELECT round(v, 6) FROM (SELECT {c} AS v, count(*) AS n FROM timed WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS mode,
        round(quantile_cont({c}, 0.5), 6) AS median FROM timed"""
        for c in ("fare_amount", "trip_distance", "passenger_count")
    ),
)
def _(spark, d):
    return PR.shape_stats(V.timed_trips(spark, d), ["fare_amount", "trip_distance", "passenger_count"])


@query(
    "a7_iqr_outliers",
    _union(
        f"""SELECT '{c}' AS feature, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
        round(lo, 6) AS lower, round(hi, 6) AS upper, count_if({c} < lo OR {c} > hi)::BIGINT AS outliers,
        round(count_if({c} < lo OR {c} > hi) * 100.0::DOUBLE / count(*), 6) AS outlier_pct,
        count_if({c} < 0)::BIGINT AS negative, count_if({c} = 0)::BIGINT AS zero, count_if({c} > 100)::BIGINT AS over_100,
        count_if({c} > 500)::BIGINT AS over_500 FROM trips,
        (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
          (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM trips)) GROUP BY q1, q3, lo, hi"""
        for c in ("fare_amount", "trip_distance")
    ),
)
def _(spark, d):
    return PR.iqr_outliers(V.trips(spark, d), ["fare_amount", "trip_distance"])


@query(
    "a8_error_percentiles",
    _union(
        f"SELECT {p} AS percentile, round(quantile_cont(abs({_E}), {p / 100}), 6) AS abs_error FROM test"
        for p in S.ERROR_PERCENTILES
    ),
)
def _(spark, d):
    return EV.error_percentiles(_test(spark, d))


def _conditions_sql(conditions):
    return _union(
        f"SELECT '{name}' AS issue, count_if({c})::BIGINT AS count FROM timed" for name, c in conditions
    )


@query(
    "a9_anomaly_counts",
    _conditions_sql(
        [
            ("zero distance", "trip_distance = 0"),
            ("distance > 50", "trip_distance > 50"),
            ("distance > 100", "trip_distance > 100"),
            ("zero passengers", "passenger_count = 0"),
            ("passengers > 6", "passenger_count > 6"),
            ("negative duration", "trip_duration_minutes < 0"),
            ("zero duration", "trip_duration_minutes = 0"),
            ("duration > 60", "trip_duration_minutes > 60"),
            ("duration > 120", "trip_duration_minutes > 120"),
        ]
    ),
)
def _(spark, d):
    return PR.anomaly_counts(V.timed_trips(spark, d))


_QUALITY = _conditions_sql(
    [
        ("Missing passenger_count", "passenger_count IS NULL"),
        ("Zero/Negative fare", "fare_amount <= 0"),
        ("Fare > $500", "fare_amount > 500"),
        ("Zero trip distance", "trip_distance = 0"),
        ("Distance > 100 miles", "trip_distance > 100"),
        ("Zero passenger count", "passenger_count = 0"),
        ("Negative duration", "trip_duration_minutes < 0"),
        ("Duration > 3 hours", "trip_duration_minutes > 180"),
    ]
)


@query(
    "a10_quality_report",
    f"""SELECT issue, count, round(pct, 6) AS pct, total,
    CASE WHEN pct < 1 THEN 'ok' WHEN pct < 5 THEN 'warn' ELSE 'bad' END AS status FROM
    (SELECT issue, count, total, count * 100.0::DOUBLE / total AS pct
     FROM ({_QUALITY}), (SELECT count(*) AS total FROM trips))""",
)
def _(spark, d):
    return PR.quality_report(V.timed_trips(spark, d))


_CORR_MASK = """fare_amount > 0 AND fare_amount < 100 AND trip_distance > 0 AND trip_distance < 50
  AND trip_duration_minutes > 0 AND trip_duration_minutes < 120 AND passenger_count IS NOT NULL"""


def _corr_rows(spark, d):
    return CL.mask_filter(
        V.timed_trips(spark, d),
        fare_amount=(0, 100),
        trip_distance=(0, 50),
        trip_duration_minutes=(0, 120),
    )


@query(
    "a11_corr_matrix",
    _union(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM timed WHERE {_CORR_MASK}"
        for a in S.CORRELATION_COLUMNS
        for b in S.CORRELATION_COLUMNS
    ),
)
def _(spark, d):
    return PR.corr_matrix(_corr_rows(spark, d))


@query(
    "a12_corr_with_target",
    _union(
        f"SELECT '{c}' AS feature, round(corr({c}, fare_amount), 6) AS r FROM timed WHERE {_CORR_MASK}"
        for c in S.CORRELATION_COLUMNS
        if c != "fare_amount"
    ),
)
def _(spark, d):
    return PR.corr_with_target(_corr_rows(spark, d))


_ERROR_FEATURES = ["trip_distance", "passenger_count", "pickup_hour", "pickup_dayofweek", "trip_duration_minutes", "avg_speed_mph", "is_weekend"]
_CORR_ERROR = _union(
    f"SELECT '{c}' AS feature, round(corr({c}, abs({_E})), 6) AS r FROM test" for c in _ERROR_FEATURES
)


@query("a13_corr_with_error", _CORR_ERROR)
def _(spark, d):
    return EV.corr_with_error(_test(spark, d), _ERROR_FEATURES)


def _histogram_sql(columns, source, bins=10):
    """NumPy's rule: an arithmetic guess, corrected against the edges."""
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS feature, g.b::INT AS bin, round(e.lo, 6) AS lo, round(e.hi, 6) AS hi,
            coalesce(n, 0)::BIGINT AS count, round(coalesce(n, 0) / (total * (e.hi - e.lo)), 6) AS density
            FROM range({bins}) g(b)
            JOIN (SELECT b, b * ((mx - mn) / {bins}) + mn AS lo,
              CASE WHEN b = {bins - 1} THEN mx ELSE (b + 1) * ((mx - mn) / {bins}) + mn END AS hi
              FROM range({bins}) r(b), (SELECT min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx FROM {source})) e ON e.b = g.b
            LEFT JOIN (SELECT CASE WHEN v < gb * w + mn THEN gb - 1
                WHEN v >= (gb + 1) * w + mn AND gb < {bins - 1} THEN gb + 1 ELSE gb END AS b, count(*) AS n
              FROM (SELECT v, mn, (mx - mn) / {bins} AS w,
                  least(floor((v - mn) * ({bins}.0::DOUBLE / (mx - mn))), {bins - 1}) AS gb
                FROM (SELECT {c}::DOUBLE AS v FROM {source}),
                  (SELECT min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx FROM {source})) GROUP BY 1) h ON h.b = g.b
            , (SELECT count({c}) AS total FROM {source})"""
        )
    return _union(parts)


@query("a14_histogram", _histogram_sql(("fare_amount", "trip_distance", "pickup_hour"), "scored"))
def _(spark, d):
    return PR.histogram(V.scored_trips(spark, d), ["fare_amount", "trip_distance", "pickup_hour"])


def histogram_pair_sql(columns, reference, current, bins=10):
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS feature, b::INT AS bin,
            printf('%.1f-%.1f', b * w + mn, CASE WHEN b = {bins - 1} THEN mx ELSE (b + 1) * w + mn END) AS label,
            round(count_if(r AND vb = b) * 100.0::DOUBLE / count_if(r AND b >= 0), 6) AS reference_pct,
            round(count_if(NOT r AND vb = b) * 100.0::DOUBLE / count_if(NOT r AND b >= 0), 6) AS current_pct
            FROM range({bins}) g(b), (SELECT r, mn, mx, w, CASE WHEN v < gb * w + mn THEN gb - 1
                WHEN v >= (gb + 1) * w + mn AND gb < {bins - 1} THEN gb + 1 ELSE gb END AS vb
              FROM (SELECT r, v, mn, mx, (mx - mn) / {bins} AS w,
                  least(floor((v - mn) * ({bins}.0::DOUBLE / (mx - mn))), {bins - 1}) AS gb
                FROM (SELECT true AS r, {c}::DOUBLE AS v FROM {reference}
                  UNION ALL SELECT false, {c}::DOUBLE FROM {current}),
                (SELECT least(a, c) AS mn, greatest(b, e) AS mx FROM
                  (SELECT min({c})::DOUBLE AS a, max({c})::DOUBLE AS b FROM {reference}),
                  (SELECT min({c})::DOUBLE AS c, max({c})::DOUBLE AS e FROM {current}))))
            GROUP BY b, w, mn, mx"""
        )
    return _union(parts)


@query("a15_histogram_pair", histogram_pair_sql(S.HISTOGRAM_FEATURES, "train", "log"))
def _(spark, d):
    train = V.split_of(V.scored_trips(spark, d), "train")
    return PR.histogram_pair(train, V.event_log(spark, d))


@query(
    "a16_reference_stats",
    f"""SELECT h.feature, h.bin, h.lo AS bin_edge, h.density, s.mean, s.std, s.min, s.max
    FROM ({_histogram_sql(S.STATS_FEATURES, "train")}) h JOIN ({_union(
        f'''SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM train''' for c in S.STATS_FEATURES
    )}) s USING (feature)""",
)
def _(spark, d):
    stats = PR.reference_stats(V.split_of(V.scored_trips(spark, d), "train"))
    bars = F.arrays_zip("hist", F.slice("bin_edges", 1, F.size("hist")).alias("edge"))
    return stats.select("*", F.posexplode(bars).alias("bin", "bar")).select(
        "feature", "bin", F.col("bar.edge").alias("bin_edge"), F.col("bar.hist").alias("density"),
        "mean", "std", "min", "max",
    )


# --- evaluation --------------------------------------------------------------------


def metrics_sql(p="predicted", full=True, y="fare_amount"):
    e = f"({y} - {p})"
    basic = f"""round(sqrt(avg({e} ** 2)), 6) AS rmse, round(avg(abs{e}), 6) AS mae,
      round(1 - sum({e} ** 2) / (var_pop({y}) * count(*)), 6) AS r2,
      round(avg(abs{e} / abs({y})) * 100, 6) AS mape"""
    if not full:
        return basic
    return f"""{basic}, round(avg({e} ** 2), 6) AS mse, round(max(abs{e}), 6) AS max_error,
      round(1 - var_pop{e} / var_pop({y}), 6) AS explained_variance, round(stddev_pop{e}, 6) AS std_error,
      round(quantile_cont(abs{e}, 0.5), 6) AS median_ae"""


@query("a17_regression_metrics", f"SELECT {metrics_sql()} FROM (SELECT fare_amount, 3.0 + 2.6 * trip_distance AS predicted FROM trips WHERE fare_amount BETWEEN 2.5 AND 500)")
def _(spark, d):
    t = CL.filter_fare(V.trips(spark, d))
    return EV.regression_metrics(t.withColumn("predicted", TR.linear_fare(F.col("trip_distance"))))


@query("a18_regression_metrics_basic", f"SELECT {metrics_sql(full=False)} FROM test")
def _(spark, d):
    return EV.regression_metrics_basic(_test(spark, d))


@query(
    "a18b_metrics_unscored",
    f"SELECT {metrics_sql()} FROM (SELECT * FROM test WHERE payment_type <> 2)",
)
def _(spark, d):
    # Rows without a prediction take no part.
    scored = F.when(F.col("payment_type") != 2, F.col("predicted"))
    return EV.regression_metrics(_test(spark, d).withColumn("predicted", scored))


@query("a19_metrics_by_split", f"SELECT split, {metrics_sql()} FROM scored GROUP BY 1")
def _(spark, d):
    return EV.metrics_by_split(V.scored_trips(spark, d))


@query(
    "a20_error_summary",
    f"""SELECT round(avg({_E}), 6) AS mean_error, round(stddev_samp({_E}), 6) AS std_error,
    round(min({_E}), 6) AS min_error, round(max({_E}), 6) AS max_error, round(avg(abs({_E})), 6) AS mean_abs_error,
    round(quantile_cont(abs({_E}), 0.5), 6) AS median_abs_error FROM test""",
)
def _(spark, d):
    return EV.error_summary(_test(spark, d))


_FARE_RANGE = """CASE WHEN fare_amount <= 10 THEN '$0-10' WHEN fare_amount <= 20 THEN '$10-20'
  WHEN fare_amount <= 30 THEN '$20-30' WHEN fare_amount <= 50 THEN '$30-50'
  WHEN fare_amount <= 100 THEN '$50-100' ELSE '$100+' END"""
_DISTANCE_RANGE = """CASE WHEN trip_distance <= 1 THEN '0-1 mi' WHEN trip_distance <= 3 THEN '1-3 mi'
  WHEN trip_distance <= 5 THEN '3-5 mi' WHEN trip_distance <= 10 THEN '5-10 mi'
  WHEN trip_distance <= 20 THEN '10-20 mi' ELSE '20+ mi' END"""


@query(
    "a21_segment_metrics",
    _union(
        f"""SELECT '{name}' AS segment, {expr} AS value, round(avg(abs({_E})), 6) AS mae,
        round(avg(abs({_E}) / fare_amount) * 100, 6) AS mape, round(avg(fare_amount), 6) AS avg_fare,
        count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM test), 6) AS pct FROM test GROUP BY 2"""
        for name, expr in (
            ("pickup_hour", "pickup_hour::VARCHAR"),
            ("pickup_dayofweek", "dayname(tpep_pickup_datetime)"),
            ("fare_range", _FARE_RANGE),
            ("distance_range", _DISTANCE_RANGE),
        )
    ),
)
def _(spark, d):
    return EV.segment_metrics(_test(spark, d))


@query("a22_encoder_fit", _DICT)
def _(spark, d):
    train = V.split_of(V.scored_trips(spark, d), "train")
    return LK.encoder_fit(train, ["PULocationID", "DOLocationID"])


@query(
    "a23_scaler_fit",
    _union(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS scale FROM train"
        for c in S.TRANSFORMER_NUMERICAL
    ),
)
def _(spark, d):
    return LK.scaler_fit(V.split_of(V.scored_trips(spark, d), "train"), S.TRANSFORMER_NUMERICAL)


@query(
    "a23b_scaler_apply",
    "SELECT trip_id, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train), 6) AS {c}"
        for c in S.TRANSFORMER_NUMERICAL
    )
    + " FROM test",
)
def _(spark, d):
    scored = V.scored_trips(spark, d)
    scaler = LK.scaler_fit(V.split_of(scored, "train"), S.TRANSFORMER_NUMERICAL)
    return LK.scaler_apply(V.split_of(scored, "test"), scaler, S.TRANSFORMER_NUMERICAL).select(
        "trip_id", *S.TRANSFORMER_NUMERICAL
    )


@query(
    "a24_error_buckets",
    _union(
        f"""SELECT {i} AS bucket, '{name}' AS label, count_if({w})::BIGINT AS count,
        round(count_if({w}) * 100.0::DOUBLE / count(*), 6) AS pct FROM test"""
        for i, (name, w) in enumerate(
            [
                ("Excellent", f"abs({_E}) < 1"),
                ("Good", f"abs({_E}) >= 1 AND abs({_E}) < 2"),
                ("Acceptable", f"abs({_E}) >= 2 AND abs({_E}) < 5"),
                ("Poor", f"abs({_E}) >= 5 AND abs({_E}) < 10"),
                ("Very Poor", f"abs({_E}) >= 10"),
            ]
        )
    ),
)
def _(spark, d):
    return EV.error_buckets(_test(spark, d))


@query(
    "a25_route_mean_distance",
    "SELECT PULocationID, DOLocationID, round(avg(trip_distance), 6) AS avg_distance, count(*) AS trips FROM trips GROUP BY ALL",
)
def _(spark, d):
    return LK.route_mean_distance(V.trips(spark, d))


@query(
    "a26_network_speed",
    "SELECT round(avg(avg_speed_mph), 6) AS mean_speed_mph, count(*) AS trips FROM scored",
)
def _(spark, d):
    return PR.network_speed(V.strict_features(spark, d))


@query("a27_trips_by_month", "SELECT pickup_year, pickup_month, count(*) AS trips FROM timed GROUP BY ALL")
def _(spark, d):
    return PR.trips_by_month(V.timed_trips(spark, d))


_WORST = f"(SELECT * FROM test ORDER BY abs({_E}) DESC, trip_id LIMIT 100)"


@query(
    "a28_worst_vs_overall",
    _union(
        f"""SELECT '{name}' AS population, round(avg(fare_amount), 6) AS avg_actual, round(avg(predicted), 6) AS avg_predicted,
        round(avg(abs({_E})), 6) AS avg_abs_error, count(*) AS rows FROM {src}"""
        for name, src in (("worst", _WORST), ("overall", "test"))
    ),
)
def _(spark, d):
    return EV.worst_vs_overall(_test(spark, d))


@query("a28b_worst_by_fare_range", f"SELECT {_FARE_RANGE} AS fare_range, count(*) AS count FROM {_WORST} GROUP BY 1")
def _(spark, d):
    return EV.worst_by_fare_range(_test(spark, d))


@query(
    "a29_split_summary",
    """SELECT split, count(*) AS rows, round(avg(fare_amount), 6) AS target_mean, round(stddev_samp(fare_amount), 6) AS target_std,
    round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM scored), 6) AS pct FROM scored GROUP BY 1""",
)
def _(spark, d):
    return EV.split_summary(V.scored_trips(spark, d))


_RANGE_COLUMNS = ["fare_amount", "trip_distance", "trip_duration_minutes"]


@query(
    "a30_range_check",
    _union(
        f"SELECT '{c}' AS feature, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM imputed"
        for c in _RANGE_COLUMNS
    ),
)
def _(spark, d):
    return PR.range_check(V.full_features(spark, d), _RANGE_COLUMNS)


@query(
    "a31_zones_grouped",
    """SELECT Borough, LocationID AS id, Zone AS name, Zone || ' (' || Borough || ')' AS label FROM zones""",
)
def _(spark, d):
    nested = LK.zones_grouped(V.zones(spark, d))
    return nested.select("Borough", F.inline("zones"))


@query(
    "a31b_zone_list",
    """SELECT Borough, LocationID, Zone, Zone || ' (' || Borough || ')' AS label, count(*) OVER () AS total FROM zones""",
)
def _(spark, d):
    return LK.zone_list(V.zones(spark, d))


@query(
    "a32_evaluation_verdicts",
    f"""SELECT u.name AS "check", round(u.value, 6) AS value, u.flag::INT AS flag FROM
    (SELECT r2, mape, mae, abs(train_mae - mae) AS gap, high FROM
      (SELECT 1 - sum(({_E}) ** 2) / (var_pop(fare_amount) * count(*)) AS r2,
        avg(abs({_E}) / fare_amount) * 100 AS mape, avg(abs({_E})) AS mae FROM test),
      (SELECT avg(abs({_E})) AS train_mae FROM train),
      (SELECT avg(m) AS high FROM (SELECT {_FARE_RANGE} AS fr, avg(abs({_E})) AS m FROM test GROUP BY 1)
        WHERE regexp_matches(fr, '50|100'))),
    LATERAL (SELECT * FROM (VALUES ('good_r2', r2, r2 > 0.8), ('low_mape', mape, mape < 20),
      ('low_overfitting', gap, gap < 0.5), ('mae_could_be_lower', mae, mae > 2.5),
      ('high_fares_worse', high, high > mae * 1.5), ('alert_level', mae * 1.2, true)) v(name, value, flag)) u""",
)
def _(spark, d):
    return EV.evaluation_verdicts(V.scored_trips(spark, d))


# --- windows -----------------------------------------------------------------------


def _importances(spark, d):
    """Share of absolute correlation with the fare per feature."""
    r = PR.corr_with(V.split_of(V.scored_trips(spark, d), "train"), _ERROR_FEATURES, "fare_amount")
    total = r.select(F.sum(F.abs("r"))).scalar()
    return r.select("feature", (F.abs("r") / total).alias("importance"))


_IMPORTANCE = f"""(SELECT feature, r / sum(r) OVER () AS importance FROM ({_union(
    f"SELECT '{c}' AS feature, abs(corr({c}, fare_amount)) AS r FROM train" for c in _ERROR_FEATURES)}))"""


@query(
    "w1_cumulative_share",
    f"""SELECT feature, round(importance, 6) AS importance,
    row_number() OVER (ORDER BY importance DESC, feature)::INT AS position,
    round(sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING), 6) AS cumulative
    FROM {_IMPORTANCE}""",
)
def _(spark, d):
    return RK.cumulative_share(_importances(spark, d))


@query(
    "w1b_features_needed",
    _union(
        f"""SELECT {t}::DOUBLE AS threshold, (count_if(c < {t}) + 1)::BIGINT AS features FROM
        (SELECT sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS c FROM {_IMPORTANCE})"""
        for t in (0.8, 0.9)
    ),
)
def _(spark, d):
    return RK.features_needed(_importances(spark, d))


# Transparent candidate models: fare = 3 + rate * miles.
_RATES = [2.2, 3.1, 2.5, 2.8, 2.4, 2.6, 2.7]
_TRIALS_SQL = f"""(SELECT t.i AS trial, avg(abs(fare_amount - (3.0 + t.rate * trip_distance))) AS mae
  FROM test, (VALUES {", ".join(f"({i}::INT, {r}::DOUBLE)" for i, r in enumerate(_RATES))}) t(i, rate) GROUP BY 1)"""


def _trials(spark, d):
    wide = _test(spark, d).agg(
        *[
            F.avg(F.abs(F.col("fare_amount") - TR.linear_fare(F.col("trip_distance"), 3.0, r))).alias(f"m{i}")
            for i, r in enumerate(_RATES)
        ]
    )
    return PR.rows_of(
        wide,
        [F.struct(F.lit(i).alias("trial"), F.col(f"m{i}").alias("mae")) for i in range(len(_RATES))],
    )


@query(
    "w2_running_best",
    f"SELECT trial, round(mae, 6) AS mae, round(min(mae) OVER (ORDER BY trial), 6) AS best_so_far FROM {_TRIALS_SQL}",
)
def _(spark, d):
    return RK.running_best(_trials(spark, d), "mae")


@query(
    "w3_last_n",
    "SELECT event_id, round(trip_distance, 6) AS trip_distance FROM log ORDER BY ts DESC, event_id DESC LIMIT 100",
)
def _(spark, d):
    return RK.last_n(V.event_log(spark, d), 100, "ts", "event_id").select("event_id", "trip_distance")


@query(
    "w3b_last_n_per_key",
    """SELECT event_id, PULocationID FROM (SELECT *, row_number() OVER (PARTITION BY PULocationID ORDER BY ts DESC, event_id DESC) AS rn
    FROM log) WHERE rn <= 10""",
)
def _(spark, d):
    return RK.last_n_per_key(V.event_log(spark, d), 10, "PULocationID", "ts", "event_id").select(
        "event_id", "PULocationID"
    )


# --- top-k -------------------------------------------------------------------------

_MODELS = {"base": "predicted", "flat": "predicted_b"}


@query(
    "t1_leaderboard",
    _union(f"SELECT '{m}' AS model, {metrics_sql(p, full=False)} FROM test" for m, p in _MODELS.items()),
)
def _(spark, d):
    t = _test(spark, d)
    rows = None
    for m, p in _MODELS.items():
        one = EV.metrics(t, prediction=p).select(F.lit(m).alias("model"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return RK.leaderboard(rows)


@query(
    "t2_worst_predictions",
    f"""SELECT trip_id, round(fare_amount, 6) AS fare_amount, round(predicted, 6) AS predicted,
    round({_E}, 6) AS error, round(abs({_E}), 6) AS abs_error FROM {_WORST}""",
)
def _(spark, d):
    return EV.worst_predictions(_test(spark, d)).select(
        "trip_id", "fare_amount", "predicted", "error", "abs_error"
    )


@query("t3_top_zones", "SELECT PULocationID, count(*) AS trips FROM trips GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return RK.top_zones(V.trips(spark, d), "PULocationID")


@query("t3b_top_dropoff_zones", "SELECT DOLocationID, count(*) AS trips FROM trips GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return RK.top_zones(V.trips(spark, d), "DOLocationID")


@query("t4_best_model", f"SELECT trial AS model, round(mae, 6) AS mae FROM {_TRIALS_SQL} ORDER BY mae, trial LIMIT 1")
def _(spark, d):
    return RK.best_model(_trials(spark, d).withColumnRenamed("trial", "model"))


@query("t5_top_by_abs", f"SELECT * FROM ({_CORR_ERROR}) ORDER BY abs(r) DESC, feature LIMIT 3")
def _(spark, d):
    return RK.top_by_abs(EV.corr_with_error(_test(spark, d), _ERROR_FEATURES), "r", "feature", 3)


@query("t6_top_features", f"SELECT feature, round(importance, 6) AS importance FROM {_IMPORTANCE} ORDER BY importance DESC LIMIT 5")
def _(spark, d):
    return RK.top_features(_importances(spark, d), 5)


@query("t7_head", "SELECT trip_id, trip_distance FROM trips ORDER BY trip_id LIMIT 10")
def _(spark, d):
    return RK.head(V.trips(spark, d), 10, "trip_id").select("trip_id", "trip_distance")
