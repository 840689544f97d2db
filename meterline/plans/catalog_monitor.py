"""Registered queries: samples, splits and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline import schemas as S
from meterline.functions import trip as TR
from meterline.operators import distribution as DI, drift as DR, reference as RF, sampling as SA
from meterline.plans import views as V
from meterline.plans.catalog_profile import histogram_pair_sql
from meterline.plans.registry import query
from meterline.sources.staging import stage

_HASH = "md5(concat_ws('|', trip_id, '42'))"


def _union(parts):
    return " UNION ALL ".join(parts)


def _split(spark, d, name):
    return V.split_of(V.scored_trips(spark, d), name)


# --- samples and splits --------------------------------------------------------------


@query("x1_sample_n", f"SELECT trip_id, trip_distance FROM trips ORDER BY {_HASH}, trip_id LIMIT 2000")
def _(spark, d):
    return SA.sample_n(V.trips(spark, d), 2000, unique=True).select("trip_id", "trip_distance")


@query("x2_split_data", "SELECT trip_id, split FROM scored")
def _(spark, d):
    return SA.split_data(V.strict_features(spark, d)).select("trip_id", "split")


@query(
    "x2b_split_data_thirds",
    """SELECT trip_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT trip_id, ('0x' || substr(md5(concat_ws('|', trip_id, '42')), 1, 8))::BIGINT % 100 AS b FROM imputed)""",
)
def _(spark, d):
    rows = V.full_features(spark, d)
    return SA.split_data(rows, test_size=0.15, val_size=0.15, hashed=False).select("trip_id", "split")


@query(
    "x3_sample_train_val",
    f"""SELECT trip_id, split FROM (SELECT * FROM train ORDER BY {_HASH}, trip_id LIMIT 4000)
    UNION ALL SELECT trip_id, split FROM (SELECT * FROM scored WHERE split = 'val' ORDER BY {_HASH}, trip_id LIMIT 1000)""",
)
def _(spark, d):
    return SA.sample_train_val(V.scored_trips(spark, d), 4000).select("trip_id", "split")


@query(
    "x4_reference_sample",
    f"""SELECT trip_distance, passenger_count, pickup_hour, pickup_dayofweek FROM
    (SELECT * FROM train ORDER BY {_HASH}, trip_id LIMIT 10000)""",
)
def _(spark, d):
    return stage(SA.reference_sample(_split(spark, d, "train")), "reference-sample")


def _distance_sql(columns, reference, current):
    """``feature, w, ks, n_ref, n_cur`` by a window over the merged support."""
    return _union(
        f"""SELECT '{c}' AS feature, coalesce(sum((nx - v) * abs(f - g)), 0) AS w, max(abs(f - g)) AS ks,
        any_value(n1) AS n1, any_value(n2) AS n2 FROM (
          SELECT v, lead(v) OVER (ORDER BY v) AS nx, sum(a) OVER (ORDER BY v) / sum(a) OVER ()::DOUBLE AS f,
            sum(b) OVER (ORDER BY v) / sum(b) OVER ()::DOUBLE AS g, sum(a) OVER () AS n1, sum(b) OVER () AS n2
          FROM (SELECT v, sum(a) AS a, sum(b) AS b FROM (
            SELECT {c}::DOUBLE AS v, 1 AS a, 0 AS b FROM {reference}
            UNION ALL SELECT {c}::DOUBLE, 0, 1 FROM {current}) WHERE v IS NOT NULL GROUP BY 1))"""
        for c in columns
    )


_SAMPLE = f"(SELECT * FROM train ORDER BY {_HASH}, trip_id LIMIT 10000)"


def _sides_sql(columns, full, sample):
    def one(c):
        cols = []
        for p, src in (("a", full), ("b", sample)):
            cols.append(
                f"""(SELECT avg({c}) AS {p}m, stddev_samp({c}) AS {p}s, quantile_cont({c}, 0.5) AS {p}q,
                min({c})::DOUBLE AS {p}lo, max({c})::DOUBLE AS {p}hi FROM {src})"""
            )
        return f"SELECT '{c}' AS feature, * FROM {cols[0]}, {cols[1]}"

    return _union(one(c) for c in columns)


@query(
    "x5_representativeness",
    f"""SELECT feature, round(dm, 6) AS mean_diff_pct, round(ds, 6) AS std_diff_pct, round(dq, 6) AS median_diff_pct,
      alo AS full_min, blo AS sample_min, ahi AS full_max, bhi AS sample_max, round(ks, 6) AS ks_stat,
      round(p, 6) AS ks_pvalue,
      (avg(dm) OVER () < 5 AND count_if(p > 0.05) OVER () >= 0.75 * count(*) OVER ())::INT AS representative
    FROM (SELECT *, abs(am - bm) / am * 100 AS dm, abs(ass - bs) / ass * 100 AS ds,
        CASE WHEN aq <> 0 THEN abs(aq - bq) / aq * 100 ELSE 0 END AS dq,
        greatest(0, least(1, CASE WHEN t2 < 0.04 THEN 1.0 ELSE list_sum(list_transform(range(1, 101),
          lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0::DOUBLE * k * k * t2))) END)) AS p
      FROM (SELECT d.*, s.* EXCLUDE (feature, "as"), s."as" AS ass, ks * ks * (n1::DOUBLE * n2 / (n1 + n2)) AS t2
        FROM ({_distance_sql(S.DRIFT_FEATURES, "train", _SAMPLE)}) d
        JOIN ({_sides_sql(S.DRIFT_FEATURES, "train", _SAMPLE).replace(" AS as,", ' AS "as",')}) s USING (feature)))""",
)
def _(spark, d):
    train = _split(spark, d, "train")
    sample = stage(SA.reference_sample(train), "reference-sample")
    return SA.representativeness(train, sample)


# --- distributions ---------------------------------------------------------------------

_ECDF_COLUMNS = ["trip_distance", "pickup_hour"]


@query(
    "w4_ecdf",
    _union(
        f"""SELECT '{c}' AS feature, round(v, 6) AS value, round(lead(v) OVER (ORDER BY v), 6) AS next_value,
        round(sum(a) OVER (ORDER BY v) / sum(a) OVER ()::DOUBLE, 6) AS f_ref,
        round(sum(b) OVER (ORDER BY v) / sum(b) OVER ()::DOUBLE, 6) AS f_cur
        FROM (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT {c}::DOUBLE AS v, 1 AS a, 0 AS b FROM train
          UNION ALL SELECT {c}::DOUBLE, 0, 1 FROM log) GROUP BY 1)"""
        for c in _ECDF_COLUMNS
    ),
)
def _(spark, d):
    return DI.ecdf(_split(spark, d, "train"), V.event_log(spark, d), _ECDF_COLUMNS)


def _drift_sql(columns, reference, current, norm="std"):
    if norm == "std":
        scale = _union(
            f"SELECT '{c}' AS feature, greatest(stddev_samp({c}), 0.001) AS s FROM {reference}" for c in columns
        )
    else:
        scale = _union(
            f"""SELECT '{c}' AS feature, max(v) - min(v) AS s FROM (SELECT {c}::DOUBLE AS v FROM {reference}
            UNION ALL SELECT {c}::DOUBLE FROM {current})"""
            for c in columns
        )
    return f"""SELECT feature, round(w, 6) AS distance, round(w / s, 6) AS score, 0.3::DOUBLE AS threshold,
      (w / s > 0.3)::INT AS drifted FROM ({_distance_sql(columns, reference, current)}) JOIN ({scale}) USING (feature)"""


@query("d1_column_drift", _drift_sql(S.DRIFT_FEATURES, "train", "log"))
def _(spark, d):
    return DR.column_drift(_split(spark, d, "train"), V.event_log(spark, d))


@query("d1r_column_drift_range", _drift_sql(S.DRIFT_FEATURES, "train", "log", "range"))
def _(spark, d):
    return DR.column_drift(_split(spark, d, "train"), V.event_log(spark, d), norm="range")


def _js_sql(columns, reference, current):
    return _union(
        f"""SELECT '{c}' AS feature, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END
          + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2)) AS js FROM (
          SELECT p, q, (p + q) / 2 AS m FROM (SELECT sum(a) / sum(sum(a)) OVER ()::DOUBLE AS p, sum(b) / sum(sum(b)) OVER ()::DOUBLE AS q
          FROM (SELECT {c} AS v, 1 AS a, 0 AS b FROM {reference} UNION ALL SELECT {c}, 0, 1 FROM {current}) GROUP BY v))"""
        for c in columns
    )


_CATEGORIES = ["PULocationID", "pickup_hour"]


@query(
    "d1b_column_drift_cat",
    f"""SELECT feature, round(js, 6) AS distance, round(js, 6) AS score, 0.3::DOUBLE AS threshold,
    (js > 0.3)::INT AS drifted FROM ({_js_sql(_CATEGORIES, "train", "log")})""",
)
def _(spark, d):
    return DR.column_drift_cat(_split(spark, d, "train"), V.event_log(spark, d), _CATEGORIES)


@query(
    "d2_dataset_drift",
    f"""SELECT count(*) AS n_features, sum(drifted)::BIGINT AS n_drifted, round(avg(drifted), 6) AS drift_share,
    (avg(drifted) > 0.5)::INT AS dataset_drift FROM ({_drift_sql(S.DRIFT_FEATURES, "train", "log")})""",
)
def _(spark, d):
    return DR.dataset_drift(DR.column_drift(_split(spark, d, "train"), V.event_log(spark, d)))


@query(
    "d3_mean_shift",
    _union(
        f"""SELECT '{c}' AS feature, round(a, 6) AS reference_mean, round(b, 6) AS current_mean,
        round((b - a) / a * 100, 6) AS change_pct, (abs((b - a) / a * 100) > 10)::INT AS drifted
        FROM (SELECT avg({c}) AS a FROM train), (SELECT avg({c}) AS b FROM log)"""
        for c in S.HISTOGRAM_FEATURES
    ),
)
def _(spark, d):
    return DR.mean_shift(_split(spark, d, "train"), V.event_log(spark, d))


@query("d4_target_drift", _drift_sql(["fare_amount", "predicted"], "train", "test"))
def _(spark, d):
    return DR.target_drift(_split(spark, d, "train"), _split(spark, d, "test"))


_POPULATIONS = [
    ("reference", "train", "predicted"),
    ("current", "test", "predicted"),
    ("perturbed", "test", "(3.0 + 2.6 * (trip_distance * 2.0))"),
]


@query(
    "d5_performance_drift",
    f"""SELECT population, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2,
    round((mae - base) / base * 100, 6) AS mae_change_pct, ((mae - base) / base * 100 > 10)::INT AS degraded
    FROM ({_union(
        f'''SELECT '{n}' AS population, avg(abs(fare_amount - {p})) AS mae, sqrt(avg((fare_amount - {p}) ** 2)) AS rmse,
        1 - avg((fare_amount - {p}) ** 2) / var_pop(fare_amount) AS r2,
        (SELECT avg(abs(fare_amount - predicted)) FROM train) AS base FROM {t}''' for n, t, p in _POPULATIONS
    )})""",
)
def _(spark, d):
    test = _split(spark, d, "test")
    moved = DR.perturb(test, "extreme").withColumn("predicted", TR.linear_fare(F.col("trip_distance")))
    return DR.performance_drift(
        {"reference": _split(spark, d, "train"), "current": test, "perturbed": moved}
    )


@query(
    "d6_check_alerts",
    """SELECT * FROM (SELECT 'mae_increase_pct' AS alert, round((c - r) / r * 100, 6) AS value, 15.0::DOUBLE AS threshold FROM m
      UNION ALL SELECT 'max_mae', round(c, 6), 3.5::DOUBLE FROM m
      UNION ALL SELECT 'r2_decrease', round(r2r - r2c, 6), 0.05::DOUBLE FROM m) WHERE value > threshold""".replace(
        "FROM m",
        """FROM (SELECT avg(abs(fare_amount - predicted)) AS r,
        1 - avg((fare_amount - predicted) ** 2) / var_pop(fare_amount) AS r2r FROM train),
        (SELECT avg(abs(fare_amount - q)) AS c, 1 - avg((fare_amount - q) ** 2) / var_pop(fare_amount) AS r2c
        FROM (SELECT fare_amount, 3.0 + 2.6 * (trip_distance * 2.0) AS q FROM test))""",
    ),
)
def _(spark, d):
    moved = DR.perturb(_split(spark, d, "test"), "extreme")
    scored = moved.withColumn("predicted", TR.linear_fare(F.col("trip_distance")))
    return DR.check_alerts(_split(spark, d, "train"), scored)


_TAIL = "(SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 100)"
_REFERENCE = f"(SELECT * FROM train ORDER BY {_HASH}, trip_id LIMIT 10000)"


def _report_sql():
    drift = f"({_drift_sql(S.DRIFT_FEATURES, _REFERENCE, _TAIL)})"
    bars = f"({histogram_pair_sql(S.HISTOGRAM_FEATURES, _REFERENCE, _TAIL)})"
    means = _union(
        f"SELECT '{c}' AS feature, '{side}_mean' AS metric, round(avg({c}), 6) AS value FROM {src}"
        for c in S.DRIFT_FEATURES
        for side, src in (("reference", _REFERENCE), ("current", _TAIL))
    )
    return f"""SELECT feature, 'score' AS metric, score AS value FROM {drift}
    UNION ALL SELECT feature, 'drifted', drifted::DOUBLE FROM {drift}
    UNION ALL SELECT 'dataset', 'n_features', count(*)::DOUBLE FROM {drift}
    UNION ALL SELECT 'dataset', 'n_drifted', sum(drifted)::DOUBLE FROM {drift}
    UNION ALL SELECT 'dataset', 'drift_share', round(avg(drifted), 6) FROM {drift}
    UNION ALL SELECT 'dataset', 'dataset_drift', (avg(drifted) > 0.5)::INT::DOUBLE FROM {drift}
    UNION ALL {means}
    UNION ALL SELECT feature, 'reference_pct[' || label || ']', reference_pct FROM {bars}
    UNION ALL SELECT feature, 'current_pct[' || label || ']', current_pct FROM {bars}
    UNION ALL SELECT 'fare_amount', 'current_mean', round(avg(prediction), 6) FROM {_TAIL}
    UNION ALL SELECT 'fare_amount', 'reference_mean', round(avg(fare_amount), 6) FROM train
    UNION ALL SELECT 'dataset', 'total_predictions', count(*)::DOUBLE FROM log"""


@query("d7_drift_report", _report_sql())
def _(spark, d):
    from meterline.operators.ranking import last_n

    log = V.event_log(spark, d)
    train = _split(spark, d, "train")
    # Both are bounded (a summary, and 100 rows) and used many times over.
    summary = stage(RF.summarise(SA.reference_sample(train)), "reference-summary")
    tail = stage(last_n(log, S.RECENT_LOG_ROWS, "ts", "event_id"), "log-tail")
    return RF.drift_report(
        summary,
        tail,
        reference_fare_mean=train.select(F.avg("fare_amount")).scalar(),
        log_rows=log.select(F.count(F.lit(1))).scalar(),
    )


@query(
    "d7b_drift_report_too_few",
    """SELECT 'dataset' AS feature, 'too_few_rows' AS metric, count(*)::DOUBLE AS value FROM (SELECT * FROM log LIMIT 29)
    UNION ALL SELECT 'dataset', 'total_predictions', count(*)::DOUBLE FROM log""",
)
def _(spark, d):
    from meterline.operators.ranking import last_n

    log = V.event_log(spark, d)
    # One row below the limit.
    few = stage(last_n(log, S.MIN_LOG_ROWS - 1, "ts", "event_id"), "log-tail")
    reference = stage(SA.reference_sample(_split(spark, d, "train")), "reference-sample")
    return DR.drift_report(reference, few, log_rows=log.select(F.count(F.lit(1))).scalar())


@query(
    "d8_perturb",
    """SELECT trip_id, round(trip_distance * 2.0, 6) AS trip_distance, ((pickup_hour + 8) % 24)::INT AS pickup_hour,
    passenger_count + (PULocationID + DOLocationID) % 3 + 2 AS passenger_count FROM test""",
)
def _(spark, d):
    return DR.perturb(_split(spark, d, "test"), "extreme").select(
        "trip_id", "trip_distance", "pickup_hour", "passenger_count"
    )


@query(
    "d8b_perturb_mild",
    """SELECT trip_id, round(trip_distance * 1.5, 6) AS trip_distance, ((pickup_hour + 3) % 24)::INT AS pickup_hour FROM test""",
)
def _(spark, d):
    test = _split(spark, d, "test")
    return DR.perturb(DR.perturb(test, "distance"), "time").select("trip_id", "trip_distance", "pickup_hour")


_UNIFORM = "((('0x' || substr(md5(concat_ws('|', trip_id, '42')), {}, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656"
_NOISE = f"sqrt(ln({_UNIFORM.format(1)}) * -2) * cos({_UNIFORM.format(13)} * 2 * pi())"


@query(
    "d8n_perturb_noise",
    f"""SELECT trip_id, round(trip_duration_minutes + {_NOISE} * s * 0.5, 6) AS trip_duration_minutes
    FROM test, (SELECT stddev_samp(trip_duration_minutes) AS s FROM test)""",
)
def _(spark, d):
    # Dealt anew over other partitions: the noise hangs on the rows alone.
    test = _split(spark, d, "test").repartition(5, "trip_duration_minutes")
    return DR.perturb(test, "noise").select("trip_id", "trip_duration_minutes")
