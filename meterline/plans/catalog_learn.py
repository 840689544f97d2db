"""Registered queries: models, scoring, streams and extension points."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Window, functions as F

from meterline import schemas as S
from meterline.functions import calendar as C
from meterline.ml import scoring as SC, training as TN
from meterline.ml.factory import FEATURES, MODELS, get_model
from meterline.ml.transformer import TripFeatureModel, TripFeatureTransformer
from meterline.operators import evaluation as EV, features as FE, reference as RF, sampling as SA
from meterline.plans import views as V
from meterline.plans.catalog_monitor import _TAIL, _report_sql
from meterline.plans.catalog_profile import _DICT, metrics_sql
from meterline.plans.registry import query
from meterline.sources import staging as ST
from meterline.streaming import jobs as J


def _union(parts):
    return " UNION ALL ".join(parts)


def _rows(spark, d):
    return V.scored_trips(spark, d).drop("predicted", "predicted_b")


# --- fitting -----------------------------------------------------------------------

# Closed forms of two features over the training rows.
_TWO = ["trip_distance", "passenger_count"]
_SUMS = """(SELECT count(*)::DOUBLE AS n, avg(trip_distance) AS m1, avg(passenger_count) AS m2, avg(fare_amount) AS my,
  var_pop(trip_distance) AS v1, var_pop(passenger_count) AS v2, covar_pop(trip_distance, passenger_count) AS c12,
  covar_pop(trip_distance, fare_amount) AS c1, covar_pop(passenger_count, fare_amount) AS c2 FROM train)"""


def _solved(moments: str, penalty: str = "0", c1: str = "c1", c2: str = "c2") -> str:
    """Both coefficients: the penalty is on the diagonal."""
    det = f"((v1 + {penalty}) * (v2 + {penalty}) - c12 * c12)"
    return f"""SELECT *, (({c1}) * (v2 + {penalty}) - ({c2}) * c12) / {det} AS w1,
      (({c2}) * (v1 + {penalty}) - ({c1}) * c12) / {det} AS w2 FROM {moments}"""


def _shrunk(c: str) -> str:
    return f"sign({c}) * greatest(abs({c}) - {_LASSO_ALPHA}, 0)"


_RIDGE_ALPHA, _LASSO_ALPHA = 5000.0, 2.0
# The lasso's minimum is one of the points where the signs of both coefficients are given.
_LASSO = " UNION ALL ".join(
    [_solved(_SUMS, "0", f"c1 - {_LASSO_ALPHA} * {i}", f"c2 - {_LASSO_ALPHA} * {j}") for i in (-1, 1) for j in (-1, 1)]
    + [
        f"SELECT *, {_shrunk('c1')} / v1 AS w1, 0.0::DOUBLE AS w2 FROM {_SUMS}",
        f"SELECT *, 0.0::DOUBLE AS w1, {_shrunk('c2')} / v2 AS w2 FROM {_SUMS}",
    ]
)
_LOSS = f"""(v1 * w1 * w1 + 2 * c12 * w1 * w2 + v2 * w2 * w2) / 2 - c1 * w1 - c2 * w2
  + {_LASSO_ALPHA} * (abs(w1) + abs(w2))"""


@query(
    "m1_get_model",
    f"""SELECT model, round(w1, 6) AS distance, round(w2, 6) AS passengers,
      round(my - w1 * m1 - w2 * m2, 6) AS intercept FROM (
      SELECT 'linear_regression' AS model, * FROM ({_solved(_SUMS)})
      UNION ALL SELECT 'ridge', * FROM ({_solved(_SUMS, f"{_RIDGE_ALPHA} / n")})
      UNION ALL SELECT 'lasso', * FROM (SELECT * FROM ({_LASSO}) ORDER BY {_LOSS} LIMIT 1))""",
)
def _(spark, d):
    alphas = {"linear_regression": None, "ridge": _RIDGE_ALPHA, "lasso": _LASSO_ALPHA}
    rows = []
    with TN.training_rows(_rows(spark, d), _TWO) as ready:
        train = ready.where(F.col("split") == "train").select(S.TARGET, FEATURES)
        for name, alpha in alphas.items():
            m = get_model(name, {} if alpha is None else {"alpha": alpha}).fit(train)
            rows.append((name, *map(float, m.coefficients), float(m.intercept)))
    return spark.createDataFrame(rows, "model string, distance double, passengers double, intercept double")


_OLS_2 = f"(SELECT *, my - w1 * m1 - w2 * m2 AS w0 FROM ({_solved(_SUMS)}))"


@query(
    "m2_train_model",
    f"""SELECT split, {metrics_sql("p", full=False)} FROM
    (SELECT split, fare_amount, w0 + w1 * trip_distance + w2 * passenger_count AS p
     FROM scored, {_OLS_2} WHERE split IN ('train', 'val')) GROUP BY 1""",
)
def _(spark, d):
    return TN.train_model("linear_regression", _rows(spark, d), _TWO).metrics


@query(
    "m3_train_all_models",
    f"""SELECT unnest([{", ".join(f"'{m}'" for m in sorted(MODELS))}]) AS model, TRUE AS trained, TRUE AS in_order,
    TRUE AS beats_mean, TRUE AS consistent""",
)
def _(spark, d):
    # Tree metrics have no SQL twin: the board is held to what must be true of it. All
    # families with their defaults.
    rows = _rows(spark, d)
    board, _fitted = TN.train_all_models(rows, features=S.BASIC_FEATURES)
    by_rmse, as_given = Window.orderBy("rmse", "model"), Window.orderBy("_row")  # one row per model
    spread = V.split_of(rows, "val").select(F.var_pop(S.TARGET)).scalar()
    board = board.withColumn("_row", F.monotonically_increasing_id())
    gap = F.col("r2") - (1.0 - F.col("rmse") * F.col("rmse") / spread)
    return board.select(
        "model",
        F.col("error").isNull().alias("trained"),
        (F.row_number().over(by_rmse) == F.row_number().over(as_given)).alias("in_order"),
        (F.col("r2") > 0).alias("beats_mean"),
        (F.abs(gap) < 1e-6).alias("consistent"),
    )


_TRIALS = TN.draw_trials("ridge", 12)
_JUDGED = f"""(SELECT trial, fare_amount, my + w1 * (trip_distance - m1) + w2 * (passenger_count - m2) AS p
  FROM (SELECT fare_amount, trip_distance, passenger_count FROM scored WHERE split = 'val'),
  ({_solved(f"(SELECT * FROM {_SUMS}, (VALUES {', '.join(f'({i}::INT, {t['alpha']!r}::DOUBLE)' for i, t in enumerate(_TRIALS))}) t(trial, alpha))", "alpha / n")}))"""


@query(
    "m4_tune",
    f"""SELECT * EXCLUDE (sse), (trial = arg_min(trial, sse) OVER ())::INT AS is_best FROM (
      SELECT trial, {metrics_sql("p", full=False)}, sum((fare_amount - p) ** 2) AS sse FROM {_JUDGED} GROUP BY trial)""",
)
def _(spark, d):
    tuned = TN.tune("ridge", _rows(spark, d), _TWO, n_trials=len(_TRIALS))
    best = _TRIALS.index(tuned.best_params)
    return tuned.trials.drop("params").withColumn("is_best", (F.col("trial") == best).cast("int"))


@query(
    "m5_batch_predict",
    f"""SELECT trip_id, round(fare_amount, 6) AS fare_amount,
    round(w0 + w1 * trip_distance + w2 * passenger_count, 6) AS predicted_fare FROM test, {_OLS_2}""",
)
def _(spark, d):
    rows = _rows(spark, d)
    path = ST.new_path(spark, "trained")
    TN.save_trained(TN.train_model("linear_regression", rows, _TWO), path)
    saved = TN.load_trained(spark, path)
    scored = TN.batch_predict(saved.model, V.split_of(rows, "test"), saved.features)
    return scored.select("trip_id", "fare_amount", "predicted_fare")


@query(
    "m6_score_linear",
    "SELECT trip_id, round(2.5 + 2.6 * trip_distance + 0.1 * trip_duration_minutes, 6) AS predicted_fare FROM test",
)
def _(spark, d):
    test = V.split_of(_rows(spark, d), "test")
    weights = {"trip_distance": 2.6, "trip_duration_minutes": 0.1}
    return SC.score_linear(test, weights, 2.5).select("trip_id", "predicted_fare")


@query(
    "m7_feature_importance",
    f"""SELECT f AS feature, f = 'trip_distance' AS is_top, TRUE AS is_share, TRUE AS sums_to_one
    FROM (SELECT unnest([{", ".join(f"'{c}'" for c in S.BASIC_FEATURES)}]) AS f)""",
)
def _(spark, d):
    # Importances of a default forest have no SQL twin: invariants, and the feature that the fare
    # is made of comes first.
    t = TN.train_model("random_forest", _rows(spark, d), S.BASIC_FEATURES)
    table = TN.feature_importance(spark, t.model, t.features)
    v = F.col("importance")
    every = Window.partitionBy()  # one row per feature
    return table.select(
        "feature",
        (v == F.max(v).over(every)).alias("is_top"),
        v.between(0, 1).alias("is_share"),
        (F.abs(F.sum(v).over(every) - 1) < 1e-9).alias("sums_to_one"),
    )


@query(
    "m8_trip_feature_transformer",
    "SELECT trip_id, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM train)) / (SELECT stddev_pop({c}) FROM train), 6) AS {c}"
        for c in S.TRANSFORMER_NUMERICAL
    )
    + f""", coalesce(p.code, -1) AS PULocationID, coalesce(q.code, -1) AS DOLocationID FROM test t
    LEFT JOIN ({_DICT}) p ON p.feature = 'PULocationID' AND p.class = t.PULocationID::VARCHAR
    LEFT JOIN ({_DICT}) q ON q.feature = 'DOLocationID' AND q.class = t.DOLocationID::VARCHAR""",
)
def _(spark, d):
    columns = [*S.TRANSFORMER_NUMERICAL, *S.TRANSFORMER_CATEGORICAL]
    rows = _rows(spark, d)
    model = TripFeatureTransformer().fit(V.split_of(rows, "train"))
    path = ST.new_path(spark, "transformer")
    model.save(path)
    loaded = TripFeatureModel.load(path)
    return loaded.transform(V.split_of(rows, "test").select("trip_id", *columns))


# --- comparing ---------------------------------------------------------------------

_PAIR = """(SELECT avg(abs(fare_amount - predicted)) AS mae_a, sqrt(avg((fare_amount - predicted) ** 2)) AS rmse_a,
  1 - avg((fare_amount - predicted) ** 2) / var_pop(fare_amount) AS r2_a,
  avg(abs(fare_amount - predicted_b)) AS mae_b, sqrt(avg((fare_amount - predicted_b) ** 2)) AS rmse_b,
  1 - avg((fare_amount - predicted_b) ** 2) / var_pop(fare_amount) AS r2_b FROM test)"""


@query(
    "m9_compare_versions",
    _union(
        f"""SELECT '{m}' AS metric, round({m}_a, 6) AS first, round({m}_b, 6) AS second,
        round(({gain}) / {m}_a * 100, 6) AS diff_pct,
        CASE WHEN mae_b < mae_a THEN 'predicted_b' ELSE 'predicted' END AS winner FROM {_PAIR}"""
        for m, gain in (("mae", "mae_a - mae_b"), ("rmse", "rmse_a - rmse_b"), ("r2", "r2_b - r2_a"))
    ),
)
def _(spark, d):
    test = V.split_of(V.scored_trips(spark, d), "test")
    return EV.compare_versions(test, "predicted", "predicted_b")


@query(
    "m10_baseline_vs_tuned",
    _union(
        f"""SELECT '{m}' AS metric, round({m}_a, 6) AS baseline, round({m}_b, 6) AS tuned,
        round({gain}, 6) AS improvement, round(({gain}) / {m}_a * 100, 6) AS improvement_pct FROM {_PAIR}"""
        for m, gain in (("mae", "mae_a - mae_b"), ("rmse", "rmse_a - rmse_b"), ("r2", "r2_b - r2_a"))
    ),
)
def _(spark, d):
    test = V.split_of(V.scored_trips(spark, d), "test")
    return EV.baseline_vs_tuned(test, "predicted", "predicted_b")


@query(
    "m13_compare_models",
    _union(
        f"SELECT '{m}' AS model, {metrics_sql(p)} FROM test"
        for m, p in (("base", "predicted"), ("flat", "predicted_b"))
    ),
)
def _(spark, d):
    test = V.split_of(V.scored_trips(spark, d), "test")
    return EV.compare_models(test, {"base": "predicted", "flat": "predicted_b"})


# --- serving -----------------------------------------------------------------------

_MINUTES = "greatest(1.0::DOUBLE, least(180.0::DOUBLE, trip_distance / 11.0::DOUBLE * 60))"
_SERVING = f"""event_id, round(trip_distance, 6) AS trip_distance, passenger_count, round({_MINUTES}, 6) AS trip_duration_minutes,
  round(greatest(1.0::DOUBLE, least(60.0::DOUBLE, trip_distance / ({_MINUTES} / 60))), 6) AS avg_speed_mph,
  pickup_hour, pickup_dayofweek, pickup_month,
  round(sin(2 * pi() * pickup_hour / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * pickup_hour / 24), 6) + 0.0 AS hour_cos,
  round(sin(2 * pi() * pickup_dayofweek / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * pickup_dayofweek / 7), 6) + 0.0 AS dow_cos,
  PULocationID, DOLocationID, 2 AS VendorID, (pickup_dayofweek >= 5)::INT AS is_weekend,
  ((pickup_hour BETWEEN 7 AND 9 OR pickup_hour BETWEEN 16 AND 19) AND pickup_dayofweek < 5)::INT AS is_rush_hour,
  (PULocationID = DOLocationID)::INT AS same_location, 0 AS has_tolls"""


@query("m11_serving_features", f"SELECT {_SERVING} FROM log")
def _(spark, d):
    return FE.serving_features(V.event_log(spark, d), keep=["event_id"])


@query(
    "m12_prediction_record",
    """SELECT event_id, round_even(greatest(prediction - 20, 0) * 100, 0) / 100 AS predicted_fare, 'USD' AS currency,
    'trip-fare' AS model_name, 'v1' AS model_version, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS timestamp FROM log""",
)
def _(spark, d):
    shifted = V.event_log(spark, d).withColumn("prediction", F.col("prediction") - 20)
    return SC.prediction_record(shifted, "prediction", model_version="v1", keep=("event_id",))


# --- streams -----------------------------------------------------------------------


def _event_stream(spark, d):
    schema = V.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return V.log_from_events(events)


@query(
    "r1_stream_score",
    """SELECT event_id, round(3.0 + 2.6 * trip_distance, 6) AS prediction,
    round(sin(2 * pi() * pickup_hour / 24), 6) + 0.0 AS hour_sin FROM log WHERE trip_distance BETWEEN 0.1 AND 100""",
)
def _(spark, d):
    base = ST.new_path(spark, "stream-score")
    requests = _event_stream(spark, d).drop("prediction")
    job = J.stream_score(requests, {"trip_distance": 2.6}, 3.0, f"{base}/log", f"{base}/state")
    job.awaitTermination()
    return spark.read.parquet(f"{base}/log").select("event_id", "prediction", "hour_sin")


@query(
    "r1b_stream_rejects",
    """SELECT event_id, round(trip_distance, 6) AS trip_distance, 'trip_distance' AS failed_rules FROM log
    WHERE NOT trip_distance BETWEEN 0.1 AND 100""",
)
def _(spark, d):
    base = ST.new_path(spark, "stream-rejects")
    job = J.stream_rejects(_event_stream(spark, d), f"{base}/rejects", f"{base}/state")
    job.awaitTermination()
    return spark.read.parquet(f"{base}/rejects").select(
        "event_id", "trip_distance", F.array_join("failed_rules", ",").alias("failed_rules")
    )


@query(
    "r2_stream_drift_tail",
    _report_sql()
    .replace("round(avg(fare_amount), 6) FROM train\n", f"NULL FROM {_TAIL} WHERE false\n")
    .replace("count(*)::DOUBLE FROM log", f"count(*)::DOUBLE FROM {_TAIL}")
    .replace("UNION ALL SELECT 'fare_amount', 'reference_mean', NULL", "UNION ALL SELECT 'fare_amount', 'reference_mean', NULL::DOUBLE"),
)
def _(spark, d):
    # The log arrives in three files, one micro-batch each.
    base = ST.new_path(spark, "stream-drift")
    log = V.event_log(spark, d)
    cuts = ["2024-01-12", "2024-01-22"]
    parts = [
        F.col("ts") < cuts[0],
        (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]),
        F.col("ts") >= cuts[1],
    ]
    for where in parts:
        log.where(where).coalesce(1).write.mode("append").parquet(f"{base}/in")
    train = V.split_of(V.scored_trips(spark, d), "train")
    summary = ST.stage(RF.summarise(SA.reference_sample(train)), "reference-summary")
    arrivals = (
        spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    )
    job = J.stream_drift_tail(arrivals, summary, base, f"{base}/state")
    job.awaitTermination()
    last = job.lastProgress["batchId"]
    return spark.read.parquet(f"{base}/report").where(F.col("batch") == last).drop("batch")


@query(
    "r3_stream_window_stats",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS rows, round(avg(trip_distance), 6) AS mean_trip_distance,
    round(avg(passenger_count), 6) AS mean_passenger_count, round(avg(pickup_hour), 6) AS mean_pickup_hour,
    round(avg(pickup_dayofweek), 6) AS mean_pickup_dayofweek FROM log GROUP BY 1
    HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM log) - INTERVAL 1 HOUR""",
)
def _(spark, d):
    base = ST.new_path(spark, "stream-windows")
    job = J.stream_window_stats(_event_stream(spark, d), f"{base}/out", f"{base}/state")
    job.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(
    "r3b_stream_late_rows",
    """SELECT event_id, 2::BIGINT AS batch, round(trip_distance, 6) AS trip_distance FROM log
    WHERE ts < TIMESTAMP '2024-01-09' AND event_id % 7 = 0""",
)
def _(spark, d):
    # A week's rows arrive in order but for a seventh of them, which come after all others.
    base = ST.new_path(spark, "stream-late")
    log = V.event_log(spark, d)
    late = (F.col("ts") < "2024-01-09") & (F.col("event_id") % 7 == 0)
    first = F.col("ts") < "2024-01-15"
    for where in (~late & first, ~late & ~first, late):
        log.where(where).coalesce(1).write.mode("append").parquet(f"{base}/in")
    arrivals = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    J.stream_late_rows(arrivals, base, f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/late").select("event_id", F.col("batch").cast("bigint"), "trip_distance")


# --- extension points ----------------------------------------------------------------


@query(
    "e1_row_expressions",
    """SELECT trip_id, dayname(tpep_pickup_datetime) AS day, CASE WHEN pickup_hour BETWEEN 6 AND 11 THEN 'morning'
    WHEN pickup_hour BETWEEN 12 AND 16 THEN 'afternoon' WHEN pickup_hour BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS tod,
    ((pickup_hour BETWEEN 7 AND 9 OR pickup_hour BETWEEN 16 AND 19) AND pickup_dayofweek < 5)::INT AS rush FROM timed""",
)
def _(spark, d):
    hour, dow = F.col("pickup_hour"), F.col("pickup_dayofweek")
    return V.timed_trips(spark, d).select(
        "trip_id",
        C.day_name(dow).alias("day"),
        C.time_of_day_rule(hour).alias("tod"),
        C.is_rush_hour(hour, dow).alias("rush"),
    )


@query(
    "e2_group_expressions",
    f"SELECT pickup_hour, {metrics_sql(full=False)}, count(*) AS trips, round(avg(fare_amount), 6) AS avg_fare FROM scored GROUP BY 1",
)
def _(spark, d):
    exprs = EV.metric_exprs(F.col("fare_amount"), F.col("predicted"))
    return V.scored_trips(spark, d).groupBy("pickup_hour").agg(
        *[exprs[m].alias(m) for m in EV.BASIC],
        F.count(F.lit(1)).alias("trips"),
        F.avg("fare_amount").alias("avg_fare"),
    )


@query(
    "e3_transformer_stage",
    f"""SELECT trip_id, round(trip_distance, 6) AS trip_distance, coalesce(p.code, -1) AS PULocationID FROM test t
    LEFT JOIN ({_DICT}) p ON p.feature = 'PULocationID' AND p.class = t.PULocationID::VARCHAR""",
)
def _(spark, d):
    rows = _rows(spark, d)
    stage = TripFeatureTransformer(scaleNumerical=False, categoricalFeatures=["PULocationID"])
    path = ST.new_path(spark, "pipeline-model")
    Pipeline(stages=[stage]).fit(V.split_of(rows, "train")).write().save(path)
    fitted = PipelineModel.load(path)
    return fitted.transform(V.split_of(rows, "test")).select(
        "trip_id", "trip_distance", "PULocationID"
    )


@query("e4_model_stage", f"SELECT {metrics_sql(full=False)} FROM test")
def _(spark, d):
    # Any transformer that adds the prediction column can be evaluated.
    model = SQLTransformer(statement="SELECT *, 3.0D + 2.6D * trip_distance AS predicted FROM __THIS__")
    return EV.metrics(model.transform(V.split_of(_rows(spark, d), "test")))
