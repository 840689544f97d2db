import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterline import schemas as S
from meterline.ml import linear as LN, training as TN
from meterline.ml.factory import get_model
from meterline.ml.transformer import TripFeatureModel, TripFeatureTransformer
from meterline.operators import reference as RF
from meterline.plans import views as V
from meterline.sources import staging as ST
from meterline.streaming import jobs as J


def test_unknown_model():
    with pytest.raises(ValueError, match="no regressor"):
        get_model("oracle")


def test_unknown_parameter(spark):
    with pytest.raises(ValueError, match="unknown parameters"):
        get_model("random_forest", {"n_tres": 3})


def test_all_models_compare(spark, sf):
    small = {
        "random_forest": {"n_estimators": 5, "max_depth": 4, "random_state": 1},
        "gradient_boosting": {"n_estimators": 3, "max_depth": 3, "random_state": 1},
        "ridge": {"alpha": 1.0, "typo": 1},
    }
    rows = V.scored_trips(spark, sf)
    board, fitted = TN.train_all_models(rows, features=S.BASIC_FEATURES, params=small)
    # The model with the wrong parameter comes last with its error; the others are ranked.
    assert set(fitted) == {"linear_regression", "lasso", "random_forest", "gradient_boosting"}
    *ranked, lost = board.collect()
    rmse = [r.rmse for r in ranked]
    assert len(rmse) == 4 and rmse == sorted(rmse) and min(rmse) >= 0
    assert all(r.error is None for r in ranked)
    assert lost.model == "ridge" and lost.rmse is None and "typo" in lost.error
    table = TN.feature_importance(spark, fitted["random_forest"].model, S.BASIC_FEATURES)
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_tuning_for_r2_takes_the_largest(spark, sf):
    rows = V.scored_trips(spark, sf)
    tuned = TN.tune("ridge", rows, ["trip_distance"], metric="r2", trials=[{"alpha": 1e6}, {"alpha": 1.0}])
    assert tuned.best_params == {"alpha": 1.0}


def test_transformer_keeps_shape(spark):
    df = spark.createDataFrame(
        [(1.0, 1, 10, 0, 100, 200, 5.0), (2.0, 2, 11, 1, 101, 201, 6.0), (3.0, 3, 12, 2, 102, 202, 7.0)],
        "trip_distance double, passenger_count int, pickup_hour int, pickup_dayofweek int,"
        " PULocationID long, DOLocationID long, trip_duration_minutes double",
    )
    out = TripFeatureTransformer(scaleNumerical=False).fit(df).transform(df)
    assert out.columns == df.columns and out.count() == 3
    assert sorted(r.PULocationID for r in out.collect()) == [0, 1, 2]


def test_saved_transformer_keeps_parameters_and_drops_older_tables(spark):
    df = spark.createDataFrame([(1.0, 7), (3.0, 9)], "trip_distance double, PULocationID long")
    path = ST.new_path(spark, "t-transformer")
    TripFeatureTransformer(numericalFeatures=["trip_distance"]).fit(df).save(path)
    plain = TripFeatureTransformer(scaleNumerical=False, skewed=True).fit(df)
    with pytest.raises(Exception):  # noqa: B017 - a target that exists is refused
        plain.save(path)
    plain.write().overwrite().save(path)
    loaded = TripFeatureModel.load(path)
    assert loaded.scaler is None and loaded.uid == plain.uid
    assert loaded.getOrDefault("skewed") and not loaded.getOrDefault("scaleNumerical")
    pair = ("trip_distance", "PULocationID")
    assert sorted(map(tuple, loaded.transform(df).select(*pair).collect())) == [(1.0, 0), (3.0, 1)]


def test_saved_model_scores_rows_that_lack_a_feature_as_null(spark):
    rows = spark.createDataFrame(
        [(float(i), 2.0 * i + 1.0, "val" if i % 4 == 0 else "train") for i in range(40)],
        "x double, fare_amount double, split string",
    )
    path = ST.new_path(spark, "t-trained")
    for _ in range(2):  # saving again replaces
        TN.save_trained(TN.train_model("linear_regression", rows, ["x"]), path)
    saved = TN.load_trained(spark, path)
    assert saved.name == "linear_regression" and saved.features == ["x"] and saved.metrics.count() == 2
    asked = spark.createDataFrame([(10.0,), (None,), (float("nan"),)], "x double")
    got = TN.batch_predict(saved.model, asked, saved.features).collect()
    assert len(got) == 3
    assert sorted(round(r.predicted_fare, 3) for r in got if r.predicted_fare is not None) == [21.0]


def test_stream_equals_batch(spark, sf):
    base = ST.new_path(spark, "t-score")
    events = V.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    args = ({"trip_distance": 2.6}, 3.0)
    J.stream_score(V.log_from_events(stream), *args, f"{base}/log", f"{base}/state").awaitTermination()
    batch = J.score_requests(V.log_from_events(events), *args)
    streamed = spark.read.parquet(f"{base}/log").select(batch.columns)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_tail_survives_a_replayed_batch(spark, sf):
    base = ST.new_path(spark, "t-tail")
    log = V.event_log(spark, sf)
    reference = V.strict_features(spark, sf).select(*S.DRIFT_FEATURES)
    write = J.tail_writer(ST.stage(RF.summarise(reference), "t-summary"), base, n=50)
    ordered = log.orderBy("ts", "event_id")
    first, second = ordered.limit(200), ordered.orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    write(first, 0)
    write(second, 1)
    once = {r.event_id for r in spark.read.parquet(f"{base}/tail/1").collect()}
    write(second, 1)
    again = {r.event_id for r in spark.read.parquet(f"{base}/tail/1").collect()}
    assert once == again and len(once) == 50
    # The 20 rows that arrived last, then the newest 30 of the batch before.
    assert {r.event_id for r in second.collect()} <= once
    few = spark.read.parquet(f"{base}/report").where("batch = 1 AND metric = 'too_few_rows'")
    assert few.count() == 0


def _noisy(spark, n=400, d=5):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 1, 1] + [0, 1e6, 5, 0, -3]
    x[:, 4] = 0.5 * x[:, 0] + 0.1 * x[:, 4]
    y = x @ [1.0, 0.02, -3.0, 0.0, 0.5] + rng.normal(size=n)
    split = np.where(np.arange(n) % 4 == 3, "val", "train")
    names = [f"x{k}" for k in range(d)]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(fare_amount=y, split=split))
    return rows, names, x[split == "train"], y[split == "train"]


@pytest.mark.parametrize(("name", "alpha"), [("linear_regression", 0.0), ("ridge", 30.0), ("lasso", 0.05)])
def test_one_pass_fits_equal_the_library(spark, name, alpha):
    from pyspark.ml.regression import LinearRegression

    rows, names, x, y = _noisy(spark)
    [model] = TN.fit_linear(name, rows, names, trials=[{"alpha": alpha} if alpha else {}])
    penalty = alpha * y.std() / len(y) if name == "ridge" else alpha
    train = TN.assemble(rows.where("split = 'train'"), names)
    other = LinearRegression(
        featuresCol="features_vector", labelCol=S.TARGET, standardization=False, tol=1e-12, maxIter=5000,
        regParam=penalty, elasticNetParam=float(name == "lasso"),
    ).fit(train)
    assert model.coefficients.toArray() == pytest.approx(other.coefficients.toArray(), abs=2e-6)
    by_vector = get_model(name, {"alpha": alpha}).fit(train).coefficients.toArray()
    assert by_vector == pytest.approx(model.coefficients.toArray(), abs=1e-9)
    scored = model.transform(train)
    assert scored.agg(F.sum((F.col("predicted") - F.col(S.TARGET)) ** 2)).first()[0] == pytest.approx(
        LN.grams(rows.where("split = 'train'"), names, S.TARGET)[None].sse(model.coefficients.toArray(), model.intercept)
    )


def test_grams_merge_and_group(spark):
    rows, names, *_ = _noisy(spark)
    by_split = LN.grams(rows, names, S.TARGET, "split")
    whole, merged = LN.grams(rows, names, S.TARGET)[None], by_split["train"].merged(by_split["val"])
    assert merged.n == whole.n == 400
    assert np.allclose(merged.means, whole.means) and np.allclose(merged.products, whole.products, rtol=1e-6, atol=1e-4)


def test_columns_that_depend_on_each_other(spark):
    rows, names, x, y = _noisy(spark)
    rows = rows.withColumn("twice", 2 * F.col("x0")).withColumn("same", F.lit(3.0))
    [plain] = TN.fit_linear("linear_regression", rows, names)
    [model] = TN.fit_linear("linear_regression", rows, [*names, "twice", "same"])
    both = model.coefficients.toArray()
    assert both[0] + 2 * both[5] == pytest.approx(plain.coefficients[0], abs=1e-6) and both[6] == 0


def test_a_missing_feature_or_no_rows_is_an_error(spark):
    rows, names, *_ = _noisy(spark)
    with pytest.raises(ValueError, match="lack a feature"):
        TN.fit_linear("ridge", rows.withColumn("x0", F.when(F.col("x1") > 1e6, F.col("x0"))), names)
    with pytest.raises(ValueError, match="no training rows"):
        TN.fit_linear("ridge", rows.limit(0), names)


def test_tuning_reads_train_and_val_once_each(spark):
    rows, names, *_ = _noisy(spark)
    tracker, group = spark.sparkContext.statusTracker(), "tuning"
    seen = []
    for n in (2, 40):
        spark.sparkContext.setJobGroup(f"{group}{n}", "")
        tuned = TN.tune("lasso", rows, names, n_trials=n)
        assert tuned.trials.count() == n
        seen.append(len(tracker.getJobIdsForGroup(f"{group}{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen[0] == seen[1]


def test_training_rows_of_one_task_are_spread(spark):
    """A file of one row group is read by one task; fits run in several all the same."""
    df = spark.range(0, 200_000, numPartitions=1).select(
        F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("fare_amount"), F.lit("train").alias("split")
    )
    with TN.training_rows(df, ["a", "b"]) as rows:
        assert rows.columns == ["fare_amount", "split", "features_vector"]
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        kept = rows.agg(F.sum("fare_amount"), F.countDistinct("fare_amount")).first()
    assert sum(sizes) == 200_000 and len(sizes) > 2 and max(sizes) < 100_000
    assert kept[1] == 200_000 and kept[0] == pytest.approx(df.agg(F.sum("fare_amount")).first()[0])
