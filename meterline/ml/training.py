"""Fitting, comparing and tuning regressors on distributed rows.

Every table here has its label, features and ``split`` in one row.
"""

from __future__ import annotations

import json
import logging
import math
import random
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from meterline import schemas as S
from meterline.ml.factory import FEATURES, FITTED, LINEAR, MODELS, get_model
from meterline.ml.linear import LinearModel, grams, predictions
from meterline.operators.evaluation import BASIC, metrics
from meterline.operators.ranking import leaderboard
from meterline.sources.staging import use_checkpoints

log = logging.getLogger(__name__)


@dataclass
class Trained:
    name: str
    params: dict[str, Any]
    model: Transformer
    metrics: DataFrame  # split, rmse, mae, r2, mape
    features: list[str]


def assemble(df: DataFrame, features: Sequence[str], invalid: str = "error") -> DataFrame:
    """The feature vector is built last, next to the named columns. ``invalid``: what
    a missing feature does (``error``, ``skip`` or ``keep``)."""
    return VectorAssembler(
        inputCols=list(features), outputCol=FEATURES, handleInvalid=invalid
    ).transform(df)


@contextmanager
def training_rows(df: DataFrame, features: Sequence[str], label: str = S.TARGET):
    """Label, split and vector only, kept for the passes of iterative fits;
    blocks lost with an executor are recomputed from the source.

    The rows are spread by a hash of their values: a file of few row groups is read by as few
    tasks, and all passes of a fit would run in these alone."""
    spread = df.select(*dict.fromkeys([label, "split", *features]))
    spread = spread.repartition(F.xxhash64(*spread.columns))
    rows = assemble(spread, features).select(label, "split", FEATURES)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def fit_rows(
    name: str, rows: DataFrame, params: Mapping[str, Any] | None = None, label: str = S.TARGET
) -> Transformer:
    train = rows.where(F.col("split") == "train")
    use_checkpoints(rows.sparkSession)
    return get_model(name, params, label).fit(train)


def split_metrics(model: Transformer, rows: DataFrame, label: str = S.TARGET) -> DataFrame:
    """Metrics of train and val from one scan."""
    kept = rows.where(F.col("split").isin("train", "val"))
    return metrics(model.transform(kept), label, "predicted", ["split"])


def _frozen(df: DataFrame) -> DataFrame:
    """A metrics table of a few rows, detached from the rows it came from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def fit_linear(
    name: str,
    df: DataFrame,
    features: Sequence[str] = S.ALL_FEATURES,
    label: str = S.TARGET,
    trials: Sequence[Mapping[str, Any]] = ({},),
) -> list[LinearModel]:
    """A model for each of these parameters, all from one scan of the training rows."""
    fits = [get_model(name, p, label) for p in trials]
    train = df.where(F.col("split") == "train")
    found = grams(train, features, label)
    if not found:
        raise ValueError("no training rows")
    return [f.model(found[None]) for f in fits]


def linear_metrics(model: LinearModel, df: DataFrame, features: Sequence[str], label: str = S.TARGET) -> DataFrame:
    """Metrics of train and val from one scan of the named columns."""
    kept = df.where(F.col("split").isin("train", "val"))
    scored = kept.select("split", label, model.expression([F.col(c) for c in features]).alias("predicted"))
    return metrics(scored, label, "predicted", ["split"])


def train_model(
    name: str,
    df: DataFrame,
    features: Sequence[str] = S.ALL_FEATURES,
    label: str = S.TARGET,
    params: Mapping[str, Any] | None = None,
) -> Trained:
    if name in LINEAR:  # one scan to fit, one for the errors: nothing to keep
        [model] = fit_linear(name, df, features, label, [params or {}])
        return Trained(name, dict(params or {}), model, _frozen(linear_metrics(model, df, features, label)), list(features))
    with training_rows(df, features, label) as rows:
        model = fit_rows(name, rows, params, label)
        result = _frozen(split_metrics(model, rows, label))
    return Trained(name, dict(params or {}), model, result, list(features))


def train_all_models(
    df: DataFrame,
    models: Sequence[str] = MODELS,
    features: Sequence[str] = S.ALL_FEATURES,
    label: str = S.TARGET,
    params: Mapping[str, Mapping[str, Any]] | None = None,
) -> tuple[DataFrame, dict[str, Trained]]:
    """Validation leaderboard by rmse and the fitted models. A model whose parameters are
    refused is the board's last row, with the message in ``error`` and no metrics."""
    fitted: dict[str, Trained] = {}
    failed: list[tuple[str, str]] = []
    board = None
    with training_rows(df, features, label) as rows:
        for name in models:
            chosen = (params or {}).get(name)
            try:
                get_model(name, chosen, label)
            except (TypeError, ValueError) as e:  # bad parameters; a failing cluster ends the comparison
                log.error("failed to train %s: %s", name, e)
                failed.append((name, f"{type(e).__name__}: {e}"))
                continue
            model = fit_rows(name, rows, chosen, label)
            result = _frozen(split_metrics(model, rows, label))
            fitted[name] = Trained(name, dict(chosen or {}), model, result, list(features))
            val = result.where(F.col("split") == "val").select(F.lit(name).alias("model"), *BASIC)
            board = val if board is None else board.unionByName(val)
    if board is None:
        raise ValueError("no model could be trained")
    lost = df.sparkSession.createDataFrame(failed, "model string, error string")
    board = board.withColumn("error", F.lit(None).cast("string"))
    return leaderboard(board.unionByName(lost, allowMissingColumns=True)), fitted


def save_trained(trained: Trained, path: str) -> None:
    """The fitted model with its name, parameters, feature list and metrics."""
    about = {"name": trained.name, "params": trained.params, "features": trained.features}
    spark = trained.metrics.sparkSession
    trained.model.write().overwrite().save(f"{path}/model")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(
        f"{path}/about"
    )


def load_trained(spark: SparkSession, path: str) -> Trained:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = FITTED[about["name"]].load(f"{path}/model")
    metrics_table = spark.read.parquet(f"{path}/metrics")
    return Trained(about["name"], about["params"], model, metrics_table, about["features"])


# --- tuning ------------------------------------------------------------------------


def _log_uniform(rng: random.Random, low: float, high: float) -> float:
    return math.exp(rng.uniform(math.log(low), math.log(high)))


def draw_params(name: str, rng: random.Random) -> dict[str, Any]:
    """One random point of the model's search space (fixed values)."""
    if name == "random_forest":
        return {
            "n_estimators": rng.randrange(50, 301, 50),
            "max_depth": rng.randrange(5, 31, 5),
            "min_samples_leaf": rng.randint(1, 10),
            "max_features": rng.choice(["sqrt", "log2", None]),
            "random_state": 42,
        }
    if name == "gradient_boosting":
        return {
            "n_estimators": rng.randrange(50, 301, 50),
            "max_depth": rng.randint(3, 15),
            "learning_rate": _log_uniform(rng, 0.01, 0.3),
            "subsample": rng.uniform(0.6, 1.0),
            "min_samples_leaf": rng.randint(1, 10),
            "random_state": 42,
        }
    if name in ("ridge", "lasso"):
        return {"alpha": _log_uniform(rng, 0.001, 100.0)}
    if name == "linear_regression":
        return {}
    raise ValueError(f"there is no search space for {name!r}")


def draw_trials(name: str, n: int, seed: int = S.SAMPLE_SEED) -> list[dict[str, Any]]:
    rng = random.Random(seed)
    return [draw_params(name, rng) for _ in range(n)]


@dataclass
class Tuned:
    trials: DataFrame  # trial, params, rmse, mae, r2, mape
    best_params: dict[str, Any]
    best: Trained


def tune(
    name: str,
    df: DataFrame,
    features: Sequence[str] = S.ALL_FEATURES,
    label: str = S.TARGET,
    metric: str = "rmse",
    n_trials: int = 30,
    search_rows: DataFrame | None = None,
    trials: Sequence[Mapping[str, Any]] | None = None,
    parallelism: int = 2,
    seed: int = S.SAMPLE_SEED,
) -> Tuned:
    """Random search on the validation split, then a refit of the best point on
    all training rows.

    ``search_rows`` may hold a sample to search on. Linear models are all fitted from one scan of
    the training rows and judged by one of the validation rows. Each trial of another model is a
    distributed fit; ``parallelism`` of them share the cluster. rmse and mae
    are minimised, r2 is maximised.
    """
    if metric not in ("rmse", "mae", "r2"):
        raise ValueError(f"cannot tune for {metric}")
    points = [dict(p) for p in (trials or draw_trials(name, n_trials, seed))]
    if name in LINEAR:
        return _tune_linear(name, df, features, label, metric, points, search_rows)
    with training_rows(df if search_rows is None else search_rows, features, label) as rows:

        @inheritable_thread_target(rows.sparkSession)
        def run(i: int) -> tuple:
            model = fit_rows(name, rows, points[i], label)
            val = rows.where(F.col("split") == "val")
            got = metrics(model.transform(val), label, "predicted").first()
            return (i, str(points[i]), *[got[m] for m in BASIC])

        pool = ThreadPool(min(parallelism, len(points)))
        try:
            results = pool.map(run, range(len(points)), chunksize=1)
        finally:
            pool.close()
    best = _best_trial(results, metric)
    return Tuned(_trials(df, results), points[best], train_model(name, df, features, label, points[best]))


def _best_trial(results: Sequence[tuple], metric: str) -> int:
    value = {r[0]: r[2 + BASIC.index(metric)] for r in results}
    pick = max if metric == "r2" else min
    return pick(sorted(value), key=lambda i: value[i])


def _trials(df: DataFrame, results: Sequence[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        results, "trial int, params string, " + ", ".join(f"{m} double" for m in BASIC)
    )


def _tune_linear(
    name: str,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    metric: str,
    points: list[dict[str, Any]],
    search_rows: DataFrame | None,
) -> Tuned:
    rows = df if search_rows is None else search_rows
    models = dict(enumerate(fit_linear(name, rows, features, label, points)))
    val = rows.where(F.col("split") == "val").select(label, F.explode(predictions(models, features)).alias("t"))
    judged = metrics(val.select(label, "t.*"), label, "predicted", ["trial"]).collect()
    results = [(r["trial"], str(points[r["trial"]]), *[r[m] for m in BASIC]) for r in sorted(judged)]
    if not results:
        raise ValueError("no validation rows")
    best = _best_trial(results, metric)
    if search_rows is not None:
        return Tuned(_trials(df, results), points[best], train_model(name, df, features, label, points[best]))
    # Fitted on all training rows already; its metrics are computed when they are read.
    model = models[best]
    trained = Trained(name, points[best], model, linear_metrics(model, df, features, label), list(features))
    return Tuned(_trials(df, results), points[best], trained)


# --- scoring and inspection ------------------------------------------------------------


def batch_predict(
    model: Transformer,
    df: DataFrame,
    features: Sequence[str] = S.ALL_FEATURES,
    output: str = "predicted_fare",
) -> DataFrame:
    """All input rows and columns and the prediction; it is null where a feature is
    missing."""
    scored = model.transform(assemble(df, features, "keep"))
    known = reduce(
        lambda a, b: a & b,
        [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features],
    )
    return scored.withColumn("predicted", F.when(known, F.col("predicted"))).drop(
        FEATURES
    ).withColumnRenamed("predicted", output)


def feature_importance(
    spark: SparkSession, model: Transformer, features: Sequence[str]
) -> DataFrame:
    """``feature, importance``: tree importances, or coefficients by size."""
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(f, float(v)) for f, v in zip(features, values.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc(F.abs("importance")), "feature")
