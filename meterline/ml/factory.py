"""Regressors by name, with the parameter names of the training configs."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from typing import Any

from pyspark.ml import Estimator
from meterline import schemas as S
from meterline.ml.linear import LinearFit, LinearModel
from meterline.ml.trees import BinnedBoosting, BinnedForest, BoostedModel, ForestModel

FEATURES = "features_vector"
LINEAR = ("linear_regression", "ridge", "lasso")
TREES = ("random_forest", "gradient_boosting")
MODELS = LINEAR + TREES
#: What a fitted model is loaded as.
FITTED = dict.fromkeys(LINEAR, LinearModel) | {
    "random_forest": ForestModel,
    "gradient_boosting": BoostedModel,
}

# Fixed values.
DEFAULT_PARAMS: dict[str, dict[str, Any]] = {
    "linear_regression": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 1.0},
    "random_forest": {"n_estimators": 100, "max_depth": 10, "random_state": 42},
    "gradient_boosting": {
        "n_estimators": 100,
        "max_depth": 5,
        "learning_rate": 0.1,
        "random_state": 42,
    },
}

# Parameters without a counterpart in Spark: accepted, left out, and reported.
IGNORED = {"n_jobs", "min_samples_split", "solver", "selection"}
_TREE_NAMES = {
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "subsample": "subsamplingRate",
    "random_state": "seed",
    "bootstrap": "bootstrap",
}


def get_model(
    name: str,
    params: Mapping[str, Any] | None = None,
    label: str = S.TARGET,
) -> Estimator:
    """An unfitted regressor; an unknown name is a ValueError."""
    if name not in MODELS:
        raise ValueError(f"no regressor is named {name!r}; there are {', '.join(MODELS)}")
    given = {**DEFAULT_PARAMS[name], **(params or {})}
    if left_out := sorted(IGNORED & given.keys()):
        warnings.warn(f"{name}: Spark has no counterpart of {left_out}", stacklevel=2)
    given = {k: v for k, v in given.items() if k not in IGNORED}
    if name in LINEAR:
        return _linear(name, given, label)
    return _trees(name, given, label)


def _linear(name: str, given: dict, label: str) -> LinearFit:
    alpha = float(given.pop("alpha", 0.0))
    given.pop("random_state", None)
    _refuse(given)
    return LinearFit(kind=name, alpha=alpha, featuresCol=FEATURES, labelCol=label, predictionCol="predicted")


def _trees(name: str, given: dict, label: str) -> Estimator:
    common = {"featuresCol": FEATURES, "labelCol": label, "predictionCol": "predicted"}
    kwargs = {_TREE_NAMES[k]: given.pop(k) for k in list(given) if k in _TREE_NAMES}
    size = given.pop("n_estimators", 100)
    subset = _subset(given.pop("max_features", None))
    if name == "random_forest":
        _refuse(given)
        return BinnedForest(
            numTrees=size, featureSubsetStrategy=subset, **common, **kwargs
        )
    step = given.pop("learning_rate", 0.1)
    _refuse(given)
    return BinnedBoosting(
        maxIter=size,
        stepSize=step,
        featureSubsetStrategy=subset,
        checkpointInterval=10,
        **common,
        **kwargs,
    )


def _subset(max_features: Any) -> str:
    """All features unless said otherwise, as regression forests there do."""
    return "all" if max_features in (None, 1.0) else str(max_features)


def _refuse(rest: Mapping[str, Any]) -> None:
    if rest:
        raise ValueError(f"unknown parameters: {sorted(rest)}")
