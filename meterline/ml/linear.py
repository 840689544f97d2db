"""Linear fits from one pass: the Gram matrix of features and label.

One aggregate sums the products of all columns, in the tasks first and then over few rows; count,
means and centred products are all that least squares, ridge and lasso need. Any number of
penalties is fitted from the same matrix in the driver, whose size depends on the number of
columns alone. Grams of parts of a table merge, so a group per split costs no further pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

#: Pivots of the scaled matrix below this mean that columns depend on each other.
LEAST_PIVOT = 1e-10
LASSO_SWEEPS = 10_000


@dataclass(frozen=True)
class Gram:
    """Moments of the columns (features, then the label)."""

    n: int
    means: np.ndarray
    products: np.ndarray  # sums of products of deviations from the means

    def merged(self, other: Gram) -> Gram:
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.means - self.means
        return Gram(
            n,
            self.means + gap * (other.n / n),
            self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n),
        )

    @property
    def cov(self) -> np.ndarray:
        return self.products / max(self.n, 1)

    def fit(self, name: str, alpha: float = 0.0) -> tuple[np.ndarray, float]:
        """Coefficients and intercept. The penalty is alpha times the squared norm beside the sum
        of squares (ridge), or beside half their mean, times the absolute values (lasso)."""
        if not self.n:
            raise ValueError("no training rows")
        weights = lasso(self.cov, alpha) if name == "lasso" else ridge(self.cov, alpha / self.n)
        return weights, float(self.means[-1] - weights @ self.means[:-1])

    def sse(self, weights: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of a linear model on these rows."""
        by_label = np.append(-weights, 1.0)
        bias = by_label @ self.means - intercept
        return float(by_label @ self.products @ by_label + self.n * bias * bias)

    def r2(self, weights: np.ndarray, intercept: float) -> float:
        return 1.0 - self.sse(weights, intercept) / self.products[-1, -1]


def ridge(cov: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """Minimiser of the mean squared error plus `penalty` times the squared norm. Columns that
    depend on each other get the least coefficients (in units of their deviations)."""
    x, y = cov[:-1, :-1], cov[:-1, -1]
    scale = np.sqrt(np.diag(x))
    used = scale > 1e-12 * max(1.0, float(scale.max(initial=0.0)))
    weights = np.zeros(len(y))
    if not used.any():
        return weights
    s = scale[used]
    left = x[np.ix_(used, used)] / np.outer(s, s) + np.diag(penalty / s**2)
    right = y[used] / s
    try:
        lower = np.linalg.cholesky(left)
        if np.diag(lower).min() ** 2 < LEAST_PIVOT:
            raise np.linalg.LinAlgError
        solved = np.linalg.solve(lower.T, np.linalg.solve(lower, right))
    except np.linalg.LinAlgError:
        solved = np.linalg.lstsq(left, right, rcond=LEAST_PIVOT)[0]
    weights[used] = solved / s
    return weights


def lasso(cov: np.ndarray, penalty: float) -> np.ndarray:
    """Coordinate descent on the covariances: each step solves for one coefficient."""
    x, y = cov[:-1, :-1], cov[:-1, -1]
    weights = np.zeros(len(y))
    if penalty <= 0:
        return ridge(cov)
    spread = np.diag(x)
    used = np.flatnonzero(spread > 0)
    left = y.copy()  # covariance of each column with what is not explained yet
    for _ in range(LASSO_SWEEPS):
        most = 0.0
        for j in used:
            own = left[j] + spread[j] * weights[j]
            new = np.sign(own) * max(abs(own) - penalty, 0.0) / spread[j]
            step = new - weights[j]
            if step:
                left -= x[:, j] * step
                weights[j] = new
                most = max(most, abs(step) * np.sqrt(spread[j]))
        if most <= 1e-12 * np.sqrt(cov[-1, -1]):
            break
    return weights


def grams(df: DataFrame, features: Sequence[str], label: str, by: str | None = None) -> dict[Any, Gram]:
    """The Gram of each group (None without `by`) from one scan. `by` is for few groups, such as
    splits. Rows without a label take no part; a missing feature is an error."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    return _grams(df.select(x.alias("_x"), F.col(label).cast("double").alias("_y"), *([by] if by else [])), by)


def vector_gram(df: DataFrame, vector: str, label: str) -> Gram:
    """The Gram of a table with a feature vector."""
    found = _grams(df.select(vector_to_array(vector).alias("_x"), F.col(label).cast("double").alias("_y")), None)
    if not found:
        raise ValueError("no training rows")
    return found[None]


def _grams(rows: DataFrame, by: str | None) -> dict[Any, Gram]:
    rows = rows.where("_y IS NOT NULL")
    # The means of any rows will do as the origin: far from the values, sums of squares lose digits.
    some = rows.select("_x", "_y").head(200)
    if not some:
        return {}
    seen = np.array([[np.nan if v is None else v for v in (*r["_x"], r["_y"])] for r in some], float)
    known = np.isfinite(seen)
    origin = np.where(known, seen, 0.0).sum(0) / np.maximum(known.sum(0), 1)
    d = len(origin) - 1
    values = [f"_x[{k}]" for k in range(d)] + ["_y"]
    moved = rows.selectExpr(
        *[f"{v} - ({float(o)!r}D) AS _{k}" for k, (v, o) in enumerate(zip(values, origin, strict=True))],
        *([f"`{by}`"] if by else []),
    )
    columns = [f"_{k}" for k in range(d + 1)]
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    # One expression each: hundreds of sums are parsed faster than they are built one by one.
    sums = moved.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"count_if({' AND '.join(f'{c} IS NOT NULL' for c in columns)})").alias("n"),
        F.expr(f"array({', '.join(f'sum({c})' for c in columns)})").alias("sums"),
        F.expr(f"array({', '.join(f'sum(_{i} * _{j})' for i, j in pairs)})").alias("products"),
    )
    out = {}
    for r in sums.collect():
        if r["n"] != r["rows"]:
            raise ValueError(f"{r['rows'] - r['n']} rows lack a feature")
        if not r["n"]:
            continue
        total = np.array(r["sums"])
        products = np.zeros((d + 1, d + 1))
        for (i, j), p in zip(pairs, r["products"], strict=True):
            products[i, j] = products[j, i] = p
        products -= np.outer(total, total) / r["n"]
        out[r[by] if by else None] = Gram(r["n"], origin + total / r["n"], products)
    return out


class LinearModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted linear model on a feature vector; `expression` is its score of named columns."""

    weights = Param(Params._dummy(), "weights", "coefficients", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, weights=None, bias=None, featuresCol=None, predictionCol=None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.getOrDefault(self.weights))

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.bias)

    def expression(self, columns: Sequence[Column]) -> Column:
        score = F.lit(self.intercept)
        for weight, column in zip(self.getOrDefault(self.weights), columns, strict=True):
            score = score + F.lit(weight) * column.cast("double")
        return score

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x = vector_to_array(self.getFeaturesCol())
        score = self.expression([x[k] for k in range(len(self.getOrDefault(self.weights)))])
        return dataset.withColumn(self.getPredictionCol(), score)


class LinearFit(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Least squares, ridge or lasso on a feature vector, from one pass."""

    kind = Param(Params._dummy(), "kind", "linear_regression, ridge or lasso", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, kind="linear_regression", alpha=0.0, featuresCol=None, labelCol=None, predictionCol=None) -> None:
        super().__init__()
        self._setDefault(kind="linear_regression", alpha=0.0)
        self._set(**self._input_kwargs)

    def model(self, gram: Gram) -> LinearModel:
        weights, bias = gram.fit(self.getOrDefault(self.kind), self.getOrDefault(self.alpha))
        return LinearModel(
            weights=weights.tolist(), bias=bias,
            featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
        )

    def _fit(self, dataset: DataFrame) -> LinearModel:
        return self.model(vector_gram(dataset, self.getFeaturesCol(), self.getLabelCol()))


def predictions(models: Mapping[int, LinearModel], features: Sequence[str]) -> Column:
    """An array of (trial, predicted) for the named columns: exploded, the rows of all trials
    come from one scan and are summed in the task that makes them."""
    columns = [F.col(c) for c in features]
    return F.array(
        *[F.struct(F.lit(i).alias("trial"), m.expression(columns).alias("predicted")) for i, m in models.items()]
    )
