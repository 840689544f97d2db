"""Quality scores by Bradley-Terry ranking of labelled documents.

A preference pair is a document labelled good beside one labelled bad. The chance that the first
is preferred is the logistic function of the difference of their scores, and a score is linear
in a document's features, so that the loss is logistic in feature differences. Newton steps
minimise it: tasks sum gradient and curvature over the pairs, the driver adds one row a task.
The threshold between good and bad is a quantile of the labelled documents' scores, at the share
of bad ones; scores are moved so that it becomes `THRESHOLD`.

Learning reads all labelled rows, of which each meets at least `ROUNDS` of the other class, or all
of them; scoring covers all rows and reads the text alone. Joins, sorts and quantiles carry features,
never texts, and no task holds a class.

Defined cases: null and empty texts have features of zero; rows without an id teach nothing;
labels that repeat an id, and ids that repeat in the documents, count as often as they meet; null
labels teach nothing; with one class only all scores are 1 (good) or 0 (bad), without labels
they are 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from meterline.llm.common import appended, crc_of, slices, written
from meterline.llm.merkle import numbered
from meterline.operators.distribution import exact_quantiles

ROUNDS = 8
THRESHOLD = 0.3
PENALTY = 1.0
STEPS = 25
#: Standardised features end here, so that no freak text outweighs all others.
MOST = 6.0

LETTERS = re.compile(r"[^\W\d_]+")
CAPITALS = re.compile(r"[^\W\d_a-zß-öø-ÿ]{2,}")
SIGNS = re.compile(r"[^\w\s.,;:!?'\"()\-]")
FEATURES = (
    "log_words", "word_length", "long_words", "letters", "digits", "signs", "stops", "calls", "capitals",
    "unworded", "variety", "adjacent", "commonest", "pairs_again", "lines_again", "line_length", "log_commonest",
)


def features(text: str | None) -> list[float]:
    """Shares and logarithms that say how a text is made, not what it is about."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    times = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    runs = LETTERS.findall(text)
    most = max(times.values())
    return [
        math.log1p(n),
        math.log(chars / n),
        sum(len(w) > 20 for w in words) / n,
        sum(map(len, runs)) / chars,
        sum(map(str.isdigit, text)) / chars if any(map(str.isdigit, text)) else 0.0,
        len(SIGNS.findall(text)) / chars,
        sum(w[-1] in ".?" for w in words) / n,
        text.count("!") / n,
        sum(map(len, CAPITALS.findall(text))) / chars,
        sum(not LETTERS.search(w) for w in words) / n,
        math.log(len(times)) / math.log(n) if n > 1 else 1.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        most / n,
        sum(c for c in pairs.values() if c > 1) / n,
        1 - len(set(lines)) / len(lines),
        math.log(n / len(lines)),
        math.log(most),
    ]


@dataclass
class Ranking:
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    cut: float  # score that becomes THRESHOLD

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.means) / self.scales, -MOST, MOST) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(rows) - self.cut, -30, 30) + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-z))


def constant(score: float) -> Ranking:
    """Gives all texts a score near 0 or 1."""
    d = len(FEATURES)
    return Ranking(np.zeros(d), np.ones(d), np.zeros(d), -60.0 if score else 60.0)


def with_features(docs: DataFrame, text: str, name: str) -> DataFrame:
    """All rows and other columns, and the features as an array."""
    schema = StructType([f for f in docs.schema.fields if f.name not in (text, name)]).add(name, ArrayType(DoubleType()))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t) for t in batch.column(text).to_pylist()]
            kept = batch.select([c for c in batch.schema.names if c not in (text, name)])
            yield appended(kept, **{name: pa.array(rows, pa.list_(pa.float64()))})

    return docs.mapInArrow(add, schema)


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def preference_pairs(rows: DataFrame, sizes: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """(a, b): features of good and bad documents. In each of `rounds` rounds every document of
    the larger class meets one of the other class; the partners shift by one a round, so that no
    pair repeats. With fewer documents in the smaller class than rounds, all pairs are made.

    Documents are numbered within their class by a range sort over all tasks; equal ones are spread
    over the tasks by a number of their own."""
    larger, smaller = (1, 0) if sizes[1] >= sizes[0] else (0, 1)
    tied = rows.select("label", "place", "x", F.monotonically_increasing_id().alias("tie"))
    ranked = numbered(tied, "label", ["place", "x", "tie"])
    side = lambda label, name: ranked.where(F.col("label") == label).select("idx", F.col("x").alias(name))
    own, partner = ("a", "b") if larger else ("b", "a")
    drawn = side(larger, own).select(
        own, "idx", F.explode(F.sequence(F.lit(0), F.lit(min(rounds, sizes[smaller]) - 1))).alias("round")
    )
    drawn = drawn.select(own, ((F.col("idx") + F.col("round")) % F.lit(sizes[smaller])).alias("idx"))
    return drawn.join(side(smaller, partner), "idx").select("a", "b")


def newton_sums(means: np.ndarray, scales: np.ndarray, weights: np.ndarray):
    """Task side: gradient and curvature of the pairwise logistic loss."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(weights)
        total = np.zeros((d, d + 1))
        for batch in batches:
            a, b = (np.clip((matrix(batch.column(c)) - means) / scales, -MOST, MOST) for c in ("a", "b"))
            diff = a - b
            lost = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))  # chance that the bad one wins
            total[:, 0] -= diff.T @ lost
            total[:, 1:] += (diff * (lost * (1 - lost))[:, None]).T @ diff
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    return sums


def with_place(docs: DataFrame) -> DataFrame:
    """The documents with their features as `x` instead of the text, and `place`, their order in a class."""
    return with_features(docs.withColumn("place", F.xxhash64("doc_id", "text")), "text", "x")


def fit_ranking(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int | None = None, made: bool = False
) -> Ranking:
    """Learns from all labelled rows (doc_id, label 0 or 1) and the documents' texts, or, where the
    caller asks for it, from `sample_rows` of them by hash of id and text. `made`: the documents
    come from `with_place`, their features are not made again."""
    some = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("int").alias("label")
    )
    if sample_rows is not None:
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    # Features are joined, not texts: 17 numbers a document are shuffled.
    found = docs if made else with_place(docs.select("doc_id", "text"))
    rows = found.select("doc_id", "place", "x").join(some, "doc_id").select("label", "place", "x")
    if sample_rows is not None:  # an id may repeat in the documents
        rows = rows.orderBy("place", "label").limit(sample_rows)
    rows = written(rows, "bradley-rows")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return constant(float(1 in sizes))
    d = len(FEATURES)
    stats = rows.select(
        *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)],
        *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(d)],
    ).first()
    means, scales = np.array(stats[:d]), np.array(stats[d:])
    scales = np.where(scales > 1e-9, scales, 1.0)
    pairs = written(preference_pairs(rows, sizes), "bradley-pairs")
    weights = np.zeros(d)
    for _ in range(STEPS):
        parts = pairs.mapInArrow(newton_sums(means, scales, weights), "sums array<double>").collect()
        total = np.sum([r["sums"] for r in parts], axis=0).reshape(d, d + 1)
        step = np.linalg.solve(total[:, 1:] + PENALTY * np.eye(d), total[:, 0] + PENALTY * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    model = Ranking(means, scales, weights, 0.0)

    def raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(matrix(batch.column("x"))))], ["score"])

    share = sizes[0] / (sizes[0] + sizes[1])
    scores = written(rows.select("x").mapInArrow(raw, "score double"), "bradley-scores")
    model.cut = exact_quantiles(scores, ["score"], [share]).first()["q"][0]
    return model


def score_quality(docs: DataFrame, model: Ranking, text: str = "text", made: bool = False) -> DataFrame:
    """All rows and columns, and `score` and `predicted`; columns of these names are replaced.
    `made`: the documents come from `with_place`, their features are not made again."""
    names = ("score", "predicted")
    schema = StructType([f for f in docs.schema.fields if f.name not in names])
    schema = schema.add("score", DoubleType()).add("predicted", IntegerType())

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = batch.column("x").to_pylist() if made else [features(t) for t in batch.column(text).to_pylist()]
            scores = model.score(np.array(found).reshape(-1, len(FEATURES)))
            yield appended(
                batch,
                score=pa.array(scores, pa.float64()),
                predicted=pa.array((scores >= THRESHOLD).astype(np.int32)),
            )

    return docs.mapInArrow(add, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of(doc_id), F.lit(5)) == 0


def op13_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    found = written(with_place(slim), "bradley-features")
    model = fit_ranking(found, labels.where(~held_out(F.col("doc_id"))), made=True)
    return score_quality(found, model, made=True).select("doc_id", "held_out", "score", "predicted")
