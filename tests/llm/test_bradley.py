"""Pairwise ranking: pairs, loss, threshold, held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import bradley
from meterline.llm.common import table
from meterline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    return labels, QUERIES["op13_quality_classifier"](spark, sf).collect()


def test_held_out_rows(scored):
    labels, rows = scored
    assert len({r["doc_id"] for r in rows}) == len(rows) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    judged = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = np.array([s for s, _, y in judged if y == 1])
    bad = np.array([s for s, _, y in judged if y == 0])
    assert np.mean(good[:, None] > bad[None, :]) > 0.995
    assert np.mean([p == y for _, p, y in judged]) > 0.99
    assert np.mean([p for _, p, y in judged if y == 1]) > 0.99


def test_scores_read_the_text_alone(spark, sf):
    docs = table(spark, sf, "documents")
    model = bradley.fit_ranking(docs, table(spark, sf, "labels"))
    plain = bradley.score_quality(docs.select("doc_id", "text"), model)
    other = bradley.score_quality(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "score": F.lit("z")}), model)
    pick = lambda df: {r["doc_id"]: r["score"] for r in df.select("doc_id", "score").collect()}
    assert pick(plain) == pick(other)


@pytest.mark.parametrize(("good", "bad"), [(3, 5), (5, 3), (1, 20), (12, 12), (20, 1)])
def test_pairs_are_distinct_and_cover_all(spark, good, bad):
    rows = [(1, k, [float(k)]) for k in range(good)] + [(0, k, [float(k)]) for k in range(bad)]
    df = spark.createDataFrame(rows, "label int, place long, x array<double>")
    pairs = [(r["a"][0], r["b"][0]) for r in bradley.preference_pairs(df, {1: good, 0: bad}).collect()]
    assert len(set(pairs)) == len(pairs) == max(good, bad) * min(bradley.ROUNDS, good, bad)
    assert {a for a, _ in pairs} == set(range(good)) and {b for _, b in pairs} == set(range(bad))


def test_newton_finds_the_minimum(spark, sf):
    """Gradient sums against finite differences of the loss."""
    rng = np.random.default_rng(3)
    d = 4
    a, b = rng.normal(size=(50, d)), rng.normal(size=(50, d))
    w = rng.normal(size=d)
    zero, one = np.zeros(d), np.ones(d)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": a.tolist(), "b": b.tolist()})
    [out] = bradley.newton_sums(zero, one, w)([batch])
    total = np.array(out.column("sums")[0].as_py()).reshape(d, d + 1)
    loss = lambda v: np.log1p(np.exp(-(a - b) @ v)).sum()
    for k in range(d):
        e = np.eye(d)[k] * 1e-5
        assert total[k, 0] == pytest.approx((loss(w + e) - loss(w - e)) / 2e-5, rel=1e-4)
    assert np.allclose(total[:, 1:], total[:, 1:].T) and np.linalg.eigvalsh(total[:, 1:]).min() > 0


def test_one_class_and_none(spark, sf):
    docs = table(spark, sf, "documents").limit(20)
    for labels, score in (([(1, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.0), ([(1, None), (None, 1)], 0.0)):
        model = bradley.fit_ranking(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        rows = bradley.score_quality(docs, model).collect()
        assert all(r["score"] == pytest.approx(score, abs=1e-6) for r in rows)


def test_repeated_ids_are_cut_to_the_sample(spark):
    docs = spark.range(3000).select(
        F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("Some words of text "), F.col("id")).alias("text")
    )
    docs = docs.unionByName(spark.createDataFrame([(8, "### ### $$$ ###"), (8, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (7, 1)], "doc_id long, quality int")
    model = bradley.fit_ranking(docs, labels, sample_rows=5000)
    assert model.score(np.array([bradley.features("A text of plain words")]))[0] > 0.3
    cut = bradley.fit_ranking(docs, labels, sample_rows=2)
    assert len(cut.weights) == len(bradley.FEATURES)


def test_all_labelled_rows_are_learned_from(spark):
    """More labelled rows than the sample had that was learned from once."""
    n = 20_700
    text = F.concat_ws(" ", F.expr("transform(sequence(0, cast(id % 37 as int)), k -> concat('w', k * id % 11))"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(8)
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("int(id % 37 > 7 or id % 5 = 0)").alias("quality"))
    model = bradley.fit_ranking(docs, labels)
    rows = np.array([bradley.features(r["text"]) for r in docs.collect()])
    assert model.means == pytest.approx(rows.mean(0), rel=1e-9)
    assert model.scales == pytest.approx(np.where(rows.std(0) > 1e-9, rows.std(0), 1.0), rel=1e-9)
    share = labels.where("quality = 0").count() / n
    assert model.cut == pytest.approx(np.quantile(model.raw(rows), share), rel=1e-9)
    made = bradley.with_place(docs)
    twice = bradley.fit_ranking(made, labels, made=True)
    assert twice.weights == pytest.approx(model.weights, rel=1e-6)
    pick = lambda df: {r["doc_id"]: r["score"] for r in df.select("doc_id", "score").collect()}
    assert pick(bradley.score_quality(made, model, made=True)) == pytest.approx(pick(bradley.score_quality(docs, model)))


def test_features_of_odd_texts():
    for text in (None, "", " \n", "a", "a " * 60_000, "###", "\U0001f600 中文\n\n", "A\x00B"):
        found = bradley.features(text)
        assert len(found) == len(bradley.FEATURES) and np.isfinite(found).all()
