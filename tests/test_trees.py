"""Trees against the library's, whose bins are the same where a feature has few values."""

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from meterline import schemas as S
from meterline.ml import trees as TR, training as TN
from meterline.ml.factory import get_model
from meterline.sources import staging as ST

NAMES = ["a", "b", "c", "same"]


def _rows(spark, n=1500):
    df = spark.range(n).select(
        "id",
        (F.col("id") % 7).cast("double").alias("a"),
        (F.hash("id") % 9).cast("double").alias("b"),
        (F.xxhash64("id", F.lit(1)) % 20).cast("double").alias("c"),
        F.lit(3.0).alias("same"),
        (F.xxhash64("id", F.lit(2)) % 1000 / 1000.0).alias("noise"),
    )
    fare = 2 * F.col("a") + F.col("b") * F.col("c") / 7 + F.col("noise")
    return df.withColumn(S.TARGET, fare).withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train"))


def _vectors(spark, n=1500):
    return TN.assemble(_rows(spark, n), NAMES).select("id", S.TARGET, "features_vector").cache()


def _scores(model, rows):
    return [r.predicted for r in model.transform(rows).select("id", "predicted").orderBy("id").collect()]


COLUMNS = {"featuresCol": "features_vector", "labelCol": S.TARGET, "predictionCol": "predicted", "seed": 42}


def test_forest_without_bootstrap_equals_the_library(spark):
    rows = _vectors(spark)
    ours = get_model("random_forest", {"n_estimators": 2, "max_depth": 7, "bootstrap": False, "min_samples_leaf": 3}).fit(rows)
    library = RandomForestRegressor(
        numTrees=2, maxDepth=7, bootstrap=False, minInstancesPerNode=3, featureSubsetStrategy="all", **COLUMNS
    ).fit(rows)
    assert _scores(ours, rows) == pytest.approx(_scores(library, rows), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(library.featureImportances.toArray(), abs=1e-9)
    assert [t.numNodes for t in ours.trees] == [t.numNodes for t in library.trees]
    assert ours.getNumTrees == 2 and ours.getOrDefault("maxDepth") == 7


def test_boosting_equals_the_library_past_checkpoints(spark):
    rows = _vectors(spark)
    ours = get_model("gradient_boosting", {"n_estimators": 13, "max_depth": 3}).fit(rows)
    library = GBTRegressor(maxIter=13, maxDepth=3, stepSize=0.1, checkpointInterval=10, **COLUMNS).fit(rows)
    assert _scores(ours, rows) == pytest.approx(_scores(library, rows), abs=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(library.featureImportances.toArray(), abs=1e-9)
    assert ours.treeWeights == library.treeWeights


@pytest.mark.parametrize("name", ["random_forest", "gradient_boosting"])
def test_saved_trees_score_as_before_and_as_the_library(spark, name):
    path = ST.new_path(spark, "t-trees")
    TN.save_trained(TN.train_model(name, _rows(spark), NAMES, params={"n_estimators": 4, "max_depth": 5}), path)
    saved = TN.load_trained(spark, path)
    rows = spark.createDataFrame(
        [(k, *map(float, x)) for k, x in enumerate([(1, 2, 3, 3), (6, -8, 19, 3), (-50, 99, 0.5, 0), (np.nan, 1, np.nan, 3)])],
        "id int, a double, b double, c double, same double",
    )
    vectors = TN.assemble(rows, NAMES, "keep")
    ours = _scores(saved.model, vectors)
    again = _scores(type(saved.model).library.load(f"{path}/model"), vectors)
    assert ours == pytest.approx(again, abs=1e-9) and len(set(ours)) > 1
    assert saved.metrics.count() == 2 and saved.model.transform(vectors).columns == [*vectors.columns, "predicted"]


def test_bootstrap_forest_learns_and_repeats_whatever_the_order_of_rows(spark):
    rows = _vectors(spark, 4000).repartition(3, "id").cache()
    fit = get_model("random_forest", {"n_estimators": 15, "max_depth": 6})
    first = fit.fit(rows)
    again = fit.fit(rows.sortWithinPartitions(F.desc("id")))
    assert _scores(first, rows) == pytest.approx(_scores(again, rows), abs=1e-9)
    assert len({t.toDebugString.split("\n", 1)[1] for t in first.trees}) == 15
    library = RandomForestRegressor(numTrees=15, maxDepth=6, featureSubsetStrategy="all", **COLUMNS).fit(rows)
    rmse = [m.transform(rows).select(F.sqrt(F.avg((F.col("predicted") - F.col(S.TARGET)) ** 2))).first()[0] for m in (first, library)]
    assert rmse[0] == pytest.approx(rmse[1], rel=0.1)


def test_jobs_and_groups_of_nodes_change_no_tree(spark, monkeypatch):
    rows = _vectors(spark)
    fit = get_model("random_forest", {"n_estimators": 3, "max_depth": 6, "max_features": "sqrt"})
    whole = fit.fit(rows)
    monkeypatch.setattr(TR, "ROOM", 1 << 16)  # a job for each tree, through a shuffle
    monkeypatch.setattr(TR, "SMALL", 0)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("trees-many", "")
    many = fit.fit(rows)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert _scores(many, rows) == pytest.approx(_scores(whole, rows), abs=1e-9)
    assert len(tracker.getJobIdsForGroup("trees-many")) > 12
    monkeypatch.setattr(TR, "NODES", 5)  # the subset of features hangs on the group
    plain = get_model("random_forest", {"n_estimators": 1, "max_depth": 6, "bootstrap": False})
    library = RandomForestRegressor(numTrees=1, maxDepth=6, bootstrap=False, featureSubsetStrategy="all", **COLUMNS).fit(rows)
    assert _scores(plain.fit(rows), rows) == pytest.approx(_scores(library, rows), abs=1e-9)


def test_what_only_the_library_does_is_left_to_it(spark):
    rows = _rows(spark).withColumn("kind", F.concat(F.lit("k"), (F.col("id") % 3).cast("string")))
    coded = StringIndexer(inputCol="kind", outputCol="code").fit(rows).transform(rows)
    vectors = VectorAssembler(inputCols=["code", "a"], outputCol="features_vector").transform(coded)
    fit = get_model("random_forest", {"n_estimators": 2, "max_depth": 3, "bootstrap": False})
    assert "in {" in fit.fit(vectors).toDebugString


def test_constant_label_missing_label_and_no_rows(spark):
    rows = _vectors(spark)
    fit = get_model("random_forest", {"n_estimators": 2, "max_depth": 4})
    flat = fit.fit(rows.withColumn(S.TARGET, F.lit(7.0)))
    assert [t.numNodes for t in flat.trees] == [1, 1] and set(_scores(flat, rows)) == {7.0}
    with pytest.raises(ValueError, match="no finite number"):
        fit.fit(rows.withColumn(S.TARGET, F.when(F.col("id") != 5, F.col(S.TARGET))))
    with pytest.raises(ValueError, match="no training rows"):
        fit.fit(rows.where("id < 0"))


def test_summaries_and_cuts():
    rng = np.random.default_rng(3)
    x = rng.exponential(size=200_000)
    values, weights = TR.merged([TR.summary(part) for part in np.array_split(x, 7)])
    assert len(values) <= TR.POINTS + 2 and weights.sum() == len(x)
    cuts = TR.cuts_of(values, weights, 32)
    shares = np.diff(np.searchsorted(np.sort(x), cuts), prepend=0, append=len(x)) / len(x)
    assert len(cuts) == 31 and np.abs(shares - 1 / 32).max() < 0.002
    few = TR.summary(np.repeat([1.0, 2.0, 5.0], [3, 1, 6]))
    assert few[1].tolist() == [3, 1, 6] and TR.cuts_of(*few, 32).tolist() == [1.5, 3.5]
    assert TR.cuts_of(*TR.summary(np.ones(4)), 32).tolist() == []


def test_weights_are_poisson_and_hang_on_tree_and_block():
    table = TR.chances(1.0, True)
    w = TR.drawn(table, 42, 3, 0, 1, 200_000)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and w.max() > 5
    assert (w == TR.drawn(table, 42, 3, 0, 1, 200_000)).all()
    assert (w != TR.drawn(table, 42, 4, 0, 1, 200_000)).mean() > 0.5
    assert TR.chances(1.0, False) is None and TR.chances(0.25, False).mean() == pytest.approx(0.25, abs=1e-4)
