"""The stored reference summary: exact for small tables, certified bounds for large ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline import schemas as S
from meterline.operators import drift as DR, reference as RF
from meterline.sources.staging import stage

SHAPE = "trip_distance double, passenger_count double, pickup_hour double, pickup_dayofweek double"


def frame(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = np.column_stack(
        [rng.lognormal(1 + shift, 1, n), rng.integers(1, 7, n), rng.integers(0, 24, n), rng.integers(0, 7, n)]
    )
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], SHAPE)


def by_feature(df):
    return {r["feature"]: r.asDict() for r in df.collect()}


def test_small_references_are_exact(spark):
    ref, cur = frame(spark, 3000, 1), frame(spark, 500, 2, 0.3)
    summary = RF.summarise(ref)
    got, want = by_feature(RF.column_drift(summary, cur)), by_feature(DR.column_drift(ref, cur))
    for f in S.DRIFT_FEATURES:
        assert got[f]["distance"] == pytest.approx(want[f]["distance"], rel=1e-9)
        assert got[f]["score"] == pytest.approx(want[f]["score"], rel=1e-9)
        assert got[f]["drifted"] == want[f]["drifted"] and got[f]["certain"]
        assert got[f]["score_low"] == pytest.approx(got[f]["score_high"], rel=1e-9)
    old = {(r.feature, r.metric): r.value for r in DR.drift_report(ref, cur.withColumn("prediction", F.lit(1.0))).collect()}
    new = RF.drift_report(summary, cur.withColumn("prediction", F.lit(1.0))).collect()
    assert {(r.feature, r.metric) for r in new} == set(old)
    assert all(r.value == pytest.approx(old[r.feature, r.metric], rel=1e-9, abs=1e-9) for r in new)


@pytest.mark.parametrize("shift", [0.0, 0.05, 0.4])
def test_large_references_are_bounded(spark, shift):
    ref, cur = frame(spark, 40_000, 3), frame(spark, 3000, 4, shift)
    summary = stage(RF.summarise(ref, k=1024, knots=512), "test-summary")
    assert not summary.where("exact").count()
    want = by_feature(DR.column_drift(ref, cur))
    for ranges in (None, 1):
        for f, r in by_feature(RF.column_drift(summary, cur, ranges=ranges)).items():
            assert r["score_low"] <= want[f]["score"] <= r["score_high"]
            assert r["score_high"] - r["score_low"] < 0.5
            if r["certain"]:
                assert r["drifted"] == want[f]["drifted"]


def test_summaries_merge(spark):
    parts = [frame(spark, 900, 5), frame(spark, 700, 6, 2.0), frame(spark, 0, 7)]
    whole = by_feature(RF.summarise(parts[0].unionByName(parts[1])))
    merged = by_feature(RF.merged([RF.summarise(p) for p in parts]))
    for f, r in whole.items():
        for c in ("n", "mean", "std", "low", "high"):
            assert merged[f][c] == pytest.approx(r[c], rel=1e-9)
        assert merged[f]["values"] == r["values"] and merged[f]["counts"] == r["counts"]


def test_nulls_empty_tables_and_single_values(spark):
    ref = frame(spark, 50, 8).withColumn("pickup_hour", F.lit(None).cast("double")).withColumn("passenger_count", F.lit(2.0))
    summary = RF.summarise(ref)
    got, want = by_feature(RF.column_drift(summary, frame(spark, 40, 9))), by_feature(DR.column_drift(ref, frame(spark, 40, 9)))
    for f in want:
        assert got[f]["drifted"] == want[f]["drifted"]
        assert got[f]["distance"] == pytest.approx(want[f]["distance"], rel=1e-9)
    assert all(r["n"] == 0 and r["values"] == [] for r in by_feature(RF.summarise(ref.limit(0))).values())


def test_a_stored_summary_needs_no_reference(spark, tmp_path):
    path = str(tmp_path / "summary")
    RF.save_summary(RF.summarise(frame(spark, 300, 10)), path)
    tail = frame(spark, 60, 11).withColumn("prediction", F.lit(2.0))
    report = RF.drift_report(RF.load_summary(spark, path), tail)
    assert report.count() > 30
    files = {f.rsplit("/", 2)[-2] for f in report.inputFiles()}
    assert files <= {"summary"}


def test_categories_take_part_in_the_report(spark):
    ref, cur = frame(spark, 300, 12), frame(spark, 100, 13).withColumn("prediction", F.lit(1.0))
    side = lambda df, p: df.withColumn("zone", F.when(F.col("pickup_hour") < p, "a").otherwise("b"))
    rows = {(r.feature, r.metric): r.value for r in DR.drift_report(side(ref, 2), side(cur, 22), categorical=["zone"]).collect()}
    assert rows["zone", "drifted"] == 1 and rows["dataset", "n_features"] == 5
    assert ("zone", "reference_mean") not in rows


def test_noise_hangs_on_the_row(spark):
    rows = spark.range(4000).selectExpr("md5(string(id)) AS trip_id", "id % 60 * 1.0 AS trip_duration_minutes")
    a, b = (DR.perturb(rows.repartition(n), "noise") for n in (2, 7))
    one, other = ({r[0]: r[1] for r in df.collect()} for df in (a, b))
    assert one == pytest.approx(other, rel=1e-12)  # the deviation's last bit hangs on the order of sums
    noise = np.array([r[0] for r in rows.select(DR.standard_normal(F.col("trip_id"), 42)).collect()])
    assert abs(noise.mean()) < 0.08 and abs(noise.std() - 1) < 0.05 and abs((noise**3).mean()) < 0.3
