"""Boundary rows, brute-force checks and invariants on small fixtures."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline import schemas as S
from meterline.functions import calendar as C, numeric as N, trip as TR
from meterline.operators import cleaning as CL, distribution as DI, drift as DR
from meterline.operators import evaluation as EV, features as FE, lookups as LK
from meterline.operators import profile as PR, ranking as RK, sampling as SA
from meterline.plans import views as V
from meterline.sources import readers as RD, staging as ST, writers as WR

T0 = dt.datetime(2024, 1, 1)


def trips(spark, **changes):
    """Ten valid hourly trips of 15 minutes; each change replaces one column."""
    rows = []
    n = max([len(v) for v in changes.values()] or [10])
    for i in range(n):
        row = {
            S.PICKUP: T0 + dt.timedelta(hours=i),
            S.DROPOFF: T0 + dt.timedelta(hours=i, minutes=15),
            "passenger_count": 1.0,
            "trip_distance": 2.5,
            "PULocationID": 100 + i,
            "DOLocationID": 200,
            "payment_type": 1,
            "fare_amount": 12.0,
            "tip_amount": 2.0,
            "total_amount": 15.0,
        }
        row.update({k: v[i] for k, v in changes.items()})
        rows.append(tuple(row.values()))
    schema = (
        f"{S.PICKUP} timestamp_ntz, {S.DROPOFF} timestamp_ntz, passenger_count double,"
        " trip_distance double, PULocationID bigint, DOLocationID bigint, payment_type bigint,"
        " fare_amount double, tip_amount double, total_amount double"
    )
    return spark.createDataFrame(rows, schema)


def numbers(spark, values, name="x"):
    rows = [(None if v is None else float(v),) for v in values]
    return spark.createDataFrame(rows, f"{name} double")


# --- cleaning ------------------------------------------------------------------------


def test_valid_trips_survive(spark):
    out = CL.clean_trips(trips(spark))
    assert out.count() == 10 and S.TARGET in out.columns


@pytest.mark.parametrize(
    "column,values,kept",
    [
        ("fare_amount", [2.49, 2.5, 500.0, 500.01, None, float("nan")], 2),
        ("trip_distance", [0.09, 0.1, 100.0, 100.1, None], 2),
        ("passenger_count", [0.0, 1.0, 6.0, 7.0, None], 2),
        ("total_amount", [2.4, 2.5, 1000.0, 1000.5], 2),
    ],
)
def test_range_boundaries(spark, column, values, kept):
    df = RD.nan_to_null(trips(spark, **{column: values}))
    assert CL.clean_trips(df).count() == kept


def test_duration_boundaries_and_zero_divisor(spark):
    ends = [T0 + dt.timedelta(seconds=s) for s in (-60, 0, 59, 60, 10_800, 10_801)]
    df = trips(spark, **{S.PICKUP: [T0] * 6, S.DROPOFF: ends})
    timed = CL.add_duration(df)
    assert sorted(r[0] for r in CL.filter_duration(timed).select("trip_duration_minutes").collect()) == [1.0, 180.0]
    # A zero duration gives no speed instead of an error.
    assert CL.add_speed(timed).where("avg_speed_mph is null").count() == 1


def test_impute_fills_passengers_only(spark):
    df = trips(spark, passenger_count=[None, 2.0, 9.0])
    out = CL.clean_trips_impute(df).select("passenger_count").collect()
    assert sorted(r[0] for r in out) == [1.0, 2.0]


def test_audit_follows_the_filters(spark, sf):
    raw = V.trips(spark, sf)
    kept = [r["kept"] for r in CL.clean_audit(raw).orderBy("step").collect()]
    assert kept == sorted(kept, reverse=True)
    assert kept[:6] == [6000, 5675, 5390, 4860, 3647, 3647]
    assert kept[5] == CL.clean_trips(raw).count()
    assert kept[7] == V.strict_features(spark, sf).count() == 3485


def test_validation_names_the_broken_rules(spark):
    df = spark.createDataFrame(
        [(2.5, 1, 14, 2), (0.0, 9, 14, 2), (None, 1, 24, 7)],
        "trip_distance double, passenger_count int, pickup_hour int, pickup_dayofweek int",
    )
    got = [tuple(r.failed_rules) for r in CL.validate_trips(df).collect()]
    assert got == [
        (),
        ("trip_distance", "passenger_count"),
        ("trip_distance", "pickup_hour", "pickup_dayofweek"),
    ]


def test_require_features(spark):
    with pytest.raises(ValueError, match="not_there"):
        CL.require_features(trips(spark), ["trip_distance", "not_there"])


# --- scalars --------------------------------------------------------------------------


def test_cut_is_right_closed(spark):
    values = [-0.1, 0.0, 1.0, 1.01, 100.0, 100.1, float("nan"), None]
    out = [r[0] for r in numbers(spark, values).select(TR.distance_category(F.col("x"))).collect()]
    assert out == [None, None, "very_short", "short", "very_long", None, None, None]
    hours = [r[0] for r in spark.range(24).select(C.time_of_day_cut(F.col("id"))).collect()]
    assert hours == ["night"] * 7 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 5


def test_rounding_and_labels_follow_python(spark):
    values = [0.25, 0.35, 1.25, 2.675, 0.125, 12.345, 1e-9, 99.949999]
    rows = numbers(spark, values).select(
        "x", N.round_cents(F.col("x")).alias("c"), N.bin_label(F.col("x"), F.col("x") * 2).alias("l")
    )
    for r in rows.collect():
        assert r.c == float(np.round(np.float64(r.x), 2))
        assert r.l == f"{r.x:.1f}-{r.x * 2:.1f}"


def test_iso_timestamp_follows_python(spark):
    stamps = [T0, dt.datetime(2024, 5, 6, 7, 8, 9, 120), dt.datetime(2024, 5, 6, 7, 8, 9, 500000)]
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    assert [r[0] for r in df.select(C.iso_timestamp(F.col("t"))).collect()] == [
        t.isoformat() for t in stamps
    ]


def test_durations_ignore_the_session_zone(spark):
    # The clocks of this zone change between the two times.
    df = spark.createDataFrame(
        [(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 3, 30))], "a timestamp_ntz, b timestamp_ntz"
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = df.select(
            C.duration_minutes(F.col("a"), F.col("b")).alias("m"),
            C.from_instant(C.to_instant(F.col("b"))).alias("b"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.m == 120.0 and row.b == dt.datetime(2024, 3, 10, 3, 30)


def test_clip_keeps_null(spark):
    out = numbers(spark, [0.5, 200.0, None]).select(N.clip(F.col("x"), 1.0, 180.0)).collect()
    assert [r[0] for r in out] == [1.0, 180.0, None]


# --- order statistics ---------------------------------------------------------------------


def skewed(n=4000, seed=7):
    """A third of the rows share one value; the rest spread over magnitudes."""
    rng = random.Random(seed)
    return [3.25 if i % 3 == 0 else rng.lognormvariate(0, 4) for i in range(n)]


def test_exact_quantiles_match_numpy(spark):
    values = skewed()
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = numbers(spark, [*values, None, None]).repartition(5)
    row = DI.exact_quantiles(df, ["x"], probs).first()
    assert row.n == len(values)
    np.testing.assert_allclose(row.q, np.percentile(values, [p * 100 for p in probs]), rtol=1e-12)
    small = DI.exact_quantiles(df, ["x"], probs, ranges=1).first()
    np.testing.assert_allclose(small.q, row.q, rtol=1e-12)


def test_exact_quantiles_by_group(spark):
    rows = [(g, v * (g + 1)) for g in range(3) for v in skewed(500, g)]
    df = spark.createDataFrame(rows, "g int, x double")
    for r in DI.exact_quantiles(df, ["x"], [0.3], ["g"], ranges=32).collect():
        want = np.percentile([v for g, v in rows if g == r.g], 30)
        assert r.q[0] == pytest.approx(want, rel=1e-12)


def brute_distances(a, b):
    a, b = np.sort(a), np.sort(b)
    v = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(a, v, side="right") / len(a)
    g = np.searchsorted(b, v, side="right") / len(b)
    return float(np.sum(np.diff(v) * np.abs(f - g)[:-1])), float(np.max(np.abs(f - g)))


@pytest.mark.parametrize("ranges", [1, 16, 256])
def test_distances_match_brute_force(spark, ranges):
    a, b = skewed(3000, 1), [v * 1.3 for v in skewed(700, 2)]
    row = DI.distances(numbers(spark, a), numbers(spark, b), ["x"], ranges).first()
    w, ks = brute_distances(a, b)
    assert row.wasserstein == pytest.approx(w, rel=1e-9) and row.ks == pytest.approx(ks, rel=1e-9)


def test_distance_worked_example(spark):
    a, b = numbers(spark, [1.0, 2, 3, 4, 5]), numbers(spark, [8.0, 9, 10, 11, 12])
    assert DR.column_drift(a, b, ["x"], norm="none").first().score == pytest.approx(7.0)
    row = DR.column_drift(a, b, ["x"], norm="range").first()
    assert row.score == pytest.approx(7 / 11) and row.drifted == 1
    same = DR.column_drift(a, a, ["x"]).first()
    assert same.score == 0.0 and same.drifted == 0


def test_shift_is_the_distance(spark):
    values = skewed(600)
    row = DI.distances(numbers(spark, values), numbers(spark, [v + 2.5 for v in values]), ["x"]).first()
    assert row.wasserstein == pytest.approx(2.5, rel=1e-9)


def test_ks_pvalue(spark):
    # t = 0.5, 1.0 and 1.36 with n1 = n2 = 200, so that n1 n2 / (n1 + n2) = 100.
    df = numbers(spark, [0.0, 0.05, 0.1, 0.136])
    out = df.select(DI.ks_pvalue(F.col("x"), F.lit(200), F.lit(200))).collect()
    assert [round(r[0], 6) for r in out] == [1.0, 0.963945, 0.27, 0.049486]


# --- histograms ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "values",
    [[float(i) for i in range(11)], [0.1 * i for i in range(101)], skewed(999), [4.0] * 5],
)
def test_histogram_matches_numpy(spark, values):
    rows = PR.histogram(numbers(spark, values), ["x"]).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    density, _ = np.histogram(values, bins=10, density=True)
    assert [r["count"] for r in rows] == counts.tolist()
    np.testing.assert_allclose([r.lo for r in rows] + [rows[-1].hi], edges, rtol=1e-12)
    np.testing.assert_allclose([r.density for r in rows], density, rtol=1e-9)


def test_histogram_pair_percentages(spark):
    a = numbers(spark, [1.0, 2, 3], "trip_distance")
    b = numbers(spark, [10.0, 11], "trip_distance")
    rows = PR.histogram_pair(a, b, ["trip_distance"]).orderBy("bin").collect()
    assert sum(r.reference_pct for r in rows) == pytest.approx(100)
    assert rows[-1].current_pct == pytest.approx(100) and rows[0].label == "1.0-2.0"


# --- evaluation -----------------------------------------------------------------------------

PAIRS = [(4.0, 5.0), (8.0, 8.0), (12.0, 9.0), (16.0, 18.0)]


def test_metric_pairs(spark):
    df = spark.createDataFrame(PAIRS, "fare_amount double, predicted double")
    m = EV.regression_metrics(df).first()
    assert (m.mae, m.mse, m.r2, m.median_ae, m.max_error) == pytest.approx((1.5, 3.5, 1 - 14 / 80, 1.5, 3.0))


def test_segments_and_buckets_cover_all_rows(spark, sf):
    test = V.split_of(V.scored_trips(spark, sf), "test").cache()
    n = test.count()
    seg = EV.segment_metrics(test).groupBy("segment").agg(F.sum("count"), F.sum("pct")).collect()
    assert len(seg) == 4 and all(r[1] == n and r[2] == pytest.approx(100) for r in seg)
    assert EV.error_buckets(test).agg(F.sum("count")).first()[0] == n
    test.unpersist()


def test_alerts_stay_silent_on_equal_data(spark):
    df = spark.createDataFrame(PAIRS, "fare_amount double, predicted double")
    assert DR.check_alerts(df, df).count() == 0


# --- samples and splits ------------------------------------------------------------------------


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("trip_id"))
    want = sorted(range(5000), key=lambda i: (_md5(f"{i}|42"), str(i)))[:137]
    for parts in (1, 7):
        got = SA.sample_n(df.repartition(parts), 137).collect()
        assert {int(r.trip_id) for r in got} == set(want)
    assert SA.sample_n(df, 9999).count() == 5000


def test_sample_with_a_hot_key(spark):
    # A third of the rows share one key and so one hash.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("trip_id")
    )
    for n in (10, 900, 1700, 2500):
        assert SA.sample_n(df, n).count() == n


def _md5(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def test_split_is_a_partition(spark, sf):
    raw = SA.split_data(V.trips(spark, sf))
    counts = {r["split"]: r["count"] for r in raw.groupBy("split").count().collect()}
    assert counts == {"train": 4235, "val": 594, "test": 1171}


# --- lookups -------------------------------------------------------------------------------------


def test_route_lookup_default_and_salting(spark):
    df = spark.createDataFrame(
        [(161, 237, i) for i in range(30)] + [(1, 2, 99)], "PULocationID long, DOLocationID long, id long"
    )
    routes = spark.createDataFrame([(161, 237, 1.07)], "PULocationID long, DOLocationID long, avg_distance double")
    plain = LK.lookup_route_distance(df, routes).orderBy("id").collect()
    for row_key in ([], ["id"]):
        salted = LK.lookup_route_distance(df, routes, skewed=True, row_key=row_key)
        assert salted.orderBy("id").collect() == plain
    assert plain[0].route_distance == 1.07 and plain[-1].route_distance == 3.0 and not plain[-1].has_data


def test_hot_keys_are_found_and_split(spark):
    """Half of the rows have one key, and a tenth another one: no task of the join gets more than
    twice what the median task gets."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, 8).otherwise(F.col("id") % 5000)
        facts = spark.range(60_000).select(key.cast("long").alias("k"), F.col("id").alias("row"))
        table = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        found = {r["_key"] for r in LK.hot_keys(facts, ["k"], 16).collect()}
        assert found == {r[0] for r in spark.sql("SELECT xxhash64(7L) UNION SELECT xxhash64(8L)").collect()}
        joined = LK.left_lookup(facts, table, ["k"], skewed=True, row_key=["row"])
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("v <> 2 * k OR v IS NULL").count() == 0 and joined.distinct().count() == 60_000
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) <= 2 * np.median(sizes)
        plain = LK.left_lookup(facts, table, ["k"]).groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in plain) > 4 * np.median([r["count"] for r in plain])
    finally:
        for k in off:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_encoder_is_sorted_and_marks_unseen(spark):
    rng = random.Random(3)
    words = [f"{rng.choice('abc')}{rng.randrange(2000)}" for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    codes = {r["class"]: r.code for r in LK.encoder_fit(df, ["w"]).collect()}
    assert codes == {w: i for i, w in enumerate(sorted(set(words)))}
    unseen = spark.createDataFrame([("zzz",), (words[0],)], "w string")
    out = [r.w for r in LK.encode_lookup(unseen, LK.encoder_fit(df, ["w"]), ["w"]).collect()]
    assert sorted(out) == sorted([-1, codes[words[0]]])


def test_scaler_with_zero_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = LK.scaler_apply(df, LK.scaler_fit(df, ["a", "b"]), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_correlation_survives_a_large_mean(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0, 1) for _ in range(500)]
    rows = [(1e9 + x, x + rng.gauss(0, 1)) for x in xs]
    r = PR.corr_matrix(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    want = np.corrcoef([a for a, _ in rows], [b for _, b in rows])[0, 1]
    assert r.where("a = 'a' and b = 'b'").first().r == pytest.approx(want, rel=1e-6)


# --- ranking -----------------------------------------------------------------------------------------


def test_features_needed(spark):
    df = spark.createDataFrame(
        [("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.05)], "feature string, importance double"
    )
    got = {r.threshold: r.features for r in RK.features_needed(df).collect()}
    # 0.5 + 0.3 reaches 0.8 exactly, 0.95 is the first sum above 0.9.
    assert got == {0.8: 2, 0.9: 3}


# --- sources -------------------------------------------------------------------------------------------


def test_old_and_new_log_records(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(
        '[{"timestamp":"t1","inputs":{"trip_distance":1.5},"prediction":7.0},'
        '{"timestamp":"t2","input":{"trip_distance":2.5,"VendorID":2},"prediction":9.0}]'
    )
    rows = RD.flatten_inputs(RD.scan_prediction_log(spark, str(path))).orderBy("timestamp").collect()
    assert [(r.trip_distance, r.prediction) for r in rows] == [(1.5, 7.0), (2.5, 9.0)]
    bad = tmp_path / "bad.json"
    bad.write_text("not json")
    assert RD.scan_prediction_log(spark, str(bad)).count() == 0


def test_route_table_json(spark, tmp_path):
    path = tmp_path / "routes.json"
    path.write_text('{"161_237": 1.07, "1_2": 3.5}')
    rows = RD.scan_route_table(spark, str(path)).orderBy("PULocationID").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 3.5), (161, 237, 1.07)]


def test_absent_logs_and_routes_are_empty_tables(spark, tmp_path):
    log = RD.scan_prediction_log(spark, str(tmp_path / "none.json"))
    assert log.columns == ["timestamp", "inputs", "prediction"] and log.count() == 0
    routes = RD.scan_route_table(spark, str(tmp_path / "none.json"))
    assert routes.columns == ["PULocationID", "DOLocationID", "avg_distance"] and routes.count() == 0


@pytest.mark.parametrize("layout", ["compact", "pretty", "lines"])
def test_log_files_are_split(spark, tmp_path, layout):
    records = [
        {"timestamp": f"t{k:04d}", "inputs" if k % 2 else "input": {"trip_distance": k / 2, "VendorID": 1}, "prediction": 1.0 * k}
        for k in range(3000)
    ]
    texts = {"compact": lambda: json.dumps(records), "pretty": lambda: json.dumps(records, indent=2)}
    path = tmp_path / "log.json"
    path.write_text(texts.get(layout, lambda: "\n".join(map(json.dumps, records)))())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        log = RD.flatten_inputs(RD.scan_prediction_log(spark, str(path)))
        assert log.select(F.spark_partition_id()).distinct().count() > 4
        rows = log.orderBy("timestamp").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.timestamp, r.trip_distance, r.prediction) for r in rows] == [(f"t{k:04d}", k / 2, float(k)) for k in range(3000)]


def test_route_files_are_split(spark, tmp_path):
    path = tmp_path / "routes.json"
    path.write_text(json.dumps({f"{k}_{k + 1}": k / 4 for k in range(9000)}, indent=1) + '\n{"7_7": 1e1}\n{"x": 2, "8_8": null}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        routes = RD.scan_route_table(spark, str(path))
        assert routes.select(F.spark_partition_id()).distinct().count() > 2
        rows = {tuple(r) for r in routes.where("PULocationID is not null").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {(k, k + 1, k / 4) for k in range(9000)} | {(7, 7, 10.0), (8, 8, None)}


def test_compaction_keeps_rows_and_splits_large_days(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, DATE'2024-01-01', DATE'2024-01-02') AS day")
    for k in range(3):
        WR.append_log(rows.where(F.col("id") % 3 == k).repartition(5), path, "day")
    WR.append_log(rows.limit(10).withColumn("day", F.lit("2024-01-03").cast("date")).repartition(3), path, "day")
    files = lambda day: len(list((tmp_path / "log" / f"day={day}").glob("*.parquet")))
    before = {d: files(d) for d in ("2024-01-01", "2024-01-02", "2024-01-03")}
    WR.compact_log(spark, path, ["2024-01-01", "2024-01-02"], rows_per_file=600)
    assert files("2024-01-01") == 2 and 2 <= files("2024-01-02") <= 4
    assert files("2024-01-03") == before["2024-01-03"] > 1 and before["2024-01-02"] > 4
    again = spark.read.parquet(path)
    assert again.count() == 3010 and again.select("id").distinct().count() == 3000


def test_types_of_months_meet(spark, tmp_path):
    kinds = {
        "number": ["int", "decimal(10,2)", "double"],
        "exact": ["int", "decimal(10,2)", "decimal(12,4)"],
        "day": ["date", "timestamp_ntz", "date"],
        "void": ["int", "bigint", "smallint"],
    }
    for k in range(3):
        row = spark.sql("SELECT 7 AS number, 7 AS exact, DATE'2024-02-03' AS day, 7 AS void")
        row.select(*[F.col(c).cast(t[k]) for c, t in kinds.items()]).write.parquet(str(tmp_path / str(k)))
    df = RD.scan_many(spark, [str(tmp_path / str(k)) for k in range(3)])
    assert dict(df.dtypes) == {"number": "double", "exact": "decimal(14,4)", "day": "timestamp_ntz", "void": "bigint"}
    assert df.distinct().count() == 1
    spark.sql("SELECT 'seven' AS number").write.parquet(str(tmp_path / "text"))
    with pytest.raises(ValueError, match="number is"):
        RD.scan_many(spark, [str(tmp_path / "0"), str(tmp_path / "text")])


def test_shared_folder_comes_from_the_session(spark):
    assert ST.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# --- plans -----------------------------------------------------------------------------------------------


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "trips")
    trips(spark).write.parquet(path)
    df = FE.engineer_features(CL.clean_trips(spark.read.parquet(path))).groupBy("pickup_hour").agg(
        F.avg("fare_amount")
    )
    plan = executed_plan(df)
    assert "GreaterThanOrEqual(fare_amount,2.5)" in plan.replace(" ", "")
    assert "Python" not in plan


def test_quantiles_across_and_inside_brackets(spark):
    """Below 10,000 values brackets are open; above, most values are counted by gap."""
    rng = np.random.default_rng(5)
    probs = [0.0, 0.0001, 0.01, 0.25, 0.5, 0.501, 0.99, 1.0]
    for n in (2, 9_999, 10_000, 60_000):
        x = np.concatenate([rng.lognormal(0, 3, n - n // 3), np.full(n // 3, 2.5)])
        x[0] = 1e300
        df = numbers(spark, x.tolist()).repartition(5)
        row = DI.exact_quantiles(df, ["x"], probs).first()
        assert row.n == n
        np.testing.assert_allclose(row.q, np.percentile(x, [p * 100 for p in probs]), rtol=1e-12)
    counts = DI.bracketed_counts(df, ["x"], [0.25, 0.5])
    assert counts.where("column < 0").first().n == n
    assert 2 < counts.count() < 0.01 * n


def test_quantiles_with_nan_and_nulls(spark):
    values = [float(x) for x in range(30_000)] + [float("nan")] * 100 + [None] * 50
    df = spark.createDataFrame([(v, v) for v in values], "x double, y double").repartition(3)
    for r in DI.exact_quantiles(df, ["x", "y"], [0.5, 1.0]).collect():
        assert r.n == 30_100 and r.q[0] == 15_049.5 and np.isnan(r.q[1])


def test_quantiles_of_many_groups(spark):
    """100,000 groups and a large one: the same numbers as a grouped percentile, no broadcast."""
    small = F.struct((F.col("id") % 100_000).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x"))
    large = F.struct(F.lit(-1).cast("long").alias("g"), (F.rand(3) * 1000).alias("x"))
    df = spark.range(300_000).select(F.explode(F.array(small, F.when(F.col("id") % 3 == 0, large))).alias("r")).where("r is not null").select("r.*")
    df = ST.stage(df, "t-groups")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what is left would be forced
    try:
        plan = DI.exact_quantiles(df, ["x"], [0.1, 0.5], by=["g"], many=True)
        assert "Broadcast" not in executed_plan(plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5))).alias("w"), F.count("x").alias("m"))
    joined = plan.join(want, "g")
    gap = F.exists(F.zip_with("q", "w", lambda a, b: F.abs(a - b) > 1e-9), lambda x: x)
    assert joined.count() == 100_001 and joined.where(gap | (F.col("n") != F.col("m"))).count() == 0


def test_samples_by_group_are_lazy_and_exact(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("trip_id"), (F.col("id") % 4).alias("g"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("t-lazy", "")
    got = SA.sample_by(df, "g", {0: 100, 1: 5, 2: 9999, 7: 3}, key="trip_id", unique=True)
    assert not tracker.getJobIdsForGroup("t-lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {0: 100, 1: 5, 2: 1000}
    order = SA.sample_hash("trip_id")
    want = {r.trip_id for r in df.where("g = 0").orderBy(order, "trip_id").limit(100).collect()}
    assert {r.trip_id for r in got.where("g = 0").collect()} == want
    assert SA.sample_n(df, 0).count() == 0


def test_samples_of_repeated_keys_are_exact(spark):
    df = spark.range(900).select(F.lit("same").alias("trip_id"), "id").unionByName(
        spark.range(50).select(F.col("id").cast("string").alias("trip_id"), "id")
    )
    for n in (1, 40, 500, 949, 950, 2000):
        assert SA.sample_n(df, n, unique=False).count() == min(n, 950)


def test_outliers_of_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (900.0, None)], "x double, y double")
    rows = PR.iqr_outliers(df, ["x", "y"]).collect()
    assert [(r.feature, r.q1, r.over_500, r.outliers) for r in rows] == [("x", 1.5, 1, 0)]
    assert PR.iqr_outliers(df.limit(0), ["x"]).count() == 0


def test_quantiles_and_distances_scan_few_times(spark, sf):
    a = V.strict_features(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan, with what it reuses
    try:
        plan = executed_plan(DI.exact_quantiles(a, ["fare_amount"], [0.5]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("FileScan") == 2
    b = V.event_log(spark, sf)
    assert executed_plan(DI.distances(a, b, ["trip_distance"])).count("FileScan") == 2


def test_segments_scan_once(spark, sf):
    plan = executed_plan(EV.segment_metrics(V.scored_trips(spark, sf)))
    assert plan.count("FileScan") == 1
