"""A stored summary of a reference table, so that drift reports don't read it again.

One aggregate makes, per feature, its moments and a mergeable quantile sketch (KLL) of bounded
size. A sketch that never had to drop a value (no more rows than its size) is exact; otherwise
its ranks are off by at most `rank_error` of the rows, with 99 % confidence. The summary holds
`values`, the values of the sketch (or quantiles at even ranks), and `counts`, the rows that each
stands for: a table of at most features x `knots` values, against which any number of current
tables are compared. Distances come with the interval in which the exact ones lie.

Summaries of parts (days, regions) merge into that of the whole, sketches and moments alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterline import schemas as S
from meterline.functions import numeric as N
from meterline.operators import distribution as DI, drift as DR
from meterline.operators.profile import bounds, histogram_of_counts, moments, rows_of
from meterline.operators.sets import united_range
from meterline.sources.staging import stage

#: Values that a sketch keeps: samples up to this size are kept whole.
SKETCH_SIZE = 16_384
#: Quantiles that stand for a larger table.
KNOTS = 4_096


def rank_error(k: int) -> float:
    """Rank error of a sketch of this size, at 99 % confidence (a published fit)."""
    return 2.296 / k**0.9021


def _parts(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """``feature, n, mean, m2, low, high, sketch`` from one scan."""

    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("feature"),
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(v)).alias("m2"),
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.kll_sketch_agg_double(v, k).alias("sketch"),
        ).alias(c)

    return rows_of(df.agg(*[one(c) for c in columns]), [F.col(c) for c in columns])


def _even_shares(n: Column, size: int) -> Column:
    """Whole numbers that add up to n, as even as they can be."""

    def upto(i: Column) -> Column:
        return F.floor(n * i / size).cast("bigint")

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: upto(i + 1) - upto(i))


def _with_values(parts: DataFrame, k: int, knots: int) -> DataFrame:
    """Adds the values and counts that stand for the rows.

    ``parts`` is written first: the ranks at which a sketch is asked are constants that hang on
    the number of rows, one number per feature.
    """
    parts = stage(parts, "summary-parts")
    sizes = {r["feature"]: r["n"] for r in parts.select("feature", "n").collect()}
    # A sketch that kept every row gives them back at the ranks in the middle of 1/n wide steps.
    steps = {f: min(n, k) if n <= k else knots for f, n in sizes.items()}
    n = F.col("n")
    out = None
    for size in sorted(set(steps.values())):
        own = parts.where(F.col("feature").isin([f for f, x in steps.items() if x == size]))
        if size:
            ranks = F.split(F.lit(",".join(repr((i + 0.5) / size) for i in range(size))), ",").cast("array<double>")
            values = F.kll_sketch_get_quantile_double("sketch", ranks)
            counts = _even_shares(n, size)
        else:
            values, counts = F.array().cast("array<double>"), F.array().cast("array<bigint>")
        part = own.select(
            "*",
            F.sqrt(F.try_divide("m2", n - 1)).alias("std"),
            (n <= k).alias("exact"),
            F.when(n <= k, 0.0).otherwise(rank_error(k) + 1.0 / knots).alias("rank_error"),
            values.alias("values"),
            counts.alias("counts"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def summarise(
    reference: DataFrame, columns: Sequence[str] = S.DRIFT_FEATURES, k: int = SKETCH_SIZE, knots: int = KNOTS
) -> DataFrame:
    """``feature, n, mean, m2, std, low, high, sketch, exact, rank_error, values, counts``."""
    return _with_values(_parts(reference, columns, k), k, knots)


def merged(summaries: Sequence[DataFrame], k: int = SKETCH_SIZE, knots: int = KNOTS) -> DataFrame:
    """The summary of the tables together."""
    parts = None
    for s in summaries:
        own = s.select("feature", "n", "mean", "m2", "low", "high", "sketch")
        parts = own if parts is None else parts.unionByName(own)
    n, mean = F.col("n"), F.col("mean")
    whole = F.sum(n)
    # A row per part and feature.
    sums = parts.groupBy("feature").agg(
        whole.alias("n"),
        F.try_divide(F.sum(mean * n), whole).alias("mean"),
        F.coalesce(F.sum("m2"), F.lit(0.0)).alias("_within"),
        F.collect_list(F.when(n > 0, F.struct("n", "mean"))).alias("_means"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )
    between = F.aggregate(
        "_means", F.lit(0.0), lambda acc, p: acc + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean"))
    )
    return _with_values(sums.withColumn("m2", F.col("_within") + between).drop("_within", "_means"), k, knots)


def save_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").parquet(path)


def load_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def weighted_values(summary: DataFrame) -> DataFrame:
    """``feature, value, n``: the summary's rows, as counts of distinct values."""
    pairs = summary.select("feature", F.explode(F.arrays_zip("values", "counts")).alias("p"))
    return pairs.groupBy("feature", F.col("p.values").alias("value")).agg(F.sum("p.counts").alias("n"))


def distances(
    summary: DataFrame, current: DataFrame, columns: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """``feature, wasserstein, wasserstein_low, wasserstein_high, ks, ks_low, ks_high``.

    Between two neighbouring values the reference's share lies between its ranks at both, give or
    take the sketch's error; before its least and after its greatest value it is 0 and 1.
    """
    ref = weighted_values(summary.where(F.col("feature").isin(list(columns))))
    cur = DI.distinct_counts(current, columns)
    support = (
        ref.select("feature", "value", F.col("n").alias("n_ref"), F.lit(0).cast("bigint").alias("n_cur"))
        .unionByName(cur.select("feature", "value", F.lit(0).cast("bigint").alias("n_ref"), F.col("n").alias("n_cur")))
        .groupBy("feature", "value")
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )
    # One row of bounds per feature.
    ecdf = DI.cdf_of_counts(support, ranges).join(
        F.broadcast(summary.select("feature", F.col("low").alias("_low"), F.col("high").alias("_high"), "rank_error")),
        "feature",
    )
    known = F.col("rank_error") == 0
    v, nxt = F.col("value"), F.col("next_value")
    gap, f = F.col("f_cur"), F.col("f_ref")
    least = F.when(known, f).when(v >= F.col("_high"), 1.0).otherwise(F.greatest(F.lit(0.0), f - F.col("rank_error")))
    most = (
        F.when(known, f)
        .when(nxt <= F.col("_low"), 0.0)
        .otherwise(F.least(F.lit(1.0), F.col("next_f_ref") + F.col("rank_error")))
    )
    bounds = ecdf.select(
        "feature",
        (nxt - v).alias("width"),
        F.abs(f - gap).alias("gap"),
        F.greatest(F.lit(0.0), least - gap, gap - most).alias("gap_low"),
        F.greatest(F.abs(least - gap), F.abs(most - gap)).alias("gap_high"),
    )
    area = lambda c: F.coalesce(F.sum(F.col("width") * F.col(c)), F.lit(0.0))
    return bounds.groupBy("feature").agg(
        area("gap").alias("wasserstein"),
        area("gap_low").alias("wasserstein_low"),
        area("gap_high").alias("wasserstein_high"),
        F.max("gap").alias("ks"),
        F.max("gap_low").alias("ks_low"),
        F.max("gap_high").alias("ks_high"),
    )


def column_drift(
    summary: DataFrame,
    current: DataFrame,
    columns: Sequence[str] = S.DRIFT_FEATURES,
    threshold: float = S.DRIFT_THRESHOLD,
    ranges: int | None = None,
) -> DataFrame:
    """As the exact drift, by the reference's deviation, plus ``score_low, score_high`` and
    ``certain``: whether the exact score is on the same side of the threshold."""
    scale = summary.select("feature", F.greatest(F.col("std"), F.lit(0.001)).alias("_scale"))
    # One row per feature on both sides.
    joined = distances(summary, current, columns, ranges).join(F.broadcast(scale), "feature")
    score = {p: N.ratio(F.col(f"wasserstein{p}"), F.col("_scale")) for p in ("", "_low", "_high")}
    drifted = F.coalesce(score[""] > threshold, F.lit(False))
    return joined.select(
        "feature",
        F.col("wasserstein").alias("distance"),
        score[""].alias("score"),
        F.lit(threshold).alias("threshold"),
        drifted.cast("int").alias("drifted"),
        score["_low"].alias("score_low"),
        score["_high"].alias("score_high"),
        F.coalesce((score["_low"] > threshold) | (score["_high"] <= threshold), F.lit(True)).alias("certain"),
    )


def drift_report(
    summary: DataFrame,
    tail: DataFrame,
    reference_fare_mean: Column | None = None,
    log_rows: Column | None = None,
    min_rows: int = S.MIN_LOG_ROWS,
    prediction: str = "prediction",
) -> DataFrame:
    """The report on the newest log rows against a stored summary: reads the tail and the summary,
    both of bounded size."""
    known = [f for f in S.DRIFT_FEATURES if f in tail.columns]
    own = summary.where(F.col("feature").isin(known))
    drift = column_drift(own, tail, known, ranges=1).select("feature", "distance", "score", "threshold", "drifted")
    now = moments(tail, known).select("feature", F.col("mean").alias("current_mean"))
    # One row per feature on both sides.
    means = own.select("feature", F.col("mean").alias("reference_mean")).join(F.broadcast(now), "feature")
    shown = [f for f in S.HISTOGRAM_FEATURES if f in known]
    limits = united_range(own.select("feature", "low", "high", "n"), bounds(tail, shown)).where(F.col("feature").isin(shown))
    one, none = F.col("n"), F.lit(0).cast("bigint")
    both = weighted_values(own).select("feature", "value", one.alias("n_ref"), none.alias("n_cur")).unionByName(
        DI.distinct_counts(tail, shown).select("feature", "value", none.alias("n_ref"), one.alias("n_cur"))
    )
    bars = histogram_of_counts(both, limits)
    return DR.report_of(drift, means, bars, tail, reference_fare_mean, log_rows, min_rows, prediction)
