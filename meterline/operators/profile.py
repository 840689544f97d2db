"""Data profiling: one wide aggregate per table, then a turn to long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterline import schemas as S
from meterline.functions import numeric as N
from meterline.operators import distribution as DI
from meterline.operators.cleaning import numeric_columns


def rows_of(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn one row into many: one per struct."""
    return df.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, count, mean, std, min, max``; std is the sample one."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
            ).alias(c)
        )
    return rows_of(df.agg(*aggs), [F.col(c) for c in columns])


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False
) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max of every numeric column."""
    columns = list(columns or numeric_columns(df))
    quarts = DI.quantiles(df, columns, [0.25, 0.5, 0.75], approx=approx)
    # Both sides have one row per column.
    return moments(df, columns).join(F.broadcast(quarts), "feature", "left").select(
        "feature",
        "count",
        "mean",
        "std",
        "min",
        F.col("q")[0].alias("p25"),
        F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"),
        "max",
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percent per column, most nulls first."""
    total = F.count(F.lit(1)).alias("_n")
    counts = df.agg(total, *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return rows_of(
        counts,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).alias("missing"),
                N.round_cents(N.percent(F.col(c), F.col("_n"))).alias("missing_pct"),
            )
            for c in df.columns
        ],
    ).orderBy(F.desc("missing"), "column")


def rows_with_nulls(df: DataFrame) -> DataFrame:
    any_null = F.size(F.array_compact(F.array(*[F.when(F.col(c).isNull(), 1) for c in df.columns])))
    return df.agg(F.count_if(any_null > 0).alias("rows_with_nulls"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percent of all rows per non-null value."""
    n = df.select(F.count(F.lit(1))).scalar()
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("pct", N.percent(F.col("count"), n))
    )


def group_mean(df: DataFrame, key: str, value: str = S.TARGET) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(f"mean_{value}"))


def pivot_count(
    df: DataFrame, row: str, column: str, values: Sequence[int], counted: str = S.TARGET
) -> DataFrame:
    """Count matrix with the column values given, so no job looks for them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(counted)).na.fill(0)


def shape_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, mode (smallest on a tie), sample skewness and excess kurtosis."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(v).cast("double").alias("n"),
                F.skewness(v).alias("g1"),
                F.kurtosis(v).alias("g2"),
            ).alias(c)
        )
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    # Spark's moments are the population ones; these are the sample corrections.
    skew = N.ratio(g1 * F.sqrt(n * (n - 1)), n - 2)
    kurt = N.ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    shape = rows_of(df.agg(*aggs), [F.col(c) for c in columns]).select(
        "feature", skew.alias("skewness"), kurt.alias("kurtosis")
    )
    modes = DI.distinct_counts(df, columns).groupBy("feature").agg(
        F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("mode")
    )
    medians = DI.exact_quantiles(df, columns, [0.5]).select(
        "feature", F.col("q")[0].alias("median")
    )
    # One row per column in all three tables.
    return shape.join(F.broadcast(modes), "feature").join(F.broadcast(medians), "feature")


def iqr_outliers(df: DataFrame, columns: Sequence[str] = (S.TARGET,)) -> DataFrame:
    """Quartile fences and what lies outside them, per column."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    ends = F.struct(
        q1.alias("q1"),
        q3.alias("q3"),
        (q3 - q1).alias("iqr"),
        (q1 - 1.5 * (q3 - q1)).alias("lower"),
        (q3 + 1.5 * (q3 - q1)).alias("upper"),
    )
    # One row with the fences of every column, known before the rows are read.
    fences = (
        DI.exact_quantiles(df, columns, [0.25, 0.75])
        .agg(F.struct(*[F.max(F.when(F.col("feature") == c, ends)).alias(c) for c in columns]))
        .scalar()
    )

    def counted(c: str) -> Column:
        v, fence = F.col(c).cast("double"), F.col("_fences")[c]
        outside = F.count_if((v < fence["lower"]) | (v > fence["upper"]))
        return F.struct(
            F.lit(c).alias("feature"),
            F.first(fence).alias("fence"),
            outside.alias("outliers"),
            N.percent(outside, F.count(v)).alias("outlier_pct"),
            F.count_if(v < 0).alias("negative"),
            F.count_if(v == 0).alias("zero"),
            F.count_if(v > 100).alias("over_100"),
            F.count_if(v > 500).alias("over_500"),
        ).alias(c)

    wide = df.select(*columns, fences.alias("_fences")).agg(*[counted(c) for c in columns])
    # A column without a value has no fences and no row.
    return rows_of(wide, [F.col(c) for c in columns]).where(F.col("fence").isNotNull()).select(
        "feature", "fence.*", "outliers", "outlier_pct", "negative", "zero", "over_100", "over_500"
    )


def condition_counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """``issue, count, total`` for named conditions, in one pass."""
    total = F.count(F.lit(1)).alias("_n")
    wide = df.agg(total, *[F.count_if(cond).alias(name) for name, cond in conditions.items()])
    return rows_of(
        wide,
        [
            F.struct(
                F.lit(name).alias("issue"), F.col(f"`{name}`").alias("count"), F.col("_n").alias("total")
            )
            for name in conditions
        ],
    )


def anomaly_counts(df: DataFrame) -> DataFrame:
    return condition_counts(df, {k: F.expr(c) for k, c in S.ANOMALIES.items()}).select("issue", "count")


def quality_report(df: DataFrame) -> DataFrame:
    """Eight issues with count, percent and status."""
    pct = N.percent(F.col("count"), F.col("total"))
    return condition_counts(df, {k: F.expr(c) for k, c in S.QUALITY_ISSUES.items()}).select(
        "issue", "count", F.round(pct, 6).alias("pct"), N.quality_status(pct).alias("status"), "total"
    )


def corr_matrix(df: DataFrame, columns: Sequence[str] = S.CORRELATION_COLUMNS) -> DataFrame:
    """Pearson r of every ordered pair, as ``a, b, r``; rows with a null in any
    of the columns are left out.

    One pass: products are summed around the means of some rows, which is near enough for the sums
    not to cancel. One row of 8 + 36 sums instead of 28 correlation states keeps the aggregate
    inside generated code.
    """
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop("any")
    origin = data.limit(1000).select(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    centred = data.select(*[(F.col(c) - origin.getField(c)).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = centred.agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.sum(F.col(a) * F.col(b)).alias(f"p_{columns.index(a)}_{columns.index(b)}") for a, b in pairs],
    )
    n = F.col("_n")

    def co(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.col(f"p_{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / n

    rows = []
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            r = F.lit(1.0) if i == j else N.ratio(co(i, j), F.sqrt(co(i, i)) * F.sqrt(co(j, j)))
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
    return rows_of(sums, rows)


def corr_with(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``feature, r`` against one column, in one pass."""
    wide = df.agg(
        *[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in features]
    )
    return rows_of(
        wide, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in features]
    )


def corr_with_target(
    df: DataFrame, columns: Sequence[str] = S.CORRELATION_COLUMNS, target: str = S.TARGET
) -> DataFrame:
    complete = df.select(*columns).na.drop("any")
    return corr_with(complete, [c for c in columns if c != target], target).orderBy(F.desc("r"))


# --- histograms -------------------------------------------------------------------


def bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, low, high, n`` per column."""
    return moments(df, columns).select(
        "feature", F.col("min").alias("low"), F.col("max").alias("high"), F.col("count").alias("n")
    )


def _bin_counts(df: DataFrame, columns: Sequence[str], limits: DataFrame, bins: int) -> DataFrame:
    index = N.equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins)
    return (
        DI.long_values(df, columns)
        .join(F.broadcast(limits), "feature")
        .groupBy("feature", index.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _all_bins(limits: DataFrame, bins: int) -> DataFrame:
    low, high, b = F.col("low"), F.col("high"), F.col("bin")
    return limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumns(
        {"lo": N.bin_edge(low, high, bins, b), "hi": N.bin_edge(low, high, bins, b + 1)}
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """``feature, bin, lo, hi, count, density`` with empty bins included."""
    limits = bounds(df, columns)
    counts = _bin_counts(df, columns, limits, bins)
    c = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    # Columns x bins rows on both sides.
    return (
        _all_bins(limits, bins)
        .join(F.broadcast(counts), ["feature", "bin"], "left")
        .select(
            "feature",
            "bin",
            "lo",
            "hi",
            c.alias("count"),
            N.ratio(c.cast("double"), F.col("n") * (F.col("hi") - F.col("lo"))).alias("density"),
        )
    )


def histogram_pair(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str] = S.HISTOGRAM_FEATURES,
    bins: int = 10,
) -> DataFrame:
    """Shared bins over both samples, each side in percent of its own rows."""
    from meterline.operators.sets import combined_range

    one, none = F.lit(1), F.lit(0)
    both = DI.long_values(reference, columns).select("*", one.alias("n_ref"), none.alias("n_cur")).unionByName(
        DI.long_values(current, columns).select("*", none.alias("n_ref"), one.alias("n_cur"))
    )
    return histogram_of_counts(both, combined_range(reference, current, columns), bins)


def histogram_of_counts(both: DataFrame, limits: DataFrame, bins: int = 10) -> DataFrame:
    """The same from ``feature, value, n_ref, n_cur`` and the features' united ranges."""
    index = N.equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins)
    counts = (
        both.join(F.broadcast(limits), "feature")
        .groupBy("feature", index.alias("bin"))
        .agg(F.sum("n_ref").alias("_r"), F.sum("n_cur").alias("_c"))
    )

    def pct(count: str, total: str) -> Column:
        return F.coalesce(N.percent(F.col(count), F.col(total)), F.lit(0.0))

    # Columns x bins rows on both sides.
    return (
        _all_bins(limits, bins)
        .join(F.broadcast(counts), ["feature", "bin"], "left")
        .select(
            "feature",
            "bin",
            N.bin_label(F.col("lo"), F.col("hi")).alias("label"),
            pct("_r", "n_reference").alias("reference_pct"),
            pct("_c", "n_current").alias("current_pct"),
        )
    )


def reference_stats(
    df: DataFrame, columns: Sequence[str] = S.STATS_FEATURES, bins: int = 10
) -> DataFrame:
    """One row per feature: mean, std, min, max, density histogram and edges."""
    present = [c for c in columns if c in df.columns]
    ordered = F.sort_array(F.collect_list(F.struct("bin", "lo", "hi", "density")))
    bars = histogram(df, present, bins).groupBy("feature").agg(ordered.alias("b"))
    b = F.col("b")
    return (
        moments(df, present)
        .join(F.broadcast(bars), "feature")
        .select(
            "feature",
            "mean",
            "std",
            F.transform(b, lambda x: x["density"]).alias("hist"),
            F.array_append(
                F.transform(b, lambda x: x["lo"]), F.element_at(b, -1)["hi"]
            ).alias("bin_edges"),
            "min",
            "max",
        )
    )


# --- small reports ------------------------------------------------------------------


def range_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return moments(df, columns).select("feature", "min", "max")


def network_speed(df: DataFrame) -> DataFrame:
    """Mean speed over all trips."""
    return df.agg(
        F.avg("avg_speed_mph").alias("mean_speed_mph"), F.count("avg_speed_mph").alias("trips")
    )


def trips_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("pickup_year", "pickup_month").agg(F.count(F.lit(1)).alias("trips"))
