"""Exact order statistics without a global sort or a single-task window.

Every operator here works on *counts of distinct values*: duplicates collapse
in the map-side partial aggregate, so one value that holds a third of all rows
costs one row afterwards. The distinct values are then spread over value
ranges cut at a uniform sample of themselves, which keeps the ranges even
however the values are distributed; windows run inside one range, and a small
table of range totals (groups x ranges rows) carries the offsets across them.

The range cuts are picked by hash, not by a sketch, so every evaluation of the
plan - a second branch, a retried task - finds the same ranges.

Quantiles need few of the values: a quantile sketch of bounded size first gives two
values around every wanted rank. Only values between them stay themselves; all
others become one value per gap, which keeps the order and the counts, so that the
ranks stay exact and the shuffle carries a small share of the values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline.sources.staging import stage

#: Value ranges, at least; a session with more shuffle partitions has as many ranges.
RANGES = 256


#: Size of the sketch that brackets quantiles; its relative rank error is about one over
#: `SKETCH_ACCURACY` (99 % confidence).
SKETCH_SIZE = 65_535
SKETCH_ACCURACY = 10_000
#: Rank shares on either side of a quantile that its bracket spans: three sketch errors.
BRACKET_MARGIN = 3.0 / SKETCH_ACCURACY


def default_ranges(df: DataFrame) -> int:
    """The number of ranges follows the session; results don't depend on it."""
    return max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def long_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., feature, value`` with one row per non-null number."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot(list(by), list(columns), "feature", "value")
    return long.where(F.col("value").isNotNull())


def distinct_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., feature, value, n``."""
    return (
        long_values(df, columns, by)
        .groupBy(*by, "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_ranges(
    counts: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    ranges: int | None = None,
    weights: Sequence[str] = ("n",),
) -> DataFrame:
    """Add ``_range``: the number of sampled cuts below the value."""
    ranges = ranges or default_ranges(counts)
    stride = max(2, isqrt(ranges))
    v = F.col(value)
    # Always true, but it keeps the weights in this branch, so that it reads
    # the same shuffle as the other one and the data are scanned once.
    counted = reduce(lambda a, b: a + b, [F.col(w) for w in weights]) > 0
    sample = (
        counts.where(counted).groupBy(*keys, F.pmod(F.xxhash64(v), F.lit(ranges - 1)).alias("_slot"))
        .agg(F.min_by(v, F.xxhash64(v, F.lit(1))).alias("_cut"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
        .withColumn("_coarse", F.filter("_cuts", lambda x, i: i % stride == stride - 1))
    )
    full = F.size(F.filter("_coarse", lambda x: x < v))
    part = F.slice(F.col("_cuts"), full * stride + 1, F.lit(stride))
    # The sample has one row per group and at most `ranges` cuts in it.
    return (
        counts.join(F.broadcast(sample), list(keys))
        .withColumn("_range", full * stride + F.size(F.filter(part, lambda x: x < v)))
        .drop("_cuts", "_coarse")
    )


def range_offsets(
    ranged: DataFrame,
    keys: Sequence[str],
    weights: Sequence[str],
    value: str = "value",
    ahead: bool = False,
) -> DataFrame:
    """Per range: for each weight ``{w}_start`` (sum before the range),
    ``{w}_here`` and ``{w}_total``; ``_next_min``, the least value after it. With ``ahead`` also
    ``{w}_next``, the weight of that value, and ``_origin``, the least value of all."""
    first = [F.min_by(w, value).alias(f"{w}_first") for w in weights] if ahead else []
    totals = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(w).alias(f"{w}_here") for w in weights], F.min(value).alias("_min"), *first
    )
    # At most `ranges` rows per group reach these windows.
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("_range")
    out = {"_next_min": F.lead("_min").over(ordered)}
    for w in weights:
        here = F.col(f"{w}_here")
        running = F.sum(here).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        out[f"{w}_start"] = running - here
        out[f"{w}_total"] = F.sum(here).over(whole)
        if ahead:
            out[f"{w}_next"] = F.lead(f"{w}_first").over(ordered)
    if ahead:
        out["_origin"] = F.min("_min").over(whole)
    return totals.withColumns(out).drop("_min", *[f"{w}_first" for w in weights])


def brackets(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """``by..., _edges``: for each column and probability a low and a high value that the
    wanted ranks lie between, from one wide aggregate of quantile sketches.

    Ranks next to a quantile are at most two away from its share of the rows. A bracket is three
    sketch errors wide on either side, which holds both the sketch's error and those two ranks
    from 10,000 values on; the brackets of smaller groups are open, so that all values stay, and
    so are those of a column with NaN, which a sketch leaves out.
    """
    shares = [min(1.0, max(0.0, p + m)) for p in probs for m in (-BRACKET_MARGIN, BRACKET_MARGIN)]
    open_ends = [float("-inf"), float("nan")]  # NaN is above all numbers
    is_open = [not 0.0 < share < 1.0 for share in shares]

    def edges(c: str) -> Column:
        v = F.col(c).cast("double")
        sketch = F.kll_sketch_agg_double(v, SKETCH_SIZE)
        wide = (F.count(v) >= SKETCH_ACCURACY) & (F.kll_sketch_get_n_double(sketch) == F.count(v))
        found = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(x) for x in shares]))
        ends = [F.lit(open_ends[k % 2]) for k in range(len(shares))]
        some = [ends[k] if is_open[k] else F.get(found, F.lit(k)) for k in range(len(shares))]
        return F.when(wide, F.array(*some)).otherwise(F.array(*ends))

    return df.groupBy(*by).agg(F.array(*[edges(c) for c in columns]).alias("_edges"))


def bracketed_counts(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """``by..., column, prob, value, n`` of the values inside the brackets, and a row per group
    with column -1 and ``totals``: for each column its values, then those below each bracket.

    Only values inside a bracket become rows; all others are counted where they lie.
    """
    wide = df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    edges = brackets(df, columns, probs, by)
    # One row of edges per group.
    held = wide.join(F.broadcast(edges), list(by)) if by else wide.withColumn("_edges", edges.scalar())
    values = [F.col(f"_v{i}") for i in range(len(columns))]
    low = [[F.get(F.get("_edges", F.lit(i)), F.lit(2 * k)) for k in range(len(probs))] for i in range(len(columns))]
    high = [[F.get(F.get("_edges", F.lit(i)), F.lit(2 * k + 1)) for k in range(len(probs))] for i in range(len(columns))]

    def item(i: int, k: int, value: Column) -> Column:
        return F.struct(F.lit(i).alias("column"), F.lit(k).alias("prob"), value.alias("value"))

    inside = [
        F.when((v >= low[i][k]) & (v <= high[i][k]), item(i, k, v)) for i, v in enumerate(values) for k in range(len(probs))
    ]
    whole_row = item(-1, -1, F.lit(None).cast("double"))
    rows = held.withColumn("_item", F.explode(F.array_compact(F.array(whole_row, *inside))))
    is_row = F.col("_item.column") < 0
    totals = [
        F.count_if(is_row & t)
        for i, v in enumerate(values)
        for t in (v.isNotNull(), *[v < low[i][k] for k in range(len(probs))])
    ]
    return rows.groupBy(*by, "_item").agg(F.count(F.lit(1)).alias("n"), F.array(*totals).alias("totals")).select(
        *by, "_item.*", "n", "totals"
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    ranges: int | None = None,
    packed_by: Sequence[str] = (),
    many: bool = False,
) -> DataFrame:
    """``by..., feature, n, q`` with linearly interpolated quantiles in ``q``.

    ``by`` is for few groups (splits, segments); ``many=True`` for any number of them. The table is read twice: for the brackets of the
    wanted ranks, and for the counts of the values inside them. A rank outside its bracket,
    against the sketch's bound, is an error, never a wrong number; ``many=True`` has no brackets. ``ranges=1`` is for groups
    known to have few distinct values: one task then holds those of a whole group.
    """
    if by:
        # A struct is never null itself, so a null group stays a group and the
        # joins below add no null tests that would tell the branches apart.
        packed = df.select(F.struct(*by).alias("_group"), *columns)
        return exact_quantiles(packed, columns, probs, (), ranges, ("_group",), many).select(
            "_group.*", "feature", "n", "q"
        )
    if ranges == 1:
        counts = distinct_counts(df, columns, packed_by)
        return counts.groupBy(*packed_by, "feature").agg(
            F.sum("n").alias("n"),
            F.percentile("value", F.array(*[F.lit(float(p)) for p in probs]), F.col("n")).alias("q"),
        )
    if many:
        return _grouped_quantiles(df, columns, probs, packed_by)
    counts = bracketed_counts(df, columns, probs, packed_by)
    keys = [*packed_by, "column", "prob"]
    # Told apart by the sums, not by the key, and with the count kept, so that both branches read
    # the same shuffle.
    most = F.array_max("totals")
    ranged = with_ranges(counts.where(most == 0), keys, ranges=ranges)
    width = len(probs) + 1
    wanted = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("prob") + 1)
    each = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(len(columns) - 1)),
                lambda i: F.transform(
                    F.sequence(F.lit(0), F.lit(len(probs) - 1)),
                    lambda k: F.struct(
                        i.alias("column"),
                        k.alias("prob"),
                        F.get("totals", i * width).alias("n_all"),
                        F.get("totals", i * width + k + 1).alias("below"),
                    ),
                ),
            )
        )
    )
    # Groups x columns x probabilities rows.
    sizes = counts.where((most > 0) & (F.col("n") > 0)).select(*packed_by, each.alias("_t")).select(*packed_by, "_t.*")
    position = wanted * (F.col("n_all") - 1)
    ranks = F.array_distinct(F.array(*[f(position).cast("bigint") - F.col("below") for f in (F.floor, F.ceil)]))
    offsets = range_offsets(ranged, keys, ["n"]).join(F.broadcast(sizes), keys)
    # At most two ranges per quantile and group.
    targets = (
        offsets.withColumn(
            "_ranks",
            F.filter(ranks, lambda r: (r >= F.col("n_start")) & (r < F.col("n_start") + F.col("n_here"))),
        )
        .where(F.size("_ranks") > 0)
        .select(*keys, "_range", "n_start", "_ranks")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("value")
    upto = F.col("n_start") + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    hits = (
        ranged.join(F.broadcast(targets), [*keys, "_range"])
        .withColumn("_upto", upto)
        .withColumn(
            "_rank",
            F.explode(
                F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("n")))
            ),
        )
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_at"))
    )
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column") + 1)

    def at(f) -> Column:
        found = F.try_element_at("_at", f(position).cast("bigint") - F.col("below"))
        return F.coalesce(found, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

    one = at(F.floor) + (at(F.ceil) - at(F.floor)) * (position - F.floor(position))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("prob", one.alias("q")))), lambda x: x["q"])
    return (
        sizes.where("n_all > 0")
        .join(hits, keys, "left")
        .groupBy(*packed_by, name.alias("feature"))
        .agg(F.first("n_all").alias("n"), ordered.alias("q"))
    )


def _grouped_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]
) -> DataFrame:
    """Quantiles of any number of groups by secondary sort: the distinct values of all groups are
    sorted by range over the tasks, so that small groups lie together and a large one is spread.
    Nothing is broadcast; what the sums need per group is joined by group."""
    keys = [*by, "feature"]
    counts = distinct_counts(df, columns, by)
    # Written, so that every branch finds the rows in the same tasks.
    ranged = stage(
        counts.repartitionByRange(*keys, "value").withColumn("_range", F.spark_partition_id()), "grouped-values"
    )
    # Groups + tasks rows.
    offsets = range_offsets(ranged, keys, ["n"]).select(*keys, "_range", "n_start", "n_total")
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(offsets, [*keys, "_range"]).withColumn("_upto", F.col("n_start") + F.sum("n").over(inside))
    position = [F.lit(float(p)) * (F.col("n_total") - 1) for p in probs]
    before = F.col("_upto") - F.col("n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_upto")) & (rank >= before), F.col("value")))

    def quantile(h: Column) -> Column:
        low, high = value_at(F.floor(h)), value_at(F.ceil(h))
        return low + (high - low) * F.max(h - F.floor(h))

    return placed.groupBy(*keys).agg(F.max("n_total").alias("n"), F.array(*[quantile(h) for h in position]).alias("q"))


def approx_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Same shape as :func:`exact_quantiles`, from a bounded sketch."""
    return (
        long_values(df, columns, by)
        .groupBy(*by, "feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx("value", [float(p) for p in probs], accuracy).alias("q"),
        )
    )


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    approx: bool = False,
    many: bool = False,
) -> DataFrame:
    if approx:
        return approx_quantiles(df, columns, probs, by)
    return exact_quantiles(df, columns, probs, by, many=many)


def ranked_classes(classes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """0-based position of every distinct value inside its group."""
    ranged = with_ranges(classes.withColumn("n", F.lit(1)), keys, value)
    offsets = range_offsets(ranged, keys, ["n"], value).select(*keys, "_range", "n_start")
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    return ranged.join(F.broadcast(offsets), [*keys, "_range"]).select(
        *keys,
        value,
        (F.col("n_start") + F.row_number().over(inside) - 1).cast("bigint").alias("code"),
    )


# --- two samples ----------------------------------------------------------------


def paired_counts(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, value, n_ref, n_cur`` on the merged support."""
    tagged = long_values(reference, columns).select(
        "feature", "value", F.lit(1).alias("r"), F.lit(0).alias("c")
    ).unionByName(
        long_values(current, columns).select(
            "feature", "value", F.lit(0).alias("r"), F.lit(1).alias("c")
        )
    )
    return tagged.groupBy("feature", "value").agg(
        F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur")
    )


def ecdf(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """``feature, value, next_value, f_ref, f_cur``: both empirical CDFs at
    every value of the merged support.

    ``ranges=1`` is for samples of bounded size: one task per feature.
    """
    return cdf_of_counts(paired_counts(reference, current, columns), ranges).select(
        "feature", "value", "next_value", "f_ref", "f_cur"
    )


def cdf_of_counts(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """``feature, value, next_value, n_ref, n_cur, f_ref, f_cur, next_f_ref, origin`` of merged
    counts; ``origin`` is the feature's least value, ``next_f_ref`` the reference's share at the
    next value."""
    weights = ["n_ref", "n_cur"]
    if ranges == 1:
        whole = Window.partitionBy("feature")
        order = whole.orderBy("value")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        ranged = counts.select(
            "*",
            F.min("value").over(whole).alias("_origin"),
            F.lit(None).cast("double").alias("_next_min"),
            F.lit(None).cast("bigint").alias("n_ref_next"),
            *[F.lit(0).alias(f"{w}_start") for w in weights],
            *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
        )
    else:
        spread = with_ranges(counts, ["feature"], ranges=ranges, weights=weights)
        offsets = range_offsets(spread, ["feature"], weights, ahead=True)
        offsets = offsets.drop("n_ref_here", "n_cur_here", "n_cur_next")
        # One offset row per feature and range.
        ranged = spread.join(F.broadcast(offsets), ["feature", "_range"])
        order = Window.partitionBy("feature", "_range").orderBy("value")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)

    def share(w: str, more: Column | int = 0) -> Column:
        cumulated = F.col(f"{w}_start") + F.sum(w).over(upto) + more
        return F.try_divide(cumulated.cast("double"), F.col(f"{w}_total").cast("double"))

    return ranged.select(
        "feature",
        "value",
        F.coalesce(F.lead("value").over(order), F.col("_next_min")).alias("next_value"),
        *weights,
        share("n_ref").alias("f_ref"),
        share("n_cur").alias("f_cur"),
        share("n_ref", F.coalesce(F.lead("n_ref").over(order), F.col("n_ref_next"), F.lit(0))).alias("next_f_ref"),
        F.col("_origin").alias("origin"),
    )


def distances(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """``feature, wasserstein, ks, ref_std, low, high``: the reference's deviation and the range of
    both come from the same counts, so that each table is read once."""
    counts = cdf_of_counts(paired_counts(reference, current, columns), ranges)
    gap = F.abs(F.col("f_ref") - F.col("f_cur"))
    width = F.col("next_value") - F.col("value")
    n, moved = F.col("n_ref"), F.col("value") - F.col("origin")
    sums = counts.groupBy("feature").agg(
        F.coalesce(F.sum(width * gap), F.lit(0.0)).alias("wasserstein"),
        F.max(gap).alias("ks"),
        F.sum(n).alias("_n"),
        F.sum(n * moved).alias("_s1"),
        F.sum(n * moved * moved).alias("_s2"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    spread = F.col("_s2") - F.try_divide(F.col("_s1") * F.col("_s1"), F.col("_n"))
    std = F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), F.col("_n") - 1))
    return sums.select("feature", "wasserstein", "ks", std.alias("ref_std"), "low", "high")


def ks_pvalue(statistic: Column, n_ref: Column, n_cur: Column, terms: int = 100) -> Column:
    """Two-sample p-value from the asymptotic Kolmogorov series."""
    n1, n2 = n_ref.cast("double"), n_cur.cast("double")
    t2 = statistic * statistic * F.try_divide(n1 * n2, n1 + n2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        * F.exp(F.lit(-2.0) * k * k * t2),
    )
    # The series does not converge near zero, where the p-value is 1.
    p = F.when(t2 < 0.04, F.lit(1.0)).otherwise(series)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def jensen_shannon(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, js_distance`` between the category frequencies (base 2)."""

    def as_text(df: DataFrame, r: int, c: int) -> DataFrame:
        wide = df.select(*[F.col(x).cast("string").alias(x) for x in columns])
        return (
            wide.unpivot([], list(columns), "feature", "value")
            .where(F.col("value").isNotNull())
            .select("feature", "value", F.lit(r).alias("r"), F.lit(c).alias("c"))
        )

    counts = (
        as_text(reference, 1, 0)
        .unionByName(as_text(current, 0, 1))
        .groupBy("feature", "value")
        .agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    )
    totals = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur")
    )
    p = F.try_divide(F.col("n_ref").cast("double"), F.col("t_ref").cast("double"))
    q = F.try_divide(F.col("n_cur").cast("double"), F.col("t_cur").cast("double"))
    mid = (p + q) / 2.0

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mid)).otherwise(F.lit(0.0))

    # One row of totals per feature.
    return (
        counts.join(F.broadcast(totals), "feature")
        .groupBy("feature")
        .agg((F.sum(part(p) + part(q)) / 2.0).alias("_d"))
        .select("feature", F.sqrt(F.greatest(F.col("_d"), F.lit(0.0))).alias("js_distance"))
    )
