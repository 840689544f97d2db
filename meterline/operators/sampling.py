"""Repeatable samples and splits, keyed on a hash of the row's own key.

Neither depends on how the rows are partitioned, so reruns and retried tasks
agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from meterline import schemas as S
from meterline.functions import numeric as N
from meterline.operators import distribution as DI
from meterline.operators.cleaning import select_available
from meterline.operators.profile import moments

def hex_bucket(hex_text: Column, digits: int, buckets: int) -> Column:
    """Bucket number from the leading digits of a hexadecimal hash."""
    number = F.conv(F.substring(hex_text, 1, digits), 16, 10).cast("bigint")
    return (number % buckets).cast("int")


def sample_hash(key: str, seed: int = S.SAMPLE_SEED) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def sample_n(
    df: DataFrame, n: int, key: str = "trip_id", seed: int = S.SAMPLE_SEED, unique: bool = False
) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement: those with the least
    key hash. Lazy: nothing runs before the sample is used.

    See `sample_by`, of which this is the case of one group.
    """
    grouped = df.withColumn("_group", F.lit(0))
    return sample_by(grouped, "_group", {0: n}, key, seed, unique).drop("_group")


def sample_by(
    df: DataFrame,
    group: str,
    sizes: Mapping[Any, int],
    key: str = "trip_id",
    seed: int = S.SAMPLE_SEED,
    unique: bool = False,
) -> DataFrame:
    """For each group in ``sizes`` exactly so many rows, or all it has: those with the least key
    hash. Other groups give no rows.

    A count per hash cell (65,536 cells a group, one pass for all groups) finds the cell where the
    last row lies; the keys of that one cell say how it ends. Rows up to there are taken as they
    stand, wherever they are: no task gathers the sample, and keys alone are read before. ``unique``
    says that a key names one row, and saves a scan; without it the rows that share the last key
    are numbered by the hash of their columns.
    """
    order = sample_hash(key, seed)
    cell = F.conv(F.substring(order, 1, 4), 16, 10).cast("int")
    kind = df.schema[group].dataType
    wanted = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, n)])
    keys = df.where(F.col(group).isin(list(sizes))).select(
        F.col(group).alias("_g"), F.col(key).alias("_k"), order.alias("_h"), cell.alias("_cell")
    )
    counts = keys.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("rows"))
    by_group = Window.partitionBy("_g")
    upto = by_group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    # At most 65,536 rows a group reach the window; one row a group is left.
    edges = (
        counts.withColumn("_upto", F.sum("rows").over(upto))
        .withColumn("_n", F.try_element_at(wanted, F.col("_g").cast(kind)))
        .where((F.col("_upto") >= F.col("_n")) & (F.col("_upto") - F.col("rows") < F.col("_n")))
        .select("_g", "_cell", (F.col("_n") - F.col("_upto") + F.col("rows")).alias("_rest"))
    )
    place = F.row_number().over(by_group.orderBy("_h", "_k"))
    last = (
        keys.join(F.broadcast(edges), ["_g", "_cell"])
        .withColumn("_place", place)
        .where(F.col("_place") == F.col("_rest"))
        .select(F.col("_g"), F.col("_h").alias("_last_h"), F.col("_k").alias("_last_k"))
    )
    # Groups that have no more rows than wanted have no last row. One row a group on either side.
    some = [F.lit(g) for g, n in sizes.items() if n > 0]
    ends = df.sparkSession.range(1).select(F.explode(F.array(*some).cast(T.ArrayType(kind))).alias("_g"))
    ends = ends.join(F.broadcast(last), "_g", "left")
    rows = df.withColumn("_h", order).join(F.broadcast(ends), F.col(group) == F.col("_g"))
    below = F.col("_last_h").isNull() | (F.col("_h") < F.col("_last_h"))
    tied = (F.col("_h") == F.col("_last_h")) & F.col(key).eqNullSafe(F.col("_last_k"))
    before = below | ((F.col("_h") == F.col("_last_h")) & (F.col(key) < F.col("_last_k")))
    if unique:
        return rows.where(before | tied).select(*df.columns)
    taken = rows.where(before).groupBy("_g").agg(F.count(F.lit(1)).alias("_taken"))
    number = F.row_number().over(by_group.orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    rest = (
        rows.where(tied)
        .join(F.broadcast(taken), "_g", "left")
        .withColumn("_number", number)
        .where(F.col("_number") <= max(sizes.values(), default=0))  # tasks hand on no more than that
        .where(F.col("_number") + F.coalesce(F.col("_taken"), F.lit(0)) <= F.try_element_at(wanted, F.col("_g").cast(kind)))
    )
    return rows.where(before).select(*df.columns).unionByName(rest.select(*df.columns))


def split_label(key_hash: Column, test_size: float = 0.2, val_size: float = 0.1) -> Column:
    """train / val / test from 100 buckets of a hexadecimal key hash."""
    test_from = round((1.0 - test_size) * 100)
    val_from = test_from - round(val_size * 100)
    # A lookup instead of a comparison chain: the hash is taken once per row.
    labels = F.array(
        *[F.lit("train" if b < val_from else "val" if b < test_from else "test") for b in range(100)]
    )
    return F.try_element_at(labels, hex_bucket(key_hash, 8, 100) + 1)


def split_data(
    df: DataFrame,
    test_size: float = 0.2,
    val_size: float = 0.1,
    key: str = "trip_id",
    hashed: bool = True,
    seed: int = S.SAMPLE_SEED,
) -> DataFrame:
    """Add ``split``. ``hashed`` says that the key is a hexadecimal hash
    already; otherwise it is hashed with the seed. A projection: no shuffle,
    and label and features never part."""
    h = F.col(key) if hashed else sample_hash(key, seed)
    return df.withColumn("split", split_label(h, test_size, val_size))


def sample_train_val(
    df: DataFrame, n: int, key: str = "trip_id", seed: int = S.SAMPLE_SEED
) -> DataFrame:
    """n training rows and n/4 validation rows, both from the same passes."""
    return sample_by(df, "split", {"train": n, "val": n // 4}, key, seed, unique=True)


def reference_sample(
    train: DataFrame,
    n: int = S.REFERENCE_SAMPLE_ROWS,
    features: Sequence[str] = S.DRIFT_FEATURES,
    key: str = "trip_id",
    seed: int = S.SAMPLE_SEED,
) -> DataFrame:
    narrow = select_available(train, [key, *features])
    return sample_n(narrow, n, key, seed, unique=True).drop(key)


def representativeness(
    full: DataFrame, sample: DataFrame, features: Sequence[str] = S.DRIFT_FEATURES
) -> DataFrame:
    """Per feature: difference of mean, deviation and median in percent, both
    ranges, the KS statistic and its p-value; plus the verdict on all.

    The whole table is compared, so nothing is subsampled for the test.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        med = DI.exact_quantiles(df, features, [0.5]).select("feature", F.col("q")[0].alias("median"))
        stats = moments(df, features).join(F.broadcast(med), "feature")
        return stats.select("feature", *[F.col(c).alias(f"{p}_{c}") for c in stats.columns[1:]])

    def diff_pct(stat: str) -> Column:
        a, b = F.col(f"full_{stat}"), F.col(f"sample_{stat}")
        return F.when(a != 0, F.abs(a - b) / a * 100.0).otherwise(F.lit(0.0))

    # One row per feature everywhere below.
    joined = (
        side(full, "full")
        .join(F.broadcast(side(sample, "sample")), "feature")
        .join(F.broadcast(DI.distances(full, sample, features)), "feature")
    )
    per_feature = joined.select(
        "feature",
        diff_pct("mean").alias("mean_diff_pct"),
        diff_pct("std").alias("std_diff_pct"),
        diff_pct("median").alias("median_diff_pct"),
        "full_min",
        "sample_min",
        "full_max",
        "sample_max",
        F.col("ks").alias("ks_stat"),
        DI.ks_pvalue(F.col("ks"), F.col("full_count"), F.col("sample_count")).alias("ks_pvalue"),
    )
    every = Window.partitionBy()
    same = F.count_if(F.col("ks_pvalue") > 0.05).over(every)
    ok = (F.avg("mean_diff_pct").over(every) < 5) & (
        N.ratio(same, F.count(F.lit(1)).over(every)) >= 0.75
    )
    return per_feature.withColumn("representative", ok.cast("int"))
