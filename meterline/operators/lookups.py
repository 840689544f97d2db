"""Dimension lookups. All are equi joins from the trip table to a smaller one.

No broadcast hint is given here: a scanned or staged table carries its true
size, so the optimizer broadcasts it below ``autoBroadcastJoinThreshold`` and
otherwise plans a sort-merge join, where ``skewed`` finds and splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterline import schemas as S
from meterline.functions.trip import as_string_key, zone_label
from meterline.operators.distribution import ranked_classes


#: Keys that a heavy-hitter sketch follows: none with a larger share than about one over this
#: is missed.
SKETCH_KEYS = 10_000


def hot_keys(facts: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """``_key, _copies``: hashes of the keys that hold more than half of an even share of the rows
    (one part of ``parts``), and into how many pieces, each an eighth of such a share, they are cut.

    From a heavy-hitter sketch of the key columns, one pass with one small row per task: at most
    2 x parts rows come out, whatever the number of keys.
    """
    key = F.xxhash64(*[F.col(c) for c in on]).alias("_key")
    most, followed = 2 * parts, max(SKETCH_KEYS, 20 * parts)
    top = F.expr(f"approx_top_k(_key, {most}, {followed})").alias("_top")
    sketched = facts.select(key).agg(top, F.count(F.lit(1)).alias("_rows"))
    each = sketched.select("_rows", F.explode("_top").alias("_t"))
    even = F.col("_rows") / parts
    return each.where(F.col("_t.count") > even / 2).select(
        F.col("_t.item").alias("_key"), F.ceil(F.col("_t.count") * 8 / even).cast("int").alias("_copies")
    )


def left_lookup(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    skewed: bool = False,
    row_key: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Left join. With ``skewed`` the hot keys of the facts are found by a sketch and cut into
    small pieces, and their rows of the table repeated as often; all other keys
    are joined as they are. For a table too large to broadcast under keys that hold much of the
    facts; it costs one more pass over the facts' key columns.

    Rows of a hot key are spread by a hash of ``row_key``, columns that tell rows apart (all
    columns, if none are given). ``parts``: the partitions to spread over, by default those of a
    shuffle.
    """
    if not skewed:
        return facts.join(table, list(on), "left")
    parts = parts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # At most 2 x parts rows.
    hot = F.broadcast(hot_keys(facts, on, parts))
    key = F.xxhash64(*[F.col(c) for c in on])
    row = F.xxhash64(F.lit(1), *[F.col(c) for c in row_key or facts.columns])
    # Rows of other keys have salt 0; like the hash, it is the same again when a task is retried.
    salt = F.coalesce(F.pmod(row, F.col("_copies")).cast("int"), F.lit(0))
    spread = facts.withColumn("_key", key).join(hot, "_key", "left").withColumn("_salt", salt).drop("_key", "_copies")
    last = F.coalesce(F.col("_copies"), F.lit(1)) - 1
    copies = (
        table.withColumn("_key", key)
        .join(hot, "_key", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_key", "_copies")
    )
    return spread.join(copies, [*on, "_salt"], "left").drop("_salt")


# --- routes -----------------------------------------------------------------------


def route_mean_distance(trips: DataFrame) -> DataFrame:
    """Mean distance and trip count per (pickup, dropoff); partial sums are
    taken before the shuffle, so a hot route costs no more than others."""
    return trips.groupBy("PULocationID", "DOLocationID").agg(
        F.avg("trip_distance").alias("avg_distance"), F.count(F.lit(1)).alias("trips")
    )


def lookup_route_distance(
    trips: DataFrame,
    routes: DataFrame,
    default: float = S.DEFAULT_ROUTE_MILES,
    skewed: bool = False,
    row_key: Sequence[str] = (),
) -> DataFrame:
    """Add ``route_distance`` (default for an unknown route) and ``has_data``."""
    keys = ["PULocationID", "DOLocationID"]
    found = left_lookup(trips, routes.select(*keys, "avg_distance"), keys, skewed, row_key)
    return found.withColumns(
        {
            "route_distance": F.coalesce("avg_distance", F.lit(default)),
            "has_data": F.coalesce(F.col("avg_distance") > 0, F.lit(False)),
        }
    ).drop("avg_distance")


def fill_distance(
    trips: DataFrame,
    routes: DataFrame,
    default: float = S.DEFAULT_ROUTE_MILES,
    skewed: bool = False,
    row_key: Sequence[str] = (),
) -> DataFrame:
    """Replace a distance that is not positive by the route's mean."""
    d = F.col("trip_distance")
    return (
        lookup_route_distance(trips, routes, default, skewed, row_key)
        .withColumn("trip_distance", F.when(d <= 0, F.col("route_distance")).otherwise(d))
        .drop("route_distance", "has_data")
    )


# --- zones ------------------------------------------------------------------------


def enrich_zones(
    trips: DataFrame, zones: DataFrame, skewed: bool = False, row_key: Sequence[str] = ()
) -> DataFrame:
    """Borough and zone of both ends."""
    out = trips
    for key, side in (("PULocationID", "pickup"), ("DOLocationID", "dropoff")):
        dim = zones.select(
            F.col("LocationID").alias(key),
            F.col("Borough").alias(f"{side}_borough"),
            F.col("Zone").alias(f"{side}_zone"),
        )
        out = left_lookup(out, dim, [key], skewed, row_key)
    return out


def zone_list(zones: DataFrame) -> DataFrame:
    """One row per zone with its label and the number of zones."""
    total = zones.select(F.count(F.lit(1))).scalar()
    return zones.select(
        F.col("Borough"),
        F.col("LocationID"),
        F.col("Zone"),
        zone_label(F.col("Zone"), F.col("Borough")).alias("label"),
        total.alias("total"),
    )


def zones_grouped(zones: DataFrame) -> DataFrame:
    """``Borough, zones`` with the zones of a borough nested in id order. A
    borough's list is bounded by the zone file, a few hundred rows."""
    item = F.struct(
        F.col("LocationID").alias("id"),
        F.col("Zone").alias("name"),
        zone_label(F.col("Zone"), F.col("Borough")).alias("label"),
    )
    return zones.groupBy("Borough").agg(F.sort_array(F.collect_list(item)).alias("zones"))


# --- label encoding -----------------------------------------------------------------


def encoder_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, class, code``: distinct values as text, coded in text order."""
    text = df.select(*[as_string_key(F.col(c)).alias(c) for c in columns])
    classes = (
        text.unpivot([], list(columns), "feature", "class")
        .where(F.col("class").isNotNull())
        .distinct()
    )
    return ranked_classes(classes, ["feature"], "class")


def encode_lookup(
    df: DataFrame,
    dictionary: DataFrame,
    columns: Sequence[str],
    skewed: bool = False,
    row_key: Sequence[str] = (),
) -> DataFrame:
    """Replace each column by its code; a class not in the dictionary gives -1."""
    out = df
    for c in columns:
        codes = dictionary.where(F.col("feature") == c).select(
            F.col("class").alias("_class"), F.col("code").alias("_code")
        )
        out = left_lookup(
            out.withColumn("_class", as_string_key(F.col(c))), codes, ["_class"], skewed, row_key
        )
        out = out.withColumn(c, F.coalesce("_code", F.lit(-1))).drop("_class", "_code")
    return out


# --- scaling ------------------------------------------------------------------------


def scaler_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, mean, scale``: population deviation, 1 where it is zero."""
    from meterline.operators.profile import rows_of

    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        sd = F.stddev_pop(v)
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(v).alias("mean"),
                F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("scale"),
            ).alias(c)
        )
    return rows_of(df.agg(*aggs), [F.col(c) for c in columns])


def scaler_apply(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """z-scores. The fitted row is read as one scalar subquery, so the data
    pass through a projection only."""
    by_name = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale"))))
    # One entry per scaled column.
    fitted = scaler.agg(by_name.alias("m")).scalar()

    def z(c: str) -> Column:
        s = F.try_element_at(fitted, F.lit(c))
        return (F.col(c) - s.getField("mean")) / s.getField("scale")

    return df.withColumns({c: z(c) for c in columns})


# --- statistics ---------------------------------------------------------------------


def compare_stats(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Join two long statistics tables (``feature, stat, value``)."""
    return (
        reference.withColumnRenamed("value", "reference")
        .join(current.withColumnRenamed("value", "current"), ["feature", "stat"])
        .withColumn("diff", F.col("current") - F.col("reference"))
    )


def stats_long(stats: DataFrame, names: Sequence[str]) -> DataFrame:
    wide = stats.select("feature", *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot(["feature"], list(names), "stat", "value")
