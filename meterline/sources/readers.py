"""Scans. All lazy; projections and filters reach the file readers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from meterline import schemas as S
from meterline.functions.trip import parse_route_key


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the trip files; Spark aggregates skip null only."""
    fractional = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in fractional else F.col(c)
            for c in df.columns
        ]
    )


def scan_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _schema_of(spark: SparkSession, path: str) -> T.StructType | None:
    """Schema of a file or folder; None if there is none."""
    try:
        return spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


#: Decimal digits of the whole numbers.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_FRACTIONAL = (T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _wider(a: T.DataType, b: T.DataType, name: str = "") -> T.DataType:
    """The narrowest type that holds both: numbers stay numbers and times stay times. A column
    that is a number in one file and text or a time in another has no common type: an error."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    both = (a, b)
    if all(isinstance(t, (*_DIGITS, *_FRACTIONAL, T.DecimalType)) for t in both):
        if any(isinstance(t, _FRACTIONAL) for t in both):
            return T.DoubleType()  # a float holds no 32-bit integer exactly
        if any(isinstance(t, T.DecimalType) for t in both):
            # A whole number is a decimal without a fraction.
            sizes = [(t.precision, t.scale) if isinstance(t, T.DecimalType) else (_DIGITS[type(t)], 0) for t in both]
            scale = max(s for _, s in sizes)
            digits = max(p - s for p, s in sizes) + scale
            return T.DecimalType(digits, scale) if digits <= 38 else T.DoubleType()
        return max(both, key=lambda t: _DIGITS[type(t)])
    if all(isinstance(t, _TIMES) for t in both):
        zoned = any(isinstance(t, T.TimestampType) for t in both)
        # A date or local time beside an instant: read as local, as the trip files are.
        return T.TimestampNTZType() if not zoned or T.TimestampNTZType() in both else T.TimestampType()
    if all(isinstance(t, T.StringType | T.CharType | T.VarcharType) for t in both):
        return T.StringType()
    raise ValueError(f"{name or 'a column'} is {a.simpleString()} in one file and {b.simpleString()} in another")


def scan_many(
    spark: SparkSession,
    paths: Iterable[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Row concatenation of files; a column a file lacks becomes null there.

    Absent files are skipped, and if none is left the table is empty with the
    given schema. Files that share a schema are one scan; a column whose type
    differs between files gets the narrowest one that holds all of them (a decimal beside a double
    is a double, a date beside a timestamp a timestamp). NaN becomes null.
    """
    paths = list(paths)
    if not paths and schema is None:
        raise ValueError("no files to read")
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda p: _schema_of(spark, p), paths))
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for path, own in zip(paths, found, strict=True):
        if own is not None:
            groups.setdefault(own.json(), (own, []))[1].append(path)
    if not groups:
        if schema is None:
            raise ValueError(f"none of {len(paths)} files exists")
        df = spark.createDataFrame([], schema)
        return df.select(*columns) if columns else df
    types: dict[str, T.DataType] = {}
    for own, _ in groups.values():
        for f in own.fields:
            types[f.name] = _wider(types[f.name], f.dataType, f.name) if f.name in types else f.dataType
    frames = [
        spark.read.schema(own)
        .parquet(*some)
        .select(
            *[
                F.col(f.name) if f.dataType == types[f.name] else F.col(f.name).cast(types[f.name]).alias(f.name)
                for f in own.fields
            ]
        )
        for own, some in groups.values()
    ]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return nan_to_null(df.select(*columns) if columns else df)


def month_paths(folder: str, year: int, months: Iterable[int]) -> list[str]:
    """Monthly file names under a folder."""
    return [f"{folder.rstrip('/')}/yellow_tripdata_{year}-{m:02d}.parquet" for m in months]


def select_months(
    spark: SparkSession,
    folder: str,
    year: int,
    months: Iterable[int],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read only the named months, with all columns that any of them has.

    Months without a file are skipped; without any the table is empty.
    """
    return scan_many(spark, month_paths(folder, year, months), columns, S.RAW_TRIP_SCHEMA)


def scan_zones(spark: SparkSession, path: str) -> DataFrame:
    return drop_unnamed_zones(spark.read.schema(S.ZONE_SCHEMA).csv(path, header=True))


def drop_unnamed_zones(zones: DataFrame) -> DataFrame:
    return zones.dropna(subset=["Borough", "Zone"])


def _existing(spark: SparkSession, path: str, read: Callable[[str], DataFrame]) -> DataFrame | None:
    """What `read` makes of the path; None if nothing is there."""
    try:
        return read(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame | None:
    """``value``: the text between two separators. Files split into tasks at any of them, however
    long their lines are; None without a file."""
    return _existing(spark, path, lambda p: spark.read.option("lineSep", separator).text(p))


def scan_prediction_log(spark: SparkSession, path: str, first_key: str = "timestamp") -> DataFrame:
    """JSON log to ``timestamp, inputs, prediction``: arrays of records, or a record per line, or
    both, over any number of tasks per file.

    ``first_key`` is the key with which every record begins. Records under the old key ``input``
    are accepted; a record that cannot be parsed is dropped. Without a file the table is empty.
    """
    quoted = f'"{first_key}"'
    pieces = _pieces(spark, path, quoted)
    if pieces is None:
        return normalise_log(spark.createDataFrame([], S.LOG_SCHEMA))
    # What follows the first key, up to the record's end; then comes what stands between records.
    rest = F.regexp_extract("value", r"(?s)^(\s*:.*\})[\s,\[\]{]*$", 1)
    record = F.from_json(F.concat(F.lit("{" + quoted), rest), S.LOG_SCHEMA)
    return normalise_log(pieces.where(rest != "").select(record.alias("r")).select("r.*"))


def normalise_log(raw: DataFrame) -> DataFrame:
    inputs = F.coalesce(F.col("inputs"), F.col("input"))
    return raw.select("timestamp", inputs.alias("inputs"), "prediction").where(
        F.col("inputs").isNotNull()
    )


def flatten_inputs(log: DataFrame) -> DataFrame:
    return log.select("timestamp", "inputs.*", "prediction")


def parse_inputs(json_text: Column) -> Column:
    return F.from_json(json_text, S.LOG_INPUTS)


def scan_route_table(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects ``{"pu_do": miles}`` to one row per route; a file of any size is read by many
    tasks, entry by entry. Without a file the table is empty."""
    pieces = _pieces(spark, path, ",")
    if pieces is None:
        return explode_routes(spark.createDataFrame([], "value string"), F.col("value"))
    # Two entries where an object ends and the next one begins.
    entries = F.regexp_extract_all("value", F.lit(r'"([^"]*"\s*:\s*[^,{}\s]+)'), 1)
    parts = pieces.select(F.explode(entries).alias("entry")).select(F.split("entry", r'"\s*:\s*').alias("p"))
    return _routes(parts.select(F.col("p")[0].alias("key"), F.col("p")[1].try_cast("double").alias("value")))


def explode_routes(df: DataFrame, json_map: Column) -> DataFrame:
    """The same from a column of such objects."""
    return _routes(df.select(F.explode(F.from_json(json_map, "map<string,double>"))))


def _routes(entries: DataFrame) -> DataFrame:
    pickup, dropoff = parse_route_key(F.col("key"))
    return entries.select(
        pickup.alias("PULocationID"),
        dropoff.alias("DOLocationID"),
        F.col("value").alias("avg_distance"),
    )
