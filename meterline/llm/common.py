"""Helpers of the text operators: tables, shared scratch tables, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a Python worker turns into Python objects at a time.
SLICE_ROWS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    That is `spark.checkpoint.dir`; where it is unset, a local session takes a folder below its
    warehouse, and a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder: later steps read it, lost executors don't matter."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator, so that filters above don't repeat their work."""
    packed = F.struct(*[c.alias(k) for k, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(packed)).alias("_once")).select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(f"_once.{k}").alias(k) for k in columns]
    )


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def appended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns; one of the same name is replaced."""
    names = [n for n in batch.schema.names if n not in columns]
    arrays = [batch.column(n) for n in names] + list(columns.values())
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *columns])


def arrow_struct(schema: StructType) -> pa.DataType:
    return pa.struct(list(to_arrow_schema(schema)))
