"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits come from the XXH64 of all three-word shingles. Bit positions carry
labels from 1 to 15, dealt in turn. For each non-zero vector v of four bits a mask keeps the
positions whose label has an odd inner product with v. The labels of three differing positions
span at most three of four dimensions, so that some v is orthogonal to all of them: each pair
within three bits agrees on at least one of the 15 masked keys. Nothing is missed.

A mask leaves at most 32 bits free. Buckets with more than `SMALL` fingerprints are covered
once more over their free bits (same proof), which leaves at most 16, so that no bucket holds
over 65,536 distinct fingerprints, whatever the input. Inside a bucket a search that takes
each linked fingerprint off the open list gives a spanning forest, not all pairs. Copies
meet in their common fingerprint before any of this. Links then go to connected components.

Defined cases: null and empty text have fingerprint zero and are linked like any other; a row
without id keeps its row, and its id counts as larger than any other; repeated rows are copies.
Tables without rows give no rows. `near_duplicates` drops other columns, `drop_near_duplicates`
keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from meterline.llm.common import appended, fresh_name, slices, written
from meterline.llm.components import components

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Buckets up to this size are searched as they are, larger ones are covered again first.
SMALL = 2048
#: Bytes A-Z to a-z.
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TABLES = 2 ** (RADIUS + 1) - 1


def covering_masks(positions: list[int]) -> list[int]:
    """Masks over these bit positions: pairs within `RADIUS` bits agree under one of them."""
    labels = {p: 1 + k % TABLES for k, p in enumerate(positions)}
    return [
        sum(1 << p for p, label in labels.items() if (label & v).bit_count() % 2)
        for v in range(1, TABLES + 1)
    ]


MASKS = covering_masks(list(range(64)))
#: For each first mask, the masks over the positions that it leaves free.
SECOND = [covering_masks([p for p in range(64) if not m >> p & 1]) for m in MASKS]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of whole text (UTF-8)."""
    words = text.translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(words) - 2].tolist(), ends[2:].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in pairs), np.uint64, len(words) - 2)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint as a long. A text travels once."""
    schema = StructType([*docs.schema.fields]).add(name, LongType())
    column = docs.columns.index(text)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(column).cast(pa.binary()).to_pylist()
            yield appended(batch, **{name: pa.array([signed(fingerprint(t or b"")) for t in texts], pa.int64())})

    return docs.mapInArrow(add, schema)


def forest(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all fingerprints of a bucket that are linked within it."""
    left = np.unique(prints)
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            node, frontier = frontier[0], frontier[1:]
            # Unsigned: the count of a negative number is that of its absolute value.
            near = np.bitwise_count((left ^ node).view(np.uint64)) <= RADIUS
            if near.any():
                hit = left[near]
                yield np.full(len(hit), node), hit
                frontier, left = np.concatenate([frontier, hit]), left[~near]


def links_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("prints")
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = [pair for i, j in zip(ends[:-1], ends[1:], strict=True) for pair in forest(flat[i:j])]
        if found:
            a, b = (np.concatenate(side) for side in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def masked(value: Column, masks: list[int]) -> Column:
    """(table, key) structs of a fingerprint, one for each mask."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("t"), value.bitwiseAND(F.lit(signed(m))).alias("key"))
            for k, m in enumerate(masks)
        ]
    )


def print_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of distinct fingerprints `fp`; connected as all pairs within the radius are."""
    keyed = prints.select("fp", F.explode(masked(F.col("fp"), MASKS)).alias("k")).select(
        F.col("k.t").alias("t"), F.col("k.key").alias("key"), "fp"
    )
    # Most keys are held by one fingerprint and go no further.
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["t", "key"]), "simhash-buckets")
    small = (
        shared.where(F.col("n") <= SMALL)
        .groupBy("t", "key")
        .agg(F.collect_list("fp").alias("prints"))
        .select("prints")
    )
    again = F.lit(None)
    for k, masks in enumerate(SECOND):
        again = F.when(F.col("t") == k, masked(F.col("fp"), masks)).otherwise(again)
    large = (
        shared.where(F.col("n") > SMALL)
        .select("t", "key", "fp", F.explode(again).alias("k"))
        .groupBy("t", "key", "k.t", "k.key")
        .agg(F.collect_list("fp").alias("prints"))
        .where(F.size("prints") > 1)
        .select("prints")
    )
    return small.unionByName(large).mapInArrow(links_of, "a long, b long")


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root) for distinct fingerprints `fp`: a class has one root, itself a fingerprint."""
    roots = components(print_links(prints), "simhash-components")
    alone = prints.join(roots, prints["fp"] == roots["node"], "left")
    return alone.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is its smallest id.

    The component of rows that have no id at all is null.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashed = written(with_fingerprints(slim, "text", "fp").select("doc_id", "fp"), "simhash-docs")
    prints = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    rooted = written(prints.join(classes(prints.select("fp")), "fp"), "simhash-roots")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # The fingerprint side has one row a fingerprint; a hot one is a skewed join's larger side.
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return hashed.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of each component; the columns stay as they are.

    Among rows that repeat that id, one row stays; without any id, one row stays as well.
    """
    fp, uid = (fresh_name(docs, c) for c in ("fp", "uid"))
    # The row number is fixed by being written.
    hashed = written(
        with_fingerprints(docs, text, fp).withColumn(uid, F.monotonically_increasing_id()), "simhash-rows"
    )
    own_id = F.col(f"`{doc_id}`")
    rank = F.struct(own_id.isNull().alias("n"), own_id.alias("id"), F.col(uid).alias("uid"))
    prints = written(
        hashed.select(F.col(fp).alias("fp"), rank.alias("r")).groupBy("fp").agg(F.min("r").alias("first")),
        "simhash-prints",
    )
    winners = written(
        prints.join(classes(prints.select("fp")), "fp")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.uid").alias(uid)),
        "simhash-winners",
    )
    # As many winners as documents, nearly: sorted and merged at every size, never broadcast.
    return hashed.join(winners.hint("merge"), uid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
