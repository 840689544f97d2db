"""Connected components of an edge table, in a number of rounds that grows with the logarithm
of the longest chain.

Every round sends rows by node; a hub's edges are pre-aggregated to their smallest neighbour
before the shuffle where only that is needed, and tables of every round are written to the
shared folder. Nothing is gathered in the driver but the count of rows that changed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meterline.llm.common import written

EDGE = "a long, b long"
#: Edges that a task contracts at a time.
CHUNK = 500_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges, and the smallest node that each one reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            return nodes, nodes[root]


def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a task by stars with the same components."""
    held_a, held_b, held = [], [], 0

    def star() -> pa.RecordBatch:
        nodes, root = roots_of(np.concatenate(held_a), np.concatenate(held_b))
        far = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])

    for batch in batches:
        held_a.append(batch.column("a").to_numpy())
        held_b.append(batch.column("b").to_numpy())
        held += batch.num_rows
        if held >= CHUNK:
            yield star()
            held_a, held_b, held = [], [], 0
    if held:
        yield star()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Self loops, repeated edges and both directions are fine; rows with a null end are ignored.
    An empty table gives an empty table.
    """
    # Edges run from a larger to a smaller node throughout.
    stars = written(
        edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(contract, EDGE),
        name,
    )
    while True:
        # Every node points at the smallest neighbour below it; its other neighbours are
        # linked to that one. Nodes with one neighbour are settled unless it moves itself.
        low = stars.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            stars.join(low, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        # Pointer jumping: the smallest neighbour's own smallest neighbour.
        up = low.select(F.col("a").alias("m"), F.col("m").alias("top"))
        jumped = low.join(up, "m", "left").select(
            "a", F.coalesce("top", "m").alias("b"), F.col("top").isNotNull().alias("changed")
        )
        merged = moved.select("a", "b", F.lit(True).alias("changed")).unionByName(jumped)
        following = written(
            merged.groupBy("a", "b").agg(F.max("changed").alias("changed")), name
        )
        busy = following.where("changed").limit(1).count()
        stars = following.select("a", "b")
        if not busy:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
