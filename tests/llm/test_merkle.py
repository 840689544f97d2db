"""Merkle manifest against a tree built in memory."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from meterline.llm import merkle
from meterline.llm.common import table
from meterline.llm.queries import QUERIES


def sha(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, changed: bool = False) -> str:
    text = row["text"]
    if changed and text is not None:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree_of(leaves: list[str], arity: int = 8) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and for each leaf its siblings before and after it, level by level."""
    paths, place, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(place):
            run = level[i // arity * arity : i // arity * arity + arity]
            paths[k].append((run[: i % arity], run[i % arity + 1 :]))
        place = [i // arity for i in place]
        level = [sha(*level[b : b + arity]) for b in range(0, len(level), arity)]
    return level[0], paths


def wanted(rows) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    first = lambda v: (v is not None, v if v is not None else 0)
    for members in groups.values():
        members.sort(key=lambda r: (first(r["doc_id"]), leaf_of(r)))
    trees = {g: tree_of([leaf_of(r) for r in rs]) for g, rs in groups.items()}
    if not groups:
        return []
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, tops = tree_of([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            whole = path + top
            name = "" if r["doc_id"] is None else str(r["doc_id"])
            node = leaf_of(r, zlib.crc32(name.encode()) % 3 == 0)
            for low, high in whole:
                node = sha(*low, node, *high)
            proof = sha(*["".join(low + high) for low, high in whole])
            out.append((r["doc_id"], leaf_of(r), trees[g][0], root, proof, node, node == root))
    return out


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_merkle_manifest"](spark, sf).collect()
    assert ordered(rows) == ordered(wanted(table(spark, sf, "documents").collect()))
    assert {r["verified"] for r in rows} == {True, False}


DOCS = "doc_id long, source string, lang string, n_chars int, text string, h string, row int, idx int, root int"


def rows_of(langs: list, n: int) -> list[tuple]:
    return [(k, "s", g, k, f"Text {k}", "x", 1, 2, 3) for g in langs for k in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(["a"], 1),
        rows_of([None, "", *[f"l{k}" for k in range(68)]], 2),
        rows_of(["a"], 65) + rows_of(["é", None], 8) + rows_of(["z"], 1),
        # Ties: the same id with other texts, whole rows that repeat, no ids, nulls everywhere.
        [(1, "s", "a", 1, t, "x", 1, 2, 3) for t in ("A", "A", "b", "", None)] * 4
        + [(None, None, None, None, None, None, None, None, None)] * 3
        + [(None, "s", "a", 0, "X", "x", 1, 2, 3)] * 2,
        [],
    ],
    ids=["one", "many groups", "uneven", "ties", "none"],
)
def test_shapes(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    assert ordered(merkle.op12_merkle_manifest(docs).collect()) == ordered(wanted(docs.collect()))


@pytest.mark.parametrize("arity", [2])
def test_other_arities(spark, arity):
    docs = spark.createDataFrame([(k, "g", sha(str(k))) for k in range(11)], "doc_id int, lang string, leaf string")
    docs = docs.withColumn("leaf", F.unhex("leaf"))
    got = merkle.manifest(docs, arity=arity)
    got = got.select(
        "doc_id",
        merkle.as_hex(F.col("root")).alias("root"),
        merkle.siblings_of(F.col("proof")).alias("siblings"),
        merkle.as_hex(merkle.folded(F.col("leaf"), F.col("proof"))).alias("folded"),
    )
    root, paths = tree_of([sha(str(k)) for k in range(11)], arity)
    for r in got.collect():
        assert (r["root"], r["folded"]) == (root, root)
        assert r["siblings"] == "".join("".join(low + high) for low, high in paths[r["doc_id"]])


def test_columns_stay(spark):
    docs = spark.createDataFrame(rows_of(["a", "b"], 20), DOCS).withColumn("leaf", merkle.digest(F.col("text")))
    out = merkle.manifest(docs)
    assert out.columns == [*[c for c in docs.columns if c != "root"], "subroot", "root", "proof"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted([*range(20)] * 2)


def test_a_group_is_spread_over_tasks(spark):
    """One group with all rows: no task sorts or numbers all of it."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("g").alias("grp"), F.xxhash64("id").alias("h")
    )
    out = merkle.numbered(docs.repartition(4), "grp", ["doc_id"])
    assert out.where("idx <> doc_id OR n <> 20000").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        placed = docs.repartitionByRange("grp", "doc_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in placed) < 10_000
