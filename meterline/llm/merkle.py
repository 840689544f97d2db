"""Merkle manifest of a dataset: a tree for each group of rows, and a tree of their roots.

A row's leaf is the SHA-256 of its columns. Leaves are numbered within their group by sort key;
then every level equijoins its nodes with their siblings' computed numbers (the slots of the same
run of `ARITY` nodes; for two it is the number with its last bit flipped), and the node in slot
zero of a run emits the parent, the hash of the run. Groups with one node left are done; their roots
are the leaves of one more tree. Every level is a table in the shared folder.

A proof is the siblings from a leaf up to the root. Proofs are put together from the root
down, so that nodes of a run share what lies above them: each level joins its nodes with the
proof of their parents. `folded` recomputes a root from a leaf and its proof.

Numbers come from a range sort and the sizes of its partitions, so that no task holds a group:
a group may be the whole table. Shuffles carry digests of 32 bytes, never texts.

Defined cases: null columns are `-` in a leaf, so that they differ from empty ones; a null group
is a group of its own, before all others, and null sort keys come first; rows that tie in the
sort key are numbered by their leaves, and equal leaves are interchangeable; an only leaf is its
group's root, an only group's root is the root; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline.llm.common import ascii_lower, crc_of, once, written

ARITY = 8
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_of(*columns: Column) -> Column:
    """Digest of these columns: `-` for null, else the length in UTF-8 bytes, a colon, the value."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*fields))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with `idx`, their number within the group, and `n`, the group's size.

    Rows are sorted by range over all tasks; a row's number is its place in its task plus what
    earlier tasks hold of its group.
    """
    placed = written(
        rows.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "merkle-order",
    )
    task = F.shiftright("_at", 33)
    by_task = Window.partitionBy(group).orderBy("_task")
    parts = (
        placed.groupBy(group, task.alias("_task"))
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(by_task) - F.col("_rows"))
        .withColumn("n", F.sum("_rows").over(Window.partitionBy(group)))
    )
    # At most tasks + groups rows; written, so that their size decides the kind of join.
    parts = written(parts.drop("_rows"), "merkle-parts")
    return (
        placed.withColumn("_task", task)
        .join(parts, [group, "_task"])
        .withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_at", "_task", "_first", "_before")
    )


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """The nodes (grp, idx, n, h, ...) with `low` and `high`, the digests of their siblings
    in earlier and in later slots."""
    first = F.col("idx") - F.pmod("idx", F.lit(arity))
    last = F.least(first + (arity - 1), F.col("n") - 1)
    if arity == 2:
        numbers = F.filter(F.array(F.col("idx").bitwiseXOR(F.lit(1))), lambda x: x < F.col("n"))
    else:
        numbers = F.filter(F.sequence(first, last), lambda x: x != F.col("idx"))
    asked = nodes.select("grp", "idx", F.explode(numbers).alias("sibling"))
    held = nodes.select("grp", F.col("idx").alias("sibling"), "h")
    # At most arity - 1 rows a node.
    found = (
        asked.join(held, ["grp", "sibling"])
        .groupBy("grp", "idx")
        .agg(F.sort_array(F.collect_list(F.struct("sibling", "h"))).alias("run"))
    )
    side = lambda keep: F.coalesce(
        F.transform(F.filter("run", keep), lambda s: s["h"]), F.array().cast("array<binary>")
    )
    return (
        nodes.join(found, ["grp", "idx"], "left")
        .withColumn("low", side(lambda s: s["sibling"] < F.col("idx")))
        .withColumn("high", side(lambda s: s["sibling"] > F.col("idx")))
        .drop("run")
    )


def hexes(digests: Column) -> Column:
    return F.array_join(F.transform(digests, as_hex), "")


def parent(low: Column, own: Column, high: Column) -> Column:
    """Digest of a run, its digests written as hex text."""
    return digest(F.concat(hexes(low), as_hex(own), hexes(high)))


@dataclass
class Tree:
    levels: list[DataFrame]  # (grp, idx, n, h, low, high) of each level, leaves first
    roots: DataFrame  # (grp, h)


def build(leaves: DataFrame, arity: int = ARITY) -> Tree:
    """The trees over leaves (grp, idx, n, h, ...) of all groups; other columns stay with the
    leaves' level."""
    levels, roots, nodes = [], [], leaves
    top = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.where("n = 1").select("grp", "h"))
        if top <= 1:
            break
        held = written(with_siblings(nodes.where("n > 1"), arity), "merkle-level")
        levels.append(held)
        slot_zero = held.where(F.pmod("idx", F.lit(arity)) == 0)
        nodes = written(
            slot_zero.select(
                "grp",
                F.expr(f"idx div {arity}").alias("idx"),
                F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
                parent(F.col("low"), F.col("h"), F.col("high")).alias("h"),
            ),
            "merkle-nodes",
        )
        top = -(-top // arity)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return Tree(levels, out)


#: A proof: siblings before and after the node, level by level upwards.
PROOF = "array<struct<low: array<binary>, high: array<binary>>>"


def proofs(tree: Tree, above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The nodes of the first level (grp, idx, ...) with `up`: a struct of their `proof` and
    what `above` (grp, up) says about their group. `above` starts with the proof of its root.

    No join has a hot key: a run has at most `arity` nodes, and only a group's last run asks
    for the group.
    """
    held = None
    for level in reversed(tree.levels):
        kept = [c for c in level.columns if c not in ("n", "h", "low", "high")]
        own = level.select(
            *kept,
            F.expr(f"idx div {arity}").alias("over"),
            (F.col("n") <= arity).alias("last"),
            F.array(F.struct("low", "high")).alias("own"),
        )
        longer = F.col("up").withField("proof", F.concat("own", "up.proof")).alias("up")
        parts = own.where("last").join(above, "grp").select(*kept, longer)
        if held is not None:
            higher = held.withColumnRenamed("idx", "over")
            parts = parts.unionByName(own.where("not last").join(higher, ["grp", "over"]).select(*kept, longer))
        # The leaves' proofs are the bulk of it; they go on as they are made.
        held = parts if level is tree.levels[0] else written(parts, "merkle-proofs")
    return held


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, s: parent(s["low"], node, s["high"]))


def siblings_of(proof: Column) -> Column:
    """All siblings of a proof as one hex text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(hexes(s["low"]), hexes(s["high"]))), "")


def manifest(
    leaves: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf", arity: int = ARITY
) -> DataFrame:
    """The rows with `subroot`, `root` and `proof` (digests of 32 bytes); all columns stay.

    `leaf` is a column of digests, `group` a text column. Columns that have the names of the
    results are replaced.
    """
    rows = leaves.drop("subroot", "root", "proof")
    kept = rows.columns
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        # Null before all texts, bytewise.
        F.coalesce(F.concat(F.lit("."), F.col(f"`{group}`").cast("string")), F.lit("-")).alias("grp"),
        F.col(f"`{order}`").alias("key"),
        F.col(f"`{leaf}`").alias("h"),
    )
    # Written, so that the range sort samples digests and no text is hashed twice.
    sorted_rows = numbered(written(packed, "merkle-leaves"), "grp", ["key", "h"])
    placed = written(sorted_rows.drop("key"), "merkle-numbered")
    tree = build(placed, arity)
    # The groups' roots are the leaves of one more tree.
    members = written(tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "h"), "merkle-roots")
    tops = written(numbered(members, "grp", ["member"]), "merkle-tops")
    crown = build(tops, arity)
    none = F.array().cast(PROOF)
    start = crown.roots.select("grp", F.struct(none.alias("proof"), F.col("h").alias("root")).alias("up"))
    if crown.levels:
        # Roots themselves are no part of the level's columns that go on.
        whole = proofs(crown, start, arity).join(tops.select("idx", F.col("h").alias("subroot")), "idx")
    else:
        whole = tops.withColumnRenamed("h", "subroot").join(start, "grp")
    above = written(
        whole.select(F.col("member").alias("grp"), F.col("up").withField("subroot", F.col("subroot")).alias("up")),
        "merkle-subroots",
    )
    done = placed.where("n = 1").join(above, "grp").select("row", "up")
    if tree.levels:
        done = done.unionByName(proofs(tree, above, arity).select("row", "up"))
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "up.subroot", "up.root", "up.proof")


def op12_merkle_manifest(docs: DataFrame) -> DataFrame:
    fields = {c: F.col(c) for c in LEAF_COLUMNS}
    changed = fields | {"text": ascii_lower(F.col("text"))}
    tampered = F.when(F.pmod(crc_of(F.col("doc_id")), F.lit(3)) == 0, leaf_of(*changed.values()))
    leaves = docs.select("doc_id", "lang", leaf_of(*fields.values()).alias("leaf"), tampered.alias("tampered"))
    start = F.coalesce("tampered", "leaf")
    proven = once(manifest(leaves), reached=folded(start, F.col("proof")))
    return proven.select(
        "doc_id",
        as_hex(F.col("leaf")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        as_hex(F.col("root")).alias("root"),
        F.sha2(siblings_of(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        as_hex(F.col("reached")).alias("folded_root"),
        (F.col("reached") == F.col("root")).alias("verified"),
    )
