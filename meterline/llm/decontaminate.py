"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Text is normalised by its bytes: A-Z become lower case, and every ASCII character that is no
letter or digit separates words. The automaton is built over item words. Document words
stream through it; the state tells the longest run of item words that ends at each word. Where
the run reaches ten words (or a whole shorter item), the window is hit, and the items below
that state's suffix of window length are the contaminating ones. Only stretches of words that
occur in some item enter the automaton, as no window can hold another word.

Items are dealt by hash to blocks of about `BLOCK_WORDS` words, in Spark. A benchmark of one block
takes one pass. More blocks take one pass each, with one block broadcast at a time, and their
hits are merged by document, so that memory does not grow with the benchmark.

Defined cases: null or empty text has no words and no hits; null or empty items have no
windows; an item without an id still marks words, but is not counted; items that repeat an
id count once; repeated documents give repeated rows; an empty benchmark leaves all as it is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from meterline.llm.common import appended, arrow_struct, fresh_name, slices, written

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: A document with a larger share of hit words is dropped whole by `decontaminate`.
MAX_COVERAGE = 0.8
#: Bytes that separate words become blanks, A-Z become a-z, all others stay.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
WORD = re.compile(rb"[^\x20]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class SuffixAutomaton:
    """Of several word sequences. States know the items whose windows end in them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        ends: list[tuple[int, int, int]] = []  # state, item, length of the item so far
        for number, (_, words) in enumerate(items):
            last = 0
            for at, w in enumerate(words, 1):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                if at >= window or at == len(words):
                    ends.append((last, number, min(at, window)))
        self.names = [name for name, _ in items]
        self._mark(ends)
        self.least = min((min(len(w), window) for _, w in items if w), default=window)

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last] and length[step[last][c]] == length[last] + 1:
            return step[last][c]
        if c in step[last]:
            return self._clone(last, c, step[last][c])
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[p] + 1 == length[q] else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        clone = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    def _mark(self, ends: list[tuple[int, int, int]]) -> None:
        """windows[state]: (length, items) of the windows that are suffixes of its strings."""
        own: dict[int, dict[int, set[int]]] = {}
        for state, item, n in ends:
            # The state whose strings include the last n words.
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            own.setdefault(state, {}).setdefault(n, set()).add(item)
        self.windows: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            mine = tuple((n, frozenset(s)) for n, s in sorted(own.get(state, {}).items(), reverse=True))
            self.windows[state] = mine + self.windows[self.link[state]]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word ranges (start, stop exclusive; merged) inside windows, and the items."""
        known = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        inside = np.concatenate([[False], known >= 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i >= self.least:
                self._stream(known[i:j].tolist(), i, ranges, items)
        return ranges, items

    def _stream(self, run: list[int], at: int, ranges: list, items: set[int]) -> None:
        step, link, length, windows = self.step, self.link, self.length, self.windows
        state, n = 0, 0
        for c in run:
            at += 1
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            if c in step[state]:
                state = step[state][c]
                n += 1
            longest = 0
            for size, found in windows[state]:
                if size <= n:
                    longest = longest or size
                    items |= found
            if longest:
                start = at - longest
                while ranges and ranges[-1][1] >= start:
                    start = min(start, ranges.pop()[0])
                ranges.append((start, at))


def numbered_items(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> tuple[DataFrame, int]:
    """(i, t, block) of the items, dealt by hash to blocks of about so many words; the blocks."""
    items = benchmark.where(F.col(text).isNotNull()).select(
        F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")
    )
    # Words are at least a letter and a separator.
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = size // (2 * block_words) + 1
    dealt = items.distinct().withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    return (written(dealt, "benchmark-blocks") if blocks > 1 else dealt), blocks


def block_of(items: DataFrame, k: int) -> Broadcast | None:
    """The items of one block, whose size is bounded."""
    rows = items.where(F.col("block") == k).select("i", "t").collect()
    held = [(r["i"], words_of(bytes(r["t"]))) for r in sorted(rows, key=lambda r: (r["i"] or "", bytes(r["t"])))]
    held = [(i, w) for i, w in held if w]
    return items.sparkSession.sparkContext.broadcast(held) if held else None


_built: dict[str, SuffixAutomaton] = {}


def automaton(key: str, block: Broadcast) -> SuffixAutomaton:
    """One automaton at a time stays in a worker."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(block.value)
    return _built[key]


def found_in(key: str, block: Broadcast, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Hit word ranges and the ids of the items."""
    machine = automaton(key, block)
    ranges, items = machine.hits(words)
    return ranges, {machine.names[k] for k in items if machine.names[k] is not None}


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, j in sorted(ranges):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(j, out[-1][1]))
        else:
            out.append((i, j))
    return out


HITS = (
    StructType()
    .add("n_words", LongType())
    .add("n_hit", LongType())
    .add("items", ArrayType(StringType()))
    .add("ranges", ArrayType(StructType().add("start", LongType()).add("stop", LongType())))
    .add("clean", BinaryType())
)


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without these word ranges; one blank stands for a removed passage."""
    spans = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    out, at = [], 0
    for i, j in ranges:
        out.append(text[at : spans[i][0]])
        at = spans[j - 1][1]
    return b" ".join([*out, text[at:]]) if ranges else text


def scanned(docs: DataFrame, text: str, name: str, key: str, block: Broadcast | None, remove: bool) -> DataFrame:
    """All rows and columns, and the hits in one block's items; one pass, no shuffle."""
    schema = StructType([*docs.schema.fields]).add(name, HITS)
    kind = arrow_struct(HITS)
    column = docs.columns.index(text)

    def hits(words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        return found_in(key, block, words) if block else ([], set())

    def row(t: bytes) -> dict:
        words = words_of(t)
        ranges, items = hits(words)
        clean = None
        if remove and ranges:
            clean, left = without(t, ranges), ranges
            while left:  # a removal can join the ends of two passages
                left = hits(words_of(clean))[0]
                clean = without(clean, left)
        return {
            "n_words": len(words),
            "n_hit": sum(j - i for i, j in ranges),
            "items": sorted(items),
            "ranges": [{"start": i, "stop": j} for i, j in ranges],
            "clean": clean,
        }

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [row(t or b"") for t in batch.column(column).cast(pa.binary()).to_pylist()]
            yield appended(batch, **{name: pa.array(rows, kind)})

    return docs.mapInArrow(add, schema)


def merged_hits(lists: Column) -> Column:
    """The union of the word ranges, touching ones joined."""
    ordered = F.array_sort(F.flatten(lists))
    return F.aggregate(
        ordered,
        F.array().cast("array<struct<start: bigint, stop: bigint>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (r["start"] <= F.element_at(done, -1)["stop"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(
                    F.element_at(done, -1)["start"].alias("start"),
                    F.greatest(F.element_at(done, -1)["stop"], r["stop"]).alias("stop"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    name: str = "hits",
    remove: bool = False,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All rows and columns, and a struct: words, hit words, item ids, hit word ranges.

    With `remove`, `clean` is the text without the hit passages (UTF-8), until no window is left.
    A benchmark of one block takes one pass over the documents. More blocks take one pass each,
    every task builds one automaton, and the hits meet again by row.
    """
    run = uuid.uuid4().hex
    items, blocks = numbered_items(benchmark, item_id, item_text, block_words)
    if blocks == 1:
        return scanned(docs, text, name, run, block_of(items, 0), remove)
    uid, own = fresh_name(docs, "_uid"), fresh_name(docs, "_text")
    held = written(docs.withColumn(uid, F.monotonically_increasing_id()), "decontaminate-rows")
    texts = held.select(F.col(uid).alias("uid"), F.col(f"`{text}`").alias("text"))

    def one_round(rows: DataFrame, number: int) -> DataFrame:
        """(uid, ranges, items) of the rows with hits in any block."""
        parts = None
        for k in range(blocks):
            block = block_of(items, k)
            if block is None:
                continue
            hits = scanned(rows, "text", "h", f"{run}-{number}-{k}", block, False).where("h.n_hit > 0")
            part = written(hits.select("uid", "h.ranges", "h.items"), "decontaminate-hits")
            block.unpersist()
            parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return written(rows.select("uid", F.array().cast(HITS["ranges"].dataType).alias("ranges"), F.array().cast("array<string>").alias("items")).limit(0), "decontaminate-hits")
        # A row per block and document at most.
        return written(
            parts.groupBy("uid").agg(
                merged_hits(F.collect_list("ranges")).alias("ranges"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            ),
            "decontaminate-merged",
        )

    def cut(rows: DataFrame, found: DataFrame) -> DataFrame:
        """(uid, text) of the rows with hits, without them."""

        def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                spans = [[(r["start"], r["stop"]) for r in rs] for rs in batch.column("ranges").to_pylist()]
                left = [without(t, r) for t, r in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(left, pa.binary())], ["uid", "text"])

        joined = rows.join(found.select("uid", "ranges"), "uid").select("uid", "text", "ranges")
        return written(joined.mapInArrow(out, "uid long, text binary"), "decontaminate-cut")

    found = one_round(texts, 0)
    cleaned = None
    if remove:
        cleaned = cut(texts, found)
        number = 1
        while True:  # a removal can join the ends of two passages
            more = one_round(cleaned, number)
            if more.isEmpty():
                break
            again = cut(cleaned, more)
            cleaned = written(cleaned.join(more, "uid", "left_anti").unionByName(again), "decontaminate-cut")
            number += 1
    whole = held.join(found.withColumnRenamed("uid", uid).select(uid, F.struct("ranges", "items").alias(own)), uid, "left")
    clean = F.lit(None).cast("binary")
    if cleaned is not None:
        kept = fresh_name(docs, "_clean")
        whole = whole.join(cleaned.select(F.col("uid").alias(uid), F.col("text").alias(kept)), uid, "left")
        clean = F.col(kept)
    ranges = F.coalesce(F.col(f"{own}.ranges"), F.array().cast(HITS["ranges"].dataType))
    hits = F.struct(
        word_count(F.col(f"`{text}`")).alias("n_words"),
        F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"]).alias("n_hit"),
        F.coalesce(F.col(f"{own}.items"), F.array().cast("array<string>")).alias("items"),
        ranges.alias("ranges"),
        clean.alias("clean"),
    )
    return whole.select(*[F.col(f"`{c}`") for c in docs.columns], hits.alias(name))


def word_count(text: Column) -> Column:
    """Words as the automaton sees them."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = MAX_COVERAGE
) -> DataFrame:
    """The columns of the documents: hit passages are cut out of the text.

    Documents of which more than `max_coverage` of the words are hit are dropped. Documents
    without a hit, null texts included, stay as they are.
    """
    name = fresh_name(docs, "hits")
    scanned = contamination(docs, benchmark, text, name=name, remove=True)
    clean = F.coalesce(F.col(f"{name}.clean").cast("string"), F.col(f"`{text}`"))
    return scanned.where(F.col(f"{name}.n_hit") <= max_coverage * F.col(f"{name}.n_words")).select(
        *[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    )


def op5_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    scanned = contamination(docs.select("doc_id", "text"), benchmark)
    return scanned.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )
