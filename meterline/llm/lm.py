"""Language-model scoring with a log-frequency Bloom filter.

Training text gives counts of words and word pairs. The filter holds them quantised: a count
of level q = 1 + floor(log_b(count)) is q entries (n-gram, 1) to (n-gram, q). A lookup asks for
level 1, 2, ... until one is missing, and returns the mean count of the last level found.
Scoring interpolates p(w | v) = l * c(v, w) / c(v) + (1 - l) * p(w), with a weight l for each
level of c(v), fitted by leave-one-out expectation steps on all training tokens: what enters them
is the number of tokens of each (context, pair, word) level, a table of at most (LEVELS + 1)^3 rows.

Texts are split into words once and written as chunks of documents. Counts are made from the
chunks in one shuffle: tasks hand on packed counts by hash shard, and a shard's counts become its
word counts and its segment of the filter, which holds all n-grams of the shard. Segments stay rows:
chunks send the distinct n-grams that they ask for to the shards, and the levels come back to the
chunk. No task and no broadcast holds the whole filter.

The base score needs exact counts. Words with a share of at least `HEAD_SHARE` of the tokens
(at most 1 / HEAD_SHARE of them) are broadcast; all rarer words are joined, and none of them
can be hot.

Defined cases: null text is empty and scores its end token; without training rows all counts
are 0 and V is 0; repeated rows count and score as often as they occur; a null id hashes like
empty text; an empty table gives no rows.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from meterline.llm.common import appended, crc_of, slices, written

BASE = 1.5
LEVELS = 64
HASHES = 5
BITS_PER_ENTRY = 10
HEAD_SHARE = 2e-6
#: Training text per shard of the counts, which bounds a shard's memory.
SHARD_BYTES = 6 << 20
#: Keys that a shard looks up at a time.
LOOKED_UP = 1_000_000
#: Text that a chunk of documents holds at a time.
HELD_BYTES = 4 << 20

START, END = b"\r", b"\n"  # no word holds either
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * K1
        x = (x ^ (x >> np.uint64(29))) * K2
        return x ^ (x >> np.uint64(32))


def word_keys(h: np.ndarray) -> np.ndarray:
    return mix(h ^ K3)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * K1 + ((w << np.uint64(17)) | (w >> np.uint64(47))))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


LOW = np.uint64((1 << 40) - 1)


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by shard and, within it, by their lower 40 bits; where shards begin.

    The lower 40 bits are those by which a shard knows its n-grams: a million of them meet a
    foreign key with 1e-6, against false positives of about 1e-2.
    """
    shard = shard_of(keys, shards).astype(np.uint64)
    order = np.argsort((shard << np.uint64(40)) | (keys & LOW))
    return order, np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def planes(values: np.ndarray, width: int) -> np.ndarray:
    """Whole numbers as bytes, all lowest ones first: high bytes hardly differ, and shrink."""
    return np.ascontiguousarray(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()


def from_planes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1).T
    return out.view("<u8").ravel()


def squeezed(data: bytes | np.ndarray) -> bytes:
    raw = data if isinstance(data, bytes) else data.tobytes()
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def released(data: bytes) -> bytes:
    return pa.decompress(data[8:], struct.unpack("<Q", data[:8])[0], codec="zstd", asbytes=True)


def packed(numbers: np.ndarray, width: int) -> bytes:
    return squeezed(planes(numbers, width))


def unpacked(data: bytes, width: int) -> np.ndarray:
    return from_planes(np.frombuffer(released(data), np.uint8), width)


def packed_keys(keys: np.ndarray) -> bytes:
    """The lower 40 bits of keys in the order of `by_shard`, as gaps; nothing is lost."""
    return packed(np.diff(keys & LOW, prepend=np.uint64(0)), 5)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, 5))


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def level_counts() -> np.ndarray:
    """Mean integer count of each level (the nearest one below, where a level holds none)."""
    out = [0.0]
    for q in range(1, LEVELS + 1):
        low, high = math.ceil(BASE ** (q - 1) - 1e-9), math.ceil(BASE**q - 1e-9) - 1
        out.append((low + high) / 2 if high >= low else out[-1])
    return np.array(out)


def probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the hashes of (key, level)."""
    with np.errstate(over="ignore"):
        a = mix(keys + np.uint64(level) * K3)
        return a, (a * K1) | np.uint64(1)


def bit_of(a: np.ndarray, b: np.ndarray, k: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """Bit of the k-th hash in a segment of so many bits (under 2^32): the hash's upper half,
    scaled to the segment."""
    with np.errstate(over="ignore"):
        return ((((a + np.uint64(k) * b) >> np.uint64(32)) * bits) >> np.uint64(32)).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Filter segment of these n-grams."""
    levels = level_of(counts) if len(counts) else np.zeros(0, np.int64)
    size = max(8, -(-int(levels.sum()) * BITS_PER_ENTRY // 8))
    bits = np.zeros(size * 8, np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        a, b = probes(keys[levels >= q], q)
        for k in range(HASHES):
            bits[bit_of(a, b, k, np.uint64(size * 8))] = 1
    return np.packbits(bits, bitorder="little")


@dataclass
class LogFrequencyFilter:
    data: np.ndarray  # bytes of all segments
    starts: np.ndarray  # first byte of each shard's segment
    sizes: np.ndarray  # bytes of each shard's segment

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Stored level of each n-gram: 0 if absent."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.sizes):
            return out
        shard = (keys % np.uint64(len(self.sizes))).astype(np.int64)
        first, bits = self.starts[shard] * 8, self.sizes[shard].astype(np.uint64) * np.uint64(8)
        active = np.arange(len(keys))
        for q in range(1, LEVELS + 1):
            a, b = probes(keys, q)
            for k in range(HASHES):
                at = first + bit_of(a, b, k, bits)
                hit = np.flatnonzero((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                keys, first, bits, active, a, b = (x[hit] for x in (keys, first, bits, active, a, b))
            if not len(active):
                break
            out[active] = q
        return out


@dataclass
class Chunk:
    """Some documents as their distinct words and a slot per token: slot 0 is the start, which
    is no token itself, slot 1 the end."""

    words: list[bytes]  # of slots 2 and up
    slots: np.ndarray
    lengths: np.ndarray  # tokens of each document

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Chunk:
        tokens = [[*words_of(t), END] for t in texts]
        known: dict[bytes, int] = {START: 0, END: 1}
        for t in tokens:
            for w in t:
                known.setdefault(w, len(known))
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        slots = np.fromiter((known[w] for t in tokens for w in t), np.int64, int(lengths.sum()))
        return cls(list(known)[2:], slots, lengths)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, (START, END, *self.words)), np.uint64, len(self.words) + 2)

    def names(self) -> list[bytes]:
        return [START, END, *self.words]

    def before(self) -> np.ndarray:
        """The slot before each token."""
        out = np.zeros_like(self.slots)
        out[1:] = self.slots[:-1]
        out[np.cumsum(self.lengths)[:-1]] = 0
        return out

    def columns(self) -> dict[str, bytes]:
        return {
            "words": squeezed(b" ".join(self.words)),
            "slots": packed(self.slots, 4),
            "lengths": packed(self.lengths, 8),
        }

    @classmethod
    def read(cls, words: bytes, slots: bytes, lengths: bytes) -> Chunk:
        return cls(released(words).split(), unpacked(slots, 4).astype(np.int64), unpacked(lengths, 8).astype(np.int64))


CHUNKS = "chunk long, size long, words binary, slots binary, lengths binary, docs binary"


def chunks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side: chunks of documents as rows."""
    parts: list[pa.RecordBatch] = []
    held = 0

    def row() -> pa.RecordBatch:
        docs = pa.Table.from_batches(parts)
        rest = docs.drop_columns(["bytes"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_table(rest)
        made = Chunk.of(docs.column("bytes").to_pylist()).columns()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().int >> 65], pa.int64()),
                pa.array([held], pa.int64()),
                *[pa.array([made[c]], pa.binary()) for c in ("words", "slots", "lengths")],
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            ],
            ["chunk", "size", "words", "slots", "lengths", "docs"],
        )

    for batch in slices(batches):
        parts.append(batch)
        held += sum(len(t or b"") for t in batch.column("bytes").to_pylist())
        if held >= HELD_BYTES:
            yield row()
            parts.clear()
            held = 0
    if parts:
        yield row()


def text_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of the documents (doc_id, held_out, text), written, so that their names stay; texts
    are split into words once."""
    source = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("bytes"))
    return written(source.mapInArrow(chunks_of, CHUNKS), "lm-chunks")


COUNTS = "shard int, kind string, keys binary, counts binary"


def packed_counts(shards: int):
    """Task side: each chunk's counts of its training tokens by shard, as packed arrays."""

    def rows(chunk: Chunk, docs: bytes) -> Iterator[tuple[int, str, bytes, bytes]]:
        held = pa.ipc.open_stream(docs).read_all().column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        taught = np.repeat(~held, chunk.lengths)
        h = chunk.hashes()
        keys, n = np.unique(pair_keys(h[chunk.before()], h[chunk.slots])[taught], return_counts=True)
        order, cuts = by_shard(keys, shards)
        keys, n = keys[order], n[order]
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            mine = slice(cuts[s], cuts[s + 1])
            yield s, "pair", packed_keys(keys[mine]), packed(n[mine], 4)
        times = np.bincount(chunk.slots[taught], minlength=len(h))
        names = chunk.names()
        found = np.flatnonzero(times)
        shard = shard_of(word_keys(h[found]), shards)
        order = np.argsort(shard, kind="stable")
        found, cuts = found[order], np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            mine = found[cuts[s] : cuts[s + 1]]
            yield s, "word", squeezed(b" ".join([names[k] for k in mine.tolist()])), packed(times[mine], 8)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, slots, lengths, docs in zip(*(batch.column(c) for c in ("words", "slots", "lengths", "docs")), strict=True):
                out = list(rows(Chunk.read(words.as_py(), slots.as_py(), lengths.as_py()), docs.as_py()))
                sides = list(zip(*out, strict=True)) or [[]] * 4
                kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(sides, kinds, strict=True)], ["shard", "kind", "keys", "counts"]
                )

    return count


SHARDS = "kind string, word binary, n long, data binary"


def shard_tables(shards: int):
    """Shard side: exact word counts, and the shard's segment of the filter."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        words: Counter = Counter()
        pairs: list[np.ndarray] = [np.zeros(0, np.uint64)]
        times: list[np.ndarray] = [np.zeros(0, np.uint64)]
        for kind, keys, counts in zip(*(rows.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
            if kind == "pair":
                pairs.append(unpacked_keys(keys))
                times.append(unpacked(counts, 4))
            else:
                for w, n in zip(released(keys).split(b" "), unpacked(counts, 8).tolist(), strict=True):
                    words[w] += n
        all_keys, all_times = np.concatenate(pairs), np.concatenate(times)
        order = np.argsort(all_keys, kind="stable")
        all_keys, all_times = all_keys[order], all_times[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(all_keys) else np.zeros(0, np.int64)
        summed = np.add.reduceat(all_times, first) if len(all_keys) else all_times
        names = list(words)
        own = word_keys(np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))) & LOW
        data = segment(
            np.concatenate([all_keys[first], own]),
            np.concatenate([summed, np.fromiter(words.values(), np.int64, len(names))]),
        )
        n = len(names)
        return pa.table(
            {
                "kind": pa.array(["word"] * n + [f"filter {key[0].as_py()}"]),
                "word": pa.array([*names, None], pa.binary()),
                "n": pa.array([*words.values(), None], pa.int64()),
                "data": pa.array([None] * n + [data.tobytes()], pa.binary()),
            }
        )

    return merge


@dataclass
class Model:
    counted: DataFrame  # (word, n): exact counts of the training tokens
    segments: DataFrame  # (shard, data): the filter, a row per shard
    shards: int
    total: int
    distinct: int
    head: dict[bytes, int]

    def denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def fit_model(chunks: DataFrame) -> Model:
    """Learns from the chunks' documents that are not held out."""
    shards = (chunks.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES + 1
    counts = chunks.select("words", "slots", "lengths", "docs").mapInArrow(packed_counts(shards), COUNTS)
    merged = written(counts.groupBy("shard").applyInArrow(shard_tables(shards), SHARDS), "lm-counts")
    counted = merged.where("kind = 'word'").select("word", "n")
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = int(sums[0]), int(sums[1])
    least = max(1, math.ceil(HEAD_SHARE * total))
    head = {bytes(r["word"]): r["n"] for r in counted.where(F.col("n") >= least).toLocalIterator()}
    segments = merged.where("kind like 'filter %'").select(
        F.substring_index("kind", " ", -1).cast("int").alias("shard"), "data"
    )
    return Model(counted, segments, shards, total, distinct, head)


class Questions:
    """The distinct words and pairs of a chunk, by shard, and where each token needs them."""

    def __init__(self, chunk: Chunk, shards: int):
        h, before = chunk.hashes(), chunk.before()
        pairs, back = np.unique(pair_keys(h[before], h[chunk.slots]), return_inverse=True)
        # The start token itself isn't counted; as many texts start as end.
        self.context, self.word, self.pair = np.where(before == 0, 1, before), chunk.slots, len(h) + back
        keys = np.concatenate([word_keys(h), pairs])
        self.order, self.cuts = by_shard(keys, shards)
        self.keys = keys[self.order]


ASKED = "chunk long, shard int, keys binary"


def asking(shards: int):
    """Task side: for each shard the keys that a chunk asks for."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *sides in zip(*(batch.column(c) for c in ("chunk", "words", "slots", "lengths")), strict=True):
                asked = Questions(Chunk.read(*[x.as_py() for x in sides]), shards)
                cuts = asked.cuts.tolist()
                some = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name.as_py()] * len(some), pa.int64()),
                        pa.array(some, pa.int32()),
                        pa.array([packed_keys(asked.keys[cuts[s] : cuts[s + 1]]) for s in some], pa.binary()),
                    ],
                    ["chunk", "shard", "keys"],
                )

    return ask


def answer(key: tuple, asked: pa.Table, segments: pa.Table) -> pa.Table:
    """Shard side: the levels of the keys that each chunk asks for."""
    data = [np.frombuffer(d, np.uint8) for d in segments.column("data").to_pylist()]
    held = LogFrequencyFilter(data[0], np.array([0]), np.array([len(data[0])])) if data else None
    levels: list[bytes] = []
    some: list[np.ndarray] = []

    def look_up() -> None:
        # N-grams that several chunks ask for are looked up once.
        keys, back = np.unique(np.concatenate(some), return_inverse=True)
        found = (held.levels(keys) if held else np.zeros(len(keys), np.int64)).astype(np.uint8)[back]
        levels.extend(squeezed(x) for x in np.split(found, np.cumsum([len(k) for k in some])[:-1]))
        some.clear()

    for keys in asked.column("keys"):
        some.append(unpacked_keys(keys.as_py()))
        if sum(map(len, some)) >= LOOKED_UP:
            look_up()
    if some:
        look_up()
    return pa.table({"chunk": asked.column("chunk"), "shard": asked.column("shard"), "levels": pa.array(levels, pa.binary())})


LEVELLED = "doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<binary>, triples binary"


def levelled(chunks: DataFrame, doc_id: str, model: Model) -> DataFrame:
    """A row per document: its base score without the rare words, the rare words, and for each
    token the levels of context, pair and word as one number. `doc_id` is the type of the id."""
    sent = chunks.sparkSession.sparkContext.broadcast({w: math.log10(n + 0.5) for w, n in model.head.items()})
    shards = model.shards
    schema = f"doc_id {doc_id}, " + LEVELLED.split(", ", 1)[1]
    # Keys are made again rather than written.
    answers = (
        chunks.select("chunk", "words", "slots", "lengths").mapInArrow(asking(shards), ASKED).groupBy("shard")
        .cogroup(model.segments.groupBy("shard"))
        .applyInArrow(answer, "chunk long, shard int, levels binary")
    )

    def put_together(key: tuple, chunk: pa.Table, answered: pa.Table) -> pa.Table:
        logs = sent.value
        made = Chunk.read(*[chunk.column(c)[0].as_py() for c in ("words", "slots", "lengths")])
        asked = Questions(made, shards)
        by_shard = answered.sort_by("shard").column("levels").to_pylist()
        level = np.zeros(len(asked.keys), np.uint8)
        level[asked.order] = np.frombuffer(b"".join(map(released, by_shard)), np.uint8)
        level = level.astype(np.int64)
        triples = triple(level[asked.context], level[asked.pair], level[asked.word]).astype("<u8")
        log = np.array([logs.get(w, math.nan) for w in made.names()])[made.slots]
        lengths = made.lengths
        ends = np.cumsum(lengths)
        starts = ends - lengths
        is_rare = np.isnan(log)
        at = np.flatnonzero(is_rare)
        cuts = np.searchsorted(at, np.append(starts, ends[-1]))
        names = made.names()
        rare = [names[k] for k in made.slots[at].tolist()]
        out = pa.ipc.open_stream(chunk.column("docs")[0].as_py()).read_all()
        return pa.table(
            {
                "doc_id": out.column("doc_id"),
                "held_out": out.column("held_out"),
                "n_tokens": pa.array(lengths, pa.int64()),
                "known": pa.array(lengths - np.diff(cuts), pa.int64()),
                "base": pa.array(np.add.reduceat(np.where(is_rare, 0.0, log), starts), pa.float64()),
                "rare": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rare, pa.binary())),
                "triples": pa.array([planes(triples[i:j], 3).tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
            }
        )

    return written(
        chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(put_together, schema),
        "lm-levels",
        compression="zstd",
    )


def triples_of(data: bytes) -> np.ndarray:
    """The numbers of a document's tokens."""
    return from_planes(np.frombuffer(data, np.uint8), 3).astype(np.int64)


def triple(context: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (context * (LEVELS + 1) + pair) * (LEVELS + 1) + word


def apart(triples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, word = np.divmod(triples, LEVELS + 1)
    return *np.divmod(left, LEVELS + 1), word


def pair_share(counts: np.ndarray, context: np.ndarray, pair: np.ndarray, off: float = 0.0) -> np.ndarray:
    both = np.maximum(counts[pair] - off, 0.0)
    return both / np.maximum(np.maximum(counts[context] - off, both), 1.0)


def count_triples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((LEVELS + 1) ** 3, np.int64)
    for batch in slices(batches):
        found = np.concatenate([np.zeros(0, np.int64), *map(triples_of, batch.column("triples").to_pylist())])
        codes, n = np.unique(found, return_counts=True)
        sums[codes] += n
    codes = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums[codes])], ["code", "n"])


def fit_weights(training: DataFrame, denominator: float) -> np.ndarray:
    """Interpolation weight for each context level: expectation steps over all training tokens,
    each left out. Tokens of the same three levels are one row of a table of bounded size."""
    weights = np.full(LEVELS + 1, 0.3)
    weights[0] = 0.0
    rows = (
        training.select("triples").mapInArrow(count_triples, "code long, n long")
        .groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    )
    if not rows:
        return weights
    codes, n = (np.array([r[c] for r in rows], np.int64) for c in ("code", "n"))
    context, pair, word = apart(codes)
    counts = level_counts()
    near = pair_share(counts, context, pair, 1.0)
    alone = (np.maximum(counts[word] - 1.0, 0.0) + 0.5) / denominator
    for _ in range(20):
        l = weights[context]
        post = n * l * near / (l * near + (1 - l) * alone)
        # One imagined token with a share of 0.3 keeps rare levels off the ends.
        sums = np.bincount(context, post, LEVELS + 1) + 0.3
        weights = sums / (np.bincount(context, n, LEVELS + 1) + 1.0)
        weights[0] = 0.0
    return weights


def score_text(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of the rows
    (doc_id, held_out, text); those not held out are the training rows."""
    chunks = text_chunks(docs)
    model = fit_model(chunks)
    denominator = model.denominator()
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    rows = levelled(chunks, doc_id, model)
    weights, counts = fit_weights(rows.where(~F.col("held_out")), denominator), level_counts()
    schema = f"doc_id {doc_id}, " + SCORED.split(", ", 1)[1]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [triples_of(t) for t in batch.column("triples").to_pylist()]
            ends = np.cumsum([len(p) for p in parts])
            codes, back = np.unique(np.concatenate(parts), return_inverse=True)
            context, pair, word = apart(codes.astype(np.int64))
            l = weights[context]
            p = l * pair_share(counts, context, pair) + (1 - l) * (counts[word] + 0.5) / denominator
            scores = np.add.reduceat(np.log10(p)[back], ends - [len(x) for x in parts])
            yield appended(batch.drop_columns(["triples"]), score=pa.array(scores, pa.float64()))

    # Written, so that the row numbers stay.
    scored = written(rows.mapInArrow(score, schema).withColumn("uid", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("uid", F.explode("rare").alias("word")).join(model.counted, "word", "left")
    sums = rare.groupBy("uid").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("found")
    )
    return scored.drop("rare").join(sums, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(denominator))).alias("base_score"),
        "score",
    )


SCORED = "doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<binary>, score double"


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of(doc_id), F.lit(5)) == 1


def op9_lm_scoring(docs: DataFrame) -> DataFrame:
    return score_text(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")))
