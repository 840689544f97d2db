"""Fill-in-the-middle: texts cut in three at token boundaries, put in another order.

The token boundaries of a text are a set of code-point offsets, held as Roaring does it: offsets
with the same upper bits share a container, which is a sorted array, a bitmap with counts per
word, or runs with counts per run, whichever is smallest; the containers carry cumulative
cardinalities. The k-th boundary is found by a search over the containers and a select inside one.
The same set over the bytes at which code points start turns such an offset into a byte offset,
so that texts are cut without being decoded.

A text is cut after a random number of tokens twice. The draws come from the SHA-256 of seed and
id, so that they are the same in every run and under any partitioning. Texts that hold a marker
are left as they are (form `plain`), and the original is rebuilt from the output and its form.

Defined cases: null text is empty, and an empty text is `plain`; a null id draws like an empty
one; rows that repeat an id draw the same numbers and are cut by their own texts; very long texts
take about five bytes of memory a byte; an empty table gives no rows. All columns stay; a column
that has the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from meterline.llm.common import appended, arrow_struct, fresh_name, once, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, so many are cut, and so many of those have the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
SPAN = 1 << 16  # offsets that share a container


class ArrayContainer:
    """Sorted offsets of few members."""

    def __init__(self, flags: np.ndarray):
        self.members = np.flatnonzero(flags).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.members[k])


class BitmapContainer:
    """A bit for each offset, and the members before each word of 64 bits."""

    def __init__(self, flags: np.ndarray):
        bits = np.packbits(flags, bitorder="little")
        self.words = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # drops the lowest member
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    """First members of runs, and the members before each run."""

    def __init__(self, flags: np.ndarray):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
        self.starts, ends = edges[::2], edges[1::2]
        self.before = np.concatenate([[0], np.cumsum(ends - self.starts)])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(flags: np.ndarray, members: int) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form: two bytes a member, four bytes a run, or a bit an offset."""
    runs = int(flags[0]) + int(np.count_nonzero(flags[1:] > flags[:-1]))
    sizes = {RunContainer: 2 + 4 * runs, ArrayContainer: 2 * members, BitmapContainer: SPAN // 8}
    return min(sizes, key=sizes.get)(flags)


class BoundarySet:
    """A set of offsets, made of flags; `select(k)` is the k-th one, counted from 0."""

    def __init__(self, flags: np.ndarray):
        parts = [flags[at : at + SPAN] for at in range(0, len(flags), SPAN)]
        members = [int(np.count_nonzero(p)) for p in parts]
        held = [k for k, n in enumerate(members) if n]
        self.containers = [container(parts[k], members[k]) for k in held]
        self.bases = [k * SPAN for k in held]
        self.before = np.concatenate([[0], np.cumsum([members[k] for k in held], dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return self.bases[at] + self.containers[at].select(k - int(self.before[at]))


def boundaries(text: bytes) -> tuple[BoundarySet, BoundarySet]:
    """Token boundaries of a UTF-8 text as code points (start and end included), and the bytes
    at which code points start (end included). A token is a run of A-Z and a-z, or one other
    code point."""
    raw = np.frombuffer(text, np.uint8)
    letter = ((raw | 32) - np.uint8(97)) < 26
    point = (raw & 0xC0) != 0x80
    point[:1] = True
    begins = point.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return BoundarySet(np.append(begins[point], True)), BoundarySet(np.append(point, True))


def fill(text: bytes, draws: tuple[int, int, int, int]) -> tuple[bytes, int, str, int | None, int | None]:
    """Output, tokens, form, code points of prefix and middle."""
    tokens, points = boundaries(text)
    n = len(tokens) - 1
    marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or draws[2] % 100 >= CUT_SHARE:
        return text, n, "plain", None, None
    first, second = (tokens.select(k) for k in sorted(d % (n + 1) for d in draws[:2]))
    i, j = points.select(first), points.select(second)
    prefix, middle, suffix = PREFIX + text[:i], MIDDLE + text[i:j], SUFFIX + text[j:]
    form = "spm" if draws[3] % 100 < SUFFIX_FIRST_SHARE else "psm"
    head = suffix + prefix if form == "spm" else prefix + suffix
    return head + middle, n, form, first, second - first


FILLED = (
    StructType()
    .add("output", StringType())
    .add("n", LongType())
    .add("form", StringType())
    .add("prefix_chars", LongType())
    .add("middle_chars", LongType())
)


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "1", name: str = "fim"
) -> DataFrame:
    """All rows and columns, and a struct of the output, its tokens, form and cuts."""
    drawn = fresh_name(docs, "_draws")
    own_id = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    source = docs.withColumn(drawn, F.sha2(F.concat(F.lit(f"{seed}:"), own_id).cast("binary"), 256))
    schema = StructType([f for f in docs.schema.fields if f.name != name]).add(name, FILLED)
    kind = arrow_struct(FILLED)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            digests = batch.column(drawn).to_pylist()
            rows = [
                fill(t or b"", tuple(int(d[k : k + 8], 16) for k in range(0, 32, 8)))
                for t, d in zip(texts, digests, strict=True)
            ]
            sides = list(zip(*rows, strict=True))
            # Cut at code points, the bytes are as valid as they were.
            arrays = [pa.array(sides[0], pa.binary()).view(pa.string())]
            arrays += [pa.array(s, t.type) for s, t in zip(sides[1:], list(kind)[1:], strict=True)]
            kept = batch.select([c for c in batch.schema.names if c not in (drawn, name)])
            yield appended(kept, **{name: pa.StructArray.from_arrays(arrays, fields=list(kind))})

    return source.mapInArrow(add, schema)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. No cut text holds a marker, so that the markers
    of an output are its own."""
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )


def op11_fill_in_middle(docs: DataFrame) -> DataFrame:
    filled = fill_in_middle(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    rebuilt = once(filled, original=restored(F.col("output"), F.col("form")))
    return rebuilt.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("original").cast("binary"), 256).alias("restored_sha256"),
    )
