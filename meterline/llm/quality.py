"""Quality rules: how far a text's distributions are from those of its language.

References are learned from all rows with a language: the histogram of character classes,
and that of the language's most common short words with one bin for all other words. A text
is compared with every reference by the Jensen-Shannon distance (base 2, 0 to 1), and the
nearest reference counts, so that a missing or wrong language does no harm. Texts with large
shares of symbols or capitals are no part of a reference. Texts shorter than the guards are
not compared. Fixed counts (words, symbols, repeated lines and windows)
give the base rule.

Defined cases: null text has no words and fails the base rule; rows without a language are
judged but teach nothing; a table without any language, or without rows, has no references,
and the base rule alone decides; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from meterline.llm.common import appended, fresh_name, slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Guards: shorter texts are not compared by characters, by words.
MIN_CHARS_COMPARED = 100
MIN_WORDS_COMPARED = 40
#: A histogram of n words is off by about 1 / sqrt(n) by chance; what both distances have above
#: that may sum up to this.
MAX_EXCESS = 0.36
#: Texts with larger shares of symbols or capitals are no part of a reference.
MAX_TAUGHT_SYMBOLS = 0.02
MAX_TAUGHT_UPPER = 0.3
COMMON_WORDS = 50
COMMON_LENGTH = 5  # code points of a word that can be a common one
CLASSES = ("blank", "lower", "upper", "digit", "stop", "symbol", "other")
EDGE = ".,;:!?()[]{}\"'`#*$%&|<>-_=+/\\~^@"
#: Words that a task counts before it hands on its counts.
HELD_WORDS = 200_000


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        if c in SYMBOLS:
            kinds[cp] = 5
        elif cp in (32, *range(9, 14)):
            kinds[cp] = 0
        elif c.isupper():
            kinds[cp] = 2
        elif c.isalpha():
            kinds[cp] = 1
        elif c.isdigit():
            kinds[cp] = 3
        elif c in ".,;:!?'\"()-":
            kinds[cp] = 4
    return kinds


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(class_table()[points], minlength=len(CLASSES))


def plain_words(text: str) -> list[str]:
    """Lower-case words without signs at their ends."""
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(kl) / 2)))


def teaches(words: list[str], kinds: np.ndarray) -> bool:
    """Whether a text is plain enough to be part of a reference."""
    named = dict(zip(CLASSES, kinds.tolist(), strict=True))
    letters = named["lower"] + named["upper"]
    return (
        len(words) >= MIN_WORDS
        and named["symbol"] <= MAX_TAUGHT_SYMBOLS * kinds.sum()
        and named["upper"] <= MAX_TAUGHT_UPPER * letters
    )


def counts_by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chars: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}
    totals: Counter = Counter()

    def rows(done: bool) -> pa.RecordBatch:
        out = [(lang, "w", w, n) for lang, ws in words.items() for w, n in ws.items()]
        if done:
            out += [(lang, "n", "", n) for lang, n in totals.items()]
            out += [(lang, "c", k, int(n)) for lang, c in chars.items() for k, n in zip(CLASSES, c, strict=True)]
        words.clear()
        sides = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(sides, kinds, strict=True)], ["lang", "kind", "item", "n"]
        )

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = plain_words(text)
            kinds = class_counts(text)
            if not teaches(found, kinds):
                continue
            chars[lang] = chars.get(lang, 0) + kinds
            totals[lang] += len(found)
            words.setdefault(lang, Counter()).update([w for w in found if len(w) <= COMMON_LENGTH])
        if sum(map(len, words.values())) > HELD_WORDS:
            yield rows(False)
    yield rows(True)


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[dict]:
    """Per language: the character-class histogram, the common words and their histogram.

    The rows that reach the driver are languages times (classes + common words).
    """
    slim = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    counted = slim.mapInArrow(counts_by_language, "lang string, kind string, item string, n long")
    summed = counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    kept = summed.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= COMMON_WORDS)
    by_lang: dict[str, dict[str, dict[str, int]]] = {}
    for r in kept.collect():
        by_lang.setdefault(r["lang"], {}).setdefault(r["kind"], {})[r["item"]] = r["n"]
    out = []
    for name, kinds in sorted(by_lang.items()):
        common = dict(sorted(kinds.get("w", {}).items(), key=lambda x: (-x[1], x[0])))
        total = sum(kinds.get("n", {}).values())
        out.append(
            {
                "lang": name,
                # Blanks are left out: their share depends on the words' length alone.
                "chars": np.array([kinds["c"].get(k, 0) for k in CLASSES[1:]], float),
                "words": {w: k for k, w in enumerate(common)},
                "counts": np.array([*common.values(), max(0, total - sum(common.values()))], float),
            }
        )
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words in windows that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total, reach = 0, 0
    for k, w in enumerate(windows):
        if times[w] > 1:
            total += k + WINDOW - max(k, reach)
            reach = k + WINDOW
    return total


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.split():
            if line in seen:
                n += 1
            seen.add(line)
    return n


def measures(text: str | None, known: list[dict]) -> dict:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    kinds = class_counts(text)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > 30 * len(words)
    row = {
        "n_words": len(words),
        "word_chars": int(kinds.sum() - kinds[0]),
        "n_symbols": int(kinds[5]),
        "n_dup_lines": duplicate_lines(raw),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "char_distance": None,
        "word_distance": None,
        "nearest_lang": None,
    }
    if known and kinds[1:].sum() >= MIN_CHARS_COMPARED:
        row["char_distance"] = min(distance(kinds[1:], r["chars"]) for r in known)
    if known and len(words) >= MIN_WORDS_COMPARED:
        times = Counter(plain_words(text))
        total = sum(times.values())
        best = None
        for r in known:
            hist = np.zeros(len(r["words"]) + 1)
            for w, k in r["words"].items():
                hist[k] = times.get(w, 0)
            hist[-1] = total - hist[:-1].sum()
            d = distance(hist, r["counts"]) if total else 1.0
            if best is None or d < best[0]:
                best = (d, r["lang"])
        row["word_distance"], row["nearest_lang"] = best
    both = None not in (row["char_distance"], row["word_distance"])
    far = both and row["char_distance"] + row["word_distance"] - 2 / math.sqrt(len(words)) > MAX_EXCESS
    row["kept"] = not failed and not far
    return row


MEASURES = (
    StructType()
    .add("n_words", LongType())
    .add("word_chars", LongType())
    .add("n_symbols", LongType())
    .add("n_dup_lines", LongType())
    .add("n_repeat_words", LongType())
    .add("base_failed", BooleanType())
    .add("char_distance", DoubleType())
    .add("word_distance", DoubleType())
    .add("nearest_lang", "string")
    .add("kept", BooleanType())
)


def quality_measures(docs: DataFrame, text: str = "text", lang: str = "lang", name: str = "quality") -> DataFrame:
    """All rows and columns, and a struct with the counts, distances and the verdict `kept`."""
    from meterline.llm.common import arrow_struct

    known = references(docs, text, lang)
    schema = StructType([*docs.schema.fields]).add(name, MEASURES)
    column = docs.columns.index(text)
    kind = arrow_struct(MEASURES)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measures(t, known) for t in batch.column(column).to_pylist()]
            yield appended(batch, **{name: pa.array(rows, kind)})

    return docs.mapInArrow(add, schema)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that pass, with their columns."""
    name = fresh_name(docs, "quality")
    return quality_measures(docs, text, lang, name).where(F.col(f"{name}.kept")).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def op3_quality_rules(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text", "lang")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_measures(slim).select("doc_id", *[f"quality.{c}" for c in fields])
