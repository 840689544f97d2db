"""Language identification by hyperdimensional profiles.

Every letter has a random vector of plus and minus one. A trigram is the product of its
letters' vectors, each rotated by its place; a text is the sum of its trigrams; a language is
the sum of its training texts. A text gets the language whose prototype has the largest cosine
with it. Letters are folded to lower case; every stretch of other characters is one blank.

Prototypes are summed where the rows are: what reaches the driver is dimensions times
languages. No column but the text enters a prediction.

Defined cases: null text, or one without letters, is `und` with score 0; without training rows
every text is `und`; equal cosines go to the first language by name; rows without a language
teach nothing; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from meterline.llm.common import appended, crc_of, slices

DIMENSIONS = 1024
#: Letters a-z have symbols of their own, other letters share the rest; 0 is the blank.
SYMBOLS = 64
SEED = 20_011
UNDETERMINED = "und"


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x30000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return table


@lru_cache(1)
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the symbols at the first, second and third place of a trigram."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    v = (rng.integers(0, 2, (SYMBOLS, DIMENSIONS)) * 2 - 1).astype(np.int8)
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    s = symbol_table()[points]
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate([[0], s, [0]]).astype(np.int32)
    s = s[np.append((s[1:] != 0) | (s[:-1] != 0), True)]
    codes = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    return np.unique(codes, return_counts=True)


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' vectors."""
    first, second, third = letter_vectors()
    total = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(codes), 4096):
        c, n = codes[at : at + 4096], counts[at : at + 4096]
        vectors = first[c // SYMBOLS**2] * second[c // SYMBOLS % SYMBOLS] * third[c % SYMBOLS]
        total += n.astype(np.float32) @ vectors.astype(np.float32)
    return total


def prototypes(training: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The bundled vector of every language of the training rows."""
    slim = training.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for k, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes, counts = trigrams(t)
                if k not in counted:
                    counted[k] = np.zeros(SYMBOLS**3, np.int64)
                counted[k][codes] += counts
        for k, c in counted.items():
            codes = np.flatnonzero(c)
            vector = np.rint(bundle(codes, c[codes])).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {"lang": [k] * DIMENSIONS, "d": np.arange(DIMENSIONS), "v": vector}
            )

    rows = slim.mapInArrow(sums, "lang string, d long, v long").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in rows.collect():
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["d"]] = r["v"]
    return {k: v for k, v in sorted(out.items()) if v.any()}


def predict_language(
    docs: DataFrame, known: dict[str, np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """All rows and columns, the predicted language and its cosine (0 to 1)."""
    schema = StructType([f for f in docs.schema.fields if f.name not in (pred, score)])
    schema = schema.add(pred, StringType()).add(score, DoubleType())
    column = docs.columns.index(text)
    names = list(known)
    units = np.array([v / np.linalg.norm(v) for v in known.values()]).reshape(len(names), DIMENSIONS)

    def one(value: str | None) -> tuple[str, float]:
        codes, counts = trigrams(value or "")
        if not len(codes) or not names:
            return UNDETERMINED, 0.0
        vector = bundle(codes, counts)
        size = np.linalg.norm(vector)
        cosines = units @ vector / size if size else np.zeros(len(names))
        best = int(np.argmax(cosines))
        return names[best], float(min(1.0, max(0.0, cosines[best])))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [one(t) for t in batch.column(column).to_pylist()]
            yield appended(
                batch,
                **{
                    pred: pa.array([f[0] for f in found], pa.string()),
                    score: pa.array([f[1] for f in found], pa.float64()),
                },
            )

    return docs.mapInArrow(add, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of(doc_id), F.lit(4)) == 2


def op4_language_id(docs: DataFrame) -> DataFrame:
    known = prototypes(docs.where(~held_out(F.col("doc_id"))))
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict_language(slim, known).select("doc_id", "held_out", "lang_pred", "score")
