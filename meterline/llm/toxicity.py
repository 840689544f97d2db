"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words map to a small alphabet: insult (with a learned weight), threat, target, negation,
report, other; signs end clauses. Five transducers read that alphabet: an insult scores its
weight; a threat scores when a target follows soon; a target shortly before or after an insult
raises it; a negation shortly before lowers it; a reporting word or an opening quote lowers all
that follows in the clause. They are composed into one automaton whose product states are built
when first reached. The scores of matched clauses give a text's features, and a logistic curve
turns them into a probability.

The insult lexicon is learned: words much more frequent in toxic rows than in others, by
the log-likelihood ratio over distinct neighbourhoods, so that copies of one text count once.
Learning reads at most `SAMPLE_ROWS` labelled rows (by hash of the id); scoring covers all rows
and reads the text alone.

Defined cases: null and empty texts have no matched clause and get the curve's lowest score;
without labels, or with one class only, the lexicon is empty and the score is the base rate
(0 without labels); labels that repeat an id count as often as they occur; null labels teach
nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from meterline.llm.common import appended, crc_of, slices, written

SAMPLE_ROWS = 20_000
MIN_RATIO = 30.0  # log-likelihood ratio of a lexicon word
MIN_PLACES = 4

# Words of the small classes in four languages.
THREATS = "kill hurt shoot stab beat destroy töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yourself u they them their he she him her du dich dein euch ihr sie tu toi te vous votre eux tú te ti usted ustedes ellos".split()
NEGATIONS = "not no never none nobody isn't aren't don't without nicht kein keine nie pas jamais aucun nunca ningún sin".split()
REPORTS = "said says say quoted quote wrote claimed called reported alleged accused sagte schrieb nannte behauptete dit écrit appelé cité dijo escribió llamó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words over which a negation, a target, a threat and an insult reach.
NEGATION_REACH, TARGET_REACH, THREAT_REACH, INSULT_REACH = 3, 4, 3, 3
NEGATED, REPORTED, TARGETED, THREAT_WEIGHT = 0.4, 0.6, 1.5, 2.0

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.;:!?\n]|[\"“”«»]")


def countdown(trigger: int, reach: int) -> Callable[[int, int], int]:
    """Transducer: words left since the class was last seen."""
    return lambda state, cls: reach if cls == trigger else max(0, state - 1)


def reported(state: int, cls: int) -> int:
    """Transducer: whether the clause reports what another one says."""
    return 1 if cls == REPORT else state


MACHINES = (
    countdown(NEGATION, NEGATION_REACH),
    countdown(TARGET, TARGET_REACH),
    countdown(THREAT, THREAT_REACH),
    countdown(INSULT, INSULT_REACH),
    reported,
)


class Grammar:
    """The composed automaton: (state, class) to (state, factor of an insult, factor added for
    the insult before, threat weight)."""

    def __init__(self):
        self.states: dict[tuple[int, ...], int] = {(0,) * len(MACHINES): 0}
        self.tuples = [(0,) * len(MACHINES)]
        self.moves: dict[tuple[int, int], tuple[int, float, float, float]] = {}

    def move(self, state: int, cls: int) -> tuple[int, float, float, float]:
        if (state, cls) not in self.moves:
            now = self.tuples[state]
            following = tuple(m(s, cls) for m, s in zip(MACHINES, now, strict=True))
            negated, target, threat, insult, report = now
            damp = (NEGATED if negated else 1.0) * (REPORTED if report else 1.0)
            factor = damp * (TARGETED if target else 1.0) if cls == INSULT else 0.0
            after = damp * (TARGETED - 1.0) if cls == TARGET and insult and not target else 0.0
            threatens = THREAT_WEIGHT * damp if cls == TARGET and threat else 0.0
            if following not in self.states:
                self.states[following] = len(self.tuples)
                self.tuples.append(following)
            self.moves[state, cls] = (self.states[following], factor, after, threatens)
        return self.moves[state, cls]


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    curve: tuple[float, ...]  # intercept and slopes

    def __post_init__(self):
        self.classes = {
            **dict.fromkeys(TARGETS, TARGET),
            **dict.fromkeys(NEGATIONS, NEGATION),
            **dict.fromkeys(REPORTS, REPORT),
            **dict.fromkeys(THREATS, THREAT),
            **dict.fromkeys(self.lexicon, INSULT),
        }
        self.grammar = Grammar()
        self.matters = set(self.lexicon) | set(THREATS)

    def clauses(self, text: str) -> list[tuple[float, str]]:
        """Score and words of each matched clause."""
        tokens = TOKEN.findall(text.lower())
        if self.matters.isdisjoint(tokens):
            return []
        out, state, total, before, words = [], 0, 0.0, 0.0, []
        move, classes = self.grammar.move, self.classes
        for t in [*tokens, "\n"]:
            if t in ".;:!?\n":
                if total > 0:
                    out.append((total, " ".join(words)))
                state, total, before, words = 0, 0.0, 0.0, []
                continue
            words.append(t)
            cls = REPORT if t in "\"“”«»" else classes.get(t, OTHER)
            state, factor, after, threat = move(state, cls)
            if factor:
                before = self.lexicon[t]
                total += factor * before
            total += after * before + threat
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        scores = [s for s, _ in self.clauses(text or "")]
        return (1.0 if scores else 0.0, max(scores, default=0.0), math.log1p(sum(scores)))

    def score(self, text: str | None) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def ratio(p: float, n: float, all_p: float, all_n: float) -> float:
    """Log-likelihood ratio of a word with p and n places in toxic and other text; negative if
    it is rarer in toxic text."""
    rate = (p + n) / (all_p + all_n)
    g = sum(2 * x * math.log(x / (rate * a)) for x, a in ((p, all_p), (n, all_n)) if x)
    return g if p * all_n > n * all_p else -g


def weight(p: float, n: float, all_p: float, all_n: float) -> float:
    return min(6.0, math.log((p + 0.5) / (n + 0.5) * (all_n + 1.0) / (all_p + 1.0)))


def neighbourhoods(batches: Iterable[pa.RecordBatch], among: set[str] | None) -> Iterator[pa.RecordBatch]:
    """Without `among`: rows in which each word occurs, by label. With it: distinct places."""
    held: Counter | set = Counter() if among is None else set()
    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            tokens = ["", *TOKEN.findall((text or "").lower()), ""]
            if among is None:
                held.update((w, 0, toxic) for w in set(tokens) if len(w) > 1)
                continue
            for k, w in enumerate(tokens):
                if w in among:
                    place = f"{tokens[k - 1]} {tokens[k + 1]}"
                    held.add((w, xxhash.xxh64_intdigest(place) >> 1, toxic))
    rows = [(*k, v) for k, v in held.items()] if among is None else [(*k, 1) for k in held]
    sides = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(sides, kinds, strict=True)], ["word", "place", "toxic", "n"]
    )


COUNTED = "word string, place long, toxic int, n long"


def by_word(rows: DataFrame, all_p: float, all_n: float) -> DataFrame:
    p = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0))
    n = F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    return rows.groupBy("word").agg(p.alias("p"), n.alias("q")).where(
        (F.col("p") >= MIN_PLACES) & (F.col("p") * all_n > 4 * F.col("q") * all_p)
    )


def learn_lexicon(sample: DataFrame, all_p: float, all_n: float) -> dict[str, float]:
    """Weights of the words that are clearly more frequent in toxic rows; how many there are is
    bounded by the sample."""
    first = by_word(sample.mapInArrow(lambda b: neighbourhoods(b, None), COUNTED), all_p, all_n)
    rate = (F.col("p") + F.col("q")) / (all_p + all_n)
    terms = [F.when(F.col(x) > 0, 2 * F.col(x) * F.ln(F.col(x) / (rate * a))).otherwise(0.0) for x, a in (("p", all_p), ("q", all_n))]
    among = {r["word"] for r in first.where(terms[0] + terms[1] >= MIN_RATIO).collect()}
    if not among:
        return {}
    places = sample.mapInArrow(lambda b: neighbourhoods(b, among), COUNTED)
    places = places.select("word", "place", "toxic").distinct().withColumn("n", F.lit(1))
    out = {}
    for r in by_word(places, all_p, all_n).collect():
        if ratio(r["p"], r["q"], all_p, all_n) >= MIN_RATIO:
            out[r["word"]] = weight(r["p"], r["q"], all_p, all_n)
    return dict(sorted(out.items()))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-2) -> tuple[float, ...]:
    """Newton steps of a penalised logistic regression; a row counts n times."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + penalty * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Learns from the labelled rows (doc_id, toxic) and the documents' texts.

    The labels are cut to `sample_rows`, so that they can be broadcast; as an id may repeat in the
    documents, the rows found are cut once more, by hash (rows that repeat id and text count as one
    there). The curve is fitted to counts of distinct features.
    """
    some = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    place = F.xxhash64("doc_id", "text").alias("place")
    found = written(
        docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic", place), "toxic-sample"
    )
    # Hashes alone are sorted.
    last = found.select("place").orderBy("place").limit(sample_rows).agg(F.max("place")).first()[0]
    sample = found.where(F.col("place") <= F.lit(last)).select("text", "toxic")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    all_p, all_n = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not all_p or not all_n:
        return Toxicity({}, (30.0 if all_p else -30.0, 0.0, 0.0, 0.0))
    model = Toxicity(learn_lexicon(sample, all_p, all_n), (0.0,) * 4)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([model.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_pydict(
                {"a": found[:, 0], "b": found[:, 1], "c": found[:, 2], "toxic": batch.column("toxic")}
            )

    made = sample.mapInArrow(features, "a double, b double, c double, toxic int")
    rows = np.array([tuple(r) for r in made.groupBy("a", "b", "c", "toxic").count().orderBy("a", "b", "c", "toxic").collect()], float)
    return Toxicity(model.lexicon, logistic(rows[:, :3], rows[:, 3], rows[:, 4]))


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """All rows and columns, and `score` and `predicted`."""
    names = ("score", "predicted")
    schema = StructType([f for f in docs.schema.fields if f.name not in names])
    schema = schema.add("score", DoubleType()).add("predicted", IntegerType())
    column = docs.columns.index(text)
    lexicon, curve = model.lexicon, model.curve

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Toxicity(lexicon, curve)
        for batch in slices(batches):
            scores = [own.score(t) for t in batch.column(column).to_pylist()]
            yield appended(
                batch,
                score=pa.array(scores, pa.float64()),
                predicted=pa.array([int(s >= 0.5) for s in scores], pa.int32()),
            )

    return docs.mapInArrow(add, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(crc_of(doc_id), F.lit(5)) == 0


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score_toxicity(slim, model).select("doc_id", "held_out", "score", "predicted")
