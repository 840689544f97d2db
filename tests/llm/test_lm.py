"""LM scoring: nothing left out of the filter, its accuracy, and weights from all training rows."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import lm


def rows_of(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs.select("doc_id", "text", F.lit(False).alias("held_out"))


def test_no_ngram_is_left_out(spark, monkeypatch):
    """Every token's levels over many shards and chunks are at least those of the exact counts."""
    monkeypatch.setattr(lm, "SHARD_BYTES", 8_000)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 200) % 3000) for _ in range(100)]
    docs = rows_of(spark, texts).repartition(4)
    chunks = lm.text_chunks(docs)
    model = lm.fit_model(chunks)
    assert 8 < model.shards == model.segments.count()
    words, pairs = Counter(), Counter()
    tokens = [[lm.START, *lm.words_of(t.encode()), lm.END] for t in texts]
    for t in tokens:
        words.update(t[1:])
        pairs.update(zip(t[:-1], t[1:], strict=True))
    words[lm.START] = words[lm.END]
    level = lambda c: lm.level_of(np.array(c))
    above = total = 0
    for r in lm.levelled(chunks, "bigint", model).collect():
        t = tokens[r["doc_id"]]
        found = lm.apart(lm.triples_of(r["triples"]))
        exact = level([words[w] for w in t[:-1]]), level([pairs[p] for p in zip(t[:-1], t[1:], strict=True)]), level([words[w] for w in t[1:]])
        for f, e in zip(found, exact, strict=True):
            assert len(f) == len(e) and (f >= e).all()
            above, total = above + (f > e).sum(), total + len(f)
    assert above < 0.03 * total


def test_filter_accuracy():
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    data = lm.segment(keys, np.maximum(1, rng.zipf(1.5, 50_000) % 10_000).astype(np.int64))
    held = lm.LogFrequencyFilter(data, np.array([0]), np.array([len(data)]))
    assert (held.levels(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)) > 0).mean() < 0.013
    counts = np.arange(1, 100_000)
    assert (np.abs(lm.level_counts()[lm.level_of(counts)] / counts - 1) <= 0.3).all()


def test_weights_come_from_all_rows(spark):
    """Null rows and a large group of copies don't take the place of others."""
    rng = np.random.default_rng(8)
    some = [" ".join(f"w{x}" for x in rng.zipf(1.5, 60) % 500) for _ in range(1500)]
    texts = [None] * 1500 + ["the same text of a group"] * 1500 + some
    docs = rows_of(spark, texts)
    chunks = lm.text_chunks(docs)
    model = lm.fit_model(chunks)
    levels = lm.levelled(chunks, "bigint", model)
    weights = lm.fit_weights(levels, model.denominator())
    found = np.concatenate([lm.triples_of(r["triples"]) for r in levels.collect()])
    context, pair, word = lm.apart(found)
    counts = lm.level_counts()
    near = lm.pair_share(counts, context, pair, 1.0)
    alone = (np.maximum(counts[word] - 1, 0) + 0.5) / model.denominator()
    wanted = np.where(np.arange(lm.LEVELS + 1) > 0, 0.3, 0.0)
    for _ in range(20):
        post = wanted[context] * near / (wanted[context] * near + (1 - wanted[context]) * alone)
        wanted = (np.bincount(context, post, lm.LEVELS + 1) + 0.3) / (np.bincount(context, minlength=lm.LEVELS + 1) + 1)
        wanted[0] = 0.0
    assert weights == pytest.approx(wanted, rel=1e-6)
    assert (np.abs(weights[np.unique(context)] - 0.3) > 1e-3).all() and math.isclose(weights[0], 0.0)


def test_packing_loses_nothing():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    order, cuts = lm.by_shard(keys, 7)
    assert sorted(order.tolist()) == list(range(5000))
    for s in range(7):
        mine = keys[order[cuts[s] : cuts[s + 1]]]
        assert (lm.shard_of(mine, 7) == s).all()
        assert (lm.unpacked_keys(lm.packed_keys(mine)) == mine & lm.LOW).all()
    assert (lm.unpacked(lm.packed(np.arange(300), 2), 2) == np.arange(300)).all()
    assert len(lm.unpacked_keys(lm.packed_keys(keys[:0]))) == 0
    texts = [b"One two one", None, b"", "caf\u00e9 ONE".encode()]
    chunk = lm.Chunk.of(texts)
    again = lm.Chunk.read(*chunk.columns().values())
    names = [lm.START, lm.END, *again.words]
    found = [names[k] for k in again.slots]
    assert found == [w for t in texts for w in (*lm.words_of(t), lm.END)]
    assert again.lengths.tolist() == [4, 1, 1, 3]


def test_probabilities_of_a_vocabulary_sum_to_about_one(spark):
    """All words after a context: quantised counts over an exact denominator stay near 1."""
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.4, 100) % 300) for _ in range(400)]
    words = sorted({w for t in texts for w in t.split()})
    docs = rows_of(spark, texts)
    chunks = lm.text_chunks(docs)
    model = lm.fit_model(chunks)
    denominator = model.denominator()
    weights = lm.fit_weights(lm.levelled(chunks, "bigint", model), denominator)
    segments = {r["shard"]: np.frombuffer(r["data"], np.uint8) for r in model.segments.collect()}
    assert list(segments) == [0]
    held = lm.LogFrequencyFilter(segments[0], np.array([0]), np.array([len(segments[0])]))
    h = np.array([lm.xxhash.xxh64_intdigest(w.encode()) for w in words] + [lm.xxhash.xxh64_intdigest(lm.END)], np.uint64)
    counts, word = lm.level_counts(), held.levels(lm.word_keys(h) & lm.LOW)
    for v in (0, 5, 50):
        pair = held.levels(lm.pair_keys(np.full(len(h), h[v]), h) & lm.LOW)
        context = np.full(len(h), word[v])
        share = weights[context]
        p = share * lm.pair_share(counts, context, pair) + (1 - share) * (counts[word] + 0.5) / denominator
        assert 0.8 < p.sum() < 1.25
