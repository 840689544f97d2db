"""Fill-in-the-middle: the boundary set against plain lists, outputs against a brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from meterline.llm import fim
from meterline.llm.common import table
from meterline.llm.queries import QUERIES

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def starts(text: str) -> list[int]:
    return [m.start() for m in TOKEN.finditer(text)] + [len(text)]


def wanted(doc_id: int | None, text: str) -> tuple:
    tokens = TOKEN.findall(text)
    n = len(tokens)
    name = "" if doc_id is None else doc_id
    h = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    draws = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    i, j = sorted(d % (n + 1) for d in draws[:2])
    p, m, s = ("".join(x) for x in (tokens[:i], tokens[i:j], tokens[j:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= 90:
        return n, "plain", None, None, text
    if draws[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abZ <P>SM.é中\U0001f600\n\x00"), max_size=40))
def test_boundaries(text):
    tokens, points = fim.boundaries(text.encode())
    assert [tokens.select(k) for k in range(len(tokens))] == starts(text)
    sizes = np.cumsum([0] + [len(c.encode()) for c in text]).tolist()
    assert [points.select(k) for k in range(len(points))] == sizes


@pytest.mark.parametrize("kind", [fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer])
def test_each_container_selects(kind):
    flags = np.random.default_rng(1).random(5000) < 0.3
    held = kind(flags)
    assert [held.select(k) for k in range(int(flags.sum()))] == np.flatnonzero(flags).tolist()


def test_containers_are_the_smallest():
    one = np.zeros(fim.SPAN, bool)
    one[5] = True
    mixed = np.arange(fim.SPAN) % 3 == 0
    kinds = [type(fim.container(f, int(f.sum()))) for f in (one, mixed, np.ones(fim.SPAN, bool))]
    assert kinds == [fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer]


def test_very_long_text_crosses_containers():
    parts = ["ab é " * 30_000, ("x" * 100 + " ") * 1_500, "x" * 150_000, "1, " * 40_000, "中" * 70_000, "end of it"]
    text = "".join(parts)
    tokens, points = fim.boundaries(text.encode())
    assert len({type(c) for c in tokens.containers}) == 3
    all_starts = starts(text)
    assert len(tokens) == len(all_starts)
    for k in [0, 1, 70_000, 99_999, 150_001, len(all_starts) - 2, len(all_starts) - 1]:
        assert tokens.select(k) == all_starts[k]
        assert points.select(all_starts[k]) == len(text[: all_starts[k]].encode())
    with pytest.raises(IndexError):
        tokens.select(len(all_starts))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op11_fill_in_middle"](spark, sf).collect()
    assert len(rows) == len(texts)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        n, form, prefix, middle, output = wanted(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r)[:5] == (r["doc_id"], n, form, prefix, middle)
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(output), sha(texts[r["doc_id"]]))


def test_odd_rows_are_restored(spark):
    texts = [None, "", "a", "a<S>b", "<<P", "<S", "P>", "é" * 5, "same", "same", "x\r\n\x00y", "  end"]
    ids = [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    docs = spark.createDataFrame(
        [(i, t, "held", 1) for i, t in zip(ids * 9, texts * 9, strict=True)],
        "doc_id long, text string, fim string, _draws int",
    )
    docs = docs.selectExpr("doc_id + (monotonically_increasing_id() % 9) * 100 AS doc_id", "text", "fim", "_draws")
    filled = fim.fill_in_middle(docs)
    assert filled.columns == ["doc_id", "text", "_draws", "fim"]
    checked = filled.withColumn("back", fim.restored(filled["fim.output"], filled["fim.form"])).collect()
    assert len(checked) == len(texts) * 9
    for r in checked:
        n, form, prefix, middle, output = wanted(r["doc_id"], r["text"] or "")
        assert tuple(r["fim"]) == (output, n, form, prefix, middle)
        assert r["back"] == (r["text"] or "")


def test_other_seeds_draw_other_cuts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    one, two = (fim.fill_in_middle(docs, seed=s).select("doc_id", "fim.*").collect() for s in "12")
    assert sorted(r["doc_id"] for r in one) == sorted(r["doc_id"] for r in two)
    assert {tuple(r) for r in one} != {tuple(r) for r in two}
