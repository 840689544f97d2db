"""Operators that learn: base columns by brute force, held-out accuracy, defined edge cases."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from meterline.llm import extract, language, quality, toxicity
from meterline.llm.common import table
from meterline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_DOCS = [
    (1, None, "en", "s", 0),
    (2, "", None, None, None),
    (None, "the same words again and again " * 40, "en", "s", 1),
    (3, "a", "de", "s", 1),
    (3, "a", "de", "s", 1),
    (4, "word " * 60_000, "en", "s", 300_000),
    (5, "\n \t  \U0001f600 12345 ###", "fr", "s", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, repeated rows, and names that operators use themselves."""
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(ODD_DOCS, SCHEMA)
    docs.selectExpr("*", "1 as quality", "'x' as _bytes", "2 as fp", "3 as uid", "4 as row", "5 as hits", "6 as score").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "a"), (None, "again and again")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, None, 1), (None, 1, 1), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>one<p>two"), (None, "u", "plain &amp; text")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "pages"):
        table(spark, sf, name).limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name not in ("op1_license_scan", "pipeline"):
        assert len(rows) == (4 if name.startswith("op10") else len(ODD_DOCS))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_clashing_columns_stay(spark, odd):
    docs = table(spark, odd, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd).columns == docs.columns


def test_quality_base_columns(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["op3_quality_rules"](spark, sf).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times, marked = Counter(windows), set()
        for i, x in enumerate(windows):
            if times[x] > 1:
                marked |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(w)
        assert r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(marked)
        failed = len(w) < 20 or 100 * len(marked) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    good = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    kept = {r["doc_id"]: r for r in QUERIES["op3_quality_rules"](spark, sf).collect()}
    judged = [(r["kept"], good[i]) for i, r in kept.items() if i in good and not r["base_failed"]]
    assert all(k for k, g in judged if g)
    assert np.mean([not k for k, g in judged if not g]) > 0.85


def test_distance():
    p = np.array([1.0, 0, 0])
    assert quality.distance(p, p) == 0
    assert quality.distance(p, np.array([0, 3.0, 0])) == pytest.approx(1)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op4_language_id"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98


def test_bundle_is_the_sum_of_bound_vectors():
    first, second, third = language.letter_vectors()
    s = language.symbol_table()
    wanted = np.zeros(language.DIMENSIONS)
    padded = [0, *[int(s[ord(c)]) for c in "Abca b"], 0]
    for x, y, z in zip(padded, padded[1:], padded[2:], strict=False):
        wanted += first[x].astype(int) * second[y] * third[z]
    assert np.array_equal(language.bundle(*language.trigrams("Abca  -- b!")), wanted)
    assert not len(language.trigrams("12 34")[0])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    rows = [r for r in QUERIES["op6_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in rows]) > 0.97


def test_grammar_composes():
    m = toxicity.Toxicity({"idiot": 2.0}, (0.0, 1.0, 1.0, 1.0))
    score = lambda t: sum(s for s, _ in m.clauses(t))
    plain = score("what an idiot")
    assert plain == 2.0
    assert score("you are an idiot") == plain * toxicity.TARGETED == score("idiot, you")
    assert score("not an idiot") == plain * toxicity.NEGATED
    assert score("he said an idiot") == pytest.approx(plain * toxicity.REPORTED * toxicity.TARGETED)
    assert score("i will kill you") == toxicity.THREAT_WEIGHT
    assert score("not this one. an idiot") == plain and score("a quiet day") == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<nav class="menu"><ul><li><a href="/">Home page</a></li><li><a>More</a></li></ul></nav>
<div class="cookie-banner">We use cookies to improve your stay on this site, please accept them all</div>
%s<footer>&copy; somebody, all rights reserved, contact us any time you like</footer></body></html>"""
BODY = """<h1>A &amp; B</h1><p>First   para<b>graph</b> with some words in it<br>and a break
<p>Second &lt;one&gt; that is also long enough to count</p>
<aside>Related: other things to read</aside><div class="ad">Buy now, cheap</div>
<form><input name=q><button>Go</button></form><p>Third and last paragraph of the text.</p>"""
COMMENTS = '<section id="comments"><p>Reader one: great article, thanks a lot for it</p></section>'
WANTED = (
    "A & B First paragraph with some words in it and a break Second <one> that is also long enough to count "
    "Third and last paragraph of the text."
)


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div class='post'>{}</div>", "<main><div>{}</div></main>"])
def test_extraction_of_a_page(frame):
    model = extract.Extractor({"nav": 6.0, "ul": 6.0, "li": 5.0, "footer": 6.0, "p": -5.0, "/p": -5.0}, 4.0)
    assert model.extract(PAGE % (frame.format(BODY) + COMMENTS)) == WANTED


def test_extraction_query(spark, sf):
    rows = {r["page_id"]: r for r in QUERIES["op10_html_extraction"](spark, sf).collect()}
    for p in table(spark, sf, "pages").collect():
        body = re.search(r"<article>(.*?)</article>", p["html"] or "", re.S)
        text = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", "\n", body[1])) if body else ""
        wanted = " ".join(html.unescape(text).split())
        assert rows[p["page_id"]]["text"] == wanted and rows[p["page_id"]]["n_chars"] == len(wanted)


def test_extraction_edges():
    model = extract.Extractor({}, 4.0)
    assert model.extract(None) == model.extract("") == model.extract("<p></p><br>") == ""
    assert model.extract("plain &eacute; text") == "plain é text"
    assert model.extract("<p>a<script>var x='</p>'</script> b</p><!-- no --><p>c") == "a b c"


def test_pipeline(spark):
    """Every stage on what the stage before it kept, against the operators' own queries."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    good = {r["doc_id"] for r in QUERIES["op3_quality_rules"](spark, sf).collect() if r["kept"]}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality_rules"](spark, docs, sf)
    assert {r["doc_id"] for r in first.collect()} == good and first.columns == docs.columns
    from meterline.llm.simhash import near_duplicates

    classes = {r["component_id"] for r in near_duplicates(first).collect()}
    result = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in result} <= classes
    assert len(result) >= 0.95 * len(classes)
    hits = QUERIES["op5_benchmark_decontamination"](spark, sf)
    dirty = {r["doc_id"] for r in hits.collect() if r["contaminated"]}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in result:
        assert "token = \"" not in r["text"]
        if r["doc_id"] not in dirty and "token = " not in before[r["doc_id"]]:
            assert r["text"] == before[r["doc_id"]] or "[secret]" in r["text"]
        assert r["n_tokens"] == len(r["token_ids"])
