"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores plus one, a tag minus the penalty of its
name and classes; words of furniture (navigation, adverts, forms, comments, ...) score slightly
below zero. One linear scan finds the contiguous region with the largest sum; inside
it furniture is left out. Penalties come from labelled pages: a page with one `article` or
`main` element says itself where its text is. The log-odds of a tag's features outside and
inside of those elements, times a scale fitted on the same pages, are the penalties. Learning
reads at most `SAMPLE_PAGES` pages (by hash of id and page; rows that repeat both count as one); extraction covers all pages.

Text: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by one space in page order; nothing is cut.

Defined cases: null or empty html has empty text; a page without any word has empty text;
unclosed and stray tags are tolerated (a closing tag ends all that is open inside of it; the next
article or main ends an unclosed nav, aside or form);
without labelled pages fixed penalties of the well-known names apply; equal regions: the first
one; repeated pages give repeated rows.
"""

from __future__ import annotations

import bisect
import html as references
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

from meterline.llm.common import appended, slices, written

SAMPLE_PAGES = 2_000
SCALES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
#: Score of a word in furniture: it is left out of the text, but doesn't part what is around it.
FURNITURE = -0.1

# Elements without text of their own, blocks, and names of page furniture.
SILENT = "script style noscript template svg math iframe object canvas audio video select option textarea button head title".split()
CONTENT = ("article", "main")
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
FURNITURE_TAGS = "nav aside footer form dialog menu fieldset".split()
#: Furniture whatever share of the page it holds.
LANDMARKS = "nav aside footer menu".split()
FURNITURE_CLASSES = (
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar "
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice "
    "notices alert gdpr popup modal overlay newsletter subscribe subscription signup login form search comment comments "
    "reply replies disqus discussion respond share sharing social related recommended more tags pagination pager "
    "copyright legal disclaimer widget"
).split()
#: A name after one of these ("no-sidebar", "with-sidebar") says something of an element that isn't
#: furniture itself.
NEGATIONS = "no non not with without has hide hidden".split()
#: Longer names also begin a class that is written in one word ("commentlist").
BEGINNINGS = tuple(c for c in FURNITURE_CLASSES if len(c) >= 7)
#: Share of the page's words outside of furniture below which inherited marks are looked at again.
LITTLE = 0.1
#: Landmark roles.
FURNITURE_ROLES = "navigation banner contentinfo complementary search form dialog alert".split()

#: Elements whose inside is no markup; of these, some leave a mark in the page.
RAW = "script style textarea noscript template svg iframe title".split()
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
TAG = re.compile(r"(/?)([a-zA-Z][^\s/><]*)")
TAG_SIGN = re.compile("[<>\"']")
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


def features(tag: str, attributes: str) -> list[str]:
    """The tag, and the words of its class, id and role."""
    out = [tag]
    if "=" in attributes:
        for kind, *values in ATTR.findall(attributes):
            mark = "@" if kind.lower() == "role" else "."
            for token in "".join(values).lower().split():
                negated = False
                for w in NAME.findall(token):
                    if w not in FURNITURE_CLASSES and w.startswith(BEGINNINGS):
                        out.append(f"{mark}{next(c for c in BEGINNINGS if w.startswith(c))}")
                    # A negated name is a feature of its own.
                    out.append(f"{mark}+{w}" if negated and w in FURNITURE_CLASSES else f"{mark}{w}")
                    negated = w in NEGATIONS
    return out


@dataclass
class Piece:
    kind: str  # text, tag
    text: str  # raw text, or empty
    words: int
    keys: list[str]
    starts_block: bool
    open: str = ""
    close: str = ""


class Scanner:
    """Texts and tags of a page in one forward pass; a sign that was once looked for in vain is
    not looked for again, so that broken markup takes no longer than any other."""

    def __init__(self, page: str):
        self.page = page
        self.absent: set[str] = set()

    def find(self, sign: str, at: int) -> int:
        if sign in self.absent:
            return -1
        found = self.page.find(sign, at)
        if found < 0:
            self.absent.add(sign)
        return found

    def end_of_tag(self, at: int) -> int:
        """Where a tag's attributes end: at the next `<` or `>` outside of quotes. A quote without
        an end is a sign like any other."""
        while True:
            m = TAG_SIGN.search(self.page, at)
            if m is None:
                return len(self.page)
            if m[0] in "<>":
                return m.start()
            closing = self.find(m[0], m.end())
            at = closing + 1 if closing >= 0 else m.end()

    def pieces(self) -> list[Piece]:
        page, out = self.page, []
        start = at = 0  # text since start, looked at up to at

        def text(end: int) -> None:
            if end > start:
                raw = page[start:end]
                out.append(Piece("text", raw, len(raw.split()), [], False))

        while (at := self.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                text(at)
                end = self.find("-->", at + 4)
                start = at = end + 3 if end >= 0 else len(page)
                continue
            if page.startswith(("<!", "<?"), at):
                end = self.find(">", at)
                if end < 0:
                    at += 1
                    continue
                text(at)
                start = at = end + 1
                continue
            m = TAG.match(page, at + 1)
            if m is None:
                at += 1
                continue
            text(at)
            tag = m[2].lower()
            end = self.end_of_tag(m.end())
            start = at = end + 1 if page.startswith(">", end) else end
            if m[1]:
                out.append(Piece("tag", "", 0, [f"/{tag}"], tag not in INLINE, close=tag))
            elif tag in RAW:
                closing = RAW_END[tag].search(page, at)
                start = at = closing.end() if closing else len(page)
                if tag in ("title", "textarea", "iframe"):
                    out.append(Piece("tag", "", 0, [tag], True))
            else:
                attributes = page[m.end() : end]
                held = "" if tag in VOID or attributes.rstrip().endswith("/") else tag
                out.append(Piece("tag", "", 0, features(tag, attributes), tag not in INLINE, open=held))
        text(len(page))
        return out


def pieces(page: str) -> list[Piece]:
    return Scanner(page).pieces()


def text_of(parts: Iterable[Piece]) -> str:
    blocks: list[str] = []
    held: list[str] = []
    for p in parts:
        if p.kind == "text":
            held.append(p.text)
        elif p.starts_block and held:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    clean = (SPACE.sub(" ", references.unescape(b)).strip() for b in blocks)
    return " ".join(b for b in clean if b)


def unclosed(parts: list[Piece]) -> set[int]:
    """The nav, aside and form elements that no tag closes; the next article or main ends them."""
    left: dict[str, list[int]] = {t: [] for t in ("nav", "aside", "form")}
    for k, p in enumerate(parts):
        if p.open in left:
            left[p.open].append(k)
        elif p.close in left and left[p.close]:
            left[p.close].pop()
    return {k for ks in left.values() for k in ks}


@dataclass
class Extractor:
    odds: dict[str, float]  # log-odds of a feature outside against inside
    scale: float = 4.0

    def is_furniture(self, keys: list[str]) -> bool:
        if keys[0] in FURNITURE_TAGS or keys[0] in SILENT:
            return True
        if keys[0] in (*CONTENT, "body", "html", *INLINE):
            return False
        for k in keys[1:]:
            known = FURNITURE_ROLES if k[0] == "@" else FURNITURE_CLASSES
            if k[1:] in known and self.odds.get(k, 0.0) >= 0:
                return True
        return any(self.odds.get(k, 0.0) > 2.0 for k in keys[1:])

    def penalty(self, keys: list[str]) -> float:
        found = [self.odds[k] for k in keys if k in self.odds]
        return 0.1 + self.scale * max(0.0, max(found, default=0.0))

    def marked(self, parts: list[Piece]) -> list[bool]:
        """Which pieces lie in furniture.

        Where hardly a word lies outside of furniture, a frame around the page was marked: then the
        page's article and main elements, or else the outermost marked elements that hold most of
        the words, as few of them as free enough words, lift the marks around them.
        """
        words = [p.words for p in parts]
        total = sum(words)
        content = [k for k, p in enumerate(parts) if p.open in CONTENT]

        def enough(marks: list[bool]) -> bool:
            free = sum(w for w, f in zip(words, marks, strict=True) if not f)
            return free >= LITTLE * total or any(not marks[k] for k in content)

        out, spans = self._marks(parts, set())
        if enough(out):
            return out
        if content:
            return self._marks(parts, set(content))[0]
        sums = [0]
        for w in words:
            sums.append(sums[-1] + w)
        # Elements with most of the words lie in each other.
        most = sorted(
            k for k, end in spans.items()
            if out[k] and parts[k].keys[0] not in LANDMARKS and 2 * (sums[end] - sums[k]) > total
        )
        few = bisect.bisect_left(range(len(most) + 1), True, key=lambda n: enough(self._marks(parts, set(most[:n]))[0]))
        return self._marks(parts, set(most[:few]))[0]

    def _marks(self, parts: list[Piece], lifts: set[int]) -> tuple[list[bool], dict[int, int]]:
        """Which pieces lie in furniture, given those that lift marks; and where elements end."""
        open_ended = unclosed(parts)
        stack: list[tuple[str, bool, int]] = []
        depths: dict[str, list[int]] = {}  # where each tag is open
        loose: list[int] = []  # where elements are open that no tag closes
        out = []
        spans: dict[int, int] = {}

        def cut(depth: int, at: int) -> None:
            while len(stack) > depth:
                tag, _, k = stack.pop()
                spans[k] = at
                depths[tag].pop()
                if loose and loose[-1] == len(stack):
                    loose.pop()

        for n, p in enumerate(parts):
            if p.close and depths.get(p.close):
                depth = depths[p.close][-1]
                # A closing inline tag ends nothing but its own element.
                if p.starts_block or depth == len(stack) - 1:
                    inside = stack[depth][1]
                    cut(depth, n)
                    out.append(inside)
                    continue
            if p.open and (p.starts_block or p.open == "a"):
                if p.open in CONTENT and loose:
                    cut(loose[0], n)
                if p.open in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == p.open:
                    cut(len(stack) - 1, n)
                inside = n not in lifts and (bool(stack and stack[-1][1]) or self.is_furniture(p.keys))
                depths.setdefault(p.open, []).append(len(stack))
                if n in open_ended:
                    loose.append(len(stack))
                stack.append((p.open, inside, n))
                out.append(inside)
                continue
            out.append(bool(stack and stack[-1][1]))
        cut(0, len(parts))
        return out, spans

    def region(self, parts: list[Piece], furniture: list[bool]) -> tuple[int, int]:
        """Bounds of the first contiguous run with the largest sum."""
        best, bounds, total, start = 0.0, (0, 0), 0.0, 0
        for k, (p, f) in enumerate(zip(parts, furniture, strict=True)):
            if total <= 0:
                total, start = 0.0, k
            total += p.words * (FURNITURE if f else 1.0) if p.kind == "text" else -(0.1 if f else self.penalty(p.keys))
            if total > best:
                best, bounds = total, (start, k + 1)
        return bounds

    def extract(self, page: str | None) -> str:
        parts = pieces(page or "")
        furniture = self.marked(parts)
        return self.text_in(parts, furniture, *self.region(parts, furniture))

    @staticmethod
    def text_in(parts: list[Piece], furniture: list[bool], i: int, j: int) -> str:
        """Text of the region without furniture."""
        kept = (
            Piece("tag", "", 0, p.keys, p.starts_block) if f and p.kind == "text" else p
            for p, f in zip(parts[i:j], furniture[i:j], strict=True)
        )
        return text_of(kept)


def own_label(parts: list[Piece]) -> tuple[int, int] | None:
    """The bounds of the one article or main element, if the page has exactly one."""
    for name in CONTENT:
        opens = [k for k, p in enumerate(parts) if p.open == name]
        closes = [k for k, p in enumerate(parts) if p.close == name]
        if len(opens) == 1 and len(closes) == 1 and opens[0] < closes[0]:
            return opens[0], closes[0] + 1
    return None


def count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in slices(batches):
        for page in batch.column("html").to_pylist():
            parts = pieces(page)
            bounds = own_label(parts)
            if bounds:
                for k, p in enumerate(parts):
                    (inside if bounds[0] <= k < bounds[1] else outside).update(p.keys)
    names = sorted(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_pydict(
        {"name": pa.array(names, pa.string()), "i": pa.array([inside[n] for n in names], pa.int64()), "o": pa.array([outside[n] for n in names], pa.int64())}
    )


def overlap(a: str, b: str) -> float:
    """F1 of the words of two texts, as bags."""
    x, y = Counter(a.split()), Counter(b.split())
    both = sum((x & y).values())
    return 2 * both / (x.total() + y.total()) if both else float(not x and not y)


def fit_extractor(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> Extractor:
    """Penalties from the labelled pages of a bounded sample."""
    pages = pages.where(F.col(html).isNotNull())
    place = F.xxhash64(F.col(page_id).cast("string"), html)
    # The sample hangs on the rows, not on the files; only hashes are sorted.
    last = pages.select(place.alias("h")).orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    sample = written(
        pages.where(place <= F.lit(last)).select(F.col(html).alias("html")).repartition(8), "labelled-pages"
    )
    counts = (
        sample.mapInArrow(count_features, "name string, i long, o long")
        .groupBy("name")
        .agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        .where("i + o >= 5")
        .collect()
    )
    # Odds per page element: 0 is as frequent inside as outside.
    odds = {r["name"]: math.log((r["o"] + 0.5) / (r["i"] + 0.5)) for r in counts}

    def rate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = dict.fromkeys(SCALES, 0.0)
        makers = {scale: Extractor(odds, scale) for scale in SCALES}
        for batch in slices(batches):
            for page in batch.column("html").to_pylist():
                parts = pieces(page)
                bounds = own_label(parts)
                if not bounds:
                    continue
                marked = makers[SCALES[0]].marked(parts)
                wanted = makers[SCALES[0]].text_in(parts, marked, *bounds)
                for scale, maker in makers.items():
                    got = maker.text_in(parts, marked, *maker.region(parts, marked))
                    sums[scale] += 1.0 if got == wanted else overlap(got, wanted)
        yield pa.RecordBatch.from_pydict({"scale": list(sums), "f1": list(sums.values())})

    rated = sample.mapInArrow(rate, "scale double, f1 double").groupBy("scale").agg(F.sum("f1").alias("f1")).collect()
    best = max(rated, key=lambda r: (round(r["f1"], 6), -r["scale"]), default=None)
    return Extractor(odds, best["scale"] if best and best["f1"] > 0 else 4.0)


def extract_text(pages: DataFrame, model: Extractor, html: str = "html", name: str = "text") -> DataFrame:
    """All rows and columns, and the main text."""
    schema = StructType([f for f in pages.schema.fields if f.name != name]).add(name, StringType())
    column = pages.columns.index(html)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32):
            texts = [model.extract(h) for h in batch.column(column).to_pylist()]
            yield appended(batch, **{name: pa.array(texts, pa.string())})

    return pages.mapInArrow(add, schema)


def op10_html_extraction(pages: DataFrame) -> DataFrame:
    slim = pages.select("page_id", "url", "html")
    return extract_text(slim, fit_extractor(slim)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
