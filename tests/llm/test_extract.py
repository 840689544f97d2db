"""A furniture name around the article doesn't take its text."""

from __future__ import annotations

import time

import pytest

from meterline.llm import extract

TEXT = "First paragraph of the story with enough words to count. Second paragraph that goes on for a while."
BODY = "<p>First paragraph of the story with enough words to count.</p><p>Second paragraph that goes on for a while.</p>"
NAV = "<nav><a>Home</a> <a>About us</a></nav>"
COMMENTS = "<section id='comments'><article class='comment'><p>" + "great story thanks a lot " * 40 + "</p></article></section>"


@pytest.mark.parametrize("page", [
    f"<body><form action='/'>{NAV}<article>{BODY}</article><footer>all rights reserved</footer></form></body>",
    f"<body><form action='/'>{NAV}<div>{BODY}</div><footer>all rights reserved</footer></form></body>",
    f"<body><nav><a>Home</a><article>{BODY}</article></body>",
    f"<body><aside><p>Related things</p><main>{BODY}</main></body>",
    f"<body><div class='content with-sidebar'>{NAV}<div>{BODY}</div></div></body>",
    f"<body><div class='no-sidebar'>{NAV}<article>{BODY}</article></div></body>",
    f"<body><article>{BODY}</article>{COMMENTS}</body>",
    f"<body><div class='main-nav'><a>Home</a> <a>About</a></div><div>{BODY}</div></body>",
])
def test_furniture_around_the_text(page):
    assert extract.Extractor({".sidebar": 4.0}, 4.0).extract(page) == TEXT


FURNITURE = [
    "reader-comments", "disqus_thread", "fb-comments", "commentlist", "comments-area", "comment-respond",
    "related-posts", "related-articles", "share-buttons", "social-icons", "cookie-law-info", "newsletter-inline",
    "popular-tags", "ad-slot", "promo-card", "sidebar-right",
]


@pytest.mark.parametrize("where", ["inside", "after"])
@pytest.mark.parametrize("name", FURNITURE)
def test_usual_containers_are_left_out(name, where):
    other = f"<div class='{name}'><p>Some words that are no part of the story at all.</p></div>"
    page = f"<article>{BODY}{other}</article>" if where == "inside" else f"<article>{BODY}</article>{other}"
    assert extract.Extractor({}, 4.0).extract(f"<body>{NAV}{page}</body>") == TEXT


@pytest.mark.parametrize("page", [
    "<a " * 350_000,
    "<a href='" * 100_000,
    "<!-- " * 200_000,
    "<script>" * 100_000,
    "<article>" * 100_000 + "word",
    "<div class='ad'>" * 20_000 + "word " * 50,
    "<nav>" * 50_000 + "</div>" * 50_000,
    "<? " * 200_000 + "< " * 100_000,
    "word " * 400_000,
])
def test_long_broken_pages_take_linear_time(page):
    begun = time.process_time()
    extract.Extractor({}, 4.0).extract(page)
    assert time.process_time() - begun < 10


def test_broken_tags():
    model = extract.Extractor({}, 4.0)
    assert model.extract("<p>a < b and c > d</p>") == "a < b and c > d"
    assert model.extract("<p title=\"x > y\">one</p><p title='it>two</p>") == "one two"
    assert model.extract("<p>one<b two</b> three<!-- x") == "one three"
    assert model.extract("<SCRIPT>x</SCRIPT ><P>One</P><style>y") == "One"


def test_equal_regions_give_the_first():
    assert extract.Extractor({"hr": 3.0}, 4.0).extract("<p>one two</p><hr><hr><p>six ten</p>") == "one two"
