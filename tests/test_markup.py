"""Selectors, cards, comments, meetings and linked data on small pages."""

from __future__ import annotations

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewire.plans.markups import CARDS, COMMENTS, meeting_days
from tidewire.sources import linked, markup
from tidewire.sources.markup import Field, Rule, Selector

PAGE = """<html><body><div id=top class="a b"><p>one<p class=c>two <b>bold</b><ul><li>x<ul><li data-k="v w">y</ul><li>z</ul></div>
<section><h2>head</h2><p>three</p><span>four</span><p>five</p><br/></section><img src=x><script>if (a < b) { "<p>no</p>" }</script></body>"""


def found(selector: str, html: str = PAGE) -> list[str]:
    wanted = Selector.of(selector)
    return [" ".join(n.text().split()) or n.tag for n in markup.tree(html).elements() if wanted.meets(n)]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("p", ["one", "two bold", "three", "five"]), (".a.b > p", ["one", "two bold"]), ("#top p.c b", ["bold"]), ("li li", ["y"]), ("li + li", ["z"]), ("ul > li", ["xy", "y", "z"]),
        ("[data-k]", ["y"]), ("[data-k~='w']", ["y"]), ("li[data-k^=v]", ["y"]), ("[data-k$='x']", []), ("[src*='x']", ["img"]), ("h2 ~ p", ["three", "five"]), ("h2 + p", ["three"]),
        ("span, b", ["bold", "four"]), ("section *", ["head", "three", "four", "five", "br"]), ("div p, section > p", ["one", "two bold", "three", "five"]), (".missing", []),
    ],
)
def test_selectors(selector, want):
    assert found(selector) == want


def test_implied_ends():
    html = "<table><tr><td>1<td>2<table><tr><td>in</table><tr><td>3</table><dl><dt>a<dd>b<dt>c</dl><p>q<div>r</div>s</p></p></nothing>t"
    assert found("tr > td", html) == ["1", "2in", "in", "3"] and found("dl > *", html) == ["a", "b", "c"] and found("p", html) == ["q"]


def test_rows_of_random_trees_are_those_of_a_plain_walk():
    draw = random.Random(3)

    def grow(depth: int) -> list:
        return [(draw.choice("xyz"), draw.choice(["", "k", "k m"]), grow(depth - 1) if depth else []) for _ in range(draw.randrange(4))]

    def html(nodes: list) -> str:
        return "".join(f'<{t} class="{c}">{html(inner)}</{t}>' for t, c, inner in nodes)

    def plain(nodes: list, above: tuple = ()) -> list[bool]:
        out = []
        for i, (t, c, inner) in enumerate(nodes):
            under = any(a == "x" for a, _ in above)
            beside = any("k" in b.split() for _, b, _ in nodes[:i])
            child = bool(above) and above[-1] == ("x", "k m") and "m" in c.split()
            out.append((t == "y" and under) or (t == "z" and beside) or child)
            out += plain(inner, (*above, (t, c)))
        return out

    for _ in range(200):
        nodes = grow(4)
        wanted = Selector.of("x y, .k ~ z, x.k.m > .m")
        got = [wanted.meets(n) for n in markup.tree(html(nodes)).elements()]
        want = plain(nodes)
        assert got == want


def test_cards(spark):
    rows = [
        (1, '<div class="views-row"><article><a class="link-arrow" href="/n/a">Rates  &amp; more</a><time datetime="">May 4, 2026</time><p>One</p><p>two</p><div class="blog-post--category">Blog</div></article></div>', "https://a.example/list"),
        (2, '<div class="item-listing-content"><a class="item-listing-content__link" href="">no link</a></div>', "https://a.example"),
        (3, '<outline-search-result><a href="/newsroom/search">Find</a></outline-search-result>', "https://b.example/"), (4, None, "https://b.example/"), (5, "", None), (1, "<p>again", "https://a.example/list"),
    ]
    pages = spark.createDataFrame(rows, "id int, html string, url string")
    got = markup.cards(markup.extract(pages, "id", "html", "url", CARDS), pages.where("html IS NULL OR html <> '<p>again'"), "id", "url", r"^(?!.*/newsroom/search$)").collect()
    assert [tuple(r)[3:] for r in got] == [("Rates & more", "https://a.example/n/a", datetime(2026, 5, 4), "One two", "Blog")]


def test_comments_answer_the_nearest_that_stays(spark):
    def comment(name: str, text: str, inside: str = "") -> str:
        return f'<li class="comment"><div class="comment-author"><span class="fn">{name} says:</span></div><time datetime="2026-06-16T10:00:00-04:00">June</time><div class="comment-content"><p>{text}</p></div><ul class="children">{inside}</ul></li>'

    page = f'<ol class="comment-list">{comment("A", "The first comment here", comment("B", "short", comment("C", "An answer to the answer")))}{comment("D", "Leave a reply to this")}{comment("A", "The FIRST comment here")}</ol>'
    pages = spark.createDataFrame([(1, page, "")], "id int, html string, url string")
    got = markup.comments(markup.extract(pages, "id", "html", "url", COMMENTS)).orderBy("item").collect()
    assert [(r["author"], r["text"], r["at"]) for r in got] == [("A", "The first comment here", datetime(2026, 6, 16, 14)), ("C", "An answer to the answer", datetime(2026, 6, 16, 14))]
    assert got[0]["thread"] is None and got[1]["thread"] == got[0]["item"]


def test_meetings(spark):
    page = """<p><strong>Wednesday, October 7, 2026: Board Meeting (2:00pm)</strong></p><ul><li>Budget</li><li><p>Call-in: 1</p></li></ul><p>note</p><div><ol><li>Vote</li></ol></div><hr><ul><li>no</li></ul>
    <p>Thursday, October 8, 2026: <a href="/c">advisory committee</a> (9 a.m.)</p><ul><li>Conference ID: 5</li></ul><p>Friday, October 9, 2026: NO BOARD MEETING</p><p>Monday, October 13, 2026: wrong day</p>"""
    pages = spark.createDataFrame([(1, page, ""), (2, "<p>new layout", "")], "id int, html string, url string")
    got = markup.meetings(markup.extract(pages, "id", "html", "url", markup.MEETINGS), F.lit(date(2026, 1, 1)), "Details follow.").orderBy("id", "day").collect()
    assert [tuple(r)[2:] for r in got] == [
        ("2026-10-07", "14:00", "Board meeting", "Budget | Vote", None, True), ("2026-10-08", "09:00", "Advisory committee", "Details follow.", "/c", False), (None,) * 6,
    ]


def test_orders_of_one_page_read_it_once(spark, tmp_path, monkeypatch):
    rows = [(i, i % 3 * 24 + i % 2, datetime(1995, 3, 1 + i % 4), (None, "O")[i % 2], "1-URGENT") for i in range(240)] + [(500, None, datetime(1995, 3, 1), "O", "x"), (501, 1, None, "O", "x")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    extract, read = markup.extract, []
    monkeypatch.setattr(markup, "extract", lambda pages, *given: (read.append(pages.where("html IS NOT NULL").count()), extract(pages, *given))[1])
    got = {r["id"]: tuple(r)[1:] for r in meeting_days(spark, str(tmp_path)).collect()}
    assert read == [4] and len(got) == 240
    assert got[4] == ("1995-03-01", "", "Board meeting on 1-URGENT", "", "/m", True) and got[7] == ("1995-03-04", "01:05", "Board meeting on 1-URGENT", "1-URGENT | Vote", "/m", True)


def test_linked_data_six_levels_deep(spark):
    deep = {"@type": ["Thing", "Comment"], "author": {"alternateName": "Ann"}, "description": "A comment far down", "dateCreated": "2026-01-02T03:04:05Z"}
    for _ in range(3):
        deep = {"x": [{"y": deep}]}
    page = [{"@type": "NewsArticle", "url": "https://a.example/x", "comment": [{"@type": "Comment", "author": "Bob", "text": "The first comment", "comment": deep}, {"@type": "Comment", "text": "THE first comment", "author": "bob"}, {"@type": "Comment", "text": "short"}]}]
    rows = [(1, json.dumps(page), "https://a.example/x"), (2, "{no json", ""), (3, None, ""), (4, json.dumps({"@type": "Article", "url": "https://b.example", "isPartOf": {"@type": "Article"}}), "https://a.example"), (5, json.dumps({"@graph": [{"z": {"@type": "Article"}}]}), "https://c.example")]
    frame = spark.createDataFrame(rows, "id int, json string, url string")
    every = linked.objects(frame, "id", "json")
    got = linked.comments(every).orderBy("path").collect()
    assert [(r["author"], r["text"], r["at"]) for r in got] == [("Bob", "The first comment", None), ("Ann", "A comment far down", datetime(2026, 1, 2, 3, 4, 5))]
    assert len(got[1]["path"]) > 8
    assert sorted(r["id"] for r in linked.articles(every, frame, "id", "url").collect()) == [1, 5]
    assert linked.objects(frame.limit(0), "id", "json").count() == 0


def test_rules_by_host(spark):
    rules = markup.article_rules([(r"(^|\.)a\.example$", (".story", "article"))], ("article", "main"))
    page = '<main>whole <article>inner <div class="story"> </div></article></main>'
    pages = spark.createDataFrame([(1, page, "https://www.a.example/x"), (2, page, "https://b.example")], "id int, html string, url string")
    got = {(r["id"], r["rule"]): (r["turn"], r["text"]) for r in markup.first_text(markup.extract(pages, "id", "html", "url", rules)).collect()}
    assert got[1, r"(^|\.)a\.example$"] == (1, "inner") and got[2, "default"] == (0, "inner")
