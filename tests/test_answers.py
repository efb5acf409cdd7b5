"""Sentences and events from prose, session tables, social pages, answers, bytes and slices, on small rows."""

from __future__ import annotations

import json
import random
from datetime import date, datetime

from pyspark.sql import functions as F

from tidewire.functions import charsets
from tidewire.functions.text import SENTIMENTS
from tidewire.operators import answers, evaluate, prose
from tidewire.sources import markup, social


def test_sentences_and_abbreviations(spark):
    text = "Dr. Ann Lee spoke. Costs rose 3.5 percent! Did J. B. Smith agree?  Yes: no. lower case"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(prose.sentences(F.col("t"), prose.ABBREVIATIONS).alias("s"), prose.sentences(F.col("t")).alias("plain")).collect()
    assert row[0]["s"] == ["Dr. Ann Lee spoke.", "Costs rose 3.5 percent!", "Did J. B. Smith agree?", "Yes: no. lower case"]
    assert row[0]["plain"][0] == "Dr." and row[1]["s"] == [""]


def test_periods_are_told_only_where_the_day_is_certain(spark):
    page = """<div class="usa-accordion"><button class="usa-accordion__button">Rates 2027 (Closed)</button><div class="usa-accordion__content"><p>Public comments will be accepted until Monday, October 5, 2026.
    The Board will hold more. A public comment forum will be held on Thursday, July 23rd at 4 p.m. via phone.</p><p>Comments will be accepted until October 5. Comments are open until Friday, October 5.</p></div></div>"""
    pages = spark.createDataFrame([(1, page, ""), (2, "<p>new layout</p>", "")], "id int, html string, url string")
    found = markup.extract(pages, "id", "html", "url", prose.SECTIONS)
    got = prose.comment_periods(found, pages, "id", F.lit(date(2026, 7, 1))).orderBy("id", "day").collect()
    assert [tuple(r)[1:5] for r in got] == [
        ("hearing", "2026-07-23", "16:00", "Public comment forum: Rates 2027"), ("deadline", "2026-10-05", "", "Public comment closes: Rates 2027"), (None,) * 4,
    ]


def test_session_tables(spark):
    meeting = {"MeetingDate": "Friday, October 9, 2026", "CommName": "House Committee on Human Services", "StartTime": 1, "RoomNbr": "11", "Room": "Large", "PermanentID": 16, "Published": 0}
    rows = [(1, json.dumps({"data": [meeting, {**meeting, "MeetingDate": "Friday, October 8, 2026"}, {**meeting, "CommName": "Roads"}]})), (2, "{}"), (3, '{"data": []}'), (4, None)]
    got = prose.session_meetings(spark.createDataFrame(rows, "id int, json string"), "id", "json", "https://law.example", "(?i)human services", F.lit(date(2026, 1, 1))).orderBy("id").collect()
    assert [(r["id"], r["day"], r["time"], r["body"], r["url"]) for r in got] == [
        (1, "2026-10-09", "", "Room 11 (Large), State House", "https://law.example/committee/detail/2026/16"), (2, None, None, None, None), (4, None, None, None, None),
    ]


def test_posts_and_comments_of_social_pages(spark):
    post = r'''<script>{"post_id":"1","message":{"text":"Plans “were” cut.\nMore"},"creation_time":1781270103,"x":"y","wwwURL":"https:\/\/www.facebook.com\/paper\/posts\/pf1"} {"wwwURL":"https:\/\/www.facebook.com\/paper\/posts\/pf1"}</script>'''
    threads = r'''{"depth":1,"body":{"text":"First, though a reply"},"author":{"name":"Ann"},"created_time":1781270200}{"depth":1,"body":{"text":"Answer"},"author":{"name":"Bob"}}{"depth":0,"body":{"text":"Root"},"author":{"name":"Cé"}}
    {"body":{"text":"Answer"},"author":{"name":"Bob"}}{"depth":0,"depth":2,"body":{"text":"Deep"},"author":{"name":"Dan"}}{"depth":0,"body":{"text":" "}}'''
    frame = spark.createDataFrame([(1, post + threads), (2, "<p>none</p>"), (3, None), (4, r'{"wwwURL":"https:\/\/www.facebook.com\/a\/posts\/1"}')], "id int, html string")
    assert [tuple(r)[2:] for r in social.preloaded_posts(frame, "id", "html").collect()] == [("https://www.facebook.com/paper/posts/pf1", "Plans “were” cut. More", datetime(2026, 6, 12, 13, 15, 3))]
    got = {r["text"]: r for r in social.preloaded_comments(frame, "id", "html").collect()}
    assert {t: r["author"] for t, r in got.items()} == {"First, though a reply": "Ann", "Answer": "Bob", "Root": "Cé", "Deep": "Dan"}
    root = {t: next(x for x, o in got.items() if o["place"] == r["root"]) for t, r in got.items()}
    assert root == {"First, though a reply": "First, though a reply", "Answer": "First, though a reply", "Root": "Root", "Deep": "Root"}


def test_marks_give_what_is_around(spark):
    draw = random.Random(5)
    for _ in range(3):
        text = "".join(draw.choice("ab<x>é") for _ in range(300))
        got = social.marks(spark.createDataFrame([(1, text)], "id int, html string"), "id", "html", "(a+)<", 7, 11).orderBy("place").collect()
        import re

        want = [(m[1], text[max(0, m.start() - 7) : m.start()], text[max(0, m.start() - 7) : m.start() + 11], text[m.start() : m.start() + 11]) for m in re.finditer("(a+)<", text)]
        assert [(r["found"], r["ahead"], r["around"], r["behind"]) for r in got] == want


def test_merged_posts(spark):
    schema = "k int, title string, link string, at timestamp, text string, comments array<string>"
    pages = spark.createDataFrame([(1, "page", "l", datetime(2026, 1, 1), "short", ["a"]), (2, "alone", "m", None, "x", None)], schema)
    posts = spark.createDataFrame([(1, "", "n", None, "whole text", [])], schema)
    assert sorted(tuple(r) for r in social.merged_posts(pages, posts, "k").collect()) == [(1, "page", "n", datetime(2026, 1, 1), "whole text", ["a"]), (2, "alone", "m", None, "x", None)]


def test_answers_and_their_faults(spark):
    said = [
        (1, '```json\n[{"id":"2","summary":" Two  words ","relevant":false,"sentiment":"Postive - x","sentimentReason":"why"},{"id":1,"summary":"Kept","relevant":false},{"id":2,"summary":"Later"},{"id":9,"summary":"?"},{"id":"x","summary":"?"},{"id":3,"summary":7},"odd"]\n``` '),
        (2, "I can't."), (3, '{"id":1}'), (4, "[]"), (5, None),
    ]
    items = spark.createDataFrame([(b, p, p == 1) for b in (1, 2, 4) for p in (1, 2, 3)], "batch int, place int, curated boolean")
    got = answers.applied(spark.createDataFrame(said, "batch int, text string"), items, "batch", "text", "place", F.col("curated"), F.lit(True)).collect()
    of = lambda b: sorted((str(r["place"]), str(r["turn"]), r["fault"] or "", r["summary"], r["relevant"], r["sentiment"]) for r in got if r["batch"] == b)
    assert of(1) == sorted([
        ("2", "0", "repeated", "Two words", False, "positive"), ("1", "1", "", "Kept", True, None), ("2", "2", "", "Later", True, None), ("9", "3", "no item", "?", True, None), ("None", "4", "no place", "?", True, None),
        ("3", "5", "no summary", None, True, None), ("None", "6", "no place", None, True, None), ("3", "None", "unanswered", None, None, None),
    ])
    assert [x[2] for x in of(2)] == ["unanswered"] * 3 + ["unreadable"] and [x[2] for x in of(3)] == ["unreadable"] == [x[2] for x in of(5)] and [x[2] for x in of(4)] == ["unanswered"] * 3


def test_bytes(spark):
    curly = "naïve “quotes” – it’s €5"
    rows = [
        (1, curly.encode("utf-16-le").join([b"\xff\xfe", b""]), None, curly), (2, b"\xfe\xff" + curly.encode("utf-16-be"), "latin1", curly), (3, b"\xef\xbb\xbf" + curly.encode(), None, curly), (4, curly.encode(), "iso-8859-1", curly),
        (5, curly.encode("cp1252"), "ISO-8859-1", curly), (6, b'<?xml version="1.0" encoding="windows-1252"?>' + curly.encode("cp1252"), " ", '<?xml version="1.0" encoding="windows-1252"?>' + curly),
        (7, b"<meta charset=latin1>" + curly.encode("cp1252"), None, "<meta charset=latin1>" + curly), (8, b"caf\xe9", None, "caf�"), (9, b"caf\xe9", "klingon", "caf�"), (10, b"", None, ""), (11, None, None, None), (12, b"\xff\xfea\x00b", None, "a�"),
    ]
    got = spark.createDataFrame([(i, b and bytearray(b) if b is not None else None, d) for i, b, d, _ in rows], "id int, raw binary, said string").select("id", charsets.decoded(F.col("raw"), F.col("said")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {i: t for i, _, _, t in rows}


def test_slices_are_agreement_of_each_part(spark):
    draw = random.Random(8)
    rows = [(i, draw.choice([*SENTIMENTS, None, "odd"]), draw.choice([*SENTIMENTS, None]), draw.choice(SENTIMENTS), draw.random() < 0.4) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, e string, p string, q string, f boolean")
    slices = {"all": F.lit(True), "f": F.col("f"), "not f": ~F.col("f"), "none": F.lit(False)}
    got = {(r["slice"], r["prediction"]): r for r in evaluate.sliced(frame, slices, F.col("e"), {"p": F.col("p"), "q": F.col("q")}).collect()}
    assert len(got) == 8 and got["none", "p"]["n"] == 0 and got["none", "p"]["exact"] is None
    for (name, prediction), row in got.items():
        want = evaluate.agreement(frame.where(slices[name]), F.col("e"), F.col(prediction)).first()
        assert all(row[c] == want[c] or abs(row[c] - want[c]) < 1e-12 for c in want.asDict())
    labels = spark.createDataFrame([(1, "positive"), (2, "negative"), (2, "neutral")], "id int, label string")
    assert {r["id"]: r["label"] for r in evaluate.labelled(frame.select("id").where("id < 4"), labels, "id").collect()} == {0: None, 1: "positive", 2: None, 3: None}


def test_social_pages_by_their_elements(spark):
    now = F.lit(datetime(2026, 6, 12, 18))
    head = '<head><title>t</title><meta property="og:title" content="Paper"><meta name="description" content="Plans &amp; more"><link rel="canonical" href="https://f.example/p/posts/9"><meta property="article:published_time" content="2026-06-12T10:00:00Z"></head>'
    shown = '<div aria-label="Comment by Ann Lee 2 hours ago">Ann Lee Top fanGood news for all2h</div><div class="UFICommentBody">Good</div><div class="UFICommentBody">Good</div>'
    post = '<article><div><p>The insurer wants to offer cheaper health plans.</p><span>3h ·</span><a href="/paper/posts/123?ref=x">3h</a> <b>Like Share</b></div></article>'
    long = f'<section>{"long " * 400}<i><a href="story.php?id=7">More of it</a></i></section>'
    pages = spark.createDataFrame([(1, head + shown, "https://f.example/asked", "Name"), (2, post + long + post, "https://f.example/paper", "Name"), (3, '<script>"publish_time":1700000000</script>', "https://f.example/x", "Name")], "id int, html string, url string, name string")
    found = markup.extract(pages, "id", "html", "url", [social.POST, social.SHOWN, social.LINKS])
    posts = {r["id"]: tuple(r)[1:] for r in social.post_pages(found, pages, "id", F.col("name"), F.col("url"), F.col("html")).collect()}
    assert posts[1] == ("Paper post: Plans & more", "https://f.example/p/posts/9", datetime(2026, 6, 12, 10), "Plans & more")
    assert posts[3] == ("Name post", "https://f.example/x", datetime(2023, 11, 14, 22, 13, 20), "")
    assert sorted((r["author"], r["text"]) for r in social.shown_comments(found).collect()) == [("", "Good"), ("Ann Lee", "Good news for all")]
    linked = {r["link"]: (r["text"], r["at"]) for r in social.linked_posts(found, pages, "id", F.col("url"), now).collect()}
    first = next(k for k in linked if "/posts/123" in k)
    assert linked[first] == ("The insurer wants to offer cheaper health plans.3h ·3h", datetime(2026, 6, 12, 15)) and sorted(x for x, _ in linked.values())[0] == "More of it" and len(linked) == 2


def test_a_session_reads_days_of_wanted_meetings_once(spark):
    """Rows of other committees and without a day go before a day is read, and a day is parsed in one place."""
    rows = spark.createDataFrame([(1, '{"data":[{"MeetingDate":"Monday, January 5, 2026","LongName":"Health"},{"MeetingDate":"Someday","LongName":"Health"}]}')], "id int, json string")
    found = prose.session_meetings(rows, "id", "json", "https://law.example", "(?i)health", F.lit(date(2026, 1, 1)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MMMM d yyyy") <= 14  # 36 before
    assert [(r["id"], r["day"]) for r in found.collect()] == [(1, "2026-01-05")]
