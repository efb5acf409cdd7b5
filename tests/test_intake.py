"""Listings, posts, comments, schedules and titles on small pages; streams against their batch results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewire.operators import intake
from tidewire.streaming import state as streams


def test_listings(spark):
    html = '<a href="/news/one#x">A headline that is long</a><a href="/news/one">Again the headline, longer</a><a href="/about">About this paper</a><a href="/news/two">Short</a>'
    rows = spark.createDataFrame([(1, html, "https://a.example/list")], "id int, html string, base string")
    found = [(r["title"], r["link"]) for r in intake.listing_items(rows, "id", "html", "base", "^/news/").collect()]
    assert found == [("A headline that is long", "https://a.example/news/one")]


def test_comments_with_replies(spark):
    page = '{"comment":[{"text":" One ","author":{"name":"A"},"dateCreated":"2026-01-02T03:04:05Z","comment":[{"text":"Two","author":{"name":"B"}}]},{"text":""},{"text":"Three"}]}'
    rows = spark.createDataFrame([(1, page), (2, None), (3, "no json")], "id int, json string")
    found = intake.linked_comments(rows, "id", "json", 2).orderBy("place").collect()
    assert [(r["id"], r["place"], r["author"], r["text"]) for r in found] == [(1, 1, "A", "One"), (1, 2, "B", "Two")]


def test_schedules(spark):
    lines = ["Intro", "Monday, August 3, 2026", "9:00-11:00am - Hearing one", "12:15-2:30pm - Hearing two", "Tuesday, August 4, 2026", "Agenda: talks", "11:00-1:00pm - "]
    rows = spark.createDataFrame([(1, lines[:6]), (2, None)], "id int, lines array<string>")
    heading = r"^(?:Monday|Tuesday),\s+([A-Z][a-z]+)\s+(\d{1,2}),\s+(\d{4})$"
    timed = r"(?i)^(\d{1,2})(?::(\d{2}))?\s*-\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?\s*-\s*(.+)$"
    found = intake.page_events(rows, "id", F.col("lines"), heading, timed).orderBy("place").collect()
    assert [(r["day"], r["time"], r["end"], r["title"]) for r in found] == [
        ("2026-08-03", "09:00", "11:00", "Hearing one"),
        ("2026-08-03", "12:15", "14:30", "Hearing two"),
        ("2026-08-04", "", "", "Tuesday, August 4, 2026"),
    ]


def test_snippets_that_only_repeat_the_title(spark):
    rows = [("Ferry sinks - The Paper", "Ferry sinks The Paper", "The Paper"), ("Ferry sinks - The Paper", "Ferry sinks. Crew of nine was saved", "The Paper"), (None, None, None)]
    frame = spark.createDataFrame(rows, "title string, snippet string, outlet string")
    found = [r[0] for r in frame.select(intake.story_snippet(F.col("snippet"), F.col("title"), F.col("outlet"))).collect()]
    assert found == ["", "Ferry sinks. Crew of nine was saved", ""]


def test_fallbacks_and_headers(spark):
    sources = spark.createDataFrame([("A", "https://www.a.example/f", True), ("B", "https://b.example/f", False)], "name string, url string, local boolean")
    found = {(r["name"], r["url"], r["fallback"]) for r in intake.with_fallbacks(sources, "name", "url", "https://s.example/?q=").collect()}
    assert ("A (search)", "https://s.example/?q=site%3Aa.example", True) in found and len(found) == 3
    saved = spark.createDataFrame([("https://a.example", " x ", ""), ("https://b.example", "", None), ("ftp://c", "x", "y")], "url string, etag string, modified string")
    assert [tuple(r) for r in intake.valid_headers(saved, "url", "etag", "modified").collect()] == [("https://a.example", "x", None)]


def streamed(spark, tmp_path, frame, apply, mode="append"):
    folder, out = str(tmp_path / "in"), f"out_{tmp_path.name.replace('-', '_')}"
    frame.repartition(1).write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).parquet(folder)
    run = apply(stream).writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return spark.table(out).collect()


ROWS = [("k", datetime(2026, 1, 1, 0, i), i in (1, 2, 4), f"https://a.example/{i % 3}?utm_source=x") for i in range(6)]
SCHEMA = "key string, at timestamp, failed boolean, link string"


def test_streamed_streaks(spark, tmp_path):
    found = streamed(spark, tmp_path, spark.createDataFrame(ROWS, SCHEMA), lambda s: streams.failure_streaks(s, "key", "at", "failed"))
    assert sorted((r["at"].minute, r["streak"]) for r in found) == [(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (5, 0)]


def test_streamed_links_and_windows(spark, tmp_path):
    found = streamed(spark, tmp_path, spark.createDataFrame(ROWS, SCHEMA), lambda s: streams.new_links(s, "link", "at"))
    assert sorted(r["canonical"] for r in found) == [f"https://a.example/{i}" for i in range(3)]


def test_streamed_windows(spark, tmp_path):
    found = streamed(spark, tmp_path, spark.createDataFrame(ROWS, SCHEMA), lambda s: streams.window_counts(s, "key", "at", "2 minutes"), "complete")
    assert sorted((r["window_start"].minute, r["n"]) for r in found) == [(0, 2), (2, 2), (4, 2)]


def test_streamed_sessions_and_delivery(spark, tmp_path):
    rows = [("k", datetime(2026, 1, 1, 0, m), False, "") for m in (0, 3, 5, 40, 44)]
    found = streamed(spark, tmp_path, spark.createDataFrame(rows, SCHEMA), lambda s: streams.session_counts(s, "key", "at", "10 minutes"), "complete")
    assert sorted((r["opened"].minute, r["n"]) for r in found) == [(0, 3), (40, 2)]
    folder, out = str(tmp_path / "src"), str(tmp_path / "sent")
    spark.createDataFrame(rows, SCHEMA).repartition(1).write.parquet(folder)
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        streams.deliver(stream, out, ["key", "at"], str(tmp_path / f"ck{_}")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 5


def test_short_titles_leave_other_words_whole(spark):
    rows = spark.createDataFrame([("Only three more", "E. - The Post"), ("e e The Post e", "E. - The Post"), ("Ten words are here", "E. - The Post")], "s string, t string")
    assert [r[0] for r in rows.select(intake.story_snippet(F.col("s"), F.col("t"))).collect()] == ["", "", "Ten words are here"]
