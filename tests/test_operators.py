"""Operators on small tables."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import dates, text, urls
from tidewire.operators import archive, cluster, resolve, rules, state
from tidewire.sinks import outputs
from tidewire.sources import feeds


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (text.clean, "  a  b\n", "a b"),
        (text.sentiment, "neuttral to positive", "neutral to positive"),
        (text.sentiment, "neutral to negative - while we are only mentioned", "neutral to negative"),
        (text.sentiment, "negative (and more)", "negative"),
        (text.sentiment, "wildly enthusiastic", None),
        (text.sentiment, "Postive", "positive"),
        (text.csv_field, '=1+"2"', '"\'=1+""2"""'),
        (text.escape_ics, "a,b;c\n", "a\\,b\\;c\\n"),
        (text.plain_numbers, "760k and 1.5 million", "760000 and 1500000"),
        (text.plain_numbers, "1,234,567 and 1.234 million, 2.125b, 1.0006k, x2k, 3 m", "1234567 and 1234000, 2125000000, 1001, x2k, 3000000"),
        (text.mask_personal, "see https://a.b/c/d or x@y.org", "see https://a.b/… or [email]"),
        (urls.canonical_link, "HTTPS://WWW.Ab.com/x/?b=2&utm_source=q&a=1#top", "https://www.ab.com/x/?a=1&b=2"),
        (urls.vote_link, "http://www.ab.com:80/x/?gclid=1", "ab.com/x"),
        (dates.parse, "Wed, 30 Sep 2026 17:00:00 GMT", datetime(2026, 9, 30, 17)),
        (dates.parse, "March 5, 2026 5pm", datetime(2026, 3, 5, 17)),
        (dates.parse, "Mar 5, 2026, 5:07 a.m.", datetime(2026, 3, 5, 5, 7)),
        (dates.parse, "2026-03-05", datetime(2026, 3, 5)),
        (dates.real_day, "2026-02-30", None),
    ],
)
def test_scalars(spark, function, given, want):
    assert one(spark, function(F.col("x")), x=given) == want


def test_half_up_and_percent(spark):
    assert one(spark, text.half_up(F.lit(-2.5))) == -2
    assert one(spark, text.percent_change(F.lit(3), F.lit(0))) is None


def test_only_first_match_counts(spark):
    term = rules.Term("x", r"blue", reject=r"blue moon")
    found = rules.labels(F.col("t"), [term])
    assert one(spark, found, t="blue moon, then blue " + "." * 60 + " blue sky") == []
    assert one(spark, found, t="blue sky") == ["x"]


def test_visible_without_verdict(spark):
    frame = spark.createDataFrame([(None,), (True,), (False,)], "relevant boolean")
    assert frame.where(rules.visible(F.col("relevant"))).count() == 2


def test_merge_copies(spark):
    frame = spark.createDataFrame(
        [("k", 1, 10, "", ["a"], None), ("k", 2, 20, "t", ["b"], False), ("k", 3, 5, "u", ["a", "c"], True)],
        "key string, id int, q int, title string, terms array<string>, relevant boolean",
    )
    row = resolve.merge_copies(frame, "key", "q", "id", fill=["title"], union=["terms"], verdict="relevant").first()
    assert (row["id"], row["title"], row["terms"], row["relevant"]) == (2, "t", ["b", "a", "c"], True)


def test_retention_refuses_before_exempting(spark):
    now = dates.instant("2026-01-01")
    frame = spark.createDataFrame([(1, datetime(2020, 1, 1), True, False), (2, datetime(2020, 1, 1), False, False), (3, datetime(2025, 12, 1), True, True), (4, datetime(2027, 1, 1), True, False)], "id int, at timestamp, ex boolean, no boolean")
    kept = archive.retained(frame, F.col("at"), now, F.col("ex"), F.col("no"))
    assert [r["id"] for r in kept.collect()] == [1]


def test_votes_ties(spark):
    frame = spark.createDataFrame([("i", "drop", None, 5), ("i", "keep", None, 5), ("i", "sentiment", "neutral", 5), ("i", "sentiment", "good", 5)], "item string, vote string, label string, at long")
    found = {r["question"]: (r["vote"], r["label"]) for r in state.resolve_votes(frame).collect()}
    assert found == {"inclusion": ("keep", None), "sentiment": ("sentiment", "good")}


def test_average_linkage_stops_at_half(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a int, b int")
    sizes = spark.createDataFrame([(i, 1) for i in range(1, 6)], "id int, n int")
    found = {r["id"]: r["group"] for r in cluster.average_linkage(links, sizes).collect()}
    # Either end of the chain may go with its middle, but not both.
    assert found in ({1: 1, 2: 1, 3: 3, 4: 4, 5: 4}, {1: 1, 2: 2, 3: 2, 4: 4, 5: 4})


def test_average_linkage_is_that_of_single_merges(spark):
    import random

    draw = random.Random(5)
    n = 45
    links = [(a, b) for a in range(n) for b in range(a + 1, n) if draw.random() < (0.75 if a // 9 == b // 9 else 0.04)]
    weight = {i: draw.randrange(1, 4) for i in range(n)}
    every = spark.createDataFrame([(a, b) for a in range(n) for b in range(a + 1, n)], "a long, b long")
    digest = {(r["a"], r["b"]): r["h"] for r in every.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    linked = set(links)
    around = {i: frozenset({i} | {b for a, b in linked if a == i} | {a for a, b in linked if b == i}) for i in range(n)}
    groups = {}
    for i in range(n):
        groups.setdefault(next(j for j in range(n) if around[j] == around[i]), []).append(i)
    while True:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    count = sum(weight[x] * weight[y] for x in groups[a] for y in groups[b] if (min(x, y), max(x, y)) in linked)
                    size = sum(weight[x] for x in groups[a]) * sum(weight[y] for y in groups[b])
                    if count / size > 0.5:
                        best = max(best or (0,), (count / size, digest[a, b], a, b))
        if best is None:
            break
        groups[best[2]] += groups.pop(best[3])
    want = {x: g for g, members in groups.items() for x in members}
    sizes = spark.createDataFrame(list(weight.items()), "id long, n long")
    found = {r["id"]: r["group"] for r in cluster.average_linkage(spark.createDataFrame(links, "a long, b long"), sizes).collect()}
    assert found == {i: want[i] for i in found} and len(set(found.values())) < 20


def test_rounds_of_linkage_are_planned_alike(spark):
    """Of a table that is known by what made it, the size is multiplied from round to round: planning took 38 s in the 13th of check_s."""
    links = [(a, b) for a in range(18) for b in range(a + 1, 18) if (a * 7 + b * 3) % 5 and b - a < 9]
    sizes = spark.createDataFrame([(i, 1 + i % 3) for i in range(18)], "id long, n long")
    found = cluster.average_linkage(spark.createDataFrame(links, "a long, b long"), sizes)
    assert found.count() == 18 and 1 < found.select("group").distinct().count() < 18
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 40


def test_rows_that_are_linked_alike_are_one_node(spark):
    import random

    draw = random.Random(8)
    day = 86_400
    rows = [(i, draw.randrange(8) * day + draw.choice((0, 0, 0, 7)), draw.choice((None, 5, 5, 5, 5, 5, 5, 5, 6)), draw.randrange(1, 3)) for i in range(120)]
    apart = lambda a, b: rows[a][2] is None or rows[a][2] != rows[b][2]
    other = {(a, b) for a in range(120) for b in range(a + 1, 120) if apart(a, b) and (a == 3 or (a, b) in ((10, 20), (30, 40)) or draw.random() < 0.001)}
    near = {(a, b) for a in range(120) for b in range(a + 1, 120) if not apart(a, b) and abs(rows[a][1] - rows[b][1]) <= 3 * day}
    frame = spark.createDataFrame(rows, "id long, s long, kin long, rows long").withColumn("at", F.timestamp_seconds("s"))
    nodes, links, sizes = cluster.alike_rows(frame, spark.createDataFrame(sorted(other), "a long, b long"), 3)
    inside: dict[int, list[int]] = {}
    for r in nodes.collect():
        inside.setdefault(r["node"], []).append(r["id"])
    met = [(r["a"], r["b"]) for r in links.collect()]
    got = {(min(x, y), max(x, y)) for a, b in met for x in inside[a] for y in inside[b]} | {(x, y) for m in inside.values() for x in m for y in m if x < y}
    assert got == other | near and len(met) == len(set(met)) < len(got) / 4
    assert {r["id"]: r["n"] for r in sizes.collect()} == {a: sum(rows[x][3] for x in m) for a, m in inside.items() if any(a in pair for pair in met)}


def test_stories_of_one_title_are_linked_by_nodes(spark):
    """300 reports of one title in ten days, each in words of its own: 44,850 pairs less those too far apart."""
    rows = [(i, "Harbour ferry sinks near island", f"crew{i} rescued{i} after{i} dawn{i}", f"outlet{i % 7}", "n", i % 10) for i in range(300)]
    rows += [(400, "Orchard frost ruins apples", "Growers count losses", "o", "n", 2), (401, "Harbour ferry", "crew7 rescued7", "p", "n", 8)]
    frame = spark.createDataFrame(rows, "id long, title string, text string, outlet string, block string, day int").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("day") * 86_400))
    linkage, given = cluster.average_linkage, []
    cluster.average_linkage = lambda links, sizes: (given.append(links.count()), linkage(links, sizes))[1]
    try:
        found = {r["id"]: r["group"] for r in cluster.groups(frame, "id", "title", "text", "at", "outlet", "block", F.lit(False)).collect()}
    finally:
        cluster.average_linkage = linkage
    assert given[0] < 500 and len(found) == 302 and found[400] == 400 and len({found[i] for i in range(300)}) < 6


def test_years_blank_outlets_and_word_endings(spark):
    row = spark.range(1).select(text.story_terms(F.lit("Enrolled enrollees' enrollment under the Affordable Care Act: 1,200 people")).alias("t")).first()["t"]
    assert row[0] == row[1] == row[2] == "enrol" and "aca" in row and "1200" in row
    rows = [
        (1, "Ferry harbour opens new pier 2026", "Mayor cuts ribbon 2026", "", 0),
        (2, "Ferry harbour closes old berth 2026", "Engineers warn rust 2026", "", 1),
        (3, "Orchard frost ruins apples - The Paper", "Growers count losses", "", 2),
        (4, "Orchard frost ruins apples", "Growers count losses now", "", 3),
    ]
    frame = spark.createDataFrame([(*r[:4], datetime(2026, 1, 1 + r[4] // 3), "n") for r in rows], "id long, title string, text string, outlet string, at timestamp, block string")
    found = {r["id"]: r["group"] for r in cluster.groups(frame, "id", "title", "text", "at", "outlet", "block", F.lit(False)).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 3}


def test_feeds(spark):
    rss = "<rss><channel><item><title><![CDATA[A &amp; B]]></title><link>/x</link><pubDate>Wed, 30 Sep 2026 17:00:00 GMT</pubDate></item></channel></rss>"
    atom = '<feed><entry><title>C</title><link href="https://c.org/1"/><id>1</id><updated>2026-09-30T17:00:00Z</updated></entry></feed>'
    frame = spark.createDataFrame([("r", rss, "https://a.org/f"), ("a", atom, "https://c.org"), ("n", "<html/>", "")], "source string, xml string, base string")
    found = {r["source"]: (r["title"], r["link"], r["published"]) for r in feeds.feed_items(frame, "xml", "source", "base").collect()}
    assert found == {"r": ("A & B", "https://a.org/x", datetime(2026, 9, 30, 17)), "a": ("C", "https://c.org/1", datetime(2026, 9, 30, 17))}


def test_calendar_round(spark):
    events = spark.createDataFrame([(date(2026, 9, 30), "09:30", "A, b", "body " * 30, "https://x.org")], "day date, time string, title string, body string, url string")
    block = outputs.ics_blocks(events, dates.instant("2026-01-01")).first()["value"]
    assert all(len(line.encode()) <= 75 for line in block.split("\r\n"))
    row = feeds.ics_events(spark.createDataFrame([(block,)], "t string"), "t").first()
    assert (row["day"], row["time"], row["title"]) == (date(2026, 9, 30), "09:30", "A, b")


def test_article_text(spark):
    html = "<html><title>T</title><nav><p>menu</p></nav><article><p>First paragraph, long enough.</p></article><p>foot</p></html>"
    row = feeds.article_text(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html").orderBy("id").collect()
    assert (row[0]["title"], row[0]["text"], row[1]["text"]) == ("T", "First paragraph, long enough.", "")


def test_stories_of_many_copies_are_those_of_all_pairs(spark):
    copies = [(i, "Harbour ferry sinks near island", "Crew rescued after ferry capsized at dawn") for i in range(210)]
    others = [(300, "Council debates parking levy", "Members postponed voting"), (301, "Council debates parking levy again", "Members postponed voting"), (302, "Orchard frost ruins apples", "Growers count losses")]
    rows = [(i, t, x, f"outlet{i}", "news") for i, t, x in copies + others]
    frame = spark.createDataFrame(rows, "id long, title string, text string, outlet string, block string").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60))
    found = {r["id"]: r["group"] for r in cluster.groups(frame, "id", "title", "text", "at", "outlet", "block", F.lit(False)).collect()}
    assert found == {i: 0 for i in range(210)} | {300: 300, 301: 300, 302: 302}


def test_stories_write_no_pairs_that_cannot_link(spark):
    """Pages of common words: nearly all pairs share some, and none of them is written."""
    import random
    from pathlib import Path

    draw = random.Random(9)
    words = [f"{a}{b}ustrolk" for a in "bcdfghklmnprstvz" for b in "aeiou"]
    rows = [(i, f"{words[i % 80]} {words[i * 7 % 79]}", " ".join(draw.sample(words, 20)), f"o{i}", "n") for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, title string, text string, outlet string, block string").withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 60))
    folder = Path(cluster.checkpoint_folder(spark).removeprefix("file:"))
    room = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before, links = room(), cluster.average_linkage
    found = []
    cluster.average_linkage = lambda *given: (found.append(room() - before), links(*given))[1]
    try:
        assert cluster.groups(frame, "id", "title", "text", "at", "outlet", "block", F.lit(False)).count() == 400
    finally:
        cluster.average_linkage = links
    assert found[0] < 600_000, found


def test_pairs_of_parts_are_all_pairs(spark, monkeypatch):
    """Parts and slices of a few rows, times on both sides of buckets' ends."""
    import random

    monkeypatch.setattr(cluster, "PART", 8)
    monkeypatch.setattr(cluster, "SLICE", 3)
    draw = random.Random(10)
    day = 86_400
    rows = [(i, draw.randrange(12 * day), draw.choice("mn"), [f"t{draw.randrange(9)}" for _ in range(draw.randrange(1, 9))], [f"t{draw.randrange(9)}" for _ in range(draw.randrange(3))]) for i in range(90)]
    rows[1] = (1, rows[0][1] + 3 * day, rows[0][2], *rows[0][3:])
    rows[2] = (2, rows[0][1] - 3 * day, rows[0][2], *rows[0][3:])
    frame = spark.createDataFrame(rows, "id long, s long, block string, full array<string>, own array<string>").withColumn("at", F.timestamp_seconds("s"))
    frequencies = cluster.inverse_frequencies(frame, F.concat("full", "own")).cache()
    vectors = [{}, {}]
    for found, c in zip(vectors, ("full", "own")):
        for r in cluster.vectors(frame, "id", F.col(c), frequencies).collect():
            found.setdefault(r["id"], {})[r["term"]] = r["w"]
    want = {}
    for a, x in enumerate(rows):
        for b, y in enumerate(rows[:a]):
            full, title = (sum(w * v.get(b, {}).get(t, 0) for t, w in v.get(a, {}).items()) for v in vectors)
            if x[2] == y[2] and abs(x[1] - y[1]) <= 3 * day and (full >= 0.45 or title >= 0.5 or full >= 0.25 and title >= 0.2):
                want[b, a] = (round(full, 9), round(title, 9))
    packed = frame.select("id", "at", "block").join(cluster.packed_vectors(frame, frequencies), "id")
    got = [((r["a"], r["b"]), (round(r["full_cosine"], 9), round(r["title_cosine"], 9))) for r in cluster.likely_pairs(packed, 3).collect()]
    assert len(got) == len(want) > 100 and dict(got) == want and {(0, 1), (0, 2)} <= set(want)


def test_products_of_common_and_rare_terms(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(4)
    sides = [np.where(draw.random((n, 30)) < draw.random(30) ** 2, draw.random((n, 30)), 0) for n in (23, 17)]
    sides[0][:, 5] = sides[1][:, 6] = 0
    parts = []
    for side in sides:
        rows, terms = np.nonzero(side)
        order = np.lexsort((draw.random(len(rows)), rows))
        parts.append((rows[order], (terms * 7919 - 9)[order], side[rows, terms][order]))
    for rare, at_once in ((1e-9, 3), (4, 5), (1e9, 3)):
        monkeypatch.setattr(cluster, "RARE", rare)
        monkeypatch.setattr(cluster, "AT_ONCE", at_once)
        found = cluster.Products(*parts, 23, 17)
        got = np.concatenate([found.of(low, min(10, 23 - low)) for low in (0, 10, 20)])
        assert np.allclose(got, sides[0] @ sides[1].T)
    none = (np.array([], int),) * 2 + (np.array([]),)
    assert (cluster.Products(none, parts[1], 4, 17).of(0, 4) == 0).all()


def test_leading_terms_meet_all_pairs(spark):
    import random

    draw = random.Random(6)
    rows = [(i, [f"t{min(draw.randrange(1, 40), draw.randrange(1, 40))}" for _ in range(draw.randrange(1, 15))]) for i in range(60)]
    weights = cluster.vectors(spark.createDataFrame(rows, "id long, terms array<string>"), "id", F.col("terms")).cache()
    vector: dict[int, dict[str, float]] = {}
    for r in weights.collect():
        vector.setdefault(r["id"], {})[r["term"]] = r["w"]
    for least in (0.25, 0.5):
        first: dict[int, set[str]] = {i: set() for i in vector}
        for r in cluster.leading(weights, least).collect():
            first[r["id"]].add(r["term"])
        near = [(a, b) for a in vector for b in vector if a < b and sum(w * vector[b].get(t, 0) for t, w in vector[a].items()) >= least]
        assert near and all(first[a] & first[b] for a, b in near)


def test_numbers_are_rewritten_once(spark):
    """Each unit's pattern stands in the plan twice, to split a text and to find in it; nothing is computed again for each match."""
    rows = spark.createDataFrame([("2k and 3 million, 1,000 or 1.5b",), (None,), ("",)], "t string").select(text.plain_numbers(F.col("t")).alias("t"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3
    assert [r["t"] for r in rows.collect()] == ["2000 and 3000000, 1000 or 1500000000", None, ""]
