"""Frozen texts over runs, and small rules of saved state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import frozen

A, B, C = ("a" * 64, "b" * 64, "c" * 64)


def test_texts_stay_as_they_were_first_seen(spark):
    schema = "id string, place int, provenance string, excerpt string, outlet string, title string"
    run = lambda rows: spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([], "id string, excerpt string, outlet string, title string")
    first, state = frozen.freeze(run([(A, 1, "list", " One  text ", "", "T1"), (B, 2, "team feedback", "", "", "T2"), ("odd", 3, "list", "x", "y", "z"), (C, 4, "list", "room?", "", "")]), none, "place", 2)
    assert {r["id"]: (r["excerpt"], r["added"], r["changed"], r["lost"]) for r in first.collect()} == {A: (" One  text ", True, False, False), B: ("", True, False, False), "odd": ("x", False, False, False), C: ("room?", False, False, False)}
    assert {r["id"]: tuple(r)[1:] for r in state.collect()} == {A: ("One text", None, None), B: (None, None, "T2")}
    second, state = frozen.freeze(run([(A, 1, "list", "Other", "Paper", "T9"), (B, 2, "team feedback", "Late", "", " ")]), state, "place", 2)
    got = {r["id"]: (r["excerpt"], r["outlet"], r["title"], r["added"], r["changed"], r["lost"]) for r in second.collect()}
    assert got == {A: ("One text", "Paper", "T9", True, True, False), B: ("Late", "", "T2", True, False, True)}
    assert {r["id"]: tuple(r)[1:] for r in state.collect()} == {A: ("One text", "Paper", None), B: ("Late", None, "T2")}


def test_saved_texts_made_valid(spark):
    rows = [(A, 2, "x" * 900, None, " "), ("A" * 64, 1, "x", "y", "z"), (B, 3, " ", "", None), (C, 4, None, " o ", None)]
    frame = spark.createDataFrame(rows, "id string, place int, excerpt string, outlet string, title string")
    assert sorted((r["id"][0], len(r["excerpt"] or ""), r["outlet"], r["title"]) for r in frozen.valid_texts(frame, "place").collect()) == [("a", 700, None, None), ("c", 0, "o", None)]
    assert [r["id"] for r in frozen.valid_texts(frame, "place", 1).collect()] == [A]


def test_links_odds_and_contexts(spark):
    rows = [("https://a.org/?utm_source=x", "https://a.org/#f"), ("https://a.org/#f", "https://a.org/"), ("https://a.org/", "https://b.org/"), (None, "https://b.org/?utm_source=x")]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in frame.select(frozen.shown_link(F.col("a"), F.col("b"))).collect()] == ["https://a.org/#f", "https://a.org/", "https://a.org/", None]
    one = spark.range(1)
    assert one.select(frozen.signals({"x": F.lit(0.5), "y": F.lit(1.5)})).first()[0].asDict() == {"x": 0.5, "y": None}
    assert one.select(frozen.signals({"x": F.lit(-1.0), "y": F.lit(None).cast("double")})).first()[0] is None
    said = '{"storylines":[{"name":" Rates ","note":"Watch  them","match":[" Premium ",""]},{"name":"No note","match":["x"]},{"note":"no name","match":["x"]},{"name":"n","note":"n","match":[]}]}'
    found = spark.createDataFrame([(said,), ("odd",), (None,)], "j string").select(frozen.contexts(F.col("j")).alias("c")).collect()
    assert [[(e["name"], e["note"], e["match"]) for e in r["c"]] for r in found] == [[("Rates", "Watch them", ["premium"])], [], []]
    note = frozen.context_of(F.lit("A PREMIUM rise"), [("Rates", "Watch", ("premium", "x")), ("Other", "No", ("zzz",))])
    assert one.select(note).first()[0] == "Rates: Watch"
