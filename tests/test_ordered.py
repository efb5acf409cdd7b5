"""Running sums, nearest marks and chains of openers against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import alerts, ordered, selection, state


def test_running_sums_over_many_ranges(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "b"]), None if draw.random() < 0.1 else draw.randrange(9)) for i in range(3000)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "id int, kind string, v int").repartition(7)
    found = ordered.running(frame, [F.col("kind").desc(), F.col("id")], {"n": F.lit(1), "total": F.col("v")}).collect()
    want, n, total = {}, 0, 0
    for i, _, v in sorted(rows, key=lambda r: (-ord(r[1]), r[0])):
        n, total = n + 1, total + (v or 0)
        want[i] = (n, total)
    assert {r["id"]: (r["n"], r["total"]) for r in found} == want
    assert ordered.running(frame.limit(0), [F.col("id")], {"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("later", [True, False])
def test_nearest_marks(spark, later):
    draw = random.Random(2)
    marks = [(draw.choice("ab"), draw.randrange(-500, 500)) for _ in range(60)]
    points = [(draw.choice("abc"), draw.randrange(-600, 600), i) for i in range(300)]
    found = ordered.nearest(spark.createDataFrame(points, "k string, at long, id int"), spark.createDataFrame(marks, "k string, at long"), ["k"], "at", 37, later=later).collect()
    for k, at, i in points:
        own = [m for key, m in marks if key == k and (m >= at if later else m <= at)]
        assert {r["id"]: r["mark"] for r in found}[i] == ((min if later else max)(own) if own else None)


def folded(seconds: list[int], step: int) -> dict[int, int]:
    out: dict[int, int] = {}
    opened = None
    for s in sorted(seconds):
        if opened is None or s >= opened + step:
            opened = s
        out[opened] = out.get(opened, 0) + 1
    return out


def test_batches_are_those_of_a_fold(spark):
    draw = random.Random(3)
    start = datetime(2026, 1, 1)
    rows = [("hot", draw.randrange(2_000_000)) for _ in range(20_000)] + [(k, draw.randrange(20_000)) for k in "abc" for _ in range(30)] + [(None, 5)]
    frame = spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in rows] + [("a", None)], "k string, at timestamp")
    found = state.batches(frame, "k", "at", 35).collect()
    got: dict[str, dict[int, int]] = {}
    for r in found:
        got.setdefault(r["k"], {})[int((r["opened"] - start).total_seconds())] = r["n"]
    assert got == {k: folded([s for key, s in rows if key == k], 35 * 60) for k in ("hot", "a", "b", "c")}
    assert len(got["hot"]) > 800


def test_packing_is_that_of_a_fold(spark):
    draw = random.Random(4)
    for most in (12, 30, 400):
        lines = [(i, draw.choice("xyz") * draw.choice([0, 1, 3, 7, 20])) for i in range(150)]
        found = alerts.packed(spark.createDataFrame([*lines, (999, None)], "place int, line string").repartition(5), "place", "line", "H", most)
        want: list[str] = []
        for _, line in lines:
            if not line:
                continue
            if want and len(want[-1]) + len(line) <= most - 1:
                want[-1] += line
            else:
                want.append(line)
        assert [r["body"] for r in found.orderBy("message").collect()] == ["H" + x for x in want]


def test_ranks_and_bytes(spark):
    frame = spark.createDataFrame([(i, i % 3 == 0, i % 4) for i in range(40)], "id int, urgent boolean, section int")
    ranks = {r["id"]: r["rank"] for r in selection.leading(frame, F.col("urgent"), "id").collect()}
    assert sorted(ranks, key=ranks.get) == sorted(range(40), key=lambda i: (i % 3 != 0, i))
    kept = selection.within_bytes(frame, "section", "id", "id", 100, 10).collect()
    assert sum(r["id"] for r in kept) <= 90 and {r["section"] for r in kept} == {0}
