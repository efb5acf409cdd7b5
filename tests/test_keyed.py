"""Streams with timers against batch operators and plain loops: order, late rows, restarts, expiry."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import state
from tidewire.streaming import keyed

START = datetime(2026, 1, 1)
SCHEMA = "key string, at timestamp, failed boolean, seconds int"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get(*keyed.STORE[:1], None)
    spark.conf.set(*keyed.STORE)
    yield
    spark.conf.unset(keyed.STORE[0]) if before is None else spark.conf.set(keyed.STORE[0], before)


class Feed:
    """Files that arrive one after the other, and a query over them that is started anew each time."""

    def __init__(self, spark, folder, apply):
        self.spark, self.folder, self.apply, self.n = spark, folder, apply, 0

    def give(self, *batches):
        for rows in batches:
            frame = self.spark.createDataFrame([(k, START + timedelta(seconds=s), f, w) for k, s, f, w in rows], SCHEMA)
            frame.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        return self.run()

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        query = self.apply(stream).writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/ck").trigger(availableNow=True).start()
        query.awaitTermination(300)
        return self.spark.read.parquet(f"{self.folder}/out")


def row(key, second, failed=False, seconds=None):
    return (key, second, failed, seconds)


#: A row far ahead, whose arrival lets the watermark pass all others; its own key tells nothing.
END = [row(None, 10**8), row("end", 10**8)]


def test_batches_are_those_of_the_batch_operator(spark, tmp_path):
    draw = random.Random(1)
    rows = [row(draw.choice("ab"), draw.randrange(40_000)) for _ in range(250)]
    feed = Feed(spark, tmp_path, lambda s: keyed.alert_batches(s, "key", "at", 35, "20 hours"))
    # Out of order within the watermark, over files, with a restart between.
    feed.give(rows[:90], rows[90:150])
    feed.give(rows[150:])
    found = feed.give(END, [row("end", 10**8 + 1)])
    frame = spark.createDataFrame([(k, START + timedelta(seconds=s)) for k, s, _, _ in rows], "key string, at timestamp")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, state.batches(frame, "key", "at", 35).select("key", "opened", "n").collect()))


def test_late_rows_are_left_out(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: keyed.alert_batches(s, "key", "at", 1, "10 seconds"))
    feed.give([row("a", 0), row("a", 30)], [row("a", 500)], [row("b", 501)])
    found = feed.give([row("a", 31), row("a", 495)], [row("end", 10**8)], [row("end", 10**8 + 1)]).orderBy("opened").collect()
    assert [((r["opened"] - START).total_seconds(), r["n"]) for r in found if r["key"] == "a"] == [(0, 2), (495, 2)]


def test_streaks_are_those_of_the_batch_operator(spark, tmp_path):
    draw = random.Random(2)
    seconds = draw.sample(range(5000), 120)
    rows = [row(draw.choice("ab"), s, draw.random() < 0.7) for s in seconds]
    feed = Feed(spark, tmp_path, lambda s: keyed.failure_streaks(s, "key", "at", F.col("failed"), late="5 hours"))
    feed.give(rows[:50])
    found = feed.give(rows[50:], END, [row("end", 10**8 + 1)]).where("key <> 'end'")
    frame = spark.createDataFrame([(k, START + timedelta(seconds=s), f) for k, s, f, _ in rows], "key string, at timestamp, failed boolean")
    want = state.streaks(frame, "key", "at", "at", F.col("failed")).select("key", "at", "streak").collect()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want))


def test_quiet_keys_start_anew(spark, tmp_path):
    day = 86_400
    feed = Feed(spark, tmp_path, lambda s: keyed.failure_streaks(s, "key", "at", F.col("failed"), 2, "1 hour"))
    found = feed.give([row("a", 0, True), row("a", 60, True)], [row("a", day, True)], [row("a", 4 * day, True)], END, [row("end", 10**8 + 1)])
    assert [r["streak"] for r in found.where("key = 'a'").orderBy("at").collect()] == [1, 2, 3, 1]


def test_alerts_are_told_once_while_held(spark, tmp_path):
    day = 86_400
    feed = Feed(spark, tmp_path, lambda s: keyed.new_alerts(s, "key", "at", 10, "1 hour"))
    found = feed.give([row("a", 5), row("a", 0), row("b", 7)], [row("a", 9 * day)], [row("a", 18 * day)], [row("a", 30 * day)], END, [row("end", 10**8 + 1)])
    assert sorted((r["key"], (r["at"] - START).total_seconds()) for r in found.where("key <> 'end'").collect()) == [("a", 0), ("a", 30 * day), ("b", 7)]


def test_rests_begin_grow_and_end(spark, tmp_path):
    seconds = state.cooldown_seconds(F.lit(None).cast("int"), F.col("seconds"))
    feed = Feed(spark, tmp_path, lambda s: keyed.rests(s.where("seconds IS NOT NULL OR key IS NULL OR key = 'end'"), "key", "at", seconds, "1 minute"))
    found = feed.give([row("a", 0, True, 600), row("a", 0, True, 120), row("a", 60, True, 120), row("a", 300, True, 900)], [row("a", 5000, True, 60)], [row("end", 10**7, True, 60)], [row("end", 10**8, True, 60)])
    got = [((r["at"] - START).total_seconds(), r["resting"], (r["until"] - START).total_seconds()) for r in found.where("key = 'a'").orderBy("at").collect()]
    assert got == [(0, True, 600), (300, True, 1200), (1200, False, 1200), (5000, True, 5060), (5060, False, 5060)]
