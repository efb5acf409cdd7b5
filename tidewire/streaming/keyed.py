"""Keyed state that expires: batches of alerts, streaks, alerts told once, rests of sources.

A key's rows come in any order within what the watermark allows. They are counted into a map by
second, each second with a timer, and taken in order once the watermark has passed them; so what comes out
is what the batch operators make of the same rows, and a key's rows are never in one place. Rows
later than the watermark are left out. State goes by timers too: nothing is kept of a key that
has been quiet for as long as the operator says.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StructField, StructType

#: Where state is kept; the operators need it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


TYPES = {"long": LongType(), "int": IntegerType(), "boolean": BooleanType()}


def kind(text: str, **given: DataType) -> StructType:
    """A row's type from names and types, made without a session: workers need it too. `given` names other types."""
    pairs = [pair.split() for pair in text.split(", ")]
    return StructType([StructField(name, given.get(name) or TYPES[own]) for name, own in pairs])


class InOrder(StatefulProcessor):
    """Rows of a key, counted by second and sort, taken in order when the watermark has passed them.

    A subclass says what a second's rows do (`take`) and, if it sets timers of its own, what is due
    (`due`). Rows have `key`, `at` (seconds) and `sort` (a small number).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", kind("at long, sort int"), kind("n long"))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            at = (row["at"], row["sort"])
            have = self.waiting.getValue(at)
            self.waiting.updateValue(at, ((have[0] if have else 0) + 1,))
            if have is None:
                self.handle.registerTimer(1000 * row["at"])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        yield from self.due(key[0], now)
        for sort in self.sorts:
            have = self.waiting.getValue((now, sort))
            if have is not None:
                self.waiting.removeKey((now, sort))
                yield from self.take(key[0], now, sort, have[0])

    #: Sorts of rows in the order in which those of one second are taken.
    sorts: tuple[int, ...] = (0,)

    def due(self, key: Any, now: int) -> Iterator[Row]:
        return iter(())

    def take(self, key: Any, now: int, sort: int, n: int) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Batches(InOrder):
    """Alerts merged into batches; a batch comes out when the time that it is open is over."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", kind("opened long, n long"))

    def due(self, key: Any, now: int) -> Iterator[Row]:
        if self.open.exists():
            opened, n = self.open.get()
            if now >= opened + self.gap:
                self.open.clear()
                yield Row(key=key, opened=opened, n=n)

    def take(self, key: Any, now: int, sort: int, n: int) -> Iterator[Row]:
        if self.open.exists():
            opened, had = self.open.get()
            self.open.update((opened, had + n))
        else:
            self.open.update((now, n))
            self.handle.registerTimer(1000 * (now + self.gap))
        return iter(())


class Streaks(InOrder):
    """Failures in a row as of each second; a key that is quiet for long starts anew."""

    # Of one second a success comes first: a failure then is what holds.
    sorts = (0, 1)

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.run = handle.getValueState("run", kind("streak long, last long"))

    def due(self, key: Any, now: int) -> Iterator[Row]:
        if self.run.exists() and now >= self.run.get()[1] + self.quiet:
            self.run.clear()
        return iter(())

    def take(self, key: Any, now: int, sort: int, n: int) -> Iterator[Row]:
        streak = self.run.get()[0] if self.run.exists() else 0
        for _ in range(n):
            streak = streak + 1 if sort else 0
            yield Row(key=key, at=now, streak=streak)
        self.run.update((streak, now))
        self.handle.registerTimer(1000 * (now + self.quiet))


class Once(InOrder):
    """The first of a key's alerts; another one is told only when none has come for as long as the key is held."""

    def __init__(self, held: int):
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", kind("at long"))

    def due(self, key: Any, now: int) -> Iterator[Row]:
        if self.last.exists() and now >= self.last.get()[0] + self.held:
            self.last.clear()
        return iter(())

    def take(self, key: Any, now: int, sort: int, n: int) -> Iterator[Row]:
        known = self.last.exists()
        self.last.update((now,))
        self.handle.registerTimer(1000 * (now + self.held))
        if not known:
            yield Row(key=key, at=now)


class Rests(InOrder):
    """Sources that rest after errors: when a rest begins, is prolonged or ends. `sort` is the rest in minutes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("until", kind("at long"))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if self.until.exists() and now >= self.until.get()[0]:
            self.until.clear()
            yield Row(key=key[0], at=now, resting=False, until=now)
        # Of one second's errors the longest rest counts. What waits at other seconds has timers of its own.
        rests = [sort for (at, sort), _ in self.waiting.iterator() if at == now]
        for sort in rests:
            self.waiting.removeKey((now, sort))
        if rests:
            until = now + 60 * max(rests)
            if not self.until.exists() or self.until.get()[0] < until:
                self.until.update((until,))
                self.handle.registerTimer(1000 * until)
                yield Row(key=key[0], at=now, resting=True, until=until)


def _keyed(stream: DataFrame, key: str, at: str, late: str, processor: StatefulProcessor, out: str, sort: Column | None = None) -> DataFrame:
    timed = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    rows = timed.select(F.col(key).alias("key"), F.unix_seconds(at).alias("at"), (F.lit(0) if sort is None else sort).cast("int").alias("sort"), F.col(at).alias("_time"))
    return rows.groupBy("key").transformWithState(processor, kind(f"key own, {out}", key=rows.schema["key"].dataType), "Append", "EventTime")


def alert_batches(stream: DataFrame, key: str, at: str, gap_minutes: int = 35, late: str = "2 hours") -> DataFrame:
    """(key, opened, n) of batches once the watermark passes the end of the time they are open."""
    found = _keyed(stream, key, at, late, Batches(60 * gap_minutes), "opened long, n long")
    return found.select(F.col("key").alias(key), F.timestamp_seconds("opened").alias("opened"), "n")


def failure_streaks(stream: DataFrame, key: str, at: str, failed: Column, quiet_days: int = 30, late: str = "2 hours") -> DataFrame:
    """(key, at, streak): failures in a row as of each row, in order of seconds; in one second successes come first."""
    found = _keyed(stream, key, at, late, Streaks(86_400 * quiet_days), "at long, streak long", F.coalesce(failed, F.lit(False)).cast("int"))
    return found.select(F.col("key").alias(key), F.timestamp_seconds("at").alias("at"), "streak")


def new_alerts(stream: DataFrame, key: str, at: str, held_days: int = 90, late: str = "2 hours") -> DataFrame:
    """(key, at) of the first alert of each key, and of one after so long a silence."""
    found = _keyed(stream, key, at, late, Once(86_400 * held_days), "at long")
    return found.select(F.col("key").alias(key), F.timestamp_seconds("at").alias("at"))


def rests(stream: DataFrame, key: str, at: str, seconds: Column, late: str = "2 hours") -> DataFrame:
    """(key, at, resting, until) whenever a source begins to rest, rests longer, or may be asked again. Rests count in whole minutes."""
    found = _keyed(stream, key, at, late, Rests(), "at long, resting boolean, until long", F.ceil(seconds / 60))
    return found.select(F.col("key").alias(key), F.timestamp_seconds("at").alias("at"), "resting", F.timestamp_seconds("until").alias("until"))
