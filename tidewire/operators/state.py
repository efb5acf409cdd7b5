"""Keyed state from event logs: votes, streaks, fixed windows, alerts, subscriptions, cache misses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.archive import hours
from tidewire.operators.cluster import cut
from tidewire.operators.ordered import nearest, openers


def resolve_votes(votes: DataFrame, item: str = "item", vote: str = "vote", label: str = "label", at: str = "at") -> DataFrame:
    """(item, question, vote, label, at): the latest vote on each question of an item.

    Keeping and dropping are one question, labels another. At the same time keep beats
    drop, and of labels the smaller one counts. An aggregation, so no item's votes are gathered.
    """
    question = F.when(F.col(vote).isin("keep", "drop"), "inclusion").when(F.col(vote) == "sentiment", "sentiment")
    rows = votes.select(F.col(item).alias("item"), question.alias("question"), F.col(vote).alias("vote"), F.col(label).alias("label"), F.col(at).alias("at"))
    rank = F.struct((-F.unix_micros(F.col("at").cast("timestamp")) if dict(rows.dtypes)["at"].startswith("timestamp") else -F.col("at")).alias("t"), F.when(F.col("vote") == "drop", 1).otherwise(0).alias("d"), "label")
    valid = rows.where("item IS NOT NULL AND question IS NOT NULL AND at IS NOT NULL AND (question = 'inclusion' OR label IS NOT NULL)")
    best = valid.groupBy("item", "question").agg(F.min_by(F.struct("vote", "label", "at"), rank).alias("x"))
    return best.select("item", "question", "x.vote", "x.label", "x.at")


def apply_votes(items: DataFrame, votes: DataFrame, applied: DataFrame, identity: str, relevant: str) -> tuple[DataFrame, DataFrame]:
    """Items with votes on inclusion applied or, where a vote was withdrawn, undone; and the new state.

    `applied` holds (identity, baseline) of earlier votes. An item without a vote but with a
    baseline gets that back; one with a vote takes it and keeps its first baseline.
    """
    inclusion = votes.where("question = 'inclusion'").select(F.col("item").alias(identity), (F.col("vote") == "keep").alias("_voted"))
    joined = items.join(inclusion, identity, "left").join(applied.select(identity, F.col("baseline").alias("_base"), F.lit(True).alias("_had")), identity, "left")
    was = F.when(F.col("_had"), F.col("_base")).otherwise(F.col(relevant))
    value = F.when(F.col("_voted").isNotNull(), F.col("_voted")).otherwise(was)
    out = joined.select(*(value.alias(c) if c == relevant else c for c in items.columns))
    state = joined.where("_voted IS NOT NULL").select(identity, was.alias("baseline"))
    return out, state


def streaks(frame: DataFrame, key: str, at: str, tie: str, failed: Column) -> DataFrame:
    """The frame with `streak`: how many failures in a row end at each row, 0 at a success."""
    order = W.partitionBy(key).orderBy(at, tie)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    island = frame.withColumn("_failed", failed).withColumn("_island", F.sum(F.when(F.col("_failed"), 0).otherwise(1)).over(upto))
    within = W.partitionBy(key, "_island").orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(F.when(F.col("_failed"), 1).otherwise(0)).over(within)).drop("_failed", "_island")


def failure_alerts(current: DataFrame, least: int, targets: Sequence[str]) -> DataFrame:
    """(…, pending) of sources whose streak is long enough and that some target hasn't been told of."""
    told = F.coalesce(F.col("delivered"), F.array().cast("array<string>"))
    pending = F.array_except(F.array(*map(F.lit, targets)), told)
    return current.withColumn("pending", pending).where((F.col("streak") >= least) & (F.size("pending") > 0))


def fixed_windows(frame: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """(key, window_start, n, allowed, refused): hits per fixed window of the epoch, and how many a limit lets through."""
    start = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds) * seconds
    counted = frame.groupBy(key, start.cast("long").alias("window_start")).agg(F.count("*").alias("n"))
    return counted.withColumns({"allowed": F.least("n", F.lit(limit)).cast("long"), "refused": F.greatest(F.col("n") - limit, F.lit(0)).cast("long")})


def batches(frame: DataFrame, key: str, at: str, gap_minutes: int = 35, stretch_hours: int = 24) -> DataFrame:
    """(key, opened, n): alerts merged into batches, each open for `gap_minutes` after its first one.

    A batch's end counts from its first alert, not its last. Each second at which a key has alerts
    gets the second that would open the next batch, and the chain of openers from the first
    one on is found by doubled steps; no key's alerts are gathered. A key's seconds are
    looked through by stretches of `stretch_hours`. Alerts without a time or a key are left out.
    """
    step, width = gap_minutes * 60, stretch_hours * 3600
    rows = frame.where(F.col(at).isNotNull() & F.col(key).isNotNull())
    seconds = cut(rows.groupBy(key, F.unix_seconds(F.col(at).cast("timestamp")).alias("s")).agg(F.count("*").alias("n")))
    marks = seconds.select(key, "s")
    ends = nearest(marks.select(key, F.col("s").alias("own"), (F.col("s") + step).alias("s")), marks, [key], "s", width, "following")
    chain = openers(ends.select(key, F.col("own").alias("s"), "following"), [key], "s", "following")
    opened = nearest(seconds, chain, [key], "s", width, "opened", later=False)
    return opened.groupBy(key, F.timestamp_seconds("opened").alias("opened")).agg(F.sum("n").alias("n"))


def new_alerts(items: DataFrame, seen: DataFrame, key: str, seeded: bool) -> DataFrame:
    """Items whose key the state doesn't have; none while the state is not seeded yet."""
    fresh = items.join(seen.select(key).distinct(), key, "left_anti")
    return fresh if seeded else fresh.limit(0)


def latest_state(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last event of each key: the state of a machine whose every event tells the state it leads to."""
    row = F.struct(*events.columns)
    return events.groupBy(key).agg(F.max_by(row, F.struct(at, tie)).alias("row")).select("row.*")


def send_candidates(subscribers: DataFrame, subscriptions: DataFrame, sends: DataFrame, identity: str, content: str, now: Column, most_attempts: int = 3) -> DataFrame:
    """Active subscribers to whom a content hasn't been sent, or failed and may be tried again."""
    done = sends.where(F.col("content_key") == content).select(F.col(identity), "status", "attempts")
    wanted = subscribers.where("status = 'active'").join(subscriptions, identity)
    joined = wanted.alias("w").join(done.alias("d"), identity, "left")
    again = F.col("d.status").isNull() | ((F.col("d.status") == "failed") & (F.col("d.attempts") < most_attempts))
    return joined.where(again).select("w.*")


def housekeeping(frame: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows younger than so many days."""
    return frame.where(F.col(at) >= now - hours(24 * days))


def classify_miss(requests: DataFrame, key: str, known: Sequence[tuple[str, DataFrame]], default: str = "new") -> DataFrame:
    """(key, reason): the first table that has a request's key names why its lookup missed."""
    out = requests.select(key)
    for name, table in known:
        out = out.join(table.select(key, F.lit(True).alias(f"_{name}")).distinct(), key, "left")
    reason = F.lit(default)
    for name, _ in reversed(known):
        reason = F.when(F.col(f"_{name}"), F.lit(name)).otherwise(reason)
    return out.select(key, reason.alias("reason"))


def cooldown_seconds(status: Column, retry_after: Column) -> Column:
    """How long a source rests after an error: what it asks for up to a day, else by its status."""
    asked = F.least(retry_after.cast("long"), F.lit(86_400))
    return F.coalesce(asked, F.when(status == 403, 86_400).when(status == 429, 7_200).otherwise(3_600).cast("long"))


def fresh_seconds(cache_control: Column, age: Column, most: int) -> Column:
    """How long a response stays fresh: max-age without its age, capped; null where it may not be kept."""
    max_age = F.nullif(F.regexp_extract(F.lower(cache_control), r"max-age\s*=\s*\"?(\d+)", 1), F.lit("")).try_cast("long")
    left = F.least(max_age - F.coalesce(age.cast("long"), F.lit(0)), F.lit(most))
    return F.when(~F.lower(cache_control).rlike("no-store|no-cache"), F.when(left > 0, left))
