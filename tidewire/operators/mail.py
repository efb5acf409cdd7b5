"""Mail lists as tables: who is subscribed, which send claims a delivery, how it ended, what is due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes after which sending stops altogether. Fixed values.
STOP_CODES = (
    "E_RATE_LIMIT_EXCEEDED E_DAILY_LIMIT_EXCEEDED E_SENDER_NOT_VERIFIED E_SENDER_DOMAIN_NOT_AVAILABLE E_CONTENT_TOO_LARGE E_HEADER_NOT_ALLOWED E_HEADER_USE_API_FIELD "
    "E_HEADER_VALUE_INVALID E_HEADER_VALUE_TOO_LONG E_HEADER_NAME_INVALID E_HEADERS_TOO_LARGE E_HEADERS_TOO_MANY"
).split()


def known_lists(text: Column, lists: Sequence[str]) -> Column:
    """The chosen lists in their own order, each once; null where an unknown one is named."""
    chosen = F.transform(text, lambda x: F.lower(F.trim(x)))
    return F.when(F.size(F.array_except(chosen, F.array(*map(F.lit, lists)))) == 0, F.filter(F.array(*map(F.lit, lists)), lambda x: F.array_contains(chosen, x)))


def subscribers(events: DataFrame, identity: str, at: str, tie: str) -> DataFrame:
    """(identity, status, confirmed_at, unsubscribed_at, lists): each address's state after its events.

    Events have `kind` (request, confirm, unsubscribe), `lists` and `nonce`. A confirmation counts if its
    nonce is the newest request's. Lists are those confirmed since the last unsubscription.
    """
    order = F.struct(at, tie)
    latest = events.where("kind = 'request'").groupBy(identity).agg(F.max_by("nonce", order).alias("_nonce"))
    joined = events.join(latest, identity, "left")
    valid = joined.where((F.col("kind") != "confirm") | F.col("nonce").eqNullSafe(F.col("_nonce")))
    ends = valid.groupBy(identity).agg(
        F.max(F.when(F.col("kind") == "unsubscribe", order)).alias("_out"), F.max(F.when(F.col("kind") == "confirm", order)).alias("_in"),
        F.min(F.when(F.col("kind") == "confirm", F.col(at))).alias("confirmed_at"),
    )
    active = F.coalesce(F.col("_in") > F.col("_out"), F.col("_in").isNotNull())
    status = F.when(active, "active").when(F.col("_out").isNotNull(), "unsubscribed").otherwise("pending")
    since = valid.join(ends, identity).where((F.col("kind") == "confirm") & F.coalesce(order > F.col("_out"), F.lit(True)))
    lists = since.select(identity, F.explode("lists").alias("x")).groupBy(identity).agg(F.array_sort(F.collect_set("x")).alias("lists"))
    gone = F.when(~active, F.col(f"_out.{at}"))
    return ends.join(lists, identity, "left").select(identity, status.alias("status"), "confirmed_at", gone.alias("unsubscribed_at"), F.coalesce("lists", F.array().cast("array<string>")).alias("lists"))


def claims(sends: DataFrame, wanted: DataFrame, keys: Sequence[str], most_attempts: int = 3) -> DataFrame:
    """The deliveries that a run may claim, with their attempt: not sent before, or failed and to be tried again; each once."""
    one = wanted.select(*keys).distinct()
    joined = one.join(sends.select(*keys, "status", "attempts"), list(keys), "left")
    free = F.col("status").isNull() | ((F.col("status") == "failed") & (F.col("attempts") < most_attempts))
    return joined.where(free).select(*keys, (F.coalesce("attempts", F.lit(0)) + 1).cast("long").alias("attempt"))


def merge_claims(sends: DataFrame, claimed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The send log after claims: claimed rows are being sent with one attempt more, new ones join."""
    joined = sends.join(claimed, list(keys), "full_outer")
    status = F.when(F.col("attempt").isNotNull(), "sending").otherwise(F.col("status"))
    return joined.select(*keys, status.alias("status"), F.coalesce("attempt", "attempts").alias("attempts"))


def send_outcome(code: Column) -> Column:
    """What an error means: the address is suppressed, sending stops, or this one failed; sent without an error."""
    return F.when(code.isNull(), "sent").when(code == "E_RECIPIENT_SUPPRESSED", "suppressed").when(code.isin(*STOP_CODES), "stop").otherwise("failed")


def settle(sends: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The send log after outcomes (keys, code): a stop gives the attempt back and leaves the row to be tried again."""
    joined = sends.join(outcomes.select(*keys, send_outcome(F.col("code")).alias("_outcome")), list(keys), "left")
    status = F.when(F.col("_outcome") == "stop", "failed").otherwise(F.coalesce("_outcome", "status"))
    attempts = F.when(F.col("_outcome") == "stop", F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts"))
    return joined.select(*keys, status.alias("status"), attempts.alias("attempts"))


def jobs(sends: DataFrame, remaining: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status, sent, failed, left) of each content: done once nobody is left."""
    counted = sends.groupBy(*keys).agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"))
    left = remaining.groupBy(*keys).agg(F.count("*").alias("left"))
    joined = counted.join(left, list(keys), "full_outer")
    filled = joined.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sent", "failed", "left")))
    return filled.withColumn("status", F.when(F.col("left") == 0, "done").otherwise("partial"))


def catch_up(now: Column, done_at: Column, start_minute: int, window_minutes: int = 330, grace_minutes: int = 25) -> Column:
    """Whether a missed daily run is made up for: within the window after its time, and not done today (UTC)."""
    minute = F.hour(now) * 60 + F.minute(now)
    open_ = (minute >= start_minute + grace_minutes) & (minute < start_minute + grace_minutes + window_minutes)
    return open_ & ~F.coalesce(done_at >= F.date_trunc("day", now), F.lit(False))


def freshness(made_at: Column, now: Column, most_hours: int, future_hours: int = 6) -> Column:
    """Why a content may not be sent: undated, in the future, stale; an empty text if it may."""
    hour = F.expr("interval 1 hour")
    return F.when(made_at.isNull(), "undated").when(made_at > now + hour * future_hours, "future").when(made_at < now - hour * most_hours, "stale").otherwise("")


def time_to_live(expires_at: Column, now: Column, least: int = 60, grace: int = 30 * 86_400) -> Column:
    """Seconds that a cache entry is kept: what is left of it and a grace, a minute at least."""
    left = F.coalesce(F.floor(F.unix_seconds(expires_at) - F.unix_seconds(now)), F.lit(0))
    return F.greatest(F.lit(least).cast("long"), left + grace)


def unsubscribed(state: DataFrame, asked: DataFrame, identity: str, now: Column) -> DataFrame:
    """The subscribers after unsubscriptions: their lists are empty, and who had already left keeps the first time."""
    joined = state.join(asked.select(identity).distinct().withColumn("_asked", F.lit(True)), identity, "left")
    leaves = F.coalesce("_asked", F.lit(False)) & (F.col("status") != "unsubscribed")
    return joined.select(
        *(
            F.when(leaves, F.lit("unsubscribed")).otherwise(F.col("status")).alias(c) if c == "status"
            else F.when(leaves, now).otherwise(F.col(c)).alias(c) if c == "unsubscribed_at"
            else F.when(F.col("_asked"), F.array().cast("array<string>")).otherwise(F.col(c)).alias(c) if c == "lists"
            else F.col(c)
            for c in state.columns
        )
    )
