"""Who is next: work queues under budgets, orders, pages and bounded state.

Budgets are small numbers, so what a limit keeps is small; the rows that compete for it
are never sorted as a whole but cut to the limit in each partition first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.ordered import running


def for_run(pending: DataFrame, at: str, tie: str, batch: int, requests: int, oldest_first: bool = False) -> DataFrame:
    """The rows that one run takes: newest first, or oldest first in a sweep, `batch` for each request."""
    order = (F.col(at).asc_nulls_last(), F.col(tie)) if oldest_first else (F.col(at).desc_nulls_last(), F.col(tie))
    return pending.orderBy(*order).limit(batch * requests)


def first_per_key(entries: DataFrame, key: str, place: str) -> DataFrame:
    """The entry of the lowest place of each request key: equal requests are made once."""
    return entries.groupBy(key).agg(F.min_by(F.struct(*entries.columns), place).alias("row")).select("row.*")


def slots(entries: DataFrame, key: str, place: str, most: int, reserved: int, primary: str = "primary", scope: str = "scope", odds: str = "odds", caps: Mapping[str, int] | None = None) -> DataFrame:
    """(key, slot, place): which requests share a run's `most` slots.

    `entries` has a row per request key with its place and booleans named `primary`, `scope` and
    `odds`: which kinds of work it needs. Odds work gets up to `reserved` slots first; then
    primary work, scope work and again odds work take what is left, no key twice, and no
    more than `caps` says for a kind.
    """
    out = entries.where(odds).orderBy(place).limit(min(reserved, most)).select(key, place, F.lit("reserved").alias("slot"))
    for kind, flag in (("primary", primary), ("scope", scope), ("spare", odds)):
        # What is taken is at most `most` rows, and so may be counted and broadcast.
        left = most - out.count()
        more = entries.where(flag).join(F.broadcast(out.select(key)), key, "left_anti").orderBy(place).limit(max(0, min(left, (caps or {}).get(kind, left))))
        out = out.unionByName(more.select(key, place, F.lit(kind).alias("slot")))
    return out


def newest_keys(keys: DataFrame, key: str, place: str, most: int) -> DataFrame:
    """(key, place): each key at its last place, the `most` last of them, in order."""
    last = keys.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.max(place).alias(place))
    return last.orderBy(F.col(place).desc()).limit(most).orderBy(place)


def newest_months(state: DataFrame, month: str, most: int = 120) -> DataFrame:
    """The rows of a table by month that belong to its `most` newest months."""
    kept = state.select(month).distinct().orderBy(F.col(month).desc()).limit(most)
    return state.join(F.broadcast(kept), month, "left_semi")


def leading(frame: DataFrame, urgent: Column, place: str, out: str = "rank") -> DataFrame:
    """Rows with urgent ones before others, each part in its own order; `out` numbers them all. Places are distinct."""
    ranked = running(frame.withColumn("_late", F.when(urgent, 0).otherwise(1)), [F.col("_late"), F.col(place)], {out: F.lit(1)})
    return ranked.withColumn(out, F.col(out).cast("int")).drop("_late")


def page(frame: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1, brought within the pages there are) of `size` rows, with `rank` and `pages`."""
    total = frame.count()
    pages = max(1, -(-total // size))
    number = min(max(1, number), pages)
    # Only rows up to the page's end are sorted together.
    upto = frame.orderBy(*order).limit(number * size)
    ranked = upto.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return ranked.where(F.col("rank") > (number - 1) * size).withColumn("pages", F.lit(pages))


def first_page(frame: DataFrame, group: str, at: str, identity: str, size: int = 25) -> DataFrame:
    """(story, lead, at, n): the newest stories of a page; a row without a group is a story of its own."""
    story = F.coalesce(F.col(group).cast("string"), F.col(identity).cast("string"))
    order = F.struct(F.col(at), F.col(identity))
    grouped = frame.groupBy(story.alias("story")).agg(F.max_by(identity, order).alias("lead"), F.max(at).alias("at"), F.count("*").alias("n"))
    return grouped.orderBy(F.col("at").desc_nulls_last(), "story").limit(size)


def peak(weeks: DataFrame, group: str, week: str, value: str) -> DataFrame:
    """(group, week, value): the week of each group's highest value, the first of equal ones."""
    best = weeks.groupBy(group).agg(F.max_by(F.struct(week, value), F.struct(F.col(value), -F.unix_date(F.col(week).cast("date")))).alias("x"))
    return best.select(group, f"x.{week}", f"x.{value}")


def event_order(day: str = "date", time: str = "time", title: str = "title") -> list[Column]:
    """Order of calendar events: day, then time, whole days first, then title."""
    return [F.col(day), F.coalesce(F.col(time), F.lit("")), F.col(title)]


def findings_order(months: DataFrame, month: str = "month") -> DataFrame:
    """Months in the order in which findings are written: the last but one, the last, then backwards. One row a month."""
    back = F.row_number().over(W.orderBy(F.col(month).desc()))
    return months.select(month, F.when(back == 2, 1).when(back == 1, F.when(F.count("*").over(W.partitionBy()) > 1, 2).otherwise(1)).otherwise(back).alias("turn"))


def within_bytes(entries: DataFrame, section: str, place: str, size: str, most: int, frame_bytes: int = 0) -> DataFrame:
    """The entries of a digest that fit into `most` bytes: the last ones of the last sections go first. Section and place are distinct together."""
    summed = running(entries, [F.col(section), F.col(place)], {"_upto": F.col(size)})
    return summed.where(F.col("_upto") + frame_bytes <= most).drop("_upto")


def excerpt_candidates(frame: DataFrame, relevant: Column, category: Column, brand: str, url: Column, paywalled: Column, named: Column, at: str, tie: str, most: int = 150) -> DataFrame:
    """The newest visible rows of the brand whose excerpt doesn't name it and whose page can be read again."""
    readable = F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)) & ~F.coalesce(paywalled, F.lit(False))
    wanted = frame.where(~relevant.eqNullSafe(F.lit(False)) & (category == brand) & readable & ~F.coalesce(named, F.lit(False)))
    return wanted.orderBy(F.col(at).desc_nulls_last(), tie).limit(most)


def excluded_rows(items: DataFrame, key: str, at: str, since: Column, relevant: str, tie: str) -> DataFrame:
    """The newest rejected row of each key since a time; undated rows are left out."""
    recent = items.where((F.col(relevant) == F.lit(False)) & (F.col(at) >= since))
    return recent.groupBy(key).agg(F.max_by(F.struct(*(c for c in items.columns if c != key)), F.struct(F.col(at), F.col(tie))).alias("row")).select(key, "row.*")
