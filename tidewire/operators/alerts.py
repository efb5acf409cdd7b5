"""Alerts and calendar displays: keys, batches that are published, what a row looks like, local days and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates, urls
from tidewire.functions.text import blank_to_null, clean, escape_xml, first_filled, once, url_safe_digest
from tidewire.operators.cluster import cut
from tidewire.operators.ordered import nearest, openers, running
from tidewire.operators.profile import is_urgent

#: Days of the week as they are written. Fixed values.
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def alert_key(guid: Column, link: Column) -> Column:
    """A short key of a row's id, else of its link; empty without either."""
    own = first_filled(guid, link)
    return F.when(own == "", F.lit("")).otherwise(url_safe_digest(own, 16))


def undelivered(alerts: DataFrame, accepted: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """(target, key) of alerts that a target hasn't accepted yet: a failed one tries again, others get nothing twice.

    Targets are few; alerts times targets are rows, not a product of two large tables.
    """
    every = alerts.select(key).distinct().crossJoin(F.broadcast(targets.select(target).distinct()))
    return every.join(accepted.select(target, key).distinct(), [target, key], "left_anti")


def next_batch(prior: DataFrame, fresh: DataFrame, now: Column, key: str, made: str, minutes: int = 35) -> DataFrame:
    """(key, made) of the batch to publish: fresh keys with those of a very recent batch, or the prior batch as it is.

    Batches are bounded lists of keys.
    """
    told = fresh.agg((F.count("*") > 0).alias("some"))
    recent = F.col(made) > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    kept = prior.crossJoin(F.broadcast(told)).where(~F.col("some") | (recent & (F.col(made) <= now)))
    old = kept.select(key, F.when(F.col("some"), now).otherwise(F.col(made)).alias(made))
    both = old.union(fresh.select(key, now.alias(made)))
    return both.groupBy(key).agg(F.max(made).alias(made))


def published(batch: DataFrame, now: Column, made: str, hours: int = 12) -> DataFrame:
    """A batch as it is shown: empty once it is older than the limit."""
    return batch.where(F.col(made) >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def described(title: Column, url: Column, outlet: Column, label: Column, score: Column, summary: Column, snippet: Column) -> Column:
    """What an alert shows of a row: (title, url, outlet, sentiment, summary, urgent)."""
    tone, points = blank_to_null(clean(label)), F.floor(score + 0.5).cast("long")
    scored = F.when(points.isNull(), F.coalesce(tone, F.lit("not yet scored"))).otherwise(
        F.when(tone.isNull(), F.concat(F.lit("score "), points.cast("string"))).otherwise(F.concat(tone, F.lit(" (score "), points.cast("string"), F.lit(")")))
    )
    return F.struct(
        first_filled(clean(title), F.lit("Untitled")).alias("title"), F.when(urls.is_web(url), url).otherwise("").alias("url"), clean(outlet).alias("outlet"),
        scored.alias("sentiment"), clean(first_filled(summary, snippet)).alias("summary"), is_urgent(label, score).alias("urgent"),
    )


def also_covered(members: DataFrame, group: str, place: str, link: str, title: str, outlet: str, most: int = 20) -> DataFrame:
    """(group, html): the other reports of each story as links by their outlets, the first `most` of them."""
    anchor = F.concat(F.lit('<a href="'), escape_xml(F.col(link)), F.lit('" title="'), escape_xml(F.col(title)), F.lit('">'), escape_xml(F.col(outlet)), F.lit("</a>"))
    others = members.where((F.col(place) > 1) & (F.col(place) <= most + 1))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), anchor.alias("a")))), lambda x: x["a"]), " · ")
    return others.groupBy(group).agg(F.concat(F.lit("<p><strong>Also covered by:</strong> "), joined, F.lit("</p>")).alias("html"))


def packed(lines: DataFrame, place: str, line: str, header: str, most: int = 2000) -> DataFrame:
    """(message, body): lines packed in order into messages of `most` characters at most, each under the header.

    A line too long for a message has one to itself. Each line gets the one that would open the next
    message if it opened one, by running sums of lengths, and the chain of openers follows. Places are
    distinct; a null or empty line stands in no message.
    """
    room = most - len(header)
    kept = lines.where(F.length(line) > 0).select(F.col(place).alias("place"), F.col(line).alias("line"))
    summed = cut(running(kept, [F.col("place")], {"i": F.lit(1), "upto": F.length("line")}))
    # The next message opens at the first line that ends beyond this one's begin and the room.
    begin = F.col("upto") - F.length("line")
    ends = summed.select("i", F.lit(0).alias("_all"), "upto")
    asked = summed.select(F.lit(0).alias("_all"), "i", (begin + room + 1).alias("upto"))
    met = nearest(asked, ends, ["_all"], "upto", 1000 * most, "end")
    at = met.join(ends.select(F.col("upto").alias("end"), F.col("i").alias("j")), "end", "left")
    # A line that fills its message alone ends beyond the room itself; then the next one opens, if there is one.
    step = F.when(F.col("j").isNotNull(), F.greatest(F.col("j"), F.col("i") + 1))
    following = ends.select(F.col("i").alias("following"))
    steps = at.withColumn("step", step).join(following, F.col("step") == F.col("following"), "left").select("_all", "i", "following")
    chain = openers(steps, ["_all"], "i", "following").select("i", F.lit(1).alias("opens"))
    counted = running(summed.join(chain, "i", "left"), [F.col("i")], {"n": F.col("opens")})
    # A message's lines are bounded by its room.
    bodies = counted.groupBy((F.col("n") - 1).cast("int").alias("message")).agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("rows"))
    return bodies.select("message", F.concat(F.lit(header), F.array_join(F.transform("rows", lambda r: r["line"]), "")).alias("body"))


def weekday(day: Column) -> Column:
    """The name of a day's weekday."""
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day))


def dated(month: Column, day: Column, year: Column, name: Column, today: Column) -> Column:
    """The date of a month's name, a day, and a weekday or a year.

    A year must fit the weekday, if there is one. Without a year the weekday picks this or the
    next one, never a past day; without either there is no date.
    """
    known, low = blank_to_null(F.lower(name)), F.year(today)
    at = lambda y: F.try_to_date(F.concat_ws(" ", month, day.cast("string"), y.cast("string")), "MMMM d yyyy")
    fits = lambda d: d.isNotNull() & (known.isNull() | (weekday(d) == known))
    later = lambda d: (d >= today) & (weekday(d) == known)
    this, following = at(low), at(low + 1)
    return F.when(year.isNotNull(), once(at(year), lambda given: F.when(fits(given), given))).when(later(this), this).when(later(following), following)


def local_clock(at: Column, zone: str = dates.ZONE) -> Column:
    """(day, time) of an instant on a zone's clocks."""
    local = F.from_utc_timestamp(at, zone)
    return F.struct(F.date_format(local, "yyyy-MM-dd").alias("day"), F.date_format(local, "HH:mm").alias("time"))


def session_key(day: Column) -> Column:
    """The even year that ends the session of a day."""
    year = F.year(day)
    return year + year % 2


def agency_link(text: Column, domain: str, fallback: Column) -> Column:
    """The first address in a text that is on a domain or below it, else the fallback."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s\\]+)"), F.lit(1))
    return F.coalesce(F.get(F.filter(found, lambda u: urls.in_domains(urls.host(u), [domain])), F.lit(0)), fallback)


#: Where a description's practical details begin, and a line that only tells times. Fixed values.
DETAILS = r"(?i)(?:Meeting Location:|Additional Details:)"
TIMES = r"(?i)^\d{1,2}(?::\d{2})?\s*(?:am|pm)?\s*-\s*\d{1,2}(?::\d{2})?\s*(?:am|pm)$"


def agency_text(text: Column, title: Column, ends: str = DETAILS) -> Column:
    """The lines of a description before its practical details, without addresses, times and the title itself."""
    lines = F.transform(F.split(F.get(F.split(text, ends), F.lit(0)), "\n"), lambda x: F.trim(F.regexp_replace(x, r"https?://\S+", "")))
    kept = F.filter(lines, lambda x: (x != "") & (F.lower(x) != F.lower(title)) & ~x.rlike(TIMES))
    return clean(F.array_join(kept, ". "))


def valid_filter(query: Column, section: Column, first: Column, last: Column, sections: Sequence[str], most: int = 200) -> Column:
    """A reader's filter made valid: text cut, section known, days real; (q, section, first, last)."""
    day = lambda c: F.coalesce(F.date_format(dates.real_day(c), "yyyy-MM-dd"), F.lit(""))
    return F.struct(
        F.substring(F.trim(F.coalesce(query, F.lit(""))), 1, most).alias("q"), F.when(section.isin(*sections), section).otherwise("all").alias("section"), day(first).alias("first"), day(last).alias("last")
    )


def preview(text: Column, promotion: str, most: int = 600) -> Column:
    """A preview, blank where it is a promotion, cut after a word and marked with dots."""
    whole = clean(text)
    head = F.rtrim(F.substring(whole, 1, most - 3))
    cut = F.rtrim(F.regexp_replace(head, r" [^ ]*$", ""))
    return F.when(whole.rlike(promotion), F.lit("")).when(F.length(whole) <= most, whole).otherwise(F.concat(cut, F.lit("...")))
