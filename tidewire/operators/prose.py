"""Events from prose: sentences, templates that read days and times from them, and rows of a session's table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.functions.text import clean, first_filled, once, truncate
from tidewire.operators.alerts import dated, session_key
from tidewire.sources.markup import DAY, MONTH, Field, Rule, filled

#: Abbreviations after which a sentence goes on. Fixed value.
ABBREVIATIONS = r"(?:\b(?:Dr|Mr|Mrs|Ms|Rev|Sen|Rep|Gov|Lt|Gen|St|Jr|Sr|Inc|Corp|Co|Vt|No)|\b[A-Z])\.$"


def sentences(text: Column, abbreviations: str = "") -> Column:
    """Sentences of a cleaned text: they end with a mark before white space and a capital, but not after an abbreviation."""
    pieces = F.split(clean(text), r"(?<=[.!?])\s+(?=[A-Z])")
    if not abbreviations:
        return pieces
    start = F.array().cast("array<string>")

    def add(done: Column, piece: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        goes_on = F.coalesce(last.rlike(abbreviations), F.lit(False))
        return F.when(goes_on, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, piece)))).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, start, add)


@dataclass(frozen=True)
class Template:
    """What a sentence may tell: a kind, the heading of its title, a pattern, and which of its groups are what (0: none)."""

    kind: str
    heading: str
    pattern: str
    weekday: int = 1
    month: int = 2
    day: int = 3
    year: int = 4
    hour: int = 0
    minute: int = 0
    meridiem: int = 0

    def event(self, sentence: Column, topic: Column, today: Column) -> Column:
        """(kind, day, time, title, body), null where the sentence doesn't fit or its day isn't certain."""

        def part(i: int) -> Column:
            return F.nullif(F.regexp_extract(sentence, self.pattern, i), F.lit("")) if i else F.lit(None).cast("string")

        day = dated(part(self.month), part(self.day).try_cast("int"), part(self.year).try_cast("int"), part(self.weekday), today)
        clock = dates.clock(part(self.hour).try_cast("int"), F.coalesce(part(self.minute).try_cast("int"), F.lit(0)), part(self.meridiem))
        time = F.when(part(self.hour).isNotNull(), clock).otherwise("")
        told = lambda d: F.struct(
            F.lit(self.kind).alias("kind"), F.date_format(d, "yyyy-MM-dd").alias("day"), time.alias("time"),
            F.concat(F.lit(self.heading), topic).alias("title"), truncate(sentence, 300).alias("body"),
        )
        return F.when(sentence.rlike(self.pattern), once(day, lambda d: F.when(d.isNotNull(), told(d))))


_WHEN = rf"(?:({DAY}),?\s+)?({MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?"
#: Sentences on the end of a time for comments, and on a forum. Fixed values.
PERIODS = (
    Template("deadline", "Public comment closes: ", rf"(?i)\b(?:accept(?:ed|ing|s)?|open)\b[^.;]{{0,100}}?\b(?:until|through)\s+{_WHEN}"),
    Template("hearing", "Public comment forum: ", rf"(?i)\b(?:public\s+(?:comment\s+)?(?:forum|hearing))\b[^.;]{{0,60}}?\b(?:held|scheduled)\s+on\s+{_WHEN}(?:\s+at\s+(\d{{1,2}})(?::(\d{{2}}))?\s*([ap])\.?\s*m\b)?", hour=5, minute=6, meridiem=7),
)
#: Sections of a page on comments: a button with the topic, and the prose under it.
SECTIONS = (Rule("sections", ".usa-accordion", (Field("topic", ".usa-accordion__button"), Field("prose", ".usa-accordion__content"))),)


def told(frame: DataFrame, id_col: str, topic: Column, text: Column, templates: Sequence[Template], today: Column) -> DataFrame:
    """(id, sentence, kind, day, time, title, body): a row for each template that a sentence fits; one sentence may tell several events."""
    rows = frame.select(F.col(id_col).alias("id"), topic.alias("topic"), F.posexplode(sentences(text)).alias("sentence", "said"))
    every = F.array_compact(F.array(*(t.event(F.col("said"), F.col("topic"), today) for t in templates)))
    return rows.select("id", "sentence", F.explode(every).alias("x")).select("id", "sentence", "x.*")


def comment_periods(found: DataFrame, pages: DataFrame, id_col: str, today: Column, templates: Sequence[Template] = PERIODS) -> DataFrame:
    """(id, kind, day, time, title, body) of pages with sections of prose, from rows of `SECTIONS`.

    A page without a section gives a row without a kind: its layout has changed.
    """
    own = found.groupBy("id", "item").agg(filled("topic").alias("topic"), filled("prose").alias("prose"))
    topic = F.regexp_replace(F.coalesce("topic", F.lit("")), r"(?i)\s*\(closed\)\s*$", "")
    events = told(own.select(F.struct("id", "item").alias("key"), "topic", "prose"), "key", topic, F.col("prose"), templates, today)
    events = events.select("id.id", "kind", "day", "time", "title", "body")
    changed = pages.select(F.col(id_col).alias("id")).join(own.select("id").distinct(), "id", "left_anti")
    return events.unionByName(changed.select("id", *(F.lit(None).cast("string").alias(c) for c in events.columns[1:])))


#: A day as a session's table writes it. Fixed value.
LONG_DAY = rf"(?i)^({DAY}),\s+({MONTH})\s+(\d{{1,2}}),\s+(\d{{4}})$"
#: Fields of a row of a session's table.
MEETING = "MeetingDate string, LongName string, CommName string, StartTime string, RoomNbr string, Room string, BuildingName string, AlternateRoomLocation string, Published string, CommitteeMeetingID string, PermanentID string, notes string"


def session_meetings(frame: DataFrame, id_col: str, json_col: str, base: str, committees: str, today: Column) -> DataFrame:
    """(id, place, day, time, title, body, url) of a session's table of meetings, of committees that fit a pattern.

    A start that is no time of day is none. A payload without a list of meetings gives a row
    without a day; an empty list gives none.
    """
    data = F.from_json(json_col, f"struct<data: array<struct<{MEETING.replace(' string', ': string')}>>>")["data"]
    parsed = frame.select(F.col(id_col).alias("id"), data.alias("data"))
    rows = parsed.select("id", F.posexplode("data").alias("place", "m"))
    # Days are read last, and only where there is one: what can't be read as a date costs most.
    title = first_filled(clean(F.col("m.LongName")), clean(F.col("m.CommName")))
    rows = rows.where(title.rlike(committees) & clean(F.col("m.MeetingDate")).rlike(LONG_DAY))
    part = lambda i: F.regexp_extract(clean(F.col("m.MeetingDate")), LONG_DAY, i)
    own = F.struct(*(part(i).alias(c) for i, c in enumerate(("name", "month", "day", "year"), 1)))
    day = once(own, lambda p: dated(p["month"], p["day"].try_cast("int"), p["year"].try_cast("int"), p["name"], today))
    rows = rows.withColumn("at", day)
    day = F.col("at")
    start = r"(?i)^(\d{1,2}):(\d{2})\s*([AP])M$"
    clock = lambda i: F.regexp_extract(clean(F.col("m.StartTime")), start, i)
    time = F.when(clean(F.col("m.StartTime")).rlike(start), dates.clock(clock(1).try_cast("int"), clock(2).try_cast("int"), clock(3))).otherwise("")
    number, room = clean(F.col("m.RoomNbr")), clean(F.col("m.Room"))
    within = F.concat(F.lit("Room "), number, F.when(room != "", F.concat(F.lit(" ("), room, F.lit(")"))).otherwise(""), F.lit(", "), first_filled(clean(F.col("m.BuildingName")), F.lit("State House")))
    place = F.when(number != "", within).otherwise(clean(F.col("m.AlternateRoomLocation")))
    body = F.array_join(F.filter(F.array(place, clean(F.col("m.notes"))), lambda x: x != ""), ". ")
    published = F.col("m.Published").eqNullSafe("1")
    link = F.concat_ws("/", F.lit(base), F.lit("committee"), F.when(published, "agenda").otherwise("detail"), session_key(day).cast("string"), F.when(published, F.col("m.CommitteeMeetingID")).otherwise(F.col("m.PermanentID")))
    good = rows.select("id", "place", F.date_format(day, "yyyy-MM-dd").alias("day"), time.alias("time"), title.alias("title"), body.alias("body"), link.alias("url"))
    good = good.where("day IS NOT NULL")
    nothing = parsed.where("data IS NULL").select("id", *(F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns[1:]))
    return good.unionByName(nothing)
