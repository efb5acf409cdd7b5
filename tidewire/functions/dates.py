"""Calendars as Column expressions. Every function takes its instant and zone; none reads a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"

#: Formats of feeds' dates, without the day of the week. Fixed values.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "d MMM yyyy HH:mm:ss XX",
    "d MMM yyyy HH:mm:ss z",
    "d MMM yyyy",
    "MMMM d, yyyy[ h[:mm[:ss]] a]",
    "MMM d, yyyy[ h[:mm[:ss]] a]",
    "d MMMM yyyy[ h[:mm[:ss]] a]",
    "M/d/yyyy[ h[:mm[:ss]] a]",
    "yyyy-MM-dd h[:mm[:ss]] a",
)


def parse(text: Column) -> Column:
    """The instant that a text tells in one of the usual formats, null if in none."""
    bare = F.regexp_replace(F.trim(text), r"^(?i)(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+", "")
    bare = F.regexp_replace(bare, r"(?i)(\d),?\s*a\.?m\b\.?", "$1 AM")
    bare = F.regexp_replace(bare, r"(?i)(\d),?\s*p\.?m\b\.?", "$1 PM")
    bare = F.regexp_replace(bare, r"(?i)(\d),?\s+(?:at\s+)?(?=\d{1,2}(?::\d\d)*\s[AP]M)", "$1 ")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS))


def local_day(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def local_month(at: Column, zone: str = ZONE) -> Column:
    """Month of an instant in a zone, as yyyy-MM."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM")


def utc_month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def month_start(month: Column, zone: str = ZONE) -> Column:
    """Instant at which a month (yyyy-MM) begins in a zone."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat(month, F.lit("-01"))), zone)


def shift_month(month: Column, by: int) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), by), "yyyy-MM")


def week_start(at: Column) -> Column:
    """Monday of an instant's week."""
    return F.to_date(F.date_trunc("week", at))


def real_day(text: Column) -> Column:
    """A text of the form yyyy-MM-dd that names a day, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def clock(hour: Column, minute: Column, meridiem: Column) -> Column:
    """HH:mm of a twelve-hour time, empty where it is none."""
    day_hour = F.pmod(hour, F.lit(12)) + F.when(F.lower(meridiem).startswith("p"), 12).otherwise(0)
    valid = hour.between(1, 12) & minute.between(0, 59) & F.lower(meridiem).rlike("^[ap]")
    return F.when(valid, F.format_string("%02d:%02d", day_hour.cast("int"), minute.cast("int"))).otherwise("")


def wall_to_utc(day: Column, time: Column, zone: str = ZONE) -> Column:
    """Instant of a wall clock's time on a day; an empty time is the day's begin."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(time == "", "00:00").otherwise(time)), F.lit("yyyy-MM-dd HH:mm")), zone)


def next_occurrence(month: Column, day: Column, today: Column) -> Column:
    """The date of a month and day without a year: this year's, or next year's once that is past."""
    this = F.try_to_date(F.concat_ws("-", F.year(today), month, day), "y-M-d")
    following = F.try_to_date(F.concat_ws("-", F.year(today) + 1, month, day), "y-M-d")
    return F.when(this >= today, this).otherwise(following)


def ago(text: Column, now: Column) -> Column:
    """The instant that "3h", "2 days" or "5 min" lie before `now`; null for other texts."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*[a-zA-Z]", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(text, r"^\s*\d+\s*([a-zA-Z]+)", 1))
    seconds = (
        F.when(unit.rlike("^(?:s|sec|secs|seconds?)$"), 1)
        .when(unit.rlike("^(?:m|min|mins|minutes?)$"), 60)
        .when(unit.rlike("^(?:h|hr|hrs|hours?)$"), 3600)
        .when(unit.rlike("^(?:d|days?)$"), 86400)
        .when(unit.rlike("^(?:w|wks?|weeks?)$"), 7 * 86400)
    )
    return F.timestamp_micros(F.unix_micros(now) - n.cast("long") * seconds * 1_000_000)


def rfc1123(at: Column) -> Column:
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def months(bounds: DataFrame, start: str, end: str, out: str = "month") -> DataFrame:
    """One row per month from the column `start` to the column `end` of a row of bounds."""
    first, last = F.to_date(F.concat(start, F.lit("-01"))), F.to_date(F.concat(end, F.lit("-01")))
    days = F.sequence(first, last, F.expr("interval 1 month"))
    spine = bounds.where(F.col(start) <= F.col(end)).select(F.explode(days).alias("_day"))
    return spine.select(F.date_format("_day", "yyyy-MM").alias(out))


def weeks(bounds: DataFrame, start: str, end: str, out: str = "week") -> DataFrame:
    """One row per Monday between two Mondays."""
    days = F.sequence(F.col(start), F.col(end), F.expr("interval 7 days"))
    return bounds.where(F.col(start) <= F.col(end)).select(F.explode(days).alias(out))


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def session(app: str = "tidewire", **conf: str) -> SparkSession:
    """A session with the settings that the library's expressions count on."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
