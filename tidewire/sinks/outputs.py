"""Feeds, tables and calendars to publish, as text columns that Spark's writers take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import rfc1123
from tidewire.functions.text import blank_to_null, cdata, csv_field, escape_ics, escape_xml, first_filled
from tidewire.operators.rules import visible


def rss_items(frame: DataFrame, most: int = 100) -> DataFrame:
    """(position, xml) of the newest visible items: a top-k, so no whole table is sorted."""
    shown = frame.where(visible(F.col("relevant"))).orderBy(F.col("published").desc_nulls_last(), "link").limit(most)
    guid = first_filled(F.col("guid"), F.col("link"))
    xml = F.concat(
        F.lit("<item><title>"), escape_xml(F.col("title")), F.lit("</title><link>"), escape_xml(F.col("link")),
        F.lit('</link><guid isPermaLink="false">'), escape_xml(guid), F.lit("</guid>"),
        F.coalesce(F.concat(F.lit("<pubDate>"), rfc1123(F.col("published")), F.lit("</pubDate>")), F.lit("")),
        F.lit("<description>"), cdata(F.col("summary")), F.lit("</description></item>"),
    )
    return shown.select("published", "link", xml.alias("xml"))


def feed_rows(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(json): a published row of each visible item, blank texts left out."""
    kinds = dict(frame.dtypes)
    kept = [blank_to_null(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in columns]
    return frame.where(visible(F.col("relevant"))).select(F.to_json(F.struct(*kept)).alias("json"))


def csv_lines(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(value): guarded and quoted CSV lines, to be written with `lineSep` CRLF."""
    return frame.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in columns)).alias("value"))


def fold(line: Column, octets: int = 75) -> Column:
    """An iCalendar line of ASCII folded at so many octets; lines with wider characters fold earlier."""
    width = F.when(F.octet_length(line) == F.length(line), octets - 1).otherwise((octets - 1) // 4)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / width) - 1, F.lit(0))), lambda i: F.substring(line, (i * width + 1).cast("int"), width.cast("int")))
    return F.array_join(parts, "\r\n ")


def ics_blocks(events: DataFrame, stamp: Column, zone: str = "America/New_York") -> DataFrame:
    """(day, time, value): a VEVENT block of each event (day, time, title, body, url)."""
    at = F.when(F.col("time") == "", F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("day", "yyyyMMdd"))).otherwise(
        F.concat(F.lit(f"DTSTART;TZID={zone}:"), F.date_format("day", "yyyyMMdd"), F.lit("T"), F.replace("time", F.lit(":"), F.lit("")), F.lit("00"))
    )
    uid = F.substring(F.sha2(F.concat_ws("|", "day", "time", "title", "url"), 256), 1, 32)
    lines = F.array(
        F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("DTSTAMP:"), F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'")), at,
        F.concat(F.lit("SUMMARY:"), escape_ics(F.col("title"))), F.concat(F.lit("DESCRIPTION:"), escape_ics(F.col("body"))),
        F.concat(F.lit("URL:"), F.coalesce("url", F.lit(""))), F.lit("END:VEVENT"),
    )
    return events.select("day", "time", F.array_join(F.transform(lines, lambda line: fold(line)), "\r\n").alias("value"))
