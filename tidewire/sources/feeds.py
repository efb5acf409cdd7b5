"""Feeds, sitemaps, pages, calendars and seeds as DataFrames: one document per row in, rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates, urls
from tidewire.functions.text import clean, first_filled

RSS = "struct<title:string,link:string,guid:string,pubDate:string,description:string,category:array<string>>"
ATOM = "struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,published:string,updated:string,summary:string,content:string>"


def is_feed(xml: Column) -> Column:
    """Whether the root element is that of a feed."""
    return F.coalesce(xml.rlike(r"(?is)^\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*)*<(?:rss|feed|rdf:RDF)[\s>]"), F.lit(False))


def plain(markup: Column) -> Column:
    """Text of a markup fragment: tags out, the usual entities decoded twice, white space collapsed."""
    out = F.coalesce(markup, F.lit(""))
    for _ in range(2):
        out = F.regexp_replace(out, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        out = F.regexp_replace(out, r"(?s)<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", " ")
        for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(character))
    return clean(out)


def feed_items(frame: DataFrame, xml_col: str, source_col: str, base_col: str | None = None) -> DataFrame:
    """(source, title, link, guid, published, summary, position) of RSS items and Atom entries.

    Items without a title or a link go. Relative links are resolved by `base_col`.
    """
    rows = frame.where(is_feed(F.col(xml_col)))
    base = F.col(base_col) if base_col else F.lit("")
    # Names with a prefix come in without it.
    bare = F.regexp_replace(F.col(xml_col), r"<(/?)(?!rdf:RDF)[A-Za-z]+:(?=[A-Za-z])", "<$1ns_")
    own = rows.select(F.col(source_col).alias("source"), base.alias("base"), bare.alias("xml"))
    found = own.select("source", "base", F.from_xml("xml", f"channel struct<item:array<{RSS}>>, item array<{RSS}>, entry array<{ATOM}>").alias("x"))
    items = found.select("source", "base", F.posexplode(F.coalesce("x.channel.item", "x.item")).alias("position", "i")).select(
        "source", "base", "position", "i.title", F.col("i.link").alias("link"), F.col("i.guid").alias("guid"), F.col("i.pubDate").alias("at"), F.col("i.description").alias("summary")
    )
    links = F.filter("e.link", lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    entries = found.select("source", "base", F.posexplode("x.entry").alias("position", "e")).select(
        "source", "base", "position", "e.title", F.try_element_at(links, F.lit(1))["_href"].alias("link"), F.col("e.id").alias("guid"),
        F.coalesce("e.published", "e.updated").alias("at"), F.coalesce("e.summary", "e.content").alias("summary"),
    )
    every = items.unionByName(entries)
    return every.select(
        "source",
        plain(F.col("title")).alias("title"),
        F.when(F.trim("link") != "", urls.resolve(F.trim("link"), F.col("base"))).alias("link"),
        F.trim("guid").alias("guid"),
        dates.parse(F.col("at")).alias("published"),
        plain(F.col("summary")).alias("summary"),
        "position",
    ).where("title <> '' AND link <> ''")


def sitemap_items(frame: DataFrame, xml_col: str, source_col: str, path_pattern: str) -> DataFrame:
    """(source, title, link, published) of a news sitemap's pages whose path fits a pattern."""
    bare = F.regexp_replace(F.col(xml_col), r"<(/?)news:", "<$1")
    schema = "url array<struct<loc:string,news:struct<publication_date:string,title:string>>>"
    found = frame.select(F.col(source_col).alias("source"), F.explode(F.from_xml(bare, schema)["url"]).alias("u"))
    rows = found.select("source", plain(F.col("u.news.title")).alias("title"), F.trim("u.loc").alias("link"), dates.parse(F.col("u.news.publication_date")).alias("published"))
    return rows.where((F.col("title") != "") & urls.path(F.col("link")).rlike(path_pattern))


def seed_items(frame: DataFrame, json_col: str) -> DataFrame:
    """(title, link, outlet, published, topic) of a curated list; references and other schemes go."""
    schema = "articles array<struct<url:string,title:string,outlet:string,pubDate:string,topic:string,referenceOnly:boolean>>"
    rows = frame.select(F.explode(F.from_json(json_col, schema)["articles"]).alias("a")).select("a.*")
    kept = rows.where(urls.is_web(F.col("url")) & ~F.coalesce("referenceOnly", F.lit(False)))
    return kept.select(clean(F.col("title")).alias("title"), F.col("url").alias("link"), "outlet", dates.parse(F.col("pubDate")).alias("published"), "topic")


def catalog(spark: SparkSession, rows: list[tuple[str, str, str, int | None]]) -> DataFrame:
    """Sources as a table: (name, url, kind, max_items)."""
    return spark.createDataFrame(rows, "name string, url string, kind string, max_items int")


def configured(frame: DataFrame, text_col: str) -> DataFrame:
    """(name, url) from texts of `Name|URL` parted by commas or lines; what is no address goes."""
    parts = frame.select(F.explode(F.split(text_col, r"[,\n]")).alias("x")).select(F.trim("x").alias("x"))
    rows = parts.select(
        F.when(F.col("x").contains("|"), F.trim(F.substring_index("x", "|", 1))).alias("name"), F.trim(F.substring_index("x", "|", -1)).alias("url")
    ).where(urls.is_web(F.col("url")))
    return rows.select(first_filled(F.col("name"), urls.host(F.col("url"))).alias("name"), "url")


#: Elements whose text is no part of an article. Fixed values.
BOILERPLATE = frozenset("script style noscript nav header footer aside form button svg iframe figure".split())


class _Paragraphs(HTMLParser):
    """Paragraphs and headings of a page, those inside <article> kept apart."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.inside, self.title, self.canonical = 0, 0, "", ""
        self.open: list[str] | None = None
        self.every: list[str] = []
        self.article: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        known = dict(attrs)
        if tag in BOILERPLATE:
            self.skipped += 1
        elif tag == "article":
            self.inside += 1
        elif tag == "title":
            self.in_title = True
        elif tag in ("p", "h2", "li") and not self.skipped:
            self._close()
            self.open = []
        elif tag == "link" and known.get("rel") == "canonical":
            self.canonical = known.get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag in BOILERPLATE:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "article":
            self._close()
            self.inside = max(0, self.inside - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in ("p", "h2", "li"):
            self._close()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif self.open is not None and not self.skipped:
            self.open.append(data)

    def _close(self) -> None:
        text = " ".join("".join(self.open or []).split())
        self.open = None
        if text:
            self.every.append(text)
            if self.inside:
                self.article.append(text)


def article_text(frame: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, canonical, text, preview) of each page: its paragraphs, an article's alone if there is one.

    The preview is the first two paragraphs of 20 characters or more, 600 characters at most.
    Null and empty pages have empty texts; rows with null ids stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for html in batch["html"]:
                page = _Paragraphs()
                page.feed(html or "")
                page.close()
                page._close()
                paragraphs = page.article or page.every
                preview = " ".join([p for p in paragraphs if len(p) >= 20][:2])[:600]
                out.append((" ".join(page.title.split()), page.canonical, "\n\n".join(paragraphs), preview))
            made = pd.DataFrame(out, columns=["title", "canonical", "text", "preview"])
            yield pd.concat([batch[["id"]].reset_index(drop=True), made], axis=1)

    rows = frame.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, title string, canonical string, text string, preview string")


def ics_events(frame: DataFrame, text_col: str, wanted: str | None = None, unwanted: str | None = None) -> DataFrame:
    """(uid, day, time, title, description, location, url) of calendar entries, lines unfolded.

    Repeating and cancelled entries go, and those whose title does not fit the patterns.
    """
    unfolded = F.regexp_replace(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"), r"\n[ \t]", "")
    blocks = frame.select(F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))).alias("e"))

    def field(name: str) -> Column:
        raw = F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1)
        for escaped, character in (("\\n", "\n"), ("\\,", ","), ("\\;", ";"), ("\\\\", "\\")):
            raw = F.replace(raw, F.lit(escaped), F.lit(character))
        return F.trim(raw)

    start = field("DTSTART")
    moment = F.try_to_timestamp(F.regexp_extract(start, r"^(\d{8}T\d{6})", 1), F.lit("yyyyMMdd'T'HHmmss"))
    local = F.when(start.endswith("Z"), F.from_utc_timestamp(moment, dates.ZONE)).otherwise(moment)
    day = F.coalesce(F.to_date(local), F.try_to_date(F.substring(start, 1, 8), "yyyyMMdd"))
    rows = blocks.where(~F.col("e").rlike(r"(?m)^RRULE") & (F.upper(field("STATUS")) != "CANCELLED")).select(
        field("UID").alias("uid"), day.alias("day"), F.coalesce(F.date_format(local, "HH:mm"), F.lit("")).alias("time"), field("SUMMARY").alias("title"),
        field("DESCRIPTION").alias("description"), field("LOCATION").alias("location"), field("URL").alias("url"),
    ).where("day IS NOT NULL AND title <> ''")
    rows = rows.where(F.col("title").rlike(wanted)) if wanted else rows
    return rows.where(~F.col("title").rlike(unwanted)) if unwanted else rows


def collect(readers: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> tuple[DataFrame | None, DataFrame]:
    """Rows of all sources that could be planned, and a status row (source, ok, error) of each.

    A source that fails is a row, not an exception. Sources are few; their rows stay distributed.
    """
    parts, status = [], []
    for name, read in readers.items():
        try:
            parts.append(read().withColumn("source", F.lit(name)))
            status.append((name, True, None))
        except Exception as error:  # noqa: BLE001 - whatever a source raises is its status
            status.append((name, False, str(error)[:500]))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, spark.createDataFrame(status, "source string, ok boolean, error string")
