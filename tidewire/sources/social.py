"""Posts and comments of social pages: from the data that a page carries for its scripts, and what two readings of a post make together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import dates, urls
from tidewire.functions.text import clean, first_filled
from tidewire.operators.resolve import threads
from tidewire.sources.markup import Field, Rule, filled

#: Marks in a page's data: a post's address, its message and time, a comment's text, author, time and depth. Fixed values;
#: loops give nothing back, so that long texts need no deep stack.
POST_URL = r'"wwwURL":"(https:\\/\\/www\.facebook\.com\\/[^"]*?\\/posts\\/[^"]+?)"'
MESSAGE, CREATED = r'"message":\{"text":"((?:[^"\\]++|\\.)*+)"', r'"creation_time":(\d{9,12})\b'
BODY, NAME = r'"body":\{"text":"((?:[^"\\]++|\\.)*+)"', r'"name":"((?:[^"\\]++|\\.)*+)"'
COMMENTED, DEPTH = r'"created_time":(\d{9,12})', r'"depth":(\d+)'


def unescaped(text: Column) -> Column:
    """The text of a JSON string's inside; one that is none keeps its letters, slashes without their mark."""
    read = F.from_json(F.concat(F.lit('{"m":"'), text, F.lit('"}')), "m string")["m"]
    return F.coalesce(read, F.replace(text, F.lit("\\/"), F.lit("/")))


def marks(frame: DataFrame, id_col: str, html_col: str, pattern: str, before: int, after: int) -> DataFrame:
    """(id, place, found, ahead, around, behind): each match of a pattern's first group in a page, and the text around it.

    `ahead` are the `before` characters before a match, `behind` what begins with it, and `around` both.
    """
    rows = frame.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    # Where a match begins: after all texts between matches up to it, and all matches before it.
    pieces = rows.select("id", "html", found.alias("every"), F.split("html", pattern, -1).alias("between")).where(F.size("every") > 0)
    lengths = pieces.withColumn("sizes", F.zip_with(F.slice("between", 1, F.size("every")), "every", lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))))
    ends = F.aggregate("sizes", F.array(F.lit(0)), lambda done, s: F.concat(done, F.array(F.element_at(done, -1) + s["b"] + s["m"])))
    starts = F.transform(F.arrays_zip(ends.alias("e"), F.col("sizes").alias("s")), lambda x: x["e"] + x["s"]["b"])
    at = lengths.select("id", "html", F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size("every")).alias("at"), F.col("every").alias("m"))).alias("place", "x"))
    start = F.col("x.at")
    low = F.greatest(start - before, F.lit(0))
    return at.select(
        "id", "place", F.regexp_extract("x.m", pattern, 1).alias("found"), F.substring("html", low + 1, start - low).alias("ahead"),
        F.substring("html", low + 1, start - low + after).alias("around"), F.substring("html", start + 1, F.lit(after)).alias("behind"),
    )


def preloaded_posts(frame: DataFrame, id_col: str, html_col: str, near: int = 30_000) -> DataFrame:
    """(id, place, link, text, at) of posts in a page's data: the first mention of each address, with the message and time near it.

    A post without a message goes. Null pages and pages without posts give no rows.
    """
    found = marks(frame, id_col, html_col, POST_URL, near, near)
    told = found.select(
        "id", "place", unescaped(F.col("found")).alias("link"), clean(unescaped(F.nullif(F.regexp_extract("around", MESSAGE, 1), F.lit("")))).alias("text"),
        F.timestamp_seconds(F.nullif(F.regexp_extract("around", CREATED, 1), F.lit("")).try_cast("long")).alias("at"),
    )
    firsts = told.groupBy("id", "link").agg(F.min_by(F.struct("place", "text", "at"), "place").alias("x"))
    return firsts.select("id", "x.place", "link", "x.text", "x.at").where("text <> ''")


def preloaded_comments(frame: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, place, root, author, text, at) of comments in a page's data: of copies the first; a reply belongs to the comment before it that is none."""
    found = marks(frame, id_col, html_col, BODY, 600, 6000)
    depths = F.regexp_extract_all("ahead", F.lit(DEPTH), F.lit(1))
    told = found.select(
        "id", "place", clean(unescaped(F.nullif(F.regexp_extract("behind", NAME, 1), F.lit("")))).alias("author"), clean(unescaped(F.col("found"))).alias("text"),
        F.coalesce(F.try_element_at(depths, F.lit(-1)).try_cast("int"), F.lit(0)).alias("depth"),
        F.timestamp_seconds(F.nullif(F.regexp_extract("behind", COMMENTED, 1), F.lit("")).try_cast("long")).alias("at"),
    )
    firsts = told.where("text <> ''").groupBy("id", "author", "text").agg(F.min_by(F.struct("place", "depth", "at"), "place").alias("x")).select("id", "author", "text", "x.*")
    # A page's first comment is a root, whatever its depth.
    numbered = firsts.withColumn("first", F.row_number().over(W.partitionBy("id").orderBy("place")) == 1)
    return threads(numbered, "id", "place", F.col("first") | (F.col("depth") == 0)).select("id", "place", "root", "author", "text", "at")


#: Where a post's own page tells what it is; comments that it shows, by what screen readers are told; and links to posts.
POST = Rule("post", "", (
    *(Field("text", f"meta[{kind}='{name}']", "content") for name in ("og:description", "twitter:description", "description") for kind in ("property", "name")),
    *(Field("title", f"meta[{kind}='{name}']", "content") for name in ("og:title", "twitter:title") for kind in ("property", "name")),
    Field("link", "link[rel='canonical']", "href"), *(Field("link", f"meta[{kind}='og:url']", "content") for kind in ("property", "name")),
    *(Field("date", f"meta[{kind}='{name}']", "content") for name in ("article:published_time", "article:modified_time") for kind in ("property", "name")),
))
SHOWN = Rule("shown", "[aria-label^='Comment by'], [aria-label*=' comment by'], [data-testid='UFI2Comment/body'], .UFICommentBody", (Field("aria", "", "aria-label"), Field("text")))
LINKS = Rule("links", "a[href]", (Field("href", "", "href"), Field("own"), Field("around", outward=6, most=1201)))
#: How long ago something was, at a text's end; and the words of a post's buttons. Fixed values.
AGO = r"(?i)\b(?:\d+[mhd](?:\d+)?|(?:about\s+)?(?:an?\s+hour|\d+\s+(?:minutes?|hours?|days?))\s+ago)$"
BUTTONS, POST_PATH = r"(?i)\b(?:Like|Comment|Share|Full Story)\b", r"(?i)/posts/|story\.php|permalink\.php"
RELATIVE = r"(?i)\b(?:(\d+)\s*([mhd])|(\d+)\s+(minutes?|hours?|days?)|an?\s+hour)\s*·"


def relative_time(text: Column, now: Column) -> Column:
    """The instant that "3h ·" or "an hour ·" in a text lies before `now`; null without one."""
    part = lambda i: F.regexp_extract(clean(text), RELATIVE, i)
    amount = F.coalesce(F.nullif(part(1), F.lit("")), F.nullif(part(3), F.lit("")), F.lit("1")).try_cast("int")
    unit = F.lower(F.substring(first_filled(part(2), part(4), F.lit("h")), 1, 1))
    seconds = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86_400)
    return F.when(clean(text).rlike(RELATIVE), F.timestamp_micros(F.unix_micros(now) - amount.cast("long") * seconds * 1_000_000))


def post_pages(found: DataFrame, pages: DataFrame, id_col: str, name: Column, url: Column, html: Column) -> DataFrame:
    """(id, title, link, at, text) of posts' own pages, from rows of `POST`: what their heads tell, else the name and address asked for."""
    said = found.where("rule = 'post'").groupBy("id").agg(filled("text").alias("text"), filled("title").alias("title"), filled("link").alias("link"), filled("date", dates.parse(clean(F.col("text")))).alias("at"))
    asked = pages.select(F.col(id_col).alias("id"), name.alias("name"), url.alias("url"), F.timestamp_seconds(F.nullif(F.regexp_extract(html, r'"(?:creation_time|publish_time)":(\d{9,12})\b', 1), F.lit("")).try_cast("long")).alias("made"))
    joined = asked.join(said, "id", "left")
    text = F.coalesce("text", F.lit(""))
    title = F.concat(first_filled(F.col("title"), F.col("name")), F.lit(" post"), F.when(text != "", F.concat(F.lit(": "), F.substring(text, 1, 80))).otherwise(""))
    return joined.select("id", clean(title).alias("title"), first_filled(F.col("link"), F.col("url")).alias("link"), F.coalesce("at", "made").alias("at"), text.alias("text"))


def shown_comments(found: DataFrame) -> DataFrame:
    """(id, item, author, text) of comments that a page shows, from rows of `SHOWN`; of copies the first."""
    own = found.where("rule = 'shown'").groupBy("id", "item").agg(filled("aria").alias("aria"), filled("text").alias("text"))
    author = F.regexp_replace(F.regexp_replace(F.coalesce("aria", F.lit("")), r"(?i)^Comment by\s+", ""), r"(?i)\s+(?:about\s+)?(?:an?\s+hour|\d+\s+(?:minutes?|hours?|days?))\s+ago$", "")
    named = own.withColumn("author", author)
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)^Top fan", "")
    leads = (F.col("author") != "") & F.startswith(F.lower(bare), F.lower("author"))
    rest = F.regexp_replace(clean(F.when(leads, F.substring(bare, F.length("author") + 1, F.length(bare))).otherwise(bare)), "(?i)^Top fan", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(rest, AGO, ""), r"(?i)\d+[mhd](?:\d+)?$", ""))
    told = named.select("id", "item", "author", text.alias("text")).where("text <> ''")
    return told.groupBy("id", "author", "text").agg(F.min("item").alias("item")).select("id", "item", "author", "text")


def linked_posts(found: DataFrame, pages: DataFrame, id_col: str, base: Column, now: Column, most: int = 1200) -> DataFrame:
    """(id, item, link, text, at) of posts that a page links to, from rows of `LINKS`: the first link of each.

    A post's text is that of the nearest element around its link that has more than the link's own
    text and is not too long, else the shortest one cut.
    """
    rows = found.where("rule = 'links'")
    own = rows.groupBy("id", "item").agg(filled("href").alias("href"), F.length(F.coalesce(filled("own"), F.lit(""))).alias("n")).where(F.col("href").rlike(POST_PATH))
    around = rows.where("field = 'around' AND text <> ''").select("id", "item", "place", F.col("text").alias("level")).join(own, ["id", "item"])
    fits = F.length("level").between(F.greatest(F.lit(20), F.col("n") + 1), F.lit(most))
    best = around.groupBy("id", "item", "href").agg(
        F.min_by("level", F.when(fits, F.col("place"))).alias("fit"), F.min_by("level", F.struct(F.length("level"), "place")).alias("short")
    )
    bases = pages.select(F.col(id_col).alias("id"), base.alias("base"))
    text = clean(F.regexp_replace(F.coalesce("fit", F.substring("short", 1, most)), BUTTONS, " "))
    told = best.join(bases, "id").select("id", "item", urls.post_link(urls.resolve(F.replace("href", F.lit("&amp;"), F.lit("&")), F.col("base"))).alias("link"), text.alias("text")).where("text <> '' AND link <> ''")
    firsts = told.groupBy("id", "link").agg(F.min_by(F.struct("item", "text"), "item").alias("x"))
    return firsts.select("id", "x.item", "link", "x.text", relative_time(F.col("x.text"), now).alias("at"))


def merged_posts(pages: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """Posts as their page tells them, with what their own address told in its place where it told anything.

    Both have key, title, link, at, text and comments (an array); a post read alone keeps its own.
    """
    other = posts.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in ("title", "link", "at", "text", "comments")))
    joined = pages.join(other, key, "left")
    better = lambda c: first_filled(F.col(f"_{c}"), F.col(c)).alias(c)
    own = F.when(F.size(F.coalesce("_comments", F.array())) > 0, F.col("_comments")).otherwise(F.coalesce("comments", F.col("_comments")))
    return joined.select(key, better("title"), better("link"), F.coalesce("_at", "at").alias("at"), better("text"), own.alias("comments"))
