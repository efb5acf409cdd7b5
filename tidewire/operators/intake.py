"""What comes in before anything is judged: source windows, saved state made valid, cached articles, pages that are what they should be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.functions.text import blank_to_null, clean, title_key, title_words

#: Shape of a story's short key, and how many of them are kept. Fixed values.
SHORT_KEY, STORY_KEYS = "^[a-f0-9]{12}$", 20_000
#: What pages say in their titles, and at their beginning, when what they had is gone. Fixed values.
MISSING_TITLE = r"(?i)\b404\b|\bpage not found\b|\barticle not found\b|\bstory not found\b"
MISSING_TEXT = r"(?i)(?:^|\s)(?:error\s*)?404\s*[:|-]?\s*(?:page\s+)?not found\b|^(?:page|article|story) not found\b"


def shift_day(day: Column, by: int) -> Column:
    """The day so many days later; a text that names none gives null."""
    return F.date_format(F.date_add(F.try_to_date(day, "yyyy-MM-dd"), by), "yyyy-MM-dd")


def search_window(query: Column, first: str, last: str) -> Column:
    """A search restricted to the days from first to last: in the place of a rolling window, else at the end."""
    bounds = f"after:{first} before:{last}"
    return F.when(query.rlike(r"when:\d+d"), F.regexp_replace(query, r"when:\d+d", bounds)).otherwise(F.trim(F.concat(query, F.lit(f" {bounds}"))))


def backfill(sources: DataFrame, search: str, query: str, age: str, first: str | None, last: str | None) -> DataFrame:
    """Sources for a run over past days, with `since` and `past_cache`; half a window is none.

    Searches get the window in their query, no rolling age, a day of slack before it, and go past
    the cache, for the same address now asks something else. Other sources stay as they are.
    """
    if not first or not last or first >= last:
        return sources.withColumns({"since": F.lit(None).cast("string"), "past_cache": F.lit(False)})
    takes = F.coalesce(F.col(search), F.lit(False)) & F.col(query).isNotNull()
    return sources.withColumns(
        {
            query: F.when(takes, search_window(F.col(query), first, last)).otherwise(F.col(query)),
            age: F.when(~takes, F.col(age)),
            "since": F.when(takes, shift_day(F.lit(first), -1)),
            "past_cache": takes,
        }
    )


def with_fallbacks(sources: DataFrame, name: str, url: str, endpoint: str) -> DataFrame:
    """Sources and, for each local outlet among them (`local`), a search of its site when its feed has nothing."""
    searched = F.concat(F.lit(endpoint), F.url_encode(F.concat(F.lit("site:"), urls.host(F.col(url)))))
    own = sources.withColumn("fallback", F.lit(False))
    extra = sources.where("local").withColumns({name: F.concat(name, F.lit(" (search)")), url: searched, "fallback": F.lit(True)})
    return own.unionByName(extra.select(*own.columns))


def configured_catalog(defaults: DataFrame, added: DataFrame, disabled: DataFrame, name: str, url: str) -> DataFrame:
    """The catalog of a run: defaults that aren't disabled, then what is added, the first of each address."""
    both = defaults.select(name, url, F.lit(0).alias("turn")).union(added.select(name, url, F.lit(1).alias("turn")))
    kept = both.join(disabled.select(name).distinct(), name, "left_anti").where(urls.is_web(F.col(url)))
    return kept.groupBy(url).agg(F.min_by(name, F.struct("turn", name)).alias(name), F.min("turn").alias("turn"))


def first_of_each(items: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """Items of all sources in the sources' order, the first of each key."""
    keyed = items.withColumn("_key", key)
    return keyed.groupBy("_key").agg(F.min_by(F.struct(*items.columns), F.struct(*order)).alias("row")).select("row.*")


def valid_cache(cache: DataFrame, key: str, url: str, checked: str, expires: str, now: Column) -> DataFrame:
    """Cached articles with a key, a page's address and a time of checking, that haven't expired; an absent end never does."""
    fresh = F.col(expires).isNull() | (F.col(expires) > now)
    return cache.where((F.coalesce(F.col(key), F.lit("")) != "") & urls.is_web(F.col(url)) & F.col(checked).isNotNull() & fresh)


def cached_article(items: DataFrame, cache: DataFrame, link: str, resolved: str, key: str, checked: str) -> DataFrame:
    """The items with the newest cached article of either of their two addresses, the first one's on a tie, and `hit`."""
    row = F.struct(*cache.columns)
    known = cache.groupBy(key).agg(F.max_by(row, checked).alias("_row"))
    one, two = (known.select(F.col(key).alias(f"_{n}"), F.col("_row").alias(f"_row{n}")) for n in (1, 2))
    joined = items.join(one, F.col(link) == F.col("_1"), "left").join(two, F.col(resolved) == F.col("_2"), "left")
    newer = F.col(f"_row2.{checked}") > F.col(f"_row1.{checked}")
    return joined.withColumn("cached", F.when(newer | F.col("_row1").isNull(), F.col("_row2")).otherwise(F.col("_row1"))).withColumn("hit", F.col("cached").isNotNull()).drop("_1", "_2", "_row1", "_row2")


def needed(cache: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """The part of a cache that a run can touch."""
    return cache.join(requests.select(key).distinct(), key, "left_semi")


def valid_headers(state: DataFrame, url: str, etag: str, modified: str, most: int = 500) -> DataFrame:
    """Saved validators by address: pages' addresses with at least one, texts cut, blanks as null."""
    one, two = (blank_to_null(F.substring(F.trim(c), 1, most)) for c in (etag, modified))
    return state.where(urls.is_web(F.col(url))).select(url, one.alias(etag), two.alias(modified)).where(F.col(etag).isNotNull() | F.col(modified).isNotNull())


def source_states(catalog: DataFrame, state: DataFrame, name: str, defaults: dict[str, Column]) -> DataFrame:
    """A state for each source of the catalog: the saved one, or defaults where it or a field is missing."""
    joined = catalog.select(name).distinct().join(state.select(name, *defaults), name, "left")
    return joined.select(name, *(F.coalesce(F.col(c), value).alias(c) for c, value in defaults.items()))


def cooled(state: DataFrame, failures: DataFrame, name: str, until: str) -> DataFrame:
    """Saved states with the later of their rest and a new one; sources without a state get one."""
    fresh = failures.groupBy(name).agg(F.max(until).alias("_until"))
    joined = state.join(fresh, name, "full_outer")
    return joined.select(*(F.greatest(F.coalesce(until, "_until"), F.coalesce("_until", until)).alias(c) if c == until else F.col(c) for c in state.columns))


def story_keys(rows: DataFrame, key: str, place: str, most: int = STORY_KEYS) -> DataFrame:
    """Distinct valid short keys in order of their first place, the first `most`."""
    one = rows.where(F.col(key).rlike(SHORT_KEY)).groupBy(key).agg(F.min(place).alias(place))
    return one.orderBy(place, key).limit(most)


def charset(head: Column) -> Column:
    """The character set that the first kilobyte of a page declares, in lower case; null if none."""
    said = F.substring(head, 1, 1024)
    return blank_to_null(F.lower(F.regexp_extract(said, r"""(?i)(?:<\?xml[^>]*encoding=|<meta[^>]*charset=)["']?\s*([\w-]+)""", 1)))


def shared_title(page: Column, expected: Column, least: int = 2, share: float = 0.3) -> Column:
    """Whether a page's title is the expected one's: enough words in common, and enough of the expected ones."""
    want, have = title_words(expected, 2), title_words(page, 2)
    common = F.size(F.array_intersect(want, have))
    return (common >= F.least(F.lit(least), F.size(want))) & (common >= share * F.size(want))


def is_missing(title: Column, text: Column, most: int = 400) -> Column:
    """Whether a page, though it was given, says that the article isn't there: in its titles, or where its text begins."""
    lead = F.substring(clean(text), 1, most)
    return F.coalesce(title.rlike(MISSING_TITLE), F.lit(False)) | F.coalesce(lead.rlike(MISSING_TEXT), F.lit(False))


def declares_article(json_ld: Column) -> Column:
    """Whether linked data of a page declares an article, at any depth."""
    return F.coalesce(json_ld.rlike(r'"@type"\s*:\s*(?:\[[^\]]*)?"(?:News|Blog|Report|Opinion)?(?:Article|Posting)"'), F.lit(False))


def has_evidence(canonical: Column, url: Column, kind: Column, json_ld: Column, paragraphs: Column, least: int = 2) -> Column:
    """Whether a page is an article: its own canonical address, its declared type, its linked data, or paragraphs enough."""
    own = F.coalesce(urls.same_page(canonical, url), F.lit(False)) & (F.coalesce(canonical, F.lit("")) != "")
    return own | F.coalesce(F.lower(kind) == "article", F.lit(False)) | declares_article(json_ld) | (paragraphs >= least)


def contradicts(canonical: Column, url: Column, missing: Column) -> Column:
    """Whether a page is not the one asked for: it says so, or its canonical address is another's."""
    other = (F.coalesce(canonical, F.lit("")) != "") & ~F.coalesce(urls.same_page(canonical, url), F.lit(True))
    return F.coalesce(missing, F.lit(False)) | other


def title_variants(title: Column, outlet: Column | None = None) -> Column:
    """Keys of a title: whole, without the outlet after a dash, the outlet alone, and both run together; longest first, no blanks.

    An `outlet` known otherwise is one more.
    """
    whole = clean(title)
    ending = r"\s+-\s+(.{2,80})$"
    bare, name = F.regexp_replace(whole, ending, ""), F.regexp_extract(whole, ending, 1)
    every = [whole, bare, name, F.concat_ws(" ", bare, name), *([] if outlet is None else [outlet, F.concat_ws(" ", bare, outlet)])]
    keys = F.array_distinct(F.array(*map(title_key, every)))
    long = F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))
    return F.transform(F.sort_array(long, asc=False), lambda x: x["x"])


def story_snippet(snippet: Column, title: Column, outlet: Column | None = None, least: int = 4) -> Column:
    """A snippet, blank if fewer than `least` words are left of it without the title's variants; whole where there is no title.

    Variants are whole words: a short title takes no letters out of other words.
    """
    apart = lambda text: F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))  # noqa: E731 - each word has its own spaces
    left = F.aggregate(title_variants(title, outlet), title_key(clean(snippet)), lambda text, variant: clean(F.replace(apart(text), apart(variant), F.lit(" "))))
    count = F.size(F.filter(F.split(left, " "), lambda w: w != ""))
    return F.when((clean(title) == "") | (count >= least), clean(snippet)).otherwise("")


def merged_sources(fresh: DataFrame, previous: DataFrame, status: DataFrame, source: str) -> DataFrame:
    """Each source's fresh rows if its reading worked, else its previous ones."""
    ok = status.where("ok").select(source)
    return fresh.join(ok, source, "left_semi").unionByName(previous.join(ok, source, "left_anti").select(*fresh.columns))


def event_key(source: Column, day: Column, time: Column, title: Column) -> Column:
    return F.concat_ws("|", source, day, F.coalesce(time, F.lit("")), title)


def valid_events(events: DataFrame, first: Column, days: int, day: str = "day", title: str = "title", key: Column | None = None) -> DataFrame:
    """Events with a real day within the window and a title, one of each key, titles and bodies cut."""
    kept = events.where(F.try_to_date(F.col(day), "yyyy-MM-dd").between(first, F.date_add(first, days)) & (clean(F.col(title)) != ""))
    own = event_key(F.col("source"), F.col(day), F.col("time"), F.col(title)) if key is None else key
    return kept.withColumn("_key", own).groupBy("_key").agg(F.min(F.struct(*events.columns)).alias("row")).select("row.*")


def clock_range(start_hour: Column, start_minute: Column, end_hour: Column, end_minute: Column, meridiem: Column) -> Column:
    """(time, end) of a range whose end alone says am or pm; a start that would pass the end steps back half a day."""
    from tidewire.functions.dates import clock

    end, start = clock(end_hour, end_minute, meridiem), clock(start_hour, start_minute, meridiem)
    back = F.format_string("%02d%s", (F.substring(start, 1, 2).cast("int") - 12), F.substring(start, 3, 3))
    known = (start != "") & (end != "")
    time = F.when(known, F.when(start > end, back).otherwise(start)).otherwise("")
    return F.struct(time.alias("time"), F.when(known, end).otherwise("").alias("end"))


def page_events(frame: DataFrame, id_col: str, lines: Column, heading: str, timed: str) -> DataFrame:
    """(id, place, day, time, end, title) of a schedule page's lines: timed entries under headings that name a day.

    `heading` is a pattern with month name, day and year as groups, `timed` one with start hour and
    minute, end hour and minute, meridiem and title. A day without entries gives one without a time,
    of its heading's place. Lines are one page's: a bounded list.
    """
    rows = frame.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("place", "line"))
    group = lambda pattern, i: F.regexp_extract("line", pattern, i)
    named = F.concat_ws(" ", group(heading, 1), group(heading, 2), group(heading, 3))
    day = F.when(F.col("line").rlike(heading), F.date_format(F.try_to_date(named, "MMMM d yyyy"), "yyyy-MM-dd"))
    order = W.partitionBy("id").orderBy("place")
    dated = rows.withColumn("heads", day.isNotNull()).withColumn("day", F.last(day, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    hour = lambda i: F.nullif(group(timed, i), F.lit("")).try_cast("int")
    span = clock_range(hour(1), F.coalesce(hour(2), F.lit(0)), hour(3), F.coalesce(hour(4), F.lit(0)), group(timed, 5))
    told = dated.withColumns({"timed": F.col("line").rlike(timed) & F.col("day").isNotNull(), "span": span, "title": clean(group(timed, 6))})
    some = F.max(F.col("timed").cast("int")).over(W.partitionBy("id", "day"))
    kept = told.withColumn("some", some).where(F.col("timed") | (F.col("heads") & (F.col("some") == 0)))
    entry = lambda c: F.when(F.col("timed"), F.col(f"span.{c}")).otherwise("")
    return kept.select("id", "place", "day", entry("time").alias("time"), entry("end").alias("end"), F.when(F.col("timed"), F.col("title")).otherwise(clean(F.col("line"))).alias("title"))


def linked_comments(frame: DataFrame, id_col: str, json_col: str, most: int = 25) -> DataFrame:
    """(id, place, author, text, at) of comments in a page's linked data, those of replies too, the first `most` of a page.

    Two levels are read: comments and their replies. Texts are cleaned and cut to 1,200 characters; blank ones go.
    """
    person = "struct<name:string>"
    reply = f"struct<text:string,author:{person},dateCreated:string,datePublished:string>"
    schema = f"struct<comment:array<struct<text:string,author:{person},dateCreated:string,datePublished:string,comment:array<{reply}>>>>"
    found = frame.select(F.col(id_col).alias("id"), F.posexplode(F.from_json(json_col, schema)["comment"]).alias("i", "c"))
    own = F.struct(F.col("c.text").alias("text"), F.col("c.author").alias("author"), F.coalesce("c.dateCreated", "c.datePublished").alias("at"))
    replies = F.transform(F.coalesce("c.comment", F.array().cast(f"array<{reply}>")), lambda r: F.struct(r["text"].alias("text"), r["author"].alias("author"), F.coalesce(r["dateCreated"], r["datePublished"]).alias("at")))
    flat = found.select("id", "i", F.posexplode(F.concat(F.array(own), replies)).alias("j", "x"))
    text = F.substring(clean(F.col("x.text")), 1, 1200)
    rows = flat.select("id", "i", "j", clean(F.col("x.author.name")).alias("author"), text.alias("text"), F.try_to_timestamp("x.at").alias("at")).where("text <> ''")
    place = F.row_number().over(W.partitionBy("id").orderBy("i", "j"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("id", "place", "author", "text", "at")


def listing_items(frame: DataFrame, id_col: str, html_col: str, base_col: str, path: str, least: int = 12) -> DataFrame:
    """(id, place, title, link) of a listing page's links whose path fits a pattern and whose text is a headline; the first of each address."""
    anchor = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"'#]+)[^"']*["'][^>]*>(.*?)</a>"""
    raw = F.posexplode(F.regexp_extract_all(html_col, F.lit(anchor), F.lit(0))).alias("place", "raw")
    rows = frame.select(F.col(id_col).alias("id"), F.col(base_col).alias("base"), raw)
    title = clean(F.regexp_replace(F.regexp_extract("raw", anchor, 2), "<[^>]*>", " "))
    found = rows.select("id", "place", title.alias("title"), urls.resolve(F.trim(F.regexp_extract("raw", anchor, 1)), F.col("base")).alias("link"))
    fit = found.where(urls.path(F.col("link")).rlike(path) & (F.length("title") >= least))
    return fit.groupBy("id", "link").agg(F.min(F.struct("place", "title")).alias("x")).select("id", "x.place", "x.title", "link")
