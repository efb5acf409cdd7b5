"""What pages hold, by a table of selectors: one pass over each page for all rules, rows of fields out.

A rule names the hosts it is for, the elements that are its items, and for each field where its
value is: a selector below the item, and an attribute or the text. `extract` reads a page once
and gives a row for each value, in the page's order; what the values mean (first one that is
filled, dates, addresses) is decided by DataFrame operations on these rows, in the functions below it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import dates, urls
from tidewire.functions.text import blank_to_null, clean
from tidewire.operators import alerts

#: Elements without an end. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What ends an open paragraph, and for other elements which open ones their start ends, and across what it doesn't. Fixed values.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}
ACROSS = {"li": "ul ol", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table"}


@dataclass
class Node:
    """An element: its place among a page's elements, and what it holds in order, texts and elements."""

    place: int
    tag: str
    attributes: dict[str, str]
    parent: Node | None
    before: Node | None = None
    inside: list[Node | str] = field(default_factory=list)

    def elements(self) -> Iterator[Node]:
        """All elements below, in the page's order."""
        stack = [x for x in reversed(self.inside) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.inside) if isinstance(x, Node)]

    def text(self, without: Selector | None = None) -> str:
        """All text inside, but for that of elements that a selector meets."""
        out, stack = [], list(reversed(self.inside))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif without is None or not without.meets(x):
                stack += reversed(x.inside)
        return "".join(out)


class Builder(HTMLParser):
    """Elements of a page; ends that nothing opened are passed over, and what is left open ends with the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node(0, "", {}, None)
        self.count = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended = {*ENDS.get(tag, "").split(), *(["p"] if tag in ENDS_P else [])}
        at, stays = self.open, ACROSS.get(tag, "table td th button").split()
        while at.parent is not None and at.tag not in stays:
            if at.tag in ended:
                self.open = at.parent
            at = at.parent
        self.count += 1
        before = next((x for x in reversed(self.open.inside) if isinstance(x, Node)), None)
        node = Node(self.count, tag, {k: v or "" for k, v in attrs}, self.open, before)
        self.open.inside.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = self.open
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self.open = at.parent

    def handle_data(self, data: str) -> None:
        self.open.inside.append(data)


def tree(html: str) -> Node:
    """The root of a page's elements."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


#: A condition on an element: a tag, class, id, or attribute with what it should be.
CONDITION = re.compile(r"""([*]|[\w-]+)|\.([\w-]+)|\#([\w-]+)|\[([\w:-]+)(?:([\^*$~]?=)["']?([^"'\]]*)["']?)?\]""")


@dataclass(frozen=True)
class Selector:
    """One or more paths of conditions, joined by descent (space), child (>), or a sibling before (~, the next one +)."""

    paths: tuple[tuple[tuple[str, tuple], ...], ...]

    @staticmethod
    def of(text: str) -> Selector:
        paths = []
        for path in re.split(r",(?![^\[]*\])", text):
            steps = re.findall(r"""\s*([>~+]|\s)?\s*((?:[\w*.#-]|\[[^\]]*\])+)""", path.strip())
            paths.append(tuple((joint.strip() or " ", tuple(CONDITION.findall(own))) for joint, own in steps))
        return Selector(tuple(paths))

    def meets(self, node: Node) -> bool:
        return any(_path(node, path, len(path) - 1) for path in self.paths)


def _holds(node: Node, conditions: tuple) -> bool:
    for tag, name, own, key, how, value in conditions:
        has = node.attributes.get(key)
        if tag:
            good = tag in ("*", node.tag)
        elif name:
            good = name in node.attributes.get("class", "").split()
        elif own:
            good = node.attributes.get("id") == own
        elif has is None or (how and how != "=" and not value):
            good = False
        else:
            good = {"": True, "=": has == value, "^=": has.startswith(value), "$=": has.endswith(value), "*=": value in has, "~=": value in has.split()}[how]
        if not good:
            return False
    return node.parent is not None


def _path(node: Node, path: tuple, at: int) -> bool:
    joint, conditions = path[at]
    if not _holds(node, conditions):
        return False
    if at == 0:
        return True
    follow, once = (("parent", joint == ">") if joint in (" ", ">") else ("before", joint == "+"))
    other = getattr(node, follow)
    while other is not None:
        if _path(other, path, at - 1):
            return True
        other = None if once else getattr(other, follow)
    return False


@dataclass(frozen=True)
class Field:
    """Where a value is: a selector below the item (blank: the item), an attribute or the text, the first match or every one.

    `itself` lets the item be the match; `without` names elements whose text doesn't count. `outward`
    asks for the texts of so many elements around the match, cleaned and cut to `most` characters,
    from the nearest on: their places are 0, 1 and so on.
    """

    name: str
    selector: str = ""
    attribute: str = ""
    every: bool = False
    itself: bool = False
    without: str = ""
    outward: int = 0
    most: int = 0


@dataclass(frozen=True)
class Rule:
    """The items of pages (a selector; blank: the page) of some hosts (a pattern; blank: all), and their fields, the better place of one first."""

    name: str
    items: str
    fields: tuple[Field, ...]
    hosts: str = ""


class Compiled:
    """Rules ready for use."""

    def __init__(self, rules: Sequence[Rule]):
        one = lambda text: Selector.of(text) if text else None
        self.rules = [(r, re.compile(r.hosts, re.I) if r.hosts else None, one(r.items), [(f, one(f.selector), one(f.without)) for f in r.fields]) for r in rules]

    def rows(self, html: str, host: str) -> Iterator[tuple]:
        """(rule, item, outer, within, field, turn, place, text) of a page, in order."""
        wanted = [r for r in self.rules if r[1] is None or r[1].search(host)]
        if not wanted:
            return
        root = tree(html)
        every = list(root.elements())
        for rule, _, items, fields in wanted:
            found = [root] if items is None else [n for n in every if items.meets(n)]
            places = {n.place for n in found}
            for item in found:
                around, at = [], item.parent
                while at is not None:
                    around.append(at.place)
                    at = at.parent
                outer = next((x for x in around if x in places), None)
                below = list(item.elements()) if any(f.selector for f, _, _ in fields) else []
                for turn, (own, selector, without) in enumerate(fields):
                    if selector is None or (own.itself and selector.meets(item)):
                        met = [item]
                    else:
                        met = [n for n in below if selector.meets(n)]
                    for n in met if own.every else met[:1]:
                        if own.outward:
                            at = n.parent
                            for level in range(own.outward):
                                if at is None:
                                    break
                                yield rule.name, item.place, outer, around, own.name, turn, level, " ".join(at.text(without).split())[: own.most]
                                at = at.parent
                            continue
                        text = n.attributes.get(own.attribute) if own.attribute else n.text(without)
                        if text is not None:
                            yield rule.name, item.place, outer, around, own.name, turn, n.place, text


#: Columns of the rows, besides the page's id.
ROWS = "rule string, item int, outer int, within array<int>, field string, turn int, place int, text string"


def extract(frame: DataFrame, id_col: str, html_col: str, url_col: str, rules: Sequence[Rule]) -> DataFrame:
    """(id, rule, item, outer, within, field, turn, place, text): a row for each value that a rule finds in a page.

    `item` and `place` number elements in the page's order, `outer` is the nearest item of the
    same rule around one, `within` all elements around it from the nearest on, `turn` tells which of a rule's fields found the value. Each page is read
    once for all rules; null pages and pages of no rule's host give no rows. Ids may be null or
    repeat, a page's rows are made with it; columns of any name are left out.
    """
    rows = frame.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), F.coalesce(urls.host(F.col(url_col)), F.lit("")).alias("host")).where("html IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    shapes = pa.schema([("rule", pa.string()), ("item", pa.int32()), ("outer", pa.int32()), ("within", pa.list_(pa.int32())), ("field", pa.string()), ("turn", pa.int32()), ("place", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Compiled(rules)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, own = [], []
                for at, (html, host) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    more = list(compiled.rows(html, host))
                    found += more
                    own += [at] * len(more)
                columns = [pa.array([x[i] for x in found], shapes.types[i]) for i in range(len(shapes))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), *columns], ["id", *shapes.names])

    return rows.mapInArrow(run, f"id {kind}, {ROWS}")


def filled(field_name: str, value: Column | None = None, refuse: str | None = None) -> Column:
    """The value of a field in its first place that has one, of an item; an aggregate. `value` reads a text, null where it can't."""
    read = blank_to_null(clean(F.col("text"))) if value is None else value
    good = (F.col("field") == field_name) & read.isNotNull()
    if refuse is not None:
        good &= ~clean(F.col("text")).rlike(refuse)
    return F.min_by(read, F.when(good, F.struct("turn", "place")))


def joined(field_name: str, mark: str = " ") -> Column:
    """All values of a field of an item, in order; an aggregate over an item's own few rows."""
    every = F.sort_array(F.collect_list(F.when(F.col("field") == field_name, F.struct("turn", "place", blank_to_null(clean(F.col("text"))).alias("x")))))
    return F.array_join(F.transform(every, lambda r: r["x"]), mark)


def cards(found: DataFrame, pages: DataFrame, id_col: str, base_col: str, allowed: str = "") -> DataFrame:
    """(id, rule, item, title, link, at, description, category) of listing cards with a title and a link.

    Fields are title, link, date, description (all of them, joined) and category. Links are taken
    from the page's address, and must fit the pattern `allowed`. A card's date is the first that can be read.
    """
    of_item = found.groupBy("id", "rule", "item").agg(
        filled("title").alias("title"), filled("link").alias("href"), filled("date", dates.parse(clean(F.col("text")))).alias("at"),
        joined("description").alias("description"), joined("category").alias("category"),
    )
    bases = pages.select(F.col(id_col).alias("id"), F.col(base_col).alias("base"))
    linked = of_item.where("title IS NOT NULL AND href IS NOT NULL").join(bases, "id").withColumn("link", urls.resolve(F.col("href"), F.col("base")))
    return linked.where(F.col("link").rlike(allowed)).select("id", "rule", "item", "title", "link", "at", "description", "category")


#: Words of a comment form, which are no comment. Fixed value.
NO_COMMENT = r"(?i)\b(?:add a comment|cancel reply|comments are closed|join the conversation|leave a reply|log in to comment|post a comment|reply to|sign in to comment|submit comment)\b"


def comments(found: DataFrame, least: int = 12, most: int = 1200) -> DataFrame:
    """(id, item, thread, author, text, at) of comments: `thread` is the nearest comment around one that is kept itself.

    Fields are author, text and date. Texts are cut, short ones and words of forms go, and of equal
    comments of a page the first stays; what answered one that went belongs to the next around it.
    """
    of_item = found.groupBy("id", "item").agg(
        F.first("within").alias("within"), filled("author", refuse=NO_COMMENT).alias("author"), filled("text").alias("text"),
        filled("date", dates.parse(clean(F.col("text")))).alias("at"),
    )
    author = F.trim(F.regexp_replace(F.coalesce("author", F.lit("")), r"(?i)\s+says:?$", ""))
    told = of_item.withColumns({"author": author, "text": F.when(F.length("text") > most, F.concat(F.rtrim(F.substring("text", 1, most - 3)), F.lit("..."))).otherwise(F.col("text"))})
    good = told.where((F.length("text") >= least) & ~F.col("text").rlike(NO_COMMENT))
    firsts = good.groupBy("id", F.lower("author"), F.lower("text")).agg(F.min("item").alias("item")).select("id", "item")
    kept = good.join(firsts, ["id", "item"])
    # The elements around an item are few; the nearest of them that is a comment kept itself is what it answers.
    around = kept.select("id", "item", F.posexplode("within").alias("far", "thread"))
    threads = around.join(kept.select("id", F.col("item").alias("thread")), ["id", "thread"]).groupBy("id", "item").agg(F.min_by("thread", "far").alias("thread"))
    return kept.join(threads, ["id", "item"], "left").select("id", "item", "thread", "author", "text", "at")


#: Days and months as they are written. Fixed values.
DAY, MONTH = r"(?:Sun|Mon|Tues|Wednes|Thurs|Fri|Satur)day", r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: A meeting's line: weekday, month, day, year, what it says; its time at its end; and lines on how to take part. Fixed values.
MEETING = rf"(?i)^({DAY}),\s+({MONTH})\s+(\d{{1,2}}),\s+(\d{{4}})\s*:\s*(.+)$"
MEETING_TIME, TAKE_PART = r"(?i)\(\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?\s*\)\s*$", r"(?i)call-in|conference id|join the ms teams"
#: What `meetings` reads: paragraphs with their links, rules, and entries of lists.
MEETINGS = (Rule("meetings", "p, hr, li", (Field("line", "p", itself=True), Field("entry", "li", itself=True), Field("rule", "hr", itself=True), Field("link", "a[href]", "href"))),)


def meetings(found: DataFrame, today: Column, taking_part: str = "") -> DataFrame:
    """(id, place, day, time, label, body, href, board) of meetings: a paragraph's dated line and the lists after it.

    A line's lists are those of the elements beside it, up to the next dated line or a rule. Lines
    that call a meeting off, and days that don't fit their weekday, go; a meeting whose lists only
    say how to take part has `taking_part` as its body. A page without a dated line gives a row
    without a day, which tells that its layout changed.
    """
    line = clean(F.col("text"))
    part = lambda i: F.regexp_extract("line", MEETING, i)
    rows = found.where("rule = 'meetings'").select("id", "item", "field", "within", line.alias("line"))
    heads = rows.where("field = 'rule'").select("id", F.col("item").alias("place"), F.get("within", F.lit(0)).alias("scope"), F.lit(-1).alias("opens"))
    dated = rows.where(F.col("field") == "line").where(F.col("line").rlike(MEETING))
    heads = heads.union(dated.select("id", "item", F.get("within", F.lit(0)), F.col("item")))
    # An entry is below an element beside the line, so what holds that element is around the entry's own list.
    entries = rows.where("field = 'entry' AND line <> ''").select("id", F.col("item").alias("place"), "line", F.explode(F.slice("within", 2, 1000)).alias("scope"))
    both = heads.withColumn("line", F.lit(None).cast("string")).unionByName(entries.withColumn("opens", F.lit(None).cast("int")))
    upto = W.partitionBy("id", "scope").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    listed = both.withColumn("head", F.last("opens", ignorenulls=True).over(upto)).where("line IS NOT NULL AND head > 0")
    agenda = F.sort_array(F.collect_list(F.when(~F.col("line").rlike(TAKE_PART), F.struct("place", "line"))))
    bodies = listed.groupBy("id", F.col("head").alias("item")).agg(
        F.array_join(F.transform(agenda, lambda x: x["line"]), " | ").alias("agenda"), F.max(F.col("line").rlike(TAKE_PART)).alias("open")
    )
    links = found.where("rule = 'meetings' AND field = 'link'").groupBy("id", "item").agg(F.min_by("text", "place").alias("href"))
    told = dated.join(bodies, ["id", "item"], "left").join(links, ["id", "item"], "left")
    rest = part(5)
    clock = lambda i: F.nullif(F.regexp_extract(rest, MEETING_TIME, i), F.lit(""))
    time = F.when(rest.rlike(MEETING_TIME), dates.clock(clock(1).try_cast("int"), F.coalesce(clock(2).try_cast("int"), F.lit(0)), clock(3))).otherwise("")
    named = F.regexp_replace(clean(F.regexp_replace(rest, r"\([^)]*\)\s*$", "")), r"\bMeeting\b", "meeting")
    label = F.concat(F.upper(F.substring(named, 1, 1)), F.substring(named, 2, 10_000))
    day = alerts.dated(part(2), part(3).try_cast("int"), part(4).try_cast("int"), part(1), today)
    body = F.when(F.coalesce("agenda", F.lit("")) != "", F.col("agenda")).when(F.col("open"), F.lit(taking_part)).otherwise("")
    seen = told.select("id", F.col("item").alias("place"), F.date_format(day, "yyyy-MM-dd").alias("day"), time.alias("time"), label.alias("label"), body.alias("body"), "href", rest.alias("rest"))
    good = seen.where("day IS NOT NULL").where(~F.col("rest").rlike(r"(?i)^no\b|cancel")).drop("rest")
    good = good.withColumn("board", F.col("label").rlike(r"(?i)\bboard meeting\b"))
    without = found.where("rule = 'meetings'").groupBy("id").agg(F.max((F.col("field") == "line") & line.rlike(MEETING)).alias("some")).where("NOT some")
    nothing = without.select("id", *(F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns[1:]))
    return good.unionByName(nothing)


def first_text(found: DataFrame) -> DataFrame:
    """(id, rule, turn, text): a page's text at the first place of a rule that has any."""
    best = found.groupBy("id", "rule").agg(F.min_by(F.struct("turn", clean(F.col("text")).alias("text")), F.when(blank_to_null(clean(F.col("text"))).isNotNull(), F.struct("turn", "place"))).alias("x"))
    return best.where("x IS NOT NULL").select("id", "rule", "x.turn", "x.text")


def article_rules(by_host: Sequence[tuple[str, Sequence[str]]], default: Sequence[str]) -> list[Rule]:
    """A rule for each host pattern: its own selectors of an article's text, then the default ones, each once; and one for all hosts."""
    whole = lambda name, hosts, selectors: Rule(name, "", tuple(Field("text", s) for s in dict.fromkeys(selectors)), hosts)
    return [*(whole(hosts, hosts, [*own, *default]) for hosts, own in by_host), whole("default", "", default)]
