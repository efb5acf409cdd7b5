"""What a row is, told by its address, its names and its labels: type, outlet, section, access, eligibility.

Everything here is a Column expression, evaluated in the scan that reads the rows. Domains,
patterns and labels of a newsroom are arguments; general English patterns are defaults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.functions.text import SENTIMENTS, blank_to_null, clean, first_filled

#: Patterns of death notices, by where they count. Fixed values.
NOTICE_PATH = r"(?i)(?:^|/)(?:obituaries?|obits?|death-notices?|life-lines/obituaries?)(?:/|$)"
NOTICE_CATEGORY = r"(?i)\b(?:obituaries?|obits?|death notices?)\b"
NOTICE_TITLE = r"(?i)^(?:obituaries?|obits?|obituary|death notices?|in memoriam)\b|\bobituary:|\bdeath notice:"
NOTICE_TEXT = r"(?i)\b(?:obituary|obituaries|death notices?|passed away|died peacefully|funeral (?:service|home)|celebration of life|memorial service)\b"
#: An address that carries markup as data in a parameter. Fixed value.
DATA_MARKUP = r"(?i)^data:[^,]{0,100},\s*<[^>]+>"
#: Titles of pieces that only a copy of themselves is like. Fixed value.
OPINION = r"(?i)\b(?:letter to the editor|letters?:|commentary|opinion|op-ed|editorial|column|endors(?:e|es|ing)|headlines:)"
#: Titles that gather several stories. Fixed value.
ROUNDUP = r"(?i)\b(?:business briefs?|health briefs?|community news|sports\s*/\s*outdoors)\b"


def holds(text: Column, pattern: str | None) -> Column:
    """Whether a pattern is found in a text; without a pattern always, in a null text as in an empty one."""
    return F.lit(True) if pattern is None else F.coalesce(text, F.lit("")).rlike(pattern)


@dataclass(frozen=True)
class Shape:
    """Patterns of an address's host and path and of a title, all of which must be found."""

    host: str | None = None
    path: str | None = None
    title: str | None = None

    def fits(self, url: Column, title: Column | None = None) -> Column:
        found = holds(urls.host(url), self.host) & holds(urls.path(url), self.path)
        return found if self.title is None else found & holds(clean(F.lit("") if title is None else title), self.title)


def fits_any(shapes: Sequence[Shape], url: Column, title: Column | None = None) -> Column:
    """Whether an address has one of some shapes: job listings, videos, directories, placeholders, indexes."""
    return reduce(lambda a, b: a | b, (s.fits(url, title) for s in shapes), F.lit(False))


def carries_markup(url: Column) -> Column:
    """Whether a parameter of an address is markup given as data."""
    values = F.transform(F.split(F.coalesce(urls.part(url, "QUERY"), F.lit("")), "&"), lambda p: F.trim(F.try_url_decode(F.regexp_extract(p, "=(.*)", 1))))
    return F.exists(values, lambda v: F.coalesce(v.rlike(DATA_MARKUP), F.lit(False)))


def is_notice(url: Column, title: Column, categories: Column, text: Column) -> Column:
    """Whether a row is a death notice, by category, title, path, or its text."""
    by_name = holds(clean(categories), NOTICE_CATEGORY) | holds(clean(title), NOTICE_TITLE)
    return by_name | holds(urls.path(url), NOTICE_PATH) | holds(clean(text), NOTICE_TEXT)


def source_type(url: Column, source: Column, owned: Sequence[str], social: Sequence[str], social_name: str | None = None, own: str = "Owned") -> Column:
    """Owned, Social or News, by domains and by the source's name."""
    named = F.lit(False) if social_name is None else holds(source, social_name)
    host = urls.host(url)
    return F.when(urls.in_domains(host, owned), F.lit(own)).when(urls.in_domains(host, social) | named, F.lit("Social")).otherwise("News")


def outlet(recorded: Column, url: Column, source: Column, aliases: Mapping[str, str], names: Mapping[str, str], search: str = r"(?i)^search\b") -> Column:
    """An outlet's name: as recorded (aliases replaced), by its host, by a source that is no search feed, else its host.

    `aliases` has lower-case keys, `names` hosts without www.; both are small.
    """

    def named(key: Column, table: Mapping[str, str]) -> Column:
        if not table:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)

    kept = blank_to_null(clean(recorded))
    host = urls.host(url)
    source = F.coalesce(source, F.lit(""))
    own = F.when((source != "") & ~source.rlike(search), source)
    bare = blank_to_null(F.regexp_replace(host, r"^(?:amp|m)\.", ""))
    return F.coalesce(named(F.lower(kept), aliases), kept, named(host, names), own, bare, blank_to_null(source), F.lit("Unknown"))


def with_outlets(frame: DataFrame, table: DataFrame, url: Column, other: Column, out: str = "outlet") -> DataFrame:
    """The frame with the outlet of each row's host from a table (host, outlet), of any size; `other` where it has none."""
    known = table.groupBy(F.lower("host").alias("_host")).agg(F.min("outlet").alias("_outlet"))
    joined = frame.withColumn("_key", urls.host(url)).join(known, F.col("_key") == F.col("_host"), "left")
    return joined.withColumn(out, F.coalesce("_outlet", other)).drop("_key", "_host", "_outlet")


@dataclass(frozen=True)
class Region:
    """What makes a text regional: a pattern, or a local source whose page is no syndicated one and names no other region.

    `ambiguous` places are blanked before the other regions are looked for.
    """

    pattern: str
    sources: Sequence[str] = ()
    syndicated: str | None = None
    elsewhere: str | None = None
    ambiguous: str | None = None

    def signal(self, text: Column, source: Column, url: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        bare = F.regexp_replace(text, self.ambiguous, " ") if self.ambiguous else text
        local = F.coalesce(source.isin(*self.sources), F.lit(False)) if self.sources else F.lit(False)
        if self.syndicated:
            local &= ~holds(urls.path(url), self.syndicated)
        if self.elsewhere:
            local &= ~bare.rlike(self.elsewhere)
        return text.rlike(self.pattern) | local


def bare_title(title: Column) -> Column:
    """A title without the publisher that an aggregator adds after a dash."""
    return F.regexp_replace(clean(title), r"\s+-\s+[^-]{2,80}$", "")


def section(category: Column, regional: Column, brand: str, names: Sequence[str], recorded: Column | None = None) -> Column:
    """The reader's section of a row: the brand's, the region's, or the rest, with these three `names`.

    `recorded` tells rows that were put in the region's section by hand.
    """
    by_hand = F.lit(False) if recorded is None else F.coalesce(recorded, F.lit(False))
    return F.when(category == brand, F.lit(names[0])).when(by_hand | F.coalesce(regional, F.lit(False)), F.lit(names[1])).otherwise(names[2])


def names_brand(curated: Column, terms: Column, certain: Sequence[str], text: Column, host: Column, other: str, relation: str, hosts: Sequence[str], place: str) -> Column:
    """Whether an ambiguous brand label means this brand.

    A curated row or a certain label says so; a text that names another bearer of the label, and
    no relation to it, says no; else a host of the region or a place in the text decides.
    """
    sure = F.coalesce(curated, F.lit(False)) | F.arrays_overlap(terms, F.array(*map(F.lit, certain)))
    another = holds(text, other) & ~holds(text, relation)
    return sure | (~another & (F.coalesce(host.isin(*hosts), F.lit(False)) | holds(text, place)))


def access(url: Column, login: Sequence[str], paywalled: Sequence[str], free: Sequence[str]) -> Column:
    """Whether a page may need a login, is likely behind a paywall, is free, or neither is known."""
    host = urls.host(url)
    return (
        F.when(urls.in_domains(host, login), "May require login")
        .when(urls.in_domains(host, paywalled), "Paywall likely")
        .when(urls.in_domains(host, free), "Free to read")
        .otherwise("Access varies")
    )


def has_policy(terms: Column, text: Column, labels: Sequence[str], pattern: str) -> Column:
    """Whether a label or a text speaks of policy."""
    return F.arrays_overlap(terms, F.array(*map(F.lit, labels))) | holds(text, pattern)


def only_minor(terms: Column, brand: Sequence[str], minor: Sequence[str]) -> Column:
    """Whether there are labels besides the brand's, and all of them are minor."""
    rest = F.array_except(terms, F.array(*map(F.lit, brand)))
    return (F.size(rest) > 0) & (F.size(F.array_except(rest, F.array(*map(F.lit, minor)))) == 0)


def refused_by_summary(reason: Column) -> Column:
    """Whether a stored reason already says that a row is none of ours."""
    said = F.lower(clean(reason))
    return F.contains(said, F.lit("false positive")) | (said == "irrelevant")


def refused_by_shape(url: Column, category: Column, brand: str) -> Column:
    """Whether a row is a press release that isn't the brand's."""
    return F.coalesce(url.rlike(r"(?i)/press_releases?/"), F.lit(False)) & (category != brand)


def still_matches(match_source: Column, curated: Column, found: Column) -> Column:
    """Whether a stored row has a reason to be there: its provenance, or rules that match its text now."""
    given = F.coalesce(match_source.isin("searchFallback", "mediaTracker"), F.lit(False)) | F.coalesce(curated, F.lit(False))
    return given | (F.size(found) > 0)


def stays_long(terms: Column, body_only: Column, labels: Sequence[str]) -> Column:
    """Whether a label that more than the body supports keeps a row beyond the usual time."""
    supported = F.array_except(terms, F.coalesce(body_only, F.array().cast("array<string>")))
    return F.arrays_overlap(supported, F.array(*map(F.lit, labels)))


def first_reason(*steps: tuple[Column, str]) -> Column:
    """The text of the first condition that holds, an empty one if none does; null conditions don't."""
    return reduce(lambda out, s: F.when(s[0], F.lit(s[1])).otherwise(out), reversed(steps), F.lit(""))


def scores(relevant: Column, category: Column, kind: Column, brand: str, excluded: Column) -> Column:
    """Whether a row's sentiment is scored: a visible one of the brand, from the press, and none of the excluded."""
    return ~relevant.eqNullSafe(F.lit(False)) & (category == brand) & (kind == "News") & ~F.coalesce(excluded, F.lit(False))


def is_pending(relevant: Column, summary: Column, scored: Column, sentiment: Column, rubric: Column, current: str, rescore: bool = False, rejudge: bool = False) -> Column:
    """Whether a row waits for a summary, a verdict or a score (`scored`: it should have one)."""
    if rejudge:
        return F.lit(True)
    wanting = blank_to_null(sentiment).isNull()
    if rescore:
        wanting |= ~rubric.eqNullSafe(F.lit(current))
    return ~relevant.eqNullSafe(F.lit(False)) & (blank_to_null(summary).isNull() | relevant.isNull() | (scored & wanting))


def fetches_article(mode: Column, allowed: Column, n_brand: Column, n_topics: Column, n_fallback: Column, required: Column) -> Column:
    """Whether a row's page is read: never, always, only without a brand label in the feed, or with any signal."""
    some = (n_brand > 0) | (n_topics > 0) | (n_fallback > 0) | F.coalesce(required, F.lit(False))
    by_mode = F.when(mode == "feedOnly", False).when(mode == "always", True).when(mode == "brandBody", n_brand == 0).otherwise(some)
    return F.coalesce(allowed, F.lit(True)) & by_mode


def fetches_preview(paywalled: Column, allowed: Column, *counts: Column) -> Column:
    """Whether a page behind a paywall gets a preview: it has any signal."""
    some = reduce(lambda a, b: a | b, (n > 0 for n in counts), F.lit(False))
    return F.coalesce(allowed, F.lit(True)) & paywalled & some


def is_groupable(category: Column, kind: Column, brand: str) -> Column:
    """Whether a row may join a story: not the brand's own coverage, its own pages or social posts."""
    return (category != brand) & ~kind.isin("Owned", "Social")


def is_press(relevant: Column, published: Column, kind: Column, url: Column, source: Column, excluded: Sequence[str], excluded_name: str) -> Column:
    """Whether a row is press coverage: visible, dated, news, on no excluded host or source."""
    other = urls.in_domains(urls.host(url), excluded) | holds(source, excluded_name)
    return ~relevant.eqNullSafe(F.lit(False)) & published.isNotNull() & F.coalesce(kind == "News", F.lit(True)) & ~other


def is_urgent(label: Column, score: Column, labels: Sequence[str] = SENTIMENTS[:2], below: int = 35) -> Column:
    """Whether an alert leads: by label, or by a score below the limit."""
    return F.coalesce(F.lower(clean(label)).isin(*labels), F.lit(False)) | F.coalesce(score < below, F.lit(False))


def shown_preview(preview: Column, title: Column, own: Column, found: Column, brand: Sequence[str], is_brand: Column) -> Column:
    """A preview, blank where it belongs to another piece of a roundup: none of the row's labels is found in it."""
    marks = F.array(*map(F.lit, brand))
    related = F.when(is_brand, F.arrays_overlap(found, marks)).otherwise(F.arrays_overlap(found, own))
    return F.when(holds(title, ROUNDUP) & ~related, F.lit("")).otherwise(F.coalesce(preview, F.lit("")))


def decide(probability: Column, keyword: Column, include: float = 0.7, exclude: float = 0.3) -> Column:
    """(decision, relevant, agrees, note): a model's probability where it is sure, else the keywords' verdict."""
    valid = probability.isNotNull() & probability.between(0, 1)

    def settled(decision: str, relevant: Column, agrees: Column, note: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), relevant.alias("relevant"), agrees.alias("agrees"), F.lit(note).alias("note"))

    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(F.coalesce(~valid, yes), settled("keyword", keyword, yes, "no usable answer"))
        .when(probability >= include, settled("include", yes, keyword == yes, ""))
        .when(probability <= exclude, settled("exclude", no, keyword == no, ""))
        .otherwise(settled("keyword", keyword, yes, "uncertain"))
    )


def strongest(scopes: Mapping[str, Column]) -> Column:
    """The highest probability among several scopes, null unless all are probabilities."""
    values = list(scopes.values())
    valid = reduce(lambda a, b: a & b, (v.isNotNull() & v.between(0, 1) for v in values))
    return F.when(valid, F.greatest(*values) if len(values) > 1 else values[0])


def scope_reason(subject: Column, scopes: Mapping[str, Column], least: float = 0.7, refused: str = r"(?i)\b(?:not|no|unrelated|irrelevant)\b") -> Column:
    """A sentence on why a row fits: its subject, unless that speaks against it, and the strongest scope if sure."""
    lead = F.regexp_replace(clean(subject), r"[.\s]+$", "")
    lead = F.when((lead != "") & ~lead.rlike(refused), F.concat(lead, F.lit(".")))
    valid = F.array_compact(F.array(*(F.when(v.between(0, 1), F.struct(v.alias("value"), F.lit(name).alias("name"))) for name, v in scopes.items())))
    best = F.array_max(valid)
    fit = F.when(best["value"] >= least, F.concat(F.lit("Fits "), best["name"], F.lit(" ("), F.floor(best["value"] * 100 + 0.5).cast("string"), F.lit("% confidence).")))
    return first_filled(F.concat_ws(" ", lead, fit), F.lit("Fits the feed's editorial scope."))


def excerpt(*fields: Column, most: int = 1200) -> Column:
    """The first filled field, cleaned and cut."""
    return F.substring(clean(first_filled(*fields)), 1, most)
