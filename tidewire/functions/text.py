"""Text functions as Column expressions. None of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No-break space, which counts as white space in cleaned text.
NBSP = "\u00a0"


def blank_to_null(text: Column) -> Column:
    """Null instead of an empty text, so that `coalesce` passes over it."""
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else an empty one."""
    return F.coalesce(*map(blank_to_null, texts), F.lit(""))


def clean(text: Column) -> Column:
    """Runs of white space, no-break ones too, become one space; none at the ends. Null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\s{NBSP}]+", " "))


def truncate(text: Column, most: int, mark: str = "…") -> Column:
    """The text, or its first characters and a mark, `most` in all."""
    cut = F.concat(F.rtrim(F.substring(text, 1, most - len(mark))), F.lit(mark))
    return F.when(F.length(text) > most, cut).otherwise(text)


def preview(text: Column, most: int = 600, promotions: Sequence[str] = ()) -> Column:
    """Cleaned text without `promotions` (patterns), cut after a word and marked with dots."""
    out = text
    for pattern in promotions:
        out = F.regexp_replace(out, pattern, " ")
    out = clean(out)
    head = F.regexp_replace(F.substring(out, 1, most), r"\s+\S*$", "")
    return F.when(F.length(out) > most, F.concat(head, F.lit("..."))).otherwise(out)


def clip(text: Column, most: int) -> Column:
    """The first `most` characters of the cleaned text."""
    return F.substring(clean(text), 1, most)


def snippet(text: Column, at: Column, before: int = 180, after: int = 260, fallback: int = 320) -> Column:
    """What stands around place `at` (from 0), with dots where it was cut; without a place the beginning."""
    start = F.greatest(at - before, F.lit(0))
    end = F.least(at + after, F.length(text))
    body = F.trim(F.substring(text, start + 1, end - start))
    around = F.concat(
        F.when(start > 0, F.lit("... ")).otherwise(""), body, F.when(end < F.length(text), F.lit(" ...")).otherwise("")
    )
    return F.when(at.isNull() | (at < 0), F.trim(F.substring(text, 1, fallback))).otherwise(around)


def escape_xml(text: Column) -> Column:
    """The five characters with a meaning in XML as entities. Null is empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def cdata(text: Column) -> Column:
    """The text as CDATA; an end mark within it is split over two sections."""
    inner = F.replace(F.coalesce(text, F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA["), inner, F.lit("]]>"))


def escape_ics(text: Column) -> Column:
    """Text value of an iCalendar property."""
    out = F.coalesce(text, F.lit(""))
    for plain, escaped in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def csv_field(value: Column) -> Column:
    """A quoted CSV field; what a spreadsheet would read as a formula gets an apostrophe first."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    guarded = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


#: What `mask_personal` masks, in this order, and with what.
MASKS = (
    (r"(https?://[^/\s]+)/\S+", "$1/…"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"[A-Za-z0-9_-]{32,}", "[token]"),
)


def mask_personal(text: Column) -> Column:
    """Text without paths of addresses, mail addresses and long tokens."""
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def email(address: Column) -> Column:
    """A mail address in lower case, null where it is none."""
    found = F.lower(F.trim(address))
    return F.when(found.rlike(r"^[^\s@,;<>]+@[^\s@,;<>]+\.[a-z]{2,}$") & (F.length(found) <= 254), found)


def mask_email(address: Column) -> Column:
    """The first letter and the domain of a mail address."""
    return F.regexp_replace(address, r"^(.)[^@]*@", "$1***@")


def hash_address(secret: str, address: Column) -> Column:
    """Salted digest of an address, 16 bytes in hex."""
    return F.substring(F.sha2(F.concat(F.lit(secret + ":"), address), 256), 1, 32)


def url_safe_digest(text: Column, length: int) -> Column:
    """The beginning of a SHA-256 in the base64 alphabet for addresses."""
    encoded = F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/=", "-_")
    return F.substring(encoded, 1, length)


def numbers(text: Column) -> Column:
    """All numbers of a text as doubles, without their commas."""
    found = F.regexp_extract_all(text, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def claims_supported(answer: Column, given: Column) -> Column:
    """Whether every number of an answer also stands in the text that it was made from."""
    known = numbers(given)
    return F.forall(numbers(answer), lambda n: F.array_contains(known, n))


def whole_number(text: Column, default: int, least: int = 0) -> Column:
    """The number at a text's beginning, or the default if there is none or it is too small."""
    found = F.regexp_extract(F.trim(text), r"^\+?(\d+)", 1).try_cast("bigint")
    return F.when(found >= least, found).otherwise(F.lit(default))


def json_array(text: Column) -> Column:
    """From the first opening to the last closing bracket of a text, null without them."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    return blank_to_null(F.regexp_extract(bare, r"(?s)(\[.*\])", 1))


#: Labels from worst to best; their values go from -2 to 2, their anchors from 0 to 100. Fixed values.
SENTIMENTS = ("negative", "neutral to negative", "neutral", "neutral to positive", "positive")


def sentiment(text: Column) -> Column:
    """The label that a text begins with, the longest one; null where it names none.

    What follows a hyphen or a bracket is a remark. Two usual slips of the pen are read as meant.
    """
    bare = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s)[\s{NBSP}]*[-(].*$", "")))
    bare = F.replace(F.replace(bare, F.lit("postive"), F.lit("positive")), F.lit("neuttral"), F.lit("neutral"))
    named = [F.when(F.startswith(bare, F.lit(label)), F.lit(label)) for label in sorted(SENTIMENTS, key=len, reverse=True)]
    return F.coalesce(*named)


def sentiment_score(probabilities: Column) -> Column:
    """Scale point, 0 to 100, of the five labels' probabilities: half up, null unless they sum to 1."""
    found = [F.coalesce(F.get(probabilities, F.lit(i)), F.lit(-1.0)) for i in range(5)]
    place = sum(((p * w) for p, w in zip(found, (-2, -1, 0, 1, 2), strict=True)), F.lit(0.0))
    total = sum(found, F.lit(0.0))
    valid = (F.abs(total - 1) <= 0.001) & (F.least(*found) >= 0)
    return F.when(valid, half_up(50 + 25 * place).cast("int"))


def half_up(x: Column) -> Column:
    """The nearest integer; halves go up, negative ones too."""
    return F.floor(x + 0.5)


def percent_change(value: Column, prior: Column) -> Column:
    """Change in whole percent of a prior value; null where that isn't positive."""
    return F.when(prior > 0, half_up(100.0 * (value - prior) / prior))


def signed(value: Column) -> Column:
    """A net value with its sign and two decimals; n/a for null."""
    return F.when(value.isNull(), F.lit("n/a")).otherwise(F.format_string("%+.2f", value))


def title_words(text: Column, longer: int = 0, stop: Sequence[str] = ()) -> Column:
    """Distinct lower-case words of letters and digits, longer than `longer`, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), F.lit(1)))
    return F.filter(found, lambda w: (F.length(w) > longer) & ~w.isin(*stop) if stop else F.length(w) > longer)


def overlap(left: Column, right: Column) -> Column:
    """Overlap coefficient of two arrays of words."""
    return F.size(F.array_intersect(left, right)) / F.greatest(F.lit(1), F.least(F.size(left), F.size(right)))


def without_outlet(title: Column, outlet: Column, aggregated: Column | None = None) -> Column:
    """A title without the outlet's name at its end.

    The ending after the last dash goes if it equals the outlet by letters and digits, or
    the title comes from an aggregator; endings with digits stay, for they tell parts of a
    series apart.
    """
    ending = F.regexp_extract(title, r"\s[-–—|]\s([^-–—|]+)$", 1)

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")

    same = F.trim(bare(ending)) == F.trim(bare(F.coalesce(outlet, F.lit(""))))
    goes = (ending != "") & ~ending.rlike(r"\d") & (same | (F.lit(False) if aggregated is None else aggregated))
    return F.when(goes, F.regexp_replace(title, r"\s[-–—|]\s[^-–—|]+$", "")).otherwise(title)


def title_key(title: Column) -> Column:
    """What equal titles have in common: lower-case letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


#: Endings that `stem` takes off. Fixed value.
ENDINGS = r"(ments?|ees?|ing|ed|ers?|ies|es|s)$"


def stem(word: Column) -> Column:
    """A word without one usual ending, and then without a doubled last letter; numbers and words of four letters stay."""
    bare = F.regexp_replace(word, ENDINGS, "")
    return F.when((F.length(word) > 4) & ~word.rlike(r"^\d"), F.regexp_replace(bare, r"(.)\1$", "$1")).otherwise(word)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that it names more than once: the value is computed one time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rewritten(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """The text with each match of a pattern rewritten by itself."""

    def joined(x: Column) -> Column:
        told = F.transform(F.regexp_extract_all(x, F.lit(f"({pattern})"), F.lit(1)), rewrite)
        between = F.split(x, pattern, -1)
        return once(told, lambda t: F.array_join(F.transform(between, lambda y, i: F.concat(y, F.coalesce(F.get(t, i), F.lit("")))), ""))

    return once(text, joined)


def _whole(unit: int, found: Column) -> Column:
    value = F.floor(F.regexp_extract(found, r"^[\d.]+", 0).cast("double") * unit + 0.5)
    return F.when(F.length(F.regexp_extract(found, r"^\d+", 0)) <= 15, value.cast("string")).otherwise(found)


def plain_numbers(text: Column) -> Column:
    """Numbers written alike: no commas, "760k" and "760 thousand" as 760000, likewise millions and billions.

    Fractions count whole, and round to the nearest integer. Numbers of more than 15 digits stay as they are.
    """
    out = F.regexp_replace(text, r"(?<=\d),(?=\d{3}\b)", "")
    for names, unit in (("k|thousand", 10**3), ("m|million", 10**6), ("b|billion", 10**9)):
        out = rewritten(out, rf"(?i)\b\d+(?:\.\d+)?\s*(?:{names})\b", partial(_whole, unit))
    return out


#: Words that tell stories apart too little. Fixed values.
STOP_WORDS = (
    "a about after again against all also am an and any are as at be because been before being between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its just may me more most much must my new no nor not now of off on once only or other our out "
    "over own per said same says she should so some such than that the their them then there these they this those through to too under until up us very was we were what when "
    "where which while who whom why will with would you your amid plans plan set sets expected report reports reportedly according announce announces announced latest week today "
    "year years news"
).split()
#: Names that are written in several ways, and one word for each. Fixed values.
PHRASES = (
    (r"\baffordable care act\b", " aca "),
    (r"\bobamacare\b", " aca "),
    (r"\bhealthcare\.gov\b", " aca "),
    (r"\bcenters for medicare (?:and|&) medicaid services\b", " cms "),
    (r"\bhealth and human services\b", " hhs "),
    (r"\bblue cross (?:and|&) blue shield\b", " bcbs "),
    (r"\bu\.s\.(?=\s|$)", " us "),
)


def story_terms(text: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """Terms of a text, repeats included: phrases and numbers written alike, no stop words, stemmed."""
    lowered = F.lower(clean(text))
    for pattern, word in phrases:
        lowered = F.regexp_replace(lowered, pattern, word)
    lowered = F.regexp_replace(plain_numbers(lowered), "['’]s\\b", "")
    found = F.regexp_extract_all(lowered, F.lit(r"([a-z0-9]{2,})"), F.lit(1))
    return F.filter(F.transform(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)), stem), lambda w: F.length(w) > 1)
