"""Whose words a text gives: names beside language of attribution, checked against who held which role when.

A name alone is no quote. Patterns are matched on the text in which the brand's own names are
made one neutral word, so that only other organizations are left to look like some.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import clean

#: Verbs of saying, words between them and a name, titles of others, abbreviations that end no sentence. Fixed values.
VERBS = (
    "said says told tells wrote writes stated states added adds explained explains noted notes described describes emphasized acknowledged argued testified according\\s+to"
).split()
FILLERS = "the a an of and insurer['’]?s? president ceo chief financial executive medical operating officer vice spokes\\w+ dr\\.?".split()
OTHER_TITLES = (
    "mayor sen\\.? senator rep\\.? representative gov\\.? governor commissioner treasurer secretary judge sheriff superintendent principal coach professor "
    "chairman chairwoman chair auditor speaker"
).split()
ABBREVIATIONS = "Dr Mr Ms Mrs St Sen Rep Gov Vt Inc Co Jr Sr U\\.S".split()
AFTER_NAME = "was is has had will would could should did does joined took became and may".split()
#: What the brand's names become.
BRAND = "brandname"


def _any(words: Sequence[str]) -> str:
    return f"(?:{'|'.join(words)})"


#: Another organization: a preposition before a capital. Fixed value.
OTHER = r"\b(?:of|at|with|from|for)\s+(?:the\s+)?[A-Z]"
#: Who speaks for others. Fixed value.
SPOKES = r"(?i:\bspokes(?:person|woman|man)\b)"
#: A character of the sentence that names no other organization.
STEP = rf"(?:(?!{OTHER})(?:\b{_any(ABBREVIATIONS)}\.|[^;.!?]))"
SAYS = rf"(?i:(?:(?:also|later|then|recently)\s+)?{_any(VERBS)}\b)"
FILLER = rf"(?i:(?:{_any([*FILLERS, BRAND])}\s+){{0,10}})"
#: The clauses by which words are attributed to a name, what they are and on which side of it they stand. Bounds and words are fixed values.
CLAUSES = (
    ("after", "a verb of saying", rf"['’]?\s+{SAYS}"),
    ("after", "a clause and a verb", rf",\s*{STEP}{{0,160}}?,\s*{SAYS}"),
    ("after", "speaking for somebody", rf",\s*{STEP}{{0,60}}?{SPOKES}(?![^.;]{{0,80}}?{OTHER})"),
    ("after", "a colon and a quotation", r"\s*:\s*[\"“]"),
    ("before", "a title of a speaker", rf"{SPOKES}\s+"),
    ("before", "a speaker for somebody", rf"{SPOKES}\s+(?:for|at|of)\s+[^,.]{{1,60}},\s*"),
    ("before", "according to", rf"(?i:\baccording\s+to\s+){FILLER}"),
    ("before", "a quotation and a verb", rf"[”\"’',]\s*(?i:said|says|wrote)\s+{FILLER}(?=[^,.;]{{1,60}}?(?:[,.;]|$))"),
    ("before", "the end of a quotation", r"[^\s(\[“\"'][”\"’]\s*[,—–-]?\s*"),
    ("before", "a dash", r"[—–]\s*"),
)
FOLLOWS, LEADS = (f"(?:{'|'.join(p for own, _, p in CLAUSES if own == side)})" for side in ("after", "before"))
#: The rest of the sentence names no other organization.
PURE = rf"(?!(?:\b{_any(ABBREVIATIONS)}\.|[^.!?]){{0,100}}?{OTHER})"
#: No title of others stands before.
PLAIN = rf"(?<!\b(?i:{_any(OTHER_TITLES)})\s)"


def neutral(text: Column, brand: str | None) -> Column:
    """A cleaned text with the brand's names as one word."""
    return clean(text) if brand is None else F.regexp_replace(clean(text), brand, BRAND)


def pattern(name: Column) -> Column:
    """The pattern of a name as it stands in texts."""
    escaped = F.regexp_replace(F.trim(name), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?i:"), F.regexp_replace(escaped, r"\s+", r"\\s+"), F.lit(r")(?![\p{L}\p{N}])"))


def attributed(name: Column, guard: str = "") -> Column:
    """The pattern of a name (a pattern itself) to which words are attributed, by what follows or by what leads to it."""
    moves = rf"(?!\s+(?i:{_any(AFTER_NAME)})\b)"
    return F.concat(F.lit(rf"(?:{PLAIN}{guard}"), name, F.lit(FOLLOWS + "|" + LEADS + guard), name, F.lit(moves + PURE + ")"))


def is_quoted(text: Column, names: Column, surnames: Column) -> Column:
    """Whether a neutral text attributes words to a person: to a full name, or to a surname after a full name came up.

    A surname after another first name is somebody else's.
    """
    whole = F.exists(names, lambda n: F.regexp_like(text, attributed(pattern(n))))
    alone = r"(?<![A-Z][a-z]{1,20}\s)"
    # A surname counts as it is written: its pattern knows no other case.
    bare = lambda s: F.replace(pattern(s), F.lit("(?i:"), F.lit("(?:"))
    later = F.exists(names, lambda n: F.exists(surnames, lambda s: F.regexp_like(text, F.concat(pattern(n), F.lit(r"(?s:.*)"), attributed(bare(s), alone)))))
    return whole | later


def active(day: Column, since: Column, until: Column) -> Column:
    """Whether a role was held on a day; a role with bounds fits no undated text."""
    return (since.isNull() | F.coalesce(day >= since, F.lit(False))) & (until.isNull() | F.coalesce(day <= until, F.lit(False)))


def quoted_people(frame: DataFrame, people: DataFrame, key: str, texts: Sequence[str], at: str, brand: str | None = None, stored: str | None = None) -> DataFrame:
    """(key, name, title): people to whom one of a row's texts attributes words, or who are `stored` there, in a role held then.

    `people` has name, aliases (array), title, since and until (dates or null). It is a newsroom's
    list by contract; rows meet it on names that their texts hold, and only such pairs are matched.
    """
    none = F.array().cast("array<string>")
    hay = F.array(*(neutral(F.coalesce(F.col(t), F.lit("")), brand) for t in texts))
    kept = F.coalesce(F.col(stored), none) if stored else none
    rows = frame.select(F.col(key).alias("key"), hay.alias("texts"), kept.alias("stored"), F.to_date(F.col(at)).alias("day"))
    names = F.array_union(F.array("name"), F.coalesce("aliases", none))
    known = people.where(F.trim("name") != "").withColumn("names", names)
    last = F.transform("names", lambda n: F.element_at(F.split(F.trim(n), r"\s+"), -1))
    known = known.withColumn("surnames", F.array_distinct(F.filter(last, lambda s: F.length(s) > 3)))
    held = F.exists("texts", lambda t: F.exists("names", lambda n: F.contains(F.lower(t), F.lower(F.trim(n)))))
    # A small file is one task's, which matching keeps long: rows are spread first.
    spread = rows.repartition("key", "texts")
    quoted = F.exists("texts", lambda t: is_quoted(t, F.col("names"), F.col("surnames")))
    # Patterns are matched within the same condition, or the optimizer puts them before the names and matches all pairs.
    told = F.array_contains("stored", F.col("name")) | F.when(held, quoted).otherwise(False)
    found = spread.join(F.broadcast(known), active(F.col("day"), F.col("since"), F.col("until")) & told)
    return found.select(F.col("key").alias(key), "name", "title").distinct()


def titles(found: DataFrame) -> DataFrame:
    """(name, title) of everybody quoted, each once."""
    return found.groupBy("name").agg(F.min("title").alias("title"))
