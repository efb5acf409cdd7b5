"""Tagging texts by tables of rules, and the verdicts that follow from labels.

Rules are data. They compile to one Column each, so a scan tags its rows in the same
stage that reads them; only storylines, which come as a table, are a (broadcast) join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import snippet

#: Characters after a match that a rejecting pattern looks at too.
AFTER = 40


@dataclass(frozen=True)
class Term:
    """A label, the pattern that gives it, and patterns that take it back.

    A first match that `reject` finds in itself or the characters after it gives no label,
    unless `unless` finds something in the whole text. `strip` is blanked before matching.
    """

    label: str
    pattern: str
    reject: str | None = None
    unless: str | None = None
    strip: str | None = None

    def subject(self, text: Column) -> Column:
        return F.regexp_replace(text, self.strip, " ") if self.strip else text

    def accepted(self, text: Column) -> Column:
        """Whether the first match counts; later matches are not looked at."""
        subject = self.subject(text)
        found = subject.rlike(self.pattern)
        if self.reject:
            at = F.regexp_instr(subject, F.lit(self.pattern))
            length = F.length(F.regexp_extract(subject, self.pattern, 0))
            refused = F.substring(subject, at, length + AFTER).rlike(self.reject)
            if self.unless:
                refused &= ~text.rlike(self.unless)
            found &= ~refused
        return F.coalesce(found, F.lit(False))

    def place(self, text: Column) -> Column:
        """Where the accepted match begins, from 0; null without one."""
        return F.when(self.accepted(text), F.regexp_instr(self.subject(text), F.lit(self.pattern)) - 1)


def labels(text: Column, terms: Sequence[Term], aliases: Mapping[str, str] | None = None) -> Column:
    """Labels of accepted terms in the terms' order, aliases replaced, each once."""
    if not terms:
        return F.array().cast("array<string>")
    found = F.array_compact(F.array(*(F.when(t.accepted(text), F.lit(t.label)) for t in terms)))
    return canonical(found, aliases or {})


def canonical(found: Column, aliases: Mapping[str, str]) -> Column:
    """Labels with aliases replaced, each once, in their order."""
    if aliases:
        names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
        found = F.transform(found, lambda x: F.coalesce(F.try_element_at(names, x), x))
    return F.array_distinct(found)


def first_place(text: Column, terms: Sequence[Term]) -> Column:
    """Where the first accepted match of any term begins; null without one."""
    places = F.array(*(t.place(text) for t in terms)) if terms else F.array().cast("array<int>")
    return F.array_min(F.array_compact(places))


def tag(
    frame: DataFrame, text_col: str, terms: Sequence[Term], aliases: Mapping[str, str] | None = None, out: str = "labels", snippet_col: str | None = None
) -> DataFrame:
    """The frame with the labels of its texts, and a snippet around the first match if asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    frame = frame.withColumn(out, labels(text, terms, aliases))
    return frame.withColumn(snippet_col, snippet(text, first_place(text, terms))) if snippet_col else frame


def category(found: Column, brand: Sequence[str], yes: str = "brand", no: str = "topic") -> Column:
    """Whether any label is one of the brand's."""
    return F.when(F.arrays_overlap(found, F.array(*map(F.lit, brand))), F.lit(yes)).otherwise(F.lit(no))


def without_body_only(found: Column, body_only: Column) -> Column:
    """Labels that more than the article's body supports."""
    return F.array_except(found, F.coalesce(body_only, F.array().cast("array<string>")))


def merge_body_only(left: Column, right: Column, supported: Column) -> Column:
    """Labels that only bodies support in either copy, without those that a copy supports otherwise."""
    return F.array_except(F.array_union(left, right), supported)


@dataclass(frozen=True)
class Verdict:
    """One step of a cascade: where the condition holds, relevance and reason are settled."""

    condition: Column
    relevant: bool | None
    reason: str


def cascade(steps: Sequence[Verdict], relevant: bool | None = None, reason: str = "") -> Column:
    """(relevant, reason) of the first step whose condition holds; null conditions don't.

    `relevant` is null where nothing was judged, which is visible: see `visible`.
    """
    schema = "struct<relevant:boolean,reason:string>"

    def settled(value: bool | None, why: str) -> Column:
        return F.struct(F.lit(value).cast("boolean").alias("relevant"), F.lit(why).alias("reason")).cast(schema)

    return reduce(lambda out, s: F.when(s.condition, settled(s.relevant, s.reason)).otherwise(out), reversed(steps), settled(relevant, reason))


def visible(relevant: Column) -> Column:
    """Rows without a verdict are shown: only false hides."""
    return ~relevant.eqNullSafe(F.lit(False))


def by_probability(relevant: Column, probability: Column, include: float = 0.7, exclude: float = 0.3) -> Column:
    """A verdict that a model's probability overrules where it is sure."""
    return F.when(probability >= include, F.lit(True)).when(probability <= exclude, F.lit(False)).otherwise(relevant)


def storylines(definitions: DataFrame) -> DataFrame:
    """Valid definitions: (id, name, match, exclude, start, position), lower-cased, the first of each id.

    `definitions` has id, name, match, exclude (arrays), start (yyyy-MM-dd or null) and position.
    """

    def lowered(name: str) -> Column:
        parts = F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.trim(F.lower(x)))
        return F.filter(parts, lambda x: x != "")

    valid = definitions.select(
        F.trim("id").alias("id"), "name", lowered("match").alias("match"), lowered("exclude").alias("exclude"), F.try_to_date("start", "yyyy-MM-dd").alias("start"), "position"
    ).where("id <> '' AND size(match) > 0")
    first = valid.groupBy("id").agg(F.min("position").alias("position"))
    return valid.join(first, ["id", "position"], "left_semi")


def match_storylines(frame: DataFrame, definitions: DataFrame, key: str, texts: Sequence[str], at: str | None = None) -> DataFrame:
    """(key, storylines): ids of the storylines of each row, in the definitions' order.

    A row belongs to a storyline if its texts hold one of the matches and none of the
    exclusions, and it isn't dated before the start; undated rows belong to those without
    a start only. The definitions are a small table by contract and are sent to every task.
    """
    hay = F.lower(F.concat_ws(" ", *texts))
    day = F.to_date(F.col(at)) if at else F.lit(None).cast("date")
    rows = frame.select(F.col(key).alias("key"), hay.alias("hay"), day.alias("day"))
    known = F.broadcast(storylines(definitions))
    meets = (
        F.exists("match", lambda m: F.contains(F.col("hay"), m))
        & ~F.exists("exclude", lambda m: F.contains(F.col("hay"), m))
        & (F.col("start").isNull() | F.coalesce(F.col("day") >= F.col("start"), F.lit(False)))
    )
    found = rows.join(known, meets).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("position", "id"))).alias("found"))
    return found.select(F.col("key").alias(key), F.transform("found", lambda x: x["id"]).alias("storylines"))
