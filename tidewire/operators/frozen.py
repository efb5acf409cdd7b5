"""Text that is kept as it was first seen, links as they are best shown, odds and contexts made valid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.functions.text import blank_to_null, clean, clip

#: Fields that are frozen, and how much of each; and the sources of examples whose title is the archive's too. Fixed values.
LIMITS = {"excerpt": 700, "outlet": 160, "title": 300}
ARCHIVE_TITLES = ("human label review", "team feedback")
#: Shape of an example's id, and how many are kept. Fixed values.
EXAMPLE_ID, EXAMPLES = "^[a-f0-9]{64}$", 5000


def valid_texts(state: DataFrame, place: str, most: int | None = EXAMPLES) -> DataFrame:
    """Saved texts by id: valid ids with some text, texts cleaned and cut, blanks as null; the first `most` by place, or all."""
    cut = state.select("id", place, *(blank_to_null(clip(F.col(f), n)).alias(f) for f, n in LIMITS.items()))
    valid = cut.where(F.col("id").rlike(EXAMPLE_ID) & F.coalesce(*LIMITS).isNotNull())
    return (valid if most is None else valid.orderBy(place, "id").limit(most)).drop(place)


def freeze(examples: DataFrame, state: DataFrame, place: str, most: int | None = EXAMPLES) -> tuple[DataFrame, DataFrame]:
    """Examples with the texts that were first seen of them, and the texts to keep from now on.

    A text is kept when it is first not blank, and never changed; titles only of examples whose
    titles come from the archive. Examples tell `added`, `changed` (another text now) and
    `lost` (none now). New ids come in order of `place` while there is room for `most`. Rows without
    a valid id stay as they are; ids are distinct.
    """
    kept = state.select(F.col("id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in LIMITS))
    joined = examples.join(kept, F.col("id") == F.col("_id"), "left").withColumn("_valid", F.coalesce(F.col("id").rlike(EXAMPLE_ID), F.lit(False)))
    freezes = {f: F.col("_valid") & (F.lit(True) if f != "title" else F.coalesce(F.col("provenance").isin(*ARCHIVE_TITLES), F.lit(False))) for f in LIMITS}
    live = {f: F.when(freezes[f], blank_to_null(clip(F.coalesce(f, F.lit("")), n))) for f, n in LIMITS.items()}
    joined = joined.withColumns({f"_live_{f}": live[f] for f in LIMITS})
    fresh = joined.where(F.col("_id").isNull() & F.coalesce(*(f"_live_{f}" for f in LIMITS)).isNotNull())
    admitted = fresh if most is None else fresh.orderBy(place, "id").limit(max(0, most - state.count()))
    admitted = admitted.select(F.col("id").alias("_new"))
    told = joined.join(admitted, F.col("id") == F.col("_new"), "left").withColumn("_open", F.col("_id").isNotNull() | F.col("_new").isNotNull())
    new = {f: F.when(F.col(f"_{f}").isNull() & F.col("_open"), F.col(f"_live_{f}")) for f in LIMITS}
    had = {f: freezes[f] & F.col(f"_{f}").isNotNull() for f in LIMITS}
    some = lambda flags: F.coalesce(F.greatest(*(F.coalesce(x, F.lit(False)) for x in flags)), F.lit(False))
    out = told.select(
        *(F.when(had[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in LIMITS else F.col(c) for c in examples.columns),
        some(x.isNotNull() for x in new.values()).alias("added"), some(had[f] & (F.col(f"_live_{f}") != F.col(f"_{f}")) for f in LIMITS).alias("changed"), some(had[f] & F.col(f"_live_{f}").isNull() for f in LIMITS).alias("lost"),
    )
    given = told.where("_open").select("id", *(new[f].alias(f"_new_{f}") for f in LIMITS))
    both = state.join(given, "id", "full_outer").select("id", *(F.coalesce(f, f"_new_{f}").alias(f) for f in LIMITS))
    return out, both


def shown_link(primary: Column, fallback: Column) -> Column:
    """The one of two links of a story that is better shown: without tracking, then without a fragment; the first on a tie."""
    worth = lambda link: F.when(urls.is_tracked(link), 0).otherwise(2) + F.when(urls.has_fragment(link), 0).otherwise(1)
    one, two = (F.coalesce(x, F.lit("")) for x in (primary, fallback))
    return F.when(worth(two) > worth(one), fallback).otherwise(primary)


def is_discovery(source: Column, feed: Column, name: str, host: str) -> Column:
    """Whether a row comes from an aggregator: by its source's name, or its feed's host."""
    return F.coalesce(source.rlike(rf"(?i)^{name}\b"), F.lit(False)) | F.coalesce(urls.host(feed) == host, F.lit(False))


def signals(odds: Mapping[str, Column]) -> Column:
    """Named odds from 0 to 1 in a struct, others null; null if none is left."""
    valid = {name: F.when(x.between(0, 1), x) for name, x in odds.items()}
    return F.when(F.coalesce(*valid.values()).isNotNull(), F.struct(*(x.alias(name) for name, x in valid.items())))


def contexts(json: Column) -> Column:
    """Storylines of a document, (name, note, match) each: those with a name, a note and a term to match, terms in lower case."""
    raw = F.from_json(json, "struct<storylines: array<struct<name: string, note: string, match: array<string>>>>")["storylines"]
    terms = lambda e: F.filter(F.transform(F.coalesce(e["match"], F.array().cast("array<string>")), lambda t: F.trim(F.lower(F.coalesce(t, F.lit(""))))), lambda t: t != "")
    made = F.transform(F.coalesce(raw, F.array().cast("array<struct<name: string, note: string, match: array<string>>>")), lambda e: F.struct(clean(e["name"]).alias("name"), clean(e["note"]).alias("note"), terms(e).alias("match")))
    return F.filter(made, lambda e: (e["name"] != "") & (e["note"] != "") & (F.size(e["match"]) > 0))


def context_of(text: Column, storylines: Sequence[tuple[str, str, Sequence[str]]], most: int = 3) -> Column:
    """Notes on the storylines that a text names, the first `most`, one a line."""
    low = F.lower(F.coalesce(text, F.lit("")))
    notes = [F.when(F.greatest(*(F.contains(low, F.lit(t)) for t in match), F.lit(False)), F.lit(f"{name}: {note}")) for name, note, match in storylines]
    return F.array_join(F.slice(F.array_compact(F.array(*notes)), 1, most), "\n")
