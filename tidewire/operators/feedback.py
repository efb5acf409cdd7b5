"""Votes of people on items: reading them, what is in force, what is to be undone, and examples made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import SENTIMENTS, clip

#: Kinds of votes and the shape of an item's id. Fixed values.
VOTES = ("keep", "drop", "sentiment")
ITEM_ID = "^[0-9a-f]{64}$"


def is_vote(item: Column, vote: Column, label: Column, at: Column, labels: Sequence[str] = SENTIMENTS) -> Column:
    """Whether a row is a vote: a known kind on an item, dated, with a label exactly on sentiment."""
    labelled = F.when(vote == "sentiment", F.coalesce(label.isin(*labels), F.lit(False))).otherwise(label.isNull())
    return F.coalesce(item.rlike(ITEM_ID) & vote.isin(*VOTES) & at.isNotNull() & labelled, F.lit(False))


def parse_export(rows: DataFrame, item: str, vote: str, label: str, at: str, labels: Sequence[str] = SENTIMENTS) -> DataFrame:
    """The frame with `valid`: rows that don't validate are told apart, never guessed at."""
    return rows.withColumn("valid", is_vote(F.col(item), F.col(vote), F.col(label), F.col(at), labels))


def export_votes(votes: DataFrame, members: DataFrame, member: str, blocked: str, at: str, tie: str, most: int = 20_000) -> DataFrame:
    """Votes of members who aren't blocked, the newest `most`, without who cast them."""
    allowed = members.where(~F.col(blocked)).select(member)
    return votes.join(allowed, member).orderBy(F.col(at).desc(), F.col(tie).desc()).limit(most).drop(member)


def admin_list(votes: DataFrame, members: DataFrame, member: str, at: str, tie: str, most: int = 5_000) -> DataFrame:
    """The newest `most` votes with their members, newest first and then by item."""
    return votes.join(members, member).orderBy(F.col(at).desc(), tie).limit(most)


def by_vote(rows: DataFrame, vote: str) -> DataFrame:
    """One row: how many votes of each kind; other kinds count nowhere."""
    return rows.agg(*(F.count_if(F.col(vote) == v).alias(v) for v in VOTES))


def per_member(votes: DataFrame, member: str, item: str, most: int) -> DataFrame:
    """(member, n, full): votes of each member, and whether the limit is reached; an item counts once."""
    counted = votes.groupBy(member).agg(F.count_distinct(item).alias("n"))
    return counted.withColumn("full", F.col("n") >= most)


def current_votes(votes: DataFrame, member: str, item: str, at: str, tie: str) -> DataFrame:
    """One vote per member and item: the newest replaces those before it."""
    row = F.struct(*(c for c in votes.columns if c not in (member, item)))
    return votes.groupBy(member, item).agg(F.max_by(row, F.struct(at, tie)).alias("row")).select(member, item, "row.*")


def in_force(state: DataFrame, item: str = "item", inclusion: str = "inclusion", sentiment: str = "sentiment") -> DataFrame:
    """(item, vote, label) that a saved state says are applied: what counts when no fresh votes can be had."""
    kinds = F.array(
        F.when(F.col(inclusion).isNotNull(), F.struct(F.col(inclusion).alias("vote"), F.lit(None).cast("string").alias("label"))),
        F.when(F.col(sentiment).isNotNull(), F.struct(F.lit("sentiment").alias("vote"), F.col(sentiment).alias("label"))),
    )
    return state.select(F.col(item).alias("item"), F.explode(F.array_compact(kinds)).alias("v")).select("item", "v.*")


def settle(items: DataFrame, wanted: DataFrame, had: DataFrame, identity: str, value: str, protected: Column, blocked: Column) -> DataFrame:
    """The items with `value` as votes want it, `baseline` for the next state, and what happened.

    `wanted` has (identity, want), `had` (identity, applied, baseline). A vote that changed or went
    is undone first. A protected item keeps its value, a blocked one can't be kept. `change` is
    applied, reverted, kept, protected, blocked or null; `baseline` is null where no vote is in force.
    """
    joined = items.join(wanted.select(identity, "want"), identity, "left").join(had.select(identity, "applied", "baseline"), identity, "left")
    undone = F.col("applied").isNotNull() & ~F.col("applied").eqNullSafe(F.col("want"))
    before = F.when(undone, F.col("baseline")).otherwise(F.col(value))
    held = F.col("applied").isNotNull() & ~undone
    refused = F.coalesce(protected, F.lit(False)) | (F.coalesce(blocked, F.lit(False)) & F.coalesce(F.col("want"), F.lit(False)))
    takes = F.col("want").isNotNull() & ~refused
    change = (
        F.when(F.col("want").isNotNull() & F.coalesce(protected, F.lit(False)), "protected")
        .when(F.col("want").isNotNull() & refused, "blocked")
        .when(takes & held, "kept")
        .when(takes, "applied")
        .when(undone, "reverted")
    )
    out = [F.when(takes, F.col("want")).otherwise(before).alias(c) if c == value else F.col(c) for c in items.columns]
    base = F.when(takes | held, F.when(held, F.col("baseline")).otherwise(before))
    return joined.select(*out, base.alias("baseline"), (takes | held).alias("in_force"), change.alias("change"))


def bounded_state(state: DataFrame, item: str, at: str, most: int = 5_000) -> DataFrame:
    """The valid entries of a saved state, the newest `most`."""
    return state.where(F.col(item).rlike(ITEM_ID)).orderBy(F.col(at).desc(), item).limit(most)


def as_examples(items: DataFrame, identity: str, url: str, title: str, outlet: Column, excerpt: Column, include: Column, sentiment: Column) -> DataFrame:
    """Votes as examples (id, url, title, outlet, excerpt, context, include, sentiment, provenance) from the archive's texts."""
    return items.select(
        F.col(identity).alias("id"), F.trim(url).alias("url"), clip(F.col(title), 300).alias("title"), clip(outlet, 160).alias("outlet"), clip(excerpt, 700).alias("excerpt"),
        F.lit("").alias("context"), include.alias("include"), sentiment.alias("sentiment"), F.lit("team feedback").alias("provenance"),
    )


def merge_examples(examples: DataFrame, team: DataFrame) -> DataFrame:
    """The library with the team's examples: a drop replaces what is there, anything else refines it, new ones join."""
    usable = team.where(F.col("url").rlike("(?i)^https?://") & (F.col("title") != ""))
    joined = examples.alias("e").join(usable.alias("t"), F.col("e.id") == F.col("t.id"), "full_outer")
    old, new = F.col("e.id").isNotNull(), F.col("t.id").isNotNull()
    replaces = new & (~old | ~F.col("t.include"))

    def own(name: str) -> Column:
        if name == "include":
            return F.when(new, F.col("t.include")).otherwise(F.col("e.include"))
        if name == "sentiment":
            return F.when(replaces, F.col("t.sentiment")).otherwise(F.coalesce("t.sentiment", "e.sentiment"))
        if name == "provenance":
            return F.when(replaces, F.col("t.provenance")).when(new, F.concat("e.provenance", F.lit(" + team feedback"))).otherwise(F.col("e.provenance"))
        return F.when(replaces, F.col(f"t.{name}")).otherwise(F.col(f"e.{name}"))

    return joined.select(*(own(c).alias(c) for c in examples.columns))


def saved_searches(saved: DataFrame, owner: str, name: str, place: str, most: int = 20) -> DataFrame:
    """Saved searches by owner: names that differ in case alone are one, at its first place with its last content; `most` an owner."""
    key = F.lower(F.trim(name))
    row = F.struct(*(c for c in saved.columns if c not in (owner, place)))
    one = saved.where(F.trim(name) != "").groupBy(owner, key.alias("_key")).agg(F.min(place).alias(place), F.max_by(row, place).alias("row"))
    rank = F.row_number().over(W.partitionBy(owner).orderBy(place))
    return one.withColumn("_rank", rank).where(F.col("_rank") <= most).select(owner, place, "row.*")
