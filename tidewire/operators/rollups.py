"""Calendar rollups: counts over dense months and weeks, shares, tops, and what changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.functions.text import SENTIMENTS, blank_to_null, percent_change


def share_of_voice(frame: DataFrame, month: Column, entities: Column, known: Sequence[str], start: str | None = None) -> DataFrame:
    """(month, entity, mentions, total, share) for every month and known entity.

    A row counts once for each of its entities. Months are dense from the first to the
    last one with a row, from `start` on if given. The share is of all entities' mentions of
    the month, null where there are none.
    """
    rows = frame.select(month.alias("month"), F.explode(F.array_distinct(entities)).alias("entity"))
    rows = rows.where(F.col("month").isNotNull() & F.col("entity").isin(*known))
    if start:
        rows = rows.where(F.col("month") >= start)
    counted = rows.groupBy("month").pivot("entity", list(known)).count()
    bounds = counted.agg(F.min("month").alias("low"), F.max("month").alias("high"))
    dense = dates.months(bounds, "low", "high").join(counted, "month", "left")
    total = sum((F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in known), F.lit(0))
    pairs = F.array(*(F.struct(F.lit(k).alias("entity"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).cast("long").alias("mentions")) for k in known))
    flat = dense.select("month", total.cast("long").alias("total"), F.explode(pairs).alias("x"))
    return flat.select("month", "x.entity", "x.mentions", "total", (F.col("x.mentions") / F.nullif("total", F.lit(0))).alias("share"))


def totals(shares: DataFrame) -> DataFrame:
    """(entity, mentions, share) over all months of `share_of_voice`."""
    sums = shares.groupBy("entity").agg(F.sum("mentions").alias("mentions"))
    everything = F.sum("mentions").over(W.partitionBy())
    return sums.withColumn("share", F.col("mentions") / F.nullif(everything, F.lit(0)))


def weekly(frame: DataFrame, group: str, at: str, label: Column, scale: Sequence[str], now: Column) -> DataFrame:
    """(group, week, n, scored, net, a count per label) for each group's weeks, Mondays of UTC.

    Weeks are dense from a group's first to the current or its last one, whichever is
    later. `scored` counts rows whose label is on the scale, `net` is their mean place on
    it, the middle being 0; undated rows count nowhere.
    """
    place = F.array_position(F.array(*map(F.lit, scale)), label) - (len(scale) + 1) // 2
    on_scale = label.isin(*scale)
    counted = (
        frame.where(F.col(at).isNotNull())
        .groupBy(F.col(group).alias("group"), dates.week_start(F.col(at)).alias("week"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(on_scale).alias("scored"),
            F.sum(F.when(on_scale, place)).alias("net_sum"),
            *(F.count_if(label == x).alias(f"n_{x}") for x in scale),
        )
    )
    last = F.greatest(F.max("week"), dates.week_start(now))
    spine = counted.groupBy("group").agg(F.min("week").alias("low"), last.alias("high"))
    days = F.explode(F.sequence("low", "high", F.expr("interval 7 days")))
    dense = spine.select("group", days.alias("week")).join(counted, ["group", "week"], "left")
    counts = ["n", "scored", *(f"n_{x}" for x in scale)]
    return dense.select(
        F.col("group").alias(group), "week", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), (F.col("net_sum") / F.nullif("scored", F.lit(0))).alias("net")
    )


def net(label: Column, scale: Sequence[str] = SENTIMENTS) -> Column:
    """Mean place on a scale from worst to best, the middle being 0; an aggregate, null if nothing is on it."""
    place = F.array_position(F.array(*map(F.lit, scale)), label)
    return F.avg(F.when(place > 0, place - (len(scale) + 1) // 2))


def monthly_report(frame: DataFrame, month: Column, label: Column, score: Column, scale: Sequence[str] = SENTIMENTS) -> DataFrame:
    """A row per month, dense: volume, its change on the month before, scored rows, net, mean score and mix."""
    counted = frame.groupBy(month.alias("month")).agg(
        F.count("*").alias("volume"), F.count_if(label.isin(*scale)).alias("scored"), net(label, scale).alias("net"), F.avg(score).alias("mean_score"),
        *(F.count_if(label == x).alias(f"n_{x.replace(' ', '_')}") for x in scale),
    ).where("month IS NOT NULL")
    bounds = counted.agg(F.min("month").alias("low"), F.max("month").alias("high"))
    dense = dates.months(bounds, "low", "high").join(counted, "month", "left")
    mixes = [f"n_{x.replace(' ', '_')}" for x in scale]
    dense = dense.select("month", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("volume", "scored", *mixes)), "net", "mean_score")
    # One row a month: the window is over months.
    prior = F.lag("volume").over(W.orderBy("month"))
    changed = dense.withColumn("prior", prior)
    return changed.withColumns({"change": F.col("volume") - F.col("prior"), "percent": percent_change(F.col("volume"), F.col("prior"))})


def top(frame: DataFrame, name: Column, most: int = 5) -> DataFrame:
    """(name, n, share): the commonest names, ties by name; the share is of all rows."""
    counted = frame.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where("name IS NOT NULL")
    everything = F.sum("n").over(W.partitionBy())
    return counted.withColumn("share", F.col("n") / everything).orderBy(F.col("n").desc(), "name").limit(most)


def top_themes(frame: DataFrame, themes: Column, most: int = 5, without: Sequence[str] = ()) -> DataFrame:
    """(name, n): the commonest themes, each once a row, ties by name."""
    rows = frame.select(F.explode(F.array_distinct(themes)).alias("name"))
    rows = rows.where(~F.col("name").isin(*without)) if without else rows
    return rows.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(most)


def windowed(frame: DataFrame, times: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Rows any of whose times is in (start, end]."""
    inside = [F.coalesce((F.col(t) > start) & (F.col(t) <= end), F.lit(False)) for t in times]
    out = inside[0]
    for x in inside[1:]:
        out |= x
    return frame.where(out)


def sections(frame: DataFrame, group: str, section: str, at: str, identity: str) -> DataFrame:
    """(group, section, lead, at, others, n): each story's newest row leads and decides its section.

    `others` counts, and does not list, the rest of the story: a story may be of any size.
    """
    order = F.struct(F.coalesce(F.col(at), F.lit("1970-01-01").cast("timestamp")).alias("at"), F.col(identity).alias("id"))
    lead = F.max_by(F.struct(F.col(section).alias("section"), F.col(identity).alias("lead"), F.col(at).alias("at")), order)
    found = frame.groupBy(group).agg(lead.alias("x"), F.count("*").alias("n"))
    return found.select(group, "x.section", "x.lead", "x.at", (F.col("n") - 1).alias("others"), "n")


def members(frame: DataFrame, group: str, at: str, identity: str) -> DataFrame:
    """The frame with `place` of each row in its story, newest first from 1, and `leads`: who leads it.

    The rows after the first are the story's other reports; they stay rows, for a story may be of any size.
    """
    order = F.struct(F.coalesce(F.col(at), F.lit("1970-01-01").cast("timestamp")), F.col(identity))
    lead = frame.groupBy(group).agg(F.max_by(identity, order).alias("leads"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.col(at).desc_nulls_last(), F.col(identity).desc()))
    return frame.withColumn("place", place).join(lead, group)


def digest(frame: DataFrame, group: str, section: str, at: str, identity: str, shown: Mapping[str, Column], order: Sequence[str], brand: str, label: str, score: str) -> tuple[DataFrame, DataFrame]:
    """A digest as data: its entries, and the other reports of each.

    Entries are (story, place, section, at, lead, the `shown` columns, label, score): the newest report of a
    story leads its entry and decides its section; `place` is the section's in `order`, stories of
    other sections are left out. Labels and scores are shown in the brand's section only. The
    other reports are (story, place, the `shown` columns) rows, newest first from 2, for a story may be
    of any size. A row without a group is a story of its own. Entries are read by place, then newest first.
    """
    own = F.coalesce(F.concat(F.lit("story "), F.col(group).cast("string")), F.concat(F.lit("row "), F.col(identity).cast("string")))
    placed = members(frame.withColumn("story", own), "story", at, identity)
    position = F.array_position(F.array(*map(F.lit, order)), F.col(section))
    is_brand = F.col(section) == brand
    entries = placed.where(F.col("place") == 1).withColumn("_place", position).where("_place > 0").select(
        "story", F.col("_place").alias("place"), F.col(section).alias("section"), F.col(at).alias("at"), F.col(identity).alias("lead"), *(c.alias(n) for n, c in shown.items()),
        F.when(is_brand, blank_to_null(F.col(label))).alias("label"), F.when(is_brand, F.col(score)).alias("score"),
    )
    others = placed.where(F.col("place") > 1).join(entries.select("story"), "story").select("story", "place", *(c.alias(n) for n, c in shown.items()))
    return entries, others


def sort_time(published: Column, *others: Column) -> Column:
    """The time by which a row is sorted: its publication, else the latest of its other known times, else the epoch."""
    return F.coalesce(published, F.greatest(*others) if len(others) > 1 else others[0], F.lit("1970-01-01").cast("timestamp"))


def stories(frame: DataFrame, rank: Column, group: str, title: str, identity: str, most: int = 3, by: str | None = None) -> DataFrame:
    """The `most` best rows of different groups and titles, in all or for each value of `by`.

    The best row is taken; rows of its group or title are out for the next one. A row without
    a group is one of its own. So each of `most` rounds is an aggregation over what is left, of
    which ids and titles alone are carried; whole rows are fetched once for what was taken.
    There is a taken row for each value of `by`, which should be few; identities are distinct.
    """
    own = F.lit(0) if by is None else F.col(by)
    named = {"rank": rank, "_by": own, "_group": F.coalesce(F.col(group).cast("string"), F.concat(F.lit("row "), F.col(identity).cast("string"))), "_title": F.lower(title)}
    ranked = frame.withColumns(named)
    left = ranked.select(F.col(identity).alias("_id"), *named)
    picked = None
    for turn in range(most):
        best = left.groupBy("_by").agg(F.max_by(F.struct("_id", "_group", "_title"), F.struct("rank", "_id")).alias("row")).select("_by", F.col("row._id").alias("_id"), F.col("row._group").alias("_g"), F.col("row._title").alias("_t"))
        taken = best.select("_id", F.lit(turn + 1).alias("turn"))
        picked = taken if picked is None else picked.unionByName(taken)
        if turn + 1 < most:
            left = left.join(F.broadcast(best.drop("_id")), "_by", "left").where("NOT (_group <=> _g) AND NOT (_title <=> _t)").drop("_g", "_t")
    return ranked.drop("_by", "_group", "_title").join(picked, F.col(identity) == F.col("_id")).drop("_id")


def header_counts(frame: DataFrame, relevant: str) -> DataFrame:
    """(total, visible, rejected) in one row; rows without a verdict are visible."""
    rejected = F.count_if(F.col(relevant) == F.lit(False))
    return frame.agg(F.count("*").alias("total"), rejected.alias("rejected")).select("total", (F.col("total") - F.col("rejected")).alias("visible"), "rejected")


def distinct_stories(frame: DataFrame, month: Column, *keys: str) -> DataFrame:
    """(month, volume, stories): rows of each month, and how many stories they are by the first key that is there."""
    story = F.coalesce(*(F.col(k).cast("string") for k in keys))
    return frame.groupBy(month.alias("month")).agg(F.count("*").alias("volume"), F.count_distinct(story).alias("stories")).where("month IS NOT NULL")


def whole_months(months: DataFrame, month: str, now: Column, days: int, start: Column) -> DataFrame:
    """The months with `complete`: whether all of a month is still kept, `days` days back; `start` is its first instant."""
    return months.withColumn("complete", F.coalesce(start >= now - F.make_dt_interval(F.lit(days)), F.lit(False)))


def record_totals(state: DataFrame, live: DataFrame, month: str) -> DataFrame:
    """The saved totals with those of months that are still complete; without any live row the state stays as it is."""
    values = [c for c in state.columns if c != month]
    fresh = live.where("complete").select(month, F.struct(*values).alias("_new"))
    joined = state.select(month, F.struct(*values).alias("_old")).join(fresh, month, "full_outer")
    return joined.select(month, F.coalesce("_new", "_old").alias("v")).select(month, "v.*")


def volume_clause(volume: Column, prior: Column, name: Column, to_date: Column) -> Column:
    """How a month's volume compares with the month before, in words."""
    change = volume - prior
    percent = percent_change(volume, prior)
    share = F.when(percent.isNull(), F.lit("")).otherwise(F.concat(F.lit(" ("), F.abs(percent).cast("string"), F.lit("%)")))
    moved = F.concat(F.when(change > 0, F.lit("up ")).otherwise("down "), F.abs(change).cast("string"), share, F.lit(" from "), prior.cast("string"), F.lit(" in "), name)
    same = F.concat(F.lit("the same as the "), prior.cast("string"), F.lit(" in "), name)
    return F.when(to_date, F.concat(F.lit("against "), prior.cast("string"), F.lit(" in all of "), name)).when(change == 0, same).otherwise(moved)


def tone(net_value: Column, bound: float = 0.25) -> Column:
    """A net value in words."""
    return F.when(net_value > bound, "leaning favorable").when(net_value < -bound, "leaning unfavorable").when(net_value.isNotNull(), "close to neutral")


def joined_list(values: Column) -> Column:
    """Texts with commas, and before the last one."""
    n = F.size(values)
    head = F.array_join(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.array_join(values, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(values, -1)))


def summary(volume: Column, period: Column, clause: Column, scored: Column, net_value: Column, outlet: Column, outlet_count: Column) -> Column:
    """A month in sentences: how many stories, how they compare, their tone, and who carried most of them."""

    def plural(n: Column) -> Column:
        return F.concat(n.cast("string"), F.when(n == 1, F.lit(" story")).otherwise(" stories"))

    first = F.concat(F.lit("In "), period, F.lit(", "), plural(volume), F.when(volume == 1, F.lit(" was")).otherwise(" were"), F.lit(" found, "), clause, F.lit("."))
    second = F.when(scored == 0, F.lit("None of these has been scored yet.")).otherwise(F.concat(F.lit("Net sentiment was "), F.format_string("%+.2f", net_value), F.lit(", "), tone(net_value), F.lit(".")))
    third = F.when(outlet.isNotNull(), F.concat(outlet, F.lit(" carried the most coverage, with "), plural(outlet_count), F.lit(".")))
    return F.when(volume == 0, first).otherwise(F.concat_ws(" ", first, second, third))


def findings_input(frame: DataFrame, month: Column, group: str, at: str, identity: str, most: int = 40) -> DataFrame:
    """(month, identity, place): the newest row of each story, the `most` newest stories of each month."""
    story = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("row "), F.col(identity).cast("string")))
    rows = frame.withColumns({"month": month, "_story": story}).where("month IS NOT NULL")
    newest = rows.groupBy("month", "_story").agg(F.max(F.struct(at, identity)).alias("x"))
    place = F.row_number().over(W.partitionBy("month").orderBy(F.col(f"x.{at}").desc(), F.col(f"x.{identity}").desc()))
    return newest.withColumn("place", place).where(F.col("place") <= most).select("month", f"x.{identity}", "place")


def weekly_labels(stories_: DataFrame, line: str, at: str, label: str, labels: Sequence[str]) -> DataFrame:
    """(line, week, scored, a count per label) over a storyline's frozen members; undated and unscored ones count nowhere."""
    rows = stories_.where(F.col(at).isNotNull() & F.col(label).isin(*labels))
    return rows.groupBy(line, dates.week_start(F.col(at)).alias("week")).agg(F.count("*").alias("scored"), *(F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels))


def snapshot(state: DataFrame, live: DataFrame, key: str, complete: str) -> DataFrame:
    """Monthly totals kept for good: live rows where the month is still wholly there, else the state's, else incomplete."""
    values = [c for c in live.columns if c not in (key, complete)]
    both = live.alias("l").join(state.alias("s"), F.col(f"l.{key}") == F.col(f"s.{key}"), "full_outer")
    whole = F.coalesce(F.col(f"l.{complete}"), F.lit(False))
    known = whole | F.col(f"s.{key}").isNotNull()
    picked = (F.when(whole, F.col(f"l.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in values)
    return both.select(F.coalesce(F.col(f"l.{key}"), F.col(f"s.{key}")).alias(key), *picked, known.alias(complete))
