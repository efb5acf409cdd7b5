"""Which rows are the same article, and what is left of them when they become one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import blank_to_null, title_key
from tidewire.operators.cluster import cut


def first_rows(frame: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that must be total. Rows with a null key are dropped.

    One aggregation with partial results on the map side: a hot key's rows don't meet in a task.
    """
    columns = frame.columns
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    keyed = frame.select(F.struct(*named).alias("_key"), rank.alias("_rank"), F.struct(*columns).alias("_row"))
    for i in range(len(named)):
        keyed = keyed.where(F.col(f"_key.{keyed.schema['_key'].dataType.names[i]}").isNotNull())
    return keyed.groupBy("_key").agg(F.min_by("_row", "_rank").alias("_row")).select("_row.*")


def first_per_source(frame: DataFrame, source: str, position: str, most: int) -> DataFrame:
    """The first `most` rows of each source by position; a rank filter, which Spark pushes before the shuffle."""
    rank = F.row_number().over(W.partitionBy(source).orderBy(position))
    return frame.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def date_window(frame: DataFrame, at: str, least: Column | None = None, before: Column | None = None) -> DataFrame:
    """Rows dated in [least, before); undated rows go if there is any bound."""
    if least is not None:
        frame = frame.where(F.col(at) >= least)
    return frame if before is None else frame.where(F.col(at) < before)


def dedupe_items(frame: DataFrame, position: str, link: str = "link", guid: str = "guid") -> DataFrame:
    """The first row of each link, or of each guid where there is no link; rows with neither go."""
    key = F.coalesce(blank_to_null(F.col(link)), blank_to_null(F.col(guid)))
    return first_rows(frame, [key], [F.col(position)])


def link_quality(curated: Column, aggregated: Column, clean: Column, relevant: Column, texts: Sequence[Column], terms: Column) -> Column:
    """How much a copy of an article is worth: provenance first, then how direct, clean, judged and full it is."""
    filled = sum((F.when(blank_to_null(t).isNotNull(), 2).otherwise(0) for t in texts), F.lit(0))
    verdict = F.when(relevant, 10).when(relevant.isNull(), 5).otherwise(0)
    return (
        F.when(curated, 1000).otherwise(0)
        + F.when(aggregated, 0).otherwise(100)
        + F.when(clean, 20).otherwise(0)
        + verdict
        + filled
        + F.least(F.greatest(F.size(terms), F.lit(0)), F.lit(5))
    )


def merge_copies(
    frame: DataFrame,
    key: str,
    quality: str,
    identity: str,
    fill: Sequence[str] = (),
    union: Sequence[str] = (),
    earliest: Sequence[str] = (),
    verdict: str | None = None,
) -> DataFrame:
    """One row per key: the copy of the highest quality (then the least identity), filled up by the others.

    Columns in `fill` take the first value that isn't null or empty, in order of quality;
    arrays in `union` all values once in that order; columns in `earliest` the least value.
    `verdict` is true if any copy's is, else null if any copy's is, else false. Only what
    these columns need is aggregated: rows of a hot key are merged on the map side, and of
    arrays each distinct one is kept once with its rank.
    """
    rank = F.struct((-F.col(quality)).alias("q"), F.col(identity).alias("i"))
    aggregates = [F.min_by(c, rank).alias(c) for c in frame.columns if c not in {key, *fill, *union, *earliest, verdict}]
    for c in fill:
        value = blank_to_null(F.col(c)) if frame.schema[c].dataType.simpleString() == "string" else F.col(c)
        aggregates.append(F.min_by(value, F.when(value.isNotNull(), rank)).alias(c))
    for c in union:
        aggregates.append(F.array_sort(F.collect_set(F.struct(rank.alias("r"), F.col(c).alias("v")))).alias(c))
    aggregates += [F.min(c).alias(c) for c in earliest]
    if verdict:
        judged = F.when(F.max(F.col(verdict).eqNullSafe(F.lit(True))), True).when(F.max(F.col(verdict).isNull()), F.lit(None)).otherwise(False)
        aggregates.append(judged.cast("boolean").alias(verdict))
    merged = frame.groupBy(key).agg(*aggregates)
    for c in union:
        merged = merged.withColumn(c, F.array_distinct(F.flatten(F.filter(F.transform(c, lambda x: x["v"]), lambda v: v.isNotNull()))))
    return merged.select(*frame.columns)


def duplicates(frame: DataFrame, key: Column, identity: str) -> DataFrame:
    """(identity, first, copies) of each row: the least identity of its key, and how many rows share that."""
    keyed = frame.select(F.col(identity).alias("identity"), key.alias("key"))
    groups = keyed.groupBy("key").agg(F.min("identity").alias("first"), F.count("*").alias("copies"))
    return keyed.join(groups, "key").select("identity", "first", "copies")


def resolve_titles(frame: DataFrame, position: str, title: str = "title", outlet: str = "outlet", domain: str = "domain", curated: str = "curated", aggregated: str = "aggregated", most_rounds: int = 10_000) -> DataFrame:
    """(position, slot, rank) of each row: which rows of one title become one, and in which order they fill it.

    Rows are taken in order of position. A row of a title joins the slot that its domain has (an
    aggregator's: its domain and outlet) unless it is curated. Else it replaces the title's newest slot if
    it is curated and that is an aggregator's, or joins it if that is curated and the row an aggregator's.
    Else it meets the slot of its outlet: a curated row replaces one that isn't, a publisher's row one
    of an aggregator, and where either is an aggregator's it joins. Else it opens a slot of its own.

    `slot` is the position that opened it; of its rows the least `rank` leads, and later ranks
    fill what is blank: those that replaced come first, the last one foremost, then the opener, then
    those that joined. Rows without a title have slots of their own. Positions are distinct.

    Titles that have neither curated nor aggregated rows are one aggregation. The others go in
    rounds: each round finds every title's first row that opens or replaces, settles the rows before
    it as joining, and tells the rows behind it; there are as many rounds as the most changes of a title.
    """
    keyed = frame.select(
        F.col(position).alias("pos"), title_key(F.col(title)).alias("key"), F.coalesce(F.col(outlet), F.lit("")).alias("o"), F.coalesce(F.col(domain), F.lit("")).alias("site"),
        F.coalesce(curated, F.lit(False)).alias("c"), F.coalesce(aggregated, F.lit(False)).alias("g"),
    )
    keyed = keyed.withColumn("d", F.when(F.col("site") == "", "").when(F.col("g"), F.concat_ws("|", "site", "o")).otherwise(F.concat(F.col("site"), F.lit("|")))).drop("site")
    titled = keyed.where("key <> ''")
    mixed = titled.groupBy("key").agg(F.bool_or(F.col("c") | F.col("g")).alias("mixed"))
    told = titled.join(mixed, "key")
    plain = told.where("NOT mixed AND d <> ''")
    firsts = plain.groupBy("key", "d").agg(F.min("pos").alias("slot"))
    done = [plain.join(firsts, ["key", "d"]).select("pos", "slot", F.when(F.col("pos") == F.col("slot"), 0).otherwise(F.col("pos")).cast("long").alias("rank"))]
    alone = keyed.where("key = ''").select("pos").union(told.where("NOT mixed AND d = ''").select("pos"))
    done.append(alone.select("pos", F.col("pos").alias("slot"), F.lit(0).cast("long").alias("rank")))

    slot, flag = frame.schema[position].dataType.simpleString(), F.lit(None).cast("boolean")
    empty = {f"{x}_slot": F.lit(None).cast(slot) for x in "doa"} | {f"{x}_{y}": flag for x in "oa" for y in "cg"}
    now = cut(told.where("mixed").drop("mixed").withColumns(empty))
    by_domain = F.col("d_slot").isNotNull() & ~F.col("c")
    over_newest = F.col("c") & ~F.col("a_c") & F.col("a_g")
    to_newest = F.col("a_c") & ~F.col("c") & F.col("g")
    over_outlet = F.col("o_slot").isNotNull() & ((F.col("c") & ~F.col("o_c")) | (F.col("o_g") & ~F.col("g")))
    to_outlet = F.col("o_slot").isNotNull() & (F.col("o_g") | F.col("g"))
    # The first of these that holds; the empty ones are false, for what a title doesn't have yet is null.
    deed = F.when(by_domain, "join").when(over_newest, "replace").when(to_newest, "join").when(over_outlet, "replace").when(to_outlet, "join").otherwise("open")
    where = F.when(by_domain, F.col("d_slot")).when(over_newest | to_newest, F.col("a_slot")).when(over_outlet | to_outlet, F.col("o_slot")).otherwise(F.col("pos"))
    for _ in range(most_rounds):
        seen = now.withColumns({"deed": deed, "where": where})
        change = F.struct("pos", F.col("where").alias("slot"), "deed", "d", "o", "c", "g")
        events = seen.where("deed <> 'join'").groupBy("key").agg(F.min_by(change, "pos").alias("e"))
        met = cut(seen.join(events, "key", "left"))
        if met.isEmpty():
            break
        settled = met.where("e IS NULL OR pos <= e.pos")
        rank = F.when(F.col("deed") == "open", 0).when(F.col("deed") == "replace", -F.col("pos")).otherwise(F.col("pos"))
        done.append(settled.select("pos", F.col("where").alias("slot"), rank.cast("long").alias("rank")))
        opened = F.col("e.deed") == "open"
        outlet_now = (F.col("o") != "") & (F.col("o") == F.col("e.o"))
        # A slot's flags are those of its newest leader.
        led = {x: first | F.coalesce(F.col(f"{x}_slot") == F.col("e.slot"), F.lit(False)) for x, first in (("o", outlet_now), ("a", opened))}
        now = met.where("e IS NOT NULL AND pos > e.pos").select(
            "pos", "key", "o", "c", "g", "d", F.when((F.col("d") != "") & (F.col("d") == F.col("e.d")), F.col("e.slot")).otherwise(F.col("d_slot")).alias("d_slot"),
            F.when(outlet_now, F.col("e.slot")).otherwise(F.col("o_slot")).alias("o_slot"), F.when(opened, F.col("e.slot")).otherwise(F.col("a_slot")).alias("a_slot"),
            *(F.when(led[x], F.col(f"e.{y}")).otherwise(F.col(f"{x}_{y}")).alias(f"{x}_{y}") for x in "oa" for y in "cg"),
        )
    else:
        raise RuntimeError(f"titles did not settle in {most_rounds} rounds")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(F.col("pos").alias(position), "slot", "rank")


def resolved(frame: DataFrame, found: DataFrame, position: str, fill: Sequence[str] = (), union: Sequence[str] = (), earliest: Sequence[str] = (), verdict: str | None = None) -> DataFrame:
    """One row per slot of `resolve_titles`: its leading row, filled up by the others in order of rank."""
    ranked = frame.join(found, position).withColumn("_worth", -F.col("rank")).drop("rank")
    merged = merge_copies(ranked, "slot", "_worth", position, fill, union, earliest, verdict)
    return merged.select(*frame.columns)


def merge_comments(frame: DataFrame, key: str, position: str, author: str, text: str) -> DataFrame:
    """The first comment of each author and text, case aside, of each key; blank ones go."""
    same = F.lower(F.concat_ws("|", F.trim(F.coalesce(F.col(author), F.lit(""))), F.trim(F.col(text))))
    return first_rows(frame.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != ""), [F.col(key).alias("k"), same.alias("same")], [F.col(position)])


def threads(frame: DataFrame, key: str, position: str, is_root: Column) -> DataFrame:
    """The frame with `root`: the position of the nearest root before a row, or its own."""
    upto = W.partitionBy(key).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return frame.withColumn("root", F.last(F.when(is_root, F.col(position)), ignorenulls=True).over(upto))


def unique_keys(frame: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has; empty where the key is unique."""
    return frame.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def pack(frame: DataFrame, group: str, position: str, text: str, most: int) -> DataFrame:
    """(group, batch, texts): texts of a group packed in order into batches of at most `most` characters.

    A text goes to the first batch that has room for it and a line end. Groups are one
    alert's lines, which its sources bound.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        sizes: list[int] = []
        batches: list[list[str]] = []
        for line in rows.sort_values(position)[text].fillna(""):
            line = line[:most]
            at = next((i for i, n in enumerate(sizes) if n + 1 + len(line) <= most), None)
            if at is None:
                sizes.append(len(line))
                batches.append([line])
            else:
                sizes[at] += 1 + len(line)
                batches[at].append(line)
        return pd.DataFrame({group: rows[group].iloc[0], "batch": range(len(batches)), "texts": batches})

    kind = frame.schema[group].dataType.simpleString()
    return frame.select(group, position, text).groupBy(group).applyInPandas(fit, f"{group} {kind}, batch int, texts array<string>")


def stable_ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a over code points, 32 bits in hex."""
    for series in texts:
        out = []
        for text in series.fillna(""):
            h = 0x811C9DC5
            for c in text:
                h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
            out.append(f"{h:08x}")
        yield pd.Series(out)


def stable_id(text: Column) -> Column:
    """`stable_ids` of a column."""
    return F.pandas_udf(stable_ids, "string")(text)
