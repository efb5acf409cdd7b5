"""Examples for requests: seats first, then the nearest, no story twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import SENTIMENTS
from tidewire.operators.cluster import cut, same_story

#: What tells stories apart.
STORY = ("link", "title", "terms")


def _one_story(left: str, right: str) -> Column:
    sides = [(F.col(f"{left}.{c}"), F.col(f"{right}.{c}")) for c in STORY]
    return F.coalesce(same_story(*sides[0], *sides[1], *sides[2]), F.lit(False))


def eligible(pairs: DataFrame, task: str, labels: Sequence[str] = SENTIMENTS) -> DataFrame:
    """Pairs of a query and an example that may be shown for it: not the query's own story, and with a label where the task is about it.

    `item` and `example` are structs of link, title, terms and group; the example's has include and label too.
    """
    own = F.coalesce(F.col("item.group") == F.col("example.group"), F.lit(False)) | _one_story("item", "example")
    kept = pairs.where(~own)
    if task != "sentiment":
        return kept
    return kept.where(~F.col("example.include").eqNullSafe(F.lit(False)) & F.col("example.label").isin(*labels))


def choose(pairs: DataFrame, task: str, limit: int = 16, labels: Sequence[str] = SENTIMENTS, slots: int = 2) -> DataFrame:
    """(query, example_id, turn, score): up to `limit` examples of each query, in the order in which they are chosen.

    `pairs` has query, example_id, score and the struct `example`; an example that shares nothing
    with a query is in no pair with it. For sentiment the nearest example of each label has
    a seat, best label first; for inclusion the nearest `slots` rejections (a quarter of the
    limit at most). Then the nearest follow. Ties go by id. An example of a story chosen already is
    passed over, and its seat stays empty.

    A round chooses one example of every query at once, by an aggregation of its pairs, and closes
    the pairs of that story; there are as many rounds as seats and examples, whatever the rows.
    Columns of pairs besides these are left out; repeated pairs count once.
    """
    order = F.struct((-F.col("score")).alias("far"), "example_id")
    rows = pairs.groupBy("query", "example_id").agg(F.max("score").alias("score"), F.first("example").alias("example"))
    if task == "sentiment":
        nth = F.row_number().over(W.partitionBy("query", "example.label").orderBy(order))
        place = F.array_position(F.array(*map(F.lit, reversed(labels))), F.col("example.label"))
        seat, seats = F.when(nth == 1, F.nullif(place, F.lit(0))), len(labels)
    else:
        seats = min(slots, limit // 4)
        rejected = F.col("example.include").eqNullSafe(F.lit(False))
        nth = F.row_number().over(W.partitionBy("query", rejected).orderBy(order))
        seat = F.when(rejected & (nth <= seats), nth)
    now = cut(rows.withColumns({"seat": seat, "open": F.lit(True), "taken": F.lit(0)}).repartition("query"))
    chosen = []
    for turn in range(1, seats + limit + 1):
        free = F.col("open") & (F.col("taken") < limit)
        wanted = now.where(free & (F.col("seat") == turn)) if turn <= seats else now.where(free)
        best = cut(wanted.groupBy("query").agg(F.min_by(F.struct("example_id", "score", "example"), order).alias("best")))
        if turn > seats and best.isEmpty():
            break
        chosen.append(best.select("query", F.col("best.example_id").alias("example_id"), F.lit(turn).alias("turn"), F.col("best.score").alias("score")))
        met = now.join(best, "query", "left").withColumn("other", F.col("best.example"))
        closed = F.coalesce(F.col("example_id") == F.col("best.example_id"), F.lit(False)) | _one_story("example", "other")
        now = met.select("query", "example_id", "score", "example", "seat", (F.col("open") & ~closed).alias("open"), (F.col("taken") + F.col("best").isNotNull().cast("int")).alias("taken"))
        # Past the seats, pairs that are closed are done with.
        now = cut(now if turn < seats else now.where("open"))
    every = chosen[0]
    for more in chosen[1:]:
        every = every.unionByName(more)
    turns = F.row_number().over(W.partitionBy("query").orderBy("turn"))
    return every.select("query", "example_id", turns.alias("turn"), "score")
