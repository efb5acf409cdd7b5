"""Work along an order without one task for all of it: running sums, nearest marks, chains of openers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.operators.cluster import cut


def running(frame: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """The frame with running sums along a total order, each row's own value included.

    Rows are dealt to ranges of the order, each range sums its own, and starts from the sums of the
    ranges before it; only these, a row for each range, come together. The ranges are written
    once, so that a range lost and made again is the same. Nulls count as nothing.
    """
    names = list(sums)
    valued = frame.withColumns({f"_v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(sums.values())})
    placed = cut(valued.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*(F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))))
    starts = parts.select("_part", *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(names))))
    upto = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumns({f"_r{i}": F.sum(f"_v{i}").over(upto) for i in range(len(names))})
    joined = summed.join(F.broadcast(starts), "_part")
    return joined.select(*frame.columns, *((F.col(f"_r{i}") + F.col(f"_b{i}")).alias(name) for i, name in enumerate(names)))


def nearest(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, width: int, out: str = "mark", later: bool = True) -> DataFrame:
    """The points with the least mark of their keys that is at or after each (`later=False`: the greatest at or before), null without one.

    Points and marks have a whole number `at`. It is cut into stretches of `width`: a point's mark is
    in its own stretch or the next one that has any, so a task takes a stretch of a key, and
    all stretches of a key come together as one row each.
    """
    sign = 1 if later else -1
    own = points.columns
    given = points.withColumns({"_t": F.col(at) * sign, "_m": F.lit(None).cast("long"), "_kind": F.lit(1)})
    set_ = marks.select(*keys, (F.col(at) * sign).cast("long").alias("_m")).withColumns({"_t": F.col("_m"), "_kind": F.lit(0)})
    both = given.unionByName(set_, allowMissingColumns=True).withColumn("_stretch", F.floor(F.col("_t") / width))
    back = W.partitionBy(*keys, "_stretch").orderBy(F.col("_t").desc(), "_kind").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_m", ignorenulls=True).over(back))
    firsts = both.groupBy(*keys, "_stretch").agg(F.min("_m").alias("_first"))
    after = W.partitionBy(*keys).orderBy(F.col("_stretch").desc()).rowsBetween(W.unboundedPreceding, -1)
    following = firsts.withColumn("_next", F.last("_first", ignorenulls=True).over(after)).drop("_first")
    joined = found.where("_kind = 1").join(following, [*keys, "_stretch"])
    return joined.select(*own, (F.coalesce("_own", "_next") * sign).alias(out))


def openers(steps: DataFrame, keys: Sequence[str], at: str, following: str, most_rounds: int = 62) -> DataFrame:
    """(keys, at) of a chain: each key's least `at`, what follows it, what follows that, and so on.

    `steps` has for each `at` the one that would follow if it were in the chain. Steps are doubled:
    after k rounds the first 2**k members are known, and a step jumps 2**k of them. A round is
    two joins on key and place, so a key with a million members takes twenty rounds and
    no task takes them all.
    """
    known = cut(steps.groupBy(*keys).agg(F.min(at).alias(at)))
    jumps = cut(steps.where(F.col(following).isNotNull()).select(*keys, at, following))
    n = known.count()
    for _ in range(most_rounds):
        reached = known.join(jumps, [*keys, at]).select(*keys, F.col(following).alias(at))
        known = cut(known.union(reached).distinct())
        now = known.count()
        if now == n:
            return known
        n = now
        onward = jumps.select(*keys, F.col(at).alias(following), F.col(following).alias("_far"))
        jumps = cut(jumps.join(onward, [*keys, following]).select(*keys, at, F.col("_far").alias(following)))
    raise RuntimeError(f"the chain did not end in {most_rounds} doublings")
