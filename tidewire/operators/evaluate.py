"""How well labels agree with expected ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import SENTIMENTS


def confusion(frame: DataFrame, expected: Column, actual: Column, labels: Sequence) -> DataFrame:
    """(expected, actual, n) for each pair of labels, zero counts too."""
    counted = frame.select(expected.alias("expected"), actual.alias("actual")).groupBy("expected", "actual").agg(F.count("*").alias("n"))
    kind = counted.schema["expected"].dataType
    every = frame.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels)).cast(f"array<{kind.simpleString()}>")).alias("expected"))
    every = every.withColumn("actual", F.explode(F.array(*map(F.lit, labels)).cast(f"array<{kind.simpleString()}>")))
    return every.join(F.broadcast(counted), ["expected", "actual"], "left").select("expected", "actual", F.coalesce("n", F.lit(0)).alias("n"))


def agreement(frame: DataFrame, expected: Column, actual: Column, scale: Sequence = SENTIMENTS) -> DataFrame:
    """One row: n, exact, within_one, mean distance, signed bias and macro recall over a scale.

    Labels off the scale don't count. A positive bias means actual labels are higher on the
    scale than expected. The macro recall is the mean over labels that are expected at all.
    Shares are null where nothing counts.
    """
    places = F.array(*map(F.lit, scale))
    rows = frame.select(F.array_position(places, expected).alias("e"), F.array_position(places, actual).alias("a")).where("e > 0 AND a > 0")
    cells = rows.groupBy("e").agg(
        F.count("*").alias("n"), F.count_if(F.col("e") == F.col("a")).alias("hit"), F.count_if(F.abs(F.col("e") - F.col("a")) <= 1).alias("near"),
        F.sum(F.abs(F.col("a") - F.col("e"))).alias("apart"), F.sum(F.col("a") - F.col("e")).alias("bias"),
    )
    n = F.nullif(F.sum("n"), F.lit(0))
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("hit") / n).alias("exact"), (F.sum("near") / n).alias("within_one"),
        (F.sum("apart") / n).alias("mean_distance"), (F.sum("bias") / n).alias("bias"), F.avg(F.col("hit") / F.col("n")).alias("macro_recall"),
    )


def labelled(scored: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Scored rows with the labels of their key, null where there are none: joined after scoring, so that no score can see one.

    A key with several rows of labels has none of them; `resolve.unique_keys` lists such keys.
    """
    once = labels.groupBy(key).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in labels.columns if c != key)).where("_n = 1").drop("_n")
    return scored.join(once, key, "left")


def sliced(frame: DataFrame, slices: Mapping[str, Column], expected: Column, predictions: Mapping[str, Column], scale: Sequence = SENTIMENTS) -> DataFrame:
    """(slice, prediction, eligible, n, exact, within_one, mean_distance, bias, macro_recall): `agreement` of each prediction in each slice.

    A row is in every slice whose condition holds. All slices and predictions are counted in one
    pass: a row stands once for each of its slices, and what is shuffled is a row for
    each slice and expected label. A slice without rows is there, without shares. `eligible` counts the
    rows with a label of the scale, `n` those that the prediction has one for too.
    """
    places = F.array(*map(F.lit, scale))
    names = list(predictions)
    held = F.array_compact(F.array(*(F.when(c, F.lit(s)) for s, c in slices.items())))
    rows = frame.select(
        F.explode(held).alias("slice"), F.array_position(places, expected).alias("e"), *(F.array_position(places, p).alias(f"a{i}") for i, p in enumerate(predictions.values()))
    ).where("e > 0")

    def counts(i: int) -> list[Column]:
        there, apart = F.col(f"a{i}") > 0, F.col(f"a{i}") - F.col("e")
        when = lambda x: F.coalesce(F.sum(F.when(there, x)), F.lit(0))
        return [F.struct(F.count_if(there).alias("n"), when((apart == 0).cast("long")).alias("hit"), when((F.abs(apart) <= 1).cast("long")).alias("near"), when(F.abs(apart)).alias("apart"), when(apart).alias("bias")).alias(f"c{i}")]

    cells = rows.groupBy("slice", "e").agg(F.count("*").alias("eligible"), *(c for i in range(len(names)) for c in counts(i)))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("prediction"), F.col(f"c{i}").alias("c")) for i, name in enumerate(names))))
    flat = cells.select("slice", "eligible", each.alias("x")).select("slice", "eligible", "x.prediction", "x.c.*")
    n = F.nullif(F.sum("n"), F.lit(0))
    found = flat.groupBy("slice", "prediction").agg(
        F.sum("eligible").alias("eligible"), F.sum("n").alias("n"), (F.sum("hit") / n).alias("exact"), (F.sum("near") / n).alias("within_one"), (F.sum("apart") / n).alias("mean_distance"),
        (F.sum("bias") / n).alias("bias"), F.avg(F.col("hit") / F.nullif("n", F.lit(0))).alias("macro_recall"),
    )
    every = frame.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, slices))).alias("slice")).withColumn("prediction", F.explode(F.array(*map(F.lit, names))))
    joined = every.join(F.broadcast(found), ["slice", "prediction"], "left")
    return joined.withColumns({"eligible": F.coalesce("eligible", F.lit(0)), "n": F.coalesce("n", F.lit(0))})


def binary(frame: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """One row of counts and shares of a yes-or-no label, with those of always saying yes beside it."""
    rows = frame.select(expected.alias("e"), actual.alias("a")).where("e IS NOT NULL AND a IS NOT NULL")
    counts = rows.agg(
        F.count_if(F.col("e") & F.col("a")).alias("tp"), F.count_if(~F.col("e") & F.col("a")).alias("fp"),
        F.count_if(F.col("e") & ~F.col("a")).alias("fn"), F.count_if(~F.col("e") & ~F.col("a")).alias("tn"),
    )
    n = F.nullif(F.expr("tp + fp + fn + tn"), F.lit(0))
    return counts.withColumns(
        {
            "accuracy": F.expr("tp + tn") / n,
            "precision": F.col("tp") / F.nullif(F.expr("tp + fp"), F.lit(0)),
            "recall": F.col("tp") / F.nullif(F.expr("tp + fn"), F.lit(0)),
            "always_yes": F.expr("tp + fn") / n,
        }
    )
