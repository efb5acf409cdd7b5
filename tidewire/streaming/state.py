"""Streaming variants of the keyed operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions.urls import canonical_link


def new_links(stream: DataFrame, link: str, at: str, late: str = "92 days") -> DataFrame:
    """The first row of each canonical link within the watermark; state ends with it."""
    keyed = stream.withColumn("canonical", canonical_link(F.col(link)))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["canonical"])


def window_counts(stream: DataFrame, key: str, at: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, window_start, n) per tumbling window; rows later than the watermark don't count."""
    counted = stream.withWatermark(at, late).groupBy(key, F.window(at, width)).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("window.start").alias("window_start"), "n")


def failure_streaks(stream: DataFrame, key: str, at: str, failed: str, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """(key, at, streak): failures in a row as of each row, kept per key until it is idle so long.

    The state is two numbers a key. Rows of a batch are folded in order of time.
    """

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (streak,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(at)
        out = []
        for moment, bad in zip(rows[at], rows[failed], strict=True):
            streak = streak + 1 if bad else 0
            out.append((keys[0], moment, streak))
        state.update((streak,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[key, at, "streak"])

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {at} timestamp, streak long", "streak long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_counts(stream: DataFrame, key: str, at: str, gap: str = "35 minutes", late: str = "2 hours") -> DataFrame:
    """(key, opened, n) per session: rows no farther apart than the gap; rows later than the watermark don't count."""
    counted = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("_s")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("_s.start").alias("opened"), "n")


def sliding_counts(stream: DataFrame, key: str, at: str, width: str = "1 hour", slide: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """(key, window_start, n) per sliding window."""
    counted = stream.withWatermark(at, late).groupBy(key, F.window(at, width, slide).alias("_w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("_w.start").alias("window_start"), "n")


def deliver(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Write what is there now to a folder, each key once, however often batches or runs are repeated.

    Which keys were delivered is told by a folder of keys alone, inside `path`, where readers of the
    rows pass it over: rows that were delivered are not read again. Keys are written after their rows,
    so a run that ends between the two delivers that batch's rows again rather than losing them.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark, fresh, told = batch.sparkSession, batch.dropDuplicates(keys), f"{path}/_delivered"
        folder = spark._jvm.org.apache.hadoop.fs.Path(told)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            fresh = fresh.join(spark.read.parquet(told).distinct(), keys, "left_anti").select(*batch.columns)
        # Both folders get the same rows.
        fresh = fresh.persist()
        fresh.write.mode("append").parquet(path)
        fresh.select(*keys).write.mode("append").parquet(told)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
