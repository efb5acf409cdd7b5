"""A quality classifier by importance resampling.

Two generative models of hashed word n-grams, of target text and of raw text, give each
document the logarithm of its likelihood ratio. With a Gumbel variable added to each,
the k largest sums are a sample of k documents without replacement, by importance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import text as tw
from tidewire.llm.cluster import cut


def grams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of neighbouring words of a batch."""
    found = tw.Words(column)
    words = found.hashes()
    row = found.row
    pairs = tw.windows(words, 2)
    inner = row[1:] == row[:-1]
    shift = np.uint64(64 - bits)
    return np.concatenate([row, row[1:][inner]]), (np.concatenate([words, pairs[inner]]) >> shift).astype(np.int64)


def target_rows(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """Ids of target documents: those labelled 1, at most `most` of them by a hash of the id."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    return good.orderBy(F.xxhash64("id"), "id").limit(most)


def counts(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, target, raw): n-grams in target documents and in all. `rows` has text and is_target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                row, bucket = grams(batch.column(0), bits)
                wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                raw += np.bincount(bucket, minlength=1 << bits)
                target += np.bincount(bucket[wanted[row]], minlength=1 << bits)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], ["bucket", "target", "raw"])

    partial = rows.select("text", "is_target").mapInArrow(run, "bucket long, target long, raw long")
    return partial.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(rows: DataFrame, bits: int, smoothing: float = 1.0) -> np.ndarray:
    """Each bucket's logarithm of its share in target text over that in raw text.

    There are 2**bits buckets, whatever the corpus; nothing else reaches the driver.
    """
    target, raw = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in counts(rows, bits).collect():
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]

    def share(n: np.ndarray) -> np.ndarray:
        return (n + smoothing) / (n.sum() + smoothing * len(n))

    return np.log(share(target) / share(raw)) if target.any() else np.zeros(1 << bits)


def gumbel(id_: Column, seed: int) -> Column:
    """A standard Gumbel variable that id and seed decide."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def scores(frame: DataFrame, ratios: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n_grams, log_ratio) of each row."""
    bits = int(len(ratios)).bit_length() - 1
    shared = frame.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                row, bucket = grams(batch.column(1), bits)
                total = np.bincount(row, shared.value[bucket], minlength=batch.num_rows)
                n = np.bincount(row, minlength=batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total.astype(float))], ["id", "n_grams", "log_ratio"])

    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_grams long, log_ratio double")


def largest(frame: DataFrame, key: str, k: int, fan: int = 4096) -> Column:
    """Whether a row's (`key`, id) is among the k largest of the frame (a non-null double).

    Counts over ever finer parts of the range between the least and the largest key find
    the part that the k-th row is in; only counts reach the driver, `fan` at a time.
    Rows of equal key and id are taken or left together.
    """
    low, high, n = frame.agg(F.min(key), F.max(key), F.count("*")).first()
    if k <= 0 or n == 0:
        return F.lit(False)
    if k >= n:
        return F.lit(True)
    value, left = F.col(key), k
    for _ in range(8):
        width = (high - low) / fan
        if width <= 0 or low + width == low:
            break
        inside = frame.where(value.between(low, high))
        part = F.least(F.floor((value - low) / width), F.lit(fan - 1)).alias("part")
        found = inside.groupBy(part).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for row in sorted(found, key=lambda r: -r["part"]):
            if row["n"] >= left:
                low, high, within = row["low"], row["high"], row["n"]
                break
            left -= row["n"]
        if within <= fan or low == high:
            break
    # What is in the last part is few rows, or rows of one key; ids decide among these.
    last = frame.where(value.between(low, high)).orderBy(value.desc(), F.col("id").asc_nulls_last()).limit(left)
    edge = last.orderBy(value.asc(), F.col("id").desc_nulls_first()).first()
    at_edge = (value == edge[key]) & (F.lit(edge["id"]).isNull() | (F.col("id") <= F.lit(edge["id"])))
    return (value > edge[key]) | at_edge


def resample(
    frame: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    share: float | None = None,
    bits: int = 16,
    most_targets: int = 20_000,
    seed: int = 5,
) -> DataFrame:
    """(id, n_grams, log_ratio, key, kept) of each row of `frame`.

    Target text is that of documents labelled 1, at most `most_targets` of them; raw text
    is every document. `kept` marks the sample: the share `share` of all rows with the
    largest `key`, which is the log ratio with a Gumbel variable added. Without `share` it
    is the share of 1 among the labels. Reruns agree.

    A null or empty text has no n-grams and a ratio of 0; texts count whole, however long.
    Rows with null ids get the same random variable each; repeated rows are kept or left
    together, and of equal keys the smaller id comes first. An empty table gives no rows;
    without target rows all ratios are 0. Other columns are left out.
    """
    if share is None:
        share = labels.agg(F.avg(F.col(label_col).cast("double"))).first()[0] or 0.0
    # At most `most_targets` ids are sent to every task.
    targets = F.broadcast(cut(target_rows(labels, id_col, label_col, most_targets)).withColumn("is_target", F.lit(True)))
    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = rows.join(targets, "id", "left").select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    ratios = log_ratios(marked, bits)
    scored = cut(scores(frame, ratios, id_col, text_col))
    keyed = scored.withColumn("key", F.col("log_ratio") + gumbel(F.coalesce(F.col("id").cast("string"), F.lit("")), seed))
    k = round(share * scored.count())
    return keyed.withColumn("kept", largest(keyed, "key", k))
