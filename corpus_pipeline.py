"""From raw documents to training tokens: five stages, each one operator over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import mixing, quality_rules, sentencepiece, simhash, substring_dedup
from tidewire.llm.cluster import by_place, cut
from tidewire.llm.queries import PIECES, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality rules and the base rules keep.

    A null, empty or short text fails the base rules. Rows with a null id and repeated rows
    are judged by their own text, long ones whole; an empty table, and labels of one kind
    alone, leave the base rules. Columns of any name stay.
    """
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id; rows without an id stay.

    Null and empty texts are copies of each other. Repeated rows of the id that stays all stay.
    Texts count whole; an empty table gives no rows; columns of any name stay.
    """
    found = simhash.near_copies(docs, shingle=5, similarity=0.8)
    gone = found.where("id <> component").select(F.col("id").alias("gone")).distinct()
    own = by_place(docs)
    left = own.join(gone, own[own.columns[docs.columns.index("doc_id")]] == gone["gone"], "left_anti")
    return left.toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that stand in documents of smaller ids.

    Null texts stay null, texts without repeats stay as they are, however long; rows without an
    id and repeated rows stay, the latter without removing each other's words. `n_chars`
    follows the text. An empty table gives no rows; columns of any name stay.
    """
    return substring_dedup.apply(docs, window=50).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one of its own; null and empty texts are of no size and may be taken;
    repeated rows are taken each for itself; texts count whole, however long; an empty table gives
    no rows; columns of any name stay.
    """
    return mixing.apply(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, same) of each document taken: its SentencePiece ids, and whether decoding gives its text back.

    A null or empty text has no ids; null ids and repeated rows have a row each; texts are
    encoded whole; an empty table gives no rows.
    """
    found = sentencepiece.round_trip(spark, docs, PIECES)
    return found.select(F.col("id").alias("doc_id"), "ids", "n_pieces", "same")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mix", mix),
    ("pieces", pieces),
]

#: Learned rules, similarity classes and piece encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
