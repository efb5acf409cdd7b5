"""Queries on examples chosen for requests: benchmark items ask, conversations are the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import SENTIMENTS
from tidewire.operators import choice, cluster
from tidewire.plans.registry import query, table


def words(frame: DataFrame, key: str) -> DataFrame:
    found = frame.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"), F.lit(1))).alias("t"))
    return found.groupBy(key).agg(F.collect_set("t").alias("terms"))


def asked(spark: SparkSession, sf_dir: str, stories: bool) -> DataFrame:
    """Pairs of benchmark items and conversations that share a word of seven letters; every sixth conversation has no label, every seventh was rejected."""
    items, library = words(table(spark, sf_dir, "benchmark"), "item_id"), words(table(spark, sf_dir, "conversations"), "conv_id")
    scored = cluster.overlaps(items, library, "item_id", "terms", "conv_id", "terms")
    empty = F.array().cast("array<string>")

    def story(key: str, kind: str) -> list:
        own = F.concat(F.lit(kind), key)
        return [own.alias("link"), own.alias("title"), (F.col("terms") if stories else empty).alias("terms"), F.lit(None).cast("string").alias("group")]

    label = F.get(F.array(*map(F.lit, SENTIMENTS)), (F.col("conv_id") % 6).cast("int"))
    example = library.select("conv_id", F.struct(*story("conv_id", "c"), (F.col("conv_id") % 7 > 0).alias("include"), label.alias("label")).alias("example"))
    item = items.select("item_id", F.struct(*story("item_id", "i")).alias("item"))
    return scored.join(example, "conv_id").join(item, "item_id").select(F.col("item_id").alias("query"), F.col("conv_id").alias("example_id"), "score", "item", "example")


def told(found: DataFrame) -> DataFrame:
    return found.select(F.col("query").alias("item_id"), F.col("example_id").alias("conv_id"), "turn", F.round("score", 9).alias("score"))


SCORES = """q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) AS term FROM benchmark),
e AS (SELECT conv_id, unnest(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{7,}'))))) AS term FROM conversations GROUP BY conv_id),
nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), ne AS (SELECT conv_id, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT q.item_id, e.conv_id, count(*) / greatest(1, least(any_value(nq.n), any_value(ne.n))) AS score FROM q JOIN e ON e.term = q.term JOIN nq ON nq.item_id = q.item_id JOIN ne ON ne.conv_id = e.conv_id GROUP BY 1, 2)"""


@query(f"""WITH {SCORES}, l AS (SELECT *, 5 - conv_id % 6 AS place FROM s WHERE conv_id % 7 > 0 AND conv_id % 6 < 5),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id, place ORDER BY score DESC, conv_id) AS nth FROM l),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN nth = 1 THEN place ELSE 6 END, score DESC, conv_id) AS turn FROM n)
SELECT item_id, conv_id, turn::INTEGER AS turn, round(score, 9) AS score FROM t WHERE turn <= 8""")
def seated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest conversation of each label, then the nearest others, eight in all; no two are one story here."""
    return told(choice.choose(choice.eligible(asked(spark, sf_dir, False), "sentiment"), "sentiment", 8))


@query(f"""WITH {SCORES}, n AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN row_number() OVER (PARTITION BY item_id, conv_id % 7 = 0 ORDER BY score DESC, conv_id) END AS nth FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN nth <= 2 THEN nth ELSE 3 END, score DESC, conv_id) AS turn FROM n)
SELECT item_id, conv_id, turn::INTEGER AS turn, round(score, 9) AS score FROM t WHERE turn <= 8""")
def seated_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest rejected conversations, then the nearest of all."""
    return told(choice.choose(choice.eligible(asked(spark, sf_dir, False), "inclusion"), "inclusion", 8))


@query()
def chosen_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations for each item, of which no two share nearly all their words."""
    return told(choice.choose(choice.eligible(asked(spark, sf_dir, True), "sentiment"), "sentiment", 6))
