"""Queries on resolved titles, frozen texts, and small rules of saved state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import frozen, resolve
from tidewire.plans.registry import query, table


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as articles: a title shared by many, outlets by nation, some hand-logged, some of an aggregator."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("pos"), F.concat(F.lit("Title "), F.floor(key / 9), F.lit("!")).alias("title"), F.concat(F.lit("outlet "), key % 4).alias("outlet"),
        F.when(F.col("c_nationkey") % 3 == 0, "news.agg.example").otherwise(F.concat("c_nationkey", F.lit(".example"))).alias("domain"), (F.col("c_acctbal") < 0).alias("curated"), (F.col("c_nationkey") % 3 == 0).alias("aggregated"),
    )


@query()
def resolved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers' articles become one: by title and domain, title and outlet, and what is hand-logged or aggregated."""
    return resolve.resolve_titles(titled(spark, sf_dir), "pos")


@query("""SELECT c_custkey AS pos, min(c_custkey) OVER (PARTITION BY c_custkey // 9, c_nationkey) AS slot FROM customer""")
def plain_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without hand-logged and aggregated rows: the first of a title and domain."""
    rows = titled(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), "c_nationkey"), "pos")
    plain = rows.withColumns({"domain": F.concat("c_nationkey", F.lit(".example")), "curated": F.lit(False), "aggregated": F.lit(False)})
    return resolve.resolve_titles(plain, "pos").select("pos", "slot")


@query(r"""WITH d AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS id, trim(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[\s\x{00a0}]+', ' ', 'g')) AS line, lang, source FROM documents),
s AS (SELECT id, nullif(trim(substr(line, 1, 40)), '') AS excerpt, nullif(CASE WHEN doc_id % 4 = 0 THEN source END, '') AS outlet, nullif(trim(substr(line, 1, 20)), '') AS title FROM d WHERE doc_id % 2 = 0),
v AS (SELECT * FROM s WHERE coalesce(excerpt, outlet, title) IS NOT NULL),
e AS (SELECT d.*, CASE WHEN doc_id % 3 = 0 THEN '' ELSE nullif(substr(line, 1, 700), '') END AS live, nullif(substr(line, 1, 300), '') AS live_title, CASE WHEN doc_id % 5 = 0 THEN 'team feedback' ELSE 'list' END AS provenance, v.excerpt AS k_excerpt, v.outlet AS k_outlet, v.title AS k_title, v.id IS NOT NULL AS there FROM d LEFT JOIN v ON v.id = d.id),
f AS (SELECT *, provenance = 'team feedback' AS t FROM e)
SELECT doc_id, md5(coalesce(k_excerpt, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE line END)) AS excerpt, coalesce(k_outlet, source, '') AS outlet,
  (k_excerpt IS NULL AND nullif(live, '') IS NOT NULL) OR (k_outlet IS NULL AND coalesce(source, '') <> '') OR (t AND k_title IS NULL AND live_title IS NOT NULL) AS added,
  coalesce(k_excerpt <> nullif(live, ''), false) OR coalesce(k_outlet <> nullif(source, ''), false) OR coalesce(t AND k_title <> live_title, false) AS changed,
  (k_excerpt IS NOT NULL AND nullif(live, '') IS NULL) OR (k_outlet IS NOT NULL AND coalesce(source, '') = '') OR (t AND k_title IS NOT NULL AND live_title IS NULL) AS lost FROM f""")
def frozen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as examples, of which every other one has a text saved from before; a third have lost theirs."""
    key, line = F.col("doc_id"), F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(key.cast("string"), 256).alias("id"), line.alias("line"), "source")
    flat = F.trim(F.regexp_replace("line", r"[\s ]+", " "))
    saved = docs.where(key % 2 == 0).select("id", "doc_id", F.substring(flat, 1, 40).alias("excerpt"), F.when(key % 4 == 0, F.col("source")).alias("outlet"), F.substring(flat, 1, 20).alias("title"))
    examples = docs.select("doc_id", "id", F.when(key % 5 == 0, "team feedback").otherwise("list").alias("provenance"), F.when(key % 3 == 0, " ").otherwise(flat).alias("excerpt"), "source", "line")
    examples = examples.withColumnsRenamed({"source": "outlet", "line": "title"})
    out, _ = frozen.freeze(examples, frozen.valid_texts(saved, "doc_id", None), "doc_id", None)
    return out.select("doc_id", F.md5("excerpt").alias("excerpt"), F.coalesce("outlet", F.lit("")).alias("outlet"), "added", "changed", "lost")


@query(r"""WITH p AS (SELECT page_id, url, page_id % 4 AS k FROM pages)
SELECT page_id, CASE WHEN k = 1 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x' WHEN k = 2 THEN 'https://a.example/x' ELSE 'https://a.example/x?utm_medium=y' END AS two,
  k IN (0, 3) AS discovered, CASE WHEN k < 2 THEN k / 2.0 END AS odd FROM p""")
def shown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of links of a story, rows from an aggregator, and odds that are none."""
    kind = F.col("page_id") % 4
    tracked = F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x"))
    first = F.when(kind == 1, tracked).when(kind == 2, "https://a.example/x#y").otherwise("https://a.example/x?utm_medium=y")
    second = F.when(kind == 1, F.concat(tracked, F.lit("#z"))).when(kind == 2, "https://a.example/x").otherwise("https://a.example/x?utm_medium=y#z")
    found = frozen.is_discovery(F.when(kind == 0, "search news Vermont").otherwise("Paper"), F.when(kind == 3, "https://news.agg.example/rss").otherwise("not an address"), "Search News", "news.agg.example")
    odds = frozen.signals({"odd": F.when(kind < 3, kind / 2), "never": F.lit(7.0)})
    return table(spark, sf_dir, "pages").select("page_id", frozen.shown_link(first, second).alias("two"), found.alias("discovered"), F.when(kind < 2, odds["odd"]).alias("odd"))
