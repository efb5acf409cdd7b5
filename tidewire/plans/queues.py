"""Queries on queues, orders, pages and bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.operators import selection
from tidewire.plans.registry import query, table


@query("""SELECT event_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20)
UNION ALL SELECT -1 - event_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 20)""")
def run_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "events").where("event_type = 'error'")
    newest = selection.for_run(pending, "ts", "event_id", 5, 4).select("event_id")
    return newest.union(selection.for_run(pending, "ts", "event_id", 5, 4, oldest_first=True).select(-1 - F.col("event_id")))


@query("""WITH k AS (SELECT o_custkey AS key, min(o_orderkey) AS place, bool_or(o_totalprice > 270000) AS live, count(*) FILTER (o_orderpriority = '1-URGENT') > 3 AS scope, bool_or(o_orderstatus = 'O') AS odds FROM orders GROUP BY 1),
a AS (SELECT key, place FROM k WHERE odds ORDER BY place LIMIT 6),
b AS (SELECT key, place FROM k WHERE live AND key NOT IN (SELECT key FROM a) ORDER BY place LIMIT 20),
c AS (SELECT key, place FROM k WHERE scope AND key NOT IN (SELECT key FROM a UNION ALL SELECT key FROM b) ORDER BY place LIMIT 8),
d AS (SELECT key, place FROM k WHERE odds AND key NOT IN (SELECT key FROM a UNION ALL SELECT key FROM b UNION ALL SELECT key FROM c) ORDER BY place LIMIT (SELECT 60 - (SELECT count(*) FROM a) - (SELECT count(*) FROM b) - (SELECT count(*) FROM c)))
SELECT key, 'reserved' AS slot, place FROM a UNION ALL SELECT key, 'primary', place FROM b UNION ALL SELECT key, 'scope', place FROM c UNION ALL SELECT key, 'spare', place FROM d""")
def request_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(
        F.min("o_orderkey").alias("place"), F.bool_or(F.col("o_totalprice") > 270_000).alias("primary"),
        (F.count_if(F.col("o_orderpriority") == "1-URGENT") > 3).alias("scope"), F.bool_or(F.col("o_orderstatus") == "O").alias("odds"),
    )
    return selection.slots(rows, "key", "place", 60, 6, caps={"primary": 20, "scope": 8})


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def unique_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 10""")
def bounded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id")
    return selection.newest_keys(rows, "user_id", "event_id", 10)


@query("""WITH m AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
SELECT o_orderkey, month FROM m WHERE month IN (SELECT DISTINCT month FROM m ORDER BY month DESC LIMIT 6)""")
def newest_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return selection.newest_months(rows, "month", 6)


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_acctbal < 0 THEN 0 ELSE 1 END, s_suppkey)::INTEGER AS rank FROM supplier""")
def alert_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.leading(table(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0, "s_suppkey").select("s_suppkey", "rank")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER () AS n FROM customer)
SELECT c_custkey, rank::INTEGER AS rank, ((n + 19) // 20)::INTEGER AS pages FROM r WHERE rank > 40 AND rank <= 60""")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return selection.page(rows, [F.col("c_acctbal").desc(), F.col("c_custkey")], 3, 20).select("c_custkey", "rank", "pages")


@query("""WITH s AS (SELECT coalesce(CASE WHEN event_type <> 'click' THEN user_id::VARCHAR END, event_id::VARCHAR) AS story, * FROM events),
g AS (SELECT story, max((ts, event_id)) AS x, count(*) AS n FROM s GROUP BY 1)
SELECT story, x[2] AS lead, x[1] AS "at", n FROM g ORDER BY x[1] DESC, story LIMIT 25""")
def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("g", F.when(F.col("event_type") != "click", F.col("user_id")))
    return selection.first_page(rows, "g", "ts", "event_id")


@query("""WITH w AS (SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, week) AS k FROM w) SELECT event_type, week, n FROM r WHERE k = 1""")
def peak_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = table(spark, sf_dir, "events").groupBy("event_type", dates.week_start(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    return selection.peak(weeks, "event_type", "week", "n").withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders), b AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS back FROM m)
SELECT month, CASE back WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE back END::INTEGER AS turn FROM b""")
def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return selection.findings_order(months).withColumn("turn", F.col("turn").cast("int"))


@query("""WITH l AS (SELECT item_id, item_id % 4 AS section, octet_length(encode(coalesce(text, ''))) AS size FROM benchmark),
s AS (SELECT *, sum(size) OVER (ORDER BY section, item_id ROWS UNBOUNDED PRECEDING) + 500 AS upto FROM l) SELECT item_id, section, size::BIGINT AS size FROM s WHERE upto <= 9000""")
def digest_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("section"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return selection.within_bytes(entries, "section", "item_id", "size", 9_000, 500)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10')
SELECT user_id, event_id FROM r WHERE n = 1""")
def excluded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "error").alias("relevant"))
    return selection.excluded_rows(rows, "user_id", "ts", dates.instant("2024-01-10"), "relevant", "event_id").select("user_id", "event_id")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderstatus = 'F' AND o_totalprice >= 50000 AND o_orderpriority <> '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30""")
def excerpt_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    url = F.when(F.col("o_totalprice") < 50_000, "ftp://a").otherwise("https://a.example")
    found = selection.excerpt_candidates(table(spark, sf_dir, "orders"), F.when(key % 6 == 0, False), F.col("o_orderstatus"), "F", url, F.lit(None).cast("boolean"), F.col("o_orderpriority") == "5-LOW", "o_orderdate", "o_orderkey", 30)
    return found.select("o_orderkey", "o_orderdate")
