"""Queries on alerts and what is shown of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.operators import alerts, rollups
from tidewire.plans.registry import query, table


@query("""WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), t AS (SELECT DISTINCT n_name AS target FROM nation WHERE n_regionkey = 1),
d AS (SELECT DISTINCT n_name AS target, c_custkey AS o_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT t.target, a.o_custkey FROM a CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.target = t.target AND d.o_custkey = a.o_custkey)""")
def undelivered_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    accepted = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("target"), F.col("c_custkey").alias("o_custkey"))
    targets = nation.where("n_regionkey = 1").select(F.col("n_name").alias("target"))
    return alerts.undelivered(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), accepted, targets, "o_custkey", "target")


@query("""WITH p AS (SELECT user_id, max(ts) AS made FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 150),
o AS (SELECT user_id FROM p WHERE made > TIMESTAMP '2024-01-20' - INTERVAL 600 MINUTE UNION SELECT user_id FROM f)
SELECT user_id, TIMESTAMP '2024-01-20' AS made FROM o""")
def alert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, now = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), dates.instant("2024-01-20")
    prior = events.where(F.col("ts") < now).groupBy("user_id").agg(F.max("ts").alias("made"))
    fresh = events.where("event_type = 'error' AND value > 150").select("user_id").distinct()
    return alerts.published(alerts.next_batch(prior, fresh, now, "user_id", "made", 600), now, "made")


@query(r"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Untitled' ELSE o_orderpriority END AS title, CASE WHEN o_orderstatus = 'O' THEN 'https://a.example' ELSE '' END AS url, 'Out let' AS outlet,
  CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'negative' ELSE 'not yet scored' END WHEN o_orderkey % 2 = 0 THEN 'negative (score ' || floor(o_orderkey % 100 + 0.5 + 0.5)::BIGINT || ')' ELSE 'score ' || floor(o_orderkey % 100 + 0.5 + 0.5)::BIGINT END AS sentiment,
  CASE WHEN o_orderkey % 5 = 0 THEN 'snip' ELSE 'sum' END AS summary, o_orderkey % 2 = 0 OR (o_orderkey % 3 <> 0 AND o_orderkey % 100 + 0.5 < 35) AS urgent FROM orders""")
def described_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    found = alerts.described(
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")), F.when(F.col("o_orderstatus") == "O", "https://a.example").otherwise("javascript:x"), F.lit(" Out  let"),
        F.when(key % 2 == 0, "negative").otherwise(""), F.when(key % 3 != 0, key % 100 + 0.5), F.when(key % 5 != 0, "sum"), F.lit("snip"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("d")).select("o_orderkey", "d.*")


@query("""WITH r AS (SELECT c_nationkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS n FROM customer)
SELECT c_nationkey, '<p><strong>Also covered by:</strong> ' || string_agg('<a href="https://a.example/?x&amp;y" title="' || c_name || '">' || c_mktsegment || '</a>', ' · ' ORDER BY n) || '</p>' AS html FROM r WHERE n BETWEEN 2 AND 4 GROUP BY 1""")
def related_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumns({"at": F.lit(None).cast("timestamp"), "link": F.lit("https://a.example/?x&y")})
    placed = rollups.members(rows, "c_nationkey", "at", "c_custkey")
    return alerts.also_covered(placed, "c_nationkey", "place", "link", "c_name", "c_mktsegment", 3)


@query("""WITH RECURSIVE l AS (SELECT s_suppkey AS p, s_name || chr(10) AS x, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
f AS (SELECT i, x AS body, 0 AS message FROM l WHERE i = 1 UNION ALL SELECT l.i, CASE WHEN len(f.body) + len(l.x) <= 93 THEN f.body || l.x ELSE l.x END, f.message + CASE WHEN len(f.body) + len(l.x) <= 93 THEN 0 ELSE 1 END FROM f JOIN l ON l.i = f.i + 1)
SELECT message::INTEGER AS message, 'Header:' || arg_max(body, i) AS body FROM f GROUP BY 1""")
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat("s_name", F.lit("\n")).alias("line"))
    return alerts.packed(lines, "s_suppkey", "line", "Header:", 100)


@query("""WITH o AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS day, lower(strftime(d, '%A')) AS weekday, (year(d) + year(d) % 2)::INTEGER AS session, strftime(d, '%Y-%m-%d') AS written,
  CASE WHEN (strftime(d, '%m-%d') >= '07-01') THEN CASE WHEN lower(strftime(make_date(1996, month(d), day(d)), '%A')) = 'monday' THEN '1996-' || strftime(d, '%m-%d') WHEN lower(strftime(make_date(1997, month(d), day(d)), '%A')) = 'monday' THEN '1997-' || strftime(d, '%m-%d') END
    WHEN lower(strftime(try_cast('1997-' || strftime(d, '%m-%d') AS DATE), '%A')) = 'monday' THEN '1997-' || strftime(d, '%m-%d') END AS guessed FROM o""")
def written_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    month, day, today = F.date_format("d", "MMMM"), F.dayofmonth("d"), F.lit("1996-07-01").cast("date")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    written = alerts.dated(month, day, F.year("d"), alerts.weekday(F.col("d")), today)
    guessed = alerts.dated(month, day, F.lit(None).cast("int"), F.lit("Monday"), today)
    return days.select(text("d").alias("day"), alerts.weekday(F.col("d")).alias("weekday"), alerts.session_key(F.col("d")).alias("session"), text(written).alias("written"), text(guessed).alias("guessed"))


@query(r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://sub.state.example/m' || page_id ELSE url END AS link, CASE WHEN page_id % 2 = 0 THEN 'Budget' ELSE 'Board meeting. Budget' END AS body,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE 'all' END AS section FROM (SELECT page_id, url FROM pages)""")
def agency_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("page_id") % 2 == 0
    text = F.concat(F.when(even, F.lit("The Title\n")).otherwise("Board meeting\n"), F.lit("9:00 am - 10:30am\nBudget https://other.example/x\nhttps://sub.state.example/m"), F.when(even, F.col("page_id").cast("string")).otherwise(""), F.lit("\nMeeting Location: hall"))
    link = alerts.agency_link(F.when(even, text).otherwise("no address"), "state.example", F.col("url"))
    valid = alerts.valid_filter(F.lit(" q "), F.when(F.col("page_id") % 3 == 0, "").otherwise("odd"), F.lit("2024-02-30"), F.lit("2024-02-28"), ("", "news"))
    return table(spark, sf_dir, "pages").select("page_id", link.alias("link"), alerts.agency_text(text, F.lit("the title")).alias("body"), valid["section"].alias("section"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x{00a0}]+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, rtrim(substr(t, 1, 197)) AS head FROM c)
SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\bder\b') THEN '' WHEN len(t) <= 200 THEN t ELSE rtrim(regexp_replace(head, ' [^ ]*$', '')) || '...' END AS preview FROM h""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", alerts.preview(F.col("text"), r"(?i)\bder\b", 200).alias("preview"))
