"""Queries on digests and monthly reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.operators import rollups
from tidewire.plans.registry import query, table


def month() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM")


@query("""SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS place, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS leads FROM events""")
def story_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return rollups.members(rows, "user_id", "ts", "event_id").select("event_id", "user_id", F.col("place").cast("int").alias("place"), "leads")


@query("""WITH e AS (SELECT event_id, event_type AS by_, user_id AS g, floor(value)::BIGINT % 7 AS t, value AS rank FROM events),
a AS (SELECT *, 1 AS turn FROM (SELECT *, row_number() OVER (PARTITION BY by_ ORDER BY rank DESC, event_id DESC) AS n FROM e) WHERE n = 1),
l AS (SELECT e.* FROM e JOIN a USING (by_) WHERE e.g <> a.g AND e.t <> a.t),
b AS (SELECT *, 2 AS turn FROM (SELECT *, row_number() OVER (PARTITION BY by_ ORDER BY rank DESC, event_id DESC) AS n FROM l) WHERE n = 1),
m AS (SELECT l.* FROM l JOIN b USING (by_) WHERE l.g <> b.g AND l.t <> b.t),
c AS (SELECT *, 3 AS turn FROM (SELECT *, row_number() OVER (PARTITION BY by_ ORDER BY rank DESC, event_id DESC) AS n FROM m) WHERE n = 1)
SELECT by_ AS event_type, event_id, turn FROM a UNION ALL SELECT by_, event_id, turn FROM b UNION ALL SELECT by_, event_id, turn FROM c""")
def story_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("title", (F.floor("value") % 7).cast("string"))
    return rollups.stories(rows, F.col("value"), "user_id", "title", "event_id", 3, by="event_type").select("event_type", "event_id", "turn")


@query("""SELECT count(*) AS total, count(*) - count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') AS visible, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') AS rejected FROM orders""")
def header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") != "F")
    return rollups.header_counts(table(spark, sf_dir, "orders").withColumn("relevant", relevant), "relevant")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS volume, count(DISTINCT coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_custkey::VARCHAR END, 'o' || o_orderkey)) AS stories FROM orders GROUP BY 1""")
def monthly_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumns({"g": F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")), "own": F.concat(F.lit("o"), F.col("o_orderkey"))})
    return rollups.distinct_stories(rows, month(), "g", "own")


@query("""WITH l AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS volume FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1),
s AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (o_orderstatus = 'F') AS volume FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1),
c AS (SELECT *, (month || '-01')::TIMESTAMP >= TIMESTAMP '1998-08-15' - INTERVAL 92 DAY AS complete FROM l)
SELECT coalesce(c.month, s.month) AS month, coalesce(c.volume, s.volume) AS volume FROM s FULL JOIN (SELECT * FROM c WHERE complete) c ON c.month = s.month""")
def recorded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    saved = orders.where(F.col("o_orderdate") < dates.instant("1998-07-01")).groupBy(month().alias("month")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("volume"))
    live = orders.where(F.col("o_orderdate") >= dates.instant("1998-01-01")).groupBy(month().alias("month")).agg(F.count("*").alias("volume"))
    start = F.concat(F.col("month"), F.lit("-01")).cast("timestamp")
    return rollups.record_totals(saved, rollups.whole_months(live, "month", dates.instant("1998-08-15"), 92, start), "month")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS d, count(*) AS volume, count(*) FILTER (o_orderstatus <> 'P') AS scored, avg(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 END) AS net FROM orders GROUP BY 1),
t AS (SELECT d, o_orderpriority AS outlet, n FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n DESC, o_orderpriority) AS k FROM (SELECT date_trunc('month', o_orderdate) AS d, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE k = 1),
p AS (SELECT *, coalesce(lag(volume) OVER (ORDER BY d), 0) AS prior FROM m),
c AS (SELECT *, strftime(d, '%B') AS name, CASE WHEN volume = prior THEN 'the same as the ' || prior || ' in it' ELSE CASE WHEN volume > prior THEN 'up ' ELSE 'down ' END || abs(volume - prior) || CASE WHEN prior > 0 THEN ' (' || abs(floor(100.0 * (volume - prior) / prior + 0.5))::BIGINT || '%)' ELSE '' END || ' from ' || prior || ' in it' END AS clause FROM p)
SELECT strftime(c.d, '%Y-%m') AS month, 'In ' || name || ', ' || volume || CASE WHEN volume = 1 THEN ' story was found, ' ELSE ' stories were found, ' END || clause || '. ' || CASE WHEN scored = 0 THEN 'None of these has been scored yet.' ELSE 'Net sentiment was ' || printf('%+.2f', net + sign(net) * 1e-9) || ', '
  || CASE WHEN net > 0.25 THEN 'leaning favorable' WHEN net < -0.25 THEN 'leaning unfavorable' ELSE 'close to neutral' END || '.' END || ' ' || outlet || ' carried the most coverage, with ' || n || CASE WHEN n = 1 THEN ' story' ELSE ' stories' END || '.' AS text FROM c JOIN t ON t.d = c.d""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    orders = table(spark, sf_dir, "orders").withColumn("d", F.date_trunc("month", "o_orderdate"))
    tone = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", -1)
    counted = orders.groupBy("d").agg(F.count("*").alias("volume"), F.count(tone).alias("scored"), F.avg(tone).alias("net"))
    outlets = orders.groupBy("d", "o_orderpriority").agg(F.count("*").alias("n"))
    top = outlets.groupBy("d").agg(F.min_by(F.struct("o_orderpriority", "n"), F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("top"))
    # One row a month: the window is over months.
    months = counted.withColumn("prior", F.coalesce(F.lag("volume").over(W.orderBy("d")), F.lit(0))).join(top, "d")
    clause = rollups.volume_clause(F.col("volume"), F.col("prior"), F.lit("it"), F.lit(False))
    text = rollups.summary(F.col("volume"), F.date_format("d", "MMMM"), clause, F.col("scored"), F.col("net"), F.col("top.o_orderpriority"), F.col("top.n"))
    return months.select(F.date_format("d", "yyyy-MM").alias("month"), text.alias("text"))


@query("""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_custkey::VARCHAR END, 'row ' || o_orderkey) AS story, max((o_orderdate, o_orderkey)) AS x FROM orders GROUP BY 1, 2),
r AS (SELECT month, x[2] AS o_orderkey, row_number() OVER (PARTITION BY month ORDER BY x[1] DESC, x[2] DESC)::INTEGER AS place FROM s) SELECT * FROM r WHERE place <= 12""")
def findings_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("g", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")))
    return rollups.findings_input(rows, month(), "g", "o_orderdate", "o_orderkey", 12).withColumn("place", F.col("place").cast("int"))


@query("""SELECT o_orderpriority, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) AS scored, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O" FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def frozen_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollups.weekly_labels(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderstatus", ("F", "O"))
    return found.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("""WITH l AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS l, max(turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END AS roles, last FROM l""")
def joined_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.max("turn").alias("last"))
    return found.select("conv_id", rollups.joined_list(F.col("roles")).alias("roles"), "last")


@query(r"""WITH o AS (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP AS t, o_orderpriority AS section, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS g, o_orderstatus AS outlet, o_totalprice AS score FROM orders),
s AS (SELECT *, coalesce('story ' || g, 'row ' || k) AS story FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY t DESC, k DESC) AS n, count(*) OVER (PARTITION BY story) AS members FROM s)
SELECT story, CASE section WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END::INTEGER AS place, section, t AS "at", k AS lead, outlet, CASE WHEN section = '1-URGENT' THEN 'neutral' END AS label, CASE WHEN section = '1-URGENT' THEN score END AS score, members - 1 AS others
FROM r WHERE n = 1 AND section IN ('1-URGENT', '3-MEDIUM', '5-LOW')""")
def digest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports, customers as stories: the entries of three sections, and how many other reports each has."""
    orders = table(spark, sf_dir, "orders").withColumns({"g": F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")), "at": F.col("o_orderdate").cast("timestamp"), "label": F.lit("neutral")})
    entries, others = rollups.digest(orders, "g", "o_orderpriority", "at", "o_orderkey", {"outlet": F.col("o_orderstatus")}, ["1-URGENT", "3-MEDIUM", "5-LOW"], "1-URGENT", "label", "o_totalprice")
    more = others.groupBy("story").agg(F.count("*").alias("others"))
    return entries.join(more, "story", "left").withColumns({"others": F.coalesce("others", F.lit(0)), "place": F.col("place").cast("int")})
