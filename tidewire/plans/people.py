"""Queries on votes and mail lists: customers are members and subscribers, events what they did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.operators import feedback, mail, quotes
from tidewire.plans.registry import query, table


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as votes of users on items: errors drop, purchases keep, views correct the label."""
    kind = F.col("event_type")
    item = F.sha2((F.col("event_id") % 97).cast("string"), 256)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("member"), item.alias("item"), "ts",
        F.when(kind == "error", "drop").when(kind == "purchase", "keep").when(kind == "view", "sentiment").when(kind == "click", "other").alias("vote"),
        F.when(kind == "view", F.when(F.col("value") > 100, "positive").when(F.col("value") > 40, "neutral").otherwise("odd")).alias("label"),
    )


VOTES = """v AS (SELECT event_id, user_id AS member, sha256((event_id % 97)::VARCHAR) AS item, ts, CASE event_type WHEN 'error' THEN 'drop' WHEN 'purchase' THEN 'keep' WHEN 'view' THEN 'sentiment' WHEN 'click' THEN 'other' END AS vote,
  CASE WHEN event_type = 'view' THEN CASE WHEN value > 100 THEN 'positive' WHEN value > 40 THEN 'neutral' ELSE 'odd' END END AS label FROM events)"""


@query(f"""WITH {VOTES} SELECT event_id, coalesce(vote IN ('keep', 'drop') OR (vote = 'sentiment' AND label <> 'odd'), false) AS valid FROM v""")
def vote_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.parse_export(votes(spark, sf_dir), "item", "vote", "label", "ts").select("event_id", "valid")


@query(f"""WITH {VOTES}, m AS (SELECT DISTINCT user_id AS member, user_id % 3 = 0 AS blocked FROM events)
SELECT event_id, 'export' AS list FROM (SELECT event_id FROM v JOIN m ON m.member = v.member WHERE NOT blocked ORDER BY ts DESC, event_id DESC LIMIT 300)
UNION ALL SELECT event_id, 'admin' FROM (SELECT event_id FROM v JOIN m ON m.member = v.member ORDER BY ts DESC, event_id LIMIT 200)""")
def vote_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = votes(spark, sf_dir)
    members = rows.select("member").distinct().withColumn("blocked", F.col("member") % 3 == 0)
    export = feedback.export_votes(rows, members, "member", "blocked", "ts", "event_id", 300)
    admin = feedback.admin_list(rows, members, "member", "ts", "event_id", 200)
    return export.select("event_id", F.lit("export").alias("list")).union(admin.select("event_id", F.lit("admin").alias("list")))


@query(f"""WITH {VOTES}, c AS (SELECT member, count(DISTINCT item) AS n FROM v GROUP BY 1),
k AS (SELECT count(*) FILTER (vote = 'keep') AS keep, count(*) FILTER (vote = 'drop') AS drop_, count(*) FILTER (vote = 'sentiment') AS sentiment FROM v)
SELECT member, n, n >= 60 AS full_, keep, drop_, sentiment FROM c CROSS JOIN k""")
def vote_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = votes(spark, sf_dir)
    counted = feedback.per_member(rows, "member", "item", 60).withColumnRenamed("full", "full_")
    return counted.crossJoin(F.broadcast(feedback.by_vote(rows, "vote").withColumnRenamed("drop", "drop_")))


@query(f"""WITH {VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY member, item ORDER BY ts DESC, event_id DESC) AS n FROM v) SELECT member, item, event_id, vote, label FROM r WHERE n = 1""")
def current_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.current_votes(votes(spark, sf_dir), "member", "item", "ts", "event_id").drop("ts")


@query("""WITH s AS (SELECT c_custkey AS item, CASE c_mktsegment WHEN 'BUILDING' THEN 'keep' WHEN 'FURNITURE' THEN 'drop' END AS inclusion, CASE WHEN c_acctbal > 0 THEN 'neutral' END AS sentiment FROM customer)
SELECT item, inclusion AS vote, NULL::VARCHAR AS label FROM s WHERE inclusion IS NOT NULL UNION ALL SELECT item, 'sentiment', sentiment FROM s WHERE sentiment IS NOT NULL""")
def votes_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.when(segment == "BUILDING", "keep").when(segment == "FURNITURE", "drop").alias("inclusion"), F.when(F.col("c_acctbal") > 0, "neutral").alias("sentiment"))
    return feedback.in_force(state)


@query("""WITH i AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 = 1 END AS relevant FROM customer),
w AS (SELECT o_custkey AS c_custkey, bool_or(o_orderstatus = 'F') AS want FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
h AS (SELECT o_custkey AS c_custkey, max(o_orderkey) % 2 = 0 AS applied, max(o_orderkey) % 3 = 0 AS baseline FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1),
j AS (SELECT i.*, want, applied, baseline, i.c_custkey % 10 = 0 AS p, i.c_custkey % 7 = 0 AS b FROM i LEFT JOIN w USING (c_custkey) LEFT JOIN h USING (c_custkey)),
k AS (SELECT *, applied IS NOT NULL AND applied IS DISTINCT FROM want AS undone, want IS NOT NULL AND NOT (p OR (b AND want)) AS takes FROM j)
SELECT c_custkey, CASE WHEN takes THEN want WHEN undone THEN baseline ELSE relevant END AS relevant,
  CASE WHEN applied IS NOT NULL AND NOT undone THEN baseline WHEN takes THEN CASE WHEN undone THEN baseline ELSE relevant END END AS baseline, takes OR (applied IS NOT NULL AND NOT undone) AS in_force,
  CASE WHEN want IS NOT NULL AND p THEN 'protected' WHEN want AND b THEN 'blocked' WHEN takes AND applied IS NOT NULL AND NOT undone THEN 'kept' WHEN takes THEN 'applied' WHEN undone THEN 'reverted' END AS change FROM k""")
def settled_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 4 > 0, key % 4 == 1).alias("relevant"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    wanted = orders.where("o_orderpriority = '1-URGENT'").groupBy("c_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("want"))
    last = F.max("o_orderkey")
    had = orders.where("o_orderpriority = '2-HIGH'").groupBy("c_custkey").agg((last % 2 == 0).alias("applied"), (last % 3 == 0).alias("baseline"))
    return feedback.settle(items, wanted, had, "c_custkey", "relevant", key % 10 == 0, key % 7 == 0)


def library(frame: DataFrame, include: Column, sentiment: Column, provenance: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return frame.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://a.example/"), F.col("doc_id")).alias("url"), F.get(F.split(text, "\n"), F.lit(0)).alias("title"), F.col("source").alias("outlet"), text.alias("excerpt"),
        F.lit(provenance).alias("context"), include.alias("include"), sentiment.alias("sentiment"), F.lit(provenance).alias("provenance"),
    )


@query("""WITH e AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10))[1] AS title, CASE WHEN lang = 'en' THEN 'neutral' END AS sentiment FROM documents WHERE lang IN ('en', 'de')),
t AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10))[1] AS title, doc_id % 2 = 0 AS include, CASE WHEN doc_id % 4 = 0 THEN 'positive' END AS sentiment FROM documents WHERE lang IN ('de', 'fr') AND string_split(coalesce(text, ''), chr(10))[1] <> '')
SELECT coalesce(t.id, e.id) AS id, CASE WHEN t.id IS NULL THEN true ELSE t.include END AS include,
  CASE WHEN t.id IS NOT NULL AND (e.id IS NULL OR NOT t.include) THEN t.sentiment ELSE coalesce(t.sentiment, e.sentiment) END AS sentiment,
  CASE WHEN t.id IS NOT NULL AND (e.id IS NULL OR NOT t.include) THEN 'team' WHEN t.id IS NOT NULL THEN 'list + team feedback' ELSE 'list' END AS provenance FROM e FULL JOIN t ON e.id = t.id""")
def merged_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    own = library(docs.where("lang IN ('en', 'de')"), F.lit(True), F.when(F.col("lang") == "en", "neutral"), "list")
    team = library(docs.where("lang IN ('de', 'fr')"), key % 2 == 0, F.when(key % 4 == 0, "positive"), "team")
    return feedback.merge_examples(own, team).select("id", "include", "sentiment", "provenance")


@query("""WITH s AS (SELECT user_id, lower(event_type) AS k, min(event_id) AS place, max((event_id, value)) AS x FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS n FROM s) SELECT user_id, place, k AS name, x[2] AS value FROM r WHERE n <= 3""")
def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("name"), "value")
    found = feedback.saved_searches(rows, "user_id", "name", "event_id", 3)
    return found.select("user_id", F.col("event_id").alias("place"), "name", "value")


SUBSCRIPTIONS = """e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'request' WHEN 'purchase' THEN 'confirm' ELSE 'unsubscribe' END AS kind, (event_id % 5)::VARCHAR AS nonce, [(['alerts', 'digest', 'monthly'])[(event_id % 3)::INTEGER + 1]] AS lists
  FROM events WHERE event_type IN ('signup', 'purchase') OR (event_type = 'error' AND value < 30))"""


@query(f"""WITH {SUBSCRIPTIONS}, q AS (SELECT user_id, arg_max(nonce, (ts, event_id)) AS want FROM e WHERE kind = 'request' GROUP BY 1),
v AS (SELECT e.* FROM e LEFT JOIN q USING (user_id) WHERE kind <> 'confirm' OR nonce IS NOT DISTINCT FROM want),
o AS (SELECT user_id, max((ts, event_id)) FILTER (kind = 'unsubscribe') AS out_, max((ts, event_id)) FILTER (kind = 'confirm') AS in_, min(ts) FILTER (kind = 'confirm') AS confirmed_at FROM v GROUP BY 1),
l AS (SELECT user_id, list_sort(list_distinct(flatten(list(lists)))) AS lists FROM v JOIN o USING (user_id) WHERE kind = 'confirm' AND (out_ IS NULL OR (ts, event_id) > out_) GROUP BY 1),
s AS (SELECT *, CASE WHEN in_ IS NULL THEN false WHEN out_ IS NULL THEN true ELSE in_ > out_ END AS active FROM o)
SELECT user_id, CASE WHEN active THEN 'active' WHEN out_ IS NOT NULL THEN 'unsubscribed' ELSE 'pending' END AS status, confirmed_at, CASE WHEN NOT active THEN out_[1] END AS unsubscribed_at, coalesce(array_to_string(lists, ','), '') AS lists
FROM s LEFT JOIN l USING (user_id)""")
def subscription_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").where("event_type IN ('signup', 'purchase') OR (event_type = 'error' AND value < 30)")
    lists = F.array(F.element_at(F.array(*map(F.lit, ("alerts", "digest", "monthly"))), (F.col("event_id") % 3 + 1).cast("int")))
    events = rows.select("event_id", "user_id", "ts", F.when(kind == "signup", "request").when(kind == "purchase", "confirm").otherwise("unsubscribe").alias("kind"), (F.col("event_id") % 5).cast("string").alias("nonce"), lists.alias("lists"))
    return mail.subscribers(events, "user_id", "ts", "event_id").withColumn("lists", F.array_join("lists", ","))


def sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a send log: a row per customer and priority."""
    status = F.when(F.max("o_orderstatus") == "P", "sent").when(F.min("o_orderstatus") == "F", "failed").otherwise("sending")
    return table(spark, sf_dir, "orders").where("o_orderpriority < '4'").groupBy("o_custkey", "o_orderpriority").agg(status.alias("status"), F.count("*").alias("attempts"))


SENDS = """s AS (SELECT o_custkey, o_orderpriority, CASE WHEN max(o_orderstatus) = 'P' THEN 'sent' WHEN min(o_orderstatus) = 'F' THEN 'failed' ELSE 'sending' END AS status, count(*) AS attempts FROM orders WHERE o_orderpriority < '4' GROUP BY 1, 2)"""


@query(f"""WITH {SENDS}, w AS (SELECT c_custkey AS o_custkey, p AS o_orderpriority FROM customer CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS p) WHERE c_acctbal > 0),
c AS (SELECT w.*, coalesce(attempts, 0) + 1 AS attempt FROM w LEFT JOIN s USING (o_custkey, o_orderpriority) WHERE status IS NULL OR (status = 'failed' AND attempts < 3))
SELECT coalesce(s.o_custkey, c.o_custkey) AS o_custkey, coalesce(s.o_orderpriority, c.o_orderpriority) AS o_orderpriority, CASE WHEN attempt IS NOT NULL THEN 'sending' ELSE status END AS status, coalesce(attempt, attempts) AS attempts
FROM s FULL JOIN c ON s.o_custkey = c.o_custkey AND s.o_orderpriority = c.o_orderpriority""")
def send_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_custkey", "o_orderpriority"]
    log = sends(spark, sf_dir)
    people = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    wanted = people.select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM")))).alias("o_orderpriority"))
    return mail.merge_claims(log, mail.claims(log, wanted, keys), keys)


@query(f"""WITH {SENDS}, o AS (SELECT o_custkey, o_orderpriority, CASE o_custkey % 4 WHEN 0 THEN 'E_RECIPIENT_SUPPRESSED' WHEN 1 THEN 'E_DAILY_LIMIT_EXCEEDED' WHEN 2 THEN 'E_OTHER' END AS code FROM s WHERE status = 'sending'),
x AS (SELECT *, CASE WHEN code IS NULL THEN 'sent' WHEN code = 'E_RECIPIENT_SUPPRESSED' THEN 'suppressed' WHEN code = 'E_DAILY_LIMIT_EXCEEDED' THEN 'stop' ELSE 'failed' END AS outcome FROM o),
d AS (SELECT s.o_custkey, s.o_orderpriority, CASE WHEN outcome = 'stop' THEN 'failed' ELSE coalesce(outcome, status) END AS status, CASE WHEN outcome = 'stop' THEN attempts - 1 ELSE attempts END AS attempts FROM s LEFT JOIN x USING (o_custkey, o_orderpriority))
SELECT o_orderpriority, count(*) FILTER (status = 'sent') AS sent, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'failed' AND attempts < 3) AS left_, sum(attempts)::BIGINT AS attempts,
  CASE WHEN count(*) FILTER (status = 'failed' AND attempts < 3) = 0 THEN 'done' ELSE 'partial' END AS status FROM d GROUP BY 1""")
def send_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, log = ["o_custkey", "o_orderpriority"], sends(spark, sf_dir)
    code = F.when(F.col("o_custkey") % 4 == 0, "E_RECIPIENT_SUPPRESSED").when(F.col("o_custkey") % 4 == 1, "E_DAILY_LIMIT_EXCEEDED").when(F.col("o_custkey") % 4 == 2, "E_OTHER")
    done = mail.settle(log, log.where("status = 'sending'").select(*keys, code.alias("code")), keys)
    found = mail.jobs(done, done.where("status = 'failed' AND attempts < 3"), ["o_orderpriority"])
    return found.join(done.groupBy("o_orderpriority").agg(F.sum("attempts").alias("attempts")), "o_orderpriority").withColumnRenamed("left", "left_")


@query("""WITH e AS (SELECT event_id, ts, hour(ts) * 60 + minute(ts) AS m, value FROM events)
SELECT event_id, m >= 625 AND m < 955 AND NOT (value > 60) AS late, CASE WHEN ts > TIMESTAMP '2024-01-15 06:00:00' THEN 'future' WHEN ts < TIMESTAMP '2024-01-14 00:00:00' THEN 'stale' ELSE '' END AS refused,
  greatest(60, (epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-03-01'))::BIGINT + 2592000)::BIGINT AS seconds FROM e""")
def delivery_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, now = F.col("ts").cast("timestamp"), dates.instant("2024-01-15")
    done = F.when(F.col("value") > 60, F.date_trunc("day", ts))
    return table(spark, sf_dir, "events").select("event_id", mail.catch_up(ts, done, 600).alias("late"), mail.freshness(ts, now, 24).alias("refused"), mail.time_to_live(ts, dates.instant("2024-03-01")).alias("seconds"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN 'unsubscribed' ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'unsubscribed' ELSE 'active' END END AS status,
  CASE WHEN c_acctbal < 0 AND c_mktsegment <> 'BUILDING' THEN TIMESTAMP '2024-02-01' WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '2024-01-01' END AS unsubscribed_at, CASE WHEN c_acctbal < 0 THEN '' ELSE 'digest' END AS lists FROM customer""")
def unsubscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("c_mktsegment") == "BUILDING"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(left, "unsubscribed").otherwise("active").alias("status"), F.when(left, dates.instant("2024-01-01")).alias("unsubscribed_at"), F.array(F.lit("digest")).alias("lists"), "c_acctbal")
    found = mail.unsubscribed(rows, rows.where("c_acctbal < 0"), "c_custkey", dates.instant("2024-02-01"))
    return found.select("c_custkey", "status", "unsubscribed_at", F.array_join("lists", ",").alias("lists"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'digest,monthly' WHEN 1 THEN '' END AS lists FROM customer""")
def chosen_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    given = F.when(kind == 0, F.array(*map(F.lit, (" Monthly", "digest", "DIGEST ")))).when(kind == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("digest"), F.lit("other")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(mail.known_lists(given, ("digest", "alerts", "monthly")), ",").alias("lists"))


@query("""WITH n AS (SELECT n_nationkey, 'Ann ' || n_name AS name FROM nation), t AS (SELECT c_custkey, c_custkey % 7 AS kind, c_nationkey FROM customer)
SELECT c_custkey, name, 'Head ' || n_nationkey AS title FROM t JOIN n ON n_nationkey = c_nationkey WHERE kind IN (0, 3, 5)""")
def quoted_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Ann "), "n_name").alias("name"))
    people = nation.select("name", F.array().cast("array<string>").alias("aliases"), F.concat(F.lit("Head "), "n_nationkey").alias("title"), F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("until"))
    kind, name = F.col("c_custkey") % 7, F.col("name")
    family = F.regexp_replace("name", "^Ann ", "")
    text = (
        F.when(kind == 0, F.concat(name, F.lit(" said costs rose.")))
        .when(kind == 1, F.concat(F.lit("Lawmakers told "), name, F.lit(" about it.")))
        .when(kind == 2, F.concat(F.lit('"We grow," said '), name, F.lit(", chief of Fairview.")))
        .when(kind == 3, F.concat(name, F.lit(" leads it. "), family, F.lit(" added that it works.")))
        .when(kind == 4, F.concat(F.lit("Mayor "), name, F.lit(" said so.")))
        .when(kind == 5, F.concat(F.lit("Costs rise, according to "), name, F.lit(".")))
    )
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.alias("text"), F.lit(None).cast("timestamp").alias("at"))
    return quotes.quoted_people(rows, people, "c_custkey", ["text"], "at")
