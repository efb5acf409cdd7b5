"""Queries on libraries of examples, cached answers, and repairs of published rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.operators import examples, repair
from tidewire.plans.registry import query, table



def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a hand-kept list: three rows to an address, some without a title."""
    key = (F.col("doc_id") / 3).cast("long")
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").where("lang = 'en'").select(
        F.concat(F.lit("https://www.news.example/"), key, F.lit("?utm_source=x")).alias("url"), F.get(F.split(text, "\n"), F.lit(0)).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("outlet"),
        F.col("lang").alias("topic"), F.col("doc_id").alias("place"), F.when(F.col("doc_id") % 4 < 2, "positive").when(F.col("doc_id") % 4 == 2, "neutral").alias("label"),
    )


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").where("lang <> 'de'").select(
        F.concat(F.lit("http://news.example/"), (F.col("doc_id") / 3).cast("long"), F.lit("#top")).alias("link"), F.get(F.split(text, "\n"), F.lit(0)).alias("title"), F.col("source").alias("source"), F.col("source").alias("outlet"), text.alias("snippet"), F.lit("d").alias("description"),
    )


SEED = r"""s AS (SELECT 'news.example/' || (doc_id // 3) AS address, string_split(coalesce(text, ''), chr(10))[1] AS title, CASE WHEN doc_id % 2 = 0 THEN source END AS outlet, lang AS topic, doc_id AS place,
  CASE WHEN doc_id % 4 < 2 THEN 'positive' WHEN doc_id % 4 = 2 THEN 'neutral' END AS label FROM documents WHERE lang = 'en'),
l AS (SELECT address, count(DISTINCT label) AS labels FROM s GROUP BY 1), u AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY place) AS n FROM s WHERE trim(regexp_replace(title, '[\s\x{00a0}]+', ' ', 'g')) <> '')"""


@query(f"""WITH {SEED} SELECT sha256(u.address) AS id, place, labels > 1 AS conflict, CASE WHEN labels <= 1 THEN label END AS sentiment FROM u JOIN l ON l.address = u.address WHERE n = 1""")
def reference_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seed(spark, sf_dir).withColumn("topic", F.col("place").cast("string"))
    found = examples.references(rows, archive(spark, sf_dir), F.col("label"))
    return found.select("id", F.col("context").cast("long").alias("place"), "conflict", "sentiment")


@query(rf"""WITH {SEED}, a AS (SELECT 'news.example/' || (doc_id // 3) AS address, string_split(coalesce(text, ''), chr(10))[1] AS title, doc_id, lang FROM documents WHERE lang <> 'de'),
r AS (SELECT DISTINCT sha256('news.example/' || (doc_id // 3)) AS id FROM documents WHERE lang IN ('fr', 'de'))
SELECT DISTINCT sha256(address) AS id, false AS include FROM a WHERE trim(regexp_replace(title, '[\s\x{{00a0}}]+', ' ', 'g')) <> '' AND sha256(address) IN (SELECT id FROM r) AND address NOT IN (SELECT address FROM u)""")
def rejection_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = examples.references(seed(spark, sf_dir), archive(spark, sf_dir), F.col("label"))
    rejected = table(spark, sf_dir, "documents").where("lang IN ('fr', 'de')").select(F.sha2(F.concat(F.lit("news.example/"), (F.col("doc_id") / 3).cast("long")), 256).alias("id"))
    return examples.rejections(archive(spark, sf_dir), rejected, own).select("id", "include")


@query("""WITH k AS (SELECT conv_id, turn, sha256('["v1",' || to_json(role) || ',' || to_json((turn % 3)::VARCHAR) || ']') AS story FROM conversations)
SELECT conv_id, turn, substr(story, 1, 12) AS story, sha256(story || '|' || '[["' || conv_id || '","true"],["x",""]]') AS request FROM k""")
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    story = examples.story_key(F.lit("v1"), F.col("role"), F.col("turn") % 3)
    carried = F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit(True).alias("label")), F.struct(F.lit("x").alias("id"), F.lit(None).cast("boolean").alias("label")))
    key = examples.request_key(story, examples.signature(carried))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", examples.short_key(story).alias("story"), key.alias("request"))


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 195), s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 185)
SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM a) THEN 'referenceChanged' WHEN user_id IN (SELECT user_id FROM s) THEN 'unanswered' ELSE 'storyChanged' END AS miss FROM events""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    answered, seen = events.where("value > 195").select("user_id"), events.where("event_type = 'error' AND value > 185").select("user_id")
    return examples.classify_misses(events.select("event_id", "user_id"), "user_id", answered, seen).select("event_id", "miss")


@query("""WITH c AS (SELECT o_orderkey AS key, o_custkey AS request, CASE WHEN o_orderpriority < '3' THEN o_orderstatus END AS label FROM orders WHERE o_totalprice > 120000),
h AS (SELECT request, min(label) AS label FROM c WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) = 1)
SELECT o_orderkey AS key, coalesce(c.label, h.label) AS label FROM orders o LEFT JOIN c ON c.key = o.o_orderkey AND c.request = o.o_custkey LEFT JOIN h ON h.request = o.o_custkey""")
def saved_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("request"), F.when(F.col("o_orderpriority") < "3", F.col("o_orderstatus")).alias("label"), (F.col("o_totalprice") > 120_000).alias("dear"))
    return examples.evidence(rows.select("key", "request"), rows.where("dear"), "key", "request", ["label"]).select("key", "label")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN false ELSE value <= 100 END AS valid, ts >= TIMESTAMP '2024-01-15' AS enforces FROM events""")
def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("value") / 200
    odds = F.create_map(F.lit("yes"), 1 - share, F.lit("no"), share)
    choice = F.when(F.col("event_type") != "view", "yes").otherwise("perhaps")
    valid = examples.valid_answer(choice, F.lit(0.5), odds, ["yes", "no"])
    return table(spark, sf_dir, "events").select("event_id", valid.alias("valid"), examples.may_enforce(F.col("ts"), dates.instant("2024-01-15")).alias("enforces"))


@query("""SELECT o_orderkey, o_orderkey % 5 = 0 AND (o_orderpriority = '1-URGENT' OR o_orderkey % 3 = 0) AS rejudged,
  NOT (o_orderkey % 2 = 0) AND NOT (o_orderkey % 3 = 0 AND o_orderdate > TIMESTAMP '1998-01-01') AS rewritten,
  CASE WHEN o_orderkey % 7 = 0 THEN 'mediaTracker' WHEN o_orderkey % 2 = 0 THEN 'searchFallback' ELSE '' END AS source FROM orders""")
def rewrite_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    fresh = F.array(F.col("o_orderpriority"))
    known = F.array(*map(F.lit, ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    rejudged = examples.needs_rejudging(key % 5 > 0, known, fresh, F.lit("A  title"), F.when(key % 3 == 0, "Another").otherwise("a title"))
    made = F.col("o_orderdate")
    cached = F.when(key % 2 == 0, "h").when(key % 3 == 0, "other")
    rewritten = examples.needs_findings(F.lit("h"), cached, F.lit(None).cast("string"), made, made, dates.instant("1998-01-02"), F.lit(True))
    stand = examples.fallback(key % 7 == 0, F.array(F.lit("topic")), F.when(key % 2 == 0, F.array(F.lit("term"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", rejudged.alias("rejudged"), rewritten.alias("rewritten"), stand["source"].alias("source"))


@query("""SELECT o_custkey, count(DISTINCT o_orderkey) AS aliases, min(o_orderkey) AS least, sha256(min(o_orderpriority)) AS request_hash, min(o_orderpriority) <> max(o_orderpriority) AS collides FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def repair_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return repair.freeze(rows, "o_custkey", "o_orderkey", "o_orderpriority", ["o_orderkey", "o_totalprice"]).drop("baseline")


@query("""WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT f.o_custkey, CASE WHEN r.n IS NULL THEN 'gone' ELSE 'changed' END AS state FROM f LEFT JOIN r USING (o_custkey) WHERE f.n IS DISTINCT FROM r.n""")
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    frozen, rebuilt = (repair.freeze(x, "o_custkey", "o_orderkey", "o_orderstatus", ["o_orderkey"]) for x in (rows, rows.where("o_orderpriority <> '1-URGENT'")))
    return repair.unchanged_targets(frozen, rebuilt, "o_custkey")


ATTEMPTS = """t AS (SELECT c_custkey AS key, c_mktsegment AS request_hash FROM customer),
c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN 'other' ELSE c_mktsegment END AS request_hash, CASE c_custkey % 8 WHEN 0 THEN 'failed' WHEN 4 THEN 'odd' ELSE 'succeeded' END AS status FROM customer WHERE c_acctbal > 5000)"""


def attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    targets = customer.select(key.alias("key"), F.col("c_mktsegment").alias("request_hash"))
    status = F.when(key % 8 == 0, "failed").when(key % 8 == 4, "odd").otherwise("succeeded")
    tried = customer.where("c_acctbal > 5000").select(key.alias("key"), F.when(key % 9 == 0, "other").otherwise(F.col("c_mktsegment")).alias("request_hash"), status.alias("status"))
    return targets, tried


@query(f"""WITH {ATTEMPTS} SELECT c.key, CASE WHEN c.request_hash <> t.request_hash THEN 'other request' WHEN status = 'odd' THEN 'unknown state' WHEN status = 'succeeded' AND c.key % 5 = 0 THEN 'invalid result' END AS why
FROM c JOIN t USING (key) WHERE c.request_hash <> t.request_hash OR status = 'odd' OR (status = 'succeeded' AND c.key % 5 = 0)""")
def attempt_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, tried = attempts(spark, sf_dir)
    return repair.invalid_attempts(tried, targets, "key", "request_hash", F.col("key") % 5 != 0)


@query(f"""WITH {ATTEMPTS}, k AS (SELECT * FROM c WHERE status = 'succeeded'), b AS (SELECT key FROM t WHERE key NOT IN (SELECT key FROM k) ORDER BY key LIMIT 25)
SELECT b.key, (SELECT count(*) FROM t) AS targets, (SELECT count(*) FROM c) AS attempted, (SELECT count(*) FROM k) AS succeeded, (SELECT count(*) FROM t) - (SELECT count(*) FROM k) AS remaining, 'blocked' AS status FROM b""")
def repair_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, tried = attempts(spark, sf_dir)
    batch = repair.next_batch(targets, tried.where("status = 'succeeded'"), "key", "key").select("key")
    return batch.crossJoin(F.broadcast(repair.progress(targets, tried, "key")))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS label, o_orderkey % 3 = 0 AS human, o_orderkey % 10 / 10.0 AS sure, CASE WHEN o_orderkey % 5 > 0 THEN 40 END AS score FROM orders)
SELECT o_orderkey, CASE WHEN NOT human AND sure >= 0.6 THEN 'N' ELSE label END AS label, CASE WHEN NOT human AND score IS NOT NULL AND (CASE WHEN sure >= 0.6 THEN 'N' ELSE label END) IS NOT NULL THEN score ELSE 10 END AS score,
  CASE WHEN NOT human AND sure >= 0.6 THEN '' ELSE 'old' END AS reason FROM r""")
def repair_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    found = repair.apply_result(F.when(key % 4 > 0, F.col("o_orderstatus")), F.lit(10), F.lit("old"), F.lit("N"), (key % 10) / 10, F.when(key % 5 > 0, 40), key % 3 == 0, F.lit(True))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("r")).select("o_orderkey", "r.*")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 6000 THEN 'gone' WHEN o_orderkey % 31 = 0 THEN 'protected column changed' ELSE 'changed without being a target' END AS fault
FROM orders WHERE o_totalprice < 6000 OR o_orderkey % 31 = 0 OR (o_orderkey % 7 = 0 AND o_orderpriority <> '5-LOW') UNION ALL SELECT -1, 'new'""")
def publication_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    price = F.when(key % 31 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(key % 7 == 0, "X").otherwise(F.col("o_orderstatus"))
    after = before.where("o_totalprice >= 6000").withColumns({"o_totalprice": price, "o_orderstatus": status})
    after = after.union(before.orderBy("o_orderkey").limit(1).withColumn("o_orderkey", F.lit(-1).cast(before.schema["o_orderkey"].dataType)))
    return repair.audit(before, after, "o_orderkey", ["o_orderstatus"], before.where("o_orderpriority = '5-LOW'"))


@query("""WITH s AS (SELECT o_orderkey, o_orderpriority AS h FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE o_orderpriority END AS h FROM orders WHERE o_totalprice > 50000)
SELECT o_orderkey, CASE WHEN c.h IS NULL THEN 'missing' WHEN c.h = s.h THEN 'usable' ELSE 'changed' END AS status FROM s LEFT JOIN c USING (o_orderkey)""")
def saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    saved = rows.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderpriority").alias("h"))
    now = rows.where("o_totalprice > 50000").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderpriority")).alias("h"))
    return repair.reconcile(saved, now, "o_orderkey", "h")


@query("""WITH u AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' AND value > 180 GROUP BY 1),
r AS (SELECT user_id, min(value) AS v FROM events GROUP BY 1)
SELECT r.user_id, coalesce(u.v, r.v) AS v, coalesce((SELECT u2.v FROM u u2 WHERE u2.user_id = r.user_id + 1), -1) AS other FROM r LEFT JOIN u ON u.user_id = r.user_id""")
def patched_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    copies = F.array(F.struct((F.col("user_id") + 1).alias("user_id"), F.lit(-1.0).alias("v")), F.struct(F.lit(-5).cast("long").alias("user_id"), F.lit(0.0).alias("v")))
    rows = events.groupBy("user_id").agg(F.min("value").alias("v")).withColumn("copies", copies)
    updates = events.where("event_type = 'purchase' AND value > 180").groupBy("user_id").agg(F.max("value").alias("v"))
    return repair.patch(rows, updates, "user_id", "copies", ["v"]).select("user_id", "v", F.col("copies")[0]["v"].alias("other"))


@query("""WITH r AS (SELECT max(event_id) AS id FROM events WHERE user_id = 3 AND event_id < 900)
SELECT id AS prior, CASE WHEN (SELECT event_type FROM events WHERE event_id = r.id) <> 'purchase' THEN 'prior run unresolved' END AS fault, true AS same FROM r""")
def run_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    runs = events.select(F.col("event_id").alias("id"), F.col("event_id").alias("number"), F.col("user_id").alias("freeze"), F.lit("completed").alias("status"), F.when(F.col("event_type") == "purchase", "success").otherwise("failure").alias("conclusion"))
    last = events.where("user_id = 3 AND event_id < 900").agg(F.max("event_id")).first()[0]
    files = table(spark, sf_dir, "part").select(F.col("p_name").alias("path"), F.col("p_brand").alias("sha"))
    one = files.groupBy("path").agg(F.min("sha").alias("sha"))
    other = one.where(~F.col("path").startswith("hot")).union(one.where(F.col("path").startswith("hot")).withColumn("sha", F.lit("z")))
    return repair.lineage(runs, 900, 3, last).crossJoin(F.broadcast(repair.same_tree(one, other, "path", "sha", "^(?!hot)")))
