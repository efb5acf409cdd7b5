"""The library's operators applied to the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates, text, urls
from tidewire.operators import archive, cluster, evaluate, resolve, rollups, rules, state
from tidewire.plans import answers, choices, displays, intakes, libraries, markups, people, profiles, queues, reports, states, wordings  # noqa: F401 - they register their queries
from tidewire.plans.registry import QUERIES, SQL, query, table  # noqa: F401
from tidewire.sinks import outputs
from tidewire.sources import feeds

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS entity, count(*) AS n FROM orders
  WHERE o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW') GROUP BY 1, 2),
s AS (SELECT strftime(unnest(generate_series((min(month) || '-01')::DATE, (max(month) || '-01')::DATE, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM m),
e AS (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW']) AS entity),
d AS (SELECT s.month, e.entity, coalesce(m.n, 0) AS mentions FROM s CROSS JOIN e LEFT JOIN m ON m.month = s.month AND m.entity = e.entity)
SELECT month, entity, mentions::BIGINT AS mentions, (sum(mentions) OVER (PARTITION BY month))::BIGINT AS total,
  mentions::DOUBLE / nullif(sum(mentions) OVER (PARTITION BY month), 0)::DOUBLE AS share FROM d""")
def share_of_voice_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return rollups.share_of_voice(orders, dates.utc_month(F.col("o_orderdate")), F.array("o_orderpriority"), PRIORITIES)


KINDS = ("error", "view", "click", "signup", "purchase")


@query("""
WITH e AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, list_position(['error','view','click','signup','purchase'], event_type) AS p FROM events WHERE ts IS NOT NULL),
c AS (SELECT user_id, week, count(*) AS n, count(p) AS scored, sum(p - 3) AS s FROM e GROUP BY 1, 2),
b AS (SELECT user_id, min(week) AS low, greatest(max(week), DATE '2024-02-05') AS high FROM c GROUP BY 1),
d AS (SELECT user_id, unnest(generate_series(low, high, INTERVAL 7 DAY))::DATE AS week FROM b)
SELECT d.user_id, strftime(d.week, '%Y-%m-%d') AS week, coalesce(n, 0)::BIGINT AS n, coalesce(scored, 0)::BIGINT AS scored, round(s / nullif(scored, 0), 9)::DOUBLE AS net
FROM d LEFT JOIN c ON c.user_id = d.user_id AND c.week = d.week""")
def weekly_storyline_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = dates.instant("2024-02-07")
    found = rollups.weekly(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type"), KINDS, now)
    return found.select("user_id", F.date_format("week", "yyyy-MM-dd").alias("week"), "n", "scored", F.round("net", 9).alias("net"))


@query("""SELECT strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1""")
def eastern_month_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(dates.local_month(F.col("ts")).alias("month")).agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT strftime(ts, '%Y-%m') AS month, count(*) AS volume, avg(list_position(['error','view','click','signup','purchase'], event_type) - 3) AS net, avg(value) AS mean FROM events GROUP BY 1),
s AS (SELECT strftime(unnest(generate_series((min(month) || '-01')::DATE, (max(month) || '-01')::DATE, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM c),
d AS (SELECT s.month, coalesce(volume, 0) AS volume, net, mean, lag(coalesce(volume, 0)) OVER (ORDER BY s.month) AS prior FROM s LEFT JOIN c ON c.month = s.month)
SELECT month, volume::BIGINT AS volume, round(net, 9) AS net, round(mean, 6) AS mean_score, prior::BIGINT AS prior,
  CASE WHEN prior > 0 THEN floor(100.0 * (volume - prior) / prior + 0.5)::BIGINT END AS percent FROM d""")
def net_sentiment_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollups.monthly_report(table(spark, sf_dir, "events"), dates.utc_month(F.col("ts")), F.col("event_type"), F.col("value"), KINDS)
    return found.select("month", "volume", F.round("net", 9).alias("net"), F.round("mean_score", 6).alias("mean_score"), "prior", F.col("percent").cast("long").alias("percent"))


@query("""
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS volume FROM orders GROUP BY 1),
d AS (SELECT *, lag(volume) OVER (ORDER BY month) AS prior FROM c)
SELECT month, volume, prior, (volume - prior)::BIGINT AS change, CASE WHEN prior > 0 THEN floor(100.0 * (volume - prior) / prior + 0.5)::BIGINT END AS percent FROM d WHERE prior IS NOT NULL""")
def monthly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    found = rollups.monthly_report(orders, dates.utc_month(F.col("o_orderdate")), F.col("o_orderpriority"), F.col("o_totalprice"), PRIORITIES)
    return found.where("prior IS NOT NULL").select("month", "volume", "prior", "change", F.col("percent").cast("long").alias("percent"))


@query("""SELECT source AS name, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 5""")
def top_outlets_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.top(table(spark, sf_dir, "documents"), F.col("source"), 5).withColumn("share", F.round("share", 9))


@query("""
WITH t AS (SELECT DISTINCT doc_id, unnest([CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END, lang, source]) AS name FROM documents)
SELECT name, count(*) AS n FROM t WHERE name IS NOT NULL AND name NOT IN ('short') GROUP BY 1 ORDER BY n DESC, name LIMIT 5""")
def top_themes_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = F.array(F.when(F.col("n_chars") > 2000, "long").otherwise("short"), "lang", "source")
    return rollups.top_themes(table(spark, sf_dir, "documents"), F.array_compact(themes), 5, ("short",))


#: Rules suited to the test tables' texts.
TERMS = (
    rules.Term("license", r"license", reject=r"license(?:d| plate)", unless=r"open source"),
    rules.Term("mail", r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]+"),
    rules.Term("address", r"https?://"),
    rules.Term("phone", r"[0-9]{3}-[0-9]{4}"),
    rules.Term("key", r"(?:AKIA|sk-)[A-Za-z0-9]+", strip=r"sk-test"),
    rules.Term("web", r"www\."),
)
TERM_CASES = """
  CASE WHEN regexp_matches(t, 'license') AND NOT (regexp_matches(substr(t, strpos(t, 'license'), 47), 'license(?:d| plate)') AND NOT regexp_matches(t, 'open source')) THEN 'license' END,
  CASE WHEN regexp_matches(t, '[a-z0-9.]+@[a-z0-9.]+\\.[a-z]+') THEN 'mail' END,
  CASE WHEN regexp_matches(t, 'https?://') OR regexp_matches(t, 'www\\.') THEN 'address' END,
  CASE WHEN regexp_matches(t, '[0-9]{3}-[0-9]{4}') THEN 'phone' END,
  CASE WHEN regexp_matches(replace(t, 'sk-test', ' '), '(?:AKIA|sk-)[A-Za-z0-9]+') THEN 'key' END"""


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, coalesce(array_to_string(list_sort(list_filter([{TERM_CASES}], lambda x: x IS NOT NULL)), ','), '') AS labels FROM d""")
def term_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.tag(table(spark, sf_dir, "documents"), "text", TERMS, {"web": "address"})
    return found.select("doc_id", F.array_join(F.array_sort("labels"), ",").alias("labels"))


@query("""
SELECT d.doc_id, CASE WHEN toxic = 1 THEN false WHEN n_chars < 200 THEN false WHEN quality = 1 THEN true END AS relevant,
  CASE WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' WHEN quality = 1 THEN 'good' ELSE '' END AS reason,
  coalesce(NOT (toxic = 1 OR n_chars < 200), true) OR (toxic IS NULL AND NOT n_chars < 200) AS visible
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def verdict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    steps = [rules.Verdict(F.col("toxic") == 1, False, "toxic"), rules.Verdict(F.col("n_chars") < 200, False, "short"), rules.Verdict(F.col("quality") == 1, True, "good")]
    found = joined.select("doc_id", rules.cascade(steps).alias("v"))
    return found.select("doc_id", "v.relevant", "v.reason", rules.visible(F.col("v.relevant")).alias("visible"))


STORYLINES = [
    ("rights", "Rights", ["license", "copyright"], ["public domain"], None, 0),
    ("contact", "Contact", ["@", "phone"], [], "2024-01-01", 1),
    ("web", "Web", ["http"], ["example.org"], None, 2),
]


@query("""
WITH d AS (SELECT doc_id, lower(text) AS t, DATE '2023-12-01' + (doc_id % 60)::INTEGER AS day FROM documents),
x AS (SELECT doc_id, CASE WHEN (contains(t, 'license') OR contains(t, 'copyright')) AND NOT contains(t, 'public domain') THEN 'rights' END AS a,
  CASE WHEN (contains(t, '@') OR contains(t, 'phone')) AND day >= DATE '2024-01-01' THEN 'contact' END AS b,
  CASE WHEN contains(t, 'http') AND NOT contains(t, 'example.org') THEN 'web' END AS c FROM d)
SELECT doc_id, concat_ws(',', a, b, c) AS storylines FROM x WHERE coalesce(a, b, c) IS NOT NULL""")
def storyline_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(STORYLINES, "id string, name string, match array<string>, exclude array<string>, start string, position int")
    day = F.date_add(F.lit("2023-12-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    docs = table(spark, sf_dir, "documents").withColumn("day", day)
    return rules.match_storylines(docs, known, "doc_id", ["text"], "day").select("doc_id", F.array_join("storylines", ",").alias("storylines"))


@query("""
WITH d AS (SELECT doc_id, text AS t, strpos(text, 'license') - 1 AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, greatest(i - 180, 0) AS a, least(i + 260, length(t)) AS b FROM d)
SELECT doc_id, CASE WHEN i < 0 THEN trim(substr(t, 1, 320)) ELSE CASE WHEN a > 0 THEN '... ' ELSE '' END || trim(substr(t, a + 1, b - a)) || CASE WHEN b < length(t) THEN ' ...' ELSE '' END END AS snippet FROM w""")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    at = F.instr("text", "license") - 1
    return docs.select("doc_id", text.snippet(F.col("text"), at).alias("snippet"))


LINK_SQL = """
WITH u AS (SELECT page_id, url, html, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS scheme, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS host,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT page_id, url, html, lower(scheme) || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END AS base,
  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['fbclid','gclid','dclid','msclkid','mc_cid','mc_eid'], lower(split_part(x, '=', 1))))), '&') AS q FROM u),
k AS (SELECT page_id, url, html, CASE WHEN coalesce(q, '') = '' THEN base ELSE base || '?' || q END AS link FROM c)
"""


@query(LINK_SQL + "SELECT page_id, link FROM k")
def canonical_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_link(F.col("url")).alias("link"))


@query(LINK_SQL + """, r AS (SELECT *, CASE WHEN url = link THEN 20 ELSE 0 END AS quality FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY quality DESC, page_id) AS n FROM r)
SELECT link, page_id, url, quality FROM w WHERE n = 1""")
def link_winner_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = urls.canonical_link(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(link.alias("link"), "page_id", "url", F.when(F.col("url") == link, 20).otherwise(0).alias("quality"))
    return resolve.merge_copies(pages, "link", "quality", "page_id")


@query("""
WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents)
SELECT doc_id AS identity, min(doc_id) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) AS copies FROM k""")
def duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.xxhash64(text.title_key(F.col("text")))
    return resolve.duplicates(table(spark, sf_dir, "documents"), key, "doc_id")


@query("""
WITH o AS (SELECT user_id, max(ts) AS ts, max(value) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
n AS (SELECT user_id, max(ts) AS ts, max(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1),
m AS (SELECT coalesce(n.user_id, o.user_id) AS user_id, least(coalesce(n.ts, o.ts), coalesce(o.ts, n.ts)) AS ts, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.user_id = n.user_id)
SELECT * FROM m WHERE ts <= TIMESTAMP '2024-04-14 06:00:00' AND (user_id % 10 = 0 OR ts >= TIMESTAMP '2024-04-14' - INTERVAL 92 DAY)""")
def archive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, cut, now = table(spark, sf_dir, "events"), dates.instant("2024-01-15"), dates.instant("2024-04-14")
    last = lambda rows: rows.groupBy("user_id").agg(F.max("ts").alias("ts"), F.max("value").alias("value"))
    old, new = last(events.where(F.col("ts") < cut)), last(events.where(F.col("ts") >= cut))
    merged = archive.upsert(old, new, "user_id", fresh_first=["value"], earliest=["ts"])
    return archive.retained(merged, F.col("ts"), now, F.col("user_id") % 10 == 0)


@query("""SELECT event_id, ts FROM events WHERE CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 336 HOUR ELSE ts END > TIMESTAMP '2024-01-20'""")
def cache_ttl_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    kept = archive.unexpired(events, "ts", dates.instant("2024-01-20"), F.col("event_type") == "purchase", 336)
    return kept.select("event_id", "ts")


@query("""
SELECT c_custkey, c_acctbal FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')
  AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s_acctbal < 0) ORDER BY c_acctbal DESC, c_custkey LIMIT 25""")
def backfill_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    bad = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return archive.backfill(rows, [(urgent, ["c_custkey"]), (bad, ["c_nationkey"])], F.col("c_acctbal"), "c_custkey", 25).select("c_custkey", "c_acctbal")


@query("""
SELECT c.c_custkey FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'sent' END) AS status, count(*) AS attempts FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.o_custkey = c.c_custkey
WHERE c.c_acctbal > 0 AND (o.status IS NULL OR (o.status = 'failed' AND o.attempts < 3))""")
def send_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    people = customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, "active").otherwise("pending").alias("status"))
    lists = customer.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("list"))
    status = F.max(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("sent")).alias("status")
    sends = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("content_key")).agg(status, F.count("*").alias("attempts"))
    return state.send_candidates(people, lists, sends, "c_custkey", "1-URGENT", dates.instant("2024-01-01")).select("c_custkey")


@query("""
WITH v AS (SELECT user_id AS item, CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'error' THEN 'drop' WHEN 'view' THEN 'sentiment' END AS vote,
  CASE WHEN event_type = 'view' THEN CASE WHEN value > 50 THEN 'positive' ELSE 'negative' END END AS label, date_trunc('day', ts) AS "at" FROM events),
q AS (SELECT *, CASE WHEN vote = 'sentiment' THEN 'sentiment' ELSE 'inclusion' END AS question FROM v WHERE vote IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY item, question ORDER BY "at" DESC, CASE vote WHEN 'drop' THEN 1 ELSE 0 END, label) AS n FROM q)
SELECT item, question, vote, label, "at" FROM r WHERE n = 1""")
def vote_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    votes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item"),
        F.when(kind == "purchase", "keep").when(kind == "error", "drop").when(kind == "view", "sentiment").alias("vote"),
        F.when(kind == "view", F.when(F.col("value") > 50, "positive").otherwise("negative")).alias("label"),
        F.date_trunc("day", "ts").alias("at"),
    )
    return state.resolve_votes(votes)


@query("""
WITH i AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, (sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS streak FROM i""")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return state.streaks(events, "user_id", "ts", "event_id", F.col("event_type") == "error").select("event_id", "streak")


@query("""
SELECT user_id, (epoch(ts)::BIGINT // 86400) * 86400 AS window_start, count(*) AS n, least(count(*), 2)::BIGINT AS allowed, greatest(count(*) - 2, 0)::BIGINT AS refused
FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1, 2""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fixed_windows(table(spark, sf_dir, "events"), "user_id", "ts", 86_400, 2)


@query("""
WITH RECURSIVE m AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(s) AS opened FROM m GROUP BY 1
  UNION ALL SELECT b.user_id, (SELECT min(m.s) FROM m WHERE m.user_id = b.user_id AND m.s >= b.opened + 86400) FROM b
  WHERE EXISTS (SELECT 1 FROM m WHERE m.user_id = b.user_id AND m.s >= b.opened + 86400))
SELECT b.user_id, make_timestamp(b.opened * 1000000) AS opened, sum(m.n)::BIGINT AS n FROM b JOIN m ON m.user_id = b.user_id AND m.s >= b.opened AND m.s < b.opened + 86400 GROUP BY 1, 2""")
def alert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.batches(table(spark, sf_dir, "events"), "user_id", "ts", 24 * 60)


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3""")
def first_n_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_per_source(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'""")
def date_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.date_window(table(spark, sf_dir, "orders"), "o_orderdate", dates.instant("1995-01-01"), dates.instant("1996-01-01")).select("o_orderkey")


@query("""
WITH w AS (SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM w)
SELECT user_id, event_type AS section, event_id AS lead, ts AS "at", n - 1 AS others, n FROM r WHERE k = 1""")
def digest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rollups.windowed(table(spark, sf_dir, "events"), ["ts"], dates.instant("2024-01-10"), dates.instant("2024-01-11"))
    return rollups.sections(rows, "user_id", "event_type", "ts", "event_id")


@query("""
WITH e AS (SELECT unnest([0, 1]) AS expected), a AS (SELECT unnest([0, 1]) AS actual)
SELECT expected, actual, count(l.doc_id) AS n FROM e CROSS JOIN a LEFT JOIN labels l ON l.quality = expected AND l.toxic = actual GROUP BY 1, 2""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"), [0, 1])


@query("""
WITH r AS (SELECT list_position(['5-LOW','4-NOT SPECIFIED','3-MEDIUM','2-HIGH','1-URGENT'], o_orderpriority) AS e,
  (1 + o_orderkey % 5)::INTEGER AS a FROM orders), c AS (SELECT * FROM r WHERE e IS NOT NULL),
k AS (SELECT e, count(*) AS n, count(*) FILTER (e = a) AS hit FROM c GROUP BY 1)
SELECT count(*) AS n, round(avg((e = a)::INTEGER), 9) AS exact, round(avg((abs(e - a) <= 1)::INTEGER), 9) AS within_one, round(avg(abs(a - e)), 9) AS mean_distance, round(avg(a - e), 9) AS bias,
  (SELECT round(avg(hit / n), 9) FROM k) AS macro_recall FROM c""")
def sentiment_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = PRIORITIES[::-1]
    actual = F.element_at(F.array(*map(F.lit, scale)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    found = evaluate.agreement(table(spark, sf_dir, "orders"), F.col("o_orderpriority"), actual, scale)
    return found.select("n", *(F.round(c, 9).alias(c) for c in ("exact", "within_one", "mean_distance", "bias", "macro_recall")))


@query("""
SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'failed' WHEN user_id IN (SELECT user_id FROM events WHERE value > 95) THEN 'large' ELSE 'new' END AS reason FROM events""")
def miss_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    keyed = state.classify_miss(events.select("user_id").distinct(), "user_id", [("failed", events.where("event_type = 'error'")), ("large", events.where("value > 95"))])
    return events.select("event_id", "user_id").join(keyed, "user_id").select("event_id", "reason")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'""")
def delta_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    new = old.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return archive.changes(old, new, "o_orderkey")


@query("""
WITH t AS (SELECT conv_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM conversations),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
w AS (SELECT id, tf.term, (ln(tf) + 1) * (ln((n.n + 1) / (df + 1)) + 1) AS w FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) d ON d.term = tf.term CROSS JOIN n),
u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)
SELECT x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS cosine FROM u x JOIN u y ON x.term = y.term AND y.id <> x.id WHERE x.id % 100 = 0 GROUP BY 1, 2""")
def tfidf_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth conversation, as a query, against all others."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(F.col("conv_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1))).alias("term"))
    counted = words.groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = turns.agg(F.count_distinct("conv_id").alias("n"))
    frequency = counted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    weights = cluster.term_weights(counted, frequency.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    found = cluster.cosine_search(weights.where("id % 100 = 0"), weights)
    return found.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query()
def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("page_id") % 30) * 86_400)
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_replace("html", r"(?s)<[^>]*>", " ").alias("text"), day.alias("at"), urls.host(F.col("url")).alias("outlet"), F.lit("news").alias("block"))
    return cluster.groups(pages, "page_id", "title", "text", "at", "outlet", "block", F.lit(False))


@query("""
WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) AS term FROM benchmark),
e AS (SELECT conv_id, unnest(list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z]{7,}'))))) AS term FROM conversations GROUP BY conv_id),
nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), ne AS (SELECT conv_id, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT q.item_id, e.conv_id, count(*) / greatest(1, least(any_value(nq.n), any_value(ne.n))) AS score FROM q JOIN e ON e.term = q.term JOIN nq ON nq.item_id = q.item_id JOIN ne ON ne.conv_id = e.conv_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id) AS rank FROM s)
SELECT item_id, conv_id, round(score, 9) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def overlap_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    def terms(frame: DataFrame, key: str) -> DataFrame:
        found = frame.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"), F.lit(1))).alias("t"))
        return found.groupBy(key).agg(F.collect_set("t").alias("terms"))

    found = cluster.nearest(terms(table(spark, sf_dir, "benchmark"), "item_id"), terms(table(spark, sf_dir, "conversations"), "conv_id"), "item_id", "terms", "conv_id", "terms", 3)
    return found.withColumn("score", F.round("score", 9))


@query("""
SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS root FROM conversations""")
def comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return resolve.threads(turns, "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", F.coalesce("root", F.lit(-1)).alias("root"))


@query("""
WITH k AS (SELECT conv_id, turn, lower(concat_ws('|', trim(role), trim(text))) AS key FROM conversations WHERE trim(coalesce(text, '')) <> '')
SELECT conv_id, min(turn) AS turn FROM k GROUP BY conv_id, key""")
def comment_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_comments(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn")


@query("""SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events WHERE (props->>'$.k')::INTEGER >= 50""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k")).where("k >= 50")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, '"' || replace(CASE WHEN t <> '' AND strpos('=+-@' || chr(9) || chr(13), substr(t, 1, 1)) > 0 THEN '''' || t ELSE t END, '"', '""') || '"' AS field FROM d""")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.csv_field(F.col("text")).alias("field"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(https?://[^/\s]+)/\S+', '\1/…', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '[A-Za-z0-9_-]{32,}', '[token]', 'g') AS masked FROM documents""")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.mask_personal(F.col("text")).alias("masked"))


@query("""SELECT DISTINCT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-03-01' + 60""")
def calendar_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, first = F.to_date("o_orderdate"), F.lit("1995-03-01").cast("date")
    return table(spark, sf_dir, "orders").where(day.between(first, F.date_add(first, 60))).select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day")).distinct()


@query("""
WITH r AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey DESC) AS n, o_totalprice FROM orders)
SELECT o_orderstatus, o_orderkey, o_totalprice FROM r WHERE n = 1""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return state.latest_state(rows, "o_orderstatus", "o_totalprice", "o_orderkey")


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.article_text(table(spark, sf_dir, "pages"), "page_id", "html").withColumnRenamed("id", "page_id")


@query("""
SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') AS xml FROM documents""")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_xml(F.col("text")).alias("xml"))


@query(r"""
WITH p AS (SELECT url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR AS published FROM pages WHERE page_id % 7 <> 0),
e AS (SELECT url, published, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') AS title, replace(url, '&', '&amp;') AS link FROM p ORDER BY published DESC, url LIMIT 100)
SELECT published, url AS link, '<item><title>' || title || '</title><link>' || link || '</link><guid isPermaLink="false">' || link || '</guid><pubDate>' || strftime(published, '%a, %d %b %Y %H:%M:%S GMT')
  || '</pubDate><description><![CDATA[]]></description></item>' AS xml FROM e""")
def rss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 3600)
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("link"), F.col("url").alias("guid"), title.alias("title"), F.lit("").alias("summary"), day.alias("published"), (F.col("page_id") % 7 != 0).alias("relevant"))
    return outputs.rss_items(pages)
