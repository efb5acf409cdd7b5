"""Queries on what comes in: source windows, caches and saved state, identity of pages, listings and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates
from tidewire.operators import intake
from tidewire.plans.profiles import PAGES, pages
from tidewire.plans.registry import query, table


@query("""WITH s AS (SELECT p_partkey, p_brand LIKE '%1%' AS search, p_name || CASE WHEN p_size > 25 THEN ' when:7d' ELSE '' END AS q, p_size AS age FROM part)
SELECT p_partkey, CASE WHEN NOT search THEN q WHEN q LIKE '%when:7d' THEN replace(q, 'when:7d', 'after:2024-01-01 before:2024-02-01') ELSE q || ' after:2024-01-01 before:2024-02-01' END AS q, CASE WHEN NOT search THEN age END AS age, CASE WHEN search THEN '2023-12-31' END AS since, search AS past_cache FROM s""")
def backfill_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat("p_name", F.when(F.col("p_size") > 25, " when:7d").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.contains("p_brand", F.lit("1")).alias("search"), q.alias("q"), F.col("p_size").alias("age"))
    return intake.backfill(rows, "search", "q", "age", "2024-01-01", "2024-02-01").drop("search")


@query("""WITH s AS (SELECT s_name AS name, 'https://a' || s_nationkey || '.example/f' AS url, s_acctbal < 0 AS off FROM supplier), c AS (SELECT c_name AS name, 'https://a' || c_nationkey || '.example/f' AS url FROM customer),
b AS (SELECT name, url, 0 AS turn FROM s UNION ALL SELECT name, url, 1 FROM c)
SELECT url, arg_min(name, (turn, name)) AS name, min(turn)::INTEGER AS turn FROM b WHERE name NOT IN (SELECT name FROM s WHERE off) GROUP BY 1""")
def configured_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.concat(F.lit("https://a"), c, F.lit(".example/f"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), at("s_nationkey").alias("url"), "s_acctbal")
    added = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), at("c_nationkey").alias("url"))
    return intake.configured_catalog(own, added, own.where("s_acctbal < 0"), "name", "url")


@query("""SELECT event_type AS key, min(event_id) AS event_id FROM events GROUP BY 1""")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id")
    return intake.first_of_each(rows, F.col("key"), ["event_id"])


CACHE = """c AS (SELECT event_id, 'https://a.example/' || user_id AS key, CASE WHEN event_type = 'error' THEN 'ftp://x' ELSE 'https://a.example/' || user_id END AS url, CASE WHEN event_type <> 'view' THEN ts END AS checked, CASE WHEN event_type <> 'click' THEN ts + INTERVAL 10 DAY END AS expires FROM events)"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind, ts = F.concat(F.lit("https://a.example/"), "user_id"), F.col("event_type"), F.col("ts").cast("timestamp")
    url = F.when(kind == "error", "ftp://x").otherwise(key)
    return table(spark, sf_dir, "events").select("event_id", key.alias("key"), url.alias("url"), F.when(kind != "view", ts).alias("checked"), F.when(kind != "click", ts + F.expr("interval 10 days")).alias("expires"))


@query(f"""WITH {CACHE} SELECT event_id FROM c WHERE url LIKE 'https%' AND checked IS NOT NULL AND (expires IS NULL OR expires > TIMESTAMP '2024-01-20')""")
def valid_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.valid_cache(cache(spark, sf_dir), "key", "url", "checked", "expires", dates.instant("2024-01-20")).select("event_id")


@query(f"""WITH {CACHE}, n AS (SELECT key, max((checked, event_id)) AS x FROM c WHERE checked IS NOT NULL GROUP BY 1),
i AS (SELECT c_custkey, 'https://a.example/' || (c_custkey % 20) AS link, 'https://a.example/' || c_nationkey AS resolved FROM customer)
SELECT c_custkey, a.x IS NOT NULL OR b.x IS NOT NULL AS hit, CASE WHEN a.x IS NULL OR b.x[1] > a.x[1] THEN b.x[2] ELSE a.x[2] END AS event_id FROM i LEFT JOIN n a ON a.key = i.link LEFT JOIN n b ON b.key = i.resolved""")
def cached_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c: F.concat(F.lit("https://a.example/"), c)
    items = table(spark, sf_dir, "customer").select("c_custkey", at(F.col("c_custkey") % 20).alias("link"), at(F.col("c_nationkey")).alias("resolved"))
    known = cache(spark, sf_dir).where("checked IS NOT NULL")
    return intake.cached_article(items, known, "link", "resolved", "key", "checked").select("c_custkey", "hit", F.col("cached.event_id").alias("event_id"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, max(ts) AS until FROM events WHERE event_type = 'purchase' AND value > 150 GROUP BY 1), f AS (SELECT user_id, max(ts) AS until FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(s.user_id, f.user_id) AS user_id, coalesce(n, 0) AS n, greatest(coalesce(s.until, f.until), coalesce(f.until, s.until)) AS until FROM s FULL JOIN f ON f.user_id = s.user_id""")
def source_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    state = events.where("event_type = 'purchase' AND value > 150").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("until"))
    rested = intake.cooled(state, events.where("event_type = 'error'").select("user_id", F.col("ts").alias("until")), "user_id", "until")
    catalog = rested.select("user_id")
    return intake.source_states(catalog, rested, "user_id", {"n": F.lit(0).cast("long"), "until": F.lit(None).cast("timestamp")})


@query("""WITH k AS (SELECT substr(sha256(o_custkey::VARCHAR), 1, 12) AS key, min(o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT * FROM k ORDER BY place, key LIMIT 100""")
def story_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring(F.sha2(F.col("o_custkey").cast("string"), 256), 1, F.when(F.col("o_orderstatus") == "F", 12).otherwise(9))
    rows = table(spark, sf_dir, "orders").select(key.alias("key"), F.col("o_orderkey").alias("place"))
    return intake.story_keys(rows, "key", "place", 100)


@query(rf"""WITH {PAGES}, w AS (SELECT page_id, url, title, html, lang, list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')), lambda x: len(x) > 2) AS want,
  list_filter(list_distinct(regexp_extract_all(lower(title || ' and the rest'), '[a-z0-9]+')), lambda x: len(x) > 2) AS have FROM p)
SELECT page_id, lower(regexp_extract(substr(html, 1, 1024), '(?i)<meta[^>]*charset=["'']?\s*([\w-]+)', 1)) AS charset, len(list_intersect(want, have)) >= least(2, len(want)) AND len(list_intersect(want, have)) >= 0.3 * len(want) AS titled,
  lang = 'fr' AS missing, lang = 'de' OR lang = 'en' AS article, lang IN ('fr', 'es') AS other FROM w""")
def page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, lang, url = F.col("title"), F.col("lang"), F.col("url")
    missing = intake.is_missing(F.when(lang == "fr", "Error 404").otherwise(""), F.lit("fine"))
    canonical = F.when(lang == "de", url).when(lang == "es", "https://other.example/").otherwise("")
    linked = F.when(lang == "en", '{"@graph":[{"@type":"NewsArticle"}]}').otherwise('{"@type":"WebPage"}')
    return pages(spark, sf_dir).select(
        "page_id", intake.charset(F.col("html")).alias("charset"), intake.shared_title(F.concat(title, F.lit(" and the rest")), title).alias("titled"), missing.alias("missing"),
        intake.has_evidence(canonical, url, F.lit(None).cast("string"), linked, F.lit(0)).alias("article"), intake.contradicts(canonical, url, missing).alias("other"),
    )


@query("""WITH f AS (SELECT 's' || (o_custkey % 5) AS source, o_orderkey, 'fresh' AS side FROM orders WHERE o_orderstatus = 'O'), v AS (SELECT 's' || (o_custkey % 5) AS source, o_orderkey, 'previous' AS side FROM orders WHERE o_orderstatus = 'F')
SELECT * FROM f WHERE source IN ('s0', 's1', 's2') UNION ALL SELECT * FROM v WHERE source NOT IN ('s0', 's1', 's2')""")
def calendar_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("source", F.concat(F.lit("s"), F.col("o_custkey") % 5))
    fresh, previous = (rows.where(F.col("o_orderstatus") == k).select("source", "o_orderkey", F.lit(side).alias("side")) for k, side in (("O", "fresh"), ("F", "previous")))
    status = rows.select("source").distinct().withColumn("ok", F.col("source") < "s3")
    return intake.merged_sources(fresh, previous, status, "source")


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS title, o_orderstatus AS source, '' AS time FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01' AND o_orderpriority <> '5-LOW'""")
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), title.alias("title"), F.col("o_orderstatus").alias("source"), F.lit("").alias("time"))
    return intake.valid_events(rows, F.lit("1997-03-01").cast("date"), 30)


@query("""WITH t AS (SELECT event_id, (event_id % 12 + 1)::INTEGER AS h, (user_id % 60)::INTEGER AS m, (user_id % 12 + 1)::INTEGER AS eh, event_type IN ('view', 'click') AS pm FROM events),
c AS (SELECT event_id, (h % 12 + CASE WHEN pm THEN 12 ELSE 0 END) * 60 + m AS s, (eh % 12 + CASE WHEN pm THEN 12 ELSE 0 END) * 60 + 30 AS e FROM t), r AS (SELECT event_id, CASE WHEN s > e THEN s - 720 ELSE s END AS s, e FROM c)
SELECT event_id, CASE WHEN s < 0 THEN printf('%02d:%02d', (s - 60 * floor(s / 60.0)::INTEGER - s) // -60, s - 60 * floor(s / 60.0)::INTEGER) ELSE printf('%02d:%02d', s // 60, s % 60) END AS time, printf('%02d:%02d', e // 60, e % 60) AS "end" FROM r WHERE s >= 0""")
def clock_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = lambda c: (F.col(c) % 12 + 1).cast("int")
    half = F.when(F.col("event_type").isin("view", "click"), "p.m.").otherwise("am")
    span = intake.clock_range(hour("event_id"), (F.col("user_id") % 60).cast("int"), hour("user_id"), F.lit(30), half)
    return table(spark, sf_dir, "events").select("event_id", span.alias("s")).select("event_id", "s.*").where(~F.col("time").startswith("-"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"''#]+)[^"'']*["''][^>]*>(.*?)</a>')) AS raw, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root FROM pages),
l AS (SELECT page_id, root || regexp_extract(raw, '(?is)href\s*=\s*["'']([^"''#]+)', 1) AS link, trim(regexp_replace(regexp_replace(regexp_extract(raw, '(?is)>(.*)</a>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title, regexp_extract(raw, '(?is)href\s*=\s*["'']([^"''#]+)', 1) AS href FROM a)
SELECT DISTINCT page_id AS id, link FROM l WHERE len(title) >= 6 AND regexp_matches(href, '^/[a-zA-Z]') """)
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intake.listing_items(table(spark, sf_dir, "pages"), "page_id", "html", "url", "^/[a-zA-Z]", 6)
    return found.select("id", "link")


@query("""WITH c AS (SELECT conv_id AS id, turn, role AS author, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE trim(coalesce(text, '')) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn)::INTEGER AS place FROM c)
SELECT id, place, author, substr(text, 1, 1200) AS text FROM r WHERE place <= 6""")
def linked_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("c", F.struct("turn", F.struct("text", F.struct(F.col("role").alias("name")).alias("author")).alias("x")))
    linked = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["x"]).alias("comment"))
    rows = linked.select("conv_id", F.to_json(F.struct("comment")).alias("json"))
    return intake.linked_comments(rows, "conv_id", "json", 6).select("id", F.col("place").cast("int").alias("place"), "author", "text")
