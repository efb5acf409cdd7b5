"""Queries on what rows are: type, outlet, section, access, eligibility, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.operators import profile
from tidewire.plans.registry import query, table

TITLE = r"(?s)<title>(.*?)</title>"
OWNED, SOCIAL = ["example.org"], ["example.net"]
PAYWALLED, FREE = ["therha.example.com", "ththin.example.com"], ["example.com"]
NAMES = {"therwh.example.org": "The Rwh", "ththin.example.com": "Thin Times"}
REGION = profile.Region(r"(?i)\b(?:the|and)\b", ["feed en", "feed de"], r"^/de/", r"(?i)\bder\b", r"(?i)\bder von\b")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a title, a language and a source of that name."""
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("html", TITLE, 1).alias("title"), lang.alias("lang"), F.concat(F.lit("feed "), lang).alias("source"))


#: Pages of the same kind in SQL.
PAGES = r"""p AS (SELECT page_id, url, html, title, lang, 'feed ' || lang AS source,
    regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path
  FROM (SELECT *, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages))"""


@query(f"""WITH {PAGES}
SELECT page_id, CASE WHEN host LIKE '%.example.org' THEN 'Owned' WHEN host LIKE '%.example.net' OR lang = 'es' THEN 'Social' ELSE 'News' END AS kind,
  CASE WHEN host LIKE '%.example.net' THEN 'May require login' WHEN host IN ('therha.example.com', 'ththin.example.com') OR host LIKE '%.therha.example.com' OR host LIKE '%.ththin.example.com' THEN 'Paywall likely'
    WHEN host LIKE '%.example.com' THEN 'Free to read' ELSE 'Access varies' END AS access FROM p""")
def page_kind_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    kind = profile.source_type(url, F.col("source"), OWNED, SOCIAL, r"\bes\b")
    return pages(spark, sf_dir).select("page_id", kind.alias("kind"), profile.access(url, SOCIAL, PAYWALLED, FREE).alias("access"))


@query(rf"""WITH {PAGES}, r AS (SELECT *, CASE WHEN lang = 'fr' THEN ' Le  Monde ' WHEN lang = 'es' THEN 'the paper' END AS recorded FROM p)
SELECT page_id, CASE WHEN lang = 'es' THEN 'The Paper' WHEN lang = 'fr' THEN 'Le Monde' WHEN host = 'therwh.example.org' THEN 'The Rwh' WHEN host = 'ththin.example.com' THEN 'Thin Times'
  WHEN lang = 'de' THEN source ELSE regexp_replace(host, '^(amp|m)\.', '') END AS outlet FROM r""")
def page_outlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    recorded = F.when(F.col("lang") == "fr", " Le  Monde ").when(F.col("lang") == "es", "the paper")
    found = profile.outlet(recorded, F.col("url"), F.col("source"), {"the paper": "The Paper"}, NAMES, r"(?i)^feed en")
    return pages(spark, sf_dir).select("page_id", found.alias("outlet"))


@query(f"""WITH {PAGES}, t AS (SELECT host, min(title) AS outlet FROM p WHERE lang = 'en' GROUP BY 1)
SELECT page_id, coalesce(t.outlet, 'none') AS outlet FROM p LEFT JOIN t ON t.host = p.host""")
def outlet_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir)
    known = rows.where("lang = 'en'").select(urls.host(F.col("url")).alias("host"), F.col("title").alias("outlet"))
    return profile.with_outlets(rows, known, F.col("url"), F.lit("none")).select("page_id", "outlet")


@query(rf"""WITH {PAGES}, b AS (SELECT *, regexp_replace(trim(regexp_replace(title, '\s+', ' ', 'g')), '\s+-\s+[^-]{{2,80}}$', '') AS bare FROM p),
s AS (SELECT *, regexp_matches(bare, '(?i)\b(the|and)\b') OR (source IN ('feed en', 'feed de') AND NOT regexp_matches(path, '^/de/')
    AND NOT regexp_matches(regexp_replace(bare, '(?i)\bder von\b', ' ', 'g'), '(?i)\bder\b')) AS regional FROM b)
SELECT page_id, regional, CASE WHEN lang = 'fr' THEN 'Brand' WHEN lang = 'es' OR regional THEN 'Region' ELSE 'Nation' END AS section FROM s""")
def page_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    regional = REGION.signal(profile.bare_title(F.col("title")), F.col("source"), F.col("url"))
    rows = pages(spark, sf_dir).withColumn("regional", regional)
    category = F.when(F.col("lang") == "fr", "brand").otherwise("topic")
    return rows.select("page_id", "regional", profile.section(category, F.col("regional"), "brand", ["Brand", "Region", "Nation"], F.col("lang") == "es").alias("section"))


SHAPES = [profile.Shape(r"(?:^|\.)example\.net$", r"^/(?:en|fr)/"), profile.Shape(r"^blog\.", None, r"(?i)\bthe\b"), profile.Shape(None, r"/\d$")]


@query(rf"""WITH {PAGES} SELECT page_id,
  (regexp_matches(host, '(^|\.)example\.net$') AND regexp_matches(path, '^/(en|fr)/')) OR (regexp_matches(host, '^blog\.') AND regexp_matches(trim(regexp_replace(title, '\s+', ' ', 'g')), '(?i)\bthe\b')) OR regexp_matches(path, '/\d$') AS listing,
  regexp_matches(title, '(?i)^(obituaries|in memoriam)') OR regexp_matches(path, '(?i)(^|/)obits?(/|$)') OR regexp_matches(html, '(?i)\b(passed away|memorial service)\b') AS notice FROM p""")
def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notice = profile.is_notice(F.col("url"), F.col("title"), F.lit(None).cast("string"), F.col("html"))
    return pages(spark, sf_dir).select("page_id", profile.fits_any(SHAPES, F.col("url"), F.col("title")).alias("listing"), notice.alias("notice"))


@query("""WITH u AS (SELECT doc_id, 'https://x.example/a?b=' || CASE WHEN doc_id % 3 = 0 THEN 'data:text/html,%20%3Cb%3E' WHEN doc_id % 3 = 1 THEN 'data:text/plain,c' ELSE source END AS url, doc_id % 3 = 0 AS markup FROM documents)
SELECT doc_id, markup, doc_id % 3 = 0 AS refused FROM u""")
def markup_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 3
    url = F.concat(F.lit("https://x.example/a?b="), F.when(kind == 0, "data:text/html,%20%3Cb%3E").when(kind == 1, "data:text/plain,c").otherwise(F.col("source")))
    shape = profile.refused_by_shape(F.when(kind == 0, "https://x.example/Press_Releases/1").otherwise(url), F.lit("topic"), "brand")
    return table(spark, sf_dir, "documents").select("doc_id", profile.carries_markup(url).alias("markup"), shape.alias("refused"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a newsroom: verdict, category, kind, labels and a score."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, False).when(key % 7 < 5, True).alias("relevant"),
        F.when(F.col("o_orderstatus") == "F", "brand").otherwise("topic").alias("category"),
        F.when(key % 4 == 0, "Social").otherwise("News").alias("kind"),
        F.when(key % 3 == 0, "positive").when(key % 3 == 1, "").alias("sentiment"),
        F.when(key % 5 > 0, "text").alias("summary"),
        F.when(key % 2 == 0, "r2").otherwise("r1").alias("rubric"),
        F.split("o_orderpriority", "[- ]").alias("terms"),
        F.col("o_orderpriority").alias("priority"),
    )


LABELLED = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN false WHEN o_orderkey % 7 < 5 THEN true END AS relevant, CASE WHEN o_orderstatus = 'F' THEN 'brand' ELSE 'topic' END AS category,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Social' ELSE 'News' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'positive' WHEN o_orderkey % 3 = 1 THEN '' END AS sentiment, CASE WHEN o_orderkey % 5 > 0 THEN 'text' END AS summary,
  CASE WHEN o_orderkey % 2 = 0 THEN 'r2' ELSE 'r1' END AS rubric, string_split_regex(o_orderpriority, '[- ]') AS terms, o_orderpriority AS priority FROM orders)"""


@query(f"""WITH {LABELLED}, s AS (SELECT *, relevant IS DISTINCT FROM false AND category = 'brand' AND kind = 'News' AND NOT list_contains(terms, 'LOW') AS scores FROM o)
SELECT o_orderkey, scores, relevant IS DISTINCT FROM false AND (summary IS NULL OR relevant IS NULL OR (scores AND coalesce(sentiment, '') = '')) AS pending,
  relevant IS DISTINCT FROM false AND (summary IS NULL OR relevant IS NULL OR (scores AND (coalesce(sentiment, '') = '' OR rubric <> 'r2'))) AS rescored,
  scores AND coalesce(sentiment, '') <> '' AS correctable FROM s""")
def summary_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = F.array_contains("terms", "LOW")
    rows = labelled(spark, sf_dir).withColumn("scores", profile.scores(F.col("relevant"), F.col("category"), F.col("kind"), "brand", excluded))
    columns = [F.col(c) for c in ("relevant", "summary", "scores", "sentiment", "rubric")]
    correctable = F.col("scores") & (F.coalesce("sentiment", F.lit("")) != "")
    return rows.select("o_orderkey", "scores", profile.is_pending(*columns, "r2").alias("pending"), profile.is_pending(*columns, "r2", rescore=True).alias("rescored"), correctable.alias("correctable"))


@query(f"""WITH {LABELLED}
SELECT o_orderkey, CASE WHEN relevant = false THEN 'excluded by review' WHEN list_contains(terms, 'LOW') THEN 'rejected by a rule' WHEN kind = 'Social' THEN 'no press' ELSE '' END AS reason,
  len(list_filter(terms, lambda t: t NOT IN ('1', '2', '3', '4', '5'))) > 0 AND len(list_filter(terms, lambda t: t NOT IN ('1', '2', '3', '4', '5', 'LOW', 'MEDIUM'))) = 0 AS minor,
  list_has_any(terms, ['URGENT']) OR regexp_matches(priority, '(?i)\\bhigh\\b') AS policy,
  list_has_any(list_filter(terms, lambda t: t <> '1'), ['URGENT', '2']) AS long, category <> 'brand' AND kind NOT IN ('Owned', 'Social') AS groupable FROM o""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.col("terms")
    reason = profile.first_reason((F.col("relevant") == F.lit(False), "excluded by review"), (F.array_contains(terms, "LOW"), "rejected by a rule"), (F.col("kind") == "Social", "no press"))
    return labelled(spark, sf_dir).select(
        "o_orderkey",
        reason.alias("reason"),
        profile.only_minor(terms, ["1", "2", "3", "4", "5"], ["LOW", "MEDIUM"]).alias("minor"),
        profile.has_policy(terms, F.col("priority"), ["URGENT"], r"(?i)\bhigh\b").alias("policy"),
        profile.stays_long(terms, F.array(F.lit("1")), ["URGENT", "2"]).alias("long"),
        profile.is_groupable(F.col("category"), F.col("kind"), "brand").alias("groupable"),
    )


@query(f"""WITH {LABELLED}, m AS (SELECT *, (['feedOnly', 'always', 'brandBody', 'smart'])[(o_orderkey % 4)::INTEGER + 1] AS mode, len(terms) AS n FROM o)
SELECT o_orderkey, o_orderkey % 11 <> 0 AND CASE mode WHEN 'feedOnly' THEN false WHEN 'always' THEN true WHEN 'brandBody' THEN n - 2 = 0 ELSE n > 2 END AS article,
  category = 'brand' AND n > 2 AS preview, priority = '1-URGENT' OR o_orderkey % 100 < 35 AS urgent,
  CASE WHEN priority LIKE '4%' THEN false ELSE kind = 'News' AND relevant IS DISTINCT FROM false END AS shown FROM m""")
def fetch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("o_orderkey"), F.size("terms")
    mode = F.element_at(F.array(*map(F.lit, ("feedOnly", "always", "brandBody", "smart"))), (key % 4 + 1).cast("int"))
    article = profile.fetches_article(mode, F.when(key % 11 == 0, False), n - 2, F.lit(0), F.greatest(n - 2, F.lit(0)), F.lit(None).cast("boolean"))
    urgent = profile.is_urgent(F.col("priority"), key % 100, ["1-urgent"])
    url = F.when(F.col("priority").startswith("4"), "https://a.owned.example/x").otherwise("https://b.example/x")
    shown = profile.is_press(F.col("relevant"), F.lit("2024-01-01"), F.col("kind"), url, F.lit(""), ["owned.example"], r"(?i)\bsocial\b")
    return labelled(spark, sf_dir).select("o_orderkey", article.alias("article"), profile.fetches_preview(F.col("category") == "brand", F.lit(None).cast("boolean"), n - 2, F.lit(0)).alias("preview"), urgent.alias("urgent"), shown.alias("shown"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type <> 'click' THEN value / 200 END AS p, event_type <> 'view' AS keyword, value / 300 AS q FROM events),
v AS (SELECT *, p IS NOT NULL AND p BETWEEN 0 AND 1 AS valid FROM e)
SELECT event_id, CASE WHEN NOT valid THEN 'keyword' WHEN p >= 0.7 THEN 'include' WHEN p <= 0.3 THEN 'exclude' ELSE 'keyword' END AS decision,
  CASE WHEN NOT valid THEN keyword WHEN p >= 0.7 THEN true WHEN p <= 0.3 THEN false ELSE keyword END AS relevant,
  CASE WHEN NOT valid THEN true WHEN p >= 0.7 THEN keyword WHEN p <= 0.3 THEN NOT keyword ELSE true END AS agrees,
  CASE WHEN NOT valid THEN 'no usable answer' WHEN p >= 0.7 OR p <= 0.3 THEN '' ELSE 'uncertain' END AS note,
  CASE WHEN valid AND q BETWEEN 0 AND 1 THEN greatest(p, q) END AS strongest FROM v""")
def model_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = F.when(F.col("event_type") != "click", F.col("value") / 200), F.col("value") / 300
    decided = profile.decide(p, F.col("event_type") != "view")
    return table(spark, sf_dir, "events").select("event_id", decided.alias("d"), profile.strongest({"a": p, "b": q}).alias("strongest")).select("event_id", "d.*", "strongest")


def lead(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\S+ \S+)", 1)


@query(r"""WITH d AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '^(\S+ \S+)', 1) AS lead, doc_id % 100 / 100.0 AS p FROM documents),
s AS (SELECT *, regexp_replace(trim(lead), '[.\s]+$', '') AS subject, greatest(p, 0.4) AS best, CASE WHEN p >= 0.4 THEN 'near' ELSE 'far' END AS name FROM d)
SELECT doc_id, CASE WHEN concat_ws(' ', a, b) = '' THEN 'Fits the feed''s editorial scope.' ELSE concat_ws(' ', a, b) END AS reason
FROM (SELECT doc_id, CASE WHEN subject <> '' AND NOT regexp_matches(subject, '(?i)\b(the|der)\b') THEN subject || '.' END AS a, CASE WHEN best >= 0.7 THEN 'Fits ' || name || ' (' || floor(best * 100 + 0.5)::INTEGER || '% confidence).' END AS b FROM s)""")
def inclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = {"near": (F.col("doc_id") % 100).cast("double") / 100, "far": F.lit(0.4)}
    reason = profile.scope_reason(lead(F.coalesce("text", F.lit(""))), scopes, refused=r"(?i)\b(?:the|der)\b")
    return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))
