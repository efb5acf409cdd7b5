"""Queries on how labels, numbers, dates and snippets are written, over values of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import dates, text
from tidewire.operators import intake, profile, rollups
from tidewire.plans.registry import query, table

#: Labels as people write them.
WRITTEN = (
    "Postive ", "neuttral to positive", "Neutral", "negative (and more neg to them)", "neutral to negative - while we are only mentioned in conjunction w/others", "postive - mention lowest inc. in 5 yrs",
    "", "wildly enthusiastic", "NEUTRAL TO POSITIVE", " positive-ish",
)


LABELS = ("negative", "neutral to negative", "neutral", "neutral to positive", "positive")
#: SQL of a written label `t`, as `label`.
LABEL = """nullif(regexp_extract(replace(replace(regexp_replace(trim(lower(t)), '\\s*[-(].*$', ''), 'postive', 'positive'), 'neuttral', 'neutral'), '^(neutral to positive|neutral to negative|positive|negative|neutral)', 1), '')"""


def written(frame: DataFrame, key: str) -> DataFrame:
    """The frame with `t`, one of the written labels by its key."""
    return frame.withColumn("t", F.element_at(F.array(*map(F.lit, WRITTEN)), (F.col(key) % len(WRITTEN) + 1).cast("int")))


def chosen(key: str) -> str:
    quoted = ", ".join("'" + w + "'" for w in WRITTEN)
    return f"([{quoted}])[({key} % {len(WRITTEN)})::INTEGER + 1] AS t"


@query(f"""WITH w AS (SELECT event_id, value, {chosen('event_id')} FROM events), l AS (SELECT *, {LABEL} AS label FROM w)
SELECT event_id, label, coalesce(label IN ('negative', 'neutral to negative'), false) OR value < 35 AS urgent FROM l""")
def label_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = written(table(spark, sf_dir, "events"), "event_id").withColumn("label", text.sentiment(F.col("t")))
    return told.select("event_id", "label", F.coalesce(profile.is_urgent(F.col("label"), F.col("value")), F.lit(False)).alias("urgent"))


@query(f"""WITH w AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_totalprice / 10000 AS score, {chosen('o_orderkey')} FROM orders), l AS (SELECT *, {LABEL} AS label FROM w),
m AS (SELECT month, count(*) AS volume, count(label) AS scored, avg(list_position({list(LABELS)!r}, label) - 3) AS net, round(avg(score), 6) AS mean_score, {', '.join(f"count(*) FILTER (label = '{x}') AS n_{x.replace(' ', '_')}" for x in LABELS)} FROM l GROUP BY 1)
SELECT *, lag(volume) OVER (ORDER BY month) AS prior FROM m""")
def label_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = written(table(spark, sf_dir, "orders"), "o_orderkey").withColumn("label", text.sentiment(F.col("t")))
    found = rollups.monthly_report(orders, F.date_format("o_orderdate", "yyyy-MM"), F.col("label"), F.col("o_totalprice") / 10000)
    return found.withColumn("mean_score", F.round("mean_score", 6)).drop("change", "percent")


@query(r"""WITH c AS (SELECT c_custkey, floor(abs(c_acctbal))::BIGINT + 1000 AS n FROM customer)
SELECT c_custkey, 'about ' || n || ' and ' || n || ' or ' || n * 1000 || ', not x' || n || 'k' AS text, [n, n, n * 1000, 5]::VARCHAR AS numbers FROM c""")
def number_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole amounts written with commas, as thousands with three decimals and as millions with up to four."""
    n = F.floor(F.abs("c_acctbal")).cast("long") + 1000
    # One file of one row group would be one task's.
    rows = table(spark, sf_dir, "customer").select("c_custkey", n.alias("n")).repartition("c_custkey")
    parts = F.concat(
        F.lit("about "), F.format_number("n", 0), F.lit(" and "), F.format_string("%d.%03d", F.floor(F.col("n") / 1000), F.col("n") % 1000), F.lit(" thousand or "),
        F.format_string("%d.%03d", F.floor(F.col("n") / 1000), F.col("n") % 1000), F.lit("m, not x"), F.col("n").cast("string"), F.lit("k"),
    )
    told = rows.select("c_custkey", text.plain_numbers(parts).alias("text"))
    numbers = text.numbers(F.concat(F.regexp_replace("text", "x.*$", ""), F.lit("5")))
    return told.select("c_custkey", "text", F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda x: x.cast("long").cast("string")), ", "), F.lit("]")).alias("numbers"))


@query("""SELECT o_orderkey, o_orderdate::TIMESTAMP + INTERVAL (o_custkey % 24) HOUR + INTERVAL (CASE o_orderkey % 3 WHEN 0 THEN 0 ELSE 7 END) MINUTE AS at FROM orders""")
def date_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders written as "March 5, 2026 5pm", "Mar 5, 2026, 5:07 p.m." and "2026-03-05 17:07:00"."""
    day, hour, kind = F.col("o_orderdate"), F.col("o_custkey") % 24, F.col("o_orderkey") % 3
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    half = F.when(hour < 12, "a").otherwise("p")
    plain = F.concat(F.date_format(day, "MMMM d, yyyy "), twelve, half, F.lit("m"))
    dotted = F.concat(F.date_format(day, "MMM d, yyyy, "), twelve, F.lit(":07 "), half, F.lit(".m."))
    stamp = F.concat(F.date_format(day, "yyyy-MM-dd "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":07:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse(F.when(kind == 0, plain).when(kind == 1, dotted).otherwise(stamp)).alias("at"))


@query("""WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS name FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN trim('Four more words here. ' || name) ELSE CASE WHEN trim(name) = '' THEN 'Only three more' ELSE '' END END AS snippet FROM p""")
def snippet_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets that repeat their page's title and outlet, and what they say besides."""
    # A dot of the SQL stands for all but a line feed.
    name, kind = F.regexp_extract("html", r"<title>([^\n]*?)</title>", 1), F.col("page_id") % 3
    title = F.when(F.trim(name) == "", "").otherwise(F.concat(name, F.lit(" - The Tide-Wire Post")))
    given = F.when(kind == 0, F.concat(name, F.lit(" The Tide Wire Post "), name)).when(kind == 1, F.concat(F.lit("Four more words here. "), name)).otherwise("Only three more")
    told = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), title.alias("title"), given.alias("given"))
    return told.select("page_id", intake.story_snippet(F.col("given"), F.col("title")).alias("snippet"))
