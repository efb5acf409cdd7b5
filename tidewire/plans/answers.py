"""Queries on prose, sessions, social pages, answers, bytes and slices of an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions import charsets
from tidewire.functions.text import SENTIMENTS
from tidewire.operators import answers, evaluate, prose
from tidewire.operators.cluster import cut
from tidewire.plans.registry import query, table
from tidewire.sources import markup, social

TODAY = "1990-01-01"


@query(r"""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, o_orderpriority AS p, o_custkey % 12 + 1 AS h FROM orders),
e AS (SELECT *, strftime(d, '%B ') || day(d) || ', ' || year(d) AS w, strftime(d, '%A') AS n FROM o)
SELECT id, 'deadline' AS kind, strftime(d, '%Y-%m-%d') AS day, '' AS time, 'Public comment closes: ' || p AS title, 'Comments will be accepted until ' || n || ', ' || w || '.' AS body FROM e
UNION ALL SELECT id, 'hearing', strftime(d, '%Y-%m-%d'), lpad((h % 12 + 12)::VARCHAR, 2, '0') || ':30', 'Public comment forum: ' || p, 'A public forum will be held on ' || n || ' ' || w || ' at ' || h || ':30 p.m. by phone.' FROM e""")
def comment_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sections on comments: a deadline, a forum, and sentences whose day isn't certain."""
    name, day = F.date_format("o_orderdate", "EEEE"), F.date_format("o_orderdate", "MMMM d, yyyy")
    text = F.concat(
        F.lit("<p>Comments will be accepted until "), name, F.lit(", "), day, F.lit(". A public forum will be held on "), name, F.lit(" "), day, F.lit(" at "), F.col("o_custkey") % 12 + 1, F.lit(":30 p.m. by phone. The forum was on "), day,
        F.lit(".</p><p>Comments are open until October 5.</p>"),
    )
    page = F.concat(F.lit('<div class="usa-accordion"><h4><button class="usa-accordion__button">'), "o_orderpriority", F.lit(' (closed)</button></h4><div class="usa-accordion__content">'), text, F.lit("</div></div>"))
    pages = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_orderpriority").repartition("o_orderkey").select("o_orderkey", page.alias("html"), F.lit("").alias("url"))
    found = cut(markup.extract(pages, "o_orderkey", "html", "url", prose.SECTIONS))
    return prose.comment_periods(found, pages, "o_orderkey", F.lit(TODAY).cast("date"))


@query(r"""WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, o_orderstatus AS s, o_custkey AS c FROM orders)
SELECT id, strftime(d, '%Y-%m-%d') AS day, CASE WHEN s = 'O' THEN '13:15' ELSE '' END AS time, 'House Committee on Health Care' AS title, CASE WHEN s = 'F' THEN 'Hall' ELSE 'Room ' || c || ' (Big), State House. Bring notes' END AS body,
  'https://law.example/committee/' || CASE WHEN s = 'O' THEN 'agenda/' ELSE 'detail/' END || (year(d) + year(d) % 2) || '/' || CASE WHEN s = 'O' THEN id ELSE c END AS url FROM o WHERE s <> 'P' UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL FROM o WHERE s = 'P'""")
def session_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a session's table: a meeting of a wanted committee, one of another, or no table at all."""
    status = F.col("o_orderstatus")
    row = F.struct(
        F.date_format("o_orderdate", "EEEE, MMMM d, yyyy").alias("MeetingDate"), F.lit("House Committee on Health Care").alias("LongName"), F.when(status == "O", "1:15 PM").otherwise("1").alias("StartTime"),
        F.when(status != "F", F.col("o_custkey")).alias("RoomNbr"), F.lit("Big").alias("Room"), F.lit("Hall").alias("AlternateRoomLocation"), F.when(status == "O", 1).otherwise(0).alias("Published"),
        F.col("o_orderkey").alias("CommitteeMeetingID"), F.col("o_custkey").alias("PermanentID"), F.when(status == "F", "").otherwise("Bring  notes").alias("notes"),
    )
    other = row.withField("LongName", F.lit("Committee on Roads"))
    json = F.when(status == "P", '{"data": "none"}').otherwise(F.to_json(F.struct(F.array(row, other, row.withField("MeetingDate", F.lit("Someday"))).alias("data"))))
    # A file of one row group would be one task's.
    frame = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus").repartition("o_orderkey").select("o_orderkey", json.alias("json"))
    return prose.session_meetings(frame, "o_orderkey", "json", "https://law.example", "(?i)health|insurance", F.lit(TODAY).cast("date")).drop("place")


@query(r"""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[\s\x{00a0}]+', ' ', 'g')) AS text FROM conversations)
SELECT conv_id, turn, 'https://www.facebook.com/p/posts/' || turn AS link, md5(text) AS digest, epoch_ms((1700000000 + turn) * 1000) AS at FROM c WHERE text <> ''""")
def social_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages whose data holds a post, twice."""
    inside = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("m"))), r'(?s)^\{"m":"(.*)"\}$', 1)
    link = F.concat(F.lit('"wwwURL":"https:\\/\\/www.facebook.com\\/p\\/posts\\/'), "turn", F.lit('"'))
    page = F.concat(F.lit('<script>{"post_id":"1","message":{"text":"'), inside, F.lit('"},"creation_time":'), F.col("turn") + 1_700_000_000, F.lit(","), link, F.lit(',"x":1},{'), link, F.lit("}</script>"))
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), page.alias("html"))
    found = social.preloaded_posts(rows, "id", "html")
    return found.select("id.conv_id", "id.turn", "link", F.md5("text").alias("digest"), "at")


@query(r"""WITH i AS (SELECT o_custkey AS batch, o_orderkey, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INTEGER AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
k AS (SELECT *, batch % 5 AS kind FROM i)
SELECT batch, place, CASE WHEN (kind = 0 OR s = 'P') AND NOT (kind = 2 AND place = 1) THEN 'unanswered' END AS fault, CASE WHEN kind > 0 AND s <> 'P' THEN 'About ' || o_orderkey WHEN kind = 2 AND place = 1 THEN 'Old' END AS summary,
  CASE WHEN kind > 0 AND s <> 'P' THEN NOT (s = 'F' AND kind > 1) WHEN kind = 2 AND place = 1 THEN true END AS relevant,
  CASE WHEN kind > 0 AND s <> 'P' AND kind <> 3 THEN 'neutral to positive' END AS sentiment FROM k
UNION ALL SELECT DISTINCT batch, NULL::INTEGER, 'unreadable', NULL, true, NULL FROM k WHERE kind = 0
UNION ALL SELECT batch, place, 'no summary', '', true, CASE WHEN kind <> 3 THEN 'neutral to positive' END FROM k WHERE kind > 0 AND s = 'P'
UNION ALL SELECT DISTINCT batch, (n + 1)::INTEGER, 'no item', 'Beyond', true, NULL FROM k WHERE kind > 0
UNION ALL SELECT batch, place, 'repeated', 'Old', true, NULL FROM k WHERE kind = 2 AND place = 1 AND s <> 'P'""")
def batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a batch: answers in a fence, with items left out, one too many, one twice, or nothing that can be read."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), "o_orderkey", "o_orderstatus")
    place = F.row_number().over(W.partitionBy("batch").orderBy("o_orderkey"))
    items = orders.withColumns({"place": place, "kind": F.col("batch") % 5})
    no = F.when(F.col("o_orderstatus") == "F", False)
    entry = F.struct(
        F.concat(F.col("place"), F.when(F.col("kind") == 4, ".").otherwise("")).alias("id"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat(F.lit("About  "), "o_orderkey")).alias("summary"), no.alias("relevant"),
        F.lit("Neuttral to positive - mild").alias("sentiment"),
    )
    # An answer is one bounded batch's.
    made = items.groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.to_json(entry).alias("x")))), lambda e: e["x"]), ",").alias("entries"), F.max("place").alias("n"), F.first("kind").alias("kind"))
    first = F.when(F.col("kind") == 2, '{"id":1,"summary":"Old","relevant":"false"},').otherwise("")
    text = F.when(F.col("kind") == 0, "Sorry, I [can't]").otherwise(F.concat(F.lit("```json\n["), first, "entries", F.lit(',{"id":'), F.col("n") + 1, F.lit(',"summary":"Beyond"}]\n```')))
    found = answers.applied(made.select("batch", text.alias("text")), items, "batch", "text", "place", F.col("kind") == 1, F.col("kind") != 3)
    return found.select("batch", "place", "fault", "summary", "relevant", "sentiment")


@query("""SELECT page_id, md5(CASE page_id % 5 WHEN 4 THEN html || chr(65533) ELSE html END) AS digest FROM pages""")
def page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes: UTF-8, UTF-8 under a wrong name, two-byte units with their mark, Western bytes by name, and UTF-8 with a bad byte."""
    html, kind = F.col("html"), F.col("page_id") % 5
    western = html.rlike("^[\\x00-\\x7F\\xA0-\\xFF]*$") & html.contains('charset="utf-8"')
    named = F.replace(html, F.lit('charset="utf-8"'), F.lit('charset="latin1"'))
    raw = (
        F.when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE")))
        .when((kind == 3) & western & html.rlike("[\\xA0-\\xFF]"), F.encode(F.when(western, named).otherwise(""), "ISO-8859-1"))
        .when(kind == 4, F.concat(F.encode(html, "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode(html, "UTF-8"))
    )
    text = charsets.decoded(raw, F.when(kind == 1, "iso-8859-1"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.replace(text, F.lit('charset="latin1"'), F.lit('charset="utf-8"'))).alias("digest"))


@query(f"""WITH p AS (SELECT {list(SENTIMENTS)!r} AS scale), r AS (SELECT event_id, value, event_type AS t, event_id % 6 + 1 AS a, (event_id // 6) % 7 + 1 AS b, user_id % 6 + 1 AS e FROM events),
s AS (SELECT 'all' AS slice, * FROM r UNION ALL SELECT 'views', * FROM r WHERE t = 'view' UNION ALL SELECT 'large', * FROM r WHERE value > 100 UNION ALL SELECT 'none', * FROM r WHERE value < -1),
u AS (SELECT slice, e, 'first' AS prediction, CASE WHEN a <= 5 THEN a END AS x FROM s WHERE e <= 5 UNION ALL SELECT slice, e, 'second', CASE WHEN b <= 5 THEN b END FROM s WHERE e <= 5),
c AS (SELECT slice, prediction, e, count(*) AS eligible, count(x) AS n, count(*) FILTER (x = e) AS hit, count(*) FILTER (abs(x - e) <= 1) AS near, sum(abs(x - e)) AS apart, sum(x - e) AS bias FROM u GROUP BY ALL),
g AS (SELECT slice, prediction, sum(eligible)::BIGINT AS eligible, sum(n)::BIGINT AS n, round(sum(hit) / nullif(sum(n), 0), 9) AS exact, round(sum(near) / nullif(sum(n), 0), 9) AS within_one, round(sum(apart) / nullif(sum(n), 0), 9) AS mean_distance,
  round(sum(bias) / nullif(sum(n), 0), 9) AS bias, round(avg(hit / nullif(n, 0)), 9) AS macro_recall FROM c GROUP BY 1, 2)
SELECT * FROM g UNION ALL SELECT 'none', x, 0, 0, NULL, NULL, NULL, NULL, NULL FROM (SELECT unnest(['first', 'second']) AS x) WHERE NOT EXISTS (SELECT 1 FROM g WHERE slice = 'none')""")
def evaluation_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictions of every event's label in four slices, one of them empty."""
    scale = F.array(*map(F.lit, SENTIMENTS))
    at = lambda place: F.get(scale, place.cast("int"))
    key = F.col("event_id")
    events = table(spark, sf_dir, "events")
    slices = {"all": F.lit(True), "views": F.col("event_type") == "view", "large": F.col("value") > 100, "none": F.col("value") < -1}
    found = evaluate.sliced(events, slices, at(F.col("user_id") % 6), {"first": at(key % 6), "second": at(F.floor(key / 6) % 7)})
    return found.select("slice", "prediction", "eligible", "n", *(F.round(c, 9).alias(c) for c in ("exact", "within_one", "mean_distance", "bias", "macro_recall")))
