"""Linked data of pages at any depth: values walked in rounds, each round one level of all pages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import dates, urls
from tidewire.functions.text import blank_to_null, clean, first_filled
from tidewire.operators.cluster import cut

#: Types that are articles. Fixed value.
ARTICLE = r"(?i)^(?:article|newsarticle|reportagenewsarticle)$"


def objects(frame: DataFrame, id_col: str, json_col: str, most_levels: int = 200) -> DataFrame:
    """(id, path, types, value) of every object with a type in a page's linked data, however deep.

    `path` has a number for each level, places in arrays and of sorted names in objects, so that
    paths order a page's objects; `types` are one or several. Text that is no JSON, and null, give
    no rows. A round takes one level of all pages; rounds end when no value is left.
    """
    start = frame.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("value")).where("value IS NOT NULL")
    now = start.select("id", F.array().cast("array<int>").alias("path"), "value")
    levels = []
    for _ in range(most_levels):
        # A level is read twice, for its objects and for the next level: it is written once, as text.
        written = cut(now.where(F.schema_of_variant("value").rlike("^(?:OBJECT|ARRAY)")).select("id", "path", F.to_json("value").alias("json")))
        if written.isEmpty():
            break
        level = written.select("id", "path", F.parse_json("json").alias("value"))
        levels.append(level)
        inside = level.lateralJoin(frame.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "child"))
        now = inside.select("id", F.array_append("path", F.col("pos")).alias("path"), F.col("child").alias("value"))
    else:
        raise ValueError(f"linked data deeper than {most_levels} levels")
    if not levels:
        return now.select("id", "path", F.array().cast("array<string>").alias("types"), "value").limit(0)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    # Names with an @ are no plain path: objects are asked for it by their text.
    one, several = (F.try_variant_get("value", """$["@type"]""", kind) for kind in ("string", "array<string>"))
    text = F.schema_of_variant("value").rlike("^OBJECT")
    typed = every.where(text).withColumn("types", F.coalesce(several, F.when(one.isNotNull(), F.array(one))))
    return typed.where("types IS NOT NULL").select("id", "path", "types", "value")


def text_of(path: str) -> Column:
    """A text inside an object, null where there is none."""
    return blank_to_null(F.try_variant_get("value", path, "string"))


def comments(found: DataFrame, least: int = 12) -> DataFrame:
    """(id, path, author, text, at) of comments among `objects`, at any depth; of equal ones of a page the first."""
    person = F.coalesce(text_of("$.author.name"), text_of("$.author.alternateName"), F.when(F.schema_of_variant(F.try_variant_get("value", "$.author", "variant")) == "STRING", text_of("$.author")))
    text = clean(first_filled(text_of("$.text"), text_of("$.commentText"), text_of("$.description")))
    at = dates.parse(F.coalesce(text_of("$.datePublished"), text_of("$.dateCreated"), text_of("$.dateModified")))
    told = found.where(F.array_join("types", " ").rlike(r"(?i)\bComment\b")).select("id", "path", clean(person).alias("author"), text.alias("text"), at.alias("at"))
    good = told.where(F.length("text") >= least)
    return good.groupBy("id", F.lower("author").alias("a"), F.lower("text").alias("t")).agg(F.min_by(F.struct("path", "author", "text", "at"), "path").alias("x")).select("id", "x.*")


def articles(found: DataFrame, pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(id) of pages whose linked data declares an article: the outermost one of its branch, without an address or with the page's."""
    own = found.where(F.exists("types", lambda t: t.rlike(ARTICLE))).select("id", "path", F.coalesce(text_of("$.url"), text_of("""$.mainEntityOfPage["@id"]""")).alias("said"))
    # What an article holds declares no article of its own.
    inner = own.alias("a").join(own.alias("b"), "id").where((F.size("a.path") > F.size("b.path")) & (F.slice("a.path", 1, F.size("b.path")) == F.col("b.path")))
    outermost = own.join(inner.select("id", F.col("a.path").alias("path")).distinct(), ["id", "path"], "left_anti")
    asked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("asked"))
    return outermost.join(asked, "id").where(F.col("said").isNull() | urls.same_page(F.col("said"), F.col("asked"))).select("id").distinct()
