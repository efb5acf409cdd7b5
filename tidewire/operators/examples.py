"""Libraries of labelled examples: who belongs to them, what tells requests apart, and why a lookup missed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.functions.text import SENTIMENTS, blank_to_null, clean, clip, first_filled

#: Columns of a library.
COLUMNS = ("id", "url", "title", "outlet", "excerpt", "context", "include", "sentiment", "provenance", "conflict")


def references(seed: DataFrame, archive: DataFrame, label: Column, excluded: DataFrame | None = None, conflicts: DataFrame | None = None) -> DataFrame:
    """Examples from a hand-kept list: (id, url, title, outlet, excerpt, context, include, sentiment, provenance, conflict).

    `seed` has url, title, outlet, topic and place; `archive` link, source, snippet and description;
    `label` is a seed row's label or null. The first row of each address counts. Rows of one
    address with different labels, or whose id is among the `conflicts`, keep no label. Texts come from
    the archive's copy of the address, verdicts never do.
    """
    rows = seed.withColumns({"_id": urls.vote_id(F.col("url")), "_label": label})
    told = rows.groupBy("_id").agg(F.count_distinct("_label").alias("labels"), F.min_by(F.struct(*rows.columns), "place").alias("row"))
    # A row without a title or an address of a page is no example; the next one of its address is.
    usable = rows.where(F.col("url").rlike("(?i)^https?://") & (clean(F.col("title")) != ""))
    first = usable.groupBy("_id").agg(F.min_by(F.struct(*rows.columns), "place").alias("row")).join(told.select("_id", "labels"), "_id")
    if excluded is not None:
        first = first.join(excluded.select(F.col("id").alias("_id")).distinct(), "_id", "left_anti")
    bad = first.select("_id").limit(0) if conflicts is None else conflicts.select(F.col("id").alias("_id"))
    first = first.join(bad.distinct().withColumn("_bad", F.lit(True)), "_id", "left")
    copies = archive.groupBy(urls.vote_id(F.col("link")).alias("_id")).agg(F.max_by(F.struct("source", "snippet", "description"), "link").alias("copy"))
    found = first.join(copies, "_id", "left")
    conflict = (F.col("labels") > 1) | F.coalesce("_bad", F.lit(False))
    return found.select(
        F.col("_id").alias("id"), F.trim("row.url").alias("url"), clip(F.col("row.title"), 300).alias("title"),
        clip(first_filled(F.col("row.outlet"), F.col("copy.source")), 160).alias("outlet"),
        clip(first_filled(F.col("copy.snippet"), F.col("copy.description")), 700).alias("excerpt"), clip(F.col("row.topic"), 600).alias("context"),
        F.lit(True).alias("include"), F.when(~conflict, F.col("row._label")).alias("sentiment"), F.lit("human list").alias("provenance"), conflict.alias("conflict"),
    )


def rejections(archive: DataFrame, rejected: DataFrame, seen: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Examples of what isn't wanted: archived copies of rejected ids that are no other examples, one an address.

    `archive` has link, title, outlet, snippet, description; the other tables have id.
    """
    rows = archive.where(F.col("link").rlike("(?i)^https?://") & (clean(F.col("title")) != "")).withColumn("id", urls.vote_id(F.col("link")))
    rows = rows.join(rejected.select("id").distinct(), "id", "left_semi").join(seen.select("id").distinct(), "id", "left_anti")
    if excluded is not None:
        rows = rows.join(excluded.select("id").distinct(), "id", "left_anti")
    one = rows.groupBy("id").agg(F.min_by(F.struct("link", "title", "outlet", "snippet", "description"), "link").alias("r"))
    return one.select(
        "id", F.trim("r.link").alias("url"), clip(F.col("r.title"), 300).alias("title"), clip(F.col("r.outlet"), 160).alias("outlet"),
        clip(first_filled(F.col("r.snippet"), F.col("r.description")), 700).alias("excerpt"), F.lit("").alias("context"), F.lit(False).alias("include"),
        F.lit(None).cast("string").alias("sentiment"), F.lit("human review").alias("provenance"), F.lit(False).alias("conflict"),
    )


def view(include: Column, sentiment: Column, title: Column, outlet: Column, excerpt: Column, context: Column, task: str) -> Column:
    """What a request shows of an example: its article and the label that the task is about."""
    article = F.struct(title.alias("title"), outlet.alias("outlet"), excerpt.alias("excerpt"), context.alias("context"))
    expected = sentiment if task == "sentiment" else include.cast("string")
    return F.struct(article.alias("article"), expected.alias("expected"))


def story_key(*parts: Column) -> Column:
    """Digest of what a request says apart from its examples: versions and texts in order."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256)


def short_key(key: Column) -> Column:
    return F.substring(key, 1, 12)


def signature(examples: Column) -> Column:
    """Which examples a request carries: ids and labels in order, no texts. `examples` are (id, label) structs."""
    return F.to_json(F.transform(examples, lambda e: F.array(e["id"], F.coalesce(e["label"].cast("string"), F.lit("")))))


def request_key(story: Column, signed: Column) -> Column:
    """Digest by which an answer is kept: the story's key and the examples' signature."""
    return F.sha2(F.concat_ws("|", story, F.coalesce(signed, F.lit(""))), 256)


def fingerprint(examples: DataFrame, *columns: str) -> DataFrame:
    """(n, hash): a fingerprint of a library that no order of rows changes: sums of rows' hashes."""
    row = F.xxhash64(*columns).cast("decimal(38,0)")
    return examples.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash"))


def classify_misses(entries: DataFrame, story: str, answered: DataFrame, seen: DataFrame, unclassified: bool = False) -> DataFrame:
    """The entries with `miss`: other examples under an answered story, seen but never answered, or a story new or changed."""
    known = answered.select(F.col(story), F.lit(True).alias("_answered")).distinct()
    last = seen.select(F.col(story), F.lit(True).alias("_seen")).distinct()
    joined = entries.join(known, story, "left").join(last, story, "left")
    miss = F.when(F.lit(unclassified), "unclassified").when(F.col("_answered"), "referenceChanged").when(F.col("_seen"), "unanswered").otherwise("storyChanged")
    return joined.withColumn("miss", miss).drop("_answered", "_seen")


def evidence(entries: DataFrame, cache: DataFrame, key: str, request: str, answer: Sequence[str]) -> DataFrame:
    """The entries with an answer: that of their key (if for the same request), else one of their request if all there agree.

    `cache` has the key, the request's hash and the `answer` columns, which are null without an answer.
    """
    row = F.struct(*answer)
    kept = cache.where(F.col(answer[0]).isNotNull())
    direct = kept.select(F.col(key), F.col(request).alias("_for"), row.alias("_direct"))
    # Equal answers meet in their smallest and their largest.
    history = kept.where(F.col(request).isNotNull()).groupBy(request).agg(F.min(row).alias("_low"), F.max(row).alias("_high"))
    agreed = history.where(F.col("_low") == F.col("_high")).select(request, F.col("_low").alias("_agreed"))
    joined = entries.join(direct, key, "left").join(agreed, request, "left")
    own = F.when(F.col("_direct").isNotNull() & (F.col("_for").isNull() | (F.col("_for") == F.col(request))), F.col("_direct"))
    return joined.withColumn("_found", F.coalesce(own, F.col("_agreed"))).select(*entries.columns, *(F.col(f"_found.{a}").alias(a) for a in answer))


def valid_answer(choice: Column, confidence: Column, odds: Column, labels: Sequence[str] = SENTIMENTS) -> Column:
    """Whether an answer is whole: a known choice, a confidence, and odds of all labels that sum to 1 and are highest for it."""
    values = [F.try_element_at(odds, F.lit(x)) for x in labels]
    proper = F.lit(True)
    for v in values:
        proper &= F.coalesce(v.between(0, 1), F.lit(False))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    top = F.greatest(*(F.coalesce(v, F.lit(0.0)) for v in values))
    sure = choice.isin(*labels) & confidence.between(0, 1) & (F.size(F.map_keys(odds)) == len(labels)) & proper & (F.abs(total - 1) <= 0.001)
    return F.coalesce(sure & (F.try_element_at(odds, choice) >= top), F.lit(False))


def may_enforce(first_seen: Column, boundary: Column, bounded: bool = True, rejudge: bool = False) -> Column:
    """Whether a decision may change a row: it came after the boundary, or there is none, or everything is judged again."""
    return F.lit(True) if rejudge or not bounded else F.coalesce(first_seen >= boundary, F.lit(False))


def needs_findings(hashed: Column, cached_hash: Column, failed_hash: Column, failed_at: Column, made_at: Column, now: Column, current: Column, retry_hours: int = 6, refresh_hours: int = 24) -> Column:
    """Whether a text is written again: its input changed, it didn't just fail, and the running month's isn't of today."""
    hour = F.expr("interval 1 hour")
    same = F.coalesce(hashed == cached_hash, F.lit(False))
    failed = F.coalesce((hashed == failed_hash) & (now < failed_at + hour * retry_hours), F.lit(False))
    recent = F.coalesce(cached_hash.isNotNull() & current & (now < made_at + hour * refresh_hours), F.lit(False))
    return ~same & ~failed & ~recent


def needs_rejudging(relevant: Column, known: Column, fresh: Column, old_title: Column, new_title: Column) -> Column:
    """Whether a stored rejection is looked at again: a label is new, or the title changed."""
    before, after = F.lower(clean(old_title)), F.lower(clean(new_title))
    changed = F.coalesce(blank_to_null(before) != blank_to_null(after), F.lit(False))
    return F.coalesce(relevant == F.lit(False), F.lit(False)) & ((F.size(F.array_except(fresh, known)) > 0) | changed)


def fallback(curated: Column, section_terms: Column, searched: Column) -> Column:
    """(terms, source) that stand in for a match: those of the hand-kept list, or of the search that found the row."""
    terms = F.array_distinct(F.when(curated, section_terms).otherwise(F.coalesce(searched, F.array().cast("array<string>"))))
    source = F.when(F.size(terms) == 0, "").when(curated, "mediaTracker").otherwise("searchFallback")
    return F.struct(terms.alias("terms"), source.alias("source"))
