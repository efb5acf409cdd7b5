"""Answers of a model to a numbered batch: read as far as they go, joined to the batch by place, faults as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import clean, sentiment


def array_text(text: Column) -> Column:
    """What of an answer may be its array: without fences around it, from the first opening to the last closing bracket."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    return F.when(inner != "", inner).otherwise(bare)


def entries(responses: DataFrame, batch: str, text: str) -> DataFrame:
    """(batch, turn, place, entry) of the answers' entries in order; a `place` that is no number is null.

    An answer that is no array gives one row without a turn.
    """
    parsed = responses.select(F.col(batch).alias("batch"), F.try_parse_json(array_text(F.col(text))).alias("v"))
    every = F.try_variant_get("v", "$", "array<variant>")
    rows = parsed.select("batch", F.posexplode_outer(F.when(F.schema_of_variant("v").startswith("ARRAY"), every)).alias("turn", "entry"), (~F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))).alias("bad"))
    place = F.regexp_extract(F.coalesce(F.try_variant_get("entry", "$.id", "string"), F.lit("")), r"^\s*\+?(\d{1,9})", 1).try_cast("int")
    return rows.where("bad OR turn IS NOT NULL").select("batch", "turn", place.alias("place"), "entry")


def applied(responses: DataFrame, items: DataFrame, batch: str, text: str, place: str, curated: Column, scored: Column) -> DataFrame:
    """(batch, place, turn, summary, reason, relevant, sentiment, sentiment_reason, fault): every entry and every item of the batches.

    A row without a fault is an item's answer: of several for one place the last counts. Only an
    outright no excludes, and never a curated item; labels count where the item is `scored`.
    Faults are "unreadable" (no array), "no place", "no item" (no such place in the batch), "no
    summary", "repeated" (a later entry counts) and "unanswered" (an item without an answer).
    """
    known = items.select(F.col(batch).alias("batch"), F.col(place).cast("int").alias("place"), curated.alias("curated"), scored.alias("scored"), F.lit(True).alias("there"))
    read = entries(responses, batch, text).join(known, ["batch", "place"], "left")
    own = lambda name: F.try_variant_get("entry", f"$.{name}", "string")
    is_text = F.schema_of_variant(F.try_variant_get("entry", "$.summary", "variant")) == "STRING"
    summary = F.when(is_text, clean(own("summary")))
    no = F.schema_of_variant(F.try_variant_get("entry", "$.relevant", "variant")).eqNullSafe("BOOLEAN") & (own("relevant") == "false")
    fault = (
        F.when(F.col("turn").isNull(), "unreadable").when(F.col("place").isNull(), "no place").when(F.col("there").isNull(), "no item").when(F.coalesce(summary, F.lit("")) == "", "no summary")
    )
    label = F.when(F.coalesce("scored", F.lit(False)), sentiment(own("sentiment")))
    told = read.select(
        "batch", "place", "turn", summary.alias("summary"), clean(own("reason")).alias("reason"), (F.coalesce("curated", F.lit(False)) | ~F.coalesce(no, F.lit(False))).alias("relevant"),
        label.alias("sentiment"), F.when(label.isNotNull(), clean(own("sentimentReason"))).alias("sentiment_reason"), fault.alias("fault"),
    )
    last = told.where("fault IS NULL").groupBy("batch", "place").agg(F.max("turn").alias("last"))
    marked = told.join(last, ["batch", "place"], "left").withColumn("fault", F.when(F.col("fault").isNull() & (F.col("turn") < F.col("last")), "repeated").otherwise(F.col("fault")))
    answered = marked.select(*told.columns)
    missing = known.join(last, ["batch", "place"], "left_anti").select("batch", "place", *(F.lit(None).cast(told.schema[c].dataType).alias(c) for c in told.columns[2:-1]), F.lit("unanswered").alias("fault"))
    return answered.unionByName(missing)
