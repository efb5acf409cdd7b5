"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected equally often: the source's target size
over its own size. Prefix sums of these expectations, plus one random offset, cross
some integers; a document is taken once for each integer that its own share crosses.
Documents stand in order of size, so that those taken spread over all sizes and
their words come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.cluster import by_place, cut

SEPARATORS = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; a null text has none."""
    # Each match is a word with the white space around it; what is left is one mark a word.
    marks = F.regexp_replace(text, f"[{SEPARATORS}]*+[^{SEPARATORS}]++[{SEPARATORS}]*+", "x")
    return F.when(text.rlike(f"[^{SEPARATORS}]"), F.length(marks)).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources take `weights` in turn, by code point and null last, and share the total
    size by weight. No target passes `most` times its source's size; what is over
    goes to the other sources by weight until none is above. Sources that reach their
    cap are those of the least cap per weight, so the cut falls where the next
    source's fair share is within its cap. The frame holds a row per source: its
    windows are over sources, not documents.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    upward = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = upward.rowsBetween(W.unboundedPreceding, -1)
    everywhere = W.partitionBy()
    shares = (
        weighed.withColumn("total", F.sum("source_size").over(everywhere))
        .withColumn("weights", F.sum("weight").over(everywhere))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # Words per unit of weight, if all sources before this one are at their caps.
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("weights_before")))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("fair", F.min(F.when(F.col("fits"), F.struct(F.col("weights_before"), F.col("level")))).over(everywhere))
    )
    own = F.when(
        F.col("fair").isNull() | (F.col("weights_before") < F.col("fair.weights_before")), F.col("cap")
    ).otherwise(F.col("fair.level") * F.col("weight"))
    return shares.select("source", "source_size", own.alias("target"))


def mix(
    frame: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seed: str = "mix",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, copies) of each row of `frame`.

    A column `row` holds the columns in `carry`, if any, as a struct.

    `copies` says how often the mix takes the document, at most `most` times; reruns
    agree, for the offset of a source comes from a digest of its name and `seed`.
    Null and empty texts have size 0 and may be taken, at no words. Rows with a null
    source form a source of their own, rows with a null id stand first among equals.
    Documents of one source and size stand in order of a digest and their id; repeated
    rows count and are taken each for itself. An empty table gives no rows; texts count
    whole, however long; other columns are left out.

    As a source's documents stand in order of size, the words taken differ from the target
    by less than its largest document has.

    Prefix sums are taken in two steps, so that no source stands in one task: within
    blocks of a source (a size and 256 hash classes of ids), and over the counts of blocks.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keys = ["named", "name", "size", "block"]
    own = [F.struct(*carry).alias("row")] if carry else []
    rows = frame.select(
        *own,
        F.col(id_col).alias("id"),
        F.col(source_col).isNotNull().alias("named"),
        F.coalesce(F.col(source_col), F.lit("")).alias("name"),
        word_count(F.col(text_col)).alias("size"),
        F.substring(digest, 1, 2).alias("block"),
    )
    # Words are counted once; carried rows are too wide to be written for that.
    rows = rows if carry else cut(rows)
    # One small row per block: source, size, hash class, number of documents.
    blocks = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")))
    source = F.when(F.col("named"), F.col("name"))
    sizes = blocks.groupBy("named", "name").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = targets(sizes.select(source.alias("source"), "source_size"), weights, float(most))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "source")), 1, 8), 16, 10)
    aims = aims.select(
        F.col("source").isNotNull().alias("named"),
        F.coalesce("source", F.lit("")).alias("name"),
        "source_size",
        "target",
        (offset.cast("double") / F.lit(float(1 << 32))).alias("offset"),
    )
    # Documents before a block: those of smaller sizes, and of earlier blocks of its size.
    smaller = W.partitionBy("named", "name").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    by_size = blocks.groupBy("named", "name", "size").agg(F.sum("n").alias("n"))
    by_size = by_size.withColumn("smaller", F.coalesce(F.sum("n").over(smaller), F.lit(0))).drop("n")
    earlier = W.partitionBy("named", "name", "size").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocks.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(by_size, ["named", "name", "size"])
        .join(aims, ["named", "name"])
        .select(*keys, (F.col("earlier") + F.col("smaller")).alias("before"), "source_size", "target", "offset")
    )
    within = W.partitionBy(*keys).orderBy(F.col("id").asc_nulls_first())
    placed = rows.withColumn("rank", F.row_number().over(within)).join(starts, keys)
    placed = placed.withColumn("rank", F.col("rank") + F.col("before"))
    per_document = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    expected = F.least(per_document, F.lit(float(most)))

    def crossed(rank: Column) -> Column:
        return F.floor(rank * expected + F.col("offset"))

    copies = F.least(crossed(F.col("rank")) - crossed(F.col("rank") - 1), F.lit(most)).cast("long")
    return placed.select("id", source.alias("source"), "size", "source_size", "target", copies.alias("copies"), *(["row"] if carry else []))


def apply(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **mixing) -> DataFrame:
    """The rows of `frame`, each as often as the mix takes it, with all their columns.

    Nulls, empty and long texts, ties and repeated rows as in `mix`; columns may have any name.
    """
    own = by_place(frame)
    named = [own.columns[frame.columns.index(c)] for c in (id_col, text_col, source_col)]
    found = mix(own, *named, carry=tuple(own.columns), **mixing)
    taken = found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select("row.*").toDF(*frame.columns)
