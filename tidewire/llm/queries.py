"""One query per operator over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import alignment, byte_bpe, importance, language_id, license_scan, media, mixing, periodic_runs, quality_rules, sentencepiece, simhash, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of 50 words that earlier ones have."""
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"), window=50, texts=False)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def fold(id_: Column, n: int) -> Column:
    """The fold of an id: crc32 of its text modulo n; null for a null id."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(n))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three folds of four."""
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = language_id.identify(table(spark, sf_dir, "documents"), ~held_out & F.col("doc_id").isNotNull())
    found = found.withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, learned from labels of two folds of three."""
    taught = F.coalesce(fold(F.col("id"), 3) != 1, F.lit(False))
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), taught)
    held_out = F.coalesce(fold(F.col("id"), 3) == 1, F.lit(False)).alias("held_out")
    return found.select(
        F.col("id").alias("doc_id"), held_out, "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a bitmap, found by its signature and read back."""
    return media.stored(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document for text like that of good quality, and the sample by it."""
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


#: The vocabulary file; the driver alone reads it.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    found = sentencepiece.round_trip(spark, table(spark, sf_dir, "documents"), PIECES)
    return found.withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and what the learned rules make of them."""
    found, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(F.col("id").alias("doc_id"), *base)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over three-word shingles, linked at two differing bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and passages of licenses in every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    exact = F.filter("spans", lambda s: s["exact"])

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(F.transform(exact, lambda s: s["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(exact, lambda s: s["start"])).cast("long").alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.when(F.size("spans") > 0, F.col("score")).otherwise(0.0).alias("score"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words that it takes of each, repeats counted."""
    found = mixing.mix(table(spark, sf_dir, "documents"), most=3)
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken")
    )


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS total, count(*) AS n,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), fill AS (
  -- Rounds of the resharing: sources over their cap stop there, the rest share again.
  SELECT 0 AS round, source, total, weight, false AS stopped, 0::DOUBLE AS target FROM s
  UNION ALL
  SELECT round + 1, source, total, weight, stopped OR share >= 3 * total, CASE WHEN stopped OR share >= 3 * total THEN 3 * total ELSE share END
  FROM (
    SELECT *, CASE WHEN stopped THEN 0 ELSE weight / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER ()
        * (sum(total) OVER () - sum(CASE WHEN stopped THEN 3 * total ELSE 0 END) OVER ()) END AS share
    FROM fill WHERE round < 40
  )
), t AS (
  SELECT source, total, target, ('0x' || substr(md5(concat_ws(':', 'mix', source)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM fill WHERE round = (SELECT max(round) FROM fill)
), r AS (
  SELECT d.doc_id, d.size, t.total, t.target, t.shift,
         CASE WHEN t.total = 0 THEN 0 ELSE least(t.target / t.total, 3) END AS each,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, substr(md5(d.doc_id::VARCHAR), 1, 2), d.doc_id) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, total::BIGINT AS source_size, round(target, 6) AS target,
       (size * least(floor(rank * each + shift) - floor((rank - 1) * each + shift), 3))::BIGINT AS taken
FROM r
"""


#: Vocabulary files of the byte-level tokenizers.
BYTE_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens of every document, and the text that they decode to."""
    found = byte_bpe.encode(table(spark, sf_dir, "documents"), byte_bpe.Merges.load(BYTE_RANKS), decoded=True)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How byte-level tokens and pieces of every document align, and how common their links are."""
    documents, _ = alignment.align(table(spark, sf_dir, "documents"), alignment.Both.load(BYTE_MODEL, PIECES))
    return documents.withColumnRenamed("id", "doc_id")


def looped(frame: DataFrame) -> DataFrame:
    """The documents, of which some end in a loop of their own words: a known plant to find runs in.

    h is crc32 of the id as text, g = h div 10. Where h divides by 10 and the text has n > 0
    words, the words from place a = g % n on repeat with period 1 + (n - a) div (3 + g % 8).
    """
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = frame.select("doc_id", "text", F.floor(mark / 10).alias("g"), F.when(mark % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    sized = chosen.withColumn("n", F.nullif(F.size("words"), F.lit(0)))
    placed = sized.withColumn("a", F.col("g") % F.col("n"))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    loops = F.array_repeat(F.expr("slice(words, int(a) + 1, int(p))"), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    placed = placed.withColumn("loops", F.flatten(loops))
    whole = F.concat(F.expr("slice(words, 1, int(a))"), F.expr("slice(loops, 1, int(n - a))"))
    return placed.select("doc_id", F.coalesce(F.array_join(whole, " "), "text").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that repeat four times or more in every document, and what is left without the repeats."""
    found = periodic_runs.periodic_runs(looped(table(spark, sf_dir, "documents")), texts=False)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    return found.withColumn("top", ranked).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.back")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.less")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.less")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_substring_dedup": op1_substring_dedup, "op10_license_scan": op10_license_scan, "op11_byte_bpe": op11_byte_bpe, "op12_alignment": op12_alignment, "op13_periodic_runs": op13_periodic_runs, "op2_language_id": op2_language_id, "op3_toxicity": op3_toxicity, "op4_media": op4_media, "op5_importance": op5_importance, "op6_sentencepiece": op6_sentencepiece, "op7_quality_rules": op7_quality_rules, "op8_simhash": op8_simhash, "op9_mixing": op9_mixing}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": OP9_SQL}
