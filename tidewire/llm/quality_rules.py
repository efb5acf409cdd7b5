"""Quality rules: a learned, ordered list of threshold conjunctions over text statistics.

Statistics are DataFrame expressions over each whole text. Sequential covering
learns rules for bad documents from labelled statistics: a rule grows by the
threshold that gains most on one part of the labelled rows, loses conditions that
don't pay on another part, and takes the rows it covers out before the next one is
grown. What is learned is a Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.cluster import by_place, cut
from tidewire.llm.text import SPACE

#: Words of a window whose repetition counts.
WINDOW = 8

#: Statistics that rules look at, by name, as expressions over `statistics`.
RATIOS = {
    "words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / nullif(n_words, 0)",
    "symbols": "n_symbols / nullif(word_chars, 0)",
    "capitals": "n_capitals / nullif(word_chars, 0)",
    "marks": "n_marks / nullif(word_chars, 0)",
    "digits": "n_digits / nullif(word_chars, 0)",
    "distinct": "n_distinct / nullif(n_words, 0)",
    "repeated": "n_repeat_words / nullif(n_words, 0)",
    "lines": "n_dup_lines / nullif(n_words, 0)",
}


def statistics(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...) of each row.

    `key` is a hash of the text.
    A null or empty text has 0 everywhere. Rows with null ids and repeated rows stay;
    an empty table gives no rows; other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t\n\x0B\f\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")

    def left(keep: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{keep}]++", ""))

    counted = frame.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("key"),
        words.alias("words"),
        lines.alias("lines"),
        left(r"#*$%&|<>").alias("n_symbols"),
        left(r"A-ZÀ-ÖØ-Þ").alias("n_capitals"),
        left(r"!?.,;:").alias("n_marks"),
        left(r"0-9").alias("n_digits"),
    )
    n = F.size("words")
    hashes = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = counted.withColumn("hashes", hashes)
    # Windows in order of hash, of texts where some hash comes twice; equal ones stand side by side.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    zipped = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    placed = hashed.withColumn("sorted", F.when(repeats, F.sort_array(zipped)))

    def twice(x: Column, k: Column) -> Column:
        def same(j: Column) -> Column:
            return F.coalesce(F.get("sorted", j)["h"] == x["h"], F.lit(False))

        return same(k - 1) | same(k + 1)

    starts = F.sort_array(F.transform(F.filter("sorted", twice), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n")),
        lambda s: s["n"],
    )
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_capitals": F.col("n_capitals"),
        "n_marks": F.col("n_marks"),
        "n_digits": F.col("n_digits"),
    }
    return placed.select("id", "key", *(c.cast("long").alias(name) for name, c in counts.items()))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    @property
    def sql(self) -> str:
        return f"{RATIOS[self.name]} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are bad."""

    conditions: tuple[Condition, ...]

    @property
    def sql(self) -> str:
        return " AND ".join(f"coalesce({c.sql}, false)" for c in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: true where no rule finds the document bad."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.expr(rule.sql), F.lit(False)).otherwise(out)
    return out


def learn(
    labelled: DataFrame,
    bad: str = "bad",
    max_rules: int = 8,
    max_conditions: int = 3,
    cuts: int = 24,
    positive_cuts: int = 12,
    precision: float = 0.9,
) -> list[Rule]:
    """Rules for rows of statistics whose column `bad` is true.

    All labelled rows count; null labels don't. Thresholds lie midway between neighbouring
    quantiles of either kind's values, and of its positive values, for a statistic that is
    mostly 0 has no other small ones. What reaches the driver is a count per statistic, threshold and label, which
    doesn't grow with the rows. A third of the rows, by id, prunes rules. A rule stays if
    the share `precision` of what it covers there is bad. Of conditions that gain the same
    the first one by statistic and threshold is taken. Without rows of both kinds there are
    no rules.
    """
    known = labelled.where(F.col(bad).isNotNull())
    ratios = known.select(
        F.col(bad).alias("bad"),
        (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("prune"),
        *(F.expr(f"CAST({sql} AS DOUBLE)").alias(name) for name, sql in RATIOS.items()),
    )
    at = [i / cuts for i in range(cuts + 1)]
    above = [i / positive_cuts for i in range(positive_cuts + 1)]
    positive = (F.percentile_approx(F.when(F.col(name) > 0, F.col(name)), above, 1000).alias(f"{name}_above") for name in RATIOS)
    quantiles = ratios.groupBy("bad").agg(*(F.percentile_approx(name, at, 1000).alias(name) for name in RATIOS), *positive).collect()
    if len(quantiles) < 2:
        return []
    values = {name: sorted({x for row in quantiles for c in (name, f"{name}_above") for x in row[c] or ()}) for name in RATIOS}
    thresholds = {name: [(a + b) / 2 for a, b in zip(v, v[1:])] for name, v in values.items()}

    def bin_of(name: str) -> Column:
        # Thresholds below the value; null has a bin of its own, which no condition meets.
        bounds = F.array(*map(F.lit, thresholds[name])) if thresholds[name] else F.array().cast("array<double>")
        return F.when(F.col(name).isNotNull(), F.size(F.filter(bounds, lambda b: b < F.col(name)))).otherwise(-1)

    binned = ratios.select("bad", "prune", *(bin_of(name).alias(name) for name in RATIOS))
    rows = cut(binned.groupBy(*binned.columns).agg(F.count("*").alias("n")))

    def meets(conditions: tuple[Condition, ...]) -> Column:
        def one(c: Condition) -> Column:
            index = thresholds[c.name].index(c.threshold)
            return F.col(c.name) > index if c.above else F.col(c.name).between(0, index)

        return reduce(lambda a, b: a & b, map(one, conditions), F.lit(True))

    def tally(frame: DataFrame) -> dict[str, dict[tuple[int, bool], int]]:
        bins = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("bin")) for name in RATIOS)))
        counts = frame.select("bad", "n", bins.alias("x")).groupBy("x.name", "x.bin", "bad").agg(F.sum("n").alias("n"))
        out: dict[str, dict[tuple[int, bool], int]] = {name: {} for name in RATIOS}
        for r in counts.collect():
            out[r["name"]][r["bin"], r["bad"]] = r["n"]
        return out

    def best(frame: DataFrame) -> Condition | None:
        found, most = None, 1e-9
        for name, counts in tally(frame).items():
            p, q = (sum(n for (_, is_bad), n in counts.items() if is_bad is want) for want in (True, False))
            if not p or not q:
                return None
            below = {True: 0, False: 0}
            total = {k: sum(n for (b, is_bad), n in counts.items() if is_bad is k and b >= 0) for k in below}
            for index, threshold in enumerate(thresholds[name]):
                for k in below:
                    below[k] += counts.get((index, k), 0)
                for above in (False, True):
                    x, y = (total[k] - below[k] if above else below[k] for k in (True, False))
                    gain = x * (math.log2(x / (x + y)) - math.log2(p / (p + q))) if x else 0.0
                    if gain > most:
                        found, most = Condition(name, above, threshold), gain
        return found

    rules: list[Rule] = []
    left = growing = rows
    for _ in range(max_rules):
        conditions: tuple[Condition, ...] = ()
        grown = growing.where(~F.col("prune"))
        while len(conditions) < max_conditions and (found := best(grown.where(meets(conditions)))):
            conditions += (found,)
        if not conditions:
            break
        # Prune: the leading conditions that do best on rows that had no part in growing.
        parts = [meets(conditions[: i + 1]) for i in range(len(conditions))]
        sums = [F.sum(F.when(part & (F.col("bad") == want), F.col("n")).otherwise(0)) for part in parts for want in (True, False)]
        counts = [x or 0 for x in left.where("prune").agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        scored = [((x - y) / (x + y), x, -i) for i, (x, y) in enumerate(zip(counts[::2], counts[1::2])) if x + y]
        worth, covered, i = max(scored, default=(-1.0, 0, -len(conditions) + 1))
        rule = Rule(conditions[: 1 - i])
        # What a rule covers grows no other one, though the rule itself stays only if it is precise.
        growing = growing.where(~meets(rule.conditions))
        if covered >= 2 and (worth + 1) / 2 >= precision:
            rules.append(rule)
            left = left.where(~meets(rule.conditions))
    return rules


def judge(
    frame: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    **learning: float,
) -> tuple[DataFrame, list[Rule]]:
    """Statistics of each row with `base_failed` and `kept`, and the rules learned from `labels`.

    A document is bad where `label_col` of its id is 0. Ids with labels that disagree
    count as good; null labels and ids teach nothing. `kept` is never null.
    """
    stats = cut(statistics(frame, id_col, text_col))
    taught = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where("id IS NOT NULL")
    labelled = stats.join(taught, "id").withColumn("bad", F.col("label") == 0)
    rules = learn(labelled, **learning)
    failed = base_failed()
    return stats.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules)}), rules


def keep(frame: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning: float) -> DataFrame:
    """The rows of `frame` that `judge` keeps, as they are, with all their columns.

    Rows meet their verdict by id and text, so null ids and repeated rows get the one of
    their own text; null, empty and long texts as in `statistics`. Columns may have any name.
    """
    own = by_place(frame)
    id_at, text_at = (own.columns[frame.columns.index(c)] for c in (id_col, text_col))
    found, _ = judge(own, labels.withColumnRenamed(id_col, id_at), id_at, text_at, **learning)
    kept = found.where("kept").select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    same = F.col(id_at).eqNullSafe(F.col("kept_id")) & (F.xxhash64(F.coalesce(F.col(text_at), F.lit(""))) == F.col("kept_key"))
    return own.join(kept, same, "left_semi").toDF(*frame.columns)
