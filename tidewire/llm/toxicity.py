"""Toxicity by weak supervision.

Many voters look at a document: lexicons of words, lexicons of word beginnings, and
patterns of style. Which words telling documents have is mined from labelled rows; after
that no label is looked at. The voters vote on a sample of labelled and unlabelled rows,
and a generative label model estimates by expectation maximisation how often each voter
fires in toxic and in other documents, and from what the votes still share within a
class, which of them are correlated and count for less. Its posteriors label the sample
on which a linear classifier over hashed features is trained; the classifier scores
every document.

Words, votes and features are counted in Spark. What reaches the driver is the lexicons,
one row per pattern of votes, and the few telling features that each sampled row has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm import text as tw
from tidewire.llm.cluster import cut

#: General English words of insult, one voter among others. Fixed values.
INSULTS = tuple("clown disgusting dumb fool idiot jerk loser moron pathetic scum stupid trash worthless".split())

#: Letters of a word's beginning that patterns and features look at.
STEMS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Voters:
    """Lexicons of words and of word beginnings (`stem*`); each, and each style pattern, has a vote."""

    lexicons: tuple[tuple[str, ...], ...]

    def votes(self) -> list[Column]:
        """Votes on a row of `terms`."""
        text = F.col("text")
        letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
        style = [
            2 * F.length(F.regexp_replace(text, r"\P{Lu}+", "")) > F.greatest(letters, F.lit(1)),
            50 * (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) > F.length(text),
            text.rlike(r"(?i)\b(?:you|they)\s+(?:are|re)\b"),
        ]
        words = [F.arrays_overlap("terms", F.array(*map(F.lit, x)).cast("array<string>")) for x in (INSULTS, *self.lexicons)]
        return [*words, *style]


def terms(text: Column) -> Column:
    """The distinct words of a text in lower case, and their beginnings with a star."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = [F.transform(F.filter(words, lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    return F.array_distinct(F.concat(words, *stems))


def mine(sampled: DataFrame, least: int = 4, most: int = 300, parts: int = 4, deviations: float = 4.0) -> Voters:
    """Voters from words and beginnings that documents labelled 1 have far oftener than those labelled 0.

    A term tells if `least` documents labelled 1 have it, at ten times the rate of others, and
    `deviations` standard deviations above the share that chance gives. The `most` best of
    either kind are dealt out to `parts` voters each, so that voters can disagree.
    """
    known = sampled.where("label IS NOT NULL")
    toxic, every = known.agg(F.sum("label"), F.count("*")).first()
    toxic, rest = toxic or 0, (every or 0) - (toxic or 0)
    if not toxic or not rest:
        return Voters(())
    share = toxic / (toxic + rest)
    counted = known.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("toxic"), F.count("*").alias("every"))
    off = (F.col("toxic") - F.col("every") * share) / F.sqrt(F.col("every") * share * (1 - share))
    often = F.col("toxic") * rest >= 10 * (F.col("every") - F.col("toxic")) * toxic
    telling = counted.withColumns({"off": off, "stem": F.col("term").endswith("*")}).where(often & (F.col("toxic") >= least) & (F.col("off") >= deviations))
    rank = F.row_number().over(W.partitionBy("stem").orderBy(F.col("off").desc(), "term"))
    found = telling.withColumn("rank", rank).where(F.col("rank") <= most).select("stem", "rank", "term").collect()
    lexicons = [tuple(sorted(r["term"] for r in found if r["stem"] is stem and r["rank"] % parts == i)) for stem in (False, True) for i in range(parts)]
    return Voters(tuple(x for x in lexicons if x))


class LabelModel:
    """Rates at which voters fire in either class, and weights for what they share.

    `votes` has a row for each pattern of votes, `counts` how many documents show it. Votes
    are taken as independent within a class but for their correlations: after a first fit,
    the correlation of two voters' residuals within the classes tells how much they repeat
    each other, and a voter's evidence is divided among those it repeats.
    """

    def __init__(self, votes: np.ndarray, counts: np.ndarray, first: np.ndarray, rounds: int = 50):
        votes, counts = votes.astype(float), counts.astype(float)
        self.weights = np.ones(votes.shape[1])
        posterior = self._fit(votes, counts, first, rounds)
        self.correlations = self._residual_correlations(votes, counts, posterior)
        shared = np.where(self.correlations > 0.2, self.correlations, 0)
        np.fill_diagonal(shared, 0)
        self.weights = 1 / (1 + shared.sum(1))
        self.posterior = self._fit(votes, counts, posterior, rounds)

    def _fit(self, votes: np.ndarray, counts: np.ndarray, posterior: np.ndarray, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            mass = np.stack([1 - posterior, posterior]) * counts
            self.rates = (mass @ votes + 0.5) / (mass.sum(1, keepdims=True) + 1)
            self.prior = float(np.clip(mass[1].sum() / counts.sum(), 0.01, 0.99))
            posterior = self.predict(votes)
        return posterior

    @property
    def slopes(self) -> np.ndarray:
        """What each vote adds to the log odds."""
        return self.weights * (np.log(self.rates[1] / self.rates[0]) - np.log((1 - self.rates[1]) / (1 - self.rates[0])))

    @property
    def intercept(self) -> float:
        silent = np.log1p(-self.rates)
        return float(self.weights @ (silent[1] - silent[0]) + np.log(self.prior / (1 - self.prior)))

    def predict(self, votes: np.ndarray) -> np.ndarray:
        """Posterior of the toxic class."""
        return 1 / (1 + np.exp(-np.clip(votes @ self.slopes + self.intercept, -60, 60)))

    def _residual_correlations(self, votes: np.ndarray, counts: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        mean = posterior[:, None] * self.rates[1] + (1 - posterior[:, None]) * self.rates[0]
        residual = (votes - mean) * np.sqrt(counts / counts.sum())[:, None]
        scale = np.sqrt((residual**2).sum(0)) + 1e-9
        return residual.T @ residual / np.outer(scale, scale)

    @property
    def accuracies(self) -> np.ndarray:
        """Share of each voter's votes, to fire or not, that agree with the class."""
        return self.prior * self.rates[1] + (1 - self.prior) * (1 - self.rates[0])


def label_model(sampled: DataFrame, voters: Voters) -> LabelModel:
    """The label model of the voters' votes on all sampled rows, labels aside.

    A row is one per pattern of votes here, at most as many as sampled rows. Voters start
    as right by the share of lexicons that fire.
    """
    names = [f"v{i}" for i in range(len(voters.lexicons) + 4)]
    voted = sampled.select(*(v.cast("int").alias(n) for n, v in zip(names, voters.votes())))
    patterns = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    votes = np.array([[r[n] for n in names] for r in patterns], float)
    fired = votes[:, : len(voters.lexicons) + 1].mean(1)
    return LabelModel(votes, np.array([r["n"] for r in patterns]), np.where(fired > 0, 0.5 + 0.45 * fired, 0.05))


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the words of a batch and of their beginnings, repeats included."""
    found = tw.Words(column, tw.ALNUM)
    shift = np.uint64(64 - bits)
    words = found.hashes(lower=True)
    row = found.row
    rows, hashes = [row], [words]
    for n in STEMS:
        # Beginnings are hashed apart from the words that they are.
        longer = found.ends - found.starts > n
        rows.append(row[longer])
        hashes.append(tw.mix(found.hashes(lower=True, first=n) + np.uint64(1))[longer])
    return np.concatenate(rows), (np.concatenate(hashes) >> shift).astype(np.int64)


def distinct(row: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << bits) | bucket)
    return both >> bits, both & ((1 << bits) - 1)


def telling_features(marked: DataFrame, bits: int, deviations: float = 5.0, least: int = 5, most: int = 20_000) -> np.ndarray:
    """Buckets whose share of posterior toxic texts is `deviations` standard deviations off the sample's.

    Words that fewer than `least` texts have don't stand for these texts. At most the `most` farthest off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = np.zeros(1 << bits), np.zeros(1 << bits)
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                row, bucket = distinct(*features(batch.column(0), bits), bits)
                every += np.bincount(bucket, minlength=1 << bits)
                toxic += np.bincount(bucket, batch.column(1).to_numpy()[row], minlength=1 << bits)
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some]), pa.array(toxic[some])], ["bucket", "every", "toxic"])

    share = min(0.99, max(0.01, marked.agg(F.avg("posterior")).first()[0] or 0.0))
    partial = marked.select("text", "posterior").mapInArrow(run, "bucket long, every double, toxic double")
    counted = partial.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("toxic").alias("toxic"))
    off = F.abs(F.col("toxic") - F.col("every") * share) / F.sqrt(F.col("every") * (share * (1 - share)))
    used = counted.withColumn("off", off).where((F.col("off") >= deviations) & (F.col("every") >= least))
    return np.sort(np.array([r["bucket"] for r in used.orderBy(F.col("off").desc(), "bucket").limit(most).collect()], np.int64))


def train(marked: DataFrame, bits: int, rounds: int = 600, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier on which telling features a text has, by posterior labels."""
    used = telling_features(marked, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << bits, -1, np.int64)
        place[used] = np.arange(len(used))
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                row, bucket = features(batch.column(0), bits)
                at = place[bucket]
                both = np.unique(row[at >= 0] * len(used) + at[at >= 0]) if len(used) else row[:0]
                row, at = both // max(1, len(used)), both % max(1, len(used))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1), found], ["posterior", "at"])

    sparse = marked.select("text", "posterior").mapInArrow(run, "posterior double, at array<int>").toArrow().combine_chunks()
    posterior = sparse.column("posterior").to_numpy()
    lists = sparse.column("at").combine_chunks() if len(posterior) else pa.array([], pa.list_(pa.int32()))
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    n, at = len(posterior), lists.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())) if n else at
    share = float(np.clip(posterior.mean(), 0.01, 0.99))
    weights, bias = np.zeros(len(used)), 0.0
    # Both classes weigh the same, whatever their shares of the sample.
    balance = posterior / (2 * share) + (1 - posterior) / (2 * (1 - share))
    squares, bias_square = np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        margin = np.bincount(row, weights[at], minlength=n) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - posterior)
        gradient = np.bincount(at, error[row], minlength=len(used)) / n + ridge * weights
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
        bias_square += error.mean() ** 2
        bias -= 0.5 * error.mean() / np.sqrt(bias_square)
    out = np.zeros(1 << bits)
    out[used] = weights
    return out, float(bias)


def sample(frame: DataFrame, labels: DataFrame, taught: Column, id_col: str, text_col: str, label_col: str, most: int, unlabelled: int) -> DataFrame:
    """(label, text, terms): at most `most` rows of each label where `taught` holds, and `unlabelled` others with a null label.

    Rows come by a hash of their id, one text an id.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).where(taught)
    order = F.xxhash64("id"), F.col("id")
    parts = [known.where(F.col("label") == label).orderBy(*order).limit(most) for label in (0, 1)]
    others = frame.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy(*order).limit(unlabelled)
    parts.append(others.withColumn("label", F.lit(None).cast("int")))
    picked = cut(reduce(DataFrame.union, parts).groupBy("id").agg(F.max("label").alias("label")))
    texts = frame.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # As many rows as the parameters say, and one text of each.
    found = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    return cut(found.select("label", "text", terms(F.col("text")).alias("terms")))


def score(
    frame: DataFrame,
    labels: DataFrame,
    taught: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = 2_500,
    unlabelled: int = 5_000,
    bits: int = 18,
) -> DataFrame:
    """(id, score, n_voters) of each row of `frame`: the classifier's probability of label 1.

    Labels teach only where `taught`, a condition on `id`, holds, and only which words the
    lexicons have. At most `most` labelled rows of each label are looked at, by a hash of
    their id, and `unlabelled` more rows without their labels; every document is scored,
    over its whole text. Ids with labels that disagree count as 1, other labels than 0 and 1
    teach nothing. Null and empty texts get the score of a text without any feature. Without
    taught labels of both kinds every score is 0. Null ids and repeated rows stay and are
    scored each for itself (of an id's rows one text is sampled), an empty table gives no
    rows, other columns are left out. Ties have no part: a score depends on its text alone.
    """
    sampled = sample(frame, labels, taught, id_col, text_col, label_col, most, unlabelled)
    weights, bias, n_voters = np.zeros(1 << bits), -40.0, 0
    if sampled.select("label").distinct().where("label IS NOT NULL").count() == 2:
        voters = mine(sampled)
        model = label_model(sampled, voters)
        votes = [v.cast("double") * float(s) for v, s in zip(voters.votes(), model.slopes)]
        posterior = 1 / (1 + F.exp(-(reduce(lambda a, b: a + b, votes) + model.intercept)))
        weights, bias = train(cut(sampled.select("text", posterior.alias("posterior"))), bits)
        n_voters = len(model.slopes)
    shared = frame.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                row, bucket = features(batch.column(1), bits)
                telling = weights[bucket] != 0
                row, bucket = distinct(row[telling], bucket[telling], bits)
                margin = np.bincount(row, weights[bucket], minlength=batch.num_rows) + bias
                found = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "score"])

    every = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = every.mapInArrow(run, f"id {every.schema['id'].dataType.simpleString()}, score double")
    return scored.withColumn("n_voters", F.lit(n_voters))
