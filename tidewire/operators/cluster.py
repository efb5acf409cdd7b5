"""Related stories: weighted terms, pairs that are close in time and text, and groups of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import clean, overlap, story_terms
from tidewire.operators.profile import bare_title


def inverse_frequencies(frame: DataFrame, terms: Column, rows: Column | None = None) -> DataFrame:
    """(term, idf, df): ln((N + 1) / (df + 1)) + 1 over rows, each of which stands for `rows` of them."""
    each = F.lit(1) if rows is None else rows
    n = frame.agg(F.sum(each).alias("n"))
    told = frame.select(each.alias("k"), F.explode(F.array_distinct(terms)).alias("term"))
    frequency = told.groupBy("term").agg(F.sum("k").alias("df")).crossJoin(F.broadcast(n))
    return frequency.select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"), "df")


def term_weights(counted: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(id, term, w) of (id, term, tf): (1 + ln tf) times the term's idf, scaled to length 1 for each id."""
    weighted = counted.join(frequencies, "term").withColumn("w", (F.log("tf") + 1) * F.col("idf"))
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def vectors(frame: DataFrame, identity: str, terms: Column, frequencies: DataFrame | None = None) -> DataFrame:
    """(id, term, w) of each row's terms; the frequencies are those of the frame unless given.

    Every table here is keyed by (id, term) or term; N is one number.
    """
    counted = frame.select(F.col(identity).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return term_weights(counted, inverse_frequencies(frame, terms) if frequencies is None else frequencies)


def cosine_search(queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, cosine) of each query with every other row that shares a term; both are (id, term, w), queries few."""
    x = queries.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"))
    y = weights.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    return x.join(y, "term").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def leading(weights: DataFrame, least: float) -> DataFrame:
    """(id, term) of `vectors`: each row's rarest terms, up to where the rest is shorter than `least`.

    Where a pair's first shared term is in the rest of either one, its cosine is below `least`:
    so pairs of that cosine or more share one of these terms.
    """
    counted = weights.join(weights.groupBy("term").agg(F.count("*").alias("df")), "term")
    rest = F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id").orderBy("df", "term").rowsBetween(0, W.unboundedFollowing))
    return counted.withColumn("rest", rest).where(F.col("rest") >= least * least - 1e-9).select("id", "term")


#: Rows of a block and time bucket that meet others as one part, and rows of it that are multiplied at once.
PART, SLICE = 16_384, 512
#: A term is common if one pair of rows in so many has it on both sides; products of rare ones that are added at once.
RARE, AT_ONCE = 256, 1 << 20


def counted_terms(rows: DataFrame) -> DataFrame:
    """(id, title, t, tf): the terms of each row's `full` and `own`, by their hash, and how often it has them."""
    hashed = rows.select("id", *(F.transform(c, lambda t: F.xxhash64(t)).alias(c) for c in ("full", "own")))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for title, lists in ((False, part.column(1)), (True, part.column(2))):
                    at, terms = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
                    order = np.lexsort((terms, at))
                    at, terms = at[order], terms[order]
                    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (terms[1:] != terms[:-1]))[: len(at)])
                    tf = np.diff(np.append(first, len(at)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[first])), pa.array(np.full(len(first), title)), pa.array(terms[first]), pa.array(tf)], ["id", "title", "t", "tf"])

    return hashed.mapInArrow(run, f"id {kind}, title boolean, t long, tf long")


def packed_vectors(rows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(id, full, own, full_w, own_w) of (id, full, own): terms by their hash, and their weights of `vectors`.

    Terms of one row alone are left out of `full` after weighing, as they meet nothing. A row's terms
    are counted where it is; they are dealt by term to meet the frequencies, and back by id.
    """
    counted = counted_terms(rows)
    weighted = counted.join(frequencies.select(F.xxhash64("term").alias("t"), "idf", "df"), "t").withColumn("w", (F.log("tf") + 1) * F.col("idf"))
    taken = F.struct("t", "w")
    title = F.col("title")
    found = weighted.groupBy("id").agg(
        *(F.collect_list(F.when(kept, taken)).alias(c) for c, kept in (("full", ~title & (F.col("df") > 1)), ("own", title))),
        *(F.sqrt(F.sum(F.when(kept, F.col("w") * F.col("w")))).alias(f"{c}_norm") for c, kept in (("full", ~title), ("own", title))),
    )
    scaled = lambda c: F.transform(f"{c}.w", lambda w: w / F.col(f"{c}_norm")).alias(f"{c}_w")
    return found.select("id", F.col("full.t").alias("full"), F.col("own.t").alias("own"), scaled("full"), scaled("own"))


def entries(terms: pa.ListArray, weights: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of `packed_vectors`, in order of rows."""
    rows = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    return rows, *(c.flatten().to_numpy(zero_copy_only=False) for c in (terms, weights))


class Products:
    """Dot products of rows of x with all rows of y, both as `entries`.

    Terms that many rows of both have are columns of two matrices; for each of the others the
    rows of x that have it meet those of y.
    """

    def __init__(self, x: tuple, y: tuple, n: int, m: int):
        shared = np.intersect1d(np.unique(x[1]), np.unique(y[1]), assume_unique=True)
        x, y = (self.numbered(part, shared) for part in (x, y))
        counts = [np.bincount(part[1], minlength=len(shared)) for part in (x, y)]
        common = counts[0] * counts[1] * RARE > n * m
        self.m, self.k = m, int(common.sum())
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.x = x
        often = common[y[1]]
        self.matrix = self.dense(*(part[often] for part in y), m)
        rows, terms, weights = (part[~often] for part in y)
        order = np.argsort(terms, kind="stable")
        self.rows, self.weights = rows[order], weights[order]
        self.many = np.where(common, 0, counts[1])
        self.first = np.cumsum(self.many) - self.many

    @staticmethod
    def numbered(part: tuple, shared: np.ndarray) -> tuple:
        at = np.searchsorted(shared, part[1])
        kept = np.flatnonzero(np.append(shared, 0)[at] == part[1])
        kept = kept[at[kept] < len(shared)]
        return part[0][kept], at[kept], part[2][kept]

    def dense(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.k))
        out[rows, self.column[terms]] = weights
        return out

    def of(self, low: int, n: int) -> np.ndarray:
        """The products of the `n` rows of x from `low` on."""
        inside = slice(*np.searchsorted(self.x[0], (low, low + n)))
        rows, terms, weights = (part[inside] for part in self.x)
        rows = rows - low
        often = self.column[terms] >= 0
        found = self.dense(rows[often], terms[often], weights[often], n) @ self.matrix.T
        rows, terms, weights = (part[~often] for part in (rows, terms, weights))
        many = self.many[terms]
        upto = np.cumsum(many)
        stops = np.searchsorted(upto, np.arange(0, int(upto[-1]) if len(upto) else 0, AT_ONCE), "right")
        for a, b in zip(stops, [*stops[1:], len(many)], strict=False):
            each = many[a:b]
            place = np.arange(each.sum()) + np.repeat(self.first[terms[a:b]] - (np.cumsum(each) - each), each)
            np.add.at(found.reshape(-1), np.repeat(rows[a:b] * self.m, each) + self.rows[place], np.repeat(weights[a:b], each) * self.weights[place])
        return found


def likely_pairs(placed: DataFrame, days: int, dates: DataFrame | None = None) -> DataFrame:
    """(a, b, full_cosine, title_cosine): pairs within so many days whose cosines `related` may take.

    `placed` has (id, at, block) and packed vectors, and may have `kin`: pairs that have the same one
    are left out. Rows of a block are in time buckets of `days` days and meet those of their own and
    the next one. Buckets are dealt to parts of about `PART` rows; each pair of parts is one task's
    table, multiplied there in slices, so that only pairs that may link are ever written. The work
    grows with the pairs within reach; memory doesn't. `dates` may have (at, block) of the same rows,
    so that buckets are counted without making the vectors for it.
    """
    packed = ("full", "own", "full_w", "own_w")
    bucket = F.floor(F.unix_seconds("at") / (days * 86_400)).cast("long")
    kin = F.coalesce(*(["kin"] if "kin" in placed.columns else []), F.xxhash64("id"))
    dated = placed.select("id", F.unix_micros("at").alias("at"), "block", bucket.alias("bucket"), kin.alias("kin"), *packed)
    sizes = (dated if dates is None else dates.select("block", bucket.alias("bucket"))).groupBy("block", "bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    after = sizes.select("block", (F.col("bucket") - 1).alias("bucket"), F.col("parts").alias("next"))
    before = sizes.select("block", (F.col("bucket") + 1).alias("bucket"), F.col("parts").alias("last"))
    sizes = sizes.join(after, ["block", "bucket"], "left").join(before, ["block", "bucket"], "left").fillna(0, ["next", "last"])
    dealt = dated.join(F.broadcast(sizes), ["block", "bucket"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # The table that a row goes to: (bucket of the left, its part, whether the right is of the next bucket, its part).
    at = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda bucket, x, beside, y, left: F.struct(bucket.alias("of"), x.alias("x"), F.lit(beside).alias("beside"), y.alias("y"), left.alias("left"))
    own, here = F.col("part"), F.col("bucket")
    tables = F.concat(
        F.transform(at(F.col("parts")), lambda p: place(here, F.least(own, p), False, F.greatest(own, p), own <= p)),
        F.transform(at(F.col("next")), lambda p: place(here, own, True, p, F.lit(True))),
        F.transform(at(F.col("last")), lambda p: place(here - 1, p, True, own, F.lit(False))),
    )
    sent = dealt.select("id", "at", "block", "kin", F.explode(tables).alias("to"), *packed).select("id", "at", "block", "kin", "to.*", *packed)
    reach = days * 86_400_000_000
    kind = placed.schema["id"].dataType.simpleString()
    names = ["a", "b", "full_cosine", "title_cosine"]

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        same = table["x"][0] == table["y"][0] and not table["beside"][0].as_py()
        left = table.filter(table["left"]).combine_chunks()
        right = left if same else table.filter(pa.compute.invert(table["left"])).combine_chunks()
        ids, times = [t["id"] for t in (left, right)], [t["at"].to_numpy() for t in (left, right)]
        if not len(left) or not len(right):
            return pa.table([left["id"][:0], left["id"][:0], pa.array([], pa.float64()), pa.array([], pa.float64())], names)
        full, title = (Products(*(entries(t[c].combine_chunks(), t[f"{c}_w"].combine_chunks()) for t in (left, right)), len(left), len(right)) for c in ("full", "own"))
        kin = [t["kin"].to_numpy() for t in (left, right)]
        out = []
        for low in range(0, len(left), SLICE):
            n = min(SLICE, len(left) - low)
            x, y = full.of(low, n), title.of(low, n)
            # A shade under what `related` takes; shared figures and outlets are looked at after.
            i, j = np.nonzero((x >= 0.25 - 1e-9) | (y >= 0.5 - 1e-9))
            x, y = x[i, j], y[i, j]
            i += low
            likely = (x >= 0.45 - 1e-9) | (y >= 0.2 - 1e-9)
            likely &= (np.abs(times[0][i] - times[1][j]) <= reach) & (kin[0][i] != kin[1][j])
            if same:
                likely &= i < j
            i, j = pa.array(i[likely]), pa.array(j[likely])
            out.append(pa.table([ids[0].take(i), ids[1].take(j), pa.array(x[likely]), pa.array(y[likely])], names))
        return pa.concat_tables(out)

    found = sent.groupBy("block", "of", "x", "beside", "y").applyInArrow(meet, f"a {kind}, b {kind}, full_cosine double, title_cosine double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "full_cosine", "title_cosine")


def related(same_outlet: Column, opinion: Column, title: Column, full: Column, figure: Column) -> Column:
    """Whether two stories are one: by title alone in one outlet, else by text, title, or a shared figure."""
    across = (full >= 0.45) | (title >= 0.5) | (figure & (full >= 0.25) & (title >= 0.2))
    return F.when(same_outlet | opinion, title >= 0.8).otherwise(across)


def average_linkage(links: DataFrame, sizes: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, group): groups merged while the share of linked pairs between two is over `least`, best first.

    `links` has (a, b), a < b; `sizes` has (id, n) of every linked row, which stands for n equal ones.
    Rows with the same links, to each other too, are one group at once. Then in each round all
    pairs of groups merge that are each other's best; of equal shares a pair's digest decides, so
    that large groups merge in few rounds. A group is named by its least id. Links are counted
    between groups by aggregation; no group is gathered. The best pair of all merges in every
    round, so rounds end; there are as many as it takes.
    """
    both = links.select("a", "b").union(links.select("b", "a"))
    digest = lambda c: F.xxhash64(c).cast("decimal(38,0)")
    around = both.groupBy("a").agg(F.sum(digest("b")).alias("s"), F.count("*").alias("k")).withColumn("s", F.col("s") + digest("a"))
    told = sizes.join(around.withColumnRenamed("a", "id"), "id")
    alike = told.groupBy("s", "k").agg(F.min("id").alias("group"), F.sum("n").alias("size"))
    # Tables are written and read again: what is known of a checkpoint's size is multiplied from
    # round to round, until planning takes longer than the work.
    members = stored(told.join(alike, ["s", "k"]).select("id", "group", "size"))
    ends = {side: members.select(F.col("id").alias(side), F.col("group").alias(f"{side}_into"), F.col("size").alias(f"n{side}")) for side in "ab"}
    x, y = (sizes.select(F.col("id").alias(side), F.col("n").alias(f"k{side}")) for side in "ab")
    moved = links.select("a", "b").join(x, "a").join(y, "b").join(ends["a"], "a").join(ends["b"], "b")
    moved = moved.select(F.col("a_into").alias("a"), F.col("b_into").alias("b"), (F.col("ka") * F.col("kb")).alias("n"), "na", "nb")
    members = members.drop("size")
    for turn in count(1):
        swapped = F.col("a") > F.col("b")
        sorted_ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", F.when(swapped, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swapped, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        now = stored(moved.where("a <> b").select(*sorted_ends).groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb")))
        close = now.withColumn("share", F.col("n") / (F.col("na") * F.col("nb"))).where(F.col("share") > least)
        rank = F.struct("share", F.xxhash64("a", "b").alias("h"), "a", "b", (F.col("na") + F.col("nb")).alias("size"))
        best = close.select(F.explode(F.array("a", "b")).alias("end"), rank.alias("rank")).groupBy("end").agg(F.max("rank").alias("rank"))
        pairs = best.groupBy("rank.a", "rank.b").agg(F.count("*").alias("k"), F.first("rank.size").alias("size")).where("k = 2")
        merged = stored(pairs.select(F.explode(F.array("a", "b")).alias("from"), F.col("a").alias("into"), "size"))
        if merged.isEmpty():
            return members
        members = members.join(merged.select("from", "into"), F.col("group") == F.col("from"), "left").select("id", F.coalesce("into", "group").alias("group"))
        members = members if turn % 8 else stored(members)
        x, y = (merged.select(F.col("from").alias(side), F.col("into").alias(f"{side}_into"), F.col("size").alias(f"{side}_size")) for side in "ab")
        moved = now.join(x, "a", "left").join(y, "b", "left")
        moved = moved.select(*(F.coalesce(f"{side}_into", side).alias(side) for side in "ab"), "n", *(F.coalesce(f"{side}_size", f"n{side}").alias(f"n{side}") for side in "ab"))


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once and read back from the checkpoint folder."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """The frame, written once to the checkpoint folder as Parquet: tables of words take far less room so."""
    path = f"{checkpoint_folder(frame.sparkSession)}/stored_{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one set, or the one that `spark.checkpoint.dir` names.

    Only a session on this machine alone, as in tests, gets a folder of this machine where none is named.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context._jsc.sc().getCheckpointDir().get()


def groups(frame: DataFrame, identity: str, title: str, text: str, at: str, outlet: str, block: str, opinion: Column, days: int = 3) -> DataFrame:
    """(id, group) of each row: related stories within a block and `days` days, others by themselves.

    Titles count twice in the text, without the outlet at their end. Rows without a date are
    groups of their own. Rows of one block, time and outlet whose terms are equal are one
    story from the start, and stand in one row from there on.
    """
    base = frame.select(F.col(identity).alias("id"), F.col(title).alias("title"), F.col(text).alias("body"), F.col(at).alias("at"), F.lower(clean(F.col(outlet))).alias("outlet"), F.col(block).alias("block"), opinion.alias("opinion"))
    own = story_terms(bare_title(F.col("title")))
    dated = base.where("at IS NOT NULL").withColumns({"own": own, "full": F.concat(own, own, story_terms(F.col("body")))})
    # Equal rows without a title are not related by it: each stays its own.
    key = F.xxhash64("block", "at", "outlet", "opinion", "own", "full", F.when(F.size("own") == 0, F.col("id")))
    checkpoint_folder(frame.sparkSession)
    # Term columns are long expressions: they are computed once, and plans stay short.
    dated = stored(dated.select("id", "at", "outlet", "block", "opinion", "own", "full", key.alias("key")))
    kept = ("at", "outlet", "block", "opinion", "own", "full")
    rows = stored(dated.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in kept)))
    frequencies = stored(inverse_frequencies(rows, F.col("full"), F.col("rows")))
    # Titles of the same terms are related whatever else differs: such pairs needn't be found.
    kin = F.when(F.size("own") > 0, F.xxhash64("block", F.sort_array("own")))
    scored = likely_pairs(rows.select("id", "at", "block", kin.alias("kin")).join(packed_vectors(rows, frequencies), "id"), days, rows)
    # Years are too common to tell stories apart.
    figures = F.filter("full", lambda t: t.rlike(r"^\d{3,}$") & ~t.rlike(r"^(?:19|20)\d\d$"))
    side = rows.select("id", "outlet", "opinion", figures.alias("figures"))
    x = scored.join(side.toDF("a", "xo", "xp", "xf"), "a").join(side.toDF("b", "yo", "yp", "yf"), "b")
    same_outlet = (F.col("xo") != "") & (F.col("xo") == F.col("yo"))
    links = x.where(related(same_outlet, F.col("xp") | F.col("yp"), F.col("title_cosine"), F.col("full_cosine"), F.arrays_overlap("xf", "yf"))).select("a", "b")
    nodes, links, sizes = alike_rows(rows.select("id", "at", kin.alias("kin"), "rows"), stored(links), days)
    found = average_linkage(links, sizes).withColumnRenamed("id", "node")
    grouped = nodes.join(found, "node", "left").select("id", F.coalesce("group", "node").alias("group"))
    named = rows.select("key", "id").join(grouped, "id", "left").select("key", F.coalesce("group", "id").alias("group"))
    placed = dated.select("id", "key").join(named, "key").select("id", "group")
    return base.select("id").join(placed.distinct(), "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def alike_rows(rows: DataFrame, links: DataFrame, days: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, node), (a, b), (id, n): rows that have the same links stand in one node; links of nodes, and sizes of linked ones.

    `rows` has (id, at, kin, rows), `links` (a, b) of rows that are not of one kin. Those of a kin
    are linked within `days` days, and these links are only made between nodes: rows of a kin and
    time whose other links are the same are one node, named by its least id.
    """
    digest = F.sum(F.xxhash64("b").cast("decimal(38,0)"))
    around = links.union(links.select("b", "a")).groupBy("a").agg(digest.alias("s"), F.count("*").alias("k")).withColumnRenamed("a", "id")
    known = rows.select("id", "at", "kin", "rows").join(around, "id", "left").where("kin IS NOT NULL OR k IS NOT NULL")
    known = stored(known.withColumn("alike", F.xxhash64("kin", "at", "s", "k", F.when(F.col("kin").isNull(), F.col("id")))))
    told = stored(known.groupBy("alike").agg(F.min("id").alias("node"), F.sum("rows").alias("n"), F.first("kin").alias("kin"), F.first("at").alias("at")))
    nodes = stored(known.select("id", "alike").join(told.select("alike", "node"), "alike").select("id", "node"))
    x, y = (nodes.select(F.col("id").alias(side), F.col("node").alias(f"{side}_node")) for side in "ab")
    other = links.join(x, "a").join(y, "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
    bucket = F.floor(F.unix_seconds("at") / (days * 86_400))
    x = told.where("kin IS NOT NULL").select("kin", bucket.alias("bucket"), F.lit(False).alias("beside"), F.unix_micros("at").alias("at"), "node")
    y = x.union(x.select("kin", F.col("bucket") - 1, F.lit(True), "at", "node")).toDF("kin", "bucket", "y_beside", "y_at", "b")
    met = x.join(y, ["kin", "bucket"]).where((F.abs(F.col("at") - F.col("y_at")) <= days * 86_400_000_000) & (F.col("y_beside") | (F.col("node") < F.col("b"))))
    both = stored(other.union(met.select(F.least("node", "b"), F.greatest("node", "b"))))
    linked = both.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return nodes, both, told.select(F.col("node").alias("id"), "n").join(linked, "id", "left_semi")


def overlaps(queries: DataFrame, examples: DataFrame, query_id: str, query_terms: str, example_id: str, example_terms: str) -> DataFrame:
    """(query_id, example_id, score): term overlap of queries and examples that share a term.

    Pairs meet on terms; examples are a bounded library, and its inverted terms are
    aggregated per pair, so a pair is one row whatever it shares.
    """
    q = queries.select(F.col(query_id).alias("q"), F.array_distinct(query_terms).alias("qt"))
    e = examples.select(F.col(example_id).alias("e"), F.array_distinct(example_terms).alias("et"))
    met = q.select("q", F.size("qt").alias("nq"), F.explode("qt").alias("term")).join(e.select("e", F.size("et").alias("ne"), F.explode("et").alias("term")), "term")
    scored = met.groupBy("q", "e").agg((F.count("*") / F.greatest(F.lit(1), F.least(F.first("nq"), F.first("ne")))).alias("score"))
    return scored.select(F.col("q").alias(query_id), F.col("e").alias(example_id), "score")


def nearest(queries: DataFrame, examples: DataFrame, query_id: str, query_terms: str, example_id: str, example_terms: str, most: int) -> DataFrame:
    """(query_id, example_id, score, rank): each query's examples of the highest term overlap, ties by id."""
    scored = overlaps(queries, examples, query_id, query_terms, example_id, example_terms)
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.col("score").desc(), example_id))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def same_story(left_link: Column, right_link: Column, left_title: Column, right_title: Column, left_terms: Column, right_terms: Column) -> Column:
    """Whether two examples are one story: same address, same title, or terms that nearly all agree."""
    close = (overlap(left_terms, right_terms) >= 0.85) & (F.least(F.size(left_terms), F.size(right_terms)) >= 5)
    return (left_link == right_link) | (left_title == right_title) | close
