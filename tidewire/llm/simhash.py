"""Near duplicates by SimHash fingerprints and tables of distances to pivots.

A text's fingerprint has a bit set where more than half of its shingle hashes have
it. Its pivot table row holds its Hamming distances to reference fingerprints. By
the triangle inequality two fingerprints within distance r differ by at most r in
each coordinate.

The pivots are one base fingerprint, the base with one bit inverted for each bit, and
some random ones. What a bit's coordinate has over the base coordinate depends on that
bit alone, so r differing bits leave all but r of these differences as they are. The
bits form groups, r + 2 of them for r bits: two groups at least then agree in every
coordinate, and an equality join on the coordinates of each pair of groups meets every
pair within r. The largest difference in the random pivots' coordinates then discards
most pairs that met, and the survivors are verified on the fingerprints themselves.

Fingerprints only estimate a Jaccard similarity. `near_copies` therefore counts the
shingles that texts share: of those that pivot tables bring together first, and then of
those not joined yet that meet on their rarest shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.cluster import bucketed, components, cut, discard, thinned

#: Bits of a fingerprint.
BITS = 64
#: The base pivot, and random pivots.
BASE = 0x5B1D6E93C4A7F208
RANDOM = tuple(int(x) for x in np.random.default_rng(8).integers(-(1 << 63), (1 << 63) - 1, 16))
#: Fingerprints of a bucket that meet in pairs; larger buckets meet at their neighbours.
CROWD = 256


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each of a text's word shingles (a short text: of its whole sequence)."""
    tokens = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    width = min(shingle, len(tokens))
    spans = zip((ends - lengths)[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(tokens) - width + 1)


def ones(bits: np.ndarray) -> np.ndarray:
    """How often each column of 0 and 1 is 1: bytes hold the sums of up to 255 rows."""
    full = len(bits) // 255 * 255
    blocks = bits[:full].reshape(-1, 255, bits.shape[1]).sum(1, dtype=np.uint8)
    return blocks.sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.uint8)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of the hashes of shingles, repeats included; 0 if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65280):
        block = hashes[at : at + 65280].view(np.uint8).reshape(-1, 8)
        counts += ones(np.unpackbits(block, axis=1, bitorder="little"))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint as a signed 64-bit integer) of each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "print"])

    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, print long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivots() -> list[int]:
    """The reference fingerprints: base, base with each bit inverted, random ones."""
    return [signed(BASE), *(signed(BASE ^ (1 << b)) for b in range(BITS)), *RANDOM]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(frame: DataFrame) -> DataFrame:
    """The frame's `print` with `table`, its distances to each pivot."""
    at = F.array(*(distance(F.col("print"), F.lit(p)).cast("byte") for p in pivots()))
    return frame.withColumn("table", at)


def keys(max_distance: int) -> list[Column]:
    """A key for each pair of groups: which of their bits' coordinates are over the base's."""
    parts = max_distance + 2
    bounds = [round(BITS * i / parts) for i in range(parts + 1)]
    base = F.get("table", F.lit(0)).cast("long")

    def key(*groups: int) -> Column:
        at = F.concat(*(F.slice("table", bounds[g] + 2, bounds[g + 1] - bounds[g]) for g in groups))
        return F.aggregate(at, F.lit(0).cast("long"), lambda made, x: F.shiftleft(made, 1) + F.shiftright(x - base + 1, 1))

    return [key(*pair) for pair in combinations(range(parts), 2)]


def near_pairs(prints: DataFrame, max_distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links between distinct values of `print` that differ in 1 to `max_distance` bits (2 at most).

    Returns (a, b), a < b. Every pair is there, but for buckets with more than `crowd`
    fingerprints, as groups of near copies have them. There each fingerprint meets the others
    at the fingerprints one bit away from it, or half of `max_distance`: who meets at one of
    these is within `max_distance`, and whoever is within it meets. Each links to the least
    one that is there. Such links are true ones, they join whatever the left-out pairs join,
    and there are `BITS` + 1 for a fingerprint at most. Nulls are left out.
    """
    if not 1 <= max_distance <= 2:
        raise ValueError("links are by one or two bits")
    tabled = pivot_table(prints.select("print").where("print IS NOT NULL").distinct())
    random = F.slice("table", BITS + 2, len(RANDOM))
    dealt = tabled.select("print", random.alias("far"), F.posexplode(F.array(*keys(max_distance))).alias("probe", "key"))
    sizes = dealt.groupBy("probe", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(dealt.join(sizes, ["probe", "key"]))
    few = met.where(F.col("n") <= crowd)
    x = few.select("probe", "key", F.col("print").alias("a"), F.col("far").alias("xs"))
    y = few.select("probe", "key", F.col("print").alias("b"), F.col("far").alias("ys"))
    # Discard by the largest coordinate difference, then verify.
    apart = F.greatest(*(F.abs(F.get("xs", F.lit(i)) - F.get("ys", F.lit(i))) for i in range(len(RANDOM))))
    pairs = x.join(y, ["probe", "key"]).where("a < b").where(apart <= max_distance)
    close = pairs.where(distance(F.col("a"), F.col("b")) <= max_distance).select("a", "b")
    crowded = met.where(F.col("n") > crowd).select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << b)) for b in range(BITS)))
    beside = crowded.select("print", F.explode(flips).alias("flip")).withColumn("at", F.col("print").bitwiseXOR(F.col("flip")))
    if max_distance == 1:
        # Who is one bit apart is at the other's place.
        own = F.col("flip") == 0
        ends = beside.where(own).select("at", F.col("print").alias("a")).join(beside.where(~own).select("at", F.col("print").alias("b")), "at")
        stars = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    else:
        least = beside.groupBy("at").agg(F.min("print").alias("a"), F.count("*").alias("n")).where("n > 1")
        stars = beside.join(least.select("at", "a"), "at").where("a <> print").select("a", F.col("print").alias("b"))
    return close.union(stars).distinct()


def near_duplicates(
    frame: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_distance: int = 2,
) -> DataFrame:
    """(id, print, component) of each row of `frame`.

    Rows link where their fingerprints differ in `max_distance` bits or fewer;
    `component` is the least id that links reach from the row's, itself included.
    Texts without a word (null and empty ones too) have fingerprint 0 and link like
    any others. Rows with a null id keep it, and join components that other rows'
    ids name (null where no row of the component has an id). Repeated rows stay
    repeated. A bit that exactly half of the hashes have is 0. Texts count whole, however
    long. An empty table gives no rows; other columns are left out.
    """
    rows = cut(fingerprints(frame, id_col, text_col, shingle))
    distinct = cut(rows.groupBy("print").agg(F.min("id").alias("least")))
    roots = components(near_pairs(distinct, max_distance))
    rooted = distinct.join(roots, F.col("print") == F.col("node"), "left")
    rooted = rooted.select("print", "least", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.join(named, "root").select("print", "component")
    return rows.join(labels, "print").select("id", "print", "component")


#: Fingerprints of a bucket that meet in pairs when pivot tables bring near copies together.
FEW = 32
#: Sets of a shingle that are dealt to one part of it when all of them meet.
PART = 1024
#: Sets of a shingle that all meet at once; of more, each first meets `STARS` others a round, for `ROUNDS` rounds at most.
MEET, STARS, ROUNDS = 64, 8, 4
#: Bits of a set's parity, and shingles before a place that are held against meeting twice.
PARITY_BITS, EARLIER = 1024, 16


def least_shared(n: int, similarity: float) -> int:
    """Shingles that a set of `n` shares with any other of the similarity or more."""
    return math.ceil(similarity * n - 1e-9)


def sketch(n: int, similarity: float) -> tuple[int, int]:
    """How many of `n` ordered shingles to look at, and how many of them any similar set has there too.

    Sets of n and m >= n shingles that share o have, before the l-th shared one, at most n - o
    and m - o others, so they share l among their first n - o + l and m - o + l. A set asks for
    a twentieth of its shingles; a similar set may be smaller and ask for less.
    """
    return min(n, n - least_shared(n, similarity) + math.ceil(n / 20)), math.ceil(least_shared(n, similarity) / 20)


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls to each of `PARITY_BITS` places, as 64-bit integers.

    Parities of two sets differ only in places of shingles that one of them has alone, so in
    no more places than there are such shingles.
    """
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_sketches(frame: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, node, need, shingles) of (id, text): a digest of the set of shingles and its `sketch`.

    `need` of the sketch must be others' too. The shingles are cut to 32 bits, which can only add
    to what sets share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in batch.column(1)]
            taken = [sketch(len(x), similarity) for x in sets]
            ends = np.cumsum([0, *(t for t, _ in taken)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *(x[:t] for x, (t, _) in zip(sets, taken))]) >> np.uint64(32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.uint32).view(np.int32)))
            columns = [batch.column(0), pa.array([node(x) for x in sets], pa.int64()), pa.array([n for _, n in taken], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "need", "shingles"])

    kind = frame.schema["id"].dataType.simpleString()
    return frame.select("id", "text").mapInArrow(run, f"id {kind}, node long, need long, shingles array<int>")


def node(hashes: np.ndarray) -> int:
    """A digest of a set of shingles."""
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), 7))


def shingle_sets(frame: DataFrame, shingle: int) -> DataFrame:
    """(node, n, twins, print, shingles, parity) of `text`: a digest of the set of shingles, its size, fingerprint and shingles in order.

    `twins` says how many shingles are like another one in their upper 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in batch.column(0)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            odd = np.concatenate([np.zeros(0, np.int64), *map(parity, sets)])
            rows = np.arange(len(sets) + 1, dtype=np.int32) * (PARITY_BITS // 64)
            columns = [pa.array([f(x) for x in sets], pa.int64()) for f in (node, len, twins, fingerprint)]
            columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for at, x in ((ends, flat), (rows, odd))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "twins", "print", "shingles", "parity"])

    return frame.select("text").mapInArrow(run, "node long, n long, twins long, print long, shingles array<long>, parity array<long>")


def twins(hashes: np.ndarray) -> int:
    upper = hashes >> np.uint64(32)
    return int((upper[1:] == upper[:-1]).sum())


def enough(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    """Whether sets of n and m have the similarity if they share so many."""
    return shared * (1 + similarity) >= (n + m) * similarity - 1e-6


def near_copies(
    frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(id, component) of each row of `frame` with an id: groups of texts of a similarity or more.

    Texts link where the Jaccard similarity of their sets of shingles, counted exactly, is at
    least `similarity`. `component` is the least id that links reach. Texts with equal sets
    always link, so those that are equal but for case and white space, and null and empty
    ones with each other.

    Fingerprints of the sets and their pivot tables bring most copies together, each set with
    the least one near it. Whatever they miss is met exactly: with a text's shingles in order of
    how many texts have them, one of the first n - ceil(similarity * n) + 1 is among the other's
    first ones. Texts meet on these, and where so many shingles are left behind the first they
    share that the similarity can be reached. A large group of copies would meet in the square
    of its size; so each shingle's texts first meet a single one of them, which joins the group;
    those of crowded shingles then meet a few others in rounds, until a round joins nothing;
    and then only texts that are not joined yet meet.

    Rows without an id are left out; repeated rows have a row each. Texts count whole, however
    long. An empty table gives no rows; other columns are left out. There are no ties: a
    similarity of exactly `similarity` links.
    """
    given = frame.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(shingle_sketches(given, shingle, similarity))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("need").alias("need"), F.count("*").alias("copies")))
    # Only texts whose sketch has enough shingles of other texts can have a similar one.
    dealt = rows.select("node", F.explode("shingles").alias("shingle"))
    shared = dealt.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("shingle")
    shared = cut(shared)
    hits = thinned(dealt, "shingle", shared).join(shared, "shingle").groupBy("node").agg(F.count("*").alias("hits"))
    likely = cut(nodes.join(hits, "node").where("hits >= need * copies").select("node", F.col("least").alias("id")))
    texts = thinned(given, "id", likely).join(likely.select("id").distinct(), "id")
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = shingle_sets(texts, shingle).repartition(parts, "node").join(likely.select("node"), "node", "left_semi")
    sets, name = bucketed(sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "twins", "print", "shingles", "parity"))), "node")

    first = cut(prefixes(sets, similarity))
    alone = first.withColumn("part", F.col("node"))
    links = similar(pivot_pairs(sets).union(star_pairs(alone, similarity)).distinct(), sets, similarity)
    labels = crowds_joined(cut(components(links)), first, sets, similarity)
    labelled = with_root(first, "node", labels, "part")
    more = similar(all_pairs(labelled, sets, similarity), sets, similarity)
    # What still links is joined on the level of the groups that there are.
    higher = cut(components(with_root(with_root(more, "a", labels, "x"), "b", labels, "y"), "x", "y"))
    discard(frame.sparkSession, name)
    rooted = with_root(with_root(nodes.select("node", "least"), "node", labels, "low"), "low", higher, "root")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rows.select("id", "node").join(rooted.join(named, "root").select("node", "component"), "node").select("id", "component")


def with_root(frame: DataFrame, node: str, labels: DataFrame, out: str) -> DataFrame:
    """The frame with the root of each row's `node`, itself where it has none."""
    known = labels.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return frame.join(known, F.col(node) == F.col("_node"), "left").withColumn(out, F.coalesce("_root", node)).drop("_node", "_root")


def pivot_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): each set with one of its fingerprint, and one set of each fingerprint with the least near it."""
    prints = sets.groupBy("print").agg(F.min("node").alias("first"))
    equal = sets.select("node", "print").join(prints, "print").where("node <> first").select("first", "node")
    near = near_pairs(prints, crowd=FEW).groupBy("b").agg(F.min("a").alias("a"))
    x, y = (prints.select(F.col("print").alias(side), F.col("first").alias(f"{side}_node")) for side in "ab")
    both = equal.union(near.join(x, "a").join(y, "b").select("a_node", "b_node")).toDF("x", "y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, n, place): each set's first shingles, rarest first, that other sets have too.

    Shingles are told apart by 32 bits here, which can only make more sets meet; as a set's own
    twins may stand in any order, so many more shingles count as first.
    """
    cut_bits = F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int"))
    dealt = sets.select("node", "n", "twins", F.explode(cut_bits).alias("shingle"))
    counts = cut(dealt.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1"))
    shared = thinned(dealt, "shingle", counts).join(counts, "shingle")
    order = F.sort_array(F.collect_list(F.struct("sets", "shingle")))
    ordered = shared.groupBy("node", "n", "twins").agg(order.alias("found"))
    # A set's own shingles come before those it shares.
    own = F.col("n") - F.size("found")
    most = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 + F.col("twins")
    taken = F.expr("slice(found, 1, cast(greatest(0, most - own) as int))")
    placed = ordered.withColumns({"own": own, "most": most}).select("node", "n", "twins", "own", F.posexplode(taken).alias("at", "x"))
    return placed.select(F.col("x.shingle").alias("shingle"), "node", "n", (F.col("own") + F.col("at") - F.col("twins")).alias("place"))


def reachable(similarity: float) -> Column:
    """Whether x and y can be similar, if the shingle they meet on is the first one they share."""
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    return (F.col("x.part") != F.col("y.part")) & enough(left, F.col("x.n"), F.col("y.n"), similarity)


def ordered_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def star_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each shingle's sets with one of them."""
    star = F.min_by(F.struct("node", "n", "place", "part"), F.xxhash64("node"))
    stars = rows.groupBy("shingle").agg(star.alias("s")).select("shingle", "s.*")
    return ordered_pairs(rows.alias("x").join(stars.alias("y"), "shingle").where(reachable(similarity)))


def crowds_joined(labels: DataFrame, first: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """`labels` (node, root) with what links in shingles of more than `MEET` sets, each round with other stars.

    A set that is similar to many of a crowd meets one of them soon, so few such sets are left
    to meet all. Rounds end when one links nothing, and links are true ones: who meets here
    decides only what is left for `all_pairs`.
    """
    large = first.groupBy("shingle").agg(F.count("*").alias("size")).where(F.col("size") > MEET).select("shingle")
    crowd = cut(first.join(large, "shingle").join(sets.select("node", "parity"), "node"))
    if not crowd.head(1):
        return labels
    for turn in range(ROUNDS):
        links = cut(similar(crowd_pairs(with_root(crowd, "node", labels, "part"), similarity, turn), sets, similarity))
        if not links.head(1):
            break
        labels = cut(components(labels.select(F.col("root").alias("a"), F.col("node").alias("b")).union(links)))
    return labels


def crowd_pairs(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(a, b): each shingle's sets with up to `STARS` of them that are in other parts and may be similar.

    The stars are others for each shingle and turn.
    """
    star = F.min_by(F.struct("node", "n", "place", "part", "parity"), F.xxhash64("node", "shingle", F.lit(turn)))
    ray = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(STARS)).alias("ray")
    stars = rows.groupBy("shingle", ray).agg(star.alias("s")).select("shingle", "s.*")
    return ordered_pairs(rows.alias("x").join(stars.alias("y"), "shingle").where(reachable(similarity) & few_alone(similarity)))


def few_alone(similarity: float) -> Column:
    """Whether the parities of x and y differ in no more places than similar sets have shingles alone."""
    apart = reduce(lambda p, q: p + q, (distance(F.get("x.parity", F.lit(i)), F.get("y.parity", F.lit(i))) for i in range(PARITY_BITS // 64)))
    # Sets that have d shingles alone share (n + m - d) / 2.
    size = F.col("x.n") + F.col("y.n")
    return enough((size - apart) / 2, F.col("x.n"), F.col("y.n"), similarity)


def all_pairs(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all sets of a shingle that are in different parts and may be similar.

    The sets of the shingle's largest part don't meet each other, so only the others are on one
    side, dealt to one task for each `PART` sets of the shingle. A pair comes from the first
    shingle it shares, and only if its parities differ in no more places than similar sets have
    shingles alone.
    """
    parts = rows.groupBy("shingle", "part").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("shingle").agg(
        F.max_by("part", F.struct("size", "part")).alias("largest"), F.count("*").alias("parts"), F.ceil(F.sum("size") / PART).cast("int").alias("salts")
    ).where("parts > 1")
    before = W.partitionBy("node").orderBy("place").rowsBetween(-EARLIER, -1)
    right = rows.join(mixed.select("shingle", "largest", "salts"), "shingle").withColumn("before", F.collect_list("shingle").over(before))
    right = right.join(sets.select("node", "parity"), "node")
    left = right.where("part <> largest").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    once = (F.col("y.part") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    first = ~F.arrays_overlap("x.before", "y.before")
    return ordered_pairs(left.alias("x").join(right.alias("y"), ["shingle", "salt"]).where(reachable(similarity) & once & few_alone(similarity) & first))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets, intersected, have the similarity."""
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xs"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("ys"))
    both = pairs.join(x, "a").join(y, "b")
    return both.where(enough(F.size(F.array_intersect("xs", "ys")), F.col("na"), F.col("nb"), similarity)).select("a", "b")
