"""Connected components, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once and read back from the shared checkpoint folder.

    The folder is the one that `shared_folder` finds.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one set, or `spark.checkpoint.dir`.

    Only a session that runs on this machine alone, as in tests, gets a folder of this
    machine where none is named; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context._jsc.sc().getCheckpointDir().get()


def bucketed(frame: DataFrame, key: str) -> tuple[DataFrame, str]:
    """The frame written to the shared folder in buckets of `key`, and the table's name: joins on it don't shuffle it again.

    As many buckets as shuffles have partitions; the frame should come partitioned so. `discard`
    removes the table.
    """
    spark = frame.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/{name}"
    frame.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name), name


def discard(spark: SparkSession, name: str) -> None:
    """Remove a table that `bucketed` wrote, with its files, once nothing reads it any more."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the map that `thinned` broadcasts: at most 2**19 rows of a word of it.
MAP_BITS = 25


def thinned(frame: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of `frame` whose `key` may be in `wanted`, all that are and few others: less to shuffle for a join.

    Keys are hashed to the bits of a map of fixed size, which alone is broadcast. It lets more
    rows pass the more keys are wanted, and never holds back one that is.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << MAP_BITS))
    word, bit = F.shiftright(place, 6), F.expr("1L").cast("long")
    bit = F.call_function("shiftleft", bit, (place % 64).cast("int"))
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = frame.join(F.broadcast(bits), word == F.col("_word")).where(bit.bitwiseAND(F.col("_bits")) != 0)
    return met.drop("_word", "_bits")


def by_place(frame: DataFrame) -> DataFrame:
    """The frame with its columns named by their places, `_0` and so on; `toDF` gives them their own names back.

    Names with dots or backticks, and names that an operator uses itself, can't get in the way then.
    """
    return frame.toDF(*(f"_{i}" for i in range(len(frame.columns))))


#: Edges that a task of `components` takes, about.
EDGES = 250_000


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """Component of each node that has an edge: (node, root), root its least node.

    Alternating large-star and small-star steps: each step is one aggregate over the
    edges, and their number falls quickly, so nothing but edge counts reaches the
    driver. A node's neighbours are reduced to their minimum by aggregation, never
    gathered. Each step of a round has as many parts as its edges need; edges that fit
    one part aren't shuffled. Self loops and edges with a null end are ignored. A frame
    without edges has no nodes.
    """

    def parts(n: int) -> int:
        return max(1, -(-n // EDGES))

    kept = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    now = cut(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n = now.count()
    if not n:
        return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    now, seen = now.coalesce(parts(n)), None
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours go to the least of it and its neighbours.
        both = now.union(now.select(F.col("b"), F.col("a"))).coalesce(parts(2 * n))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = large.coalesce(parts(n)).distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        now = cut(small.where("a <> b").coalesce(parts(2 * n)).distinct().coalesce(parts(n)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen, n = state, state[0]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
