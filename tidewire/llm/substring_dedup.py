"""Substring dedup with a compressed FM-index per shard.

A window is `window` consecutive words of a document. A repeated window is found in
four steps, none of which gathers a document's copies:

1. Every window is represented by the least hash among its runs of `gram` words.
   Neighbouring windows with the same least run form a segment; equal windows are in
   segments with the same run. A segment is known by its run and a hash of its words.
2. Segments are counted by run. Where two documents have a run, one carrier of each
   distinct segment, the least document that has it, goes on. Other holders of the
   segment repeat all its windows.
   That is exact and leaves the index one copy of each segment, however often it stands.
3. Carriers go to shards by their run. A shard's segments form one text of words, of
   which it builds an FM-index: the Burrows-Wheeler transform as a wavelet tree of bit
   vectors with rank counts. The shard's segments stream through backward search,
   which gives each word's interval of suffixes and the length of its match; the
   intervals of matches at or above the threshold tell the least document that has
   that window. The segments of a run with more words than a shard are dealt to several
   shards, and all of them stream through each: no shard's index grows with a hot run.
4. A document's repeated intervals meet its text again, and are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import text as tw
from tidewire.llm.cluster import by_place, cut


class BitVector:
    """Bits in words of 64 with rank counts: `rank(i)` ones stand before position i."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(packed) // 8 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Ranks of symbols in a sequence, by one bit vector per bit of the alphabet.

    A level holds one bit of every symbol, in the order that sorting stably by the
    higher bits gives, so the tree takes as many bits as the sequence itself and the
    counts beside them.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in reversed(range(bits)):
            ones = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, BitVector(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        # Where each symbol's run starts in the last order.
        self.start = np.zeros(1 << bits, np.int64)
        heads = np.flatnonzero(np.diff(symbols, prepend=-1))
        self.start[symbols[heads]] = heads

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of `symbol` stand before `end`, for each pair."""
        at = end
        for bit, vector, zeros in self.levels:
            ones = vector.rank(at)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at - self.start[symbol]


class FMIndex:
    """An index of short word sequences, for backward search.

    `words` holds the sequences' word hashes one after the other, `sizes` their lengths
    and `owners` a number for each, of which searches tell the least. Every sequence
    ends in a separator that matches nothing.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, owners: np.ndarray, threshold: int):
        self.threshold = threshold
        n, ends = len(words) + len(sizes), np.cumsum(sizes + 1) - 1
        is_word = np.ones(n, bool)
        is_word[ends] = False
        self.alphabet, codes = np.unique(words, return_inverse=True)
        text = np.zeros(n, np.int64)
        text[is_word] = codes + 1
        order = self._suffixes(text, ends)
        # Suffixes that agree in `threshold` words, and the least owner among them.
        padded = np.zeros(n, np.uint64)
        padded[is_word] = words
        total = tw.prefix(padded)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        whole = order + threshold <= ends[owner[order]]
        head = np.where(whole, tw.span(total, order, np.minimum(order + threshold, n)), 0)
        opens = np.ones(n, bool)
        opens[1:] = ~whole[1:] | ~whole[:-1] | (head[1:] != head[:-1])
        self.interval = np.cumsum(opens) - 1
        self.least = np.minimum.reduceat(owners[owner[order]], np.flatnonzero(opens)) if n else owners[:0]
        # The transform, and where suffixes of each first word begin.
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))])
        self.size = n
        self.tree = WaveletTree(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))

    @staticmethod
    def _suffixes(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of all suffixes in order, by doubling; separators order by place."""
        n = len(text)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + after
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.diff(sorted_key, prepend=sorted_key[:1]) != 0)
            rank, step = new, step * 2
            if n == 0 or rank.max() == n - 1:
                return order

    def matches(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of streamed sequences that the index has.

        Returns (sequence, start, least owner) of each window of `threshold` words.
        Sequences are searched side by side, each from its right to its left: a word is
        prepended to the current match, whose length is the matching statistic of the
        place. Where a word doesn't extend the match, no window holds both the word and
        the match's right end, so the search begins again at the next right end at which
        a window could stand.
        """
        code = np.searchsorted(self.alphabet, words)
        code = np.where(self.alphabet[np.minimum(code, len(self.alphabet) - 1)] == words, code + 1, 0) if len(self.alphabet) else np.zeros(len(words), np.int64)
        base = np.cumsum(sizes) - sizes
        lane = np.flatnonzero(sizes >= self.threshold)
        right = sizes[lane].astype(np.int64)
        at = right.copy()
        low, high = np.zeros(len(lane), np.int64), np.full(len(lane), self.size, np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(lane):
            at = at - 1
            symbol = code[base[lane] + at]
            new_low = self.before[symbol] + self.tree.rank(symbol, low)
            new_high = self.before[symbol] + self.tree.rank(symbol, high)
            fits = (symbol > 0) & (new_low < new_high)
            full = fits & (right - at >= self.threshold)
            found.append((lane[full], at[full], self.least[self.interval[new_low[full]]]))
            # After a failure at word `at`, a window that has it must end before `right`.
            right = np.where(fits, right, np.minimum(right - 1, at + self.threshold))
            low, high = np.where(fits, new_low, 0), np.where(fits, new_high, self.size)
            at = np.where(fits, at, right)
            going = np.where(fits, at > 0, right >= self.threshold)
            lane, right, at, low, high = (x[going] for x in (lane, right, at, low, high))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(map(np.concatenate, zip(*found)))


def segments(frame: DataFrame, window: int, gram: int) -> DataFrame:
    """(run, seg, id, key, start, end): segments of windows by their least run of words.

    `frame` has id, key and text. Words [start, end) hold the segment's windows.
    """
    grams = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                found = tw.Words(batch.column(2))
                n = len(found)
                if n < window:
                    continue
                total = tw.prefix(found.hashes())
                at = np.arange(n - gram + 1)
                runs = tw.span(total, at, at + gram)
                # Where the least run of each window is, the first one of equal ones.
                place, width = at, 1
                while width < grams:
                    step = min(width, grams - width)
                    place = np.where(runs[place[step:]] < runs[place[:-step]], place[step:], place[:-step])
                    width += step
                row = found.row
                valid = np.arange(len(place)) + window <= found.first[1:][row[: len(place)]]
                opens = valid.copy()
                opens[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (row[1 : len(place)] != row[: len(place) - 1])
                closes = valid.copy()
                closes[:-1] &= ~valid[1:] | opens[1:]
                start, end = np.flatnonzero(opens), np.flatnonzero(closes) + window
                own = row[start]
                columns = [
                    pa.array(runs[place[start]].view(np.int64)),
                    pa.array(tw.span(total, start, end).view(np.int64)),
                    batch.column(0).take(pa.array(own)),
                    batch.column(1).take(pa.array(own)),
                    pa.array((start - found.first[own]).astype(np.int32)),
                    pa.array((end - found.first[own]).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["run", "seg", "id", "key", "start", "end"])

    kind = frame.schema["id"].dataType.simpleString()
    return frame.select("id", "key", "text").mapInArrow(run, f"run long, seg long, id {kind}, key long, start int, end int")


def carried_words(holders: DataFrame) -> DataFrame:
    """(run, seg, parts, id, words): the word hashes of each segment that a text carries.

    `holders` has id, text and `carried`, an array of (run, seg, parts, start, end).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                found = tw.Words(batch.column(1))
                hashes = found.hashes()
                lists = batch.column(2)
                parts = lists.flatten()
                own = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                base = found.first[own]
                bounds = zip((base + parts.field("start").to_numpy()).tolist(), (base + parts.field("end").to_numpy()).tolist())
                words = pa.array([hashes[a:b].tobytes() for a, b in bounds], pa.binary())
                ids = batch.column(0).take(pa.array(own))
                names = ["run", "seg", "parts"]
                yield pa.RecordBatch.from_arrays([*(parts.field(c) for c in names), ids, words], [*names, "id", "words"])

    kind = holders.schema["id"].dataType.simpleString()
    return holders.select("id", "text", "carried").mapInArrow(run, f"run long, seg long, parts int, id {kind}, words binary")


#: Words of a shard, about.
SHARD_WORDS = 1_500_000


def shard_matches(carried: DataFrame, window: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(run, seg, start, end): what of a carrier's segment stands in a document with a smaller id.

    Segments of one part of a run meet in one task, in order; a task indexes and searches
    them in shards of at least `shard_words` words that end where a part ends. Segments of a
    run's other parts come after a part's own ones, and stream through its index in batches.
    """

    def search(index: FMIndex, frame: pd.DataFrame) -> pa.RecordBatch:
        sizes = frame["words"].str.len().to_numpy() // 8
        words = np.frombuffer(b"".join(frame["words"]), np.uint64)
        owners = frame["id"].to_numpy()
        lane, start, least = index.matches(words, sizes)
        repeated = least < owners[lane]
        lane, start = lane[repeated], start[repeated]
        order = np.lexsort((start, lane))
        lane, start = lane[order], start[order]
        # Windows of a segment that touch are one span.
        opens = np.ones(len(lane), bool)
        opens[1:] = (lane[1:] != lane[:-1]) | (start[1:] > start[:-1] + window)
        heads = np.flatnonzero(opens)
        tails = np.append(heads[1:], len(lane)) - 1
        end = start[tails] + window if len(heads) else start[:0]
        of = lane[heads]
        columns = [pa.array(frame["run"].to_numpy()[of]), pa.array(frame["seg"].to_numpy()[of]), pa.array(start[heads].astype(np.int32)), pa.array(end.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["run", "seg", "start", "end"])

    def build(frame: pd.DataFrame) -> FMIndex:
        sizes = frame["words"].str.len().to_numpy() // 8
        return FMIndex(np.frombuffer(b"".join(frame["words"]), np.uint64), sizes, frame["id"].to_numpy(), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        size, index = 0, None
        for batch in batches:
            whole = batch.to_pandas()
            kinds = whole["own"].to_numpy()
            for piece in np.split(np.arange(len(whole)), np.flatnonzero(kinds[1:] != kinds[:-1]) + 1):
                frame = whole.iloc[piece]
                if not len(frame):
                    continue
                if not frame["own"].iloc[0]:
                    if held:
                        shard = pd.concat(held, ignore_index=True)
                        index, held, size = build(shard), [], 0
                        yield search(index, shard)
                    yield search(index, frame)
                    continue
                if size >= shard_words:
                    # The held rows end with a part that may go on: it stays for the next shard.
                    last = held[-1].iloc[-1]
                    goes_on = (frame["run"].to_numpy() == last["run"]) & (frame["part"].to_numpy() == last["part"])
                    held.append(frame[goes_on])
                    frame = frame[~goes_on]
                    if len(frame):
                        shard = pd.concat(held, ignore_index=True)
                        held, size = [], 0
                        yield search(build(shard), shard)
                held.append(frame)
                size += int(frame["words"].str.len().sum()) // 8
        if held:
            shard = pd.concat(held, ignore_index=True)
            yield search(build(shard), shard)

    home = F.pmod(F.xxhash64("seg"), F.col("parts")).cast("int")
    every = carried.withColumn("home", home).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    every = every.withColumn("own", F.col("part") == F.col("home")).select("run", "seg", "id", "words", "part", "own")
    dealt = every.repartition("run", "part").sortWithinPartitions("run", "part", F.col("own").desc())
    return dealt.mapInArrow(run, "run long, seg long, start int, end int")


def repeats(frame: DataFrame, window: int = 50, gram: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id, key, spans): words of a document that repeat a document with a smaller id.

    `frame` has id, key (a hash of the text) and text. `spans` is an array of
    (start, end) in words, in order; documents without repeats have no row.
    """
    every = segments(frame, window, gram)
    shared = every.groupBy("run").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("run")
    met = cut(every.join(shared, "run"))
    carriers = met.groupBy("run", "seg").agg(F.min(F.struct("id", "key", "start", "end")).alias("c"))
    words = F.sum(F.col("c.end") - F.col("c.start"))
    hot = carriers.groupBy("run").agg(F.ceil(words / shard_words).cast("int").alias("parts")).where("parts > 1")
    placed = carriers.join(hot, "run", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    by_text = placed.groupBy("c.id", "c.key").agg(F.collect_list(F.struct("run", "seg", "parts", "c.start", "c.end")).alias("carried"))
    carried = carried_words(frame.join(by_text, ["id", "key"]))
    # Every holder but the carrier's document has all windows of the segment again.
    held = met.join(carriers.select("run", "seg", F.col("c.id").alias("carrier")), ["run", "seg"])
    copies = held.where("id > carrier").select("id", "key", "start", "end")
    inside = shard_matches(carried, window, shard_words).select("run", "seg", F.col("start").alias("low"), F.col("end").alias("high"))
    own = held.where("id = carrier").join(inside, ["run", "seg"])
    own = own.select("id", "key", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end"))
    spans = copies.union(own).groupBy("id", "key")
    return spans.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def keep(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words outside the spans, which are in order and may overlap."""
    out: list[bytes] = []
    done = 0
    for s in spans:
        out += words[done : max(done, s["start"])]
        done = max(done, s["end"])
    return out + words[done:]


def dedup(
    frame: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    gram: int = 20,
    texts: bool = True,
    carry: tuple[str, ...] = (),
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(id, key, n_words, n_removed, kept or kept_sha256) of each row of `frame`.

    A column `row` holds the columns in `carry`, if any, as a struct.

    Each word is removed that lies in a window of `window` words whose sequence also
    starts in a document with a smaller id; windows are judged on the input. The words
    kept are joined by one space; with `texts` false only their SHA-256 is given.

    A null or empty text has no words; texts count whole, however long. Rows with a null id
    stay whole and take nothing from others. Rows of one id are one document: they don't
    remove each other's words; repeated rows have a row each. There are no ties: of equal
    windows the document of the smallest id keeps its own. An empty table gives no rows;
    other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.struct(*carry).alias("row")] if carry else []
    rows = frame.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), *own)
    found = repeats(rows.where("id IS NOT NULL").select("id", "key", "text"), window, gram, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                total, removed, kept = [], [], []
                for words, spans in zip(batch.column(2), batch.column(3)):
                    words = words.as_py().encode().split()
                    left = keep(words, spans.as_py()) if spans.is_valid else words
                    total.append(len(words))
                    removed.append(len(words) - len(left))
                    joined = b" ".join(left)
                    kept.append(joined.decode() if texts else hashlib.sha256(joined).hexdigest())
                columns = [batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *batch.columns[4:]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n_words", "n_removed", out, *extra])

    out = "kept" if texts else "kept_sha256"
    extra = ["row"] if carry else []
    joined = rows.join(found, ["id", "key"], "left").select("id", "key", "text", "spans", *extra)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key long, n_words long, n_removed long, {out} string"
    return joined.mapInArrow(run, schema + "".join(f", row {rows.schema['row'].dataType.simpleString()}" for _ in extra))


def apply(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", **removal: int) -> DataFrame:
    """The rows of `frame` with repeated passages cut out of the text.

    A text without repeats stays as it is; another is its kept words, joined by one space.
    Nulls, empty and long texts, repeated rows and empty tables as in `dedup`; columns may
    have any name.
    """
    own, at = by_place(frame), frame.columns.index(text_col)
    text_at = own.columns[at]
    found = dedup(own, own.columns[frame.columns.index(id_col)], text_at, carry=tuple(own.columns), **removal)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"row.{text_at}"))
    return found.select(*(text if c == text_at else F.col(f"row.{c}") for c in own.columns)).toDF(*frame.columns)
