"""Alignment of two tokenizers' tokens of the same bytes, and how many documents hold each pair linked.

Both tokenizers cut the same bytes. Sums of token lengths are the tokens' ends; ends that both
have are cuts, and the tokens between two cuts a group. A token links to those of the other
tokenizer that it shares bytes with.

Documents are worked on in blocks of bounded size. A block is one row of a written table: its
documents' counts and digests, the distinct pairs that it links and in how many of its documents,
and which documents hold which of them. The pairs of all blocks meet in two sums, the first of
them salted, and their counts go back to the blocks, so that rows are shuffled for a block's
distinct pairs and never for single links.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import byte_bpe
from tidewire.llm import text as tw
from tidewire.llm.cluster import shared_folder

#: Bytes of text of a block (a longer text is one of its own), characters of a part, and tokens aligned at once.
BLOCK, PART_LENGTH, AT_ONCE = 16_000_000, 1_000_000, 500_000
#: Fixed value: the letter that stands for a space in pieces.
MARK = "▁"
#: Where a long text can be parted: before a single space no token of either kind goes on.
PART = re.compile(r"(?<=\S)(?= \S)")
#: Partial sums of a pair before the last one.
SALTS = 4


def byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level vocabularies stands for: visible ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Both:
    """Two vocabularies as tasks get them: a's tokens by their bytes, and b's model file."""

    a: dict[bytes, int]
    b: bytes

    @staticmethod
    def load(a_path: str, b_path: str) -> Both:
        """Read a byte-level BPE of the tokenizers library, whose ids must follow its merges' order, and a SentencePiece model."""
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("ids must follow the merges")
        with open(b_path, "rb") as file:
            return Both({bytes(letters[c] for c in token): id_ for token, id_ in vocab.items()}, file.read())

    def pieces(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.b)


def decimals(size: int, after: str) -> np.ndarray:
    """Each id below `size` in decimal with what follows it, as eight bytes, the last of them zero."""
    return np.array([f"{i}{after}" for i in range(size)], "S8").view(np.uint64)


class Aligner:
    """Encodes parts of texts with both vocabularies and aligns them."""

    def __init__(self, both: Both):
        # Ids in the merges' order are ranks, so that this library's encoder gives the same tokens.
        self.a = tiktoken.Encoding("a", pat_str=byte_bpe.PATTERN, mergeable_ranks=both.a, special_tokens={})
        self.b = model = both.pieces()
        self.a_bytes = [b""] * (max(both.a.values()) + 1)
        for token, id_ in both.a.items():
            self.a_bytes[id_] = token
        self.b_size = model.vocab_size()
        kinds = [b"" if model.is_control(i) or model.is_unknown(i) else None for i in range(self.b_size)]
        self.b_bytes = [x if x is not None else bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, (x, p) in enumerate(zip(kinds, map(model.id_to_piece, range(self.b_size)), strict=True))]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_text = np.stack([decimals(len(self.a_bytes), sep) for sep in ",|"])
        self.b_text = np.stack([decimals(self.b_size, sep) for sep in (",", ";", "")])

    def encode(self, part: str) -> tuple[list[int], list[int]] | None:
        """Ids of a part, which begins with a space, by both; None where either's bytes aren't the part's."""
        raw, a, b = part.encode(), self.a.encode_ordinary(part), self.b.encode(part[1:])
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else None

    def parts(self, text: str) -> list[str]:
        """The text with a space before it, cut where both tokenizers cut it. Each part begins with a space."""
        text = " " + text
        if len(text) <= PART_LENGTH:
            return [text]
        out, start = [], 0
        while (cut := PART.search(text, start + PART_LENGTH)) is not None:
            out.append(text[start : cut.start()])
            start = cut.start()
        return [*out, text[start:]]

    def align(self, parts: list[tuple[list[int], list[int]]], doc: np.ndarray, last: np.ndarray) -> Aligned:
        """Aligns encoded parts of which each belongs to a document; `last` tells each document's last part."""
        a_many, b_many = (np.array([len(p[side]) for p in parts]) for side in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(p[side] for p in parts), np.int64) for side in (0, 1))
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_doc, b_doc = np.repeat(doc, a_many), np.repeat(doc, b_many)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        # Each token of a links to those of b from the one at its first byte to the one at its last.
        first = np.searchsorted(b_ends, a_ends - self.a_length[a], side="right")
        many = np.searchsorted(b_ends, a_ends) - first + 1
        from_a = np.repeat(np.arange(len(a)), many)
        from_b = np.arange(len(from_a)) + np.repeat(first - (np.cumsum(many) - many), many)
        pairs = a[from_a] * self.b_size + b[from_b]
        # In the listing stands a group's a before its b.
        a_last, b_last = a_ends == cuts[a_group], b_ends == cuts[b_group]
        ends_doc = np.zeros(len(cuts), bool)
        ends_doc[np.searchsorted(cuts, a_ends[np.cumsum(a_many)[last] - 1])] = True
        listing = np.empty(len(a) + len(b), np.uint64)
        b_before = np.searchsorted(b_group, np.arange(len(cuts)))
        a_until = np.searchsorted(a_group, np.arange(len(cuts)), side="right")
        listing[np.arange(len(a)) + b_before[a_group]] = self.a_text[a_last.astype(int), a]
        listing[np.arange(len(b)) + a_until[b_group]] = self.b_text[b_last + (b_last & ends_doc[b_group]).astype(int), b]
        letters = listing.view(np.uint8)
        held = letters != 0
        sizes = np.append(0, np.cumsum(held.reshape(-1, 8).sum(1)))
        until = np.cumsum(a_many + b_many)
        text = letters[held].tobytes()
        listed = [text[sizes[s] : sizes[e]] for s, e in zip([0, *until[:-1]], until, strict=True)]
        return Aligned(a_doc, b_doc, a_doc[np.searchsorted(a_ends, cuts)] if len(cuts) else a_doc[:0], a_doc[from_a], pairs, listed)


@dataclass(frozen=True)
class Aligned:
    """The document of each token, group and link, the links' pairs, and each part's listing of groups."""

    a_doc: np.ndarray
    b_doc: np.ndarray
    group_doc: np.ndarray
    link_doc: np.ndarray
    pairs: np.ndarray
    listed: list[bytes]


class Block:
    """What is gathered of a block of texts."""

    def __init__(self, aligner: Aligner, texts: list[str | None]):
        n = len(texts)
        self.counts = np.zeros((4, n), np.int64)
        digests = [hashlib.sha256() for _ in range(n)]
        self.docs, self.pairs, self.times = (np.zeros(0, np.int64) for _ in range(3))
        parts: list[tuple[list[int], list[int]]] = []
        doc: list[int] = []
        last: list[bool] = []
        seen, size = [], 0

        def done() -> None:
            if not parts:
                return
            at = np.array(doc)
            found = aligner.align(parts, at, np.array(last))
            self.counts += [np.bincount(x, minlength=n) for x in (found.a_doc, found.b_doc, found.group_doc, found.link_doc)]
            for i, listed in zip(doc, found.listed, strict=True):
                digests[i].update(listed)
            # Distinct pairs of each document, with how often it links them.
            span = int(found.pairs.max(initial=0)) + 1
            keys, times = np.unique((found.link_doc - at[0]) * span + found.pairs, return_counts=True)
            seen.append((keys // span + at[0], keys % span, times))
            for kept in (parts, doc, last):
                kept.clear()

        for i, text in enumerate(texts):
            own = [aligner.encode(p) for p in aligner.parts(text)] if text else []
            if None in own:
                continue
            for k, part in enumerate(own):
                if size and size + len(part[0]) > AT_ONCE:
                    done()
                    size = 0
                parts.append(part)
                doc.append(i)
                last.append(k == len(own) - 1)
                size += len(part[0])
        done()
        if seen:
            self.docs, self.pairs, self.times = (np.concatenate(x) for x in zip(*seen, strict=True))
        if len(seen) > 1:  # a long text's parts have pairs in common
            order = np.lexsort((self.pairs, self.docs))
            docs, pairs, times = self.docs[order], self.pairs[order], self.times[order]
            new = np.flatnonzero(np.diff(docs, prepend=-1) | np.diff(pairs, prepend=-1))
            self.docs, self.pairs, self.times = docs[new], pairs[new], np.add.reduceat(times, new) if len(new) else times
        self.digests = [d.hexdigest() if self.counts[0, i] else "" for i, d in enumerate(digests)]

    def row(self) -> dict[str, object]:
        """The block's distinct pairs, in how many documents each is, and which documents hold which how often."""
        distinct, which, held = np.unique(self.pairs, return_inverse=True, return_counts=True)
        return {"pairs": distinct, "held": held, "inside": pack(self.docs, which, self.times)}


def pack(docs: np.ndarray, which: np.ndarray, times: np.ndarray) -> bytes:
    """Three columns in a few bytes a row: documents in order, their pairs in order, small numbers."""
    steps = [np.diff(docs, prepend=0), np.diff(which, prepend=0), times]
    planes = np.concatenate([np.asarray(x, "<i4").view(np.uint8).reshape(-1, 4).T.ravel() for x in steps])
    return len(docs).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 12 * n, codec="zstd", asbytes=True), np.uint8)
    docs, which, times = (np.ascontiguousarray(x.reshape(4, -1).T).view("<i4").ravel().astype(np.int64) for x in np.split(planes, 3))
    return np.cumsum(docs), np.cumsum(which), times


#: Counts of a document, in order.
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def blocks(frame: DataFrame, both: Both, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each block of texts, written to the shared folder and read back."""
    spark = frame.sparkSession
    shared, name = spark.sparkContext.broadcast(both), byte_bpe.digest(both)
    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = byte_bpe.learned(Aligner, name, shared), TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in tw.slices(whole, "text", BLOCK):
                block = Block(aligner, batch.column(1).to_pylist())
                row = block.row()
                lists = [batch.column(0), *(pa.array(x) for x in block.counts), pa.array(block.digests, pa.string()), pa.array(row["pairs"]), pa.array(row["held"])]
                columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                names = ["block", "id", *COUNTS, "groups_sha256", "pairs", "held", "inside"]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *columns, pa.array([row["inside"]], pa.binary())], names)
                number += 1

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"block long, id array<{kind}>, {', '.join(f'{c} array<long>' for c in COUNTS)}, groups_sha256 array<string>, pairs array<long>, held array<long>, inside binary"
    path = f"{shared_folder(spark)}/blocks_{uuid.uuid4().hex}"
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def pair_counts(made: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its a-token is in more."""
    held = made.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.held").alias("n"))
    salted = held.groupBy("pair", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = salted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / b_size))
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(frame: DataFrame, both: Both, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents and pairs: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row, and (a, b, n).

    The a-tokens are those of a space and the text, the b-tokens those of the text, to which the
    piece model adds its space. n counts the rows that hold a pair of ids linked; `n_best` counts
    a row's links whose n no pair of the same a-id exceeds (ties count), `count_sum` sums n over
    its links. `groups_sha256` digests the groups, `a1,a2|b1;a3|b2,b3`.

    A null or empty text, and one with the piece model's mark, whose tokens don't give the text
    back, has no tokens, zeros and an empty digest. Null ids and repeated rows have a row each and
    count each; long texts count whole, parted where both tokenizers part them; an empty table gives
    no rows; other columns, of any name, are left out. Vocabularies are broadcast, their size
    bounds them.
    """
    made = blocks(frame, both, id_col, text_col)
    b_size = both.pieces().vocab_size()
    counts = pair_counts(made, b_size)
    asked = made.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts, "pair").select("of", "place", "n", "best")
    kind = made.schema["id"].dataType.elementType.simpleString()

    def sums(block: pa.Table, told: pa.Table) -> pa.Table:
        row = block.combine_chunks()
        columns = {c: row.column(c).combine_chunks().flatten() for c in ["id", *COUNTS, "groups_sha256"]}
        docs, which, times = unpack(row.column("inside")[0].as_py())
        place = told.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], best[place] = told.column("n").to_numpy(), told.column("best").cast(pa.int64()).to_numpy()
        most = len(columns["id"])

        def total(each: np.ndarray) -> pa.Array:
            out = np.zeros(most, np.int64)
            np.add.at(out, docs, each[which] * times)
            return pa.array(out)

        return pa.table({**columns, "n_best": total(best), "count_sum": total(n)}).select(names)

    names = ["id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = f"id {kind}, {', '.join(f'{c} long' for c in names[1:-1])}, groups_sha256 string"
    left = made.select("block", "id", *COUNTS, "groups_sha256", "inside")
    documents = left.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(sums, schema)
    pairs = counts.select(F.floor(F.col("pair") / b_size).alias("a"), (F.col("pair") % b_size).alias("b"), "n")
    return documents, pairs
