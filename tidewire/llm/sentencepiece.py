"""SentencePiece encoding and decoding by a Viterbi that words with a common prefix share.

Texts are cut into marked words: a run of spaces with what follows it, spaces as marks.
No piece crosses from one to the next. The distinct words of a batch are sorted, which
walks the trie of their letters depth-first: of each word only what follows the prefix
shared with the word before is computed, and the forward table of the prefix stays.

The forward table tells, for each prefix of a word, the best way to end it in a piece.
For a unigram model that is the piece of the highest total score. For a BPE model it is
the piece that merging gives: a sequence of pieces is what merging makes of a text
exactly if each two neighbours stay two when merged alone. So the path goes only over
neighbours that do, and there is one such path to each prefix. Its pieces are those of
the model's own encoder; the highest sum of a BPE model's scores, which number its
merges, would give other pieces.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidewire.llm import text as tw
from tidewire.llm.byte_bpe import digest, learned
from tidewire.llm.cluster import by_place

MARK = "▁"
#: Stands for a mark that the text itself has; no text holds a lone surrogate.
LITERAL = "\udc81"
#: A run of spaces with what follows it, or a piece of text without spaces; line ends stand alone.
WORD = re.compile(r" *[^ \n]+| +|\n")


@dataclass(frozen=True)
class Model:
    """Pieces of a SentencePiece model: ids and scores by text, byte pieces, and its kind."""

    pieces: dict[str, tuple[int, float]]
    bytes_of: dict[int, int]
    unknown: int
    merges: bool
    longest: int = field(default=0)

    @staticmethod
    def load(path: str, merges: bool = True) -> Model:
        """Read a model file on the driver; `merges` tells a BPE model from a unigram one."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        bytes_of = {i: int(model.id_to_piece(i)[1:-1], 16) for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in plain}
        return Model(pieces, bytes_of, model.unk_id(), merges, max(map(len, pieces)))


#: A node of the trie of pieces: what follows by letter, and at no letter the piece that ends here.
Trie = dict[str | None, "Trie | str"]
#: Pieces that may still go on at a place of a word: where they begin, and where they are in the trie.
Active = list[tuple[int, Trie]]


class Encoder:
    """Encodes words; what it learned of pairs of pieces and of words stays for later batches.

    When `kept` words are here they become the old ones, and of these stay those that are asked for
    before the next change.
    """

    def __init__(self, model: Model, kept: int = 250_000):
        self.model, self.kept = model, kept
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.byte_id = {b: i for i, b in model.bytes_of.items()}
        self.trie: Trie = {}
        for piece in model.pieces:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = piece

    def merge(self, text: str) -> list[str]:
        """The pieces that merging makes of a text: best score first, leftmost among equals."""
        pieces, parts = self.model.pieces, list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (found := pieces.get(both := parts[i] + parts[after[i]])):
                heapq.heappush(queue, (-found[1], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def stays(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.pairs.get(key)) is None:
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def is_whole(self, piece: str) -> bool:
        if (known := self.whole.get(piece)) is None:
            known = self.whole[piece] = self.merge(piece) == [piece]
        return known

    def step(self, word: str, end: int, table: list[tuple[float, str | None]], active: list[Active]) -> tuple[float, str | None]:
        """The forward entry of word[:end]: its score and last piece, None for an unknown character. `active` grows by a place."""
        c, going, best, merges = word[end - 1], [], None, self.model.merges
        for start, node in (*active[end - 1], (end - 1, self.trie)):
            after = node.get(c)
            if after is None:
                continue
            going.append((start, after))
            piece = after.get(None)
            if piece is None or (best is not None and merges):
                continue
            score, last = table[start]
            gain = score + self.model.pieces[piece][1]
            # Merging leaves one way to each prefix, a unigram model the best one.
            if (self.is_whole(piece) and (start == 0 or last is None or self.stays(last, piece))) if merges else (best is None or gain > best[0]):
                best = (gain, piece)
        active.append(going)
        return best or (table[end - 1][0] - 1e6, None)

    def ids(self, word: str, table: list[tuple[float, str | None]]) -> array:
        out, end = [], len(word)
        while end:
            piece = table[end][1]
            if piece is None:
                own = [self.byte_id.get(b, self.model.unknown) for b in word[end - 1].replace(LITERAL, MARK).encode()]
                out += reversed(own)
                end -= 1
            else:
                out.append(self.model.pieces[piece][0])
                end -= len(piece)
        return array("i", reversed(out))

    def learn(self, words: set[str]) -> None:
        """Encode the distinct words that aren't known yet, in order."""
        if len(self.known) > self.kept:
            self.old, self.known = self.known, {}
        if len(self.pairs) > 4 * self.kept:
            self.pairs.clear()
        new = words - self.known.keys()
        self.known |= {w: self.old[w] for w in new if w in self.old}
        new -= self.known.keys()
        runs = {w for w in new if self.model.merges and w.startswith("  ")}
        new = (new - runs) | ({" " + w.lstrip(" ") for w in runs} - self.known.keys())
        # A literal mark in the text is no space: it is kept apart as an unknown character.
        before, table, active = "", [(0.0, None)], [[]]
        for word, original in sorted((w.replace(MARK, LITERAL).replace(" ", MARK), w) for w in new):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del table[shared + 1 :], active[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                table.append(self.step(word, end, table, active))
            before = word
            self.known[original] = self.ids(word, table).tobytes()
        # Marks merge with each other after all else: the last one first goes with what follows.
        for original in runs:
            tail = original.lstrip(" ")
            rest, marks = array("i", self.known[" " + tail]), len(original) - len(tail) - 1
            if rest[0] == self.model.pieces[MARK][0]:
                rest, marks = rest[1:], marks + 1
            self.known[original] = (array("i", (self.model.pieces[p][0] for p in self.merge(MARK * marks))) + rest).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin and end."""
        split = [WORD.findall(" " + t) if t else [] for t in texts]
        self.learn(set().union(*split) if split else set())
        raw = [b"".join(map(self.known.__getitem__, words)) for words in split]
        return np.frombuffer(b"".join(raw), np.int32), np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)


class Decoder:
    """Texts of ids; ids of pieces that stand for no text give none."""

    def __init__(self, model: Model):
        text = {i: piece.replace(MARK, " ").encode() for piece, (i, _) in model.pieces.items()}
        text |= {i: bytes([b]) for i, b in model.bytes_of.items()}
        self.table = [text.get(i, b"") for i in range(max(text, default=0) + 1)]

    def text(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


def encode(
    frame: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, decoded: bool = False
) -> DataFrame:
    """(id, ids) of each row, and if asked for its `text`, and `decoded` from the ids; a null or empty text has no ids.

    Null ids and repeated rows stay, an empty table gives no rows, other columns are
    left out. A vocabulary's size bounds what is sent to the executors.
    """
    shared, name = frame.sparkSession.sparkContext.broadcast(model), digest(model)
    names = ["id", "ids", *["text"] * keep_text, *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a process has learned of words stays for its later tasks.
        encoder, decoder = learned(Encoder, name, shared), Decoder(shared.value) if decoded else None
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                flat, ends = encoder.encode([t.as_py() or "" for t in batch.column(1)])
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), *([batch.column(1)] if keep_text else [])]
                if decoder is not None:
                    columns.append(pa.array([decoder.text(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>" + "".join(f", {n} string" for n in names[2:]))


def decode(frame: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The frame with the text of its ids; null or no ids give an empty text.

    Ids of pieces that stand for no text give none, and bytes that make no UTF-8 give
    replacement characters. `out_col` takes the place of a column of that name; columns may have
    any name.
    """
    shared = frame.sparkSession.sparkContext.broadcast(model)
    names = [*(c for c in frame.columns if c != out_col), out_col]
    own = by_place(frame)
    rows = own.select(*(c for c, name in zip(own.columns, frame.columns, strict=True) if name != out_col))
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            out = [decoder.text(ids.values.to_numpy()) if ids.is_valid else "" for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "out"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("out", StringType())).toDF(*names)


def round_trip(spark: SparkSession, frame: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_pieces, decoded_sha256, same) of each row; `same` where decoding gives the text back.

    A null or empty text has no ids and decodes to an empty one. Null ids and repeated rows
    have a row each; texts are encoded whole, however long; an empty table gives no rows;
    other columns are left out. There are no ties: one path is left of each word's.
    """
    model = Model.load(path)
    both = encode(frame, model, id_col, text_col, keep_text=True, decoded=True)
    return both.select(
        "id",
        "ids",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"),
    )
