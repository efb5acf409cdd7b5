"""Byte-level BPE encoding by a transducer made from the merges, and decoding by a UTF-8 machine.

A sequence of tokens is what merging makes of its bytes exactly if each two neighbours stay
two when merged alone, and each byte string has one such sequence. So a machine that guesses
where tokens end, and goes on only with neighbours that stay, has one way through each string.
Its guesses at one place are the open ones: the last token, and how far into another one the
bytes since then lead. Run together they are a deterministic machine whose states are sets of
guesses. What all guesses of a set have passed is emitted at once, so a token comes out no
later than the longest token's length after it. States and arcs are made when a text first
needs them, and stay.

Decoding has a machine too: its states are the bytes of a character that isn't whole yet, an
arc takes a token and gives the characters that it completes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidewire.llm import text as tw
from tidewire.llm.cluster import by_place

#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which on a text's words are taken one by one.
LONG = 1_000_000
#: No rank is as high.
NEVER = 1 << 62


@dataclass
class Merges:
    """Ranks of byte strings, and how merging makes each of them: its two last parts, a single byte none.

    Only strings that merging gives as one token can be tokens inside a text; a few in a
    vocabulary may be no merge's result, and stand for a whole word alone.
    """

    ranks: dict[bytes, int]
    parts: dict[int, tuple[int, int]]
    made: frozenset[int]

    @staticmethod
    def load(path: str) -> Merges:
        """Read a file of base64 tokens and ranks on the driver."""
        with open(path, "rb") as lines:
            return Merges.of({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    @staticmethod
    def of(ranks: dict[bytes, int]) -> Merges:
        parts, made = {}, set()
        for token, rank in ranks.items():
            left = merged(token, ranks, rank)
            if len(left) == 2 and len(token) > 1:
                parts[rank] = (ranks[left[0]], ranks[left[1]])
            if len(token) == 1 or len(left) == 2:
                made.add(rank)
        return Merges(ranks, parts, frozenset(made))

    def bytes_of(self) -> list[bytes]:
        out = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            out[rank] = token
        return out


def merged(raw: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[bytes]:
    """The tokens that merging makes of the bytes by ranks below one: lowest first, leftmost of equals."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(parts) and (rank := ranks.get(both := parts[i] + parts[after[i]], below)) < below:
            heapq.heappush(queue, (rank, i, both))

    for i in range(len(parts) - 1):
        offer(i)
    while queue:
        _, i, both = heapq.heappop(queue)
        if not parts[i] or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
            continue
        gone = after[i]
        parts[i], parts[gone], after[i] = both, b"", after[gone]
        if after[i] < len(parts):
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p]


#: An open guess: tokens passed but not emitted, the last token (-1: none), and a node of the trie of tokens.
Guess = tuple[tuple[int, ...], int, int]


class Transducer:
    """Encodes words byte by byte. Its states are numbers; an arc is (state, tokens), by 256 * state + byte.

    A word's last byte makes no state: of the guesses it completes one. States and arcs go when there
    are `most_states`, and are made anew when needed.
    """

    def __init__(self, merges: Merges, most_states: int = 200_000):
        self.merges, self.most = merges, most_states
        self.token_bytes = merges.bytes_of()
        self.size = len(self.token_bytes)
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for raw, rank in merges.ranks.items():
            if rank in merges.made:
                at = 0
                for byte in raw:
                    if byte not in self.children[at]:
                        self.children[at][byte] = len(self.children)
                        self.children.append({})
                        self.token.append(-1)
                    at = self.children[at][byte]
                self.token[at] = rank
        self.both: dict[int, bool] = {}
        self.spines: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[Guess, ...]] = [(((), -1, 0),)]
        self.numbers: dict[tuple[Guess, ...], int] = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def stay(self, left: int, right: int) -> bool:
        """Whether merging leaves two tokens side by side as they are; a word's first token (left -1) always stays."""
        if left < 0:
            return True
        key = left * self.size + right
        if (known := self.both.get(key)) is None:
            if len(self.both) > 2 * self.most:
                self.both.clear()
            known = self.both[key] = self._stay(left, right)
        return known

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """A token's first (side 0) or last (1) parts, from a single byte up: (part, rank that ends it)."""
        spines = self.spines[side]
        if (known := spines.get(token)) is None:
            known, at, ends = [], token, NEVER
            while at is not None:
                known.append((at, ends))
                at, ends = (split[side] if (split := self.merges.parts.get(at)) else None), at
            known.reverse()
            spines[token] = known
        return known

    def _stay(self, left: int, right: int) -> bool:
        # At the seam stand the last part of the left token and the first of the right one. They merge into
        # each other if that comes before either is merged within its token; the left token's merge wins a tie.
        lefts, rights = self.spine(left, 1), self.spine(right, 0)
        ranks, raw, i, j = self.merges.ranks, self.token_bytes, 0, 0
        a, a_ends = lefts[0]
        b, b_ends = rights[0]
        while True:
            rank = ranks.get(raw[a] + raw[b])
            if rank is not None and rank < a_ends and rank <= b_ends:
                return False
            if a_ends <= b_ends:
                if a_ends == NEVER:
                    return True
                i += 1
                a, a_ends = lefts[i]
            else:
                j += 1
                b, b_ends = rights[j]

    def arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Where a byte leads, made now and kept."""
        guesses: list[Guess] = []
        children, stay = self.children, self.stay
        for guess in self.states[state]:
            passed, last, node = guess
            at = children[node].get(byte)
            if at is None:
                continue
            if children[at]:
                guesses.append((passed, last, at))
            token = self.token[at]
            if token >= 0 and stay(last, token):
                guesses.append(((*passed, token), token, 0))
        # All guesses have passed what the first of them and the others have in common.
        shared, first = 0, guesses[0][0]
        while shared < len(first) and all(len(p) > shared and p[shared] == first[shared] for p, _, _ in guesses):
            shared += 1
        if shared:
            guesses = [(p[shared:], last, node) for p, last, node in guesses]
        made = tuple(guesses)
        target = self.numbers.get(made)
        if target is None:
            target = self.numbers[made] = len(self.states)
            self.states.append(made)
        found = self.arcs[state << 8 | byte] = (target, first[:shared])
        return found

    def finish(self, state: int, byte: int) -> tuple[int, ...]:
        """The tokens of the one guess that a word's last byte completes."""
        for passed, last, node in self.states[state]:
            at = self.children[node].get(byte)
            if at is not None and (token := self.token[at]) >= 0 and self.stay(last, token):
                return (*passed, token)
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        if (whole := self.merges.ranks.get(word)) is not None:
            return [whole]
        if not word:
            return []
        if len(self.states) > self.most:
            self.clear()
        arcs, state, out = self.arcs, 0, []
        for byte in memoryview(word)[:-1]:
            state, tokens = arcs.get(state << 8 | byte) or self.arc(state, byte)
            if tokens:
                out += tokens
        out += self.finish(state, word[-1])
        return out


class Words(dict):
    """Ids of words as bytes of 32-bit integers, found when first asked for.

    When `most` words are here they become the old ones, and of these stay those that are asked
    for before the next change.
    """

    def __init__(self, transducer: Transducer, most: int = 200_000):
        super().__init__()
        self.transducer, self.most, self.old = transducer, most, {}

    def __missing__(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            made = array("I", self.transducer.encode(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = made
        return made


class Encoder:
    """Encodes texts; what it has learned stays, for other batches and tasks of its process too."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.split, self.words = regex.compile(pattern), Words(Transducer(merges))

    def ids(self, text: str) -> bytes:
        """Ids of a text as bytes of little-endian 32-bit integers."""
        found = self.split.findall(text) if len(text) < LONG else (m.group() for m in self.split.finditer(text))
        return b"".join(map(self.words.__getitem__, found))


class Utf8:
    """Characters from bytes as they come, in pieces of any size.

    `pending` holds the bytes of a character that isn't whole. Bytes that can't go on or begin a
    character give a replacement character, one for each longest part that a character could
    begin with.
    """

    @staticmethod
    def bounds(pending: bytes) -> tuple[int, int, int]:
        """Bytes still missing after `pending`, and the least and greatest that the next may be; 0 missing: none may."""
        head = pending[0]
        size = 2 if 0xC2 <= head <= 0xDF else 3 if 0xE0 <= head <= 0xEF else 4 if 0xF0 <= head <= 0xF4 else 1
        low, high = 0x80, 0xBF
        if len(pending) == 1:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(head, (low, high))
        return size - len(pending), low, high

    @classmethod
    def feed(cls, pending: bytes, more: bytes) -> tuple[str, bytes]:
        """What `more` completes, and what is pending then."""
        out: list[str] = []
        for byte in more:
            if pending:
                missing, low, high = cls.bounds(pending)
                if low <= byte <= high:
                    pending += bytes([byte])
                    if missing == 1:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("�")
                pending = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                pending = bytes([byte])
            else:
                out.append("�")
        return "".join(out), pending


class Decoder:
    """Texts of ids: arcs[pending][id] is (characters, what is pending then), made when first needed."""

    def __init__(self, merges: Merges):
        self.raw = merges.bytes_of()
        self.arcs: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}

    def arc(self, pending: bytes, id_: int) -> tuple[str, bytes]:
        found = Utf8.feed(pending, self.raw[id_] if 0 <= id_ < len(self.raw) else b"")
        self.arcs[pending][id_] = found
        self.arcs.setdefault(found[1], {})
        return found

    def text(self, ids: list[int]) -> str:
        """The text of the ids; an unfinished character at the end gives one replacement character."""
        arcs, pending, out = self.arcs, b"", []
        for id_ in ids:
            text, pending = arcs[pending].get(id_) or self.arc(pending, id_)
            out.append(text)
        return "".join(out) + "�" * bool(pending)


#: What a Python process has learned about vocabularies, by kind and vocabulary.
_learned: dict[tuple[str, str], object] = {}


def digest(vocabulary: object) -> str:
    """Tells vocabularies apart."""
    return hashlib.sha256(pickle.dumps(vocabulary)).hexdigest()


def learned(kind: type, name: str, shared: Broadcast) -> object:
    """An encoder or decoder of a broadcast vocabulary of that digest, one for each process and kind; the last few stay."""
    key = (f"{kind.__module__}.{kind.__qualname__}", name)
    if key not in _learned:
        while len(_learned) >= 3:
            _learned.pop(next(iter(_learned)))
        _learned[key] = kind(shared.value)
    return _learned[key]


def encode(
    frame: DataFrame, merges: Merges, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, decoded: bool = False
) -> DataFrame:
    """(id, ids, ids_sha256) of each row: the tokens of each match of `pattern` in turn; and `decoded` from them, if asked for.

    `ids_sha256` digests the ids as little-endian unsigned 32-bit integers. A null or empty text
    has no ids. Null ids and repeated rows have a row each; texts are encoded whole, and words
    without an end too, in time linear in their length; an empty table gives no rows; other
    columns, of any name, are left out. There are no ties: one way leads through each word. The
    vocabulary's size bounds what goes to the executors.
    """
    shared, name = frame.sparkSession.sparkContext.broadcast(merges), digest(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = learned(Encoder, name, shared) if pattern == PATTERN else Encoder(shared.value, pattern)
        decoder = learned(Decoder, name, shared) if decoded else None
        for whole in batches:
            for batch in tw.slices(whole, "text"):
                raw = [encoder.ids(t.as_py() or "") for t in batch.column(1)]
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), "<u4").view(np.int32)
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())]
                if decoder is not None:
                    columns.append(pa.array([decoder.text(np.frombuffer(x, "<u4").tolist()) for x in raw], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "ids_sha256", "decoded"][: len(columns)])

    rows = frame.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, ids_sha256 string" + ", decoded string" * decoded)


def decode(frame: DataFrame, merges: Merges, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The frame with the text of its ids; null or no ids give an empty text.

    Bytes that make no UTF-8 give replacement characters, ids that the vocabulary hasn't give
    nothing. Other columns keep their names and values, whatever the names; `out_col` takes the
    place of a column of that name. Repeated rows stay; ids are decoded whole, however many; an
    empty table gives no rows.
    """
    shared, name = frame.sparkSession.sparkContext.broadcast(merges), digest(merges)
    # Columns go by place: names with dots or backticks can't be named in a plan.
    names = [*(c for c in frame.columns if c != out_col), out_col]
    rows = by_place(frame)
    rows = rows.select(*(own for own, name in zip(rows.columns, frame.columns, strict=True) if name != out_col))
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = learned(Decoder, name, shared)
        for batch in batches:
            texts = [decoder.text(ids.values.to_numpy().tolist()) if ids.is_valid else "" for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "out"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("out", StringType())).toDF(*names)
