"""Byte-level tokens, alignment and periodic runs against the tokenizer libraries and plain versions."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tidewire.llm import alignment, byte_bpe, periodic_runs, queries

DOC = "doc_id long, text string"


def texts() -> list[str | None]:
    draw = random.Random(4)
    parts = ["a", "tide", "naïve", "日本", "\n", " ", "  ", "\t", "'s", "x#1", "é", "…", "▁", "🙂", "<|endoftext|>", "The", "　", "12345", "\r\n", "'ll", "ing", "\x00", "\x1c", "\x85"]
    out: list[str | None] = [None, "", " ", "\n", "▁", "a▁b", "a" * 3000, " \n" * 500, "tide over " * 300]
    out += ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 40))) for _ in range(400)]
    return [*out, *out[:20], " ".join(f"w{draw.randrange(10**4)}" for _ in range(5000))]


def documents(spark, found):
    return spark.createDataFrame(list(enumerate(found)), DOC)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    documents(spark, texts()).write.parquet(f"{folder}/documents.parquet")
    return folder


# Byte-level BPE


def library():
    with open(queries.BYTE_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op11_is_the_librarys(spark, tables):
    own = library()
    for row in queries.op11_byte_bpe(spark, tables).collect():
        text = texts()[row["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_transducer_merges_as_plain_merging_does():
    draw = random.Random(1)
    for _ in range(60):
        # Vocabularies of few letters, whose merges get in each other's way; some tokens no merge makes.
        tokens = [bytes([c]) for c in b"abc"]
        for _ in range(draw.randrange(2, 12)):
            new = draw.choice(tokens) + draw.choice(tokens)
            if new not in tokens:
                tokens.append(new)
        ranks = {t: i for i, t in enumerate(tokens)}
        merges = byte_bpe.Merges.of(ranks)
        machine = byte_bpe.Transducer(merges, most_states=40)
        for n in range(1, 7):
            for letters in itertools.product(b"abc", repeat=n):
                word = bytes(letters)
                want = [ranks[word]] if word in ranks else [ranks[p] for p in byte_bpe.merged(word, ranks)]
                assert machine.encode(word) == want


def test_decoding_byte_by_byte_is_decoding_whole():
    draw = random.Random(2)
    samples = ["naïve 日本 🙂".encode(), b"\xff\xe6\x97", b"\xf0\x9f\x99", b"\xed\xa0\x80x", b"\xc0\xaf\xf4\x90"]
    samples += [bytes(draw.choice([0x41, 0x80, 0xBF, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(draw.randrange(12))) for _ in range(4000)]
    for raw in samples:
        out, pending = [], b""
        for i in range(0, len(raw), 2):
            text, pending = byte_bpe.Utf8.feed(pending, raw[i : i + 2])
            out.append(text)
        assert "".join(out) + "�" * bool(pending) == raw.decode(errors="replace")


def test_old_words_stay_and_long_words_are_linear():
    encoder = byte_bpe.Encoder(byte_bpe.Merges.load(queries.BYTE_RANKS))
    encoder.words.most = 5
    own = library()
    for text in ["one two three four five six seven eight one two", "ab" * 100_000, "one eight nine"]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == own.encode_ordinary(text)


def test_decode_keeps_columns_of_any_name(spark):
    merges = byte_bpe.Merges.load(queries.BYTE_RANKS)
    rows = spark.createDataFrame([([64], 1, 2, 3), (None, 4, 5, 6), ([10**6], 7, 8, 9)], "ids array<int>, `a.b` int, `c``d` int, decoded int")
    found = byte_bpe.decode(rows, merges)
    assert found.columns == ["ids", "a.b", "c`d", "decoded"]
    assert [tuple(r)[1:] for r in found.collect()] == [(1, 2, merges.bytes_of()[64].decode()), (4, 5, ""), (7, 8, "")]


# Alignment


def plain_alignment(found: list[str | None]) -> list[tuple]:
    """Two pointers over each text's tokens, by the vocabularies' own libraries."""
    a_model = Tokenizer.from_file(queries.BYTE_MODEL)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    letters = alignment.byte_letters()
    with open(queries.BYTE_MODEL, encoding="utf-8") as file:
        a_bytes = {i: bytes(letters[c] for c in t) for t, i in json.load(file)["model"]["vocab"].items()}
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[1:-1], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    held, out = Counter(), []
    for text in found:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        a_raw, b_raw = [a_bytes[i] for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
            a = b = a_raw = b_raw = []
        links, groups, own = [], [], ([], [])
        i = j = a_end = b_end = 0
        while i < len(a):
            links.append((a[i], b[j]))
            a_next, b_next = a_end + len(a_raw[i]), b_end + len(b_raw[j])
            if a_next <= b_next:
                own[0].append(a[i])
                i, a_end = i + 1, a_next
            if b_next <= a_next:
                own[1].append(b[j])
                j, b_end = j + 1, b_next
            if a_next == b_next:
                groups.append("|".join(",".join(map(str, x)) for x in own))
                own = ([], [])
        held.update(set(links))
        out.append((len(a), len(b), groups, links))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(n, m, len(g), len(k), sum(held[p] == most[p[0]] for p in k), sum(held[p] for p in k), digest(g)) for n, m, g, k in out]


def test_op12_is_plain_alignment(spark, tables):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r["doc_id"]: tuple(r[c] for c in names) for r in queries.op12_alignment(spark, tables).collect()}
    assert rows == dict(enumerate(plain_alignment(texts())))


@pytest.mark.parametrize("part", [30, 200])
def test_parted_texts_align_as_whole_ones(monkeypatch, part):
    monkeypatch.setattr(alignment, "PART_LENGTH", part)
    monkeypatch.setattr(alignment, "AT_ONCE", 60)
    block = alignment.Block(alignment.Aligner(alignment.Both.load(queries.BYTE_MODEL, queries.PIECES)), texts())
    want = plain_alignment(texts())
    assert list(zip(*block.counts.tolist(), block.digests, strict=True)) == [(*w[:4], w[6]) for w in want]
    made = block.row()
    docs, which, times = alignment.unpack(made["inside"])
    assert (docs == block.docs).all() and (made["pairs"][which] == block.pairs).all() and times.sum() == sum(w[3] for w in want)
    assert len(set(zip(docs.tolist(), which.tolist(), strict=True))) == len(docs)


# Periodic runs


def plain_runs(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def loop_in(draw: random.Random, words: list, start: int, end: int) -> list:
    p = 1 + (end - start) // (3 + draw.randrange(8))
    return words[:start] + [words[start + (i - start) % p] for i in range(start, end)] + words[end:]


@pytest.mark.parametrize("small", [1, 2, 4, 64])
def test_runs_are_those_of_every_lag(monkeypatch, small):
    monkeypatch.setattr(periodic_runs, "SMALL", small)
    draw = random.Random(small)
    for _ in range(1200):
        kinds, n = draw.choice([1, 2, 3, 5, 50]), draw.randrange(120)
        words = [draw.randrange(kinds) for _ in range(n)]
        for _ in range(draw.randrange(3) if n else 0):
            start = draw.randrange(n)
            words = loop_in(draw, words, start, draw.randrange(start, n + 1))
        for exponent in (3, 4):
            assert periodic_runs.runs(np.array(words, np.int64), 6, exponent) == plain_runs(words, 6, exponent)


def test_long_periods_are_found():
    draw = random.Random(9)
    for _ in range(40):
        n = draw.randrange(600, 2500)
        words = [draw.randrange(draw.choice([2, 50, 1000])) for _ in range(n)]
        for _ in range(draw.randrange(1, 4)):
            start = draw.randrange(n)
            words = loop_in(draw, words, start, draw.randrange(start, n + 1))
        assert periodic_runs.runs(np.array(words, np.int64)) == plain_runs(words)


def test_op13_is_the_plain_contract(spark, tmp_path):
    draw = random.Random(6)
    found: list[str | None] = [None, "", " \n ", "one", "x " * 40, "a b " * 3 + "a"] * 9
    found += [" ".join(draw.choice("abcdefgh") + draw.choice("xyz é") for _ in range(draw.randrange(1, 400))) + draw.choice(["", "\n\n"]) for _ in range(400)]
    documents(spark, found).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(rows) == len(found)
    for id_, text in enumerate(found):
        words = brute.words(text)
        h, n = zlib.crc32(str(id_).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4))
        assert tuple(rows[id_][c] for c in ("n_runs", "start", "length", "period", "exponent_milli")) == want
        assert rows[id_]["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert rows[id_]["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


# Awkward rows


@pytest.mark.parametrize("empty", [False, True])
def test_nulls_repeats_clashes_and_empty_tables(spark, empty):
    rows = [(None, "a b c " * 30, 1, 2, 3), (1, None, 4, 5, 6), (1, None, 4, 5, 6), (2, "a b c " * 30, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, ids int, `block` int, `a.b` int").limit(0 if empty else 9)
    merges, n = byte_bpe.Merges.load(queries.BYTE_RANKS), 0 if empty else 4
    assert byte_bpe.encode(docs, merges).count() == n
    found, pairs = alignment.align(docs, alignment.Both.load(queries.BYTE_MODEL, queries.PIECES))
    assert found.count() == n and (pairs.count() > 0) != empty
    assert empty or {r["n"] for r in pairs.collect()} == {2}
    runs = periodic_runs.periodic_runs(docs)
    assert runs.count() == n
    assert {r["collapsed"] for r in runs.where(F.size("runs") > 0).collect()} == (set() if empty else {"a b c"})


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_of_any_name(spark, tmp_path, empty):
    draw = random.Random(3)
    prose = [" ".join(f"w{draw.randrange(900)}" for _ in range(200)) for _ in range(6)]
    found = [*prose, prose[0], prose[1] + " end", None, ""]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), i, i, i, i, i) for i, t in enumerate(found)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id int, kept_key int, `a.b` int, `c``d` int, gone int"
    docs = spark.createDataFrame(rows, schema).limit(0 if empty else 99)
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns
        assert all(r[0] == r[5] == r[6] == r[7] == r[8] == r[9] for r in left.collect())
        assert (left.count() > 0) != empty
