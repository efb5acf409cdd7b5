"""Corpus operators against plain versions of their methods, on small inputs."""

from __future__ import annotations

import gzip
import io
import itertools
import math
import random
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from tidewire.llm import importance, language_id, license_scan, media, mixing, quality_rules, sentencepiece, simhash, substring_dedup, toxicity

DOC = "doc_id long, text string"


def words(draw: random.Random, n: int, letters: str = "abcdefgh") -> list[str]:
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(2, 8))) for _ in range(n)]


# Substring dedup


@pytest.mark.parametrize("shard_words", [1_500_000, 900])
def test_hot_runs_in_one_shard_and_in_several(spark, shard_words):
    draw = random.Random(7)
    own = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    shared, other = own(70), own(55)
    docs = {}
    for i in range(120):
        part = shared if i % 3 else shared[: draw.randrange(40, 70)]
        docs[i] = " ".join([*own(draw.randrange(60)), *part, *own(draw.randrange(60)), *(other if i % 5 == 0 else []), *(shared if i % 50 == 0 else [])])
    found = substring_dedup.dedup(spark.createDataFrame(list(docs.items()), DOC), texts=False, shard_words=shard_words)
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()} == brute.repeats(docs)


def test_index_finds_every_window_of_its_sequences():
    draw = random.Random(3)
    sequences = [[draw.randrange(4) for _ in range(draw.randrange(1, 30))] for _ in range(40)]
    flat = np.array([w + 1 for s in sequences for w in s], np.uint64)
    sizes, owners = np.array([len(s) for s in sequences]), np.array([draw.randrange(9) for _ in sequences])
    index = substring_dedup.FMIndex(flat, sizes, owners, 5)
    least = {}
    for s, o in zip(sequences, owners):
        for i in range(len(s) - 4):
            least[tuple(s[i : i + 5])] = min(o, least.get(tuple(s[i : i + 5]), o))
    lane, start, owner = index.matches(flat, sizes)
    want = {(k, i): least[tuple(s[i : i + 5])] for k, s in enumerate(sequences) for i in range(len(s) - 4)}
    assert dict(zip(zip(lane.tolist(), start.tolist()), owner.tolist())) == want


def test_a_text_of_nine_million_words(spark):
    draw = random.Random(5)
    first = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    long = " ".join([*(f"z{i % 1_000_003}" for i in range(8_700_000)), *first[:200]])
    rows = spark.createDataFrame([(1, " ".join(first)), (2, long)], DOC)
    assert {r["id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(rows, texts=False).collect()} == {1: (300, 0), 2: (8_700_200, 200)}


# Language identification


def parse(reference: str, text: str) -> int:
    """Longest matches of a text against all substrings of the reference."""
    n, now = 1, ""
    for c in text:
        if now + c in reference:
            now += c
        else:
            n, now = n + 1, c if c in reference else ""
    return n


def test_phrases_are_longest_matches():
    draw = random.Random(1)
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    han = "".join(map(chr, range(0x4E00, 0x4E00 + 300)))
    known = [("a", some("abcde ", 3000)), ("b", some("abcxyé ", 3000)), ("zh", some(han, 2000))]
    parser = language_id.Parser(language_id.Reference(tuple(known)), dense=6)
    texts = ["", "abc", known[0][1][100:2900], known[2][1][:1500] + "² ½ q", some("abcdexyé é Zq", 3000), "² ½ Ⅷ", known[0][1]]
    spell = lambda text: "".join(chr(100 + s) for s in parser.symbols_of(text))
    want = [[parse(spell(reference), spell(t)) for t in texts] for _, reference in known]
    assert parser.phrases([parser.symbols_of(t) for t in texts]).tolist() == want
    languages, scores, _ = parser.predict(texts)
    assert languages == ["und", "a", "a", "zh", "b", "und", "a"] and all(0 <= s <= 1 for s in scores)


def test_what_a_reference_holds_is_bounded(spark):
    rows = [(i, "x" * 50 + "yz " * 200, "en" if i % 2 else "fr") for i in range(60)] + [(7, "x" * 50, "en")] * 30
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.reference(frame, F.lit(True), "doc_id", "text", "lang", 10, 500, 800)
    assert [k for k, _ in found.texts] == ["en", "fr"]
    assert all(len(t) <= 400 + 10 for _, t in found.texts) and all(len(t.split(" ")) >= 10 for _, t in found.texts)


# Toxicity


def test_label_model_is_that_of_single_rows():
    draw = np.random.default_rng(2)
    truth = draw.random(400) < 0.3
    rows = (draw.random((400, 6)) < np.where(truth[:, None], 0.7, 0.1)).astype(float)
    rows[:, 5] = rows[:, 4]
    patterns, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    first = np.where(patterns.mean(1) > 0.3, 0.8, 0.1)
    model = toxicity.LabelModel(patterns, counts, first)

    def fit(weights, posterior):
        for _ in range(50):
            rates = [[(sum(m * r[j] for m, r in zip(mass, rows)) + 0.5) / (sum(mass) + 1) for j in range(6)] for mass in ([1 - p for p in posterior], posterior)]
            prior = min(0.99, max(0.01, sum(posterior) / len(posterior)))
            posterior = []
            for r in rows:
                odds = math.log(prior / (1 - prior))
                for j in range(6):
                    on, off = (rates[1][j], rates[0][j]) if r[j] else (1 - rates[1][j], 1 - rates[0][j])
                    odds += weights[j] * math.log(on / off)
                posterior.append(1 / (1 + math.exp(-odds)))
        return rates, posterior

    rates, posterior = fit([1] * 6, first[inverse.ravel()].tolist())
    residual = np.array([[r[j] - p * rates[1][j] - (1 - p) * rates[0][j] for j in range(6)] for r, p in zip(rows, posterior)])
    scale = np.sqrt((residual**2).mean(0)) + 1e-9
    shared = residual.T @ residual / 400 / np.outer(scale, scale)
    assert np.allclose(model.correlations, shared, atol=1e-6) and shared[4, 5] > 0.99
    weights = [1 / (1 + sum(shared[i, j] for j in range(6) if j != i and shared[i, j] > 0.2)) for i in range(6)]
    assert np.allclose(model.weights, weights, atol=1e-6)
    _, posterior = fit(weights, posterior)
    assert np.allclose(model.posterior[inverse.ravel()], posterior, atol=1e-5)
    assert ((model.posterior[inverse.ravel()] > 0.5) == truth).mean() > 0.85


def test_toxicity_of_held_out_documents(spark):
    draw = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = words(draw, 60)
        for w in draw.sample(["idiot", "moron", "blarg", "grumpf", "snorkle", "zzyzx"], 3) if toxic else []:
            text.insert(draw.randrange(60), w)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame([*docs, (600, None), (601, "")], DOC)
    found = toxicity.score(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("id") % 3 != 1, most=200, unlabelled=200)
    held = {r["id"]: r["score"] for r in found.collect()}
    assert len(held) == 602 and held[600] == held[601] < 0.5
    out = [i for i in range(600) if i % 3 == 1]
    assert all((held[i] >= 0.7) == (i % 4 == 0) for i in out)


# Media


def png() -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples() -> dict[str, bytes]:
    sound, packed = io.BytesIO(), io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setparams((1, 1, 8000, 0, "NONE", ""))
        w.writeframes(bytes(100))
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "text")
    frame = b"\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00"
    webp = b"VP8 " + struct.pack("<I", 10) + bytes(10)
    return {
        "image/png": png(),
        "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab" + frame + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00\x12\xff\x00\x34\xff\xd9",
        "image/gif": b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"!\xf9\x04\0\0\0\0\0" + b",\0\0\0\0\1\0\1\0\0\x02\x02\x44\x01\x00;",
        "image/bmp": media.bitmap(bytes(192)),
        "audio/wav": sound.getvalue(),
        "image/webp": b"RIFF" + struct.pack("<I", 4 + len(webp)) + b"WEBP" + webp,
        "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF",
        "application/zip": packed.getvalue(),
        "application/gzip": gzip.compress(b"text" * 50, mtime=0),
        "audio/flac": b"fLaC\x80\x00\x00\x04abcd" + b"\xff\xf8frames",
    }


@pytest.mark.parametrize("kind", sorted(samples()))
def test_each_format(kind):
    data = samples()[kind]
    assert (kind, 0, len(data)) in media.find(data)
    inside = media.find(b"head " + data + (b"" if kind == "audio/flac" else b" tail"))
    assert (kind, 5, len(data)) in inside
    assert not [m for m in media.find(data[:-1]) if m[0] == kind and m[1] == 0] or kind == "audio/flac"


def test_sniffing_corrects_types_and_carves(spark):
    files = samples()
    rows = [(i, bytearray(b"x" * i + data), "text/plain") for i, data in enumerate(files.values())] + [(99, bytearray(b"plain text"), "image/png")]
    found = {r["id"]: r for r in media.sniff(spark.createDataFrame(rows, "id int, data binary, kind string"), type_col="kind").collect()}
    assert found[0]["type"] == next(iter(files)) and found[99]["type"] == "text/plain"
    for i, (kind, data) in enumerate(files.items()):
        if i:
            assert (kind, i, len(data)) in {(e["type"], e["start"], e["length"]) for e in found[i]["embedded"]}


def test_many_signatures_take_no_quadratic_time():
    data = b"%PDF-1 PK\x03\x04 " * 40_000
    assert media.find(data) == []


# Importance resampling


def test_log_ratios_and_the_sample(spark):
    draw = random.Random(6)
    docs = {i: " ".join(words(draw, draw.randrange(1, 40), "abc" if i % 3 else "cde")) for i in range(90)}
    docs[90] = ""
    known = {i: int(i % 3 == 0) for i in range(0, 90, 2)}
    frame = spark.createDataFrame(list(docs.items()), DOC)
    labels = spark.createDataFrame(list(known.items()), "doc_id long, quality int")
    bits = 12
    found = {r["id"]: r for r in importance.resample(frame, labels, share=0.4, bits=bits).collect()}

    def grams(text: str) -> list[int]:
        import pyarrow as pa

        row, bucket = importance.grams(pa.array([text]), bits)
        return bucket.tolist()

    raw, target = [0] * (1 << bits), [0] * (1 << bits)
    for i, t in docs.items():
        for b in grams(t):
            raw[b] += 1
            target[b] += known.get(i, 0)
    ratio = lambda b: math.log((target[b] + 1) / (sum(target) + (1 << bits)) / ((raw[b] + 1) / (sum(raw) + (1 << bits))))
    for i, t in docs.items():
        assert found[i]["n_grams"] == len(grams(t))
        assert found[i]["log_ratio"] == pytest.approx(sum(map(ratio, grams(t))), abs=1e-9)
    order = sorted(docs, key=lambda i: (-found[i]["key"], i))
    assert {i for i in docs if found[i]["kept"]} == set(order[: round(0.4 * len(docs))])


# SentencePiece


def unigram() -> sentencepiece.Model:
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "ba": -3.0, "aba": -4.2, "▁a": -2.4, "▁ab": -3.9, "c": -5.0, "bab": -4.0}
    pieces = {p: (i + 1, s) for i, (p, s) in enumerate(scores.items())}
    return sentencepiece.Model(pieces, {}, 0, False, max(map(len, pieces)))


def test_viterbi_gives_the_best_path_of_a_unigram_model():
    model = unigram()
    encoder = sentencepiece.Encoder(model)
    for word in map("".join, itertools.product("abc", repeat=6)):
        marked, best = "▁" + word, None
        for cuts in itertools.product([False, True], repeat=len(marked) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(marked)]
            path = [marked[a:b] for a, b in zip([0, *ends], ends)]
            if all(p in model.pieces for p in path):
                best = max(best or (-1e9,), (sum(model.pieces[p][1] for p in path),))
        flat, ends = encoder.encode([word])
        by_id = {i: (p, s) for p, (i, s) in model.pieces.items()}
        assert "".join(by_id[i][0] for i in flat.tolist()) == marked
        assert sum(by_id[i][1] for i in flat.tolist()) == pytest.approx(best[0])


def test_merging_leaves_one_path_of_neighbours(spark):
    from tidewire.llm.queries import PIECES

    model = sentencepiece.Model.load(PIECES)
    encoder = sentencepiece.Encoder(model)
    draw = random.Random(8)
    for word in ["▁" + "".join(draw.choice("aehinrst") for _ in range(draw.randrange(1, 9))) for _ in range(60)]:
        paths = [[]]
        for start in range(len(word)):
            for path in [p for p in paths if sum(map(len, p)) == start]:
                for end in range(start + 1, len(word) + 1):
                    piece = word[start:end]
                    if piece in model.pieces and encoder.is_whole(piece) and (not path or encoder.stays(path[-1], piece)):
                        paths.append([*path, piece])
        whole = [p for p in paths if sum(map(len, p)) == len(word)]
        assert len(whole) == 1
        flat, _ = encoder.encode([word[1:]])
        assert flat.tolist() == [model.pieces[p][0] for p in whole[0]]


# Quality rules


def test_learned_rules_and_the_verdict(spark):
    draw = random.Random(9)
    docs = {}
    for i in range(400):
        bad = i % 5 == 0
        docs[i] = (" ".join(w + ("#%$" if bad else "") for w in words(draw, 60)) + (" costs $5" if i % 7 == 0 else ""), bad)
    frame = spark.createDataFrame([(i, t) for i, (t, _) in docs.items()], DOC)
    labels = spark.createDataFrame([(i, int(not bad)) for i, (_, bad) in docs.items() if i % 3], "doc_id long, quality int")
    found, rules = quality_rules.judge(frame, labels)
    assert rules and all(len(r.conditions) <= 3 for r in rules)
    for r in found.collect():
        bad = False
        for rule in rules:
            bad |= all((value > c.threshold) == c.above for c in rule.conditions if (value := ratio(r, c.name)) is not None)
        assert r["kept"] == (not r["base_failed"] and not bad)
        # One price in a text doesn't make it bad.
        assert r["kept"] == (not docs[r["id"]][1])


def ratio(r, name: str) -> float | None:
    top, bottom = {"words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"), "marks": ("n_marks", "word_chars"), "digits": ("n_digits", "word_chars"), "distinct": ("n_distinct", "n_words"), "repeated": ("n_repeat_words", "n_words"), "lines": ("n_dup_lines", "n_words")}[name]
    return float(r[top]) if bottom is None else r[top] / r[bottom] if r[bottom] else None


def test_greatest_gain_comes_first(spark):
    rows = [(i, 30 + (i % 50), 100, 0, 0, 0, 20, 0, 0, 0, i % 50 >= 40) for i in range(600)]
    columns = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_capitals long, n_marks long, n_digits long, bad boolean"
    rules = quality_rules.learn(spark.createDataFrame(rows, columns))
    assert rules
    for words_, bad in ((30 + k, k >= 40) for k in (0, 20, 38, 41, 49)):
        values = {"words": words_, "mean_word": 100 / words_, "symbols": 0.0, "capitals": 0.0, "marks": 0.0, "digits": 0.0, "distinct": 20 / words_, "repeated": 0.0, "lines": 0.0}
        assert any(all((values[c.name] > c.threshold) == c.above for c in r.conditions) for r in rules) == bad


# SimHash


@pytest.mark.parametrize("distance", [1, 2])
def test_crowded_buckets_join_what_all_pairs_join(spark, distance):
    draw = random.Random(3)
    center, prints = draw.getrandbits(64), set()
    while len(prints) < 5000:
        x = center
        for _ in range(draw.randrange(7)):
            x ^= 1 << draw.randrange(64)
        prints.add(x)
    values = np.array(sorted(map(simhash.signed, prints)))
    want = set()
    for i, x in enumerate(values):
        apart = np.bitwise_count((values[i + 1 :] ^ x).view(np.uint64))
        want |= {(int(x), int(y)) for y in values[i + 1 :][apart <= distance]}
    rows = spark.createDataFrame([(int(v),) for v in values], "print long")
    whole = {(r["a"], r["b"]) for r in simhash.near_pairs(rows, distance, crowd=10**6).collect()}
    assert whole == want
    few = {(r["a"], r["b"]) for r in simhash.near_pairs(rows, distance, crowd=1).collect()}
    assert few <= want and joined(few) == joined(want)


def joined(edges: set[tuple[int, int]]) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def test_pivot_tables_bound_distances(spark):
    draw = random.Random(11)
    prints = [simhash.signed(draw.getrandbits(64)) for _ in range(50)]
    rows = simhash.pivot_table(spark.createDataFrame([(p,) for p in prints], "print long")).collect()
    pivots = [p & (1 << 64) - 1 for p in simhash.pivots()]
    for r in rows:
        assert list(r["table"]) == [((r["print"] & (1 << 64) - 1) ^ p).bit_count() for p in pivots]
    for a, b in itertools.combinations(rows, 2):
        apart = ((a["print"] ^ b["print"]) & (1 << 64) - 1).bit_count()
        assert max(abs(x - y) for x, y in zip(a["table"], b["table"])) <= apart


def test_near_copies_in_a_crowd(spark):
    draw = random.Random(12)
    template = [f"w{draw.randrange(10**9)}" for _ in range(300)]
    docs = {}
    for i in range(300):
        text = list(template)
        for _ in range(draw.randrange(12)):
            text[draw.randrange(300)] = f"x{draw.randrange(10**9)}"
        docs[i] = " ".join(text)
    sets = {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in docs.items()}
    edges = {(a, b) for a, b in itertools.combinations(docs, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    roots = joined(edges)
    found = simhash.near_copies(spark.createDataFrame(list(docs.items()), DOC))
    assert {r["id"]: r["component"] for r in found.collect()} == {i: roots.get(i, i) for i in docs}


def test_few_of_a_crowd_meet_in_pairs(spark, monkeypatch):
    """Copies around the similarity in question: most are joined before all that are left meet."""
    draw = random.Random(12)
    docs = {}
    for i in range(400):
        text = [f"w{j}" for j in range(150)]
        for j in range(draw.choice((2, 2, 3))):
            text[draw.randrange(150)] = f"x{i}y{j}"
        docs[i] = " ".join(text)
    sets = {i: frozenset(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in docs.items()}
    roots = joined({(a, b) for a, b in itertools.combinations(docs, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])})
    met = []
    every = simhash.all_pairs

    def counted(*given):
        found = every(*given)
        met.append(found.count())
        return found

    monkeypatch.setattr(simhash, "all_pairs", counted)
    found = simhash.near_copies(spark.createDataFrame(list(docs.items()), DOC))
    assert {r["id"]: r["component"] for r in found.collect()} == {i: roots.get(i, i) for i in docs}
    assert met[0] <= 400, met


# Mixing


def test_words_taken_come_near_the_target(spark):
    draw = random.Random(13)
    rows = [(i, "w " * draw.randrange(1, 200), f"s{draw.randrange(4)}" if i % 9 else None) for i in range(900)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        taken = sum(r["size"] * r["copies"] for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(0 <= r["copies"] <= 3 for r in own)


# License scans


def passages(text: str, k: int = 2, slack: int = 3, least: float = 0.6) -> set[str]:
    """Labels by plain diagonal voting: positions voted for on diagonals within `slack` of each other."""
    own, out = brute.LICENSE_WORD.findall(text.translate(brute.LOWER)), set()
    for label, passage in license_scan.PASSAGES:
        parts = passage.split()
        grams = [tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)]
        votes: dict[int, set[int]] = {}
        for p in range(len(own) - k + 1):
            for t, g in enumerate(grams):
                if tuple(own[p : p + k]) == g:
                    votes.setdefault(p - t, set()).add(t)
        for diagonal in votes:
            near = set().union(*(votes.get(diagonal + d, set()) for d in range(slack + 1)))
            if len(near) / len(grams) >= least:
                out.add(label)
    return out


def test_labels_of_changed_passages(spark):
    draw = random.Random(14)
    docs = {}
    for i, (_, passage) in enumerate(license_scan.PASSAGES):
        for j in range(4):
            parts = passage.split()
            for _ in range(j * 2):
                at = draw.randrange(len(parts))
                parts[at : at + 1] = draw.choice([[], ["word"], [parts[at], "added"]])
            docs[10 * i + j] = " ".join([*words(draw, 20), *parts, *words(draw, 20)])
    found = {r["id"]: {s["label"] for s in r["spans"] if not s["exact"]} for r in license_scan.scan(spark.createDataFrame(list(docs.items()), DOC)).collect()}
    assert found == {i: passages(t) for i, t in docs.items()}
    assert sum(map(bool, found.values())) > 20


def test_fingerprint_of_ties_and_repeats():
    hashes = np.array([0b01, 0b11, 0b01, 0b10], np.uint64)
    assert simhash.fingerprint(hashes) == 0b01
    assert simhash.fingerprint(hashes[:0]) == 0
    assert simhash.shingle_hashes(b"A b", 3).tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]
